"""Line dedup by a suffix array over line-ID sequences.

Lines with a word become IDs (128-bit hashes); lines that occur once leave at once. The suffixes that
remain are ranked by distributed prefix doubling: the rank by 2k lines is the place, in a global sort,
of the pair of ranks by k lines here and k lines on; suffixes that share it with no other leave. A
stretch of m lines is then named by the ranks of the two longest power-of-two stretches that cover
it, so that equal names are an interval of common prefixes of m lines or more.

A line is deleted if it stands in a repeated run of lines with ``min_words`` words or more of which an
earlier copy exists: maximal runs are the union of the shortest such runs from each line onward and
backward, and those are what is named and compared. Earlier means a smaller doc_id (null first), then
text hash, then line.

Defined cases: a null text stays null and an empty one empty. Lines without a word take no part and are
never deleted. A text of which every line with a word is deleted leaves with its row. Rows equal in doc_id
and text are one document and all get its result; of equal texts under several doc_ids the smallest stays.
A very long text is one row, whose lines spread over the tasks like all others. Extra columns of any name
are carried through. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, fresh, running
from .quality_rules import let, words_of

#: Words of the shortest run that is deleted.
MIN_WORDS = 5
HAS_WORD = r"[^\x20\x09-\x0D]"

_DOC = ["_d", "_h"]


def _lines(text: Column) -> Column:
    """The lines with a word: their number i among all lines, their hashes and their words."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.size(words_of(x)).alias("n")))
    return F.filter(every, lambda x: x["n"] > 0)


def _with_runs(lines: Column, least: int) -> Column:
    """Each line with the shortest runs of ``least`` words from it onward and backward: how many lines
    (null if the text has too few) and the number of the run's other end."""

    def reach(x: Column, j: Column, way: int) -> Column:
        total, out = F.lit(0), []
        for k in range(least):
            total = total + F.coalesce(F.get(x, j + way * k)["n"], F.lit(-least * least))
            out.append((total >= least, F.lit(k + 1)))
        chain = F.lit(None).cast("int")
        for fits, k in reversed(out):
            chain = F.when(fits, k).otherwise(chain)
        return chain

    def one(x: Column):
        def make(e: Column, j: Column) -> Column:
            ahead, back = reach(x, j, 1), reach(x, j, -1)
            return F.struct(
                j.alias("j"), e["i"].alias("i"), e["h1"].alias("h1"), e["h2"].alias("h2"),
                ahead.alias("ahead"), F.get(x, j + ahead - 1)["i"].alias("end"), back.alias("back"), F.get(x, j - back + 1)["i"].alias("start"),
            )

        return make

    return let(lines, lambda x: F.transform(x, one(x)))


def _repeated(ranked: DataFrame, pair: list[str]) -> DataFrame:
    """The values of the pair that occur twice or more, each with its place in the order of such values and
    how often it occurs (c)."""
    twice = ranked.groupBy(*pair).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return cut(running(twice, [], pair, {}, "rank"))


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The line numbers (from 0) of the deleted runs of each document: doc_id as _d, text hash as _h,
    and runs, an array of (start, end)."""
    keyed = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"), "text")
    ids = keyed.select(F.explode(_lines(F.col("text"))).alias("x")).select("x.h1", "x.h2")
    rank0 = _repeated(ids, ["h1", "h2"])
    lines = keyed.select(*_DOC, F.explode(_with_runs(_lines(F.col("text")), min_words)).alias("x")).select(*_DOC, "x.*")
    total = rank0.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    lines = attach(lines, rank0, ["h1", "h2"], "c", total).drop("h1", "h2")
    lines = cut(lines.dropDuplicates([*_DOC, "j"]))  # repeated rows are one document

    onward = lines.where("ahead is not null").select(*_DOC, F.col("j").alias("s"), F.col("ahead").alias("m"), F.col("i").alias("start"), "end")
    backward = lines.where("back is not null").select(*_DOC, (F.col("j") - F.col("back") + 1).alias("s"), F.col("back").alias("m"), "start", F.col("i").alias("end"))
    runs = onward.unionByName(backward).distinct()

    level, ranks = 0, lines.select(*_DOC, "j", "rank")
    named = []
    while True:
        size = 1 << level
        here = runs.where((F.col("m") >= size) & (F.col("m") < 2 * size))
        at = ranks.select(*[F.col(c).alias(f"{c}1") for c in _DOC], F.col("j").alias("j1"), F.col("rank").alias("r1"))
        here = here.join(at, F.col("_d").eqNullSafe(F.col("_d1")) & (F.col("_h") == F.col("_h1")) & (F.col("s") == F.col("j1"))).drop("_d1", "_h1", "j1")
        if level:
            at = ranks.select(*[F.col(c).alias(f"{c}2") for c in _DOC], F.col("j").alias("j2"), F.col("rank").alias("r2"))
            here = here.join(at, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")) & (F.col("s") + F.col("m") - size == F.col("j2"))).drop("_d2", "_h2", "j2")
        else:
            here = here.withColumn("r2", F.col("r1"))
        named.append(here)
        if 2 * size > min_words:  # a run has at most min_words lines
            break
        on = ranks.select(*[F.col(c).alias(f"{c}2") for c in _DOC], (F.col("j") - size).alias("j2"), F.col("rank").alias("r2"))
        pairs = ranks.join(on, F.col("_d").eqNullSafe(F.col("_d2")) & (F.col("_h") == F.col("_h2")) & (F.col("j") == F.col("j2"))).select(*_DOC, "j", F.col("rank").alias("r1"), "r2")
        pairs = cut(pairs)
        ranks = cut(attach(pairs, _repeated(pairs, ["r1", "r2"]), ["r1", "r2"], "c").select(*_DOC, "j", "rank"))
        level += 1
        if ranks.isEmpty():
            break
    every = named[0]
    for n in named[1:]:
        every = every.unionByName(n)
    every = cut(every)
    place = F.struct(F.col("_d").alias("d"), F.col("_h").alias("h"), F.col("s").alias("s"))
    firsts = every.groupBy("m", "r1", "r2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    later = attach(every, firsts, ["m", "r1", "r2"], "c").where(place > F.col("_first"))
    return later.groupBy(*_DOC).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))


def _merged(runs: Column) -> Column:
    """The union of the runs as disjoint ones, in order."""

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (r["start"] <= last["end"] + 1), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(runs, F.array().cast("array<struct<start:int,end:int>>"), step)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with later copies of repeated runs cut from text, and ``_removed``, the number
    of lines cut, as last column (with underscores behind its name where docs has a column of that name).
    Rows of which nothing with a word is left are not returned."""
    runs = find_runs(docs, min_words).select("_d", "_h", F.transform("runs", lambda r: F.struct(r["start"].cast("int").alias("start"), r["end"].cast("int").alias("end"))).alias("runs"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("key"))
    joined = keyed.join(runs, F.col("row.doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_h")), "left")
    lines = F.split("row.text", "\n", -1)

    def kept(all_runs: Column) -> Column:
        return F.filter(lines, lambda x, i: ~x.rlike(HAS_WORD) | ~F.exists(all_runs, lambda r: (i >= r["start"]) & (i <= r["end"])))

    left = joined.select("row", F.when(F.col("runs").isNotNull(), let(_merged(F.col("runs")), kept)).alias("left"))
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    removed = F.when(F.col("left").isNull(), 0).otherwise(F.size(lines) - F.size("left")).cast("long")
    some = F.col("left").isNull() | F.exists("left", lambda x: x.rlike(HAS_WORD))
    return left.where(some).select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns], removed.alias(fresh(docs.columns, "_removed")))


def op10_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).withColumnRenamed("_removed", "n_removed")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, u.i AS i, u.x AS x, len(list_filter(regexp_split_to_array(u.x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, k: {'x': x, 'i': k - 1})) AS u FROM documents)
), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l WHERE n > 0),
g AS (SELECT doc_id, list(x ORDER BY j) AS xs, list(n ORDER BY j) AS ns, list(i ORDER BY j) AS pos FROM b GROUP BY doc_id),
s AS (SELECT doc_id, xs, ns, pos, unnest(range(1, len(ns) + 1)) AS j FROM g),
m AS (
  SELECT doc_id, j AS s, list_min(list_filter([1, 2, 3, 4, 5], lambda k: j + k - 1 <= len(ns) AND list_sum(ns[j:j + k - 1]) >= 5)) AS m, xs, pos FROM s
  UNION ALL
  SELECT doc_id, j - m + 1 AS s, m, xs, pos FROM (
    SELECT doc_id, j, list_min(list_filter([1, 2, 3, 4, 5], lambda k: j - k >= 0 AND list_sum(ns[j - k + 1:j]) >= 5)) AS m, xs, pos FROM s)
), r AS (SELECT DISTINCT doc_id, s, m, array_to_string(xs[s:s + m - 1], chr(10)) AS k, pos[s] AS a, pos[s + m - 1] AS z FROM m WHERE m IS NOT NULL),
f AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(s) OVER w AS fs FROM r WINDOW w AS (PARTITION BY m, k ORDER BY doc_id, s)),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS i FROM f WHERE (doc_id, s) <> (fd, fs)),
o AS (SELECT l.doc_id, l.i, l.x, l.n, gone.i IS NOT NULL AS gone FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i AND l.n > 0)
SELECT doc_id, string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text, count(*) FILTER (WHERE gone) AS n_removed
FROM o GROUP BY doc_id HAVING count(*) FILTER (WHERE gone) = 0 OR count(*) FILTER (WHERE NOT gone AND n > 0) > 0
"""
