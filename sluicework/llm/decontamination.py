"""Benchmark decontamination by training suffix arrays.

Some SHARD_BYTES of training documents are a shard, whatever the size of the batches they come in. Its
sparse suffix array holds, in word order, every suffix that starts with a few words (the seed) that some benchmark text has in a row; no other suffix
can match a test suffix for a whole window. Every test suffix that begins a window is binary-searched
in it, which gives all places of its verbatim matches; places that follow one another join into the
longest matches. Documents never cross a shuffle.

The benchmark is taken in blocks of bounded size, each broadcast in turn, so it may be large too.

Defined cases: words are runs of 0-9, a-z (A-Z lower-cased) and anything outside ASCII. A null or
wordless text has no words and no match. An item of fewer words than a window, but not none, is one
window. An item of null id matches under the id ``null``. Repeated items and rows are all counted. A very
long text is searched as a whole, and ends its shard. Extra columns of documents, of any name, are carried
through untouched; those of benchmark are not read. Empty tables match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, released

#: Word bytes stay (A-Z lower-cased), all others become spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: UTF-8 bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Bytes of text after which a shard is closed.
SHARD_BYTES = 16 << 20
#: Most words of a seed.
SEED = 4

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("item", T.StringType())]))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def _mix(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h ^ ids[at + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class TestSuffixes:
    """The benchmark texts of a block as word numbers, with the suffixes that begin a window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        ids, start, need, item = [0], [], [], []
        for name, text in items:
            if not (words := split_words(text)):
                continue
            n, base = min(window, len(words)), len(ids)
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            starts = range(len(words) - n + 1)
            start += [base + i for i in starts]
            need += [n] * len(starts)
            item += [len(self.names)] * len(starts)
            self.names.append(name)
        self.ids = np.array(ids + [0] * window, np.int32)
        self.start, self.need, self.item = (np.array(x, np.int64) for x in (start, need, item))
        self.seed = int(min(SEED, self.need.min())) if len(start) else 0
        self.seeds = np.unique(_mix(self.ids, self.start, self.seed)) if len(start) else np.empty(0, np.uint64)


class SuffixArray:
    """The suffixes of ``ids`` at ``at``, in order of their first ``depth`` words; a 0 ends a text."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, depth: int):
        zeros = np.flatnonzero(ids == 0)
        self.ids = ids
        reach = zeros[np.searchsorted(zeros, at)] - at
        order = np.arange(len(at))
        group = np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))  # places in order that may still be moved
        for j in range(depth):
            if not len(open_):
                break
            o = order[open_]
            word = np.where(reach[o] > j, ids[np.minimum(at[o] + j, len(ids) - 1)], 0)
            by = np.lexsort((word, group[open_]))
            order[open_], word, g = o[by], word[by], group[open_][by]
            new = np.r_[True, (g[1:] != g[:-1]) | (word[1:] != word[:-1])]
            first = np.flatnonzero(new)
            group[open_] = open_[first][np.cumsum(new) - 1]
            size = np.diff(np.r_[first, len(new)])
            open_ = open_[np.repeat(size > 1, size) & (word > 0)]
        self.at = at[order]
        self.reach = reach[order]

    def _less(self, rows: np.ndarray, tests: TestSuffixes, which: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether the suffix in each row is before the test suffix, compared over that one's window."""
        out = np.full(len(rows), or_equal)
        left = np.arange(len(rows))
        j = 0
        while len(left):
            left = left[tests.need[which[left]] > j]
            r = rows[left]
            ours = np.where(self.reach[r] > j, self.ids[np.minimum(self.at[r] + j, len(self.ids) - 1)], 0)
            theirs = tests.ids[tests.start[which[left]] + j]
            out[left[ours < theirs]] = True
            out[left[ours > theirs]] = False
            left = left[ours == theirs]
            j += 1
        return out

    def search(self, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the interval of rows that match it for a whole window."""
        which, bounds = np.arange(len(tests.start)), []
        for or_equal in (False, True):
            lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(self.at), np.int64)
            while len(busy := np.flatnonzero(lo < hi)):
                mid = (lo[busy] + hi[busy]) // 2
                less = self._less(mid, tests, which[busy], or_equal)
                lo[busy] = np.where(less, mid + 1, lo[busy])
                hi[busy] = np.where(less, hi[busy], mid)
            bounds.append(lo)
        return bounds[0], bounds[1]


def search_shard(texts: list[bytes | None], tests: TestSuffixes) -> tuple[list[int], list[list[tuple[int, int, str]]]]:
    """The number of words of each text, and its longest matches (start word, end word, item)."""
    get = tests.vocabulary.get
    parts, counts = [np.zeros(1, np.int32)], []
    for t in texts:
        words = split_words(t) if t else []
        counts.append(len(words))
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(tests.start):
        return counts, spans
    ids = np.concatenate([*parts, np.zeros(SEED, np.int32)])
    known = ids > 0
    full = known[: len(ids) - SEED].copy()
    for j in range(1, tests.seed):
        full &= known[j : len(ids) - SEED + j]
    at = np.flatnonzero(full)
    h = _mix(ids, at, tests.seed)
    near = np.minimum(np.searchsorted(tests.seeds, h), len(tests.seeds) - 1)
    at = at[tests.seeds[near] == h]
    if not len(at):
        return counts, spans
    array = SuffixArray(ids, at, int(tests.need.max()))
    lo, hi = array.search(tests)
    n = hi - lo
    test = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    place, item, end = array.at[rows], tests.item[test], array.at[rows] + tests.need[test]
    by = np.lexsort((place, item))
    place, item, end = place[by], item[by], end[by]
    base = 1 + np.r_[0, np.cumsum(np.array(counts) + 1)]
    doc = np.searchsorted(base, place, "right") - 1
    for d, i, p, e in zip(doc.tolist(), item.tolist(), (place - base[doc]).tolist(), (end - base[doc]).tolist()):
        name, own = tests.names[i], spans[d]
        if own and own[-1][2] == name and p <= own[-1][1]:
            own[-1] = (own[-1][0], max(e, own[-1][1]), name)
        else:
            own.append((p, e, name))
    return counts, spans


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs with two last columns, ``_n_words`` and ``_spans`` (underscores follow where docs has
    columns of these names): word spans that match benchmark text verbatim for a window or more, each with the
    item's id; adjoining windows of one item are one span."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    names = [fresh(docs.columns, n) for n in ("_n_words", "_spans")]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], SPAN)])
    out = docs
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        tests = spark.sparkContext.broadcast(TestSuffixes([(r["item"], bytes(r["text"])) for r in block], window))
        if b:
            out = cut(out)
        out = out.mapInArrow(released(_searcher(tests, b > 0, names)), schema)
    return out


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).cast(pa.large_binary())


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of the batches in shards of some SHARD_BYTES of text, each a list of slices of batches."""
    shard, held = [], 0
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(_texts(whole)), 0).to_numpy(zero_copy_only=False)
        ends, at = held + np.cumsum(sizes.astype(np.int64)), 0
        while at < whole.num_rows:
            end = min(at + int(np.searchsorted(ends[at:], SHARD_BYTES)) + 1, whole.num_rows)
            shard.append(whole.slice(at, end - at))
            held, at = int(ends[end - 1]), end
            if held >= SHARD_BYTES:
                yield shard
                shard, held, ends = [], 0, ends - held
    if shard:
        yield shard


def _searcher(tests, again: bool, new: list[str]):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("item", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            texts = [t for b in shard for t in _texts(b).to_pylist()]
            every, found = search_shard(texts, tests.value)
            del texts
            at = 0
            for batch in shard:
                counts, spans = every[at : at + batch.num_rows], found[at : at + batch.num_rows]
                at += batch.num_rows
                columns = list(batch.columns)
                if again:
                    spans = [[(s["start"], s["end"], s["item"]) for s in old] + more for old, more in zip(columns[-1].to_pylist(), spans)]
                    columns = columns[:-2]
                own = pa.array([[{"start": s, "end": e, "item": i} for s, e, i in x] for x in spans], kind)
                names = [*batch.schema.names[: len(columns)], *new]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), own], names=names)

    return run


def covered(spans: Column) -> Column:
    """Words in the union of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")
    )
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs that match no window of the benchmark, with their own columns."""
    found = find_matches(docs, benchmark, window)
    return found.where(F.size(F.col(found.columns[-1])) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.array_sort(F.array_distinct(F.col("_spans.item")))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        covered(F.col("_spans")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )
