"""Work along an order without a task for a whole key: numbering and greedy packing by ranges of rows.

Rows are dealt out by ranges of key and order. Each range is worked on by itself, in a form that says what it
would do for whatever comes before it; one pass over the ranges of a key, a few numbers each, settles what does
come before, and each range then finishes its own rows. So a key of any size spreads over many tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import written

#: Rows of a document that began in an earlier task that are packed together.
RANGE = 20_000


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n", sums: dict[str, str] | None = None) -> DataFrame:
    """df with the row's number (from 0) in its key, and new columns of sums: running sums of a column up to and
    with the row. Nulls of keys are one key; rows that tie in order are numbered in either order."""
    sums = sums or {}
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys, *order, "_tie").withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *keys).orderBy(*order, "_tie")
    here = dealt.select("*", F.row_number().over(w).cast("long").alias("_rownum"), *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    per = dealt.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_t{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    base = per.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], earlier("_c").alias("_c0"), *[earlier(f"_t{i}").alias(f"_o{i}") for i in range(len(sums))])
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    new = [(F.coalesce(F.col(f"_s{i}"), F.lit(0)) + F.col(f"_o{i}")).alias(s) for i, s in enumerate(sums)]
    return here.join(base, on).select(*df.columns, (F.col("_rownum") + F.col("_c0") - 1).alias(name), *new)


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "block") -> DataFrame:
    """df with the number (from 1 in its key) of the run of consecutive rows of equal value that a row is in."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys, *order, "_tie").withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *keys).orderBy(*order, "_tie")
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    here = written(dealt.withColumn("_new", changed))
    place = F.struct(*order, "_tie")
    per = here.groupBy("_pid", *keys).agg(F.min_by(F.struct(value), place).alias("_first"), F.max_by(F.struct(value), place).alias("_last"), F.sum("_new").alias("_sum"))
    ranges = Window.partitionBy(*keys).orderBy("_pid")
    before = F.lag("_last").over(ranges)
    per = per.withColumn("_open", (before.isNull() | ~F.col("_first").eqNullSafe(before)).cast("int"))
    earlier = F.coalesce(F.sum(F.col("_sum") + F.col("_open")).over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = per.select(F.col("_pid").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (earlier + F.col("_open")).alias("_base"))
    on = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return here.withColumn("_run", run).join(base, on).select(*df.columns, (F.col("_base") + F.col("_run")).cast("long").alias(name))


def _steps(size: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place i (and the end): where the next group starts if one starts at i, how many groups follow
    from there to the end of the range, and how full the last of them is."""
    n = len(size)
    groups, fill = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    ends = np.append(np.cumsum(size + 2), 0)  # ends[-1] is what stands before place 0
    must = np.append(np.flatnonzero(fresh), n)
    forced = must[np.searchsorted(must, np.arange(n), "right")]
    full = np.searchsorted(ends[:n], np.where(np.arange(n) > 0, ends[np.arange(n) - 1], 0) + most + 2, "right")
    after = np.maximum(np.arange(n) + 1, np.minimum(forced, full))
    for i in range(n - 1, -1, -1):
        j = after[i]
        groups[i] = groups[j] + 1
        fill[i] = fill[j] if j < n else ends[n - 1] - (ends[i - 1] if i else 0) - 2
    return after, groups, fill


def _first_break(ends: np.ndarray, forced: int, filled: int, most: int) -> int:
    """The first place of a range that does not join the group that comes in ``filled`` characters full."""
    return min(forced, int(np.searchsorted(ends, most - filled, "right"))) if filled else 0


def pack(rows: DataFrame, doc: str, order: str, size: str, most: int, fresh: str | None = None, alone: str | None = None, name: str = "group") -> DataFrame:
    """rows with the number (from 0 in each doc) of the group they fall into: in order, a row joins the group
    before it while the sizes, with 2 for each join, stay within ``most``.

    A row for which ``fresh`` holds starts a group, one for which ``alone`` does is one by itself. A row of null or
    no size joins nothing and has a null group, but where it is fresh the next row still starts one. Rows are dealt
    by ranges of doc and order and each task walks its own in order, many documents one after the other. Only the first
    document of a task can have begun in an earlier one. Of that, each RANGE rows say for each place where they may
    first be broken how many groups follow and how full the last is left; these, and how the last document of each
    task ends, are chained, and every task is told what its first row finds."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = {"_pack_size": F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long"), "_pack_fresh": flag(fresh), "_pack_alone": flag(alone), "_pack_tie": F.monotonically_increasing_id()}
    place = [doc, order, "_pack_tie"]
    dealt = rows.withColumns(own).repartitionByRange(tasks, *place).sortWithinPartitions(*place).drop("_pack_tie")
    dealt = written(dealt.withColumn("_pid", F.spark_partition_id()))
    kind = rows.schema[doc].dataType.simpleString()
    outcome = f"_doc {kind}, _pid int, _seq int, ends array<long>, forced long, n long, groups array<long>, fill array<long>, closed boolean, base long, filled long"
    span, key = RANGE, pa.field("_doc", to_arrow_type(rows.schema[doc].dataType))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each range of the task's first document offers, and how its last one ends if that is another."""
        opening, pid, seq, held, walk = None, 0, 0, [[], [], []], None
        for b in batches:
            docs, *marks = (b.column(i).to_pylist() for i in range(4))
            if opening is None and docs:
                opening, pid = (docs[0],), b.column(4)[0].as_py()
            at = 0
            if walk is None and docs:
                at = next((i for i, d in enumerate(docs) if d != opening[0]), len(docs))
                for h, m in zip(held, marks):
                    h += m[:at]
                while len(held[0]) >= span:
                    yield _offered(key, opening[0], pid, seq, *(h[:span] for h in held), most)
                    held, seq = [h[span:] for h in held], seq + 1
                if at < len(docs):
                    walk = Walk(most)
            if walk is not None:
                walk.groups(docs[at:], *(m[at:] for m in marks))
        if held[0]:
            yield _offered(key, opening[0], pid, seq, *held, most)
        if walk is not None:
            yield _told(key, walk.doc, pid, 0, base=walk.n + 1, filled=walk.filled)

    def chain(_: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out, base, filled = [], 0, 0
        for r in f.sort_values(["_pid", "_seq"]).itertuples(index=False):
            if r.ends is None:  # a document that begins in the task
                base, filled = int(r.base), int(r.filled)
                continue
            if r[2] == 0:
                out.append((r[1], base, filled))
            ends, n = np.asarray(r.ends), int(r.n)
            b = _first_break(ends, min(int(r.forced), len(ends)), filled, most)
            if n and b < n:
                base, filled = base + int(r.groups[b]), int(r.fill[b])
            elif n:
                filled += int(ends[-1])
            if r.closed:
                filled = 0
        return pd.DataFrame(out, columns=["_pid", "_base", "_filled"])

    states = dealt.select(doc, "_pack_size", "_pack_fresh", "_pack_alone", "_pid").mapInArrow(offer, outcome).groupBy("_doc").applyInPandas(chain, "_pid int, _base long, _filled long")
    names = [f"_c{i}" for i in range(len(rows.columns))]  # a column may have the name of the group's
    told = dealt.join(F.broadcast(states), "_pid", "left").select(doc, "_pack_size", "_pack_fresh", "_pack_alone", "_base", "_filled", *[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names)])
    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)]).add("_group", LongType())

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            if not b.num_rows:
                continue
            docs, *marks = (b.column(i).to_pylist() for i in range(4))
            if walk is None:
                walk = Walk(most, docs[0], b.column(4)[0].as_py(), b.column(5)[0].as_py())
            group = pa.array(walk.groups(docs, *marks), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[6:], group], [*names, "_group"])

    return told.mapInArrow(settle, schema).select(*[F.col(n).alias(c) for c, n in zip(rows.columns, names)], F.col("_group").alias(name))


class Walk:
    """Greedy packing row by row: the document, its last group and how full that is (0: nothing joins it)."""

    def __init__(self, most: int, doc=None, base: int = 0, filled: int = 0):
        self.most, self.doc, self.n, self.filled = most, doc, base - 1, filled

    def groups(self, docs: list, sizes: list[int], fresh: list[bool], alone: list[bool]) -> list[int | None]:
        most, doc, n, filled, out = self.most, self.doc, self.n, self.filled, []
        for d, s, new, own in zip(docs, sizes, fresh, alone):
            if d != doc:
                doc, n, filled = d, -1, 0
            if new:
                filled = 0
            if not s:
                out.append(None)
                continue
            if filled and not own and filled + 2 + s <= most:
                filled += 2 + s
            else:
                n, filled = n + 1, 0 if own else s
            out.append(n)
        self.doc, self.n, self.filled = doc, n, filled
        return out


def _offered(key: pa.Field, doc, pid: int, seq: int, sizes: list[int], fresh: list[bool], alone: list[bool], most: int) -> pa.RecordBatch:
    size, new, own = np.array(sizes, np.int64), np.array(fresh, bool), np.array(alone, bool)
    due, at = np.cumsum(new), np.flatnonzero(size > 0)
    must = np.diff(np.concatenate([[0], due[at]])) > 0
    must |= own[at]
    must[1:] |= own[at[:-1]]
    closed = bool(len(at) and own[at[-1]]) or bool(due[-1] > (due[at[-1]] if len(at) else 0))
    size, n = size[at], len(at)
    ends = np.cumsum(size + 2)
    forced = int(np.argmax(must)) if must.any() else n
    reach = min(forced, int(np.searchsorted(ends, most, "right")), n)  # no later first break is possible
    _, groups, fill = _steps(size, must, most)
    return _told(key, doc, pid, seq, ends[:reach], forced, n, groups[: reach + 1], fill[: reach + 1], closed)


def _told(key: pa.Field, doc, pid: int, seq: int, ends=None, forced=None, n=None, groups=None, fill=None, closed=None, base=None, filled=None) -> pa.RecordBatch:
    many, one = pa.list_(pa.int64()), pa.int64()
    fields = [key, ("_pid", pa.int32()), ("_seq", pa.int32()), ("ends", many), ("forced", one), ("n", one), ("groups", many), ("fill", many), ("closed", pa.bool_()), ("base", one), ("filled", one)]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((doc, pid, seq, ends, forced, n, groups, fill, closed, base, filled), pa.schema(fields))], schema=pa.schema(fields))
