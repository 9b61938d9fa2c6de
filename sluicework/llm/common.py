"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is frequent if it holds more than one in so many times the number of partitions of the rows, but never if it holds no more than MANY.
SHARES, MANY = 4, 500
#: Bytes of rows in one Arrow batch to or from a Python worker, and Spark's setting for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """The folder of this session's checkpoints.

    Where spark.checkpoint.dir names none, a local session gets a temporary folder; a cluster, whose executors
    could not see one, gets an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, checkpointed once and read from there."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """The rows of df, written once as a table in the folder of the checkpoints and read from there.

    A checkpoint keeps the planner's estimate of its size, which every join multiplies; after some rounds of
    joins that is a number of millions of digits, and the planner takes minutes. A table has the size of its files."""
    path = f"{_folder(df.sparkSession)}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches of BATCH_BYTES, unless it has a setting of its own.

    Spark's 64 MB take all texts of a task at once, and an executor holds such a batch several times over: as vectors,
    as written for the worker, in the worker, and as read back. A row larger than a batch is a batch of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Gives back what Arrow's pool and, where it is glibc's, malloc keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, giving back freed memory before and after a task: a worker goes on from stage to stage."""

    @wraps(run)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


def fresh(taken: list[str], name: str) -> str:
    """The name, with underscores behind it until it is none of those taken (case does not tell names apart)."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name


def attach(rows: DataFrame, found: DataFrame, on: list[str], count: str | None = None, total: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """rows with the columns of found, which has each key (no nulls) once; rows without a key of found go.

    A key that holds more than 1 / (SHARES * partitions) of rows is frequent: at most SHARES * partitions
    keys are, so their list is broadcast. The rows of a frequent key are dealt over as many tasks as it has
    such shares, and its row of found goes to each of them. count names the column of found, if there is one, that says
    how many rows have its key; it is not returned. Else keys are counted in like, a cheaper table with the
    same keys, or in rows. rows is counted unless total says how many they are."""
    total = rows.count() if total is None else total
    least = max(MANY, total // (SHARES * partitions(rows.sparkSession)))
    if total <= least:
        return rows.join(found.drop(count) if count else found, on)
    per = (rows if like is None else like).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")) if count is None else found.withColumnRenamed(count, "_n")
    hot = F.broadcast(per.where(F.col("_n") > least).select(*[F.col(c).alias(f"_hot_{c}") for c in on], F.ceil(F.col("_n") / least).cast("int").alias("_tasks")))

    def dealt(df: DataFrame, deal: Column) -> DataFrame:
        met = df.join(hot, reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_hot_{c}") for c in on]), "left")
        return met.withColumn("_task", deal).drop("_tasks", *[f"_hot_{c}" for c in on])

    left = dealt(rows, F.when(F.col("_tasks").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("_tasks"))).otherwise(0).cast("int"))
    right = dealt(found.drop(count) if count else found, F.explode(F.sequence(F.lit(0), F.coalesce("_tasks", F.lit(1)) - 1)))
    return left.join(right, [*on, "_task"]).drop("_task")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns in which null equals null."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], rank: str) -> DataFrame:
    """Row number (from 1, as column ``rank``) and exclusive running sums within each key.

    The rows are dealt out by ranges of key and order, so that one key's rows may spread over many
    tasks: each range counts on its own, and what stands in the ranges before is then added. sums
    maps a new column to the column it adds up. Rows that tie in ``order`` are interchangeable.
    """
    spark = df.sparkSession
    dealt = cut(
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *keys, *order, "_tie")
        .withColumn("_pid", F.spark_partition_id())
    )
    w = Window.partitionBy("_pid", *keys).orderBy(*order, "_tie")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.select(
        "*",
        F.row_number().over(w).cast("long").alias("_n"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_s_{new}") for new, c in sums.items()],
    )
    per = dealt.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_t_{new}") for new, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        F.col("_pid").alias("_p2"),
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c0"),
        *[F.coalesce(F.sum(f"_t_{new}").over(earlier), F.lit(0)).alias(f"_o_{new}") for new in sums],
    )
    on = F.col("_pid") == F.col("_p2")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return here.join(offsets, on).select(
        *df.columns,
        (F.col("_n") + F.col("_c0")).alias(rank),
        *[(F.col(f"_s_{new}") + F.col(f"_o_{new}")).alias(new) for new in sums],
    )
