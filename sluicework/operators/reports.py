"""Reports over chunks and conversations: cascade delete, quality, audit, retrieval log, vectors still missing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows whose key is in gone."""
    return parents.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def chunk_report(children: DataFrame, doc: str, parent: str, tokens: str) -> DataFrame:
    """doc, n_parents, n_children, most, least and mean tokens of a child, fewest and most children of a
    parent, and how many parents have how many children (``4x2, 5x1``: two have four, one has five)."""
    per = children.groupBy(doc, parent).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("s"), F.max(tokens).alias("hi"), F.min(tokens).alias("lo"))
    sizes = per.groupBy(doc, "n").agg(F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    spread = F.transform(F.array_sort(F.collect_list(F.struct("n", "k"))), lambda x: F.concat_ws("x", x["n"].cast("string"), x["k"].cast("string")))
    return sizes.groupBy(doc).agg(
        F.sum("k").alias("n_parents"),
        F.sum(F.col("n") * F.col("k")).alias("n_children"),
        F.max("hi").alias("most"),
        F.min("lo").alias("least"),
        F.round(F.sum("s") / F.sum(F.col("n") * F.col("k")), 1).alias("mean"),
        F.min("n").alias("fewest_children"),
        F.max("n").alias("most_children"),
        F.array_join(spread, ", ").alias("distribution"),
    )


def chunk_audit(parents: DataFrame, children: DataFrame, parent: str, index: str, size: Column, most: float, band: tuple[int, int]) -> DataFrame:
    """check, n_violations for every check: orphans, gaps in the index, children over the cap, parents outside the band."""
    orphan = children.join(parents.select(parent), parent, "left_anti").agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit("orphan").alias("check"), "n_violations")
    before = F.lag(index).over(Window.partitionBy(parent).orderBy(index))
    gap = children.select((F.col(index) - before != 1).alias("bad")).agg(F.count_if("bad").alias("n_violations")).select(F.lit("gap").alias("check"), "n_violations")
    over = children.agg(F.count_if(size > most).alias("n_violations")).select(F.lit("over_cap").alias("check"), "n_violations")
    counts = children.groupBy(parent).count().agg(F.count_if(~F.col("count").between(*band)).alias("n_violations")).select(F.lit("outside_band").alias("check"), "n_violations")
    return orphan.unionAll(gap).unionAll(over).unionAll(counts)


def retrieval_log(stages: dict[str, DataFrame]) -> DataFrame:
    """query_id, stage, rank, id, score of every stage's hits."""
    return reduce(DataFrame.unionByName, [s.select("query_id", F.lit(name).alias("stage"), "rank", "id", F.col("score").cast("double").alias("score")) for name, s in stages.items()])


def retrieval_sizes(log: DataFrame) -> DataFrame:
    """query_id, stage, n_hits, best (score) of a retrieval_log."""
    return log.groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best"))


def backfill_vectors(messages: DataFrame, stored: DataFrame, keys: list[str], encode: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """keys, vector of messages that have a text and no stored vector yet; works on a stream of messages too."""
    fresh = messages.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return fresh.join(stored.select(*keys), keys, "left_anti").select(*keys, encode(F.col(text)).alias("vector"))


def changes_until_done(changes: DataFrame, key: str, order: list[str], status: str, terminal: list[str]) -> DataFrame:
    """Of a feed of status changes, those up to each key's first terminal one."""
    at = F.struct(*[F.col(c) for c in order])
    done = changes.where(F.col(status).isin(terminal)).groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_done"))
    return changes.join(done, F.col(key) == F.col("_key"), "left").where(F.col("_done").isNull() | (at <= F.col("_done"))).drop("_key", "_done")
