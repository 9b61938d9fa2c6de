"""Streams: arrivals, minute metrics, status feeds, incremental ingest. ``arrivals`` and ``minute_metrics`` give
on a stream what they give on a table; ``status_changes`` is for tables, ``status_feed`` for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.registry import parse_key
from ..sources.store import ChunkStore

ARRIVAL = "Records array<struct<eventName:string, s3:struct<object:struct<key:string>>>>"


def arrivals(events: DataFrame, completed: DataFrame | None = None) -> DataFrame:
    """user_id, doc_id of created objects, less those of completed (doc_id)."""
    e = events.select(F.explode("Records").alias("r")).select(F.col("r.eventName").alias("name"), F.col("r.s3.object.key").alias("key"))
    user, doc = parse_key(F.col("key"))
    out = e.where(F.col("name").startswith("ObjectCreated:")).select(user.alias("user_id"), doc.alias("doc_id")).where("doc_id is not null")
    return out if completed is None else out.join(completed.select("doc_id"), "doc_id", "left_anti").select("user_id", "doc_id")


def minute_metrics(jobs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """jobs: ts, outcome (processed or failed), duration_s. minute, n_processed, n_failed, sum_duration_s, n_duration."""
    if jobs.isStreaming:
        jobs = jobs.withWatermark("ts", delay)
    done = F.col("outcome") == "processed"
    out = jobs.groupBy(F.window("ts", "1 minute")).agg(
        F.count(F.when(done, 1)).alias("n_processed"),
        F.count(F.when(~done, 1)).alias("n_failed"),
        F.sum(F.when(done, F.col("duration_s"))).alias("sum_duration_s"),
        F.count(F.when(done, F.col("duration_s"))).alias("n_duration"),
    )
    return out.select(F.col("window.start").alias("minute"), "n_processed", "n_failed", "sum_duration_s", "n_duration")


def status_changes(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The rows at which a key's status differs from the one before (its first row included)."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("previous", F.lag(status).over(w)).where(~F.col(status).eqNullSafe(F.col("previous")))


def current_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))


def metric_totals(minutes: DataFrame) -> DataFrame:
    """One row of minute_metrics' sums: n_processed, n_failed, failure_rate (per cent) and average_duration_s, both to two places."""
    out = minutes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_processed", "n_failed", "n_duration")], F.sum("sum_duration_s").alias("s"))
    every = F.col("n_processed") + F.col("n_failed")
    rate = F.when(every > 0, F.round(100.0 * F.col("n_failed") / every, 2)).otherwise(0.0)
    return out.select("n_processed", "n_failed", rate.alias("failure_rate"), F.when(F.col("n_duration") > 0, F.round(F.col("s") / F.col("n_duration"), 2)).otherwise(0.0).alias("average_duration_s"))


def status_feed(events: DataFrame, key: str, order: str, status: str, terminal: list[str]) -> DataFrame:
    """key, order, status of a stream's changes: a key's first status, then each that differs from the one
    before, up to its first terminal one. The state is one status a key, which is kept;
    rows of a batch go by ``order``. Where the state of finished keys must go, use lifecycle.steps_on_stream."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(own: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        f = pd.concat(list(frames)).sort_values(order, kind="stable")
        rows = []
        for at, now in zip(f[order], f[status]):
            if last in terminal:
                break
            if now != last:
                rows.append((own[0], at, now))
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=[key, order, status])

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {status} {kinds[status]}"
    return events.select(key, order, status).groupBy(key).applyInPandasWithState(run, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def first_deliveries(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Repeated deliveries of a key within ``delay`` of event time go."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def ingest(batch: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], name: str, key: str = "doc_id", order: str | None = None) -> int:
    """Puts process(batch) into the chunk store at path in place of what it has of the batch's documents, and
    tells the commit. A document that process gives no chunk for has none any more. With ``order`` the last row
    of a document counts, without it all of them are processed. A batch of a name that is known does nothing."""
    rows = batch.where(F.col(key).isNotNull())
    if order is not None:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("_row")).select("_row.*")
    return ChunkStore(batch.sparkSession, path, key).put(rows, process(rows), name)


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], key: str = "doc_id", order: str | None = None, name: str = "stream"):
    """The started query that ingests what has arrived and ends; a batch is known by name and number, so that one
    that is replayed changes nothing. ``name`` stays the same for a checkpoint and differs between streams."""

    def run(batch: DataFrame, n: int) -> None:
        ingest(batch, path, process, f"{name}-{n}", key, order)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_messages(batch: DataFrame, path: str, encode: Callable[[Column], Column], name: str, key: str = "message_id", order: str = "at", text: str = "text") -> int:
    """Keeps one vector of each message in the store at path: that of its latest text by ``order``.

    Of the messages of the batch those go that the store has as late or later, so late and repeated ones change
    nothing. A blank text has no vector, and takes away the one from before; its row stays, with a null vector, so
    that what comes late behind it is known as late. Only key and order of the store are read."""
    store = ChunkStore(batch.sparkSession, path, key)
    rows = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(order, text), F.struct(order, text)).alias("_row")).select(key, "_row.*")
    if store.commits():
        known = store.read().select(F.col(key).alias("_key"), F.col(order).alias("_known"))
        rows = rows.join(known, F.col(key) == F.col("_key"), "left").where(F.col("_known").isNull() | (F.col("_known") < F.col(order))).drop("_key", "_known")
    said = F.col(text).rlike(r"(?U)\S")
    return store.put(rows, rows.select(key, order, F.when(said, encode(F.col(text))).alias("vector")), name)


def message_vectors(spark: SparkSession, path: str, key: str = "message_id") -> DataFrame:
    """key, vector of every message that has one."""
    return ChunkStore(spark, path, key).read().where("vector is not null").select(key, "vector")


def embed_stream(stream: DataFrame, path: str, checkpoint: str, encode: Callable[[Column], Column], key: str = "message_id", order: str = "at", text: str = "text", name: str = "messages"):
    """The started query that embeds what has arrived and ends."""

    def run(batch: DataFrame, n: int) -> None:
        embed_messages(batch, path, encode, f"{name}-{n}", key, order, text)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
