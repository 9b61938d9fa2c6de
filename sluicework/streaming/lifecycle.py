"""The lifecycle of documents as a machine: every step is judged by the one before it.

``steps`` judges a table, ``steps_on_stream`` a stream. The stream keeps a document's events until the watermark
has passed them and then takes them in the order of their time, so what it tells is what the table tells of the
same events, however they arrive; events later than the watermark allows are dropped by Spark. The state of a
document is its last step and what waits; once it is finished it is forgotten after a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The steps of a document; it may fail from anywhere and be uploaded anew but while it is processed.
STEPS = ("UPLOADED", "PROCESSING", "PARSED", "CHUNKED", "EMBEDDED", "COMPLETED")
FAILED = "FAILED"
DONE = (STEPS[-1], FAILED)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def legal(before: str | None, now: str) -> bool:
    if now not in (*STEPS, FAILED):
        return False
    if before is None:
        return now == STEPS[0]
    if now == FAILED:
        return before not in DONE
    if now == STEPS[0]:
        return before != STEPS[1]
    return before in STEPS and STEPS.index(now) == STEPS.index(before) + 1


def legal_step(before: Column, now: Column) -> Column:
    pairs = [(b, n) for b in (None, *STEPS, FAILED) for n in (*STEPS, FAILED) if legal(b, n)]
    out = F.lit(False)
    for b, n in pairs:
        out = out | ((before.isNull() if b is None else before.eqNullSafe(F.lit(b))) & now.eqNullSafe(F.lit(n)))
    return out


def steps(events: DataFrame, key: str, at: str, status: str, *ties: str) -> DataFrame:
    """key, at, status, previous, legal: each event at which a document's status changes, in the order of at and
    ties, and whether the step from the status before is one that it may take. An illegal step is taken all the same:
    the document is where its events say. Events without a status, a time or a document are none."""
    known = events.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(status).isNotNull())
    w = Window.partitionBy(key).orderBy(at, *ties, status)
    seen = known.withColumn("previous", F.lag(status).over(w)).where(~F.col(status).eqNullSafe(F.col("previous")))
    return seen.select(key, at, status, "previous", legal_step(F.col("previous"), F.col(status)).alias("legal"))


class _Lifecycle(StatefulProcessor):
    """Events wait in a list, with a timer at the time of each; state times are milliseconds."""

    def __init__(self, key: str, at: str, status: str, keep: int):
        self.names, self.keep = (key, at, status), keep

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at long")
        self.waiting = handle.getListState("waiting", "micros long, status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, at, status = self.names
        due = set()
        for f in rows:
            for when, what in zip(f[at], f[status]):
                if what is not None and not pd.isna(when):
                    micros = pd.Timestamp(when).value // 1000
                    self.waiting.appendValue((micros, what))
                    due.add(micros // 1000)
        for ms in due:
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ripe = [w for w in waiting if w[0] // 1000 <= now]
        last = self.last.get() if self.last.exists() else None
        if not ripe:
            if last is not None and last[0] in DONE and now >= last[1] + self.keep:
                self.last.clear()
            return
        before, rows = last[0] if last is not None else None, []
        for micros, what in ripe:
            if what != before:
                rows.append((key[0], pd.Timestamp(micros, unit="us"), what, before, legal(before, what)))
                before = what
        rest = waiting[len(ripe) :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        end = ripe[-1][0] // 1000
        self.last.update((before, end))
        if before in DONE:
            self.handle.registerTimer(max(now + 1, end + self.keep))
        if rows:
            k, at, status = self.names
            yield pd.DataFrame(rows, columns=[k, at, status, "previous", "legal"])

    def close(self) -> None:
        pass


def steps_on_stream(events: DataFrame, key: str, at: str, status: str, delay: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """What ``steps`` tells of the same events, once the watermark (delay behind the latest) has passed them. The state
    of a document that is completed or has failed is dropped keep_ms after its last event; should it go on after that
    it starts anew. Statuses at the same microsecond go by name, as in ``steps`` without ties.

    Sets the session's state store to RocksDB, which state with timers needs."""
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, {status} string, previous string, legal boolean"
    rows = events.select(key, at, status).where(F.col(key).isNotNull()).withWatermark(at, delay)
    return rows.groupBy(key).transformWithStateInPandas(_Lifecycle(key, at, status, keep_ms), schema, "Append", "EventTime")
