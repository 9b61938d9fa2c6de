"""Judged status steps on tables and streams, and message vectors as an upsert stream."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sluicework.sources.store import ChunkStore
from sluicework.streaming import feeds, lifecycle

EVENT = "doc string, at timestamp, status string"
T0 = datetime(2024, 1, 1)


def told(df):
    return sorted((r.doc, r["at"], r.status, r.previous, r.legal) for r in df.collect())


def test_legal_steps():
    way = [None, *lifecycle.STEPS]
    assert all(lifecycle.legal(a, b) for a, b in zip(way, way[1:]))
    assert all(lifecycle.legal(s, "FAILED") for s in lifecycle.STEPS[:-1]) and not lifecycle.legal("COMPLETED", "FAILED") and not lifecycle.legal(None, "FAILED")
    assert lifecycle.legal("FAILED", "UPLOADED") and lifecycle.legal("COMPLETED", "UPLOADED") and not lifecycle.legal("PROCESSING", "UPLOADED")
    assert not lifecycle.legal("UPLOADED", "PARSED") and not lifecycle.legal("CHUNKED", "PARSED") and not lifecycle.legal("UPLOADED", "NEW")


def test_steps_of_a_table(spark):
    rows = [("a", 0, "UPLOADED"), ("a", 1, "UPLOADED"), ("a", 2, "PARSED"), ("a", 3, "FAILED"), ("a", 4, "UPLOADED"), ("b", 0, "COMPLETED"), ("b", 1, "ODD"), ("b", 2, None), (None, 0, "UPLOADED")]
    df = spark.createDataFrame([(d, T0 + timedelta(minutes=m), s) for d, m, s in rows], EVENT)
    got = [(d, (a - T0).seconds // 60, s, p, ok) for d, a, s, p, ok in told(lifecycle.steps(df, "doc", "at", "status"))]
    assert got == [("a", 0, "UPLOADED", None, True), ("a", 2, "PARSED", "UPLOADED", False), ("a", 3, "FAILED", "PARSED", True), ("a", 4, "UPLOADED", "FAILED", True), ("b", 0, "COMPLETED", None, False), ("b", 1, "ODD", "COMPLETED", False)]


def test_a_stream_tells_what_the_table_tells(spark, tmp_path):
    """Events out of order within the watermark, in three arrivals; the last one only moves the watermark on."""
    before = spark.conf.get(lifecycle.PROVIDER)
    way = [*lifecycle.STEPS]
    rows = [("a", m, s) for m, s in enumerate(way)] + [("b", 0, "UPLOADED"), ("b", 1, "PARSED"), ("b", 3, "FAILED"), ("b", 4, "UPLOADED"), ("c", 2, "UPLOADED"), ("c", 2, "UPLOADED"), ("c", 5, None)]
    (tmp_path / "in").mkdir()
    arrivals = [[rows[i] for i in (4, 1, 8, 0, 10, 6)], [rows[i] for i in (2, 3, 5, 7, 9, 11, 12)], [("z", 600, "UPLOADED")], [("z", 1200, "PROCESSING")]]
    try:
        for n, batch in enumerate(arrivals):
            (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"doc": d, "at": (T0 + timedelta(minutes=m)).isoformat(), "status": s}) for d, m, s in batch))
            live = spark.readStream.schema(EVENT).json(f"{tmp_path}/in")
            out = lifecycle.steps_on_stream(live, "doc", "at", "status", keep_ms=60_000)
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        table = spark.createDataFrame([(d, T0 + timedelta(minutes=m), s) for b in arrivals for d, m, s in b], EVENT)
        want = told(lifecycle.steps(table, "doc", "at", "status"))
        got = told(spark.read.parquet(f"{tmp_path}/out"))
        assert [g for g in got if g[0] != "z"] == [w for w in want if w[0] != "z"]
        assert {(d, s) for d, _, s, _, ok in got if not ok} == {("b", "PARSED")}
        state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "last").load()
        kept = {r.key.doc for r in state.collect()}
        assert "a" not in kept and "b" in kept  # the finished one is forgotten
    finally:
        spark.conf.set(lifecycle.PROVIDER, before)


def test_message_vectors_are_upserted(spark, tmp_path):
    path, said = f"{tmp_path}/store", "message_id string, at int, text string"
    encode = lambda c: F.array(F.length(c).cast("double"))
    vectors = lambda: {r.message_id: r.vector for r in feeds.message_vectors(spark, path).collect()}
    batches = [
        [("a", 1, "one"), ("b", 1, "b"), ("a", 2, "seven77"), ("c", 1, "  "), (None, 1, "x")],
        [("a", 1, "one"), ("b", 3, "bbb"), ("d", 1, None)],  # a is late
        [("b", 4, " "), ("c", 2, "cc")],  # b is emptied
        [("b", 2, "old"), ("c", 2, "cc")],  # b is late behind its emptying, c is repeated
    ]
    wanted = [{"a": [7.0], "b": [1.0]}, {"a": [7.0], "b": [3.0]}, {"a": [7.0], "c": [2.0]}, {"a": [7.0], "c": [2.0]}]
    (tmp_path / "in").mkdir()
    for n, (batch, want) in enumerate(zip(batches, wanted)):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"message_id": m, "at": a, "text": t}) for m, a, t in batch))
        for checkpoint in ("c", "c"):
            feeds.embed_stream(spark.readStream.schema(said).json(f"{tmp_path}/in"), path, f"{tmp_path}/{checkpoint}", encode).awaitTermination()
        assert vectors() == want
    feeds.embed_messages(spark.createDataFrame([r for b in batches for r in b], said), path, encode, "all again")
    assert vectors() == wanted[-1]
    assert ChunkStore(spark, path, "message_id").read().groupBy("message_id").count().where("count > 1").count() == 0
