"""The chunk store: versions, tombstones, replay, compaction, and ingest on tables and streams."""

import os

import pytest
from pyspark.sql import functions as F

from sluicework.sources import registry as R
from sluicework.sources.store import ChunkStore
from sluicework.streaming import feeds

DOC = "doc_id string, text string, at int"


def words(df):
    """A chunk a word; an empty text has none."""
    cut = df.select("doc_id", F.posexplode(F.split("text", " ")).alias("n", "text"))
    return cut.where("text <> ''")


def content(store, **how):
    return sorted((r.doc_id, r.text) for r in store.read(**how).collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs}


def docs(spark, *rows):
    return spark.createDataFrame([(*r, 0)[:3] for r in rows], DOC)


def test_versions_tombstones_and_replay(spark, tmp_path):
    path = f"{tmp_path}/store"
    store = ChunkStore(spark, path)
    assert feeds.ingest(docs(spark, ("a", "x y"), ("b", "z"), ("c", "u v"), (None, "lost")), path, words, "one") == 1
    assert content(store) == [("a", "x"), ("a", "y"), ("b", "z"), ("c", "u"), ("c", "v")]
    before = files(path)
    assert feeds.ingest(docs(spark, ("a", ""), ("b", "new")), path, words, "two") == 2
    assert content(store) == [("b", "new"), ("c", "u"), ("c", "v")]
    after = files(path)
    assert before.items() <= after.items()  # nothing of the first batch is rewritten
    assert feeds.ingest(docs(spark, ("a", "other")), path, words, "two") == 2 and files(path) == after
    assert content(store, as_of=1) == [("a", "x"), ("a", "y"), ("b", "z"), ("c", "u"), ("c", "v")]
    assert {r.doc_id: (r.version, r.n_chunks) for r in store.versions().collect()} == {"a": (2, 0), "b": (2, 1), "c": (1, 2)}
    feeds.ingest(docs(spark, ("a", "back")), path, words, "three")
    assert content(store) == [("a", "back"), ("b", "new"), ("c", "u"), ("c", "v")]
    with pytest.raises(ValueError):
        store.read(as_of=9)


def test_compaction_keeps_what_is_read_and_vacuum_what_is_needed(spark, tmp_path):
    path = f"{tmp_path}/store"
    store = ChunkStore(spark, path)
    for i, batch in enumerate([[("a", "x"), ("b", "y")], [("a", "")], [("c", "z z")]]):
        feeds.ingest(docs(spark, *batch), path, words, f"n{i}")
    assert store.compact("tidy") == 4 == store.compact("tidy")
    want = [("b", "y"), ("c", "z"), ("c", "z")]
    assert content(store) == want and {r.version for r in store.read().collect()} == {1, 3}
    assert store.vacuum() == [1, 2, 3] and content(store) == want and store.vacuum() == []
    assert sorted(os.listdir(f"{path}/parts")) == ["seq=4"]
    assert feeds.ingest(docs(spark, ("a", "again")), path, words, "n1") == 2  # known by name though its files are gone
    feeds.ingest(docs(spark, ("b", ""), ("d", "w")), path, words, "n9")
    assert content(store) == [("c", "z"), ("c", "z"), ("d", "w")]
    feeds.ingest(docs(spark, ("c", ""), ("d", "")), path, words, "n10")
    store.compact("tidy again")
    assert content(store) == []


def test_a_batch_without_a_commit_is_not_seen(spark, tmp_path):
    path = f"{tmp_path}/store"
    store = ChunkStore(spark, path)
    feeds.ingest(docs(spark, ("a", "x")), path, words, "one")

    def broken(df):
        return words(df).withColumn("text", F.raise_error(F.lit("no")).cast("string"))

    with pytest.raises(Exception, match="no"):
        feeds.ingest(docs(spark, ("a", "y")), path, broken, "two")
    assert content(store) == [("a", "x")]
    store._write("half", "put", words(docs(spark, ("a", "half"))).withColumn("version", F.lit(2).cast("long")), lambda w: w.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n_chunks")), 2)
    os.system(f"mv {path}/commits/seq=2 {tmp_path}/taken")  # as if the writer had died before the commit
    assert content(store) == [("a", "x")]
    assert feeds.ingest(docs(spark, ("a", "y")), path, words, "two") == 2 and content(store) == [("a", "y")]


def test_the_last_row_of_a_document_counts(spark, tmp_path):
    batch = docs(spark, ("a", "old", 1), ("a", "new", 2), ("b", "", 1), ("b", "gone", 0))
    feeds.ingest(batch, f"{tmp_path}/store", words, "one", order="at")
    assert content(ChunkStore(spark, f"{tmp_path}/store")) == [("a", "new")]


def test_stream_ingest_lets_emptied_documents_vanish(spark, tmp_path):
    path, store = f"{tmp_path}/store", ChunkStore(spark, f"{tmp_path}/store")

    def arrive(checkpoint="c"):
        live = spark.readStream.schema(DOC).json(f"{tmp_path}/in")
        feeds.ingest_stream(live, path, f"{tmp_path}/{checkpoint}", words, order="at").awaitTermination()

    docs(spark, ("a", "x y"), ("b", "z")).write.json(f"{tmp_path}/in")
    arrive()
    assert content(store) == [("a", "x"), ("a", "y"), ("b", "z")]
    docs(spark, ("a", "", 1), ("c", "w", 1)).write.mode("append").json(f"{tmp_path}/in")
    arrive()
    assert content(store) == [("b", "z"), ("c", "w")]
    seen = files(path)
    arrive()
    assert files(path) == seen
    arrive("lost checkpoint")  # batch 0 comes again under its name
    assert content(store) == [("b", "z"), ("c", "w")]


def test_replacement_by_the_documents_processed(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "doc_id string, n int")
    new = spark.createDataFrame([("b", 9)], "doc_id string, n int")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(R.replace_by_document(old, new)) == [("a", 1), ("b", 9), ("c", 3)]
    assert got(R.replace_by_document(old, new, touched=old.where("doc_id = 'a'"))) == [("b", 9), ("c", 3)]
