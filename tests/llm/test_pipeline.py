import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as C
from sluicework.llm import common
from sluicework.llm import quality_classifier as Q
from sluicework.llm import simhash_dedup as S

from .helpers import clashes_kept, documents, empty, with_clashes, words


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        t = "\n".join(words(rng, 40, 3000) for _ in range(3))
        bad = i % 8 == 0
        rows.append((i, " | ".join(t.split(" ")) if bad else t, "en", "s", len(t)))
        labels.append((i, int(not bad), 0))
    test_text = words(rng, 30, 5000)
    rows.append((200, words(rng, 60, 3000) + " " + test_text, "en", "s", 1))
    rows.append((201, rows[3][1], "en", "s", 1))
    near = rows[5][1].split(" ")
    near[20] = "changed"
    rows.append((202, " ".join(near).replace("\n", " "), "en", "s", 1))
    rows.append((203, rows[5][1].replace("\n", " "), "en", "s", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test_text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in C.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        seen.append({r.doc_id for r in docs.collect()})
    good = {i for i in range(160) if i % 8}
    assert good - {5} <= seen[1] and len(seen[0] - seen[1]) >= 18
    assert 201 not in seen[2] and good <= seen[2]
    assert 203 not in seen[3] or 202 not in seen[3]
    assert 200 in seen[3] and 200 not in seen[4]
    out = C.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == seen[4]


def test_near_duplicates_keep_one_of_each_group(spark):
    docs = documents(spark)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert 7 in left and 8 not in left and 9 not in left
    assert sum(d is None for d in left) == 1  # the copy without an id goes, the null text stays


def test_every_stage_bears_awkward_rows_empty_tables_and_columns_of_any_name(spark, tmp_path):
    docs = with_clashes(documents(spark))
    labels = [(i, int(i % 3 > 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c " * 9), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and clashes_kept(rows), name
        assert stage(spark, with_clashes(empty(spark)), str(tmp_path)).count() == 0, name
    bare = C.lines(spark, docs.select("doc_id", "text"), str(tmp_path))
    assert bare.columns == ["doc_id", "text"]
    assert C.packed(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages_hand_texts_to_python_in_small_batches(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c " * 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("abcd"), 2500).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def largest():
        return wide.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]

    before = spark.conf.get(common.BATCH_SETTING, None)
    try:
        for name, stage in C.STAGES:
            if stage is not C.lines:  # runs no Python
                spark.conf.unset(common.BATCH_SETTING)
                assert largest() > 4 * common.BATCH_BYTES
                stage(spark, documents(spark), str(tmp_path))
                assert largest() < 1.1 * common.BATCH_BYTES, name
        spark.conf.set(common.BATCH_SETTING, "1m")
        C.benchmark(spark, documents(spark), str(tmp_path))
        assert largest() < 1.1 * (1 << 20)
    finally:
        spark.conf.unset(common.BATCH_SETTING) if before is None else spark.conf.set(common.BATCH_SETTING, before)


def test_a_task_gives_back_what_arrow_keeps(monkeypatch):
    class Pool:
        times = 0

        def release_unused(self):
            self.times += 1

    pool = Pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
    run = common.released(lambda batches: (b for b in batches))(iter([batch, batch]))
    assert [next(run), next(run)] == [batch, batch] and pool.times == 1
    assert list(run) == [] and pool.times == 2


def test_the_fit_keeps_no_scaled_copy_of_its_rows():
    rng = np.random.default_rng(3)
    rows, y = [np.sort(rng.choice(Q.BUCKETS, 4000, False)).astype(np.int32) for _ in range(300)], rng.integers(0, 2, 300)
    tracemalloc.start()
    try:
        Q.fit_hinge(rows, y, rng.normal(size=Q.BUCKETS), epochs=1)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < sum(r.nbytes for r in rows)
