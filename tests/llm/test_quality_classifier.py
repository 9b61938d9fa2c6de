import random

from pyspark.sql import functions as F

from sluicework.llm import quality_classifier as Q

from .helpers import clashes_kept, empty, with_clashes, words


def corpus(spark, n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        t = words(rng, rng.randrange(20, 80), 500)
        docs.append((i, "!! ".join(t.split()).upper() if bad else t))
        labels.append((i, int(not bad), 0))
    docs += [(n, None), (n + 1, ""), (None, "w1 w2")]
    labels += [(n + 1, None, 1), (None, 0, 0), (n + 7, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, monkeypatch):
    docs, labels = corpus(spark)
    for bound in (Q.BROADCAST_LABELS, 0):
        monkeypatch.setattr(Q, "BROADCAST_LABELS", bound)
        model = Q.train(docs.where(~Q.held_out(docs.doc_id)), labels)
        out = Q.score(docs, model).withColumn("h", Q.held_out(F.col("doc_id"))).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
        held = [r for r in out if r.h]
        assert held and all((r.score >= 0.3) == (r.doc_id % 5 != 0) for r in held)


def test_no_labels_and_empty(spark):
    docs, labels = corpus(spark, 20)
    assert {r.score for r in Q.score(docs, Q.train(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in Q.score(docs, Q.train(docs, labels.where("quality = 1"))).collect()} == {1.0}
    none = empty(spark).select("doc_id", "text")
    assert Q.score(none, Q.train(none, labels)).count() == 0


def test_columns_of_any_name_are_carried_through(spark):
    docs, labels = corpus(spark, 60)
    docs = with_clashes(docs)
    out = Q.score(docs, Q.train(docs, labels))
    assert out.columns == [*docs.columns, "score_"] and clashes_kept(out.collect())


def test_the_sample_keeps_both_bounds(spark, monkeypatch):
    docs, labels = corpus(spark)
    for rows, size in ((80, Q.FIT_BYTES), (10**6, 40_000)):
        monkeypatch.setattr(Q, "FIT_BYTES", size)
        model = Q.train(docs, labels, fit_rows=rows)
        assert model.constant is None
        held = [r for r in Q.score(docs.where("doc_id < 400"), model).collect()]
        assert sum((r.score >= 0.5) == (r.doc_id % 5 != 0) for r in held) > 380
