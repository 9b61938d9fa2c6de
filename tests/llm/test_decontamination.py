import random
import re

import pyarrow as pa
import pytest

from sluicework.llm import decontamination as D

from .helpers import ascii_lower, clashes_kept, documents, empty, with_clashes, words

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return PATTERN.findall(ascii_lower(t)) if t else []


def brute(texts, items, window=10):
    out = []
    for t in texts:
        w, hit, met = split(t), set(), set()
        for name, item in items:
            i = split(item)
            n = min(window, len(i))
            wins = {tuple(i[a : a + n]) for a in range(len(i) - n + 1)} if i else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in wins:
                    hit |= set(range(a, a + n))
                    met.add(name)
        out.append((len(w), len(hit), sorted(met)))
    return out


@pytest.mark.parametrize("blocks", [False, True])
def test_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(D, "BLOCK_BYTES", 400)
        monkeypatch.setattr(D, "SHARD_BYTES", 500)
    rng = random.Random(5)
    docs = documents(spark)
    texts = [r.text for r in docs.collect()]
    long = texts[7]
    items = [(1, long[100:260]), (2, words(rng, 30, 3)), (3, "a"), (4, None), (5, "?!"), (6, " ".join(split(long)[3:11])), (7, words(rng, 14, 60)), (7, long[100:260]), (None, " ".join(split(long)[40:52]).upper())]
    extra = [(100 + i, words(rng, 200, 3), None, None, None, None, None, None) for i in range(3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.find_matches(docs.drop("_n_words"), bench)
    got = rows.select("doc_id", "text", "_n_words", D.covered(rows._spans).alias("h"), "_spans").collect()
    want = brute([r.text for r in got], [("null" if i is None else str(i), t) for i, t in items])
    assert [(r._n_words, r.h, sorted({s.item for s in r._spans})) for r in got] == want
    assert sum(bool(w[1]) for w in want) > 5
    kept = D.decontaminate(docs.drop("_n_words"), bench)
    assert kept.columns == docs.drop("_n_words").columns and kept.count() == sum(not w[1] for w in want)


def test_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(empty(spark).drop("_n_words"), bench).count() == 0
    assert D.decontaminate(documents(spark).drop("_n_words"), bench).count() == documents(spark).count()


def test_columns_of_any_name_are_carried_through(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    docs = with_clashes(documents(spark))
    bench = spark.createDataFrame([(i, r.text[:200]) for i, r in enumerate(docs.where("doc_id > 8").collect()) if r.text], "item_id long, text string")
    found = D.find_matches(docs, bench)
    assert found.columns == [*docs.columns, "_n_words_", "_spans_"]
    rows = found.collect()
    assert clashes_kept(rows) and sum(r._n_words == 7 for r in rows) >= len(rows) - 2 and any(r["_spans_"] for r in rows)
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["_spans_"] for r in rows)
    assert D.decontaminate(with_clashes(empty(spark)), bench).count() == 0


def test_a_shard_spans_small_batches_and_parts_a_large_one(monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 100)
    texts = [["x" * 30] * 2, ["x" * 30, None, "x" * 30, "y" * 20], [], ["z" * 250, "", "é" * 60, "w"], [None]]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["text"]) for t in texts]
    shards = [[x for b in shard for x in b.column(0).to_pylist()] for shard in D._shards(iter(batches))]
    assert [x for s in shards for x in s] == [x for t in texts for x in t]
    assert [sum(len((x or "").encode()) for x in s) for s in shards] == [120, 270, 120, 1]
    assert [len(s) for s in shards] == [5, 2, 2, 2]
