"""Both arms of search, broadcast and in tiles, against plain versions; scope, odd ids, empty sides."""

import math
import random
import re
from collections import Counter

import pytest

from sluicework.operators import arms, search

INDEX = "id string, doc_id long, user_id long, chunk_type string, text string, vector array<double>"
ASKED = "query_id long, user_id long, doc_ids array<long>, text string, vector array<double>"


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if len(a) == len(b) and n else 0.0


def words(t):
    return re.findall(r"\w{2,}", (t or "").lower())


def plain(queries, rows, k, arm, scoped):
    average = sum(len(words(r[4])) for r in rows) / max(1, len(rows)) or 1
    out = set()
    for q, user, docs, text, v in queries:
        found = []
        for i, d, owner, _, t, w in rows:
            if scoped and (user is None or owner != user or (docs and d not in docs)):
                continue
            if arm == "dense":
                found.append((-round(cosine(v or [], w or []), 9), i))
                continue
            said = Counter(words(t))
            s = sum(n * said[x] * 2.2 / (said[x] + 1.2 * (0.25 + 0.75 * len(words(t)) / average)) for x, n in Counter(words(text)).items() if x in said)
            if s:
                found.append((-round(s, 9), i))
        out |= {(q, i, n, round(-s, 6)) for n, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


def tables(rng, n=230, m=37):
    vocabulary = [f"w{i}" for i in range(30)] + ["x"]
    say = lambda size: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(size)))
    vector = lambda: [float(rng.randrange(-2, 3)) for _ in range(rng.choice([3, 3, 3, 2, 0]))]
    user = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    rows = [(f"d{i}", i % 40, user(), "child", say(40), vector() if i % 11 else None) for i in range(n)]
    rows += [(f"same{i}", 1, 1, "child", "w1 w2", [1.0, 1.0, 0.0]) for i in range(30)]
    queries = [(i, user(), rng.choice([None, [], [1, 2, 3], [999]]), say(12) if i % 9 else None, vector() if i % 7 else None) for i in range(m)]
    return queries, rows


@pytest.mark.parametrize("seed", range(2))
def test_both_ways_find_what_a_plain_search_finds(spark, monkeypatch, seed):
    for name, value in (("TILE_QUERIES", 6), ("TILE_ROWS", 25), ("TILE_LEAST", 5), ("CHUNK", 16)):
        monkeypatch.setattr(arms, name, value)
    queries, rows = tables(random.Random(seed))
    q, i = spark.createDataFrame(queries, ASKED), spark.createDataFrame(rows, INDEX)
    for arm, run in (("dense", arms.dense_topk), ("bm25", arms.bm25_topk)):
        for scoped in (False, True):
            want = plain(queries, rows, 5, arm, scoped)
            for tiled in (False, True):
                got = {(r.query_id, r.id, r["rank"], round(r.score, 6)) for r in run(q, i.repartition(7), 5, scoped=scoped, tiled=tiled).collect()}
                assert got == want, (arm, scoped, tiled)


@pytest.mark.parametrize("tiled", [False, True])
def test_a_query_without_a_user_sees_nothing(spark, tiled):
    rows = [("a", 1, 1, "child", "one two", [1.0]), ("b", 2, 2, "child", "one two", [1.0]), ("c", 3, None, "child", "one two", [1.0])]
    index = spark.createDataFrame(rows, INDEX)
    lone = (9, None, None, "one", [1.0])
    for asked in ([lone], [lone, (8, 2, None, "one", [1.0])]):
        q = spark.createDataFrame(asked, ASKED)
        for run in (arms.dense_topk, arms.bm25_topk):
            assert [(r.query_id, r.id) for r in run(q, index, scoped=True, tiled=tiled).collect()] == [(8, "b")] * (len(asked) - 1)


@pytest.mark.parametrize("tiled", [False, True])
def test_text_ids_empty_partitions_and_empty_sides(spark, tiled):
    rows = [("b", 1, 1, "child", "one two", [1.0]), ("a", 2, 1, "child", "three", [1.0]), (None, 3, 1, "child", "one", [1.0])]
    index, q = spark.createDataFrame(rows, INDEX).repartition(9), spark.createDataFrame([(1, 1, None, "one", [2.0]), (2, 1, None, "zz", [])], ASKED)
    none = index.where("id = 'no'")
    for scoped in (False, True):
        got = [(r.query_id, r.id) for r in arms.bm25_topk(q, index, scoped=scoped, tiled=tiled).collect()]
        assert got == [(1, "b")]
        got = sorted((r.query_id, r["rank"], r.id) for r in arms.dense_topk(q, index, scoped=scoped, tiled=tiled).collect())
        assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b")]
        for run in (arms.dense_topk, arms.bm25_topk):
            assert run(q, none, scoped=scoped, tiled=tiled).collect() == []
            assert run(q.where("query_id = 0"), index, scoped=scoped, tiled=tiled).collect() == []


def test_many_queries_are_dealt_and_not_collected(spark, monkeypatch):
    monkeypatch.setattr(arms, "SMALL_QUERIES", 3)
    queries, rows = tables(random.Random(9), 60, 10)
    q, i = spark.createDataFrame(queries, ASKED), spark.createDataFrame(rows, INDEX)
    plans = [r(q, i)._jdf.queryExecution().toString() for r in (arms.dense_topk, arms.bm25_topk)]
    assert all("FlatMapCoGroupsInArrow" in p for p in plans)
    few = [r(q.where("query_id < 3"), i)._jdf.queryExecution().toString() for r in (arms.dense_topk, arms.bm25_topk)]
    assert not any("FlatMapCoGroupsInArrow" in p for p in few)


def test_hits_show_the_payload(spark):
    place = "array<struct<page:int>>"
    rows = [("c1", 1, 1, "child", "alpha beta", [1.0], "f.txt", ["A", "B"], [(3,), None]), ("c2", 1, 1, "child", "alpha", [1.0], None, None, None), ("p", 1, 1, "parent", "alpha beta", [1.0], "f.txt", [], [])]
    index = spark.createDataFrame(rows, INDEX + f", filename string, section_path array<string>, locations {place}")
    hits = search.retrieve(spark.createDataFrame([(1, 1, None, "alpha beta", [1.0])], ASKED), index, search.lexical_scorer).collect()
    assert [(h.id, h.filename, h.section_path, [x.page for x in h.locations]) for h in hits] == [("c1", "f.txt", ["A", "B"], [3]), ("c2", "", [], [])]
    assert hits[0].rerank_score == 1.0 and hits[0].score > hits[1].score
