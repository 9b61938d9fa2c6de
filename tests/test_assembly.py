"""Windows and parents against plain versions, streams, delimited files, scoped search."""

import json
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from sluicework.operators import chunking as C
from sluicework.operators import search as S
from sluicework.operators import trees as G
from sluicework.sources import delimited as D
from sluicework.sources.store import ChunkStore
from sluicework.streaming import feeds


def plain_windows(s, structural, atoms):
    """The rules written out place by place, over sets of seams."""
    sentence = {i for i in range(1, len(s)) if s[i - 1] == "\n" or (s[i - 1] in ".!?;" and s[i] in " \n")}
    out, start = [], 0
    while start < len(s):
        atom = next((a for a in atoms if a[0] <= start < a[1]), None)
        if atom:
            if max(1, (atom[1] - atom[0]) // 4) <= 250:
                out.append(atom)
            else:
                at = atom[0]
                while at < atom[1]:
                    out.append((at, min(len(s), at + 1000)))
                    at = out[-1][1]
            start = atom[1]
            continue
        end = min(len(s), start + 1000)
        for a, _ in atoms:
            if start < a < end:
                end = a
                break
        for seams in (structural, sentence):
            hit = [p for p in range(end, max(start, end - 200) - 1, -1) if p in seams and p > start]
            if hit:
                end = hit[0]
                break
        if (len(s) - end < 300 or end - start <= 300) and max(1, len(s[start:]) // 4) <= 250:
            end = len(s)
        out.append((start, end))
        if end >= len(s):
            break
        for seams in (sentence, structural):
            hit = [p for p in range(end - 200, max(0, end - 300) - 1, -1) if p in seams]
            if hit:
                after = hit[0]
                break
        else:
            after = max(0, end - 250)
        start = after if after > start else end
    return out


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_those_of_the_plain_rules(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab .!;\n" if seed % 2 else "abcdefg" * 6 + " .") for _ in range(rng.randrange(1, 900 if k % 3 else 2600))) or "x" for k in range(9)]
    stream, starts = C._joined(texts)
    atoms = [(a, a + len(t)) for a, t in zip(starts, texts) if rng.random() < 0.3]
    for some in ([], atoms):
        assert C.window_spans(0, len(stream), starts[1:], C.sentence_seams(stream), some) == plain_windows(stream, set(starts[1:]), some)


def test_runs_are_coalesced_like_all_ways_to_cut_them():
    rng = random.Random(1)
    for _ in range(12):
        texts = ["".join(rng.choice("abcdef .") for _ in range(rng.randrange(200, 1900))) for _ in range(rng.randrange(1, 11))]
        n = len(texts)
        count = lru_cache(None)(lambda i, j: len(C.windows_of(texts[i:j])))  # noqa: B023

        def fits(i, j):
            size = len("\n\n".join(texts[i:j]))  # noqa: B023
            return size // 4 <= 1800 and count(i, j) <= 8 and (count(i, j) >= 4 or j == n)  # noqa: B023

        def ways(i):
            if i == n:
                yield ()
            for j in range(i + 1, n + 1):
                if j == i + 1 or fits(i, j):
                    for rest in ways(j):
                        yield ((i, j), *rest)

        def cost(cuts):
            lone = sum(not 4 <= count(i, j) <= 8 and j < n for i, j in cuts)  # noqa: B023
            return len(cuts) + lone * n, sum(abs(8 - count(i, j)) for i, j in cuts)  # noqa: B023

        got = tuple((a, b) for a, b, _ in C.coalesce_run(texts))
        assert cost(got) == min(map(cost, ways(0)))


def test_element_windows_own_what_they_overlap(spark):
    rng = random.Random(2)
    rows = [(d, i, "".join(rng.choice("abc .") for _ in range(rng.randrange(1, 700))) if i % 5 else None, i % 4 == 0) for d in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "d long, n int, text string, code boolean")
    got = C.element_windows(df, "d", "n", atomic=F.col("code")).collect()
    for d in range(3):
        mine = [(n, t, c) for k, n, t, c in rows if k == d and t and t.strip()]
        stream, starts = C._joined([t for _, t, _ in mine])
        for w in (w for w in got if w.d == d):
            own = [n for (n, t, _), a in zip(mine, starts) if a < w.w_end and a + len(t) > w.w_start]
            assert w.text == stream[w.w_start : w.w_end] and own[:1] in ([], [w["first"]]) and own[-1:] in ([], [w["last"]])


def test_status_feed_and_ingest_on_streams(spark, tmp_path):
    rows = [("a", 1, "UP"), ("a", 2, "UP"), ("a", 4, "DONE"), ("a", 5, "UP"), ("b", 1, "UP"), ("b", 3, "FAILED"), ("b", 4, "FAILED")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"k": k, "n": n, "s": s}) for k, n, s in rows))
    live = spark.readStream.schema("k string, n long, s string").json(f"{tmp_path}/in")
    run = feeds.status_feed(live, "k", "n", "s", ["DONE", "FAILED"]).writeStream.format("memory").queryName("feed").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("feed").collect())) == [("a", 1, "UP"), ("a", 4, "DONE"), ("b", 1, "UP"), ("b", 3, "FAILED")]
    docs = spark.readStream.schema("k string, n long, s string").json(f"{tmp_path}/in").withColumnRenamed("k", "doc_id")
    store = ChunkStore(spark, f"{tmp_path}/store")
    process = lambda b: b.select("doc_id", "n", F.upper("s").alias("text"))
    feeds.ingest_stream(docs, f"{tmp_path}/store", f"{tmp_path}/c2", process).awaitTermination()
    assert store.read().count() == 7
    (tmp_path / "in" / "2.json").write_text(json.dumps({"k": "b", "n": 9, "s": "new"}))
    feeds.ingest_stream(docs, f"{tmp_path}/store", f"{tmp_path}/c2", process).awaitTermination()
    assert sorted((r.doc_id, r.n, r.text) for r in store.read().where("doc_id = 'b'").collect()) == [("b", 9, "NEW")]
    assert store.read().count() == 5


def test_delimited_files(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("\ufeffname;name;;b\n1;\"two\nlines\";3;4\n".encode())
    out = D.read_delimited(spark, f"{tmp_path}/x.csv")
    assert out.columns == ["name", "name_2", "column", "b"]
    assert [r[1] for r in out.collect()] == ["two\nlines"]
    assert D.unique_headers(["a", " a ", None, "", "a"]) == ["a", "a_2", "column", "column_2", "a_3"]
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa\xffb"),), (None,)], "c binary")
    assert [r[0] for r in df.select(D.decode_lenient("c")).collect()] == ["a�b", None]


def test_search_stays_within_user_and_documents(spark):
    index = [(i, i % 5, f"u{i % 2}", "parent" if i == 9 else "child", f"word{i % 3} common", [float(i % 4), 1.0]) for i in range(12)]
    chunks = spark.createDataFrame(index, "id long, doc_id long, user_id string, chunk_type string, text string, vector array<double>")
    queries = spark.createDataFrame([(1, "u0", None, "word0 common", [1.0, 1.0]), (2, "u1", [1, 3], "word1", [0.0, 1.0]), (3, "nobody", None, "common", [1.0, 0.0]), (4, "u0", [], None, [])], "query_id long, user_id string, doc_ids array<long>, text string, vector array<double>")
    hits = S.retrieve(queries, chunks, S.lexical_scorer, top_k=20).collect()
    seen = {q: {r.id for r in hits if r.query_id == q} for q in (1, 2, 3, 4)}
    assert seen[1] == seen[4] == {i for i in range(0, 12, 2)} and seen[2] == {i for i in range(1, 12, 2) if i % 5 in (1, 3) and i != 9} and not seen[3]
    best = [r for r in hits if r.query_id == 1 and r.rank == 1][0]
    assert best.id % 3 == 0 and best.rerank_score == 1.0
    with pytest.raises(ValueError):
        S.retrieve(queries, chunks, None, rerank_required=True)
    plain = S.retrieve(queries, chunks, None, top_k=2, fusion="dbsf").collect()
    assert all(r.rerank_score is None for r in plain) and len([r for r in plain if r.query_id == 1]) == 2


def test_trees_hand_on_what_containers_hold(spark):
    nodes = [("d", "a", None, 1, "list", None, None, 2), ("d", "b", "a", 2, "paragraph", "two", None, None), ("d", "c", "a", 1, "text_block", "x", None, None), ("d", "e", "c", 1, "paragraph", "one", 7, None), ("d", "f", None, 0, "table", None, None, None), ("d", "f", None, 0, "table", None, None, None), ("d", "g", "f", 1, "paragraph", " ", None, None), ("d", "h", "g", 1, "caption", None, None, None), ("d", "z", "y", 1, "paragraph", "lost", None, None)]
    df = spark.createDataFrame(nodes, "doc_id string, node string, parent string, pos int, type string, content string, page int, group int")
    got = [(r.node, r.parent, r.root, r.slide) for r in G.flatten(df).orderBy("order").collect()]
    assert got == [("f", None, "f", None), ("h", "f", "f", None), ("e", None, "a", 7), ("b", None, "a", 3)]
    assert G.flatten(df.limit(0)).count() == 0
