"""Parents: banded ones against all ways to cut, caps, places, tables, reading order, and the stand-in encoder."""

import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sluicework.functions import vectors
from sluicework.operators import chunking as C
from sluicework.operators import structure as X
from sluicework.operators import trees as G

SF = "/root/testdata/sf0.001"


def best_cut(texts, atomic):
    """(parents, distance) and the child counts of the cheapest way to cut a run, over all ways, by the rules as told."""
    stream, starts = C._joined(texts)
    seams = C.sentence_seams(stream)
    ends = [a + len(x) for a, x in zip(starts, texts)]
    n = len(texts)

    def windows(i, j):
        atoms = [(starts[u], ends[u]) for u in range(i, j) if atomic[u]]
        return len(C.window_spans(starts[i], ends[j - 1], starts[i + 1 : j], seams, atoms))

    best = [None] * n + [(0, 0, ())]
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, n + 1):
            if j > i + 1 and max(1, (ends[j - 1] - starts[i]) // 4) > 1800:
                break
            k = windows(i, j)
            if j > i + 1 and (k > 8 or (k < 4 and j < n)):
                continue
            lone = not 4 <= k <= 8 and j < n
            cost = (1 + lone * n + best[j][0], abs(8 - k) + best[j][1])
            if best[i] is None or cost < best[i][:2]:
                best[i] = (*cost, (k, *best[j][2]))
    return best[0]


def cost(parents, n):
    """The same two figures of parents that were found: (blocks, children) each."""
    lone = sum(not 4 <= k <= 8 for _, k in parents[:-1])
    return len(parents) + lone * n, sum(abs(8 - k) for _, k in parents)


def test_runs_with_code_are_cut_as_well_as_can_be():
    rng = random.Random(4)
    for _ in range(15):
        texts = ["".join(rng.choice("abcdef .") for _ in range(rng.randrange(150, 1700))) for _ in range(rng.randrange(1, 12))]
        atomic = [rng.random() < 0.3 for _ in texts]
        got = C.coalesce_run(texts, atomic=atomic)
        assert [a for a, _, _ in got] + [len(texts)] == [0] + [b for _, b, _ in got]
        want = best_cut(texts, atomic)
        assert cost([(b - a, k) for a, b, k in got], len(texts)) == want[:2]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_registered_parents_are_the_best_cuts_of_all_documents(spark):
    from sluicework.plans.queries import QUERIES

    got = {}
    for r in QUERIES["banded_parents"](spark, SF).orderBy("doc_id", "parent").collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = {r.doc_id: [x for x in r.text.split("\n") if x.strip(" ")] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got) == {d for d, x in docs.items() if x}
    for d, parents in got.items():
        lines = docs[d]
        if any(len(x) > 6000 for x in lines):
            continue  # a seam cuts the run
        assert sum(p.n_blocks for p in parents) == len(lines) and sum(p.n_chars for p in parents) == sum(map(len, lines)) + 2 * (len(lines) - len(parents))
        assert cost([(p.n_blocks, p.n_children) for p in parents], len(lines)) == best_cut(lines, [False] * len(lines))[:2]


def test_code_among_blocks_has_windows_of_its_own(spark):
    rows = [("d", i, "Words here. " * 40, i == 3) for i in range(9)]
    df = spark.createDataFrame(rows, "d string, n int, text string, code boolean")
    plain, code = (sum(r.n_children for r in C.banded_parents(df, "d", "n", atomic=a).collect()) for a in (None, F.col("code")))
    assert code >= plain >= 4


def test_token_caps_cut_at_seams(spark):
    rng = random.Random(3)
    texts = ["x" * 9000, "short", None, "y" * 7203, "y" * 7204, "x" * 7190 + ". z" + "x" * 900, "x" * 7191 + " " + "x" * 900, "x" * 6890 + " " + "x" * 900, "x" * 6889 + " " + "x" * 900]
    texts += ["".join(rng.choice("abcdefgh" * 9 + " .\n") for _ in range(rng.randrange(7000, 9000))) for _ in range(30)]

    def plain(t):
        if t is None or len(t) // 4 <= 1800:
            return t
        seams = [p for p in range(7191, 6890, -1) if t[p - 1] in " \t\n" or (t[p - 1] in ".!?;" and t[p] in " \n")]
        return t[: seams[0] if seams else 7191] + C.TRUNCATED

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", C.cap_tokens(F.col("t")).alias("c")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert all(c is None or len(c) // 4 <= 1801 for c in got.values())


def test_places_and_tables(spark):
    place = "struct<page:int,slide:int,sheet:string,cell_range:string,dom_path:string,line_start:int,line_end:int>"
    df = spark.createDataFrame([([(3, 2, "b", "B1:C1", "p", 4, 9), (1, None, "", "A1", None, None, None), (3, 1, "a", "B1:C1", "", 2, 3), None],), ([],)], f"places array<{place}>")
    both = df.select(C.location_summary(F.filter("places", lambda x: x.isNotNull()), fields=("page", "slide", "sheet", "cell_range", "dom_path", "line_start", "line_end")).alias("s")).collect()
    assert both[0].s.asDict() == {"pages": [1, 3], "slides": [1, 2], "sheets": ["b", "a"], "cell_ranges": ["B1:C1", "A1"], "dom_paths": ["p"], "line_min": 2, "line_max": 9}
    assert both[1].s.pages == [] and both[1].s.line_min is None
    rows = spark.createDataFrame([("t", 1, "s1", "A1:C1", []), ("t", 2, "s2", "A2:D2", ["x"]), ("u", 5, "s", "B7", ["y"])], "g string, n int, sheet string, r string, c array<string>")
    assert sorted(map(tuple, X.tabular_meta(rows, ["g"], "n", "sheet", "r", "c").collect())) == [("t", 1, 2, "s1", "A1:D2", ["x"]), ("u", 5, 5, "s", "B7", ["y"])]


def test_roots_in_reading_order(spark):
    rows = [("d", "a", None, 1, 2, 10.0, 5.0), ("d", "b", None, 2, 1, 50.0, 5.0), ("d", "c", None, 3, 1, 20.0, 9.0), ("d", "e", None, 4, 1, 20.0, 1.0), ("d", "f", None, 5, None, None, None), ("d", "k", "a", 7, 1, 0.0, 0.0)]
    nodes = spark.createDataFrame([(*r, "paragraph", r[1]) for r in rows], "doc_id string, node string, parent string, pos int, page int, y1 double, x1 double, type string, content string")
    flat = G.flatten(G.in_reading_order(nodes))
    assert [r.node for r in flat.orderBy("order").collect()] == ["e", "c", "b", "a", "k", "f"]


def test_the_stand_in_encoder(spark):
    texts = ["One two two", " ", None, "…", "Ünïcode word"]
    rows = vectors.embedded(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), 8).orderBy("i").collect()
    for r in rows:
        if not (r.text or "").strip():
            assert r.vector is None and r.provider is None
            continue
        counts = [0] * 8
        for w in re.findall(r"\w{2,}", r.text.lower()):
            counts[zlib.crc32(w.encode()) % 8] += 1
        n = math.sqrt(sum(c * c for c in counts)) or 1
        assert r.provider == "hashed" and r.vector == pytest.approx([c / n for c in counts])
    with pytest.raises(Exception, match="a vector of 8 was expected"):
        vectors.embedded(spark.createDataFrame([("x",)], "text string"), 8, lambda c: F.array(F.lit(1.0))).collect()
