"""Splits of oversized parents: invariants, restated cases, and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from sluicework.operators import chunking as C
from sluicework.operators import parts as Q

E = "doc string, n int, text string, code boolean"


def parts(spark, *texts, code=()):
    df = spark.createDataFrame([("d", i, t, i in code) for i, t in enumerate(texts)], E)
    return Q.standard_parts(df, ["doc"], "n", atomic=F.col("code")).orderBy("part").collect()


def tokens(p):
    return max(1, len(p.text) // 4)


def sound(found, texts):
    """Within tokens and children, in order, and nothing lost or twice."""
    assert [p.part for p in found] == list(range(1, len(found) + 1)) and {p.part_count for p in found} == {len(found)}
    pieces = "".join(x for p in found for x in p.text.split("\n\n"))
    assert pieces == "".join(t for t in texts if t and t.strip()).replace("\n\n", "")
    for p in found:
        assert tokens(p) <= 1800 and 1 <= len(p.children) <= 8
        assert p.children[0].start == 0 and p.children[-1].end == len(p.text)
        for a, b in zip(p.children, p.children[1:]):
            assert a.start < b.start <= a.end


def test_a_huge_section_has_parts_within_the_budget(spark):
    texts = [f"Sentence with some distinctive words {i} here to add length. " * 8 for i in range(120)]
    found = parts(spark, *texts)
    sound(found, texts)
    assert len(found) >= 2 and min(len(p.children) for p in found) >= 4


def test_a_single_huge_element_is_cut_at_seams(spark):
    found = parts(spark, "z" * 15_000)
    sound(found, ["z" * 15_000])
    assert len(found) >= 3 and all((p.first, p.last) == (0, 0) for p in found)
    assert [(p.first_char, p.last_char) for p in found][0][0] == 0 and all(a.last_char == b.first_char for a, b in zip(found, found[1:]))
    text = "Some words to say. " * 900
    found = parts(spark, text)
    sound(found, [text])
    assert all(Q.is_seam(text, p.first_char) for p in found)


def test_two_large_elements_and_a_tail(spark):
    for texts in (["x" * 7500, "y" * 7500], ["x" * 7500, "y" * 7500, "c" * 400]):
        found = parts(spark, *texts)
        sound(found, texts)
        assert len(found) >= 2 and min(map(tokens, found)) > 200
    found = parts(spark, "sentence with enough words to fill a couple of windows. " * 25, " ", "tail words", "")
    assert len(found) == 1 and found[0].n_units == 2


def test_code_stays_whole_and_blocks_are_split_each(spark):
    code = "def f():\n  pass\n" * 60
    texts = ["Words in a line. " * 30] * 12 + [code] + ["More words in a line. " * 30] * 12
    found = parts(spark, *texts, code=[12])
    assert sum(code in p.text for p in found) == 1 and all(len(p.children) <= 8 for p in found)
    big = "x" * 9000
    assert [p.text for p in parts(spark, big, code=[0])] == [big]
    rows = [(d, i, "Some words. " * 70, False) for d in ("a", "b") for i in range(9)]
    by = Q.standard_parts(spark.createDataFrame(rows, E), ["doc"], "n").groupBy("doc").agg(F.sum("n_units").alias("n"), F.max("part_count").alias("c")).collect()
    assert {r.doc for r in by} == {"a", "b"} and all(r.n == 9 and r.c >= 2 for r in by)
    assert Q.standard_parts(spark.createDataFrame([("d", 0, " ", False), ("d", 1, None, False)], E), ["doc"], "n").collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_any_units_are_sound(seed):
    rng = random.Random(seed)
    for _ in range(25):
        texts = ["".join(rng.choice("abcdef. \n") for _ in range(rng.choice([3, 60, 400, 1500, 5000]))) for _ in range(rng.randrange(1, 40))]
        atomic = [rng.random() < 0.1 and len(t) < 3000 for t in texts]
        runs = Q.standard_runs(texts, atomic)
        assert [i for i, _ in runs] + [len(texts)] == [0] + [j for _, j in runs]
        stream = Q.Stream(texts, atomic)
        for i, j in runs:
            assert j - i == 1 or (len(stream.windows(i, j)) <= 8 and stream.chars(i, j) // 4 <= 1800)
        whole = stream.chars(0, len(texts)) // 4
        if whole <= Q.CLOSE_TOKENS and len(stream.windows(0, len(texts))) <= 8:
            assert len(runs) == 1


def test_seam_cuts_cover_the_text():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("abcdefgh" + " .\n" * (rng.random() < 0.7)) for _ in range(rng.randrange(1, 3000)))
        cuts = Q.seam_cuts(text, 100)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
        for a, z in cuts:
            assert z - a <= 403
        for _, z in cuts[:-1]:
            assert Q.is_seam(text, z) or not any(Q.is_seam(text, p) for p in range(z - 300, z))


def plain_legacy(sizes, preferred, cap):
    """The longest run that fits from each start, back to the last preferred place in it."""
    runs, start, n = [], 0, len(sizes)
    chars = lambda i, j: sum(sizes[i:j]) + 2 * (j - i - 1)
    while start < n:
        end = max([j for j in range(start + 1, n + 1) if chars(start, j) <= cap], default=start + 1)
        if end < n:
            end = max([p for p in range(start + 1, end + 1) if preferred[p]], default=end)
        runs.append((start, end))
        start = end
    return runs


def test_legacy_runs_against_a_plain_version():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 40)
        sizes, preferred = [rng.choice([0, 5, 20, 60, 150]) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)]
        want = plain_legacy(sizes, preferred, 100)
        assert Q.legacy_runs(sizes, preferred, hard_cap=100) == want
        chars = lambda i, j: sum(sizes[i:j]) + 2 * (j - i - 1)  # noqa: B023, E731
        while len(want) > 1 and chars(*want[-1]) < 50 and chars(want[-2][0], n) <= 160:
            want[-2:] = [(want[-2][0], n)]
        assert Q.legacy_runs(sizes, preferred, True, 100, 160) == want


def test_legacy_cases(spark):
    """An oversized section, an array cut at its items, lines cut at the starts of paragraph runs."""
    rows = [("d", i, "x" * n, False) for i, n in enumerate([1000, 4000, *[2506] * 8])]
    got = Q.legacy_parts(spark.createDataFrame(rows, E), ["doc"], "n", hard_cap=5000).orderBy("part").collect()
    assert len(got) >= 3 and all(r.n_chars <= 5002 for r in got) and sum(r.n_elements for r in got) == 10
    assert got[-1]["last"] == 9 and all(a["last"] + 1 == b["first"] for a, b in zip(got, got[1:]))

    leaves = [("d", 2 * i + j, f"$.users[{i}].{k}", "p" * 60) for i in range(50) for j, k in enumerate(("name", "mail"))]
    df = spark.createDataFrame(leaves, "doc string, n int, path string, text string")
    marked = Q.json_container_starts(df, ["doc"], "n")
    assert {r.n for r in marked.where("preferred").collect()} == {2 * i for i in range(1, 50)}
    got = Q.legacy_parts(marked, ["doc"], "n", preferred=F.col("preferred"), hard_cap=2000).orderBy("part").collect()
    assert len(got) > 1 and all(r["first"] % 2 == 0 and r.n_chars <= 2000 for r in got) and sum(r.n_elements for r in got) == 100

    lines = spark.createDataFrame([("d", n + i, "y" * 98) for n in (1, 101, 201) for i in range(10)], "doc_id string, line_number int, text string")
    runs = C.paragraph_runs(lines)
    begins = F.col("line_number") % 100 == 1
    got = Q.legacy_parts(runs, ["doc_id"], "line_number", preferred=begins, hard_cap=2000).orderBy("part").collect()
    assert [(r["first"], r["last"]) for r in got] == [(1, 110), (201, 210)]
    soft = Q.legacy_parts(runs, ["doc_id"], "line_number", preferred=begins, soft=True, soft_cap=2100, hard_cap=3000).collect()
    assert len(soft) == 1 and soft[0].n_chars == 2998
