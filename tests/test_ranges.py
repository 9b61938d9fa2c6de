"""Numbering, islands and greedy packing by ranges against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from sluicework.operators import chunking as C
from sluicework.operators import ranges as R
from sluicework.operators import structure as X


def plain(rows, most):
    """One row after the other: (document, order, size, fresh, alone)."""
    out, states = {}, {}
    for d, o, size, fresh, alone in sorted(rows, key=lambda r: r[:2]):
        filled, n = states.get(d, (None, -1))
        if fresh:
            filled = None
        if not size:
            out[(d, o)] = None
        else:
            joins = not alone and filled is not None and filled + 2 + size <= most
            n, filled = (n, filled + 2 + size) if joins else (n + 1, None if alone else size)
            out[(d, o)] = n
        states[d] = filled, n
    return out


@pytest.mark.parametrize(("rows_of_a_range", "most"), [(7, 30), (1, 30), (50, 12), (5, 200), (3, 9)])
def test_packing_by_ranges_is_packing_one_by_one(spark, monkeypatch, rows_of_a_range, most):
    monkeypatch.setattr(R, "RANGE", rows_of_a_range)
    rng = random.Random(most + rows_of_a_range)
    sizes = [None, 0, 1, 2, 3, 5, 8, 13, 40]
    rows = [(d, o, 1 if d == "ones" else rng.choice(sizes), rng.random() < 0.1, rng.random() < 0.08) for d, n in (("a", 120), ("b", 33), ("ones", 90), ("c", 1)) for o in range(n)]
    df = spark.createDataFrame(rows, "d string, o int, size int, fresh boolean, alone boolean")
    got = {(r.d, r.o): r.group for r in R.pack(df.repartition(5), "d", "o", "size", most, "fresh", "alone").collect()}
    assert got == plain(rows, most)


def test_numbering_and_islands_by_ranges(spark):
    rng = random.Random(8)
    rows = [(k, o, rng.choice(["a", "b", None])) for k, n in (("x", 400), ("y", 7), (None, 30)) for o in range(n)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(6)
    got = {(r.k, r.o): (r.n, r.s) for r in R.numbered(df.withColumn("one", F.col("o") * 0 + 1), ["k"], ["o"], "n", {"s": "one"}).collect()}
    assert got == {(k, o): (o, o + 1) for k, o, _ in rows}
    got, want, last = {(r.k, r.o): r.block for r in R.islands(df, ["k"], ["o"], "v").collect()}, {}, {}
    for k, o, v in rows:
        before = last.get(k, (0, "none"))
        last[k] = (before[0] + (before[1] != v), v)
        want[(k, o)] = last[k][0]
    assert got == want
    none = df.where("o < 0")
    assert R.numbered(none, ["k"], ["o"]).collect() == R.islands(none, ["k"], ["o"], "v").collect() == R.pack(none.withColumn("z", F.col("o")), "k", "o", "z", 5).collect() == []


def test_paragraph_groups_keep_runs_whole(spark):
    """Runs of ten lines of some 100 characters: a target of 1500 holds one, of 2500 two, of 100000 all."""
    rows = [("d", n + i, "x" * 98) for n in (1, 101, 201) for i in range(10)]
    lines = spark.createDataFrame(rows, "doc_id string, line_number int, text string")
    runs = {(r.line_number // 100): r.run for r in C.paragraph_runs(lines).collect()}
    assert runs == {0: 1, 1: 2, 2: 3}
    for target, want in ((1500, [1, 1, 1]), (2500, [2, 1]), (100_000, [3]), (10, [1, 1, 1])):
        got = C.paragraph_groups(lines, target=target).orderBy("group").collect()
        assert [r.n_runs for r in got] == want and sum(r.n_elements for r in got) == 30
        assert [(r.line_first, r.line_last) for r in got][0][0] == 1 and all(r.n_chars == 1000 * r.n_runs - 2 for r in got)
    odd = [("a", 1, 4, 4, "t"), ("a", 2, None, None, "u"), ("a", 3, 5, 9, "v"), ("a", 4, 11, 11, "w"), ("b", 1, None, None, "only")]
    lines = spark.createDataFrame(odd, "doc_id string, n int, low int, high int, text string")
    assert {(r.doc_id, r.n): r.run for r in C.paragraph_runs(lines, "doc_id", "low", "high", "n").collect()} == {("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("a", 4): 2, ("b", 1): 1}


def test_children_are_flushed_at_structure_even_by_blank_elements(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE", 2)
    rows = [("d", i, t, f) for i, (t, f) in enumerate([("a", False), ("b", False), (" ", True), ("c", False), ("e", True), ("f" * 9, False), ("g", False)])]
    df = spark.createDataFrame(rows, "d string, n int, text string, fresh boolean")
    got = [(r.first, r.last, r.text) for r in X.pack_children(df, "d", "n", most=12, fresh="fresh").orderBy("child").collect()]
    assert got == [(0, 1, "a\n\nb"), (3, 3, "c"), (4, 5, "e\n\n" + "f" * 9), (6, 6, "g")]
