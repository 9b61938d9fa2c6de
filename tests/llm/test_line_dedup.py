import random

import pytest

from sluicework.llm import line_dedup as D

from sluicework.llm import common

from .helpers import clashes_kept, documents, empty, with_clashes, words


def brute(rows, least):
    """rows: (doc_id, text), all distinct. Deleted line numbers of each, over all pairs of maximal runs."""
    lines = [[(i, x) for i, x in enumerate(t.split("\n")) if x.split()] if t is not None else [] for _, t in rows]
    gone = [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    place = {k: n for n, k in enumerate(order)}
    for a in range(len(rows)):
        for b in range(len(rows)):
            for i in range(len(lines[a])):
                for j in range(len(lines[b])):
                    if (place[b], j) >= (place[a], i):
                        continue
                    n = 0
                    while i + n < len(lines[a]) and j + n < len(lines[b]) and lines[a][i + n][1] == lines[b][j + n][1]:
                        n += 1
                    if n and sum(len(x.split()) for _, x in lines[a][i : i + n]) >= least:
                        gone[a] |= {k for k, _ in lines[a][i : i + n]}
    return gone


@pytest.mark.parametrize("least", [1, 5, 11])
def test_against_brute_force(spark, least):
    rng = random.Random(least)
    pool = [words(rng, rng.randrange(1, 4), 12) for _ in range(14)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 16)))) for i in range(14)]
    rows += [(50, None), (51, ""), (52, rows[0][1]), (53, "x\n" + rows[0][1] + "\ny"), (None, rows[1][1]), (54, "a\n" * 9 + "a")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, s string")
    got = {r.doc_id: r for r in D.dedup_lines(docs, least).collect()}
    for (d, t), gone in zip(rows, brute(rows, least)):
        if t is None:
            assert got[d].text is None
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if i not in gone]
        if gone and not any(x.split() for x in kept):
            assert d not in got
        else:
            assert got[d].text == "\n".join(kept) and got[d]._removed == len(gone) and got[d].s == "z", d


def test_awkward_rows(spark):
    docs = documents(spark)
    out = D.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_removed"]
    rows = out.collect()
    assert sum(r.text is None for r in rows) == 2 and all("_" not in (r.text or "") for r in rows)
    assert D.dedup_lines(empty(spark)).count() == 0


def test_columns_of_any_name_are_carried_through(spark):
    docs = with_clashes(documents(spark))
    out = D.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_removed_"]
    rows = out.collect()
    assert clashes_kept(rows) and any(r._removed_ for r in rows)
    plain = D.dedup_lines(documents(spark)).collect()
    assert sorted(repr((r.doc_id, r.text, r._removed_)) for r in rows) == sorted(repr((r.doc_id, r.text, r._removed)) for r in plain)


def test_a_very_common_line_and_a_row_in_many_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "MANY", 4)  # frequent keys in so small a table
    rng = random.Random(3)
    common_line = words(rng, 6, 900)
    rows = [(i, "\n".join([words(rng, 5, 10**6), common_line, words(rng, 5, 10**6)])) for i in range(120)]
    rows += [(7, rows[7][1])] * 60 + [(500 + i, common_line) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted({(r.doc_id, r.text, r._removed) for r in D.dedup_lines(docs).collect()})
    want = [(0, rows[0][1], 0)] + [(i, "\n".join(rows[i][1].split("\n")[::2]), 1) for i in range(1, 120)]
    assert got == want and D.dedup_lines(docs).count() == 180
