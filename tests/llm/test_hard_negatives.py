import math
import random

import duckdb
import numpy as np

from sluicework.llm import hard_negatives as H

E = "vec_id long, embedding array<float>, label int, _a int, _r int, place long, x string"


def plain(rows):
    """As the contract says it, by Python's own integers."""
    own = []
    for r in rows:
        v = r.embedding
        if r.vec_id is None or r.label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label
        own.append((r.vec_id, label, [math.floor(256 * float(x)) for x in v]))
    anchors = {}
    for r in own:
        if r[0] % 50 == 0 and (r[0] not in anchors or r[1:] < anchors[r[0]][1:]):
            anchors[r[0]] = r
    out = []
    for a, label, v in anchors.values():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in own]
        for ps, p, _ in sorted(s for s in scored if s[2] == label and s[1] != a)[:5]:
            fit = sorted(s for s in scored if s[2] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(a, p, n, i, -ps, -ns) for n, (ns, i, _) in enumerate(fit, 1)]
    return sorted(out)


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, E)
    df.write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    got = H.op12_hard_negatives(spark, str(tmp_path)).collect()
    return df, sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def table(rng, n, dim=6):
    clash = (1, 2, 3, "y")
    rows = [(i, [rng.gauss(0, 0.4) + (0.5 if j == i % 4 else 0) for j in range(dim)], i % 4, *clash) for i in range(n)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.1, 0.2], i % 2, *clash) for i in range(60)]  # a common vector: ties
    rows += [(2001, None, 1, *clash), (2002, [0.5, None], 1, *clash), (2003, [0.5, float("nan")], 1, *clash), (2050, [float("inf")], 1, *clash), (2004, [0.9] * dim, None, *clash), (None, [0.9] * dim, 1, *clash)]
    rows += [(2100, [], 1, *clash), (2101, [0.9], 1, *clash), (2150, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2], 1, *clash)]
    return rows


def test_against_plain_integers_and_sql(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    for tile, pack in ((100_000, 4096), (60, 7)):
        monkeypatch.setattr(H, "TILE_ROWS", tile)
        monkeypatch.setattr(H, "PACK", pack)
        df, got = run(spark, table(rng, 400), tmp_path)
        assert got == plain(df.collect()) and len(got) > 50
    even = [r for r in table(rng, 300) if r[0] is not None and (r[1] is None or len(r[1]) in (2, 6))]
    df, got = run(spark, even, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute("SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (" + H.OP12_SQL + ")").fetchall()) == got


def test_repeated_rows_and_large_components(spark, tmp_path):
    clash = (1, 2, 3, "y")
    rows = [(i, [float(2 ** (i % 18)), 1.5], i % 3, *clash) for i in range(120)] + [(50, [3.0, 1.5], 2, *clash)] * 2
    df, got = run(spark, rows, tmp_path)
    assert got == plain(df.collect()) and got
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    for big in (1e6, 1e7, 1e30, 1e36):
        df, got = run(spark, [(i, [big * (1 + i % 50), -big / 10 * i], i % 3, *clash) for i in range(150)], tmp_path)
        assert got == sorted((*r[:4], clip(r[4]), clip(r[5])) for r in plain(df.collect())) and got


def test_empty_tables(spark, tmp_path):
    assert run(spark, [], tmp_path)[1] == []
    assert run(spark, [(1, [0.5], 1, 1, 2, 3, "y")], tmp_path)[1] == []
    assert run(spark, [(50, [0.5], 1, 1, 2, 3, "y")], tmp_path)[1] == []


def test_packs_multiply_exactly():
    rng = np.random.default_rng(1)
    for far in (1, 256, 2**20, 2**31, 2**45):
        c = rng.integers(-far, far + 1, (37, 9))
        a = rng.integers(-far, far + 1, 9).tolist()
        got = H.Pack(c, far).scores(a).tolist()
        assert got == [sum(x * y for x, y in zip(a, row)) for row in c.tolist()]
    assert H.Pack(np.zeros((3, 0), np.int64), 1).scores([]).tolist() == [0, 0, 0]
