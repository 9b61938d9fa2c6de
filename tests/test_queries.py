"""Every registered query of the package's own operators against its SQL, at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from sluicework.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "item") and not isinstance(x, bool) else str(x)

    cols = sorted(df.columns)
    return sorted(repr([one(x) for x in r]) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = tables.execute(ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_text_filter_takes_tokenless_items_and_whole_texts(spark, tmp_path):
    items = [(1, "alpha beta gamma delta"), (2, "... !!! ... alpha"), (3, None), (4, "alpha"), (5, "?")]
    docs = [(1, "Delta gamma, beta alpha!"), (2, "alpha beta epsilon"), (3, ""), (4, None), (5, "gamma alpha")]
    for name, key, have in (("benchmark", "item_id", items), ("documents", "doc_id", docs)):
        spark.createDataFrame(have, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["text_filter"]).fetchdf()
    assert rows(QUERIES["text_filter"](spark, str(tmp_path)).toPandas()) == rows(want)
    got = {(r.query_id, r.id) for r in QUERIES["text_filter"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (2, 5), (4, 1), (4, 2), (4, 5), *((5, d) for d in range(1, 6))}
