"""Cases of the third review: registered queries against their SQL on tables written here, and steps at the sizes named."""

import random
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from sluicework.operators import arms, elements, parts, ranges, search, structure
from sluicework.plans.queries import ORACLE_SQL, QUERIES
from sluicework.sources import delimited

from .test_queries import rows


@pytest.fixture
def against_sql(spark, tmp_path):
    def run(query: str, **tables):
        con = duckdb.connect()
        for name, (have, schema) in tables.items():
            spark.createDataFrame(have, schema).write.parquet(f"{tmp_path}/{name}.parquet")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        got = QUERIES[query](spark, str(tmp_path)).toPandas()
        want = con.execute(ORACLE_SQL[query]).fetchdf()
        assert rows(got) == rows(want)
        return got

    return run


CUT = "<html><body><nav><ul><li><a href=\"/a\">A &amp; b</a></li></ul></nav><article><h1>Q&amp;A &amp</h1><p>&lt;x &lt y&quot</p></article></body></html>"


@pytest.mark.parametrize("query", ["html_elements", "page_statistics"])
def test_references_without_semicolon_stay(against_sql, query):
    got = against_sql(query, pages=([(1, "u", CUT)], "page_id long, url string, html string"))
    if query == "html_elements":
        assert list(got["text"]) == ["A & b", "Q&A &amp", "<x &lt y&quot"]


@pytest.mark.parametrize("query", ["query_normalize", "query_flags"])
def test_letters_beyond_ascii_end_words(against_sql, query):
    said = ["der in inästber", "adoes as asó asado", "in inner the the cat", "ñin in the éa", "in the äpfel file", "wir sagten we discussedé", "pdf noteé"]
    got = against_sql(query, conversations=([(1, i, "user", s) for i, s in enumerate(said)], "conv_id long, turn int, role string, text string"))
    if query == "query_normalize":
        assert dict(zip(got["turn"], got["normalized"]))[0] == "der inästber"


def test_documents_are_packed_without_a_call_for_each(spark):
    """3 000 documents of three rows in four tasks and one of 9 000: no step takes them group by group but for the few that go on
    from one task to the next."""
    rows_ = spark.range(9_000).selectExpr("id div 3 as d", "id as o", "40 as size").unionByName(spark.range(9_000).selectExpr("-1L as d", "id as o", "10 as size"))
    packed = ranges.pack(rows_, "d", "o", "size", 100)
    assert "FlatMapCoGroupsIn" not in packed._jdf.queryExecution().toString()
    got = packed.groupBy("d", "group").count().groupBy("d").agg({"count": "max", "group": "max"}).toPandas().set_index("d")
    assert len(got) == 3_001 and (got.drop(-1)["max(count)"] == 2).all() and (got.drop(-1)["max(group)"] == 1).all()
    assert tuple(got.loc[-1, ["max(count)", "max(group)"]]) == (8, 1_124)


def test_nearest_of_a_group_meets_no_pairs(spark):
    """Nearest by number, against brute force, with gaps, repeated numbers, nulls and groups smaller than k; joined by places."""
    rng = random.Random(5)
    have = [(rng.choice([0, 1, None]), rng.randrange(600)) for _ in range(500)] + [(2, 50), (2, None), (3, 7)]
    got = search.nearest_of_group(spark.createDataFrame(have, "g int, n long"), "g", "n", F.col("n") % 50 == 0, 6)
    want = []
    for q in {n for g, n in have if n is not None and n % 50 == 0 and g is not None}:
        seen = sorted((abs(q - m), m) for h, a in have if a == q and h is not None for g, m in have if g == h and m is not None)[:6]
        want += [(q, m, i) for i, (_, m) in enumerate(seen, 1)]
    assert sorted((r.query_id, r.id, r.rank) for r in got.collect()) == sorted(want)
    assert "_at" in got._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]


def test_broken_bytes_are_mended_without_python(spark):
    rng = random.Random(3)
    pool = [0, 0x41, 0x7F, 0x80, 0x9F, 0xA0, 0xBB, 0xBF, 0xC1, 0xC2, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0xFF]
    raw = [bytearray(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(3_000)] + [bytearray(b"\xef\xbb\xbf"), bytearray(b"\xef\xbb\xbf\xef\xbb\xbfa"), bytearray(b"\xef\xbb"), None]
    df = spark.createDataFrame([(b,) for b in raw], "b binary")
    got = df.select("b", delimited.decode_lenient("b").alias("t"))
    assert "ArrowEvalPython" not in got._jdf.queryExecution().toString()
    assert all(r.t == (None if r.b is None else bytes(r.b).decode("utf-8-sig", "replace")) for r in got.collect())


def test_parts_are_the_same_however_few_blocks_are_open(spark, monkeypatch):
    have = [(d, n, f"Line {n} of {d}. " * 60) for d in range(7) for n in range(d * 6)]
    df = spark.createDataFrame(have, "doc string, n int, text string").coalesce(1)
    told = lambda: sorted(map(repr, parts.standard_parts(df, ["doc"], "n").collect()))
    whole = told()
    monkeypatch.setattr(parts, "BLOCKS", 2)
    assert told() == whole and len(whole) > 6


def test_plain_tags_are_read_as_the_library_reads_them(spark):
    """With and without the short way for tags without attributes; cells of a page are parsed once for both of their uses."""
    pages = ["<TABLE><tr><th>a</TH><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "<p>x<script>if (a<b) '</p>'</script>y<textarea><p>no</textarea><title><b>t</b></title><p>z", "<a href='u'>l</a></nothing><li>q</ li><p >w</p  ><li>e<br/>f</li>", "<p>a<", "<p>a</", "<p>a</p", "<h1>A &amp; b</h1><svg><p>no</p></svg><noscript><p>n</p></noscript><p>k"]

    class Whole(elements.Dom):
        parse_starttag, parse_endtag, updatepos = HTMLParser.parse_starttag, HTMLParser.parse_endtag, HTMLParser.updatepos

    for html in pages:
        told = []
        for kind in (Whole, elements.Dom):
            page = kind()
            page.feed(html)
            page.close()
            told.append([(n.tag, n.text(), n.path, n.section, list(n.hrefs), [c.text() for c in n.cells]) for n in page.found] + [page.open[0].text()])
        assert told[0] == told[1], html
    cells = elements.html_cells(spark.createDataFrame([(1, pages[0])], "page_id int, html string"))
    rows_ = structure.html_table_rows(cells, ["page_id", "table"], "row", "column")
    assert "MapInPandas" not in rows_._jdf.queryExecution().toString()
    assert sorted(r.text for r in rows_.collect()) == ["a | b", "a: 1\nb: 2"]


def test_words_as_a_matrix_score_as_word_by_word(spark, monkeypatch):
    rng = random.Random(2)
    said = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) for _ in range(n))
    q = spark.createDataFrame([(i, said(4)) for i in range(9)], "query_id int, text string")
    docs = spark.createDataFrame([(i, said(rng.randrange(12))) for i in range(90)], "id int, text string")
    told = lambda: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in arms.bm25_topk(q, docs, 5).collect())
    whole = told()
    monkeypatch.setattr(arms, "DENSE", 0)
    assert told() == whole and len(whole) == 45
