"""Small cases of the package's own operators."""

import json

import pytest
from pyspark.sql import functions as F

from sluicework.functions import text as T
from sluicework.functions.vectors import of_dimension
from sluicework.operators import chunking, context, elements, search, structure, trees
from sluicework.sources import delimited
from sluicework.sources import registry as R
from sluicework.streaming import feeds


def test_normalize_and_flags(spark):
    cases = {
        None: ("", False, False),
        "  what  is this ?? ": ("what is this?", True, False),
        "the the cat ,dog": ("the cat, dog", False, False),
        "According to the report": ("According to the report", False, True),
        "the memo says no": ("the memo says no", False, True),
        "​threat": ("threat", False, False),
    }
    df = spark.createDataFrame([(q,) for q in cases], "query string")
    for r in T.analyze_queries(df).collect():
        assert (r.normalized, r.refers_conversation, r.refers_document) == cases[r.query], r.query


def test_lines(spark):
    text = "a\r\nb\rc\n\nd\x0be f g"
    got = T.lines_with_offsets(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k int, text string"), "k").orderBy("k", "line_number").collect()
    assert [(r.line, text[r.char_start : r.char_end]) for r in got] == [(x, x) for x in text.splitlines()]


def test_admission_dedup_and_keys(spark):
    files = spark.createDataFrame([("a", "pdf", bytearray(b"%PDF-1"), 6), ("b", "pdf", bytearray(b"nope"), 4), ("c", "exe", bytearray(b""), 0), ("d", "txt", bytearray(b"x"), 60 << 20)], "path string, extension string, content binary, file_size long")
    assert {r.path: r.reject_reason for r in R.admit(files).collect()} == {"a": None, "b": "signature", "c": "extension", "d": "size"}
    docs = spark.createDataFrame([("u", "x", 2), ("u", "x", 1), ("v", "x", 3)], "owner string, body string, n int")
    assert sorted(r.n for r in R.first_of_content(docs, "owner", "body", ["n"]).collect()) == [1, 3]
    known = R.first_of_content(docs, "owner", "body", ["n"]).where("owner = 'u'")
    assert [r.n for r in R.first_of_content(docs, "owner", "body", ["n"], known).collect()] == [3]
    good = "doc_" + "0" * 32
    keys = spark.createDataFrame([(f"u/{good}_a/b.pdf",), (f"u/x/{good}",), ("u/doc_1_a",), (f"u/{good}",)], "key string")
    user, doc = R.parse_key(F.col("key"))
    assert [tuple(r) for r in keys.select(user, doc).collect()] == [("u", good), (None, None), (None, None), ("u", good)]


def test_counts_and_promotion(spark):
    chunks = spark.createDataFrame([("d", "c1"), ("d", "c2"), ("e", "c3")], "doc_id string, chunk_id string")
    one = chunks.where("chunk_id <> 'c2'")
    assert {r.doc_id: r.status for r in R.count_agreement(chunks, one, chunks).collect()} == {"d": "FAILED", "e": "EMBEDDED"}
    df = spark.createDataFrame([({"page": "1"},), ({},)], "metadata map<string,string>")
    assert [r.page for r in R.promote(df, ["page"]).collect()] == ["1", None]


def test_windows_cover_the_text_and_overlap():
    text = " ".join(f"word{i}." if i % 7 == 0 else f"word{i}" for i in range(900))
    spans = chunking.windows(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, z), (b, _) in zip(spans, spans[1:]):
        assert a < b <= z and z - a <= 1000 and 200 <= z - b <= 300
    assert chunking.windows("") == [] and chunking.windows("x" * 1000) == [(0, 1000)]


def test_html_and_json(spark):
    html = "<title>t</title><script>x</script><h1>A</h1><p>one<p>two <b>b</b><h3>C</h3><ul><li><p>in</p></li></ul><table><tr><th>h</th><td>1</td></tr></table>"
    got = elements.html_outline(html)
    assert [(g[0], g[1], g[2]) for g in got] == [("h1", "A", ["A"]), ("p", "one", ["A"]), ("p", "two b", ["A"]), ("h3", "C", ["A", "C"]), ("li", "in", ["A", "C"]), ("tr", "h 1", ["A", "C"])]
    assert elements.html_outline("plain") == [("body", "plain", [])]
    rows = [(1, json.dumps({"b": [1, {"c": "x"}], "a": None})), (2, '{"a": 1}\n{"b": NaN}\n{"c": true}'), (3, "")]
    out = elements.json_leaves(spark.createDataFrame(rows, "k int, j string"), "k", "j").collect()
    assert [(r.k, r.path, r.label, r.value) for r in out if not r.error] == [(1, "$.b[0]", None, "1"), (1, "$.b[1].c", "c", "x"), (1, "$.a", "a", "null"), (2, "L1.$.a", "a", "1"), (2, "L3.$.c", "c", "true")]
    assert [r.path for r in out if r.error] == ["L2"]


def test_html_paths_links_and_fragments(spark):
    html = '<html><body><div>x<p>see <a href=" /a ">a</a><a href="/b">b</a><a href="/a">c</a><a>d</a><script><a href="/no">n</a></script></div><p>' + "long " * 900 + '<div><h2>T<svg><p>no</p></svg></h2></div><ul><li>one</li><li><a href="u">two</a></ul><tr><td>stray</td></tr>'
    got = elements.html_elements(spark.createDataFrame([(1, html), (2, "<div> bare <i>text</i></div>"), (3, ""), (4, None), (5, "<p> </p><script>x</script>")], "page_id int, html string")).orderBy("page_id", "order").collect()
    body = "[document]:nth-of-type(1) > html:nth-of-type(1) > body:nth-of-type(1)"
    assert [(r.page_id, r.order, r.element_type, r.fragment, r.hrefs) for r in got] == [(1, 1, "paragraph", 0, ["/a", "/b"]), (1, 2, "paragraph", 0, []), (1, 3, "paragraph", 1, []), (1, 4, "paragraph", 2, []), (1, 5, "heading", 0, []), (1, 6, "list_item", 0, []), (1, 7, "list_item", 0, ["u"]), (2, 1, "paragraph", 0, [])]
    assert got[0].text == "see a b c d" and got[0].dom_path == f"{body} > div:nth-of-type(1) > p:nth-of-type(1)"
    assert " ".join(r.text for r in got[1:4]) == ("long " * 900).strip() and got[1].dom_path == f"{body} > p:nth-of-type(1)"
    assert (got[4].dom_path, got[4].text, got[4].section_path) == (f"{body} > div:nth-of-type(2) > h2:nth-of-type(1)", "T", ["T"])
    assert got[5].dom_path == f"{body} > ul:nth-of-type(1) > li:nth-of-type(1)" and got[7].text == "bare text"


def test_html_tables(spark):
    """The first header cell names the columns, also from a row below and from a table inside; rows inside rows are no rows."""
    one = "<table><tr><td>a</td><td>b</td></tr><tr><th>X</th><td></td></tr><tr><td>1</td><td>2<b>3</b></td><td>4</td></tr></table>"
    two = "<h1>H</h1><table><tbody><tr><td>p</td><td><table><tr><th>in</th></tr></table></td></tr><tr><td>q</td></tr></tbody></table><table><tr><td>n</td></tr><tr><td>" + "m" * 600 + "</td></tr></table>"
    pages = spark.createDataFrame([(1, one), (2, two)], "page_id int, html string")
    got = [(r.page_id, r.element_type, r.text) for r in elements.html_elements(pages).orderBy("page_id", "order").collect() if r.element_type != "heading"]
    want = [(1, "table_row", "X: a\ncolumn2: b"), (1, "table_header", "X"), (1, "table_row", "X: 1\ncolumn2: 2 3\nextra_1: 4"), (2, "table_row", "in: p\nextra_1: in"), (2, "table_row", "in: q"), (2, "table_header", "n"), (2, "table_row", "n: " + "m" * 500)]
    assert got == want
    told = structure.html_table_rows(elements.html_cells(pages.where("page_id = 1")), ["page_id", "table"], "row", "column").orderBy("row").collect()
    assert [(r.page_id, r.element_type, r.text) for r in told] == want[:3]


def test_citations_and_prompts(spark):
    answer = f'See it. {context.START}[{{"id": 1, "doc_id": "d", "page": 2,}}]{context.END}'
    text, cites = context.parse_citations(F.col("a"))
    got = spark.createDataFrame([(answer,), ("none",), (f"x{context.START}broken{context.END}",)], "a string").select(text.alias("t"), cites.alias("c")).collect()
    assert (got[0].t, got[0].c[0].doc_id, got[0].c[0].page) == ("See it.", "d", 2)
    assert got[1].t == "none" and not got[1].c and got[2].t == "x"
    e = spark.createDataFrame([(1, 2, "P2", "c"), (1, 1, None, "kid")], "query_id int, rank int, parent_text string, child_text string")
    q = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, query string")
    assert {r.query_id: r.prompt for r in context.prompts(e, q).collect()} == {1: "Context:\n[1] kid\n\n[2] P2\n\nQuestion: why?", 2: "Question: how?"}


def test_dense_search_bears_odd_vectors(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [3.0, 0.0]), (8, [])], "query_id long, vector array<double>")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in search.dense_topk(q, index, 2).collect()}
    assert got == {(9, 1): (1, 1.0), (9, 2): (5, 1.0), (8, 1): (1, 0.0), (8, 2): (2, 0.0)}


def test_streams_equal_tables(spark, tmp_path):
    key = "u/doc_" + "a" * 32 + "_f.txt"
    (tmp_path / "in").mkdir()
    for i, name in enumerate(["ObjectCreated:Put", "ObjectRemoved:Delete"]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"Records": [{"eventName": name, "s3": {"object": {"key": key}}}]}))
    stream = spark.readStream.schema(feeds.ARRIVAL).json(f"{tmp_path}/in")
    batch = spark.read.schema(feeds.ARRIVAL).json(f"{tmp_path}/in")
    run = feeds.arrivals(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("seen").collect() == feeds.arrivals(batch).collect() and spark.table("seen").count() == 1
    jobs = spark.createDataFrame([("2024-01-01 00:00:10", "processed", 2.0), ("2024-01-01 00:00:50", "failed", None), ("2024-01-01 00:02:00", "processed", 1.0)], "ts string, outcome string, duration_s double").withColumn("ts", F.to_timestamp("ts"))
    jobs.write.parquet(f"{tmp_path}/jobs")
    live = spark.readStream.schema(jobs.schema).parquet(f"{tmp_path}/jobs")
    run = feeds.minute_metrics(live).writeStream.format("memory").queryName("mm").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("mm").collect())) == sorted(map(tuple, feeds.minute_metrics(jobs).collect()))


def test_fold_small_edges(spark):
    C = chunking
    big = "x" * 60
    rows = [("a", 1, "s1"), ("a", 2, big), ("a", 3, "  "), ("a", 4, None), ("a", 5, "s2"), ("a", 6, big), ("a", 7, "s3"), ("b", 1, "s"), ("b", 2, ""), ("c", 1, None)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in C.fold_small(spark.createDataFrame(rows, "d string, n int, text string"), "d", "n").collect()}
    assert got == {("a", 2): (f"s1\n\n{big}", 2), ("a", 6): (f"s2\n\n{big}\n\ns3", 3), ("b", 1): ("s", 1), ("b", 2): ("", 1), ("c", 1): (None, 1)}


def test_section_paths_and_caps(spark):
    C = chunking
    rows = [(1, 1, "A"), (2, 3, "B"), (3, None, "t"), (4, 2, "C"), (5, None, "t"), (6, 1, "D"), (7, None, None)]
    e = spark.createDataFrame([("d", *r) for r in rows], "d string, n int, level int, text string")
    got = [r.section_path for r in C.section_paths(e, "d", "n", "level", "text").orderBy("n").collect()]
    assert got == [["A"], ["A", "B"], ["A", "B"], ["A", "C"], ["A", "C"], ["D"], ["D"]]
    t = spark.createDataFrame([("y" * 30,), ("y" * 20,), (None,)], "text string")
    assert [r[0] for r in t.select(C.cap_text(F.col("text"), 20)).collect()] == ["y" * 7 + C.TRUNCATED, "y" * 20, None]


def test_long_lines_are_cut_at_spaces_and_cover_the_line():
    line = "word " * 900 + "x" * 4500 + " end"
    got = structure.pieces(line)
    assert all(len(p) <= 2000 and line[o : o + len(p)] == p for o, p in got)
    for (a, p), (b, _) in zip(got, got[1:]):
        assert line[a + len(p) : b] in ("", " ")
    assert structure.pieces("") == [(0, "")] and structure.pieces("a" * 2000) == [(0, "a" * 2000)]


def test_markdown_outline():
    text = "intro\n# One #\n\n###  Deep\nbody\n~~~py\n# no heading\n```\n~~~\n## Two\n#\n#x\n```\nopen"
    assert [(e, t, path) for e, t, path, _ in structure.markdown_outline(text)] == [
        ("paragraph", "intro", []),
        ("heading", "One", ["One"]),
        ("heading", "Deep", ["One", "Deep"]),
        ("paragraph", "body", ["One", "Deep"]),
        ("code_block", "~~~py\n# no heading\n```\n~~~", ["One", "Deep"]),
        ("heading", "Two", ["One", "Two"]),
        ("paragraph", "#x", ["One", "Two"]),
        ("code_block", "```\nopen", ["One", "Two"]),
    ]


def test_packed_children_hold_all_texts_within_the_cap(spark):
    rows = [(1, i, "x" * n, i == 4) for i, n in enumerate([900, 900, 300, 0, 20, 50, 2500, 10])] + [(2, 0, None, None), (3, 0, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, n int, text string, alone boolean")
    got = {(r.doc_id, r.child): (r.first, r.last, r.n_elements) for r in structure.pack_children(df, "doc_id", "n", atomic="alone").collect()}
    assert got == {(1, 0): (0, 1, 2), (1, 1): (2, 2, 1), (1, 2): (4, 4, 1), (1, 3): (5, 5, 1), (1, 4): (6, 6, 1), (1, 5): (7, 7, 1), (3, 0): (0, 0, 1)}


def test_style_clusters_keep_the_first_line_as_reference(spark):
    rows = [(1, i, s, b) for i, (s, b) in enumerate([(10.0, False), (11.1, False), (11.3, False), (11.3, True), (5.0, True), (5.4, True)])]
    got = structure.style_clusters(spark.createDataFrame(rows, "b long, n int, size double, bold boolean"), ["b"], "n")
    assert [r.cluster for r in got.orderBy("n").collect()] == [1, 1, 2, 3, 4, 4]


def test_boxes_that_are_no_numbers_are_null(spark):
    df = spark.createDataFrame([("1", "2", "0", "5", "3"), ("a", "1", "1", "1", "1"), ("1", "1", "1", "1", None)], "a string, b string, c string, d string, p string")
    got = [r.x for r in df.select(structure.safe_box(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("p")).alias("x")).collect()]
    assert tuple(got[0]) == (3, 0.0, 2.0, 1.0, 5.0) and got[1:] == [None, None]


def test_admission_by_detected_type_and_vectors_of_a_dimension(spark):
    rows = [("a", "pdf", b"%PDF-1", "application/pdf"), ("b", "pdf", b"%PDF-1", "text/plain"), ("c", "md", b"x", "text/markdown"), ("d", "txt", b"x", None), ("e", "docx", b"PK\x03\x04", "application/zip"), ("f", "pdf", b"no", "text/plain")]
    files = spark.createDataFrame([(p, e, bytearray(c), len(c), m) for p, e, c, m in rows], "path string, extension string, content binary, file_size long, detected_mime string")
    assert {r.path: r.reject_reason for r in R.admit(files).collect()} == {"a": None, "b": "mime", "c": None, "d": "mime", "e": None, "f": "signature"}
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    assert v.where("size(v) = 2").select(of_dimension(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    for odd in ("size(v) = 1", "v is null"):
        with pytest.raises(Exception, match="a vector of 2 was expected"):
            v.where(odd).select(of_dimension(F.col("v"), 2)).collect()


def test_a_long_conversation_is_searched_back_from_each_turn(spark):
    rows = [("c", i, "x" if i % 5 else " ", [float(i % 7), 1.0] if i % 11 else []) for i in range(120)] + [("d", 1, "y", [1.0, 0.0])]
    msgs = spark.createDataFrame(rows, "conv_id string, turn int, text string, vector array<double>")
    queries = msgs.where("turn % 3 = 1").withColumn("query_id", F.concat("conv_id", F.col("turn").cast("string")))
    got = {(r.query_id, r.turn) for r in search.search_history(queries, msgs, 3, 10).collect()}
    want, stats = set(), {}
    for c, at, text, v in rows:
        if at % 3 == 1 and text.strip():
            before = [r for r in rows if r[0] == c and r[1] < at and r[2].strip()][-10:]
            score = lambda w: 0.0 if not v or not w else sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(a * a for a in w) ** 0.5)  # noqa: B023, E731
            want |= {(f"{c}{at}", r[1]) for r in sorted(before, key=lambda r: (-round(score(r[3]), 9), r[1]))[:3]}
            stats[f"{c}{at}"] = (sum(bool(r[3]) for r in before), len(before))
    assert got == want
    told = {r.query_id: (r.num_searched, r.num_turns) for r in search.history_statistics(queries.where("trim(text) <> ''"), msgs, 3, 10).collect()}
    assert told == stats


def test_json_elements_and_both_ways_to_leaves(spark):
    deep = json.dumps({"n": [[1, {"x": "é"}], []], "t": "w " * 1500, "e": {}, "z": None, "b": True, "f": 2.5})
    nested = "[" * 3000 + "1" + "]" * 3000
    rows = [(1, deep), (2, nested), (3, "no json"), (4, '"bare"'), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "k int, j string")
    leaves = elements.json_leaves(df, "k", "j").cache()
    got = {(r.k, r.path): (r.label, r.value, r.depth) for r in leaves.where("k in (1, 4) and path <> '$.t'").collect()}
    want = {(1, "$.n[0][0]"): (None, "1", 4), (1, "$.n[0][1].x"): ("x", "é", 5), (1, "$.z"): ("z", "null", 2), (1, "$.b"): ("b", "true", 2), (1, "$.f"): ("f", "2.5", 2), (4, "$"): (None, "bare", 1)}
    assert got == want
    native = elements.json_leaves_unordered(df.where("k <> 2"), "k", "j").where("path <> '$.t'").collect()
    assert {(r.k, r.path): (r.label, r.value, r.depth) for r in native} == want
    told = elements.json_elements(leaves, "k").orderBy("order", "fragment").collect()
    assert [r.text for r in told if r.k == 1 and r.path == "$.t"] == ["t: " + ("w " * 1000).strip(), "t: " + "w " * 500]
    assert [r.text for r in told if r.k == 1 and r.path != "$.t"] == ["1", "x: é", "z: null", "b: true", "f: 2.5"]
    stats = {r.k: (r.max_depth, r.n_errors, r.value_count) for r in elements.json_statistics(leaves, elements.json_elements(leaves, "k"), "k").collect()}
    assert stats == {1: (5, 0, 7), 2: (3001, 0, 1), 3: (0, 1, 0), 4: (1, 0, 1)}


def test_long_cells_are_cut_and_give_back_what_they_hold(spark):
    long, solid = " ".join(f"w{i}" for i in range(1500)), "x" * 4100
    rows = [("s", 2, ["Name", "Name", "", "Note"]), ("s", 1, ["", " "]), ("s", 3, ["a", "b", "c", "d", "e"]), ("s", 4, [long, "b", solid, "tail"]), ("s", 5, [None, ""]), (None, 1, ["H"]), (None, 2, ["v"])]
    cells = spark.createDataFrame(rows, "sheet string, n int, cells array<string>")
    out = delimited.sheet_elements(cells, ["sheet"], "n").orderBy("sheet", "n", "fragment").collect()
    assert [(r.sheet, r.n, r.element_type, r.text) for r in out if r.n != 4] == [(None, 1, "table_header", "H"), (None, 2, "spreadsheet_row", "H: v"), ("s", 2, "table_header", "Name | Name_2 | column | Note"), ("s", 3, "spreadsheet_row", "Name: a | Name_2: b | column: c | Note: d | extra_1: e")]
    lines = [r.text for r in out if r.n == 4]
    assert len(lines) > 3 and all(len(x) <= 2000 for x in lines)
    parts = [p.split(": ", 1) for x in lines for p in x.split(" | ")]
    held = {}
    for label, value in parts:
        held.setdefault(label, []).append(value)
    assert "".join(held["column"]) == solid and "".join(held["Name"]).replace(" ", "") == long.replace(" ", "") and held["Note"] == ["tail"]
    stats = {r.sheet: r.row_count for r in delimited.sheet_statistics(delimited.sheet_elements(cells, ["sheet"], "n"), ["sheet"]).collect()}
    assert stats == {"s": 2, None: 1}
    v = spark.createDataFrame([(True, 3.0, 2.5, " t ", None)], "b boolean, f double, g double, s string, z string")
    assert v.select(*[delimited.cell_text(F.col(f.name), f.dataType.simpleString()) for f in v.schema]).first()[:] == ("true", "3", "2.5", "t", "")


def test_slides_have_title_paths_and_fragments(spark):
    rows = [("d", "t", None, 1, "title", "Deck", 1), ("d", "u", "t", 1, "title", " Part ", None), ("d", "p", "u", 1, "paragraph", "word " * 900, 3), ("d", "q", None, 2, "paragraph", "loose", None), ("d", "g", "t", 2, "list", None, None), ("d", "i", "g", 1, "list_item", "in", None), ("d", "o", "gone", 1, "paragraph", "orphan", None)]
    nodes = spark.createDataFrame(rows, "doc_id string, node string, parent string, pos int, type string, content string, page int")
    got = trees.slide_elements(trees.flatten(nodes)).orderBy("order").collect()
    assert [(r.order, r.node, r.element_type, r.slide, r.section_path, r.fragment_index, r.fragment_count) for r in got] == [
        (1, "t", "title", 1, ["Deck"], 0, 1),
        (2, "u", "title", 1, ["Deck", "Part"], 0, 1),
        (3, "p", "paragraph", 3, ["Deck", "Part"], 0, 3),
        (4, "p", "fragment", 3, ["Deck", "Part"], 1, 3),
        (5, "p", "fragment", 3, ["Deck", "Part"], 2, 3),
        (6, "i", "list_item", 1, ["Deck"], 0, 1),
        (7, "q", "paragraph", None, [], 0, 1),
    ]
    whole = ("word " * 900).strip()
    assert all(whole[r.char_start : r.char_end] == r.text for r in got if r.node == "p")


def test_places_of_pages_slides_and_characters(spark):
    cols = ["x", "y", "z", "w", "page", "slide", "a", "b"]
    rows = [("4", "3", "2", "1", "7", None, "5", "9"), ("4", "3", "2", "1", None, "2", None, None), ("4", "3", "bad", "1", "7", "2", "5", "9"), (None,) * 6 + ("9", "5"), ("1", "2", "3", "4", "x", "y", "1", "no"), ("1", "2", "3", "NaN", "1", "1", "0", "0")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    box = [F.col(c) for c in "xyzw"]
    where = structure.location(structure.safe_box(*box, F.col("page")), structure.slide_box(*box, F.lit(None).cast("string"), F.col("slide")), F.col("a"), F.col("b"))
    got = [r[0] and (r[0].type, r[0].page, r[0].slide, r[0].x1, r[0].y2, r[0].coord_origin, r[0].char_start, r[0].char_end) for r in df.select(where).collect()]
    assert got == [("page_box", 7, None, 2.0, 3.0, None, 5, 9), ("slide_box", None, 2, 4.0, 1.0, "TOPLEFT", None, None), ("text_offset", None, None, None, None, None, 5, 9), None, None, ("text_offset", None, None, None, None, None, 0, 0)]


def test_delimited_files_of_several_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\nx,1\n")
    (tmp_path / "b.csv").write_text("name,n\ny,2\n")
    (tmp_path / "c.csv").write_bytes("\ufeffn;note\n3;\"one; two\"\n".encode())
    got = sorted((r.name or "", r.n, r.note or "") for r in delimited.read_delimited(spark, str(tmp_path)).collect())
    assert got == [("", "3", "one; two"), ("x", "1", ""), ("y", "2", "")]
    files = R.scan_files(spark, str(tmp_path), "*.csv").select(F.regexp_extract("path", r"[^/]*$", 0).alias("f"), "extension", "file_size").collect()
    assert sorted(map(tuple, files)) == [("a.csv", "csv", 11), ("b.csv", "csv", 11), ("c.csv", "csv", 23)]


def test_payloads_take_what_is_filtered_by(spark):
    schema = "user_id string, doc_id string, version_id string, chunk_id string, parent_chunk_id string, chunk_type string, chunk_index int, text string, section_path array<string>, locations array<struct<page:int>>, metadata map<string,string>"
    rows = [("u", "d", "v", "c", "p", "child", 3, "t", ["A", None], [(1,), None], {"pages": "1", "secret": "x", "filename": "f", "sheet": None}), ("u", "d", "v", "e", None, "parent", 0, "t", None, None, None)]
    one, two = R.build_payload(spark.createDataFrame(rows, schema)).orderBy("chunk_index", ascending=False).collect()
    assert (one.filename, one.parser, one.section_path, [x.page for x in one.locations], one.filters) == ("f", None, ["A"], [1], {"pages": "1", "sheet": None})
    assert (two.filename, two.section_path, two.locations, two.filters) == (None, [], [], {})
