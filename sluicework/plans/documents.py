"""Queries over sections, trees, sheets, fusion, citations and registries, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import context as X
from ..operators import search as S
from ..operators import sections as N
from ..operators import structure as U
from ..operators import trees as G
from ..sources import delimited as D
from ..sources import registry as R
from ..streaming import feeds as H
from .queries import _LINES, _WINDOWS, query, t


@query("SELECT doc_id, md5(text || chr(65533)) AS text_md5 FROM documents")
def lenient_decode(spark, sf_dir):
    """Every text with a byte order mark before and a broken byte behind."""
    raw = F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"), F.unhex(F.lit("FF")))
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(D.decode_lenient(raw)).alias("text_md5"))


@query(f"""{_LINES.replace("SELECT doc_id, CAST(n", ", l AS (SELECT doc_id, CAST(n", 1)}),
s AS (SELECT doc_id, line_number, 0 AS piece, char_start AS start0, line AS r FROM l WHERE trim(line, ' ') <> ''
 UNION ALL SELECT doc_id, line_number, piece + 1, start0 + cut + blank, substr(r, CAST(cut + blank + 1 AS BIGINT)) FROM
  (SELECT *, CASE WHEN p > 0 THEN p ELSE 2000 END AS cut, CAST(p > 0 AS INT) AS blank FROM
   (SELECT *, CASE WHEN contains(substr(r, 2, 2000), ' ') THEN 2001 - position(' ' IN reverse(substr(r, 2, 2000))) ELSE 0 END AS p FROM s WHERE length(r) > 2000)))
SELECT doc_id, line_number, piece, CAST(start0 AS BIGINT) AS char_start, md5(CASE WHEN length(r) <= 2000 THEN r ELSE substr(r, 1, CASE WHEN contains(substr(r, 2, 2000), ' ') THEN 2001 - position(' ' IN reverse(substr(r, 2, 2000))) ELSE 2000 END) END) AS text_md5 FROM s""")
def plain_elements(spark, sf_dir):
    lines = T.lines_with_offsets(t(spark, sf_dir, "documents"), "doc_id")
    return U.plain_elements(lines, "doc_id").select("doc_id", "line_number", "piece", "char_start", F.md5("text").alias("text_md5"))


@query(r"""WITH c AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 = 1 AND o_orderstatus <> 'F' AS th,
 [CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END] || CASE WHEN o_orderkey % 2 = 0 THEN [o_orderpriority] ELSE [] END AS cells FROM orders),
h AS (SELECT o_custkey, o_orderkey AS row0, cells AS names FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY th DESC, o_orderkey) = 1)
SELECT c.o_custkey, o_orderkey, CASE WHEN o_orderkey = row0 THEN 'table_header' ELSE 'table_row' END AS element_type,
 CASE WHEN o_orderkey = row0 THEN array_to_string(list_filter(cells, lambda x: x <> ''), ' | ') ELSE array_to_string(list_transform(cells, lambda x, i:
  CASE WHEN i <= len(names) THEN coalesce(nullif(names[i], ''), 'column' || i) ELSE 'extra_' || (i - len(names)) END || ': ' || x), chr(10)) END AS text
FROM c JOIN h USING (o_custkey)""")
def table_cells_to_rows(spark, sf_dir):
    """Orders as rows of their customer's table, of two or three cells; some are headers."""
    o = t(spark, sf_dir, "orders")
    cells = F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderstatus")))
    cells = F.concat(cells, F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")))
    one = o.select("o_custkey", "o_orderkey", ((F.col("o_orderkey") % 3 == 1) & (F.col("o_orderstatus") != "F")).alias("is_header"), F.posexplode(cells).alias("column", "text"))
    return U.html_table_rows(one, ["o_custkey"], "o_orderkey", "column")


@query("""SELECT doc_id, CASE WHEN c >= greatest(s, b, p) THEN ',' WHEN s >= greatest(b, p) THEN ';' WHEN b >= p THEN chr(9) ELSE '|' END AS delimiter FROM
(SELECT doc_id, length(h) - length(replace(h, ',', '')) AS c, length(h) - length(replace(h, ';', '')) AS s, length(h) - length(replace(h, chr(9), '')) AS b, length(h) - length(replace(h, '|', '')) AS p
 FROM (SELECT doc_id, substr(text, 1, 8192) AS h FROM documents))""")
def sniffed_delimiters(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", D.sniff_delimiter(F.col("text")).alias("delimiter"))


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, c_custkey, CASE WHEN c_custkey % 13 = 0 THEN ['', ' '] WHEN c_custkey % 5 = 0 THEN [c_name, '', CAST(c_custkey AS VARCHAR)] ELSE [c_name, CAST(c_custkey AS VARCHAR)] END AS cells FROM customer),
s AS (SELECT * FROM c WHERE list_bool_or(list_transform(cells, lambda x: trim(x) <> ''))),
h AS (SELECT c_nationkey, c_mktsegment, c_custkey AS row0, cells AS names FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) = 1)
SELECT c_nationkey, c_mktsegment, c_custkey, array_to_string(list_filter(list_transform(cells, lambda x, i: CASE WHEN trim(x) <> '' THEN
 CASE WHEN i <= len(names) THEN coalesce(nullif(trim(names[i]), ''), 'column' || i) ELSE 'extra_' || (i - len(names)) END || ': ' || trim(x) END), lambda x: x IS NOT NULL), ' | ') AS text
FROM s JOIN h USING (c_nationkey, c_mktsegment) WHERE c_custkey > row0""")
def sheet_rows(spark, sf_dir):
    """Customers as rows of a nation's sheets, one for each segment."""
    key = F.col("c_custkey").cast("string")
    cells = F.when(F.col("c_custkey") % 13 == 0, F.array(F.lit(""), F.lit(" "))).when(F.col("c_custkey") % 5 == 0, F.array(F.col("c_name"), F.lit(""), key)).otherwise(F.array(F.col("c_name"), key))
    return D.sheet_rows(t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", "c_custkey", cells.alias("cells")), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("""WITH c AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k, array_to_string(string_split(text, chr(10))[1:1], '') AS line, n_chars FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
v AS (SELECT *, trim(left(line, 1500), ' ') AS said FROM c), h AS (SELECT source, lang, said, doc_id AS first FROM v WHERE k = 1)
SELECT v.source, v.lang, doc_id, CAST(0 AS INTEGER) AS fragment, CASE WHEN k = 1 THEN 'table_header' ELSE 'spreadsheet_row' END AS element_type, CASE WHEN k = 1 THEN concat_ws(' | ', v.doc_id, n_chars) ELSE concat_ws(' | ', first || ': ' || v.doc_id, (SELECT n_chars FROM c x WHERE x.source = v.source AND x.lang = v.lang AND x.k = 1) || ': ' || n_chars, CASE WHEN v.said <> '' THEN 'extra_1: ' || v.said END) END AS text
FROM v JOIN h ON h.source = v.source AND h.lang = v.lang""")
def sheet_elements(spark, sf_dir):
    """Documents as rows of a sheet for each source and language: number, length and, beyond the header, the beginning of the text."""
    d = t(spark, sf_dir, "documents").where("source is not null and lang is not null")
    first = F.min("doc_id").over(Window.partitionBy("source", "lang"))
    said = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 1500)
    numbers = F.array(D.cell_text(F.col("doc_id").cast("double"), "double"), F.col("n_chars").cast("string"))
    cells = F.when(F.col("doc_id") == F.col("_first"), numbers).otherwise(F.concat(numbers, F.array(said)))
    return D.sheet_elements(d.withColumn("_first", first).select("source", "lang", "doc_id", cells.alias("cells")), ["source", "lang"], "doc_id")


_NODES = """n AS (
 SELECT c_nationkey AS doc_id, 'c' || c_custkey AS node, CAST(NULL AS VARCHAR) AS parent, c_custkey * 10 AS pos, CASE WHEN c_custkey % 4 = 0 THEN 'list' ELSE 'paragraph' END AS type,
  CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS content, CAST(nullif(c_custkey % 3, 0) AS INT) AS page, CAST(nullif(c_custkey % 2, 0) AS INT) AS grp FROM customer
 UNION ALL SELECT s_nationkey, 's' || s_suppkey, NULL, s_suppkey * 150 + 5, CASE WHEN s_suppkey % 6 = 0 THEN 'heading' ELSE 'paragraph' END, s_name, NULL, NULL FROM supplier
 UNION ALL SELECT c_nationkey, 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, 'list_item', CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 2 = 0
 UNION ALL SELECT c_nationkey, 'k' || o_orderkey, 'o' || o_orderkey, 1, 'caption', NULL, NULL, NULL FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 2 = 0 AND o_orderkey % 5 = 0)"""
_TREE = f"""{_NODES}, e AS (SELECT *, type NOT IN ('list', 'text_block') AND (type = 'caption' OR trim(coalesce(content, '')) <> '') AS el FROM n),
kid AS (SELECT doc_id, parent AS node, count(*) AS n_kids FROM n WHERE parent IS NOT NULL GROUP BY ALL),
r AS (SELECT doc_id, node, [pos] AS path, node AS root, CAST(NULL AS VARCHAR) AS above, coalesce(page, grp + 1) AS slide, type, content, el FROM e WHERE parent IS NULL
 UNION ALL SELECT e.doc_id, e.node, r.path || [e.pos], r.root, CASE WHEN r.el THEN r.node ELSE r.above END, coalesce(e.page, e.grp + 1, r.slide), e.type, e.content, e.el FROM e JOIN r ON e.doc_id = r.doc_id AND e.parent = r.node),
f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS "order", r.node, above AS parent, root, CAST(len(path) - 1 AS INT) AS depth, type, content, slide, coalesce(n_kids, 0) AS n_kids FROM r LEFT JOIN kid USING (doc_id, node) WHERE el)"""


def _tree(spark, sf_dir):
    """Nations as documents: suppliers and customers as roots, orders of every second customer as their kids."""
    c, s, o = (t(spark, sf_dir, x) for x in ("customer", "supplier", "orders"))
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    none = F.lit(None)
    roots = c.select(
        F.col("c_nationkey").alias("doc_id"), name("c", "c_custkey").alias("node"), none.cast("string").alias("parent"), (F.col("c_custkey") * 10).alias("pos"), F.when(F.col("c_custkey") % 4 == 0, "list").otherwise("paragraph").alias("type"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("content"), F.nullif(F.col("c_custkey") % 3, F.lit(0)).cast("int").alias("page"), F.nullif(F.col("c_custkey") % 2, F.lit(0)).cast("int").alias("group"),
    )
    others = s.select("s_nationkey", name("s", "s_suppkey"), none.cast("string"), F.col("s_suppkey") * 150 + 5, F.when(F.col("s_suppkey") % 6 == 0, "heading").otherwise("paragraph"), "s_name", none.cast("int"), none.cast("int"))
    placed = o.join(c, F.col("o_custkey") == F.col("c_custkey")).where("o_custkey % 2 = 0")
    kids = placed.select("c_nationkey", name("o", "o_orderkey"), name("c", "o_custkey"), "o_orderkey", F.lit("list_item"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")), none.cast("int"), none.cast("int"))
    notes = placed.where("o_orderkey % 5 = 0").select("c_nationkey", name("k", "o_orderkey"), name("o", "o_orderkey"), F.lit(1).cast("long"), F.lit("caption"), none.cast("string"), none.cast("int"), none.cast("int"))
    return G.flatten(roots.unionAll(others).unionAll(kids).unionAll(notes))


@query(f"WITH RECURSIVE {_TREE} SELECT * FROM f")
def layout_tree(spark, sf_dir):
    return _tree(spark, sf_dir).drop("section_path")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, trim(replace(text, chr(10), ' '), ' ') AS text FROM documents),
c AS (SELECT doc_id, 0 AS i, 0 AS a, text AS rest, regexp_extract(left(text, 2001), '(?s)^(.+) ', 1) AS fits FROM d WHERE text <> ''
 UNION ALL SELECT doc_id, i + 1, a, r, regexp_extract(left(r, 2001), '(?s)^(.+) ', 1) FROM
 (SELECT doc_id, i, a + CASE WHEN fits <> '' THEN length(fits) + 1 ELSE 2000 END AS a, CASE WHEN fits <> '' THEN substr(rest, length(fits) + 2) ELSE substr(rest, 2001) END AS r FROM c WHERE length(rest) > 2000)),
p AS (SELECT *, CASE WHEN length(rest) <= 2000 THEN rest WHEN fits <> '' THEN fits ELSE left(rest, 2000) END AS own FROM c)
SELECT doc_id, CAST(1 AS BIGINT) AS "order", 'title' AS element_type, md5('Deck ' || doc_id) AS text_md5, CAST(doc_id % 5 + 1 AS INTEGER) AS slide, 'Deck ' || doc_id AS section_path, CAST(0 AS INTEGER) AS fragment_index, CAST(1 AS INTEGER) AS fragment_count, CAST(0 AS BIGINT) AS char_start, CAST(length('Deck ' || doc_id) AS BIGINT) AS char_end FROM documents
UNION ALL SELECT doc_id, i + 2, CASE WHEN i = 0 THEN 'paragraph' ELSE 'fragment' END, md5(own), CAST(doc_id % 5 + 1 AS INTEGER), 'Deck ' || doc_id, CAST(i AS INTEGER), CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER), CAST(a AS BIGINT), CAST(a + length(own) AS BIGINT) FROM p""")
def slide_elements(spark, sf_dir):
    """Documents as decks: a title on a slide named by its group, and below it the whole text."""
    d = t(spark, sf_dir, "documents")
    node = lambda kind, parent, pos, content: d.select("doc_id", F.lit(kind).alias("node"), F.lit(parent).cast("string").alias("parent"), F.lit(pos).alias("pos"), F.lit(kind).alias("type"), content.alias("content"), F.when(F.lit(parent is None), F.col("doc_id") % 5).cast("int").alias("group"))
    nodes = node("title", None, 1, F.concat(F.lit("Deck "), F.col("doc_id").cast("string"))).unionAll(node("paragraph", "title", 2, F.translate("text", "\n", " ")))
    e = G.slide_elements(G.flatten(nodes))
    return e.select("doc_id", "order", "element_type", F.md5("text").alias("text_md5"), "slide", F.array_join("section_path", " > ").alias("section_path"), "fragment_index", "fragment_count", "char_start", "char_end")


@query(rf"""WITH RECURSIVE {_TREE}, top AS (SELECT doc_id, root, min("order") AS o, coalesce(bool_or(node = root AND (type IN ('table', 'heading', 'list_item') OR n_kids > 0 OR regexp_matches(coalesce(content, ''), '^\d{{1,2}}[.)]\s'))) OR NOT bool_or(node = root), true) AS major FROM f GROUP BY ALL),
b AS (SELECT *, sum(CASE WHEN major OR coalesce(was, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o) AS block FROM (SELECT *, lag(major) OVER (PARTITION BY doc_id ORDER BY o) AS was FROM top))
SELECT doc_id, CAST(block AS BIGINT) AS block, count(*) AS n_elements, min("order") AS first, max("order") AS last FROM f JOIN b USING (doc_id, root) GROUP BY ALL""")
def tree_parents(spark, sf_dir):
    return G.tree_blocks(_tree(spark, sf_dir)).groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n_elements"), F.min("order").alias("first"), F.max("order").alias("last"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus || ' | ' || o_orderpriority || ' | ' AS text FROM orders)
SELECT o_custkey, CAST(NULL AS BIGINT) AS o_orderkey, 'table' AS element_type, md5(string_agg(text, chr(10) ORDER BY o_orderkey)) AS text_md5, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns FROM r GROUP BY o_custkey
UNION ALL SELECT o_custkey, o_orderkey, 'table_row', md5(text), 1, 3 FROM r""")
def tree_tables(spark, sf_dir):
    """Orders as rows of their customer's table, of three cells, the last one blank."""
    cells = F.array(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(None).cast("string"))
    rows = G.table_rows(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.posexplode(cells).alias("column", "text")), ["o_custkey"], "o_orderkey", "column", "text")
    return rows.select("o_custkey", "o_orderkey", "element_type", F.md5("text").alias("text_md5"), "n_rows", "n_columns")


_EXT = ["csv", "JSON", "md", "exe", "pdf", "html"]


@query(f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'csv' WHEN e IN ('csv', 'json', 'md', 'pdf', 'html') THEN e ELSE 'section' END AS strategy FROM
(SELECT page_id, lower({_EXT}[page_id % 6 + 1]) AS e FROM pages)""")
def chunk_strategies(spark, sf_dir):
    """Pages with made names; every fourth has a MIME type, with parameters."""
    ext = F.get(F.array(*[F.lit(e) for e in _EXT]), (F.col("page_id") % 6).cast("int"))
    mime = F.when(F.col("page_id") % 4 == 0, "Text/CSV; charset=utf-8")
    return t(spark, sf_dir, "pages").select("page_id", N.strategy(mime, F.concat_ws(".", "url", ext)).alias("strategy"))


_KINDS = ["csv", "xlsx", "pptx", "json", "md", "section", "pdf"]


@query(rf"""WITH p AS (SELECT p_partkey, p_size, {_KINDS}[p_partkey % 7 + 1] AS k, CASE WHEN p_size % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(p_name, ' ') END AS s, p_brand, nullif(p_size % 5, 0) AS slide, '$.' || p_size || '.x[0]' AS j FROM part)
SELECT p_partkey, CASE k WHEN 'csv' THEN '' WHEN 'xlsx' THEN p_brand WHEN 'json' THEN regexp_extract(j, '^\$\.([^.]+)', 1)
 WHEN 'pptx' THEN CASE WHEN slide IS NOT NULL THEN 'slide ' || slide WHEN len(s) > 0 THEN array_to_string(s, chr(31)) END ELSE coalesce(array_to_string(s, chr(31)), '') END AS key,
 CASE k WHEN 'json' THEN true WHEN 'section' THEN len(s) > 0 WHEN 'pdf' THEN p_size % 2 = 0 ELSE false END AS seam FROM p""")
def block_keys(spark, sf_dir):
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % 7).cast("int"))
    section = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    path = F.concat(F.lit("$."), F.col("p_size").cast("string"), F.lit(".x[0]"))
    key = N.block_key(kind, section, F.col("p_brand"), F.nullif(F.col("p_size") % 5, F.lit(0)), path)
    table = F.when(F.col("p_size") % 2 == 0, "table").otherwise("paragraph")
    return t(spark, sf_dir, "part").select("p_partkey", key.alias("key"), N.is_seam(kind, section, table).alias("seam"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT *, CAST(length(line) >= 40 AS INT) AS solid FROM p WHERE trim(line, ' ') <> ''),
k AS (SELECT *, sum(solid) OVER (PARTITION BY doc_id) AS total, coalesce(sum(solid) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM m)
SELECT doc_id, CAST(coalesce(max(CASE WHEN solid = 1 THEN n END), min(n)) AS INT) AS n, md5(string_agg(line, chr(10) || chr(10) ORDER BY n)) AS text_md5, CAST(sum(1 - solid) AS BIGINT) AS n_stubs FROM k GROUP BY doc_id, greatest(0, least(earlier, total - 1))""")
def folded_stubs(spark, sf_dir):
    """Lines as blocks; those of under forty characters are stubs."""
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).where(F.trim("text") != "")
    out = N.fold_stubs(lines.select("doc_id", (F.col("at") + 1).alias("n"), "text"), "doc_id", "n", F.length("text") < 40)
    return out.select("doc_id", "n", F.md5("text").alias("text_md5"), "n_stubs")


@query("""SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) AS own, CASE WHEN l_orderkey % 2 = 0 THEN 'even' END AS kind, CAST(min(l_linenumber) AS VARCHAR) AS row_min, CAST(CASE WHEN l_orderkey % 2 = 0 THEN 3 ELSE 2 END AS INT) AS n FROM lineitem GROUP BY l_orderkey""")
def chunk_records(spark, sf_dir):
    place = F.struct(F.lit(1).alias("page"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("json_path"), F.col("l_linenumber").alias("row_start"), F.col("l_linenumber").alias("row_end"))
    per = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(place).alias("places"))
    block = F.create_map(F.lit("kind"), F.when(F.col("l_orderkey") % 2 == 0, "even"), F.lit("order"), F.lit("not this one"))
    rec = per.select("l_orderkey", N.chunk_record({"order": F.col("l_orderkey")}, block, C.location_summary(F.col("places"))).alias("r"))
    return rec.select("l_orderkey", F.try_element_at("r", F.lit("order")).alias("own"), F.try_element_at("r", F.lit("kind")).alias("kind"), F.get_json_object(F.col("r")["locations"], "$.row_min").alias("row_min"), F.size("r").alias("n"))


def _blocks(spark, sf_dir):
    lines = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.where(F.trim("text") != "")


@query()
def banded_parents(spark, sf_dir):
    """Lines as blocks, coalesced into parents; a line of over 6000 characters is a seam."""
    return C.banded_parents(_blocks(spark, sf_dir), "doc_id", "n", seam=F.length("text") > 6000)


@query("""SELECT doc_id, count(*) AS n_blocks, CAST(0 AS BIGINT) AS over_band, CAST(0 AS BIGINT) AS over_tokens, CAST(0 AS BIGINT) AS gaps FROM
(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> '' GROUP BY doc_id""")
def parent_audit(spark, sf_dir):
    """Violations among parents of several blocks: too many children, too many tokens, places not in order."""
    p = banded_parents(spark, sf_dir).withColumn("many", F.col("n_blocks") > 1)
    return p.groupBy("doc_id").agg(
        F.sum("n_blocks").alias("n_blocks"), F.count_if(F.col("many") & (F.col("n_children") > 8)).alias("over_band"),
        F.count_if(F.col("many") & (F.floor(F.col("n_chars") / 4) > 1800)).alias("over_tokens"), F.count_if(F.col("first") > F.col("last")).alias("gaps"),
    )


@query(f"""WITH RECURSIVE {_WINDOWS}, o AS (SELECT *, lag(char_end) OVER (PARTITION BY doc_id ORDER BY chunk_index) - char_start AS shared FROM win)
SELECT doc_id, count(*) AS n_windows, count(*) FILTER (WHERE shared BETWEEN 200 AND 300) AS n_in_band, count(*) FILTER (WHERE shared = 0) AS n_without, CAST(0 AS BIGINT) AS n_other FROM o GROUP BY doc_id""")
def overlap_audit(spark, sf_dir):
    from pyspark.sql import Window

    w = C.sliding_windows(t(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "char_start", "char_end")
    shared = F.lag("char_end").over(Window.partitionBy("doc_id").orderBy("chunk_index")) - F.col("char_start")
    ok = F.col("s").between(200, 300)
    return w.withColumn("s", shared).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(ok).alias("n_in_band"), F.count_if(F.col("s") == 0).alias("n_without"), F.count_if(~ok & (F.col("s") != 0)).alias("n_other"))


_FOUND = """said AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank, CASE WHEN turn % 2 = 1 THEN 'd' || turn END AS item_id, role AS payload FROM conversations),
found AS (SELECT doc_id // 6 AS query_id, doc_id % 6 + 1 AS rank, 'd' || (doc_id % 6) AS item_id, lang AS payload FROM documents),
routes AS (SELECT DISTINCT conv_id AS query_id, CASE WHEN conv_id % 3 = 0 THEN 'documents_only' WHEN conv_id % 3 = 1 THEN 'hybrid' ELSE 'conversation_only' END AS route FROM conversations)"""


def _found(spark, sf_dir):
    """Turns of a conversation, the last first, and six documents by number, some under a turn's name."""
    conv, docs = t(spark, sf_dir, "conversations"), t(spark, sf_dir, "documents")
    said = R.top_per(conv, ["conv_id"], [F.col("turn").desc()], 1 << 30).select(F.col("conv_id").alias("query_id"), "rank", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("d"), F.col("turn").cast("string"))).alias("item_id"), F.col("role").alias("payload"))
    found = docs.select(F.floor(F.col("doc_id") / 6).alias("query_id"), (F.col("doc_id") % 6 + 1).alias("rank"), F.concat(F.lit("d"), (F.col("doc_id") % 6).cast("string")).alias("item_id"), F.col("lang").alias("payload"))
    route = F.when(F.col("conv_id") % 3 == 0, "documents_only").when(F.col("conv_id") % 3 == 1, "hybrid").otherwise("conversation_only")
    return said, found, conv.select(F.col("conv_id").alias("query_id"), route.alias("route")).distinct()


_FUSE = f"""WITH {_FOUND}, asked AS (SELECT * FROM found WHERE query_id NOT IN (SELECT query_id FROM routes WHERE route = 'conversation_only')), hy AS (SELECT query_id FROM routes WHERE route = 'hybrid'),
u AS (SELECT query_id, coalesce(item_id, 'conv-' || (rank - 1)) AS item_id, 'conversation' AS source, payload, rank, 0 AS arm FROM said WHERE rank <= 2 AND query_id IN (SELECT * FROM hy)
 UNION ALL SELECT query_id, item_id, 'document', payload, rank, 1 FROM asked WHERE query_id IN (SELECT * FROM hy)),
g AS (SELECT query_id, item_id, arg_min(source, arm * 1000 + rank) AS source, arg_min(payload, arm * 1000 + rank) AS payload, min(arm * 1000 + rank) AS place, sum(CAST(1.0 / (60 + rank) AS DOUBLE)) AS s FROM u GROUP BY ALL),
fused AS (SELECT query_id, item_id, source, payload, round(s, 6) AS rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, place, item_id) AS rank FROM g
 UNION ALL SELECT query_id, item_id, 'document', payload, NULL, rank FROM asked WHERE query_id NOT IN (SELECT * FROM hy))"""


@query(f"{_FUSE} SELECT * FROM fused")
def fused_sources(spark, sf_dir):
    said, found, routes = _found(spark, sf_dir)
    return S.fuse_sources(said, S.documents_asked(found, routes), routes).withColumn("rrf", F.round("rrf", 6))


@query(f"{_FUSE} SELECT query_id, count(*) AS n FROM fused WHERE source = 'document' GROUP BY query_id")
def rerank_candidates(spark, sf_dir):
    said, found, routes = _found(spark, sf_dir)
    return S.citation_candidates(S.fuse_sources(said, S.documents_asked(found, routes), routes)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, role, md5(role || ' ' || text) AS text_md5 FROM conversations")
def normalized_messages(spark, sf_dir):
    """Turns under other names of their roles, their text in two blocks."""
    alias = F.when(F.col("role") == "user", " Human").when(F.col("role") == "assistant", "AI").otherwise(F.col("role"))
    raw = t(spark, sf_dir, "conversations").select("conv_id", "turn", alias.alias("role"), F.array("role", "text").alias("content"))
    return S.normalize_messages(raw).select("conv_id", "turn", "role", F.md5("content").alias("text_md5"))


@query("""SELECT o_custkey, CAST(coalesce(arg_min(o_orderkey % 5 - 2, o_orderkey) FILTER (WHERE o_orderkey % 5 <> 2), 1) AS INT) AS page,
arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 200000) AS top, CASE WHEN max(o_totalprice) > 200000 THEN 100.0 END AS width FROM orders GROUP BY o_custkey""")
def chunk_pages(spark, sf_dir):
    """Orders as places of their customer: pages from -2, of which 0 counts as none, and boxes of the dear ones."""
    box = F.when(F.col("o_totalprice") > 200000, F.struct(F.col("o_totalprice").alias("top"), *[F.lit(None).cast("double").alias(c) for c in ("left", "width", "height")]))
    places = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 5 - 2).cast("int").alias("page"), box.alias("bbox")))), lambda x: F.struct(x["page"].alias("page"), x["bbox"].alias("bbox")))
    per = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(places.alias("p"))
    return per.select("o_custkey", X.page_of(F.col("p")).alias("page"), X.box_of(F.col("p"))["top"].alias("top"), X.box_of(F.col("p"))["width"].alias("width"))


@query("""SELECT doc_id % 50 AS query_id, md5(string_agg(substr(text, 1, 300), '~' ORDER BY doc_id)) AS snippets, string_agg(CASE WHEN doc_id % 3 = 0 THEN 'Document passage' ELSE source END, '~' ORDER BY doc_id) AS titles, count(*) AS n,
CASE WHEN doc_id % 50 % 2 = 0 THEN 1 ELSE count(*) END AS n_cited FROM documents GROUP BY doc_id % 50""")
def fallback_citations(spark, sf_dir):
    """Documents as hits of fifty queries; the answers of every second one cite by themselves."""
    sections = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("lang"), F.col("source")))
    hits = t(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("query_id"), F.col("doc_id").alias("rank"), "doc_id", F.col("text").alias("child_text"), sections.alias("section_path"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("struct<top:double,left:double,width:double,height:double>").alias("box"))
    made = X.citations_of(hits)
    parsed = F.when(F.col("query_id") % 2 == 0, F.slice("citations", 1, 1)).otherwise(F.slice("citations", 1, 0))
    join = lambda f: F.array_join(F.transform("citations", lambda c: c[f]), "~")
    return made.select("query_id", F.md5(join("snippet")).alias("snippets"), join("chunk_title").alias("titles"), F.size("citations").cast("long").alias("n"), F.size(X.cited(parsed, F.col("citations"))).cast("long").alias("n_cited"))


@query("""WITH k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)
SELECT conv_id AS query_id, md5('Conversation:' || chr(10) || string_agg('- (' || role || ') ' || text, chr(10) ORDER BY rank) FILTER (WHERE rank <= 3) || chr(10) || chr(10) || coalesce('Context:' || chr(10) || string_agg('[' || (rank - 3) || '] ' || text, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE rank > 3) || chr(10) || chr(10), '') || 'Question: ' || conv_id) AS prompt_md5
FROM k GROUP BY conv_id""")
def conversation_prompts(spark, sf_dir):
    """The first three turns as what was said, the others as context."""
    k = R.top_per(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], 1 << 30).withColumnRenamed("conv_id", "query_id")
    later = k.where("rank > 3").select("query_id", "rank", F.col("text").alias("parent_text"), F.col("text").alias("child_text"))
    asked = k.select("query_id", F.col("query_id").cast("string").alias("query")).distinct()
    return X.prompts(later, asked, said=k.select("query_id", "rank", "role", "text")).select("query_id", F.md5("prompt").alias("prompt_md5"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'extension' WHEN n_chars * 50000 > 52428800 THEN 'size' WHEN doc_id % 4 = 2 AND NOT starts_with(text, '%PDF-') THEN 'signature' END AS reject_reason FROM documents""")
def admitted_files(spark, sf_dir):
    """Texts as files of made extensions and sizes."""
    ext = F.when(F.col("doc_id") % 4 == 1, "exe").when(F.col("doc_id") % 4 == 2, "pdf").otherwise("txt")
    files = t(spark, sf_dir, "documents").select("doc_id", ext.alias("extension"), (F.col("n_chars") * 50000).alias("file_size"), F.col("text").cast("binary").alias("content"))
    return R.admit(files).select("doc_id", "reject_reason")


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS user_id, CASE WHEN doc_id % 3 <> 0 THEN 'doc_' || md5(CAST(doc_id AS VARCHAR)) END AS key_doc FROM documents")
def object_keys(spark, sf_dir):
    name = F.concat(F.lit("doc_"), F.md5(F.col("doc_id").cast("string")))
    key = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "lang", F.lit("x"), name)).when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "lang", name)).otherwise(F.concat(F.col("lang"), F.lit("/"), name, F.lit("_a/b.txt")))
    user, doc = R.parse_key(key)
    return t(spark, sf_dir, "documents").select("doc_id", user.alias("user_id"), doc.alias("key_doc"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 2 = 1 THEN source END AS source FROM documents")
def promoted_fields(spark, sf_dir):
    meta = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.col("lang"))).otherwise(F.create_map(F.lit("source"), F.col("source")))
    return R.promote(t(spark, sf_dir, "documents").select("doc_id", meta.alias("metadata")), ["lang", "source"]).drop("metadata")


@query("""SELECT l_orderkey AS doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE l_linenumber <> 5 OR l_orderkey % 2 = 0) AS n_dense, count(*) AS n_sparse,
CASE WHEN count(*) = count(*) FILTER (WHERE l_linenumber <> 5 OR l_orderkey % 2 = 0) THEN 'EMBEDDED' ELSE 'FAILED' END AS status FROM lineitem GROUP BY l_orderkey""")
def vector_counts(spark, sf_dir):
    """Order lines as chunks; the fifth of an odd order has no dense vector."""
    chunks = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunk_id"), "l_linenumber")
    return R.count_agreement(chunks, chunks.where("l_linenumber <> 5 or doc_id % 2 = 0"), chunks)


@query("SELECT conv_id, turn, md5(trim(text, ' ')) AS answer_md5, CASE WHEN turn % 3 = 0 THEN CAST(turn AS INT) END AS page FROM conversations")
def parsed_citations(spark, sf_dir):
    """Turns as answers with a citation block that has a trailing comma, no block, or a broken one."""
    block = F.concat(F.lit(X.START + '[{"id": 1, "doc_id": "d", "page": '), F.col("turn").cast("string"), F.lit(",}]" + X.END))
    answer = F.concat("text", F.when(F.col("turn") % 3 == 0, block).when(F.col("turn") % 3 == 1, "").otherwise(F.lit(X.START + "{broken" + X.END)))
    text, cites = X.parse_citations(answer)
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text).alias("answer_md5"), F.get(cites, 0)["page"].alias("page"))


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, 'doc_' || md5(CAST(event_id AS VARCHAR)) AS doc_id FROM events WHERE event_type <> 'view' AND event_id % 5 <> 0")
def arrived_objects(spark, sf_dir):
    """Events as created or removed objects, less every fifth, which is completed."""
    e = t(spark, sf_dir, "events")
    doc = F.concat(F.lit("doc_"), F.md5(F.col("event_id").cast("string")))
    name = F.when(F.col("event_type") == "view", "ObjectRemoved:Delete").otherwise("ObjectCreated:Put")
    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), doc, F.lit("_f.txt"))
    records = F.array(F.struct(name.alias("eventName"), F.struct(F.struct(key.alias("key")).alias("object")).alias("s3")))
    return H.arrivals(e.select(records.alias("Records")), e.where("event_id % 5 = 0").select(doc.alias("doc_id")))


@query("""SELECT CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_processed, count(*) FILTER (WHERE event_type <> 'purchase') AS n_failed,
round(100.0 * count(*) FILTER (WHERE event_type <> 'purchase') / count(*), 2) AS failure_rate, round(avg(value) FILTER (WHERE event_type = 'purchase'), 2) AS average_duration_s FROM events""")
def job_totals(spark, sf_dir):
    jobs = t(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "purchase", "processed").otherwise("failed").alias("outcome"), F.col("value").alias("duration_s"))
    return H.metric_totals(H.minute_metrics(jobs))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 1 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 1)")
def owned_order(spark, sf_dir):
    """The first order of customer 1, looked up by key and owner."""
    orders = t(spark, sf_dir, "orders")
    first = orders.where("o_custkey = 1").agg(F.min("o_orderkey")).first()[0]
    return R.owned(orders, "o_orderkey", first, "o_custkey", 1).select("o_orderkey", "o_orderstatus")
