"""Layout trees given as node tables: flattening, slides, tables of rows and cells, parents of subtrees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import numbered
from .structure import LINE_CHARS, pieces

# Containers hand their children on; these types stay without a text.
CONTAINERS = ("list", "text_block")
KEEP_BLANK = ("image", "caption", "table", "table_row")
NUMBERED = r"^\d{1,2}[.)]\s"
DEEPEST = 64


def flatten(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, order (pre-order, from 1), node, parent (the nearest ancestor that is an element), root, top, type,
    content, slide, n_kids of every element of trees.

    nodes: doc, node, parent (null: a root), pos, type, content, and, if slides are asked for, page and group
    (numbered from 0). A node is visited once. Containers and blank nodes of other types than KEEP_BLANK are no
    elements; their children belong to what is above. A slide number is the node's page, else its group's
    number and one, else that of its parent. section_path has the titles above a node, its own included. A node whose
    parent is not there, or that is above itself, is not reached and is left out. One join for each level; every level is written once, and deeper
    levels than DEEPEST are an error."""
    has = set(nodes.columns)
    extra = [F.col(c) if c in has else F.lit(None).cast("int").alias(c) for c in ("page", "group")]
    one = nodes.select(doc, "node", "parent", "pos", "type", "content", *extra).dropDuplicates([doc, "node"])
    kids = one.where("parent is not null").groupBy(doc, F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_kids"))
    one = written(one.join(kids, [doc, "node"], "left").withColumn("n_kids", F.coalesce("n_kids", F.lit(0))))
    is_element = ~F.col("type").isin(*CONTAINERS) & (F.col("type").isin(*KEEP_BLANK) | (F.trim(F.coalesce("content", F.lit(""))) != ""))
    step = F.struct("pos", "node")
    own_slide = F.coalesce("page", F.col("group") + 1)
    text = F.trim(F.coalesce("content", F.lit("")))
    own_title = F.when((F.col("type") == "title") & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    at = one.where("parent is null").select(doc, "node", F.array(step).alias("path"), F.col("node").alias("root"), F.lit(None).cast(one.schema["node"].dataType).alias("above"), own_slide.alias("slide"), "type", "content", "n_kids", is_element.alias("is_element"), own_title.alias("section_path"))
    levels = []
    for _ in range(DEEPEST):
        at = written(at)
        if at.isEmpty():
            break
        levels.append(at)
        up = at.select(doc, F.col("node").alias("parent"), F.col("path").alias("_path"), "root", F.when(F.col("is_element"), F.col("node")).otherwise(F.col("above")).alias("above"), F.col("slide").alias("_slide"), F.col("section_path").alias("_titles"))
        at = one.join(up, [doc, "parent"]).select(doc, "node", F.concat("_path", F.array(step)).alias("path"), "root", "above", F.coalesce(own_slide, "_slide").alias("slide"), "type", "content", "n_kids", is_element.alias("is_element"), F.concat("_titles", own_title).alias("section_path"))
    else:
        raise ValueError(f"a tree is deeper than {DEEPEST} levels")
    if not levels:
        return at.select(doc, F.lit(0).cast("long").alias("order"), "node", F.col("above").alias("parent"), "root", F.lit(0).alias("depth"), "type", "content", "slide", "n_kids", "section_path")
    every = levels[0]
    for x in levels[1:]:
        every = every.unionAll(x)
    every = every.where("is_element")
    order = F.row_number().over(Window.partitionBy(doc).orderBy("path")).cast("long")
    return every.select(doc, order.alias("order"), "node", F.col("above").alias("parent"), "root", (F.size("path") - 1).alias("depth"), "type", "content", "slide", "n_kids", "section_path")


def table_rows(cells: DataFrame, table: list[str], row: str, column: str, text: str) -> DataFrame:
    """table, row (null for the table itself), element_type, text, n_rows, n_columns: a row's cells joined by
    `` | ``, a table's rows by newlines. Blank cells stay as empty places."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    rows = cells.groupBy(*table, row).agg(F.array_join(F.transform(parts, lambda x: x["t"]), " | ").alias("text"), F.count(F.lit(1)).alias("n_columns"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), F.col("text").alias("t"))))
    whole = rows.groupBy(*table).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_rows"), F.max("n_columns").alias("n_columns"))
    kind = cells.schema[row].dataType
    top = whole.select(*table, F.lit(None).cast(kind).alias(row), F.lit("table").alias("element_type"), "text", "n_rows", "n_columns")
    return top.unionAll(rows.select(*table, row, F.lit("table_row").alias("element_type"), "text", F.lit(1).cast("long").alias("n_rows"), "n_columns"))


def is_major(kind: Column, content: Column, n_kids: Column) -> Column:
    """Whether a root element has a parent chunk of its own."""
    return kind.isin("table", "heading", "list_item") | (n_kids > 0) | F.coalesce(content.rlike(NUMBERED), F.lit(False))


def tree_blocks(flat: DataFrame, doc: str = "doc_id") -> DataFrame:
    """flat, as flatten gives it, with ``block`` (from 1 in each document): a major root with all its
    descendants is a block, other roots that follow one another share one."""
    w = Window.partitionBy(doc).orderBy("order")
    roots = flat.groupBy(doc, "root").agg(F.min("order").alias("order"), F.max(F.when(F.col("node") == F.col("root"), F.struct("type", "content", "n_kids"))).alias("r"), F.count(F.lit(1)).alias("n"))
    major = F.coalesce(is_major(F.col("r.type"), F.col("r.content"), F.col("r.n_kids")), F.lit(True))  # a root that is no element has kids
    marked = roots.withColumn("major", major)
    new = F.when(F.col("major") | F.coalesce(F.lag("major").over(w), F.lit(True)), 1).otherwise(0)
    numbered = marked.withColumn("_new", new).select(doc, "root", F.sum("_new").over(w).cast("long").alias("block"))
    return flat.join(numbered, [doc, "root"])


def in_reading_order(nodes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """nodes (with page, y1, x1) with the roots of every document placed by page, then from y1 and x1 upwards, instead
    of by pos; a missing one comes last. Roots are numbered by ranges."""
    roots = nodes.where("parent is null")
    keys = [F.coalesce(F.col(c).cast("double"), F.lit(1e9)) for c in ("page", "y1", "x1")]
    at = numbered(roots.select(doc, "node", *[k.alias(f"_p{i}") for i, k in enumerate(keys)], "pos"), [doc], ["_p0", "_p1", "_p2", "pos", "node"], "_place")
    placed = nodes.join(at.select(F.col(doc).alias("_doc"), F.col("node").alias("_node"), "_place"), F.col(doc).eqNullSafe(F.col("_doc")) & (F.col("node") == F.col("_node")), "left")
    return placed.withColumn("pos", F.coalesce("_place", "pos").cast(nodes.schema["pos"].dataType)).drop("_doc", "_node", "_place")


def slide_elements(flat: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, order (from 1), node, parent, element_type, text, slide, section_path, fragment_index, fragment_count, char_start,
    char_end of the nodes of flatten: a text of over 2000 characters in fragments cut at spaces, of which all but the
    first have the type ``fragment``. char_start and char_end are places in the node's text.

    Only long texts pass Python; elements are numbered by ranges."""
    kept = ["node", "parent", "slide", "section_path"]
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}
    text = F.trim(F.coalesce("content", F.lit("")))
    rows = flat.select(doc, "order", *kept, F.col("type").alias("element_type"), text.alias("text"))
    short = F.length("text") <= LINE_CHARS
    whole = rows.where(short).select("*", F.lit(0).alias("fragment_index"), F.lit(1).alias("fragment_count"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [pieces(t) for t in f["text"]]
            out = f.drop(columns="text").loc[f.index.repeat([len(c) for c in cut])].reset_index(drop=True)
            flat_cut = [(i, len(c), o, p) for c in cut for i, (o, p) in enumerate(c)]
            out["element_type"] = [e if i == 0 else "fragment" for e, (i, *_) in zip(out["element_type"], flat_cut)]
            yield out.assign(text=[p for *_, p in flat_cut], fragment_index=[x[0] for x in flat_cut], fragment_count=[x[1] for x in flat_cut], char_start=[x[2] for x in flat_cut], char_end=[x[2] + len(x[3]) for x in flat_cut])

    schema = ", ".join([f"{c} {kinds[c]}" for c in (doc, "order", *kept)] + ["element_type string, text string, fragment_index int, fragment_count int, char_start long, char_end long"])
    long = rows.where(~short).select(doc, "order", *kept, "element_type", "text").mapInPandas(run, schema)
    every = numbered(whole.select(*long.columns).unionByName(long), [doc], ["order", "fragment_index"], "_n")
    return every.withColumn("order", F.col("_n") + 1).drop("_n")
