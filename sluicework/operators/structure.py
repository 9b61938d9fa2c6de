"""Structure of documents: long lines cut, Markdown, styled spans, boxes, packed children, parents of JSON
values, slides and table rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .ranges import numbered, pack

# Fixed values.
LINE_CHARS, PACK_CHARS, TABLE_BAND, JSON_SAMPLE = 2000, 2000, 8, 8
BODY_SIZE, HEADING_RATIO, BOLD_RATIO, SHORT = 11.0, 1.35, 1.15, 150
LIST_ITEM = r"^\s*(?:[-*•]|\d{1,2}[.)])\s+"
CELL_CHARS = 500
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def pieces(line: str, most: int = LINE_CHARS) -> list[tuple[int, str]]:
    """(offset, piece) of a line: cut at the last space that fits, within a word only where no space does."""
    out, at = [], 0
    while len(line) - at > most:
        space = line.rfind(" ", at + 1, at + most + 1)
        end = space if space > at else at + most
        out.append((at, line[at:end]))
        at = end + (space > at)
    return [*out, (at, line[at:])]


def split_long_lines(lines: DataFrame, key: str, start: str = "char_start", text: str = "line") -> DataFrame:
    """key, line_number, piece, char_start, char_end, text of the pieces of every line."""
    kind = lines.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, i, a + o, a + o + len(p), p) for k, n, a, t in zip(f[key], f["line_number"], f[start], f[text]) if t is not None for i, (o, p) in enumerate(pieces(t))]
            yield pd.DataFrame(rows, columns=[key, "line_number", "piece", "char_start", "char_end", "text"])

    return lines.select(key, "line_number", start, text).mapInPandas(run, f"{key} {kind}, line_number long, piece int, char_start long, char_end long, text string")


def markdown_outline(text: str) -> list[tuple[str, str, list[str], int]]:
    """(type, text, section path, first line) of headings, fenced code and other lines that are not blank."""
    out, section, fence, block, first = [], [], "", [], 0
    for n, line in enumerate(text.split("\n"), 1):
        mark = FENCE.match(line)
        if fence:
            block.append(line)
            if mark and mark[1][0] == fence:
                out.append(("code_block", "\n".join(block), list(section), first))
                fence = ""
            continue
        if mark:
            fence, block, first = mark[1][0], [line], n
            continue
        head = HEADING.match(line)
        if head:
            title = (head[2] or "").strip()
            if title:
                section = section[: len(head[1]) - 1] + [title]
                out.append(("heading", title, list(section), n))
        elif line.strip():
            out.append(("paragraph", line.strip(), list(section), n))
    return [*out, ("code_block", "\n".join(block), list(section), first)] if fence else out


def markdown_elements(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, order (from 1), element_type, text, section_path, line_number of every text's elements."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, e, x, path, n) for k, t in zip(f[key], f["text"]) if t for i, (e, x, path, n) in enumerate(markdown_outline(t), 1)]
            yield pd.DataFrame(rows, columns=[key, "order", "element_type", "text", "section_path", "line_number"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, order long, element_type string, text string, section_path array<string>, line_number long")


def style_classes(spans: DataFrame, doc: str, text: Column, size: Column, bold: Column) -> DataFrame:
    """Adds body_size (the document's median), element_type and heading_level by size, weight and length.

    The median is aggregated first and joined, so that a document's spans need not share a task."""
    body = spans.groupBy(F.col(doc).alias("_doc")).agg(F.coalesce(F.percentile(size, 0.5), F.lit(BODY_SIZE)).alias("body_size"))
    out = spans.join(body, F.col(doc).eqNullSafe(F.col("_doc"))).drop("_doc")
    short = F.length(text) <= SHORT
    large = (size >= HEADING_RATIO * F.col("body_size")) & (bold | short)
    strong = bold & short & ~text.rlike(r"[.!?;:,]\s*$") & (size >= BOLD_RATIO * F.col("body_size"))
    kind = F.when(text.rlike(LIST_ITEM), "list_item").when(large | strong, "heading").otherwise("paragraph")
    out = out.withColumn("element_type", kind)
    return out.withColumn("heading_level", F.when(F.col("element_type") == "heading", F.when(size >= 26, 1).when(size >= 20, 2).otherwise(3)))


def style_clusters(lines: DataFrame, block: list[str], order: str) -> DataFrame:
    """Adds cluster (from 1 in each block): lines stay together while size is within max(0.5, 12 %) of the
    cluster's first line and bold is equal. lines: block, order, size, bold; a block is one page's block."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(order, kind="stable")
        out, now, ref, heavy = [], 0, None, None
        for s, b in zip(f["size"], f["bold"]):
            if ref is None or abs(s - ref) > max(0.5, 0.12 * ref) or b != heavy:
                now, ref, heavy = now + 1, s, b
            out.append(now)
        return f.assign(cluster=out)

    kinds = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in lines.schema.fields)
    return lines.groupBy(*block).applyInPandas(run, f"{kinds}, cluster long")


def box_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the smallest box (x1, y1, x2, y2) around all boxes; corners in the wrong order are put right."""
    low = lambda a, b: F.min(F.least(a, b))
    high = lambda a, b: F.max(F.greatest(a, b))
    return boxes.groupBy(*keys).agg(low("x1", "x2").alias("x1"), low("y1", "y2").alias("y1"), high("x1", "x2").alias("x2"), high("y1", "y2").alias("y2"))


def safe_box(x1: Column, y1: Column, x2: Column, y2: Column, page: Column) -> Column:
    """A box of four texts or numbers and its page, or null where one of them is missing or no number."""
    v = [c.try_cast("double") for c in (x1, y1, x2, y2)]
    whole = page.try_cast("int").isNotNull()
    for c in v:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    return F.when(whole, F.struct(page.try_cast("int").alias("page"), F.least(v[0], v[2]).alias("x1"), F.least(v[1], v[3]).alias("y1"), F.greatest(v[0], v[2]).alias("x2"), F.greatest(v[1], v[3]).alias("y2")))


def slide_box(left: Column, top: Column, right: Column, bottom: Column, origin: Column, slide: Column) -> Column:
    """A slide's box as stored (its corners as they are, with the origin they count from), or null where the slide or
    one of the four numbers is missing or none."""
    v = [c.try_cast("double") for c in (left, top, right, bottom)]
    whole = slide.try_cast("int").isNotNull()
    for c in v:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    return F.when(whole, F.struct(slide.try_cast("int").alias("slide"), v[0].alias("x1"), v[1].alias("y1"), v[2].alias("x2"), v[3].alias("y2"), F.coalesce(origin, F.lit("TOPLEFT")).alias("coord_origin")))


def location(page_box: Column, slide_box_: Column, start: Column, end: Column) -> Column:
    """Where an element is: its page's box (safe_box), else its slide's (slide_box), with its characters; characters
    alone are a text_offset. Characters count only if both are whole numbers in order; without anything it is null."""
    a, z = start.try_cast("int"), end.try_cast("int")
    sound = a.isNotNull() & z.isNotNull() & (a >= 0) & (a <= z)
    kind = F.when(page_box.isNotNull(), "page_box").when(slide_box_.isNotNull(), "slide_box").when(sound, "text_offset")
    at = lambda c: F.coalesce(page_box[c], slide_box_[c])
    return F.when(
        kind.isNotNull(),
        F.struct(
            kind.alias("type"), page_box["page"].alias("page"), slide_box_["slide"].alias("slide"), at("x1").alias("x1"), at("y1").alias("y1"), at("x2").alias("x2"), at("y2").alias("y2"),
            F.when(page_box.isNull(), slide_box_["coord_origin"]).alias("coord_origin"), F.when(sound, a).alias("char_start"), F.when(sound, z).alias("char_end"),
        ),
    )


def pack_children(elements: DataFrame, doc: str, order: str, text: str = "text", atomic: str | None = None, most: int = PACK_CHARS, fresh: str | None = None) -> DataFrame:
    """doc, child (from 0), first, last (order), n_elements, text: consecutive elements joined by a blank line
    up to ``most`` characters. Blank ones go; an atomic one, or one longer than that, is a child alone. An
    element for which ``fresh`` holds, blank or not, lets nothing behind it join what is before it.

    Elements are packed by ranges, so that no task holds a document; a child is as large as ``most`` or one element."""
    said = F.col(text).rlike(r"(?U)\S")
    sized = elements.withColumn("_size", F.when(said, F.length(text)))
    packed = pack(sized, doc, order, "_size", most, fresh, atomic, "child").where("child is not null")
    out = packed.groupBy(doc, "child").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_es"))
    return out.select(doc, "child", F.get("_es.o", 0).alias("first"), F.element_at("_es.o", -1).alias("last"), F.size("_es").cast("long").alias("n_elements"), F.array_join("_es.t", "\n\n").alias("text"))


def json_parents(leaves: DataFrame, key: str, sample: int = JSON_SAMPLE) -> DataFrame:
    """leaves: key, order, path, label, value. key, root, n_leaves, text for each top-level key: its name and first leaves."""
    root = F.regexp_extract("path", r"^\$\.?([^.\[]*)", 1)
    said = F.concat_ws(": ", "label", "value")
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.col("order").alias("o"), said.alias("t")))), 1, sample)
    out = leaves.groupBy(key, root.alias("root")).agg(F.count(F.lit(1)).alias("n_leaves"), first.alias("_first"))
    return out.withColumn("text", F.concat_ws("\n", F.concat(F.lit("root: "), "root"), F.array_join(F.transform("_first", lambda x: x["t"]), "\n"))).drop("_first")


def slide_parents(slides: DataFrame, keys: list[str]) -> DataFrame:
    """slides: keys, slide, title. keys, slide_first, slide_last, n_slides, titles, path: the titles, else the slide numbers."""
    titled = F.filter(F.array_sort(F.collect_list(F.struct(F.col("slide").alias("s"), F.trim("title").alias("t")))), lambda x: F.coalesce(x["t"], F.lit("")) != "")
    out = slides.groupBy(*keys).agg(F.min("slide").alias("slide_first"), F.max("slide").alias("slide_last"), F.count_distinct("slide").alias("n_slides"), titled.alias("_t"))
    out = out.withColumn("titles", F.array_join(F.array_distinct(F.transform("_t", lambda x: x["t"])), " / ")).drop("_t")
    numbers = F.when(F.col("slide_first") == F.col("slide_last"), F.concat(F.lit("Slide "), "slide_first")).otherwise(F.concat(F.lit("Slides "), "slide_first", F.lit("-"), "slide_last"))
    return out.withColumn("path", F.when(F.col("titles") != "", F.col("titles")).otherwise(numbers))


def table_row_children(rows: DataFrame, table: str, order: str, text: str, band: int = TABLE_BAND) -> DataFrame:
    """table, parent (from 0), child (0..band-1 in it), order, text: one child for each row that is not blank."""
    said = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(table, order, text)
    by = numbered(said, [table], [order], "_n")  # by ranges: a table may be larger than a task
    return by.select(table, F.floor(F.col("_n") / band).alias("parent"), (F.col("_n") % band).alias("child"), order, text)


def tabular_meta(rows: DataFrame, group: list[str], order: str, sheet: str, cell_range: str, columns: str | None = None) -> DataFrame:
    """group, row_min, row_max, the first sheet, the range from the first row's first cell to the last row's last (one
    cell as itself), and, if asked for, the first columns of the group's rows."""
    first, last = F.min_by(cell_range, order), F.max_by(cell_range, order)
    ends = F.array_distinct(F.filter(F.array(F.element_at(F.split(first, ":"), 1), F.element_at(F.split(last, ":"), -1)), lambda x: x.isNotNull()))
    more = [F.min_by(columns, F.when(F.size(columns) > 0, F.col(order))).alias("columns")] if columns else []
    return rows.groupBy(*group).agg(F.min(order).alias("row_min"), F.max(order).alias("row_max"), F.min_by(sheet, order).alias("sheet"), F.array_join(ends, ":").alias("cell_range"), *more)


def plain_elements(lines: DataFrame, key: str) -> DataFrame:
    """key, line_number, piece, char_start, char_end, text: a paragraph for every line that is not blank, long ones in pieces.

    lines: as lines_with_offsets gives them. Only lines longer than LINE_CHARS pass Python."""
    said = lines.where(F.trim("line") != "")
    short = F.length("line") <= LINE_CHARS
    whole = said.where(short).select(key, "line_number", F.lit(0).alias("piece"), "char_start", "char_end", F.col("line").alias("text"))
    return whole.unionByName(split_long_lines(said.where(~short), key))


def html_table_rows(cells: DataFrame, table: list[str], row: str, column: str) -> DataFrame:
    """table, row, element_type, text: the row that holds a table's first header cell, else its first row, names
    the columns; every other row is ``header: cell`` a line, ``extra_n`` beyond the header, ``column{n}`` where
    that is blank. cells: table, row, column (from 0), is_header, text; cells are cut to CELL_CHARS."""
    kept = cells.select(*table, row, column, "is_header", F.substring(F.coalesce("text", F.lit("")), 1, CELL_CHARS).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(column).alias("c"), F.col("text").alias("t"))))
    rows = kept.groupBy(*table, row).agg(F.transform(parts, lambda x: x["t"]).alias("cells"), F.max("is_header").alias("_th"))
    rows = written(rows)  # read twice: cells may come from pages that are parsed for them
    heads = rows.groupBy(*table).agg(F.min_by(F.struct(F.col(row).alias("at"), F.col("cells").alias("names")), F.struct(~F.col("_th"), F.col(row))).alias("_head"))
    both = rows.join(heads, table)
    name = lambda i: F.coalesce(F.nullif(F.get("_head.names", i), F.lit("")), F.concat(F.lit("column"), (i + 1).cast("string")))
    label = lambda i: F.when(i < F.size("_head.names"), name(i)).otherwise(F.concat(F.lit("extra_"), (i - F.size("_head.names") + 1).cast("string")))
    body = F.array_join(F.transform("cells", lambda v, i: F.concat(label(i), F.lit(": "), v)), "\n")
    head = F.array_join(F.filter("cells", lambda v: v != ""), " | ")
    first = F.col(row) == F.col("_head.at")
    return both.select(*table, row, F.when(first, "table_header").otherwise("table_row").alias("element_type"), F.when(first, head).otherwise(body).alias("text"))
