"""Elements out of raw documents: HTML pages, JSON values, Markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .structure import LINE_CHARS, pieces

# Fixed values.
DROPPED = ("script", "style", "noscript", "iframe", "svg", "template")
KEPT = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr")
ENDS_PARAGRAPH = (*KEPT[:8], "ul", "ol", "table", "div", "section", "article", "header", "footer", "nav", "main", "blockquote", "pre")
KINDS = {**{f"h{i}": "heading" for i in range(1, 7)}, "li": "list_item"}
ROOT, CELL_CHARS = "[document]", 500
#: The start of a character reference that lacks its semicolon.
BARE = re.compile(r"&(?=#?[A-Za-z0-9]+(?![A-Za-z0-9;]))")
#: Tags without attributes, and those whose content is read in another way.
PLAIN, PLAIN_END = re.compile(r"<([A-Za-z][A-Za-z0-9]*)>"), re.compile(r"</([A-Za-z][A-Za-z0-9]*)>")
NOT_PLAIN = ("script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "textarea", "title", "plaintext")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class Node:
    """An open or closed element: its place among the siblings of its name, and what has been read in it."""

    __slots__ = ("tag", "n", "parent", "counts", "parts", "hrefs", "cells", "table", "header", "first", "section")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.n = 1
        if parent is not None:
            self.n = parent.counts[tag] = parent.counts.get(tag, 0) + 1
        self.counts: dict[str, int] = {}
        self.parts: list[str] = []
        self.hrefs: dict[str, None] = {}
        self.cells: list[Node] = []
        self.table: Node | None = None
        self.header: Node | None = None  # of a table: the row of its first header cell
        self.first: Node | None = None  # of a table: its first row
        self.section: list[str] = []

    @property
    def path(self) -> str:
        steps, n = [], self
        while n is not None:
            steps.append(f"{n.tag}:nth-of-type({n.n})")
            n = n.parent
        return " > ".join(reversed(steps))

    def up(self, tag: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag != tag:
            n = n.parent
        return n

    def text(self) -> str:
        return " ".join(" ".join(self.parts).split())


class Dom(HTMLParser):
    """One pass over a page. ``found`` has the outermost kept elements in order; text, links and cells are given to
    every open element that asks for them while they are read, so that no tree has to be kept."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node(ROOT, None)]
        self.dropped = 0
        self.kept: Node | None = None
        self.readers: list[Node] = [self.open[0]]  # whose text is wanted
        self.section: list[str] = []
        self.found: list[Node] = []

    def updatepos(self, i, j):
        return j  # lines are not told

    def parse_starttag(self, i):
        """A tag without attributes, which most are, is read at once."""
        plain = PLAIN.match(self.rawdata, i)
        tag = plain[1].lower() if plain else ""
        if not plain or tag in NOT_PLAIN:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [])
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH and self.kept is not None and self.kept.tag == "p":
            self._close(self.kept)
        node = Node(tag, self.open[-1])
        if tag == "a" and not self.dropped:
            url = (dict(attrs).get("href") or "").strip()
            if url:
                for n in self.open:
                    n.hrefs.setdefault(url)
        if tag in VOID:
            return
        self.open.append(node)
        self.dropped += tag in DROPPED
        if self.dropped:
            return
        if tag in ("td", "th"):
            self.readers.append(node)
            if node.parent.tag == "tr":
                node.parent.cells.append(node)
        if tag == "tr":
            node.table = node.up("table")
        if tag in ("tr", "th"):
            row = node if tag == "tr" else node.up("tr")
            for table in (n for n in self.open if n.tag == "table"):
                if tag == "tr":
                    table.first = table.first or node
                elif row is not None:
                    table.header = table.header or row
        if tag in KEPT and self.kept is None:
            self.kept = node
            self.readers.append(node)

    def handle_endtag(self, tag):
        node = next((n for n in reversed(self.open) if n.tag == tag), None)
        if node is not None and node.tag != ROOT:
            self._close(node)

    def handle_data(self, data):
        if not self.dropped:
            for n in self.readers:
                n.parts.append(data)

    def _close(self, node: Node) -> None:
        """Closes the node and all that is open in it."""
        while True:
            last = self.open.pop()
            self.dropped -= last.tag in DROPPED
            if last in self.readers:
                self.readers.remove(last)
            if last is self.kept:
                self.kept = None
                text = last.text()
                if text:
                    if last.tag in KEPT[:6]:
                        self.section = self.section[: int(last.tag[1]) - 1] + [text]
                    last.section = list(self.section)
                    self.found.append(last)
            if last is node:
                return

    def close(self):
        super().close()
        if len(self.open) > 1:
            self._close(self.open[1])


def _read(html: str) -> Dom:
    page = Dom()
    page.feed(html)
    page.close()
    return page


def _whole(page: Dom) -> str:
    return page.open[0].text()


def html_outline(html: str) -> list[tuple[str, str, list[str]]]:
    """(tag, text, section path) of the outermost headings, paragraphs, list items and rows; the text of a page without any."""
    page = _read(html)
    return [(n.tag, n.text(), n.section) for n in page.found] or [("body", t, []) for t in [_whole(page)] if t]


def _columns(node: Node) -> tuple[Node | None, list[str]]:
    head = node.table.header or node.table.first
    return head, [c.text() for c in head.cells] if head is not None else []


def row_text(names: list[str], cells: list[str]) -> str:
    """``header: cell`` a line; ``column{n}`` for a blank header, ``extra_n`` beyond the headers."""
    label = lambda i: (names[i] or f"column{i + 1}") if i < len(names) else f"extra_{i - len(names) + 1}"
    return "\n".join(f"{label(i)}: {c[:CELL_CHARS]}" for i, c in enumerate(cells))


def _elements(html: str, bare: bool = True) -> Iterator[tuple[str, str, list[str], str, list[str], int]]:
    page = _read(html if bare else BARE.sub("&amp;", html))
    for n in page.found:
        links = list(n.hrefs)
        if n.tag != "tr":
            yield from ((KINDS.get(n.tag, "paragraph"), p, n.section, n.path, links, i) for i, (_, p) in enumerate(pieces(n.text())))
        elif n.table is not None:
            head, names = _columns(n)
            if n is head:
                yield "table_header", " | ".join(x for x in names if x), n.section, n.path, links, 0
            else:
                yield "table_row", row_text(names, [c.text() for c in n.cells]), n.section, n.path, links, 0
    if not page.found and (text := _whole(page)):
        yield "paragraph", text, [], "", [], 0


def html_elements(pages: DataFrame, key: str = "page_id", bare: bool = True) -> DataFrame:
    """key, order (from 1), element_type, text, section_path, dom_path, hrefs, fragment of every page's elements.

    Texts of over 2000 characters are cut into fragments (from 0). A table's row is told by the names of its columns,
    its header by the names alone; rows outside a table go. hrefs are the links within the element, each once. A p is
    closed by what closes it in HTML, so unclosed ones do not nest. A page without any element is one paragraph.
    bare: whether a character reference without its semicolon (``&amp``) is read as HTML does; else it stays as it is."""
    kind = pages.schema[key].dataType.simpleString()
    columns = [key, "order", "element_type", "text", "section_path", "dom_path", "hrefs", "fragment"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, *e) for k, h in zip(f[key], f["html"]) if h for n, e in enumerate(_elements(h, bare), 1)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, order long, element_type string, text string, section_path array<string>, dom_path string, hrefs array<string>, fragment int")


def html_cells(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, table (its DOM path), row (from 1 in the page), column (from 0), is_header, text: the cells of the outermost
    rows of every page's tables, as html_table_rows takes them. is_header: of the row that names the columns, which
    is that of the table's first header cell, those of tables inside it included, else its first."""
    kind = pages.schema[key].dataType.simpleString()

    def cells(html: str) -> Iterator[tuple]:
        rows = [n for n in _read(html).found if n.tag == "tr" and n.table is not None]
        for r, n in enumerate(rows, 1):
            path, head = n.table.path, n is (n.table.header or n.table.first)
            yield from ((path, r, c, head, x.text()) for c, x in enumerate(n.cells))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *c) for k, h in zip(f[key], f["html"]) if h for c in cells(h)], columns=[key, "table", "row", "column", "is_header", "text"])

    return pages.select(key, "html").mapInPandas(run, f"{key} {kind}, table string, row long, column int, is_header boolean, text string")


def _leaves(root) -> Iterator[tuple[str, str | None, str, int]]:
    """(path, label, value, depth) of every scalar in the order of the text: the label is the key that holds it, none
    for an item of an array; the root has depth 1. Nesting of any depth is walked by a stack."""
    todo = [(root, "$", None, 1)]
    while todo:
        value, path, label, depth = todo.pop()
        if isinstance(value, dict):
            todo += [(v, f"{path}.{k}", k, depth + 1) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(v, f"{path}[{i}]", None, depth + 1) for i, v in reversed([*enumerate(value)])]
        else:
            yield path, label, value if isinstance(value, str) else json.dumps(value), depth


def _strict(name: str):
    raise ValueError(name)


def json_leaves(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, order, path, label, value, depth of every scalar, in the order of the document. Text that is
    not JSON as a whole is tried line by line (path prefix ``L{n}.``); lines that fail too give a row with error."""
    kind = df.schema[key].dataType.simpleString()

    def of(text: str):
        try:
            yield from ((p, x, v, d, None) for p, x, v, d in _leaves(json.loads(text, parse_constant=_strict)))
            return
        except ValueError as e:
            whole = str(e)
        lines = [(n, s) for n, s in enumerate(text.splitlines(), 1) if s.strip()]
        for n, s in lines:
            try:
                yield from ((f"L{n}.{p}", x, v, d, None) for p, x, v, d in _leaves(json.loads(s, parse_constant=_strict)))
            except ValueError as e:
                yield f"L{n}", None, None, 0, str(e) if len(lines) > 1 else whole

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, *x) for k, t in zip(f[key], f[column]) if t for n, x in enumerate(of(t), 1)]
            yield pd.DataFrame(rows, columns=[key, "order", "path", "label", "value", "depth", "error"])

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, order long, path string, label string, value string, depth long, error string")


def json_elements(leaves: DataFrame, key: str) -> DataFrame:
    """key, order (of the leaf), fragment (from 0), path, text: ``label: value`` of every leaf, values of over 2000 characters in
    fragments cut at spaces, each with the label. Only those pass Python. Rows with an error are none."""
    sound = leaves.where("error is null")
    short = F.length("value") <= LINE_CHARS
    whole = sound.where(short).select(key, "order", F.lit(0).alias("fragment"), "path", F.concat_ws(": ", F.nullif("label", F.lit("")), "value").alias("text"))
    kind = leaves.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, n, i, p, f"{x}: {v}" if x else v) for k, n, p, x, t in zip(f[key], f["order"], f["path"], f["label"], f["value"]) for i, (_, v) in enumerate(pieces(t))]
            yield pd.DataFrame(rows, columns=[key, "order", "fragment", "path", "text"])

    long = sound.where(~short).select(key, "order", "path", "label", "value")
    return whole.unionByName(long.mapInPandas(run, f"{key} {kind}, order long, fragment int, path string, text string"))


def json_statistics(leaves: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """key, max_depth, n_errors, value_count and char_count (of the elements) of every document that has leaves or errors."""
    own = leaves.groupBy(key).agg(F.max(F.when(F.col("error").isNull(), F.col("depth"))).alias("max_depth"), F.count("error").alias("n_errors"))
    said = elements.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("value_count"), F.sum(F.length("text")).alias("char_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return own.join(said, F.col(key) == F.col("_k"), "left").select(key, zero("max_depth"), "n_errors", zero("value_count"), zero("char_count"))


def json_leaves_unordered(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, label, value, depth of every scalar of texts that are JSON as a whole, without Python: texts become
    variants, which are opened a level at a time until none holds another.

    A variant does not keep the order of its keys, nor how a number was written: numbers come as Spark writes them.
    Other texts give no row; json_leaves takes them line by line."""
    spark = df.sparkSession
    parsed = df.select(F.col(key), F.try_parse_json(column).alias("_v")).where("_v is not null")
    level = parsed.select(key, F.lit("$").alias("path"), F.lit(None).cast("string").alias("label"), F.lit(1).cast("long").alias("depth"), "_v")
    kind, found = F.schema_of_variant("_v"), []
    while True:
        level = written(level.withColumn("_open", kind.startswith("OBJECT") | kind.startswith("ARRAY")))
        scalar = F.when(kind == "STRING", F.variant_get("_v", "$", "string")).otherwise(F.coalesce(F.to_json("_v"), F.lit("null")))
        found.append(level.where("not _open").select(key, "path", "label", scalar.alias("value"), "depth"))
        inner = level.where("_open")
        if inner.isEmpty():
            break
        inner = inner.select(key, "path", "depth", "_v").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(
            key,
            F.when(F.col("key").isNotNull(), F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).alias("path"),
            F.col("key").alias("label"), (F.col("depth") + 1).alias("depth"), F.col("value").alias("_v"),
        )
        level = inner
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def element_statistics(elements: DataFrame, key: str) -> DataFrame:
    """key, element_type, n_elements, n_chars."""
    return elements.groupBy(key, "element_type").agg(F.count(F.lit(1)).alias("n_elements"), F.sum(F.length("text")).alias("n_chars"))
