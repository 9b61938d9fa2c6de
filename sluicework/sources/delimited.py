"""Delimited text and sheets: delimiter, headers, rows of sheets as labelled texts; bytes as text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..operators.structure import pieces

# Fixed values.
DELIMITERS, HEAD_CHARS, ROW_CHARS = (",", ";", "\t", "|"), 8192, 2000


def decode_lenient(content: Column | str) -> Column:
    """UTF-8 without its mark; bytes that are none become replacement characters."""
    raw = F.col(content) if isinstance(content, str) else content
    marked = F.substring(raw, 1, 3) == F.unhex(F.lit("EFBBBF"))
    return F.make_valid_utf8(F.when(marked, F.substring(raw, F.lit(4), F.length(raw))).otherwise(raw).cast("string"))


def sniff_delimiter(text: Column) -> Column:
    """The delimiter that the first HEAD_CHARS characters have most often, the earlier one in a tie, a comma if none."""
    head = F.substring(text, 1, HEAD_CHARS)
    counted = F.array(*[F.struct((F.length(head) - F.length(F.translate(head, d, ""))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return F.coalesce(F.array_max(counted)["d"], F.lit(DELIMITERS[0]))


def unique_headers(names: list[str | None]) -> list[str]:
    """Trimmed names, ``column`` for blank ones; the second of a name becomes ``name_2`` and so on."""
    out, seen = [], {}
    for name in names:
        base = (name or "").strip() or "column"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return out


def delimited_formats(spark: SparkSession, path: str) -> DataFrame:
    """path, delimiter, head (the first line) of every delimited file; an admitted file fits into a task."""
    text = spark.read.format("binaryFile").load(path).select("path", decode_lenient(F.substring("content", 1, 4 * HEAD_CHARS)).alias("t"))
    return text.select("path", sniff_delimiter(F.col("t")).alias("delimiter"), F.regexp_extract("t", r"^[^\r\n]*", 0).alias("head"))


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """The rows of delimited files; those of one delimiter and header are read together, columns that a file does not
    have are null. Only the list of files, by their formats, comes to the driver."""
    formats = delimited_formats(spark, path).groupBy("delimiter", "head").agg(F.array_sort(F.collect_list("path")).alias("paths")).collect()
    out = None
    for f in sorted(formats, key=lambda r: r.paths[0]):
        options = {"sep": f.delimiter, "multiLine": True}
        names = spark.read.csv(f.paths[0], **options).first()
        rows = spark.read.csv(f.paths, header=True, enforceSchema=True, **options)
        rows = rows.toDF(*unique_headers([(c or "").lstrip("\ufeff") for c in names])) if names else rows
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "column string")


def sheet_rows(cells: DataFrame, keys: list[str], row: str, values: str = "cells") -> DataFrame:
    """keys, row, text of the rows of every sheet, as ``header: value`` joined by `` | ``.

    cells: keys, row, an array of texts. A sheet's first row that is not blank is its header; it and blank rows
    give no text. Cells beyond the header are ``extra_n``; a header's blank cell is ``column{n}``."""
    blank = ~F.exists(values, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    said = cells.where(~blank)
    heads = said.groupBy(*keys).agg(F.min_by(F.struct(F.col(row).alias("at"), F.col(values).alias("names")), row).alias("_head"))
    joined = said.join(heads, keys).where(F.col(row) > F.col("_head.at"))

    def cell(v: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(F.trim(F.get("_head.names", i)), F.lit("")), F.concat(F.lit("column"), (i + 1).cast("string")))
        label = F.when(i < F.size("_head.names"), name).otherwise(F.concat(F.lit("extra_"), (i - F.size("_head.names") + 1).cast("string")))
        return F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(label, F.lit(": "), F.trim(v)))

    return joined.select(*keys, row, F.array_join(F.transform(values, cell), " | ").alias("text"))


def cell_text(value: Column, kind: str) -> Column:
    """A typed cell as text: true or false, whole numbers without a point, texts trimmed, nothing for null."""
    text = value.cast("string")
    if kind in ("float", "double"):
        text = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(text)
    return F.coalesce(F.trim(text), F.lit(""))


def packed_cells(cells: list[tuple[str, str]], most: int = ROW_CHARS) -> list[str]:
    """``label: value`` of every cell, joined by `` | `` into lines of at most ``most`` characters.

    A value that does not fit with its label is cut, at spaces where it can be, and every piece has the label, so
    that nothing is lost and each piece speaks for itself."""
    parts = []
    for label, value in cells:
        room = most - len(label) - 2
        for _, piece in pieces(value, most):
            parts += [f"{label}: {piece[i : i + room]}" for i in range(0, len(piece), room)] if room > 0 else [piece]
    lines: list[str] = []
    for p in parts:
        if lines and len(lines[-1]) + 3 + len(p) <= most:
            lines[-1] += " | " + p
        else:
            lines.append(p)
    return lines


def sheet_elements(cells: DataFrame, keys: list[str], row: str, values: str = "cells") -> DataFrame:
    """keys, row, fragment (from 0), element_type, text: the header of every sheet (``a | b``) and its rows.

    As sheet_rows, with rows of over ROW_CHARS characters in fragments (packed_cells); headers that repeat are
    numbered. Only rows that are too long, and the headers' numbering, pass Python."""
    kinds = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in [*keys, row])
    blank = ~F.exists(values, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    said = cells.where(~blank).select(*keys, row, F.transform(values, lambda x: F.coalesce(F.trim(x), F.lit(""))).alias("_v"))
    first = said.groupBy(*keys).agg(F.min_by(F.struct(F.col(row).alias("at"), F.col("_v").alias("names")), row).alias("_h"))
    heads = first.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_h.at").alias("_at"), _unique("_h.names").alias("_names"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = said.join(heads, on)
    label = lambda i: F.when(i < F.size("_names"), F.get("_names", i)).otherwise(F.concat(F.lit("extra_"), (i - F.size("_names") + 1).cast("string")))
    body = met.where(F.col(row) > F.col("_at")).select(*keys, row, F.filter(F.transform("_v", lambda v, i: F.struct(label(i).alias("n"), v.alias("v"))), lambda x: x["v"] != "").alias("_cells"))
    body = body.withColumn("_text", F.array_join(F.transform("_cells", lambda x: F.concat(x["n"], F.lit(": "), x["v"])), " | "))
    short = F.length("_text") <= ROW_CHARS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = f[[*keys, row]]
            lines = [packed_cells([(c["n"], c["v"]) for c in x]) for x in f["_cells"]]
            out = own.loc[own.index.repeat([len(x) for x in lines])].reset_index(drop=True)
            yield out.assign(fragment=[i for x in lines for i in range(len(x))], text=[t for x in lines for t in x])

    long = body.where(~short).select(*keys, row, "_cells").mapInPandas(run, f"{kinds}, fragment int, text string")
    whole = body.where(short).select(*keys, row, F.lit(0).alias("fragment"), F.col("_text").alias("text"))
    header = met.where(F.col(row) == F.col("_at")).select(*keys, row, F.lit(0).alias("fragment"), F.lit("table_header").alias("element_type"), F.array_join("_names", " | ").alias("text"))
    rows = whole.unionByName(long).select(*keys, row, "fragment", F.lit("spreadsheet_row").alias("element_type"), "text")
    return header.unionByName(rows)


@F.pandas_udf(ArrayType(StringType()))
def _unique(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unique_headers(list(x)))


def sheet_statistics(elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_count (source rows, not fragments), char_count of every sheet."""
    rows = F.count_if((F.col("element_type") == "spreadsheet_row") & (F.col("fragment") == 0))
    return elements.groupBy(*keys).agg(rows.alias("row_count"), F.sum(F.length("text")).cast("long").alias("char_count"))
