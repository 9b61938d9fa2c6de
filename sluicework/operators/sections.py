"""Sections: which strategy chunks a document, block keys and seams of each, folded stubs, chunk records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# MIME types of the formats that have a strategy of their own; any other goes by extension.
MIME = {
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/csv": "csv",
    "application/json": "json",
    "text/plain": "txt",
    "text/markdown": "md",
    "text/html": "html",
    "application/pdf": "pdf",
}
STRATEGIES = ("docx", "pptx", "xlsx", "csv", "json", "txt", "md", "html", "pdf")


def strategy(mime: Column, filename: Column) -> Column:
    """The chunking strategy: by MIME type (what stands before a ``;``), else by extension, else ``section``."""
    kind = F.lower(F.trim(F.regexp_extract(F.coalesce(mime, F.lit("")), r"^([^;]*)", 1)))
    extension = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^./]+)$", 1))
    out = F.when(extension.isin(*STRATEGIES), extension).otherwise("section")
    for m, s in MIME.items():
        out = F.when(kind == m, s).otherwise(out)
    return out


def json_root(path: Column) -> Column:
    """The first key of a path such as ``$.a[0].b`` or ``L3.$[1].b`` (then the index); the path itself for a bare ``$``."""
    rest = F.regexp_replace(path, r"^(L\d+\.)?\$\.?", "")
    return F.coalesce(F.nullif(F.regexp_extract(rest, r"^(\[\d+\]|[^.\[]+)", 1), F.lit("")), path)


def block_key(strategy: Column, section: Column, sheet: Column, slide: Column, json_path: Column) -> Column:
    """What consecutive elements of a block have in common. section: an array of headings."""
    path = F.array_join(section, "\x1f")
    slides = F.when(slide.isNotNull(), F.concat(F.lit("slide "), slide.cast("string"))).otherwise(F.when(F.size(section) > 0, path))
    return F.when(strategy == "csv", F.lit("")).when(strategy == "xlsx", sheet).when(strategy == "pptx", slides).when(strategy == "json", json_root(json_path)).otherwise(path)


def is_seam(strategy: Column, section: Column, element_type: Column) -> Column:
    """Whether a block never merges with its neighbours."""
    headed = F.coalesce(F.size(section) > 0, F.lit(False))
    return F.when(strategy == "json", True).when(strategy == "pdf", F.coalesce(element_type == "table", F.lit(False))).when(strategy.isin("md", "pptx", "txt", "csv", "xlsx"), False).otherwise(headed)


def fold_stubs(blocks: DataFrame, doc: str, order: str, stub: Column, text: str = "text") -> DataFrame:
    """doc, order, text, n_stubs: blocks of headings alone go before the next other block of their document,
    those behind the last one after that; a document of stubs alone is one block."""
    w = Window.partitionBy(doc)
    marked = blocks.select(doc, order, text, F.coalesce(stub, F.lit(False)).alias("_stub"))
    solid = (~F.col("_stub")).cast("int")
    marked = marked.withColumn("_solid", F.sum(solid).over(w)).withColumn("_before", F.coalesce(F.sum(solid).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    at = F.coalesce(F.max(F.when(~F.col("_stub"), F.col(order))), F.min(order))
    folded = marked.groupBy(doc, F.greatest(F.lit(0), F.least("_before", F.col("_solid") - 1)).alias("_group")).agg(at.alias(order), parts.alias("_parts"), F.sum(F.col("_stub").cast("long")).alias("n_stubs"))
    return folded.select(doc, order, F.array_join(F.transform("_parts", lambda x: x["t"]), "\n\n").alias(text), "n_stubs")


def chunk_record(identity: dict[str, Column], block: Column, places: Column) -> Column:
    """A map of a chunk's identity, its block's entries and its summary of places, as texts; missing ones are left out.

    block: a map of strings; places: the struct of ``location_summary``, as JSON."""
    own = F.map_from_arrays(F.array(*[F.lit(k) for k in identity]), F.array(*[v.cast("string") for v in identity.values()]))
    whole = F.map_concat(F.map_filter(own, lambda k, v: v.isNotNull()), F.map_filter(F.coalesce(block, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~k.isin(*identity, "locations")))
    return F.map_concat(whole, F.create_map(F.lit("locations"), F.to_json(places)))
