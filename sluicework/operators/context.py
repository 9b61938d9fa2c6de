"""Context for answers: parents of hits, prompts, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks around an answer's citations.
START, END = "<<<CITATIONS_START>>>", "<<<CITATIONS_END>>>"
CITATIONS = "array<struct<id:int,doc_id:string,page:int,snippet:string>>"


def enrich(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits: query_id, rank, chunk_id. Each hit's child with its parent's text; unknown hits go, missing parents are null."""
    child = chunks.select(F.col("chunk_id").alias("_c"), "doc_id", F.col("text").alias("child_text"), "parent_chunk_id")
    parent = chunks.select(F.col("chunk_id").alias("_p"), F.col("text").alias("parent_text"))
    met = hits.join(child, F.col("chunk_id") == F.col("_c")).drop("_c")
    return met.join(parent, F.col("parent_chunk_id") == F.col("_p"), "left").drop("_p")


def page_of(locations: Column, fallback: int = 1) -> Column:
    """The page of the first location that has one; page 0 counts as none."""
    return F.coalesce(F.get(F.filter(F.transform(locations, lambda x: x["page"]), lambda p: p.isNotNull() & (p != 0)), 0), F.lit(fallback))


def box_of(locations: Column) -> Column:
    """The box of the first location that has one; of its missing sides top and left are 0, width and height 100."""
    sides = {"top": 0.0, "left": 0.0, "width": 100.0, "height": 100.0}
    box = F.get(F.filter(F.transform(locations, lambda x: x["bbox"]), lambda b: b.isNotNull()), 0)
    full = F.struct(*[F.coalesce(box[k].cast("double"), F.lit(v)).alias(k) for k, v in sides.items()])
    return F.when(box.isNotNull(), full)


def citations_of(hits: DataFrame) -> DataFrame:
    """query_id, citations: every hit's child (rank, doc_id, child_text, section_path, page, box) as a citation,
    numbered by rank, its title the last section or ``Document passage``, its snippet 300 characters."""
    title = F.coalesce(F.nullif(F.get("section_path", F.size("section_path") - 1), F.lit("")), F.lit("Document passage"))
    whole = F.struct(*[F.lit(v).alias(k) for k, v in (("top", 0.0), ("left", 0.0), ("width", 100.0), ("height", 100.0))])
    one = F.struct(
        F.col("rank"), F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("page", F.lit(1)).alias("page"), title.alias("chunk_title"),
        F.substring(F.coalesce("child_text", F.lit("")), 1, 300).alias("snippet"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("score"), F.coalesce("box", whole).alias("bounding_box"),
    )
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    fields = ("doc_id", "page", "chunk_title", "snippet", "confidence", "score", "bounding_box")
    return per.select("query_id", F.transform("c", lambda x, i: F.struct((i + 1).alias("id"), *[x[f].alias(f) for f in fields])).alias("citations"))


def cited(parsed: Column, retrieved: Column) -> Column:
    """The parsed citations, or those of the retrieved children where there are none."""
    return F.when(F.size(parsed) > 0, parsed).otherwise(retrieved)


def prompts(enriched: DataFrame, queries: DataFrame, said: DataFrame | None = None, citations: DataFrame | None = None) -> DataFrame:
    """query_id, prompt: up to three conversation hits (said: query_id, rank, role, text), the numbered parent
    texts in rank order, the citation map (citations: as citations_of), and the question; empty sections go."""
    parts = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("parent_text", "child_text").alias("t"))))
    per = enriched.groupBy(F.col("query_id").alias("_q")).agg(F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"])), "\n\n").alias("_context"))
    joined = queries.join(per, F.col("query_id") == F.col("_q"), "left").drop("_q")
    sections = [F.concat(F.lit("Context:\n"), F.col("_context")), F.concat(F.lit("Question: "), F.col("query"))]
    if said is not None:
        lines = F.slice(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- ("), "role", F.lit(") "), "text").alias("t")))), 1, 3)
        talk = said.groupBy(F.col("query_id").alias("_q")).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("_said"))
        joined = joined.join(talk, F.col("query_id") == F.col("_q"), "left").drop("_q")
        sections.insert(0, F.concat(F.lit("Conversation:\n"), F.col("_said")))
    if citations is not None:
        joined = joined.join(citations.select(F.col("query_id").alias("_q"), F.to_json("citations").alias("_map")), F.col("query_id") == F.col("_q"), "left").drop("_q")
        sections.insert(-1, F.concat(F.lit("Citations:\n"), F.col("_map")))
    return joined.select("query_id", F.concat_ws("\n\n", *sections).alias("prompt"))


def parse_citations(answer: Column) -> tuple[Column, Column]:
    """(answer without its citation block, citations); trailing commas are borne, broken JSON gives null."""
    block = rf"(?s){START}(.*?){END}"
    body = F.regexp_replace(F.regexp_extract(answer, block, 1), r",(\s*[}\]])", "$1")
    return F.trim(F.regexp_replace(answer, block, "")), F.from_json(body, CITATIONS)
