"""Search: fusion of the arms, rerank, conversation search, routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vectors import cosine
from ..sources.registry import top_per
from ..sources.scratch import written
from .arms import SMALL_QUERIES, bm25_topk, dense_topk
from .ranges import numbered


# What a hit shows of its chunk beside id and text.
PAYLOAD = ("filename", "section_path", "locations")


def nearest_of_group(rows: DataFrame, group: str, number: str, asks: Column, k: int = 20) -> DataFrame:
    """query_id, id, score (1 / (1 + distance)), rank: for each row that asks, the k of its group nearest by their number,
    itself included; ties go to the smaller number.

    In order of numbers these lie within k places of the row, so rows are numbered by ranges and met by their places:
    at most 2 k + 1 for each that asks, however large its group is."""
    placed = written(numbered(rows.where(F.col(group).isNotNull() & F.col(number).isNotNull()).select(group, number), [group], [number], "_at"))
    places = F.explode(F.sequence(F.col("_at") - k, F.col("_at") + k))
    asked = placed.where(asks).select(group, F.col(number).alias("query_id"), places.alias("_at"))
    near = asked.join(placed, [group, "_at"]).select("query_id", F.col(number).alias("id"), (1.0 / (1 + F.abs(F.col("query_id") - F.col(number)))).alias("score"))
    return top_per(near, ["query_id"], [F.col("score").desc(), "id"], k)


def rrf_fuse(arms: list[tuple[DataFrame, float]], k: float = 60.0) -> DataFrame:
    """query_id, id, score, rank: the sum over arms of weight / (k + rank). Ties go to the smaller id."""
    parts = [a.select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for a, w in arms]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")).cast("long"))


def dbsf_fuse(arms: list[DataFrame]) -> DataFrame:
    """As rrf_fuse, with each arm's scores scaled from mean - 3 sd .. mean + 3 sd to 0..1 per query, and added."""
    both = None
    for i, a in enumerate(arms):
        p = a.select("query_id", "id", "score", F.lit(i).alias("arm"))
        both = p if both is None else both.unionByName(p)
    w = Window.partitionBy("query_id", "arm")
    mean, sd = F.avg("score").over(w), F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0))
    scaled = F.when(sd > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("score") - mean + 3 * sd) / (6 * sd)))).otherwise(0.5)
    fused = both.withColumn("s", scaled).groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")).cast("long"))


def rerank(pairs: DataFrame, scorer: Callable[[Column, Column], Column] | None, k: int = 5) -> DataFrame:
    """pairs: query_id, id, query, text, rank. Best k by scorer(query, text), ties by rank; without a scorer, by rank."""
    scored = pairs.withColumn("rerank_score", scorer(F.col("query"), F.col("text")) if scorer else F.lit(None).cast("double"))
    return top_per(scored.withColumnRenamed("rank", "fused_rank"), ["query_id"], [F.col("rerank_score").desc_nulls_last(), "fused_rank", "id"], k)


def retrieve(queries: DataFrame, index: DataFrame, scorer: Callable[[Column, Column], Column] | None, top_k: int = 5, prefetch: int = 20, fusion: str = "rrf", rerank_required: bool = False) -> DataFrame:
    """The hits of hybrid search: query_id, rank, id, doc_id, text, score (fused), rerank_score, and what the index has
    of the payload (filename, section_path, locations); a null list or name comes back empty, null locations go.

    queries: query_id, user_id, doc_ids (null or empty: all), text, vector; index: id, doc_id, user_id,
    chunk_type, text, vector. A query sees children of its user's documents alone. Both arms bring ``prefetch``
    hits each, which are fused (``dbsf``, or ``rrf`` by any other name) and reranked by scorer; without one the
    fused order stands, or, if reranking is required, an error is raised."""
    if rerank_required and scorer is None:
        raise ValueError("reranking is required and there is no scorer")
    seen = index.where(F.col("chunk_type") == "child").select("id", "doc_id", "user_id", "text", "vector")
    dense, sparse = dense_topk(queries, seen, prefetch, True), bm25_topk(queries, seen, prefetch, scoped=True)
    fused = dbsf_fuse([dense, sparse]) if fusion == "dbsf" else rrf_fuse([(dense, 1.0), (sparse, 1.0)])
    fused = fused.where(F.col("rank") <= max(top_k, prefetch)).select("query_id", "id", "rank", "score")
    if queries.count() <= SMALL_QUERIES:  # else all texts of the index would be dealt by id to meet a few hits
        fused = F.broadcast(fused)
    pairs = fused.join(index.where(F.col("chunk_type") == "child").select("id", "doc_id", "text", *_payload(index)), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    best = rerank(pairs, scorer, top_k)
    return best.select("query_id", "rank", "id", "doc_id", "text", "score", "rerank_score", *[c for c in PAYLOAD if c in index.columns])


def _payload(index: DataFrame) -> list[Column]:
    """The columns of PAYLOAD that the index has, without nulls."""
    out = []
    for f in (index.schema[c] for c in PAYLOAD if c in index.columns):
        if f.dataType.typeName() == "array":
            kept = F.filter(F.col(f.name), lambda x: x.isNotNull()) if f.name == "locations" else F.col(f.name)
            out.append(F.coalesce(kept, F.array().cast(f.dataType)).alias(f.name))
        else:
            out.append(F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name))
    return out


def lexical_scorer(query: Column, text: Column) -> Column:
    """The share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def conversation_window(messages: DataFrame, size: int = 40) -> DataFrame:
    """The last ``size`` non-blank turns of every conversation."""
    said = messages.where(F.trim("text") != "")
    return top_per(said, ["conv_id"], [F.col("turn").desc()], size, "_back").drop("_back")


def search_conversations(queries: DataFrame, messages: DataFrame, k: int = 5, window: int = 40) -> DataFrame:
    """query_id, conv_id, turn, score, rank. queries: query_id, conv_id, vector; messages: conv_id, turn, text, vector."""
    turns = conversation_window(messages, window).select("conv_id", "turn", F.col("vector").alias("_v"))
    scored = queries.join(turns, "conv_id").select("query_id", "conv_id", "turn", cosine(F.col("vector"), F.col("_v")).alias("score"))
    return top_per(scored, ["query_id"], [F.round("score", 9).desc(), "turn"], k)


def search_history(queries: DataFrame, messages: DataFrame, k: int = 5, window: int = 40) -> DataFrame:
    """query_id, conv_id, turn, score, rank: as search_conversations, for queries that are turns themselves.

    queries: query_id, conv_id, turn, vector. Each is compared with the ``window`` non-blank turns before it. Turns
    are numbered by ranges and met by their numbers, at most ``window`` a query, so that a long conversation is
    neither held by one task nor met with itself."""
    found = _history(queries, messages, window).withColumn("score", cosine(F.col("vector"), F.col("_v")))
    return top_per(found.select("query_id", "conv_id", "turn", "score"), ["query_id"], [F.round("score", 9).desc(), "turn"], k)


def _history(queries: DataFrame, messages: DataFrame, window: int) -> DataFrame:
    said = numbered(messages.where(F.trim("text") != "").select("conv_id", "turn", F.col("vector").alias("_v")), ["conv_id"], ["turn"], "_at")
    asked = queries.join(said.select("conv_id", F.col("turn"), "_at"), ["conv_id", "turn"])
    places = F.explode(F.sequence(F.greatest(F.col("_at") - window, F.lit(0)), F.col("_at") - 1))
    before = asked.where("_at > 0").select("query_id", "conv_id", "vector", places.alias("_at"))
    return before.join(said, ["conv_id", "_at"])


def history_statistics(queries: DataFrame, messages: DataFrame, k: int = 5, window: int = 40) -> DataFrame:
    """query_id, best, mean (of the hits of search_history; 0 without any), n_hits, num_searched (turns compared: those
    with a vector), num_turns (turns in the window)."""
    turns = _history(queries, messages, window)
    seen = turns.groupBy("query_id").agg(F.count_if(F.size("_v") > 0).alias("num_searched"), F.count(F.lit(1)).alias("num_turns"))
    hits = search_history(queries, messages.where(F.size("vector") > 0), k, window) if k > 0 else None
    out = queries.select("query_id").join(seen, "query_id", "left")
    if hits is not None:
        out = out.join(hits.groupBy("query_id").agg(F.max("score").alias("best"), F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n_hits")), "query_id", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select("query_id", zero("best", "double"), zero("mean", "double"), zero("n_hits", "long"), zero("num_searched", "long"), zero("num_turns", "long"))


# Why a query goes where it does.
REASONS = {
    None: "no usable conversation history; falling back to document retrieval",
    "conversation_only": "conversation is highly sufficient (dependency=%.3f); skipping document retrieval",
    "hybrid": "conversation is moderately sufficient (dependency=%.3f); fusing conversation context with document retrieval",
    "documents_only": "conversation is not sufficient (dependency=%.3f); retrieving from documents only",
}


def route(hits: DataFrame, queries: DataFrame, min_hits: int = 2, strong: float = 0.6) -> DataFrame:
    """query_id, dependency, route, reason. hits: query_id, score; queries: query_id, refers_conversation, refers_document."""
    per = hits.groupBy(F.col("query_id").alias("_q")).agg(F.max("score").alias("best"), F.sum((F.col("score") >= strong).cast("int")).alias("n_strong"))
    q = queries.join(per, F.col("query_id") == F.col("_q"), "left")
    raw = 0.5 * F.col("best") + 0.3 * F.least(F.col("n_strong") / F.lit(max(min_hits, 1)), F.lit(1.0))
    raw = raw + F.when(F.col("refers_conversation"), 0.15).otherwise(0.0) - F.when(F.col("refers_document"), 0.15).otherwise(0.0)
    dependency = F.when(F.col("best").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    r6 = F.round(dependency, 9)
    path = F.when(r6 >= 0.8, "conversation_only").when(r6 >= 0.55, "hybrid").otherwise("documents_only")
    reason = F.when(F.col("best").isNull(), REASONS[None])
    for name, said in REASONS.items():
        if name:
            reason = reason.when(path == name, F.format_string(said, dependency))
    return q.select("query_id", dependency.alias("dependency"), path.alias("route"), reason.alias("reason"))


def payload_filter(chunks: DataFrame, **wanted) -> DataFrame:
    """Chunks whose columns match: a value by equality, a list by any of its values; a column that holds
    a list matches if any of its elements does. An empty list asks for nothing."""
    for name, value in wanted.items():
        values = [F.lit(v) for v in value] if isinstance(value, (list, tuple, set)) else [F.lit(value)]
        if values:
            many = chunks.schema[name].dataType.typeName() == "array"
            chunks = chunks.where(F.arrays_overlap(F.col(name), F.array(*values)) if many else F.col(name).isin(*values))
    return chunks


def text_filter(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, id: the docs (id, text) that have every token of a query's text (query_id, text), by way of the postings.

    Only the postings of each query's rarest token are read; what they hold is then asked for all tokens. A text
    without a token asks for nothing, so every document has all of it; a null text is no query."""
    q = queries.where("text is not null").select("query_id", F.array_distinct(tokens(F.col("text"))).alias("w"))
    terms = q.select("query_id", F.explode("w").alias("term"))
    words = docs.select("id", F.coalesce(F.array_distinct(tokens(F.col("text"))), F.array()).alias("has"))
    postings = words.select("id", F.explode("has").alias("term"))
    held = postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    rarest = terms.join(held, "term").groupBy("query_id").agg(F.min(F.struct("c", "term")).alias("r")).select("query_id", "r.term")
    maybe = postings.join(rarest, "term").select("query_id", "id").distinct()
    met = maybe.join(q, "query_id").join(words, "id").where(F.size(F.array_except("w", "has")) == 0).select("query_id", "id")
    return met.unionByName(q.where(F.size("w") == 0).select("query_id").crossJoin(docs.select("id")))


# Other names of roles.
ROLES = {"human": "user", "ai": "assistant"}


def normalize_messages(messages: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    """role and content as texts: aliases of roles resolved, content blocks (an array of texts) joined by spaces."""
    said = F.lower(F.trim(F.coalesce(F.col(role), F.lit(""))))
    for alias, name in ROLES.items():
        said = F.when(said == alias, name).otherwise(said)
    blocks = messages.schema[content].dataType.typeName() == "array"
    text = F.array_join(F.col(content), " ") if blocks else F.coalesce(F.col(content), F.lit(""))
    return messages.withColumns({role: said, content: text})


def documents_asked(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """The queries that search documents: all but those routed to their conversation alone."""
    gone = routes.where(F.col("route") == "conversation_only").select("query_id")
    return queries.join(gone, "query_id", "left_anti")


def fuse_sources(said: DataFrame, found: DataFrame, routes: DataFrame, k: float = 60.0, boost: float = 1.0, most_said: int = 2) -> DataFrame:
    """query_id, item_id, source, payload, rrf, rank of what a query has found in its conversation and in documents.

    said and found: query_id, rank, item_id (null in said: ``conv-`` and its place from 0), payload. On the route
    hybrid the first ``most_said`` of said are fused with found by reciprocal ranks, said weighted by ``boost``;
    an item of both adds up and keeps source and payload of its first place, said before found. On other routes
    documents pass as they are with a null rrf."""
    hybrid = routes.where(F.col("route") == "hybrid").select("query_id")
    talk = top_per(said, ["query_id"], ["rank"], most_said, "place").join(hybrid, "query_id", "left_semi")
    name = F.coalesce(F.col("item_id").cast("string"), F.concat(F.lit("conv-"), (F.col("place") - 1).cast("string")))
    talk = talk.select("query_id", name.alias("item_id"), F.lit("conversation").alias("source"), "payload", F.col("place").alias("r"), F.lit(0).alias("arm"), (F.lit(boost) / (k + F.col("place"))).alias("s"))
    docs = found.select("query_id", F.col("item_id").cast("string").alias("item_id"), F.lit("document").alias("source"), "payload", F.col("rank").alias("r"), F.lit(1).alias("arm"), (F.lit(1.0) / (k + F.col("rank"))).alias("s"))
    both = talk.unionByName(docs.join(hybrid, "query_id", "left_semi")).groupBy("query_id", "item_id").agg(F.min_by(F.struct("source", "payload", "arm", "r"), F.struct("arm", "r")).alias("x"), F.sum("s").alias("rrf"))
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 12).desc(), "x.arm", "x.r", "item_id")
    fused = both.select("query_id", "item_id", "x.source", "x.payload", "rrf", F.row_number().over(order).cast("long").alias("rank"))
    plain = docs.join(hybrid, "query_id", "left_anti").select("query_id", "item_id", "source", "payload", F.lit(None).cast("double").alias("rrf"), F.col("r").cast("long").alias("rank"))
    return fused.unionByName(plain)


def citation_candidates(fused: DataFrame) -> DataFrame:
    """What goes on to reranking: documents alone."""
    return fused.where(F.col("source") == "document")
