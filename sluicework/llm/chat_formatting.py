"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered once with that speaker as the
assistant and all others as named users; the character spans the model is to learn are those of the
assistant's own words. System turns stay system turns and are no one's perspective.

A dialogue is cut into parts of ``part_turns`` turns, each with its place in the whole, so that one
very long conversation spreads over many tasks, in the meeting of turns and participants too; parts
joined in order are the whole dialogue.

Defined cases: turns are ordered by turn (nulls first), then role, then text, and repeated rows are
all kept. A null role is the participant ``unknown``; a null text is empty. A null conv_id is a
conversation like any other. A conversation of system turns alone gives no row, an empty table none. A
text is rendered as it is, however long, marks of the format included; with ``escape`` a backslash comes
between the first two characters of such marks in texts and roles, so that no one can end a turn or speak
as another. Further columns of turns, of any name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, running

#: Fixed values of the rendered format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def header(role: Column, perspective: Column, system_roles: tuple[str, ...]) -> Column:
    name = F.when(role.isin(*system_roles), F.lit("system")).when(role == perspective, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def rotate_perspectives(turns: DataFrame, system_roles: tuple[str, ...] = ("system",), part_turns: int = 256, escape: bool = False) -> DataFrame:
    """turns: conv_id, turn, role, text. One row per conv_id, perspective and part (from 0):
    n_turns, start (characters of the dialogue before this part), text, and targets, an array of
    (start, end) character spans within the part's text that carry the loss."""
    said = lambda c: F.regexp_replace(c, r"<(?=\|im_(start|end)\|>)", r"<\\") if escape else c
    key = F.coalesce(F.concat(F.lit("k"), F.col("conv_id").cast("string")), F.lit("")).alias("_key")
    rows = turns.select("conv_id", "turn", said(F.coalesce("role", F.lit("unknown"))).alias("role"), said(F.coalesce("text", F.lit(""))).alias("text"), key)
    people = rows.where(~F.col("role").isin(*system_roles)).groupBy("_key", F.col("role").alias("perspective")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    seen = attach(rows, people, ["_key"], like=turns.select(key)).drop("_key")
    seen = seen.withColumn("_head", header(F.col("role"), F.col("perspective"), system_roles))
    seen = seen.withColumn("_len", (F.length("_head") + F.length("text") + len(CLOSE)).cast("long"))
    placed = running(seen, ["conv_id", "perspective"], ["turn", "role", "text"], {"_at": "_len"}, "_k")
    placed = placed.withColumn("part", F.floor((F.col("_k") - 1) / part_turns).cast("long"))
    piece = F.struct(
        F.col("_k").alias("k"),
        F.col("_at").alias("at"),
        F.concat("_head", "text", F.lit(CLOSE)).alias("rendered"),
        F.when(F.col("role") == F.col("perspective"), F.struct((F.col("_at") + F.length("_head")).alias("start"), (F.col("_at") + F.col("_len") - 1).alias("end"))).alias("span"),
    )
    parts = placed.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(piece)).alias("_all"))
    start = F.get(F.col("_all.at"), 0)
    return parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("_all").cast("long").alias("n_turns"),
        start.alias("start"),
        F.array_join(F.col("_all.rendered"), "").alias("text"),
        F.transform(F.filter(F.col("_all.span"), lambda s: s.isNotNull()), lambda s: F.struct((s["start"] - start).alias("start"), (s["end"] - start).alias("end"))).alias("targets"),
    )


def op9_chat_formatting(spark, sf_dir):
    """Every conversation from every participant's side; targets as ``start-end`` pairs, comma-joined."""
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("targets", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "start", "text", spans.alias("targets"))


# a target ends after the end mark but before its line feed
OP9_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
h AS (
  SELECT t.conv_id, p.perspective, turn, role, text, '<|im_start|>' ||
    CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), k AS (
  SELECT *, row_number() OVER w AS k,
    coalesce(sum(length(head) + length(text) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0
  FROM h WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text)
), q AS (SELECT *, (k - 1) // 256 AS part, min(off0) OVER (PARTITION BY conv_id, perspective, (k - 1) // 256) AS base FROM k)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, CAST(min(base) AS BIGINT) AS start,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text,
  coalesce(string_agg(CAST(CAST(off0 + length(head) - base AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(off0 + length(head) + length(text) + 10 - base AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (WHERE role = perspective), '') AS targets
FROM q GROUP BY conv_id, perspective, part
"""
