"""URL filters: allow and block rules looked up by hashed host-suffix and path-prefix expressions.

Every URL is expanded into (host suffix, path prefix) expressions; their short hash prefixes are
equi-joined with those of the rules, full digests confirm a hit, and the longest fitting rule wins.
Only the suffix and prefix lengths that some rule has are expanded, so no rule is missed and a host
of many labels costs no more than the rules ask for.

Defined cases: a null url, or one without ``://``, has empty host and path and can only meet a rule
of empty host. Of rules with the same text, block wins. Rules with a null host, path or action are
ignored. Repeated rows are judged each on their own. Further columns of ``pages`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules are broadcast up to this number of rows (of some 100 bytes); beyond it both sides are shuffled.
BROADCAST_RULES = 50_000
#: A frequent expression is spread over this many tasks when both sides are shuffled.
SALTS = 16
#: Hex digits of the short hash prefix.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: what follows, up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    pattern = r"^([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(rest, pattern, 1)), F.regexp_extract(rest, pattern, 2)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", keys: list[str] | None = None) -> DataFrame:
    """The ``keys`` columns of each row of ``pages`` (default page_id) with host, path, rule and verdict.

    rules: columns host, path, action ("allow" or "block"). A rule fits its host and all subdomains
    where the path starts with the rule's. default: the verdict where none fits.
    """
    keys = keys or ["page_id"]
    rules = rules.where("host is not null and path is not null and action is not null").select(
        F.concat("host", "path").alias("_rule"),
        F.col("action").alias("_action"),
        F.size(F.split("host", r"\.")).alias("_labels"),
        F.length("path").alias("_plen"),
        F.sha2(F.concat("host", "path"), 256).alias("_full"),
    )
    # two short lists: a host has at most 127 labels, a path as many lengths as rules use
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set("_labels").alias("labels"), F.collect_set("_plen").alias("plens")).first()
    small = shape["n"] <= BROADCAST_RULES
    rules = rules.withColumn("_short", F.substring("_full", 1, SHORT)).drop("_labels", "_plen")

    host, path = host_and_path(F.col("url"))
    rows = pages.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], host.alias("_host"), path.alias("_path"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(int(x)) for x in sorted(shape["labels"])]).cast("array<int>"), lambda k: k <= F.size(labels)),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(int(x)) for x in sorted(shape["plens"])]).cast("array<int>"), lambda k: k <= F.length("_path")),
        lambda k: F.substr(F.col("_path"), F.lit(1), k),
    )
    expressions = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))
    rows = rows.withColumn("_expr", F.explode_outer(expressions)).withColumn("_digest", F.sha2("_expr", 256)).drop("_expr")
    rows = rows.withColumn("_s", F.substring("_digest", 1, SHORT))
    # the join knows short prefixes alone; what it lets through is confirmed by the full digest
    if small:
        met = rows.join(F.broadcast(rules), F.col("_s") == F.col("_short"), "left")
    else:
        rows = rows.withColumn("_salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
        rules = rules.withColumn("_rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.join(rules, (F.col("_s") == F.col("_short")) & (F.col("_salt") == F.col("_rsalt")), "left")
    hit = F.when(F.col("_digest") == F.col("_full"), F.struct(F.length("_rule").alias("n"), F.col("_rule").alias("rule"), F.col("_action").alias("action")))
    group = ["_row", *[f"k_{i}" for i in range(len(keys))], "_host", "_path"]
    best = met.groupBy(*group).agg(F.max(hit).alias("_hit"))
    return best.select(
        *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_hit.rule").alias("rule"),
        F.coalesce(F.col("_hit.action"), F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, action string"))


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM p
), r(h, pre, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT s.page_id, s.host, s.path, r.h || r.pre AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.h || r.pre) DESC NULLS LAST) AS k
  FROM s LEFT JOIN r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.pre)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
