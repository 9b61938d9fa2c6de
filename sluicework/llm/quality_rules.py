"""Quality rules: a decision list learned by sequential covering.

Every text gets a row of statistics, by Spark expressions alone. On the labelled rows, rules that
find label 0 are grown one threshold at a time (by information gain), pruned on rows set aside, and
taken in turn while they hold up there; rows that a rule covers leave before the next is grown. The
counts behind each choice are one aggregation over binned statistics: no labelled row leaves Spark.
The list is applied as one ordered conditional expression.

Defined cases: a null text is empty. Statistics over no words are 0. Labels other than 0 and 1 are
ignored; without both labels, or with fewer rows than a rule must cover, no rule is learned and all
is kept. Repeated rows are judged each. Three-word windows are compared by 64-bit hashes within one
text.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Cut points of a statistic.
BINS = 32


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def _chars(text: Column, of: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, of, ""))).cast("long")


def _repeated(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more."""

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (F.get(s, i + 1)["g"] == x["g"]) | (F.get(s, i - 1)["g"] == x["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def grams(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))

    return let(words, lambda w: F.when(F.size(w) > 3, let(F.sort_array(grams(w)), covered)).otherwise(0)).cast("long")


def statistics(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and, of every whole text, the counts that the rules are made from."""
    base = docs.select(*keys, F.coalesce("text", F.lit("")).alias("_text"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    real = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = base.select(*keys, "_text", words_of(F.col("_text")).alias("_words"))
    return out.select(
        *keys,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        _chars(F.col("_text"), SYMBOLS).alias("n_symbols"),
        let(real, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("_words")).alias("n_repeat_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        F.size(real).cast("long").alias("n_lines"),
        _chars(F.col("_text"), upper).alias("n_upper"),
        _chars(F.col("_text"), "0123456789").alias("n_digits"),
        _chars(F.col("_text"), "!?").alias("n_marks"),
        _chars(F.col("_text"), ".,;:").alias("n_stops"),
    )


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)).cast("double")


def measures() -> dict[str, Column]:
    """The named measures that thresholds are put on, over the columns of ``statistics``."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeat_share": _ratio("n_repeat_words", "n_words"),
        "distinct_share": _ratio("n_distinct_words", "n_words"),
        "words_per_line": _ratio("n_words", "n_lines"),
        "upper_share": _ratio("n_upper", "word_chars"),
        "digit_share": _ratio("n_digits", "word_chars"),
        "marks_per_word": _ratio("n_marks", "n_words"),
        "stops_per_word": _ratio("n_stops", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.measure] > self.threshold if self.above else of[self.measure] <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects where all its conditions hold."""

    conditions: tuple[Condition, ...]

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions)) + " -> reject"


def learn(stats: DataFrame, label: str = "label", max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_share: float = 0.002) -> list[Rule]:
    """stats: the columns of ``statistics`` and a label, 0 for rows to be rejected. The rules in order."""
    of = measures()
    names = list(of)
    rows = stats.where(F.col(label).isin(0, 1))
    rows = rows.select(*[of[n].alias(n) for n in names], (F.col(label) == 0).cast("int").alias("_bad"), (F.pmod(F.xxhash64(*[of[n] for n in names]), F.lit(3)) == 0).alias("_prune"))
    rows = cut(rows)
    steps = F.array(*[F.lit((i + 1) / (BINS + 1)) for i in range(BINS)])
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"), *[F.percentile_approx(n, steps, 10_000).alias(n) for n in names]).first()
    if not first["n"] or not 0 < first["bad"] < first["n"]:
        return []
    cuts = {n: sorted(set(first[n])) for n in names}
    least = max(5, int(min_share * first["n"]))
    here = {n: F.col(n) for n in names}

    def tally(live: DataFrame) -> dict[tuple[str, int], list[int]]:
        """For each measure and bin (values up to cut i, beyond cut i-1): good and bad rows to grow on."""
        bins = [F.struct(F.lit(n).alias("m"), sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias("b")) for n in names]
        got = live.where(~F.col("_prune")).select("_bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.m", "x.b").agg(F.sum("_bad").alias("p"), F.count(F.lit(1)).alias("c")).collect()
        out = {(n, i): [0, 0] for n in names for i in range(len(cuts[n]) + 1)}
        for r in got:
            out[r["m"], r["b"]] = [r["c"] - r["p"], r["p"]]
        return out

    def best(live: DataFrame) -> tuple[Condition | None, int, int]:
        counts = tally(live)
        some = names[0]
        n0, p0 = (sum(counts[some, i][k] for i in range(len(cuts[some]) + 1)) for k in (0, 1))
        top, found = 1e-9, (None, n0, p0)
        if not p0 or not n0:
            return found
        for m in names:
            low_n = low_p = 0
            for i, c in enumerate(cuts[m]):
                low_n, low_p = low_n + counts[m, i][0], low_p + counts[m, i][1]
                for above, n, p in ((False, low_n, low_p), (True, n0 - low_n, p0 - low_p)):
                    if p >= least and (gain := p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))) > top:
                        top, found = gain, (Condition(m, above, c), n, p)
        return found

    rules: list[Rule] = []
    live = rows
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        inside = live
        while len(conditions) < max_conditions:
            c, n, _ = best(inside)
            if c is None:
                break
            conditions.append(c)
            inside = inside.where(c.column(here))
            if not n:
                break
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[: k + 1])) for k in range(len(conditions))]
        held = live.where("_prune").agg(*[F.coalesce(F.sum(F.when(r.column(here), v)), F.lit(0)).alias(f"{w}{k}") for k, r in enumerate(prefixes) for w, v in (("p", F.col("_bad")), ("n", 1 - F.col("_bad")))]).first()
        worth = [((held[f"p{k}"] - held[f"n{k}"]) / max(1, held[f"p{k}"] + held[f"n{k}"]), -k) for k in range(len(prefixes))]
        k = -max(worth)[1]
        p, n = held[f"p{k}"], held[f"n{k}"]
        if p < max(1, least // 4) or p < min_precision * (p + n):
            break
        rules.append(prefixes[k])
        live = live.where(~prefixes[k].column(here))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects (from 1), or null: one ordered conditional over ``statistics``."""
    of = measures()
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(of), F.lit(i)).otherwise(out)
    return out


def op5_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = cut(statistics(docs, "doc_id"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    rules = learn(stats.join(labels, F.col("doc_id") == F.col("_id")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules).isNull()).alias("kept"))
