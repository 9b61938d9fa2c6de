import random
import re

from pyspark.sql import functions as F

from sluicework.llm import quality_rules as Q

from .helpers import documents, empty, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    hit = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_statistics_against_brute_force(spark):
    docs = documents(spark)
    more = ["a b c a b c", "a a a a", "a a a", "x\n x\nx\n\n\nx", "é é é é # | <>\x0b\x0c q", "\n", "one two", "a b c d a b c d\na b c d"]
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(more)], docs.schema))
    for r in Q.statistics(docs, "doc_id", "text").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), repr(r.text)


def test_rules_find_planted_junk(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        t = words(rng, rng.randrange(60, 120), 400)
        kind = i % 10
        rows.append((i, " | ".join(t.split()) if kind == 0 else t.upper() if kind == 1 else t, int(kind > 1)))
    rows += [(900, None, 1), (901, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    rules = Q.learn(Q.statistics(docs, "doc_id", "label"))
    assert 1 <= len(rules) <= 4 and all(str(r).endswith("-> reject") for r in rules)
    out = Q.statistics(docs, "doc_id", "label").select("doc_id", "label", Q.verdict(rules).alias("v")).where("doc_id < 900").collect()
    assert sum((r.v is None) == (r.label == 1) for r in out) > 890


def test_nothing_to_learn(spark):
    docs = documents(spark).withColumn("label", F.lit(1))
    assert Q.learn(Q.statistics(docs, "label")) == []
    none = empty(spark).withColumn("label", F.lit(1))
    assert Q.learn(Q.statistics(none, "label")) == []
    assert Q.statistics(none, "doc_id").select(Q.verdict([])).count() == 0
