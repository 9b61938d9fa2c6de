"""Small tables with the awkward cases that every operator must bear."""

import random
import re

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, item string, _n_words int"
#: Names that the operators use, or used, inside.
CLASHES = ["_key", "_h", "_d", "_runs", "_left", "_removed", "_text_hash", "_spans", "_score", "row", "key", "left", "runs", "id", "bits", "hashes", "root", "first", "token", "n", "c", "m", "h", "d", "rid", "_task", "_id", "_y", "block", "part", "label", "score", "d2", "_n", "k_0"]


def with_clashes(docs):
    """docs with a string column of every such name, each with its own value in every row."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASHES])


def clashes_kept(rows):
    return all(r[c] == f"{c}:{'?' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASHES)


def words(rng, n, size=40):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def documents(spark, seed=1):
    """Nulls, empty texts, repeated rows, copies, near copies and columns whose names clash with inner ones."""
    rng = random.Random(seed)
    texts = [None, "", "   \n ", "a", "A b", "é ü ß", "x" * 3000]
    base = "\n".join(words(rng, 30, 4000) for _ in range(4))
    texts += [base, base, base.replace("w1", "W1"), base + " tail of words", "head of words " + base, "\n".join(words(rng, 20, 4000) for _ in range(3))]
    texts += ["\n".join(words(rng, rng.randrange(1, 40), 60) for _ in range(rng.randrange(1, 6))) for _ in range(25)]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t), i, "x", 7) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None, None, None, None), rows[8], (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def ascii_lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)
