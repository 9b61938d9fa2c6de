import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sluicework.llm import suffix_dedup as S

from .helpers import documents, empty, words


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
        rest = bytes(b for b, g in zip(d, gone) if not g)
        yield len(d), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + gone)), hashlib.sha256(rest).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = documents(spark, seed)
    long = words(rng, 400, 100_000)
    more = [long, long[:700] + "é" + long[701:], long[300:499] + "q", long[300:500] + "q", "zz" + long[900:1160] + long[40:300], "ab" * 300, "x" * 201, "y" * 200, "y" * 199, long[5:60] * 9, long[:200], long[-200:]]
    for _ in range(25):
        t = ""
        for _ in range(rng.randrange(1, 6)):
            a = rng.randrange(len(long) - 300)
            t += long[a : a + rng.randrange(150, 300)] if rng.random() < 0.7 else words(rng, 20, 100_000)
        more.append(t)
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, None, None, None, None, None, None) for i, t in enumerate(more)], docs.schema))
    got = sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in S.remove_repeats(docs).collect())
    rows = docs.collect()
    want = sorted(repr((r.doc_id, *w)) for r, w in zip(rows, brute([r.text for r in rows])))
    assert got == want


def test_empty(spark):
    assert S.remove_repeats(empty(spark)).count() == 0


def test_contexts_that_agree_in_32_bits_of_their_hash_are_told_apart(spark):
    def text(seed):
        t = bytes(np.random.default_rng(seed).integers(97, 123, 220).astype(np.uint8)).decode()
        return t[:110] + "m" * 150 + t[110:]

    docs = spark.createDataFrame([(1, text(810)), (2, text(887))], "doc_id long, text string")  # found by trying
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs).collect())
    assert got == sorted(brute([text(810), text(887)])) and all(r[1] == 0 for r in got)


def test_long_texts_of_equal_bytes_and_of_short_periods(spark):
    texts = {1: "a" * 300_000, 2: "xyz" * 100_000, 3: "b" * 200, 4: "c" * 201, 5: "pqr" * 67 + "p", 6: "stu" * 67 + "st"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(docs).collect()}
    whole = {i: (len(x), len(x), 1) for i, x in texts.items() if i in (1, 2, 4, 6)}
    # 202 bytes of period 3 hold three strings, none twice; 203 hold the first of them again
    assert got == {**whole, 3: (200, 0, 0), 5: (202, 0, 0)}


def test_intervals_of_one_text_are_united():
    rid, start, end = (np.array(x) for x in ([7, 3, 7, 7, 3], [50, 0, 0, 10, 5], [60, 4, 30, 20, 9]))
    got = S._united(rid, start, end)
    assert list(zip(*(x.tolist() for x in got))) == [(3, 0, 4), (3, 5, 9), (7, 0, 30), (7, 50, 60)]
    assert [len(x) for x in S._united(*(np.empty(0, np.int64),) * 3)] == [0, 0, 0]
