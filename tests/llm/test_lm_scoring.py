import math
import zlib
from collections import Counter

import pytest

from sluicework.llm import lm_scoring as L

from .helpers import ascii_lower, documents, empty


class Tree:
    """Context-tree weighting written out plainly, one decision at a time."""

    def __init__(self, depth):
        self.depth, self.counts, self.children = depth, {}, {}

    def add(self, context, node, bit):
        for d in range(self.depth + 1):
            k = (context[len(context) - d :], node)
            self.counts.setdefault(k, [0, 0])[bit] += 1
            if d:
                self.children.setdefault((k[0][1:], node), set()).add(k)

    @staticmethod
    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    def below(self, k):
        return sum(self.weighted(c) for c in self.children.get(k, ()))

    def weighted(self, k):
        kt = self.kt(self.counts.get(k, [0, 0]))
        if len(k[0]) == self.depth:
            return kt
        a, b = kt, self.below(k)
        return max(a, b) + math.log1p(math.exp(-abs(a - b))) - math.log(2)

    def probability(self, context, node, bit, d=0):
        k = (context[len(context) - d :], node)
        n = self.counts.get(k, [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == self.depth:
            return own
        w = 1 / (1 + math.exp(min(700, self.below(k) - self.kt(n))))
        return w * own + (1 - w) * self.probability(context, node, bit, d + 1)


def decisions(text):
    data = b"\xff" * L.DEPTH + text + b"\xff"
    for i in range(L.DEPTH, len(data)):
        for t in range(8):
            yield data[i - L.DEPTH : i], (1 << t) | (data[i] >> (8 - t)), data[i] >> (7 - t) & 1


@pytest.mark.parametrize("small", [False, True])
def test_against_plain_trees_and_counts(spark, monkeypatch, small):
    if small:
        for name, v in (("BLOCK_BYTES", 900), ("SEGMENT_BYTES", 64), ("PACK_BYTES", 300), ("CHUNK_BYTES", 200)):
            monkeypatch.setattr(L, name, v)
    docs = documents(spark).where("n_chars is null or n_chars < 700").limit(24)
    rows = docs.collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    texts = [(r.doc_id, ascii_lower(r.text or "").encode()) for r in rows]
    tree, counts = Tree(L.DEPTH), Counter()
    for d, t in texts:
        if not held(d):
            counts.update([*t.split(), None])
            for x in decisions(t):
                tree.add(*x)
    n, v = sum(counts.values()), len(counts)
    memo = {}
    tree.weighted, plain = lambda k: memo[k] if k in memo else memo.setdefault(k, plain(k)), tree.weighted
    want = []
    for d, t in texts:
        toks = [*t.split(), None]
        s = sum(math.log10(tree.probability(*x)) for x in decisions(t))
        want.append((d, not held(d), len(toks), sum(counts[k] > 0 for k in toks), n, sum(math.log10((counts[k] + 1) / (n + v + 1)) for k in toks), s))
    got = L.score_texts(docs, ~L.held_out(docs.doc_id)).collect()
    assert any(not w[1] for w in want) and len(got) == len(want)
    order = lambda x: (repr(x[0]), round(x[6], 6))
    for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order)):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-7)


def test_empty(spark):
    none = empty(spark)
    assert L.score_texts(none, ~L.held_out(none.doc_id)).count() == 0


def test_a_row_in_many_copies_spreads_over_the_blocks(spark, monkeypatch):
    for name, v in (("BLOCK_BYTES", 4000), ("PACK_BYTES", 500)):
        monkeypatch.setattr(L, name, v)
    rows = [(7, "the same words again and again")] * 400 + [(8, "others"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.score_texts(docs, ~L.held_out(docs.doc_id)).collect()
    assert len(got) == 402 and len({r.score for r in got if r.doc_id == 7}) == 1
    dealt = docs.selectExpr("cast(1 as bigint)", "cast(doc_id as string)", "true", "cast(text as binary)").mapInArrow(L._deal(10), "block int, data binary")
    sizes = {}
    for r in dealt.collect():
        sizes[r.block] = sizes.get(r.block, 0) + len(L._opened({"data": [r.data]}))
    assert sum(sizes.values()) == 402
