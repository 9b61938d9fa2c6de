import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sluicework.llm import token_counts as C

from .helpers import documents, empty, with_clashes

PATH = C.tokenizer_path()


def test_counts_are_the_librarys():
    whole, own = Tokenizer.from_file(PATH), C.Counter(PATH)
    rng = random.Random(4)
    odd = ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext|", "don't we'LL 'S '", "x \x1c\x85   y\n\n  z\t", "日本語 テスト", "\U0001f600\U0001f1e9\U0001f1ea", "՘a ֋1\U0003fc3b", "é ́", "a" * 5000, "ab" * 3000, "aab" * 999, " " * 400 + "x", "\x00\x01퟿\U0010ffff"]
    alphabet = "abAB '́é.,!<|>ndofextsrvl 19\n\t 中՘"
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(90))) for _ in range(3000)]
    odd += ["".join(map(chr, (c for c in (rng.randrange(0x110000) for _ in range(60)) if not 0xD800 <= c < 0xE000))) for _ in range(300)]
    odd.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ") for _ in range(20_000)))  # one pre-token
    want = [len(e.ids) for e in whole.encode_batch(odd, add_special_tokens=False)]
    assert own.count(odd) == want
    assert own.count(odd[::-1]) == want[::-1]


def test_small_blocks_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(C, "KEPT", 50)
    monkeypatch.setattr(C, "MERGE_BYTES", 40)
    whole, own = Tokenizer.from_file(PATH), C.Counter(PATH)
    rng = random.Random(6)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(12))) for _ in range(30)) for _ in range(9)]
        assert own.count(texts) == [len(whole.encode(t).ids) for t in texts]


def test_merging_by_rank_equals_merging_one_by_one():
    rng = random.Random(2)
    symbols = C.byte_symbols()
    vocab, merges, have = {s: i for i, s in enumerate(symbols)}, [], [symbols[b] for b in b"abc"]
    while len(merges) < 40:
        x, y = rng.choice(have), rng.choice(have)
        if x + y not in vocab:
            vocab[x + y] = len(vocab)
            merges.append((x, y))
            have.append(x + y)
    rank = {m: i for i, m in enumerate(merges)}

    def slow(word):
        s = [symbols[b] for b in word]
        while (best := min(((rank.get(p, 99), i) for i, p in enumerate(zip(s, s[1:]))), default=(99, 0)))[0] < 99:
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
        return len(s)

    words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(25))) for _ in range(2000)] + [b"", b"a", b"zz"]
    assert C.RankMerger(vocab, merges).counts(words).tolist() == [slow(w) for w in words]
    assert C.RankMerger(vocab, merges).counts([]).tolist() == []
    with pytest.raises(ValueError):
        C.RankMerger(vocab, merges[::-1])


def test_query(spark, tmp_path):
    whole = Tokenizer.from_file(PATH)
    docs = with_clashes(documents(spark).unionByName(spark.createDataFrame([(99, "word " * 1024, None, None, None, None, None, None), (98, "word " * 1023 + "word", None, None, None, None, None, None), (97, "é<|endoftext|>x " * 300_000, None, None, None, None, None, None)], documents(spark).schema)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = C.op13_token_counts(spark, str(tmp_path)).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "").ids)) for r in docs.collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and {r.over_limit for r in got} == {True, False}
    assert C.token_counts(empty(spark), PATH).collect() == []


def test_bad_bytes_count_as_replacement(spark):
    from pyspark.sql import functions as F

    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.unhex(F.lit("61FF62")).alias("text"))
    assert C.token_counts(docs, PATH).first()[1:] == (3, len(Tokenizer.from_file(PATH).encode("a�b").ids), False)
    assert np.iinfo(np.int32).max == C.NONE
