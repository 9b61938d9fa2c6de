import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sluicework.llm import packing as P

from .helpers import documents, empty

PATH = P.tokenizer_path()


def test_words_encode_like_whole_texts():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    odd = ["don't we'll  'S", "<|endoftext|> x<|startoftext|>y", "a\u0301b e\u0301", "İSTANBUL ΣΑΣ ΑΣ", "tab\tnl\r\n\x0b\x0c\x1c\x1d x", "\u00a0nb\u2003sp\u3000", "日本語 テスト", "\U0001f600\U0001f1e9\U0001f1ea", "12 345,6", "", " ", "\u0301 alone \u0308", "x\x00y", "\x01 a\x01 \x01b !\x01", "ﬁ ﬀ Å K", "<|ENDOFTEXT|>. A<|endoftext|>!!", "é.. x'S. 'S, a.b, &&&. A\u030a. 5! ..."]
    alphabet = "abAB '\u0301é.,!<|>endoftext 19\n\t\u00a0"
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    enc = P.WordEncoder(PATH)
    data, edges = enc.encode(pa.array([t.encode() for t in odd], pa.binary()))
    got = [data[a:z] for a, z in zip(edges, edges[1:])]
    for t, ids in zip(odd, got):
        assert np.frombuffer(ids, np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_stems_are_merged_once_while_they_come_up_again(monkeypatch):
    monkeypatch.setattr(P, "CACHED_WORDS", 40)
    enc, whole, merged = P.WordEncoder(PATH), Tokenizer.from_file(PATH), []
    merge = enc.merge
    enc.merge = lambda letters: merged.append(letters) or merge(letters)
    for i in range(12):
        texts = [f"Again again, AGAIN. (again) again!? d\u00e9j\u00e0 {i}"] + [f"word{a}x{b} w{chr(97 + i)}{a * 3}" for a, b in ("ab", "cd", "ef")]
        texts += [" ".join(f"{chr(97 + i)}{a}{b}{end}" for a in "abc" for b in "xyz" for end in ("", ".", ";"))]
        data, edges = enc.encode(pa.array([t.encode() for t in texts], pa.binary()))
        for t, a, z in zip(texts, edges, edges[1:]):
            assert np.frombuffer(data[a:z], np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids, t
    assert merged.count("again") == 1
    assert len(merged) == len(set(merged))
    assert len(enc.recent) + len(enc.older) < 120


def test_pack(spark):
    docs = documents(spark)
    whole = Tokenizer.from_file(PATH)
    for capacity in (2048, 64):
        rows = P.pack(docs, PATH, capacity, with_ids=True).collect()
        text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
        full = {d: whole.encode(t or "", add_special_tokens=False).ids + [0] for d, t in text.items()}
        place = {}
        for r in rows:
            if r.doc_id is not None:
                assert r.ids == full[r.doc_id][r.start : r.start + capacity] and r.start == r.piece * capacity
                assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in place.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= capacity
        n = sum(-(-len(full[r.doc_id] if r.doc_id is not None else full[7] if r.text else [0]) // capacity) for r in docs.collect())
        assert len(rows) == n
        least = -(-sum(r.length for r in rows) // capacity)
        assert len(place) <= least + 2
    assert P.pack(empty(spark), PATH).count() == 0


def test_plan_uses_every_piece_once_and_few_sequences():
    rng = random.Random(1)
    for n in (5, 300, 20_000):
        counts = {}
        for _ in range(n):
            length = min(2048, int(rng.lognormvariate(6, 1)) + 1)
            counts[length] = counts.get(length, 0) + 1
        rows = P.plan(counts, 2048)
        used = rows.groupby("length")["times"].sum().to_dict()
        assert used == counts
        ends = (rows["first"] + rows["times"]).groupby(rows["length"]).max().to_dict()
        assert ends == counts
        total = sum(k * v for k, v in counts.items())
        sequences = int((rows["sequence"] + rows["times"]).max())
        assert sequences <= -(-total // 2048) * 1.01 + 1
