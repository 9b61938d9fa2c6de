"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own node in the tree of its byte (binary
decomposition); every node has a context tree over the bytes before it, up to ``DEPTH`` of them. At
each context a Krichevsky-Trofimov estimate is mixed, half and half, with the product of the longer
contexts. The trees are learned from the training texts and then held fixed, so that a text's
probability is a product over its bytes of one number for each (context, byte).

The work is dealt out in blocks of text, written once. A block asks for the numbers of its distinct
(context, byte) strings and words; requests go to buckets by the hash of the whole string, so that none
is larger than others; there the counts of all blocks are added up, once for each distinct string. The
trees are built from those sums, dealt out by their two nearest context bytes: what grows with the corpus
is the number of distinct strings alone. The trees' numbers go back to the buckets, which answer the
blocks, and a block scores its texts with the answers. Only the nodes of the two shortest contexts, at
most 256 x 255 of them, pass the driver. Requests, answers and blocks grow with the input; no table is
held whole.

Texts are lower-cased (A-Z) UTF-8. A text starts in a context of 0xFF bytes and ends with one, so the
numbers are probabilities over whole texts; 0xFF is in no UTF-8 text.

Defined cases: a null text is empty and costs its end alone. Null doc_ids are not held out. Repeated
rows are scored each, and spread over the blocks like others. Very long texts are scored in segments cut
at white space, each knowing the bytes before it, with the same result. Without training text every
decision has probability 1/2. An empty table gives an empty one; extra columns are not read. Numbers
travel in steps of 2^-26 in the base-10 logarithm.
"""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Context bytes, 2 to 7.
DEPTH = 5
#: Text bytes of a block, of a segment, of what is dealt together, and of what is sorted at once.
BLOCK_BYTES, SEGMENT_BYTES, PACK_BYTES, CHUNK_BYTES = 20 << 20, 4 << 20, 1 << 20, 2 << 20
#: Steps of a number in one unit of its logarithm.
STEPS = 1 << 26
END = b"\xff"
_LN10 = np.log(10.0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _segments(text: bytes, most: int) -> Iterator[tuple[bytes, bytes]]:
    """(bytes before, segment); cut after white space, so that no word is split."""
    at = 0
    while True:
        z = len(text)
        if z - at > most:
            found = max(text.rfind(c, at, at + most) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if found < 0:
                after = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, at + most)) >= 0]
                found = min(after, default=z - 1)
            z = found + 1
        yield (END * DEPTH + text[max(0, at - DEPTH) : at])[-DEPTH:], text[at:z]
        if z >= len(text):
            return
        at = z


_PACK = pa.schema([("rid", pa.int64()), ("doc_id", pa.string()), ("train", pa.bool_()), ("last", pa.bool_()), ("before", pa.binary()), ("text", pa.binary())])


def _deal(blocks: int):
    """Segments in packs, each with the block it belongs to."""

    def packed(rows: list[tuple]) -> bytes:
        out = io.BytesIO()
        with pa.ipc.new_stream(out, _PACK, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACK)], schema=_PACK))
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, first = [], 0, 0
        for b in batches:
            packs = []
            for rid, doc_id, train, text in zip(*(c.to_pylist() for c in b.columns)):
                pieces = list(_segments((text or b"").lower(), SEGMENT_BYTES))
                for i, (before, piece) in enumerate(pieces):
                    last = i == len(pieces) - 1
                    if not rows:
                        first = zlib.crc32(f"{rid}|{i}".encode()) % blocks
                    rows.append((rid, doc_id, train, last, before, piece + END if last else piece))
                    held += len(piece) + 64
                    if held >= PACK_BYTES:
                        packs.append((first, packed(rows)))
                        rows, held = [], 0
            if packs:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*packs), (pa.int32(), pa.binary()))], names=["block", "data"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([packed(rows)], pa.binary())], names=["block", "data"])

    return run


def _opened(f: pd.DataFrame) -> pd.DataFrame:
    """The segments of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in f["data"]]).to_pandas()


def _press(a: np.ndarray, ordered: bool = False) -> bytes:
    """Numbers as bytes, place by place; of ordered ones, their differences."""
    a = np.diff(a, prepend=a.dtype.type(0)) if ordered else a
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpress(b: bytes, kind, ordered: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    a = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(a, dtype=kind) if ordered else a


def _keys(before: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every byte as one number, the byte lowest, and where each text's begin."""
    b = np.frombuffer(b"".join(x for pair in zip(before, texts) for x in pair), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    key = np.zeros(max(0, len(b) - DEPTH), np.uint64)
    for j in range(DEPTH + 1):
        key |= b[j : len(b) - DEPTH + j] << np.uint64(8 * (DEPTH - j))
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    keep = np.ones(len(b), bool)
    for s in starts.tolist():  # windows that start in a text's last bytes reach into the next one
        keep[max(0, s - DEPTH) : s] = False
    return key[keep[: len(key)]], np.cumsum(sizes) - sizes


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    block = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    yield from ((a, z) for a, z in zip(edges, edges[1:]) if z > a)


def _sizes(f: pd.DataFrame) -> np.ndarray:
    return np.fromiter(map(len, f["text"]), np.int64, len(f))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _grams(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct (context, byte) strings and their counts in training texts."""
    parts = []
    for train in (True, False):
        own = f[f["train"] == train]
        for a, z in _chunks(_sizes(own)):
            some = own.iloc[a:z]
            key = np.sort(_keys(some["before"].tolist(), some["text"].tolist())[0])
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            n = np.diff(np.r_[first, len(key)])
            parts.append((key[first], n if train else np.zeros(len(n), np.int64)))
            if len(parts) > 8:
                parts = [_merge(parts)]
    return _merge(parts)


def _split(text: bytes) -> list[bytes]:
    return (text[:-1] if text.endswith(END) else text).split()


def _words(f: pd.DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The block's distinct words in order, and their counts in training texts."""
    counts: Counter[bytes] = Counter()
    others: set[bytes] = set()
    for train, text in zip(f["train"], f["text"]):
        counts.update(_split(text)) if train else others.update(_split(text))
    words = sorted(others.union(counts))
    return words, np.fromiter((counts.get(w, 0) for w in words), np.int64, len(words))


def _gram_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _tree_parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """By the two nearest context bytes, under which a part has whole trees."""
    near = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return ((near * np.uint64(0x9E3779B1)) % np.uint64(1 << 32) % np.uint64(parts)).astype(np.int64)


def _split_by(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of to with the places that have it, in order."""
    by = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(to[by]) > 0]) if len(by) else []
    for a, z in zip(first, [*first[1:], len(by)]):
        yield int(to[by[a]]), by[a:z]


def _word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def _ask(buckets: int):
    """A row for each block, kind and bucket: what the block asks for there, and its training counts."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        block, f = int(f["block"].iloc[0]), _opened(f)
        keys, counts = _grams(f)
        rows = [("gram", i, _press(keys[at], True), _press(counts[at])) for i, at in _split_by(_gram_buckets(keys, buckets))]
        words, counts = _words(f)
        rows += [("word", i, b" ".join([words[k] for k in at.tolist()]), _press(counts[at])) for i, at in _split_by(_word_buckets(words, buckets))]
        rows.append(("text", 0, b"", _press(np.array([int((f["train"] & f["last"]).sum())]))))
        out = pd.DataFrame(rows, columns=["kind", "bucket", "keys", "counts"])
        return out.assign(block=block)[["block", "kind", "bucket", "keys", "counts"]]

    return run


def _pairs(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of some rows and their counts, added up."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for k, c in zip(f["keys"], f["counts"]):
        parts.append((_unpress(k, np.uint64, True), _unpress(c, np.int64)))
        if sum(len(p[0]) for p in parts) > 4_000_000 and len(parts) > 8:
            parts = [_merge(parts)]
    return _merge(parts)


def _sum_up(parts: int):
    """Of a bucket's requests: each distinct string once, dealt to the part that has its tree."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _pairs(f)
        rows = [(i, int(f["bucket"].iloc[0]), _press(keys[at], True), _press(counts[at])) for i, at in _split_by(_tree_parts(keys, parts))]
        return pd.DataFrame(rows, columns=["part", "bucket", "keys", "counts"])

    return run


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to n0 zeros and n1 ones in any order."""
    half = _log_gamma_half
    return half(n0) + half(n1) - _log_factorial(n0 + n1)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    return _log_gamma(n + 1.0)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    return _log_gamma(n + 0.5) - 0.5 * np.log(np.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, its argument first raised to 8 or more."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    while (low := y < 8).any():
        shift[low] += np.log(y[low])
        y[low] += 1
    i2 = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 / 1680))) / y - shift


def _mixed(log_kt: np.ndarray, log_longer: np.ndarray) -> np.ndarray:
    return np.logaddexp(log_kt, log_longer) - np.log(2.0)


class Trees:
    """The part of the trees under a bucket's contexts of two bytes and more."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        symbol = (keys & np.uint64(0xFF)).astype(np.int64)
        t = np.arange(8)
        self.node = ((1 << t) | (symbol[:, None] >> (8 - t))).ravel()
        self.bit = ((symbol[:, None] >> (7 - t)) & 1).ravel()
        context = np.repeat(keys >> np.uint64(8), 8)
        n = np.repeat(counts, 8).astype(np.float64)
        self.levels = []
        longer = where = None
        for depth in range(DEPTH, 1, -1):
            ids = ((context & np.uint64((1 << (8 * depth)) - 1)) << np.uint64(8)) | self.node.astype(np.uint64)
            nodes, at = np.unique(ids, return_inverse=True)
            n1 = np.bincount(at, n * self.bit, len(nodes))
            n0 = np.bincount(at, n, len(nodes)) - n1
            log_kt = _log_kt(n0, n1)
            if longer is None:
                log_w, below = log_kt, None
            else:
                up = np.empty(len(longer), np.int64)
                up[where] = at
                below = np.bincount(up, longer, len(nodes))
                log_w = _mixed(log_kt, below)
            self.levels.append((nodes, at, n0, n1, log_kt, below))
            longer, where = log_w, at
        self.log_w = longer

    def shorter(self) -> pd.DataFrame:
        """What this part adds to the nodes of one context byte."""
        nodes, _, n0, n1, _, _ = self.levels[-1]
        ids = (nodes & np.uint64(0xFFFF)).astype(np.int64)
        return pd.DataFrame({"id": ids, "n0": n0, "n1": n1, "below": self.log_w}).groupby("id", as_index=False).sum()

    def log10(self, top) -> np.ndarray:
        """Log probability of each key's byte in its context."""
        p = None
        for _, at, n0, n1, log_kt, below in self.levels:
            own = ((np.where(self.bit, n1[at], n0[at])) + 0.5) / (n0[at] + n1[at] + 1)
            if p is None:
                p = own
            else:
                w = 1 / (1 + np.exp(np.clip(below - log_kt, -700, 700)))[at]
                p = w * own + (1 - w) * p
        nodes, at = self.levels[-1][:2]
        one = (nodes & np.uint64(0xFFFF)).astype(np.int64)[at]
        for ids, (w, q1) in ((one, top.first), (one & 0xFF, top.zeroth)):
            own = np.where(self.bit, q1[ids], 1 - q1[ids])
            p = w[ids] * own + (1 - w[ids]) * p
        return np.log10(p).reshape(-1, 8).sum(axis=1)


class Top:
    """Weights of the own estimate, and estimates of a one, at the nodes of one context byte and of none."""

    def __init__(self, rows: list):
        n0, n1, below = (np.zeros(1 << 16) for _ in range(3))
        for r in rows:
            n0[r["id"]], n1[r["id"]], below[r["id"]] = r["n0"], r["n1"], r["below"]
        self.first, log_w = self._level(n0, n1, below)
        sums = [x.reshape(256, 256).sum(axis=0) for x in (n0, n1, log_w)]
        self.zeroth, _ = self._level(*sums)

    @staticmethod
    def _level(n0, n1, below):
        log_kt = _log_kt(n0, n1)
        w = 1 / (1 + np.exp(np.clip(below - log_kt, -700, 700)))
        return (w, (n1 + 0.5) / (n0 + n1 + 1)), _mixed(log_kt, below)


def _word_counts(f: pd.DataFrame) -> tuple[dict[bytes, int], list[list[bytes]]]:
    total: dict[bytes, int] = {}
    own = [k.split(b" ") for k in f["keys"]]
    for words, counts in zip(own, f["counts"]):
        for w, c in zip(words, _unpress(counts, np.int64).tolist()):
            total[w] = total.get(w, 0) + c
    return total, own


def _summary(f: pd.DataFrame) -> pd.DataFrame:
    """Totals of words and of texts."""
    kind = f["kind"].iloc[0]
    if kind == "word":
        counts = [c for c in _word_counts(f)[0].values() if c]
        return pd.DataFrame([(kind, -1, float(sum(counts)), float(len(counts)), 0.0)], columns=["kind", "id", "n0", "n1", "below"])
    return pd.DataFrame([(kind, -1, float(sum(_unpress(c, np.int64).sum() for c in f["counts"])), 0.0, 0.0)], columns=["kind", "id", "n0", "n1", "below"])


def _shorter(f: pd.DataFrame) -> pd.DataFrame:
    return Trees(*_pairs(f)).shorter().assign(kind="gram")[["kind", "id", "n0", "n1", "below"]]


def _values(top):
    """The number of each distinct string of a part, for the bucket that asked."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _pairs(f)
        value = np.round(Trees(keys, counts).log10(top.value) * STEPS).astype(np.int32)
        rows = []
        for bucket, k in zip(f["bucket"], f["keys"]):
            own = _unpress(k, np.uint64, True)
            rows.append((bucket, k, _press(value[np.searchsorted(keys, own)])))
        return pd.DataFrame(rows, columns=["bucket", "keys", "values"])

    return run


def _answer(f: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """What each block asked of a bucket."""
    if not len(f):
        return pd.DataFrame([], columns=["block", "kind", "bucket", "values"])
    keys = np.concatenate([_unpress(k, np.uint64, True) for k in found["keys"]])
    values = np.concatenate([_unpress(v, np.int32) for v in found["values"]])
    by = np.argsort(keys, kind="stable")
    keys, values = keys[by], values[by]
    answers = [_press(values[np.searchsorted(keys, _unpress(k, np.uint64, True))]) for k in f["keys"]]
    return pd.DataFrame({"block": f["block"], "kind": "gram", "bucket": f["bucket"], "values": answers})


def _answer_words(f: pd.DataFrame) -> pd.DataFrame:
    total, own = _word_counts(f)
    answers = [_press(np.array([total[w] for w in words], np.int64)) for words in own]
    return pd.DataFrame({"block": f["block"], "kind": "word", "bucket": f["bucket"], "values": answers})


def _score(buckets: int, spread: float):
    """spread: N + V + 1 of the base estimate."""

    def run(f: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame([], columns=["rid", "doc_id", "train", "n_tokens", "n_known", "base", "score"])
        f = _opened(f)
        got = {(k, b): v for k, b, v in zip(answers["kind"], answers["bucket"], answers["values"])}
        keys, _ = _grams(f)
        values = np.empty(len(keys))
        for b, at in _split_by(_gram_buckets(keys, buckets)):
            values[at] = _unpress(got["gram", b], np.int32) / STEPS
        score = []
        for a, z in _chunks(_sizes(f)):
            some = f.iloc[a:z]
            key, _ = _keys(some["before"].tolist(), some["text"].tolist())
            size = _sizes(some)
            distinct, inverse = np.unique(key, return_inverse=True)
            each = np.r_[0.0, np.cumsum(values[np.searchsorted(keys, distinct)][inverse])]
            ends = np.cumsum(size)
            score.append(each[ends] - each[ends - size])
        words, _ = _words(f)
        counts = np.empty(len(words), np.int64)
        for b, at in _split_by(_word_buckets(words, buckets)):
            counts[at] = _unpress(got["word", b], np.int64)
        logs = dict(zip(words, np.log10((counts + 1) / spread).tolist()))
        seen = {w for w, c in zip(words, counts.tolist()) if c}
        tokens, known, base = [], [], []
        for text in f["text"]:
            own = _split(text)
            tokens.append(len(own))
            known.append(sum(map(seen.__contains__, own)))
            base.append(sum(map(logs.__getitem__, own)))
        return pd.DataFrame({"rid": f["rid"], "doc_id": f["doc_id"], "train": f["train"], "n_tokens": tokens, "n_known": known, "base": base, "score": np.concatenate(score)})

    return run


def score_texts(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    train: which rows are learned from. score: log10 probability of the text under the weighted trees;
    base_score: under add-one word frequencies, an end counting as a word."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("string"), train.alias("train"), F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    buckets = max(16, 2 * blocks)
    dealt = cut(rows.mapInArrow(_deal(blocks), "block int, data binary"))
    asked = cut(dealt.groupBy("block").applyInPandas(_ask(buckets), "block int, kind string, bucket int, keys binary, counts binary"))
    grams, words = asked.where("kind = 'gram'"), asked.where("kind = 'word'")
    summed = cut(grams.groupBy("bucket").applyInPandas(_sum_up(buckets), "part int, bucket int, keys binary, counts binary"))
    shape = "kind string, id int, n0 double, n1 double, below double"
    parts = asked.where("kind <> 'gram'").groupBy("kind", "bucket").applyInPandas(_summary, shape).unionAll(summed.groupBy("part").applyInPandas(_shorter, shape))
    summary = parts.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).collect()  # at most 256 x 255 + 2 rows
    n_words, n_distinct = next(((r["n0"], r["n1"]) for r in summary if r["kind"] == "word"), (0.0, 0.0))
    n_texts = next((r["n0"] for r in summary if r["kind"] == "text"), 0.0)
    tokens, distinct = int(n_words + n_texts), int(n_distinct + (n_texts > 0))
    spread = float(tokens + distinct + 1)
    top = spark.sparkContext.broadcast(Top([r for r in summary if r["kind"] == "gram"]))
    shape = "block int, kind string, bucket int, values binary"
    found = summed.groupBy("part").applyInPandas(_values(top), "bucket int, keys binary, values binary")
    answers = grams.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(_answer, shape).unionAll(words.groupBy("bucket").applyInPandas(_answer_words, shape))
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(buckets, spread), "rid long, doc_id string, train boolean, n_tokens long, n_known long, base double, score double")
    sums = scored.groupBy("rid", "doc_id", "train").agg(*[F.sum(c).alias(f"_{c}") for c in ("n_tokens", "n_known", "base", "score")])
    end = float(np.log10((n_texts + 1) / spread))
    return sums.select(
        F.col("doc_id").cast(kind),
        "train",
        (F.col("_n_tokens") + 1).alias("n_tokens"),
        (F.col("_n_known") + int(n_texts > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + end).alias("base_score"),
        F.col("_score").alias("score"),
    )


def op2_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, ~held_out(F.col("doc_id")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
