"""Repeated byte strings, by merging shards' Burrows-Wheeler orders around shared anchors.

A byte goes if it is covered by a string of ``LENGTH`` bytes that starts anywhere else too.

Every string of ``LENGTH`` bytes holds an anchor: a place whose short hash is the least of ``REACH``
neighbours, chosen by content alone and so at the same distance in every copy, with its next
LENGTH-REACH+1 bytes (its core) inside the string. Anchors whose core occurs once are done. Those
whose whole context (all strings that may pick this anchor) occurs twice are settled as they stand.
What is left, the edges of copies, is settled by the merge: the contexts of one core, from all shards,
start as one interval of the order, and the order is refined a byte at a time towards each side by
stable partition on that byte (the interleave step of merging Burrows-Wheeler transforms); nothing is
sorted anew, and after k steps an interval holds contexts with a common string of k bytes. A string
is repeated if its left and right intervals meet in another context.

Only contexts pass the merge, aligned on their anchors, so a step costs one move for each context and
not one for each byte of the corpus; 2 x (REACH-1) steps replace LENGTH of them.

Defined cases: a null text is empty; texts shorter than LENGTH keep all bytes. Matches never cross
documents. Rows equal in doc_id and text are copies of each other. Extra columns are not read. A text
of equal bytes or of a short period has an anchor at every byte or period; overlapping intervals of one
text become one before they leave their bucket, so such a text gives few of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

LENGTH, REACH = 200, 100
CORE, SIDE = LENGTH - REACH + 1, REACH - 1
#: Text bytes whose anchors meet in one bucket, about.
BUCKET_BYTES = 12 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = 0xD6E8FEB86659FD93
_BYTES = (np.arange(1, 257, dtype=np.uint64) * _M1) ^ ((np.arange(1, 257, dtype=np.uint64) * _M2) >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (or greatest) of each n neighbours from a place on."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = least(x[: len(x) - step], x[step:])
        have += step
    return x


class Hasher:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def anchors(self, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of the anchors, their core's hash, their context's hash, and context bytes before and behind the core."""
        n = len(b)
        x = b.astype(np.uint64)
        for k in (1, 2, 4):
            x = x[:-k] | (x[k:] << np.uint64(8 * k))
        h = (x[:-8] * _M1) ^ (x[8:] * _M2)
        h ^= h >> np.uint64(32)
        h *= _M3
        h = h[: n - LENGTH + REACH]
        least = _sliding(h, REACH, np.minimum)
        pad = np.zeros(SIDE, np.uint64)
        j = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), REACH, np.maximum) == h)
        if len(self.up) <= n:
            self.up, self.down = _powers(2 * n, _BASE), _powers(2 * n, pow(_BASE, -1, 1 << 64))
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[b] * self.up[:n], out=s[1:])
        low, high = np.minimum(SIDE, j), np.minimum(SIDE, n - CORE - j)
        core = (s[j + CORE] - s[j]) * self.down[j]
        whole = (s[j + CORE + high] - s[j - low]) * self.down[j - low]
        core ^= core >> np.uint64(29)
        whole = (whole ^ (low.astype(np.uint64) << np.uint64(8)) ^ high.astype(np.uint64)) * _M2
        return j, core * _M1, whole ^ (whole >> np.uint64(32)), low, high


def _deal(buckets: int):
    """Packed anchors of each batch and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts, held = [], 0
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_buffer() if text.is_valid else None
                if t is not None and t.size >= LENGTH:
                    j, core, whole, low, high = hasher.anchors(np.frombuffer(t, np.uint8))
                    parts.append((np.full(len(j), rid, np.int64), j.astype(np.int32), core, whole, low.astype(np.uint8), high.astype(np.uint8)))
                    held += len(j)
                if held > 1_000_000:
                    yield _packed(parts, buckets)
                    parts, held = [], 0
            if parts:
                yield _packed(parts, buckets)

    return run


_FIELDS = (("rid", np.int64), ("j", np.int32), ("core", np.uint64), ("whole", np.uint64), ("low", np.uint8), ("high", np.uint8))


def _packed(parts, buckets: int) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    to = ((columns[2] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[by], np.arange(buckets + 1))
    used = [i for i in range(buckets) if edges[i + 1] > edges[i]]
    data = [pa.array([c[by[edges[i] : edges[i + 1]]].tobytes() for i in used], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *data], names=["bucket", *(n for n, _ in _FIELDS)])


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows stand together, and how many equal rows each place of it has."""
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    first = np.flatnonzero(new)
    return by, np.repeat(np.diff(np.r_[first, len(by)]), np.diff(np.r_[first, len(by)]))


def _united(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals with those of one rid that overlap or touch made one."""
    by = np.lexsort((start, rid))
    rid, start, end = rid[by], start[by].astype(np.int64), end[by].astype(np.int64)
    row = np.cumsum(np.r_[False, rid[1:] != rid[:-1]][: len(rid)]) << 32
    top = np.maximum.accumulate(row + end)
    first = np.flatnonzero(np.r_[True, (row + start)[1:] > top[:-1]][: len(rid)])
    last = np.r_[first[1:], len(rid)][: len(first)] - 1
    return rid[first], start[first], (top - row)[last]


def _settle(f: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's anchors: intervals that are repeated as they stand (core null), and the contexts
    that the merge needs (core set): the single ones, and one of each repeated kind beside them."""
    rid, j, core, whole, low, high = (np.concatenate([np.frombuffer(x, t) for x in f[n]]) for n, t in _FIELDS)
    by, n = _same(core)
    keep = by[n > 1]
    rid, j, core, whole, low, high = (c[keep] for c in (rid, j, core, whole, low, high))
    if not len(rid):
        return pd.DataFrame(columns=["rid", "j", "core", "start", "end"])
    by, n = _same(core, whole, low, high)
    rid, j, core, whole, low, high = (c[by] for c in (rid, j, core, whole, low, high))
    start, end = j - low, j + CORE + high
    done = (n > 1) & (end - start >= LENGTH)
    first = np.r_[True, (core[1:] != core[:-1]) | (whole[1:] != whole[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    edge = ~done & (end - start >= LENGTH)
    groups, where = np.unique(core, return_inverse=True)
    open_ = np.bincount(where, edge, len(groups))[where] > 0  # cores with something left to settle
    ask = open_ & first & (end - start >= LENGTH)
    more = np.bincount(where, ask, len(groups))[where] > 1
    ask &= more
    runs, starts, ends = _united(rid[done], start[done], end[done])
    a = pd.DataFrame({"rid": runs, "j": starts, "core": pd.array([None] * len(runs), "Int64"), "start": starts, "end": ends})
    b = pd.DataFrame({"rid": rid[ask], "j": j[ask], "core": pd.array(core.view(np.int64)[ask], "Int64"), "start": start[ask], "end": end[ask]})
    return pd.concat([a, b])


def _contexts(f: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in f:
        rows = []
        for rid, text, asks in zip(x["rid"], x["text"], x["asks"]):
            for a in asks:
                j = a["j"]
                rows.append((a["core"], rid, j, a["start"], a["end"], text[a["start"] : j], text[j + CORE : a["end"]]))
        yield pd.DataFrame(rows, columns=["core", "rid", "j", "start", "end", "before", "behind"])


def interleave_step(order: np.ndarray, interval: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next order and each context's interval in it, once one more byte counts: contexts are moved
    stably to their byte's part of the order, and an interval ends where byte or old interval changes."""
    c = byte[order]
    move = np.argsort(c, kind="stable")
    order, c = order[move], c[move]
    old = interval[order]
    new = np.empty(len(order), np.int64)
    new[order] = np.cumsum(np.r_[False, (c[1:] != c[:-1]) | (old[1:] != old[:-1])])
    return order, new


def _side(strings: list[bytes], backwards: bool) -> np.ndarray:
    """A row of bytes for each step away from the anchor; 0xFF, which no UTF-8 has, beyond the text."""
    out = np.full((SIDE, len(strings)), 0xFF, np.uint8)
    for i, s in enumerate(strings):
        out[: len(s), i] = np.frombuffer(s[::-1] if backwards else s, np.uint8)
    return out


def _merge(f: pd.DataFrame) -> pd.DataFrame:
    """The repeated part of each context of a bucket."""
    _, group = np.unique(f["core"].to_numpy(np.int64), return_inverse=True)
    j, start, end = (f[c].to_numpy(np.int64) for c in ("j", "start", "end"))
    low, high = j - start, end - j - CORE
    order = np.argsort(group, kind="stable")
    behind = [group.astype(np.int64)]
    at = order
    for byte in _side(f["behind"].tolist(), False):
        at, interval = interleave_step(at, behind[-1], byte)
        behind.append(interval)
    most, least = np.full(len(f), -1), np.full(len(f), SIDE + 1)
    at, interval = order, group.astype(np.int64)
    for a, byte in enumerate([None, *_side(f["before"].tolist(), True)]):
        if byte is not None:
            at, interval = interleave_step(at, interval, byte)
        rows = np.flatnonzero((low >= a) & (high >= SIDE - a))
        if len(rows) > 1:
            by, n = _same(interval[rows], behind[SIDE - a][rows])
            hit = rows[by[n > 1]]
            most[hit] = np.maximum(most[hit], a)
            least[hit] = np.minimum(least[hit], a)
    met = most >= 0
    return pd.DataFrame(dict(zip(("rid", "start", "end"), _united(f["rid"].to_numpy(np.int64)[met], (j - most)[met], (j - least + LENGTH)[met]))))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            text, merged = text or b"", []
            for s in sorted((x["start"], x["end"]) for x in spans or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            at, kept = 0, []
            for s, e in merged:
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), [{"start": s, "end": e} for s, e in merged], rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (the removed byte runs) and kept (bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.col("text").cast("binary").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(12, -(-total // BUCKET_BYTES))
    packed = rows.select("rid", "text").mapInArrow(_deal(buckets), "bucket int, rid binary, j binary, core binary, whole binary, low binary, high binary")
    settled = cut(packed.groupBy("bucket").applyInPandas(_settle, "rid long, j int, core long, start int, end int"))
    asks = settled.where("core is not null").groupBy("rid").agg(F.collect_set(F.struct("j", "core", "start", "end")).alias("asks"))
    texts = rows.select("rid", "text").join(asks, "rid").dropDuplicates(["rid"])
    contexts = texts.mapInPandas(_contexts, "core long, rid long, j int, start int, end int, before binary, behind binary")
    merged = contexts.groupBy(F.pmod(F.xxhash64("core"), F.lit(buckets)).alias("bucket")).applyInPandas(_merge, "rid long, start int, end int")
    spans = settled.where("core is null").select("rid", "start", "end").unionByName(merged)
    spans = spans.groupBy("rid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(spans, "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans", "kept")
