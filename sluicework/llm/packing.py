"""Best-fit packing by patterns: non-negative least squares over short length patterns.

The histogram of piece lengths has at most ``capacity`` entries whatever the corpus holds, so the
plan is made from it on the driver: patterns of one to three lengths that fill a sequence exactly are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares, rounded,
and what is left is packed by best fit, equal lengths at once. Pieces then look up their place by
their rank among the pieces of their length. Ranks are counted within a task when the pieces are made
and offset by the counts of earlier tasks, so no length, however common, meets in one task.

Defined cases: a null text is empty and is one piece holding the end id alone. Repeated rows and null
doc_ids are packed like others. A document of exactly the capacity is one piece.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, released

#: Words, in two halves, that a worker keeps encoded.
CACHED_WORDS = 250_000
#: UTF-8 bytes of text that are encoded together.
SLICE_BYTES = 1 << 20
#: A control character that stands between words that are encoded together.
MARK = b"\x01"
#: UTF-8 of letters that stay as they are once ASCII is lowered (to U+00FF), and ASCII punctuation but for the apostrophe.
LATIN_WORD = r"^(?P<stem>(?:[A-Za-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
#: Byte-level vocabularies write a byte that has no visible Latin-1 character as the next free letter from U+0100 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
#: Passes of the coordinate descent.
PASSES = 4


def _values(words: pa.Array) -> list[bytes]:
    """The words of a binary array without nulls (to_pylist makes an Arrow scalar of each, which takes some ten times as long)."""
    _, offsets, data = words.buffers()
    at, data = np.frombuffer(offsets or b"", np.int32)[words.offset :][: len(words) + 1].tolist(), bytes(data or b"")
    return [data[a:z] for a, z in zip(at, at[1:])]


class WordEncoder:
    """Encodes texts by way of their words.

    The tokenizer drops white space and none of its tokens spans any, so the ids of a text are those
    of its white-space-separated words in turn, and each distinct word of a block of texts is looked
    up once. A word of plain Latin letters and a tail of ASCII punctuation is the common case: it is
    split in two there, and the letters, lowered, go straight to the merges, once for all the words
    that differ in case or tail alone. All others are encoded whole.

    Stems, tails and other words are kept in two halves: when the recent half is full it becomes the
    older one, from which only what comes up again is taken over, so that common words stay."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.clear()

    def clear(self) -> None:
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_whole(self, words: list[bytes]) -> None:
        """Many at once, with a mark between them whose id no word can have."""
        # the text of a special token is case-sensitive, so what may hold one is not lowered
        plain = [w for w in words if MARK not in w and b"<|" not in w]
        self.recent.update((w, self._ids(w).tobytes()) for w in set(words).difference(plain))
        mark = self._ids(MARK)
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = self._ids((b" " + MARK + b" ").join(some))
            ends = np.flatnonzero(ids == mark[0]).tolist()
            if len(mark) != 1 or len(ends) != len(some) - 1:
                raise ValueError("the tokenizer does not keep the mark apart")
            buffer = ids.tobytes()
            self.recent.update((w, buffer[4 * a : 4 * z]) for w, a, z in zip(some, [0, *(e + 1 for e in ends)], [*ends, len(ids)]))

    def _merge_stems(self, stems: list[bytes]) -> None:
        merge, known = self.merge, self.recent
        for w in stems:
            letters = w.decode("latin-1")
            if not letters.isascii():
                letters = letters.translate(BYTE_LETTERS)
            known[w] = array("I", [t.id for t in merge(letters)]).tobytes()

    def _known(self, words: pa.Array, learn: Callable[[list[bytes]], None]) -> pa.Array:
        """The ids of distinct words; learn puts those of new ones into the recent half."""
        if len(self.recent) > CACHED_WORDS // 2:
            self.recent, self.older = {}, self.recent
        keys, recent, older = _values(words), self.recent, self.older
        of_word = list(map(recent.get, keys))
        if None in of_word:
            missing = [w for w, ids in zip(keys, of_word) if ids is None]
            recent.update((w, older[w]) for w in missing if w in older)
            learn([w for w in missing if w not in older])
            of_word = [recent[w] if ids is None else ids for w, ids in zip(keys, of_word)]
        return pa.array(of_word, pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The ids of all texts as unsigned 32-bit numbers, without ends, and the bytes between which each text's are."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.view(pa.binary())
        stem, tail = pc.extract_regex(distinct, LATIN_WORD).flatten()
        split = pc.and_(stem.is_valid(), pc.invert(pc.fill_null(pc.match_substring(tail, "<|"), True)))
        plain, other = pc.indices_nonzero(split), pc.indices_nonzero(pc.invert(split))
        stem = pc.ascii_lower(stem.take(plain).view(pa.string())).view(pa.binary()).dictionary_encode()
        tail = tail.take(plain).dictionary_encode()
        stem_ids = self._known(stem.dictionary, self._merge_stems).take(stem.indices)
        tail_ids = self._known(tail.dictionary, self._encode_whole).take(tail.indices)
        of_word = pa.concat_arrays([pc.binary_join_element_wise(stem_ids, tail_ids, pa.scalar(b"", pa.large_binary())), self._known(distinct.take(other), self._encode_whole)])
        place = np.empty(len(distinct), np.int64)
        place[np.concatenate([plain.to_numpy(), other.to_numpy()])] = np.arange(len(distinct))
        ids = of_word.take(pa.array(place[coded.indices.to_numpy()]))
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        return memoryview(data or b""), at[words.offsets.to_numpy()].tolist()


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit numbers")

_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    block = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    yield from ((a, z) for a, z in zip(edges, edges[1:]) if z > a)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, ids (null unless asked
    for), and its place among those of its length in its task (part, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = array("I", [end_id]).tobytes()
        for batch in batches:
            text = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, z in _slices(sizes, SLICE_BYTES):
                rows, piece, start, length, crc, kept = [], [], [], [], [], []
                data, edges = enc.encode(text.slice(a, z - a))
                for row, first, last in zip(range(a, z), edges, edges[1:]):
                    ids = bytes(data[first:last]) + end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append(row), piece.append(p), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                        kept.append(np.frombuffer(own, np.int32) if with_ids else None)
                size = np.array(length, np.int64)
                by = np.argsort(size, kind="stable")
                first = np.searchsorted(size[by], size[by])
                k = np.empty(len(size), np.int64)
                k[by] = np.arange(len(size)) - first + seen[size[by]]
                seen += np.bincount(size, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size), pa.array(crc, pa.int64()), pa.array(kept, pa.list_(pa.int32())), pa.array([part] * len(rows), pa.int32()), pa.array(k)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "k"],
                )
        enc.clear()  # the worker goes on to other stages

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, part int, k long")


def fit_patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Exactly filling patterns of up to three lengths and how often each is used, all within counts."""
    have = sorted(counts, reverse=True)
    left = [0.0] * (capacity + 1)
    for n, c in counts.items():
        left[n] = float(c)
    x: dict[tuple[int, ...], float] = {}
    if counts.get(capacity):
        x[(capacity,)] = left[capacity]
        left[capacity] = 0.0
    patterns = [(a, capacity - a) for a in have if 2 * a >= capacity and counts.get(capacity - a)]
    for a in have:
        if a < capacity:
            rest = capacity - a
            patterns += [(a, b, rest - b) for b in have if b <= a and 2 * b >= rest and rest > b and counts.get(rest - b)]
    # coordinate descent on the squared misfit; a length that stands twice in a pattern counts twice
    for _ in range(PASSES):
        for p in patterns:
            pull = norm = 0.0
            for n in p:
                pull += left[n]
            norm = 2.0 if len(p) == 2 and p[0] != p[1] else 4.0 if len(p) == 2 else float(sum(p.count(n) for n in p))
            old = x.get(p, 0.0)
            step = max(-old, pull / norm)
            if step:
                x[p] = old + step
                for n in p:
                    left[n] -= step
    free, used = dict(counts), []
    for p, v in sorted(x.items(), key=lambda e: (-e[1], e[0])):
        times = min([round(v), *(free[n] // p.count(n) for n in set(p))])
        if times > 0:
            used.append((p, times))
            for n in p:
                free[n] -= times
    return used


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit over lengths in falling order; bins that look alike are handled together."""
    bins: dict[int, list[list]] = {}  # room left: [content, how many]
    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c > 0:
            room = min((r for r in bins if r >= n), default=None)
            if room is None:
                content, have, room = (), -(-c // (capacity // n)), capacity
            else:
                content, have = bins[room].pop()
                if not bins[room]:
                    del bins[room]
            each = min(room // n, c)
            take = min(have, c // each)
            if have > take:
                if room < capacity or content:
                    bins.setdefault(room, []).append([content, have - take])
            bins.setdefault(room - each * n, []).append([content + (n,) * each, take])
            c -= each * take
    return [(tuple(content), have) for group in bins.values() for content, have in group]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Where the pieces of each length go: those of rank first..first+times-1 to the sequences from
    sequence on, at offset. A row for each slot of each pattern."""
    used = fit_patterns(counts, capacity)
    free = dict(counts)
    for p, times in used:
        for n in p:
            free[n] -= times
    used += best_fit({n: c for n, c in free.items() if c}, capacity)
    rank, sequence, rows = dict.fromkeys(counts, 0), 0, []
    for p, times in used:
        at = 0
        for n in p:
            rows.append((n, rank[n], times, sequence, at))
            rank[n] += times
            at += n
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "times", "sequence", "offset"]).sort_values(["length", "first"])


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset for every piece of every document.

    Pieces of a sequence stand gapless from offset 0; with_ids keeps each piece's token ids."""
    made = cut(pieces(docs, tokenizer, capacity, end_id, with_ids))
    per = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("c"))
    per = cut(per.select(F.col("part").alias("_part"), F.col("length").alias("_length"), "c", F.coalesce(F.sum("c").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    counts = {r[0]: r[1] for r in per.groupBy("_length").agg(F.sum("c")).collect()}  # at most ``capacity`` rows
    rows = plan(counts, capacity)
    slots = docs.sparkSession.sparkContext.broadcast({c: rows[c].to_numpy(np.int64) for c in rows.columns})

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = slots.value
        key = (s["length"] << 44) | s["first"]
        for f in frames:
            rank = f["rank"].to_numpy(np.int64)
            row = np.searchsorted(key, (f["length"].to_numpy(np.int64) << 44) | rank, "right") - 1
            f["sequence_id"] = s["sequence"][row] + rank - s["first"][row]
            f["offset"] = s["offset"][row]
            yield f.drop(columns="rank")

    ranked = made.join(per, (made.part == per._part) & (made.length == per._length)).select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("k") + F.col("before")).alias("rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()
    return ranked.mapInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()).drop("ids")
