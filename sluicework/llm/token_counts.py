"""Token counts of a byte-level tokenizer by rank-synchronous merging of arrays.

The pre-tokens of a batch that a worker has not met yet are held as one ragged array: their byte symbols
one behind the other, the rank of each symbol's pair with the next, and where each pre-token starts. In every
round each pre-token finds its lowest rank, all its pairs of that rank are merged at once, from the left, and
only the ranks beside a merge are looked up anew; pre-tokens without a pair left are done. What survives of
each is its number of tokens. The count of a text is the sum over its pre-tokens.

Defined cases: a null text counts like an empty one, no bytes and no tokens. Text of an added token counts as
that token, as the library does by default. Texts are counted whole, however long; a text that is not UTF-8
counts its bad bytes as U+FFFD, n_bytes as stored. Repeated rows, null and repeated ids have a row each, an
empty table none. Further columns of any name are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose counts a worker keeps before it starts anew.
KEPT = 600_000
#: UTF-8 bytes of texts that are counted together, and bytes of new pre-tokens that are merged together.
SLICE_BYTES, MERGE_BYTES = 4 << 20, 2 << 20
NONE = np.iinfo(np.int32).max

# Fixed value: how byte-level tokenizers cut a text, and the same for ASCII alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+"


def _suspects() -> str:
    """A class of the letters of ``regex`` that are unassigned in Python's own tables; the library may see them otherwise."""
    letter, out = regex.compile(r"\p{L}|\p{N}"), []
    for c in range(0x530, 0x110000):
        if unicodedata.category(chr(c)) == "Cn" and letter.match(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in out) + "]" if out else r"(?!)"


def byte_symbols() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class RankMerger:
    """Counts the symbols that merging leaves of each of many byte strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int32)
        a = np.array([vocab[x] for x, _ in merges], np.int64)
        b = np.array([vocab[y] for _, y in merges], np.int64)
        self.made = np.array([vocab[x + y] for x, y in merges], np.int32)
        if len(np.unique(self.made)) < len(self.made) or not self._in_order(a, b):
            raise ValueError("merges that can be undone by a later one of lower rank cannot be applied all at once")
        key = a << 32 | b
        self.rank = np.argsort(key, kind="stable").astype(np.int32)
        self.key = key[self.rank]
        self.bytes = self._ranks(np.repeat(self.first, 256), np.tile(self.first, 256)).reshape(256, 256)

    def _in_order(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether each merge comes behind those that make its parts, so that no merge opens one of lower rank."""
        at = np.full(int(max(self.made.max(initial=0), self.first.max(), a.max(initial=0), b.max(initial=0))) + 1, -1)
        at[self.made] = np.arange(len(self.made))
        return bool((np.maximum(at[a], at[b]) < np.arange(len(a))).all())

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(a), NONE, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        out = np.array([len(w) for w in words], np.int64)
        own = np.flatnonzero(out > 1)  # the words that may still merge
        data = np.frombuffer(b"".join([words[i] for i in own]), np.uint8)
        size = out[own]
        ends = np.cumsum(size)
        symbol = self.first[data]
        rank = np.full(len(data), NONE, np.int32)
        rank[:-1] = self.bytes[data[:-1], data[1:]] if len(data) else 0
        rank[ends - 1] = NONE
        while len(own):
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, starts)
            live = least < NONE
            if not live.all():
                out[own[~live]] = size[~live]
                kept = np.repeat(live, size)
                symbol, rank, own, size, least = symbol[kept], rank[kept], own[live], size[live], least[live]
                if not len(own):
                    break
            word = np.repeat(np.arange(len(own)), size)
            hit = np.flatnonzero(rank == least[word])
            # a pair of equal symbols may overlap the next one: of each run of neighbours every second one is merged
            fresh = np.diff(hit, prepend=-2) > 1
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            last = np.zeros(len(symbol), bool)
            last[np.cumsum(size) - 1] = True
            last[hit] = last[hit + 1]
            kept = np.ones(len(symbol), bool)
            kept[hit + 1] = False
            size = size - np.bincount(word[hit], minlength=len(own))
            symbol, rank, last = symbol[kept], rank[kept], last[kept]
            at = hit - np.arange(len(hit))
            beside = np.concatenate([at, at[at > 0] - 1])
            inner = beside[~last[beside]]
            rank[beside[last[beside]]] = NONE
            rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        return out


class Counter:
    """Counts tokens of texts as the library does with a byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model, added = spec["pre_tokenizer"] or {}, spec["model"], spec["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"]
        if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("not a plain byte-level tokenizer")
        self.merger = RankMerger(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.cut, self.ascii_cut, self.suspect = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall, re.compile(_suspects()).search
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_cut(text)
        if self.suspect(text):
            return [text[a:z] for _, (a, z) in self.library(text)]
        return self.cut(text)

    def count(self, texts: list[str]) -> list[int]:
        if len(self.known) > KEPT:
            self.known.clear()
        known, cuts, special = self.known, [], []
        for t in texts:
            parts = self.added.split(t) if self.added else [t]
            special.append(len(parts) - 1)
            cuts.append(self.pre_tokens(t) if len(parts) == 1 else [x for p in parts for x in self.pre_tokens(p)])
        new = list(set().union(*cuts).difference(known))
        words = [w.encode() for w in new]
        edges = np.cumsum([0, *map(len, words)]) // MERGE_BYTES
        for block in np.unique(edges[:-1]).tolist():
            a, z = np.searchsorted(edges[:-1], [block, block + 1]).tolist()
            known.update(zip(new[a:z], self.merger.counts(words[a:z]).tolist()))
        return [sum(map(known.__getitem__, c)) + n for c, n in zip(cuts, special)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row of docs (doc_id, text).

    Every text is one row of one task; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            size = np.array([0 if n is None else n for n in pc.binary_length(texts).to_pylist()], np.int64)
            edges = (np.cumsum(size) - size) // SLICE_BYTES
            tokens: list[int] = []
            for block in np.unique(edges).tolist():
                a, z = np.searchsorted(edges, [block, block + 1]).tolist()
                tokens += own.count([(t or b"").decode("utf-8", "replace") for t in texts.slice(a, z - a).to_pylist()])
            n = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_token_counts(spark, sf_dir):
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
