"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius share a variant that is within half the radius of both. So every
distinct fingerprint emits all its variants within half the radius, and fingerprints that meet on a
variant are linked; whatever meets so is within the radius, which verifies the pair. A run of k
fingerprints on one variant is linked in a star of k-1 pairs: all links between them hold, and none
that connects different texts is lost to their component.

The variants are dealt out by their leading bits: a fingerprint travels once to each prefix within
half the radius of its own, and its variants under that prefix are made in the task that groups them.
Prefixes with too many variants are split further, bit by bit, so no group grows with the data.
Equal fingerprints are one before they are emitted; components are found by alternating star
contraction over the links, in Spark. Wherever rows look up what belongs to their fingerprint or group,
a frequent one is dealt over many tasks.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other. Fewer
words than a shingle: the whole sequence is one shingle. Null doc_ids take part; a component's id is
its smallest doc_id that is not null. Repeated rows are all returned. A very long text is hashed as a
whole, in one task; its votes are counted in blocks. Only doc_id, text and the named keys are read, so
further columns may have any name. An empty table gives an empty one.

Deduplication at a shingle similarity of 0.8 needs more than 64 bits: such texts differ in some 15 in
100 bits. There a fingerprint has WORDS words of WORD_BITS bits over the distinct shingles, each word
is hashed by its ball on its own, and colliding pairs are verified by all bits and then by the exact
Jaccard similarity of their shingle sets, so that no family of related texts grows together by chance.
What fingerprints or heads miss is found by an exact join over the rarest shingles of each text, so groups
are those of all similar pairs. Before that a sieve over some 30 in 100 shingles of each set, the least hashes,
leaves out sets that can have no partner: only of those that stay are all shingles shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations
from math import acos, comb, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, released, settled

#: Variants that one group makes at most before its prefix is split.
GROUP_VARIANTS = 4_000_000
#: Bits by which a prefix is split.
SPLIT_BITS = 6
#: Words of a long fingerprint and their bits; two words that differ in at most WORD_RADIUS bits make a candidate.
WORDS, WORD_BITS, WORD_RADIUS = 32, 32, 2
#: Longest prefix by which words are dealt out: no group has more than 2^20 of them.
WORD_PREFIX = 12
#: Shingle hashes that a task holds before it passes them on.
HELD = 1_000_000
#: Share of a set's shingles that the sieve reads beyond those that a partner may lack.
SIEVE = 0.1
#: Rows that are broadcast at most to choose texts, so that these need no shuffle.
SENT_ROWS = 2_000_000
#: Texts with one rare shingle that one task tries with others.
TRIED_ROWS = 5_000


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, highest bit first; a bit is 1 if it is set in over half the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    hash_of = xxhash.xxh64_digest
    hashes = [hash_of(joined[s:e], seed) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :])]
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        count += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns of docs and ``fp``, the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            fps = np.frombuffer(b"".join(fingerprint(t, shingle, seed) for t in texts), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], names=[*keys, "fp"])

    kept = docs.select(*keys, F.col("text").cast("binary").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{kinds}, fp long")


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For each radius 0..most: all masks over the low ``bits`` bits of up to so many ones."""
    out, have = [], [0]
    for r in range(most + 1):
        if r:
            have = have + [sum(1 << b for b in c) for c in combinations(range(bits), r)]
        out.append(np.array(have, np.uint64))
    return out


def _spread(fps: np.ndarray, left: np.ndarray, known: int, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which row, under which next ``more`` bits, with how many flips left, once ``known`` leading bits are fixed."""
    own = (fps >> np.uint64(64 - known - more)) & np.uint64((1 << more) - 1)
    rows, nexts, lefts = [], [], []
    for flips in range(int(left.max(initial=-1)) + 1):
        can = np.flatnonzero(left >= flips)
        for c in combinations(range(more), flips):
            rows.append(can)
            nexts.append(own[can] ^ np.uint64(sum(1 << b for b in c)))
            lefts.append(left[can] - flips)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(nexts), np.concatenate(lefts)


def _ball(bits: int, left: int) -> int:
    return sum(comb(bits, r) for r in range(left + 1))


def _meet(fps: np.ndarray, left: np.ndarray, known: int, bits: int = 64) -> np.ndarray:
    """Links (row, row) among fingerprints that share a variant under the present prefix; fps has its ``bits`` leading bits in use."""
    masks = [m << np.uint64(64 - bits) for m in _masks(bits - known, int(left.max(initial=0)))]
    variants, owners = [], []
    low = fps & np.uint64((1 << (64 - known)) - 1)
    for r, m in enumerate(masks):
        rows = np.flatnonzero(left == r)
        if len(rows):
            variants.append((low[rows][:, None] ^ m[None, :]).ravel())
            owners.append(np.repeat(rows.astype(np.int32), len(m)))
    v, o = np.concatenate(variants), np.concatenate(owners)
    by = np.argsort(v, kind="stable")
    v, o = v[by], o[by]
    new = np.r_[True, v[1:] != v[:-1]]
    head = o[np.flatnonzero(new)][np.cumsum(new) - 1]
    a, b = np.minimum(head, o)[~new].astype(np.int64), np.maximum(head, o)[~new].astype(np.int64)
    pairs = np.unique(a * len(fps) + b)
    return np.stack([pairs // len(fps), pairs % len(fps)], axis=1)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """distinct: column fp, no value twice. Pairs (a, b) whose components are those of all pairs within the radius.

    radius is even: a variant within half of it lies between any two fingerprints to be linked."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius is an even number")
    half = radius // 2
    n = distinct.count()
    known = max(1, min(24, int(np.ceil(np.log2(max(1, n) * _ball(64, half) / GROUP_VARIANTS + 1)))))

    def spread(was: int, more: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                fps = f["fp"].to_numpy(np.int64).view(np.uint64)
                old = f["prefix"].to_numpy(np.int64)
                rows, nexts, lefts = _spread(fps, f["left"].to_numpy(np.int64), was, more)
                yield pd.DataFrame({"known": was + more, "prefix": (old[rows] << more) | nexts.astype(np.int64), "fp": fps.view(np.int64)[rows], "left": lefts})

        return run

    schema = "known int, prefix long, fp long, left int"
    rows = distinct.select(F.lit(0).alias("known"), F.lit(0).cast("long").alias("prefix"), "fp", F.lit(half).alias("left")).mapInPandas(spread(0, known), schema)
    ready = []
    while True:
        rows = settled(rows)
        size = F.element_at(F.array(*[F.lit(_ball(64 - known, r)) for r in range(half + 1)]), F.col("left") + 1)
        weights = rows.groupBy("known", "prefix").agg(F.sum(size).alias("_w")).where(F.col("_w") > 2 * GROUP_VARIANTS)
        if known + SPLIT_BITS > 48 or weights.isEmpty():
            ready.append(rows)
            break
        heavy = weights.select(F.col("prefix").alias("_p"))
        ready.append(rows.join(heavy, F.col("prefix") == F.col("_p"), "left_anti"))
        rows = rows.join(heavy, F.col("prefix") == F.col("_p"), "left_semi").mapInPandas(spread(known, SPLIT_BITS), schema)
        known += SPLIT_BITS

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        fps = f["fp"].to_numpy(np.int64)
        pairs = _meet(fps.view(np.uint64), f["left"].to_numpy(np.int64), int(f["known"].iloc[0]))
        x, y = fps[pairs[:, 0]], fps[pairs[:, 1]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out.groupBy("known", "prefix").applyInPandas(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Every node that has an edge, with the smallest node of its component (columns node, root).

    Alternating large-star and small-star contraction; each round is written once. The edges of a node that
    has many are dealt over several tasks.
    """
    edges = settled(edges.where("a <> b"))
    n, seen = edges.count(), None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = settled(attach(both, low, ["a"], "c", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
        small = attach(down, least, ["a"], "c", 2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        edges = settled(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        n, seen = now[0], now


def group_near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns (doc_id among them), fp (long) and component_id, the smallest doc_id reachable
    over links, for every row of docs."""
    own = [f"k_{i}" for i in range(len(keys))]
    rows = docs.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], "text")
    fps = settled(fingerprints(rows, shingle, keys=tuple(own)))
    one = settled(fps.groupBy("fp").agg(F.min(own[keys.index("doc_id")]).alias("least"), F.count(F.lit(1)).alias("c")))
    rooted = components(links(one.select("fp"), radius))
    named = settled(one.join(rooted, one.fp == rooted.node, "left").select("fp", "least", "c", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = attach(named, least, ["root"], "n").select("fp", "component_id", "c")
    return attach(fps, named, ["fp"], "c").select(*[F.col(o).alias(k) for k, o in zip(keys, own)], "fp", "component_id")


def op6_simhash_dedup(spark, sf_dir):
    out = group_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _ones(h: np.ndarray) -> np.ndarray:
    """How many rows have each bit set, added up as bytes over 255 rows at a time."""
    parts = [np.add.reduce(np.unpackbits(h[i : i + 255].view(np.uint8), axis=1), axis=0, dtype=np.uint8) for i in range(0, len(h), 255)]
    return reduce(np.add, parts[1:], parts[0].astype(np.int64))


def _mixed(h: np.ndarray, columns: int) -> np.ndarray:
    """Further hashes of each hash, one a column."""
    x = h[:, None] + np.arange(1, columns + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose words are hashed at once, and the numbers for that: one for each byte, and powers of a number and its inverse.
PIECE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)], np.int8)
_BYTES = _mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1), 1)[:, 0]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... as n unsigned 64-bit numbers that wrap around."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 2 * PIECE), _powers(_INVERSE, 2 * PIECE)


def _word_hashes(text: bytes) -> np.ndarray:
    """The hash of each word, A-Z lower-cased, in order: a polynomial over numbers drawn for its bytes, mixed.

    All words of some PIECE bytes, cut between words, are hashed at once."""
    found, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + PIECE)
        end = space.end() if space else len(text)
        raw = np.frombuffer(text, np.uint8, end - at, at)
        edge = np.diff(_IS_SPACE[raw], prepend=np.int8(1), append=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(starts):
            up, down = (_UP, _DOWN) if len(raw) <= len(_UP) else (_powers(_BASE, len(raw)), _powers(_INVERSE, len(raw)))
            terms = _BYTES[raw] * up[: len(raw)]
            ends = ends[:-1] if ends[-1] == len(raw) else ends
            sums = np.add.reduceat(terms, np.sort(np.concatenate([starts, ends])))[::2]
            h = sums * down[starts]
            h ^= h >> np.uint64(32)
            found.append(h)
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_hashes(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The hashes of the distinct shingles, in order; each is made of the hashes of its words, all shingles at once."""
    h = _word_hashes(text) if text else np.empty(0, np.uint64)
    width = min(shingle, len(h))
    many = len(h) - width + 1 if width else 0
    out = np.full(many, width, np.uint64)
    for i in range(width):
        out += h[i : i + many]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    out.sort()
    return out[np.diff(out, prepend=~out[:1]) != 0]


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS * WORD_BITS bits as 64-bit numbers; a bit is 1 if it is set in over half the hashes of the distinct shingles."""
    columns = WORDS * WORD_BITS // 64
    if not len(hashes):
        return np.zeros(columns, np.uint64)
    count = reduce(np.add, [_ones(_mixed(hashes[i : i + 255], columns)) for i in range(0, len(hashes), 255)])
    return np.packbits(count * 2 > len(hashes)).view(np.uint64)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[list[pa.Array], list[np.ndarray], list[int]]]:
    """Of batches whose last column is a text, pieces of some HELD hashes: the other columns, the sets of shingles and their ids."""
    for b in batches:
        texts, sets, at, held = b.column(b.num_columns - 1), [], 0, 0
        for i in range(len(texts)):
            sets.append(shingle_hashes(texts[i].as_py(), shingle))
            held += len(sets[-1])
            if held > HELD or i == len(texts) - 1:
                yield [c.slice(at, len(sets)) for c in b.columns[:-1]], sets, [xxhash.xxh64_intdigest(h.tobytes()) for h in sets]
                sets, at, held = [], i + 1, 0


_MADE = {
    "id": ("long", lambda sets, ids: pa.array(np.array(ids, np.uint64).view(np.int64))),
    "n": ("int", lambda sets, ids: pa.array(list(map(len, sets)), pa.int32())),
    "hashes": ("array<long>", lambda sets, ids: _lists(sets)),
    "bits": ("array<long>", lambda sets, ids: _lists([long_fingerprint(h) for h in sets])),
}


def shingle_sets(docs: DataFrame, shingle: int, keys: tuple[str, ...], made: tuple[str, ...] = ("id", "hashes")) -> DataFrame:
    """The key columns of docs and what is asked of the set of shingles: its ``id``, its number ``n``, the ``hashes``
    themselves and ``bits``, the long fingerprint, as arrays of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, sets, ids in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([*columns, *[_MADE[m][1](sets, ids) for m in made]], names=[*keys, *made])

    kept = docs.select(*keys, F.col("text").cast("binary").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    return kept.mapInArrow(released(run), ", ".join([*kinds, *[f"{m} {_MADE[m][0]}" for m in made]]))


def _least_common(n: Column, similarity: float) -> Column:
    """How many shingles a set of n at least shares with one as similar as asked."""
    return F.ceil(n * similarity - 1e-6).cast("int")


def _sieve_prefix(n: int, similarity: float) -> int:
    """How many of a set's n shingles, those of least hashes, the sieve reads."""
    least = int(np.ceil(n * similarity - 1e-6))
    return n - least + max(1, int(SIEVE * n)) if n else 0


def sieved(docs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """id and met, of sets of docs: how many shingles in its prefix (of _sieve_prefix) another set has in its own.

    A set as similar as asked lacks so few shingles of the other that at least SIEVE of the smaller one's number
    stand in both prefixes (one at least): that of the prefix that ends first. So a set with fewer, by
    the least number that a partner of it can have, has no partner.

    A piece of texts sends a shingle once: with its set, or, where several sets of the piece have it, as met
    by these already. So no shingle has more rows than there are pieces. A set that stands in several pieces is counted
    in each on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, (_, sets, ids) in enumerate(_sets(batches, shingle)):
            once = dict(zip(ids, sets))
            own = np.fromiter(once, np.uint64, len(once)).view(np.int64)
            heads = [h[: _sieve_prefix(len(h), similarity)] for h in once.values()]
            tokens, owner = np.concatenate(heads), np.repeat(np.arange(len(own)), list(map(len, heads)))
            by = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[by].view(np.int64), owner[by]
            starts = np.flatnonzero(np.diff(tokens, prepend=~tokens[:1]) != 0)
            times = np.diff(starts, append=len(tokens))
            met = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(own))
            some = np.flatnonzero(met)
            rows = [np.concatenate(x) for x in ((tokens[starts], own[some]), (own[owner[starts]], own[some]), (np.where(times > 1, -1, 0), met[some]))]
            place = np.full(len(rows[0]), TaskContext.get().partitionId() << 32 | piece, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(place), pa.array(rows[2].astype(np.int32))], names=["token", "id", "piece", "met"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(released(run), "token long, id long, piece long, met int")
    of = Window.partitionBy("token")
    sent = F.when(F.col("met") <= 0, F.col("id"))
    several = (F.min(sent).over(of) < F.max(sent).over(of)) | (F.min("met").over(of) < 0)
    met = F.when(F.col("met") > 0, F.col("met")).when((F.col("met") == 0) & several, 1).otherwise(0)
    return rows.select("id", "piece", met.alias("met")).where("met > 0").groupBy("id", "piece").agg(F.sum("met").alias("met")).groupBy("id").agg(F.max("met").alias("met"))


def comparable_texts(docs: DataFrame, ids: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The rows (text) of docs, with texts whose sets may have a partner by the sieve; ids: id, n and text_hash of every row.

    Where the hashes of these texts are too many for a broadcast, all texts are shuffled once."""
    asked = F.greatest(F.lit(1), F.floor(SIEVE * _least_common(F.col("n"), similarity)))
    texts = ids.groupBy("text_hash").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.count(F.lit(1)).alias("c"))
    chosen = settled(attach(texts, sieved(docs, similarity, shingle), ["id"]).where(F.col("met") >= asked).select("text_hash", "c"))
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    few = chosen.count() <= SENT_ROWS
    return settled((rows.join(F.broadcast(chosen), "text_hash") if few else attach(rows, chosen, ["text_hash"], "c", ids.count())).select("text"))


def comparable_sets(sets: DataFrame, similarity: float, total: int) -> DataFrame:
    """sets: id, hashes (rows of one id are equal), total of them in all. id, n (its shingles) and shared: those that
    another row has too, the rarest first; only of ids that share enough to resemble any other.

    What two sets have in common is in shared, so these arrays verify a pair as the whole sets do."""
    tokens = sets.select("id", F.size("hashes").alias("n"), F.explode("hashes").alias("token"))
    rows = settled(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    shared = attach(tokens, rows.withColumn("c", F.col("rows")), ["token"], "c", total).groupBy("id", "n").agg(F.sort_array(F.collect_set(F.struct("rows", "token"))).alias("t"))
    return settled(shared.where(F.size("t") >= _least_common(F.col("n"), similarity)).select("id", "n", F.col("t.token").alias("shared")))


def prefixes(near: DataFrame, similarity: float) -> DataFrame:
    """near: as comparable_sets. Of each set the rarest shingles, one of which any similar set has among its own
    (id, n, token, at: its place from 1): ``first`` are those that suffice on the smaller side of a pair."""
    n, own = F.col("n"), F.col("n") - F.size("shared")
    asked = n - _least_common(n, similarity) + 1 - own
    rows = near.where(asked > 0).select("id", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), asked)).alias("k", "token"))
    at = F.col("own") + F.col("k") + 1
    return rows.select("id", "n", "token", at.alias("at"), (at <= n - _least_common(n, 2 * similarity / (1 + similarity)) + 1).alias("first"))


def exact_links(near: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """links and further verified ones, so that their components are those of all pairs as similar as asked.

    Texts that share a rare shingle are tried with one of their size first, and then each with each as far as
    they are not in one component yet; a pair goes untried only where the places of its first common shingle
    prove it apart. The texts of one shingle are dealt over a task for each TRIED_ROWS of them, and its smaller
    sides go to all of these."""
    rare = settled(prefixes(near, similarity))
    kind = F.floor(F.log(F.col("n").cast("double")) * 10)
    sized = rare.withColumn("kind", kind)
    heads = sized.groupBy("token", "kind").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
    tried = attach(sized, heads, ["token", "kind"], "c").where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    links = settled(links.unionAll(verified(tried, near, similarity)).distinct())
    rooted = components(links).select(F.col("node").alias("id"), "root")
    rare = settled(rare.join(rooted, "id", "left").withColumn("root", F.coalesce("root", "id")))
    per = rare.groupBy("token").agg(F.min("root").alias("_x"), F.max("root").alias("_y"), F.count(F.lit(1)).alias("c"))
    open_ = per.where("_x <> _y").select("token", "c", F.ceil(F.col("c") / TRIED_ROWS).cast("int").alias("tasks"))
    rare = settled(attach(rare, open_, ["token"], "c"))
    task = F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task")
    small = rare.where("first").select("token", task, *[F.col(c).alias(f"{c}_a") for c in ("id", "n", "at", "root")])
    large = rare.select("token", F.pmod(F.xxhash64("id"), "tasks").cast("int").alias("task"), *[F.col(c).alias(f"{c}_b") for c in ("id", "n", "at", "root")])
    common = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    apart = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    enough = (common >= _least_common(F.col("n_a") + F.col("n_b"), similarity / (1 + similarity))) & (F.col("n_a") >= _least_common(F.col("n_b"), similarity))
    pairs = small.join(large, ["token", "task"]).where(apart & enough & (F.col("root_a") != F.col("root_b")))
    return links.unionAll(verified(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), near, similarity))


def most_differing_bits(similarity: float) -> int:
    """How many of all bits differ between sets of this Jaccard similarity, and two standard errors more."""
    n = WORDS * WORD_BITS
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(n * share + 2 * sqrt(n * share * (1 - share)))


def long_links(distinct: DataFrame, similarity: float = 0.8) -> DataFrame:
    """distinct: id, bits, n, shared, no set twice. Links (a, b) among them, each verified by its two sets.

    Fingerprints with one word in common are linked to the one with the least id, so that only
    distinct words travel: once to each prefix within half the radius, where their variants meet."""
    half = WORD_RADIUS // 2
    known = min(WORD_PREFIX, max(1, int(np.ceil(np.log2(max(1, distinct.count()) * _ball(WORD_BITS, half) / GROUP_VARIANTS + 1)))))
    low = (1 << WORD_BITS) - 1
    word = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.struct(i.alias("place"), F.element_at("bits", F.floor(i / 2).cast("int") + 1).alias("two")))
    words = distinct.select("id", F.explode(word).alias("w")).select(
        "id", F.col("w.place").alias("place"), F.when(F.col("w.place") % 2 == 0, F.col("w.two").bitwiseAND(low)).otherwise(F.shiftrightunsigned("w.two", WORD_BITS)).alias("word")
    )
    heads = settled(words.groupBy("place", "word").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("c")))
    same_word = attach(words, heads.where("c > 1"), ["place", "word"], "c", WORDS * distinct.count()).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            w = f["word"].to_numpy(np.int64)
            rows, nexts, lefts = _spread(w.astype(np.uint64) << np.uint64(64 - WORD_BITS), np.full(len(w), half), 0, known)
            yield pd.DataFrame({"place": f["place"].to_numpy()[rows], "prefix": nexts.astype(np.int32), "word": w[rows], "head": f["head"].to_numpy()[rows], "left": lefts})

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("head")
        shifted = f["word"].to_numpy(np.int64).astype(np.uint64) << np.uint64(64 - WORD_BITS)
        pairs = _meet(shifted, f["left"].to_numpy(np.int64), known, WORD_BITS)
        heads = f["head"].to_numpy(np.int64)
        return pd.DataFrame({"a": heads[pairs[:, 0]], "b": heads[pairs[:, 1]]})

    dealt = heads.drop("c").mapInPandas(spread, "place int, prefix int, word long, head long, left int")
    met = dealt.groupBy("place", "prefix").applyInPandas(meet, "a long, b long")
    candidates = settled(same_word.unionAll(met).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = _with_both(candidates, distinct.select("id", "bits"), "bits")
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(WORDS * WORD_BITS // 64)])
    return verified(both.where(differing <= most_differing_bits(similarity)).select("a", "b"), distinct, similarity)


def _with_both(pairs: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """pairs (a, b), cut, with the column of a's row and of b's row in found (id, column)."""
    n = pairs.count()
    side = lambda x: found.select(F.col("id").alias(x), F.col(column).alias(f"{column}_{x}"))
    return attach(attach(pairs, side("b"), ["b"], total=n), side("a"), ["a"], total=n, like=pairs)


def verified(pairs: DataFrame, near: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity; near: as comparable_sets."""
    both = _with_both(settled(pairs), near.select("id", F.struct("n", "shared").alias("set")), "set")
    common = F.size(F.array_intersect("set_a.shared", "set_b.shared"))
    enough = common >= _least_common(F.col("set_a.n") + F.col("set_b.n"), similarity / (1 + similarity))
    return both.where(enough).select("a", "b")


def _grouped(docs: DataFrame, keys: list[str], similarity: float, shingle: int) -> DataFrame:
    """docs: keys, text. Every row's keys and ``first``, the least keys of its group (nulls last, as a struct).

    Sets are made anew from the texts where they are asked for: they take more room than the texts."""
    ids = settled(shingle_sets(docs.withColumn("text_hash", F.xxhash64("text")), shingle, (*keys, "text_hash"), ("id", "n")))
    order = F.struct(*[x for k in keys for x in (F.col(k).isNull().alias(f"no_{k}"), F.col(k).alias(k))])
    least = ids.groupBy("id").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("c"))
    texts = comparable_texts(docs, ids, similarity, shingle)
    total = shingle_sets(texts, shingle, (), ("n",)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = comparable_sets(shingle_sets(texts, shingle, ()), similarity, total)
    distinct = settled(near.join(shingle_sets(texts, shingle, (), ("id", "bits")).dropDuplicates(["id"]), "id"))
    links = exact_links(near, settled(long_links(distinct, similarity)), similarity)
    named = least.join(components(links), F.col("id") == F.col("node"), "left").select("id", "first", "c", F.coalesce("root", "id").alias("root"))
    named = settled(named)
    least = named.groupBy("root").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    named = settled(attach(named.drop("first"), least, ["root"], "n").select("id", "first", "c"))
    return attach(ids.drop("text_hash", "n"), named, ["id"], "c").drop("id")


def group_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns of docs (doc_id among them) and component_id, the smallest doc_id reachable over
    links of texts whose shingle sets are as similar as asked."""
    own = {k: f"k_{i}" for i, k in enumerate(sorted(keys, key="doc_id".__ne__))}
    rows = docs.select(*[F.col(k).alias(o) for k, o in own.items()], "text")
    out = _grouped(rows, list(own.values()), similarity, shingle)
    return out.select(*[F.col(own[k]).alias(k) for k in keys], F.col("first.k_0").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs less all but one of each group of near duplicates: the smallest doc_id stays, of
    rows with that doc_id (or, where the group has none, without one) the smallest text hash, and one of the
    rows that are equal in both.

    Texts without a word are not compared and all stay. Extra columns of any name are carried through."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    comparable = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    grouped = _grouped(keyed.where(comparable).select("d", "h", "text"), ["d", "h"], similarity, shingle)
    per = grouped.groupBy("d", "h").agg(F.count(F.lit(1)).alias("n"), F.max(~(F.col("d").eqNullSafe(F.col("first.d")) & (F.col("h") == F.col("first.h")))).alias("gone"))
    marked = settled(per.where("gone or n > 1").select(F.col("d").alias("d2"), F.col("h").alias("h2"), "gone"))
    marked = F.broadcast(marked) if marked.count() <= SENT_ROWS else marked
    on = F.col("d").eqNullSafe(F.col("d2")) & F.col("h").eqNullSafe(F.col("h2"))
    single = keyed.join(marked, on, "left_anti").select("row.*")
    repeated = keyed.join(marked.where("not gone"), on, "left_semi").dropDuplicates(["d", "h"]).select("row.*")
    return single.unionByName(repeated)
