"""Hard-negative mining by Kronecker-packed inner products.

Components are whole numbers. For each dimension the components of a pack of candidates, made positive by a
bias, stand in separated fields of one wide integer; an anchor multiplies each of these integers once by its own
component and adds them up, and a last addend keeps every field positive. The fields of the sum are the exact
scores of all candidates of the pack, less what the biases have added.

Anchors and candidates are dealt to tiles, each tile being a part of the anchors against a part of the
candidates; a tile gives its best few for each anchor, and those of an anchor are ranked together. Two passes:
the first finds each anchor's positives, the second the negatives within the margins of their scores.

Defined cases: rows with a null id or label, a null vector, or any null or non-finite component take no part.
Vectors of unequal length are as if filled up with zeros; an empty one scores 0. An anchor is never its own
positive, and of rows that share an anchor's id the least (label, then vector) is the anchor. Repeated rows count
as often as they occur; ties go to the smaller id, and between equal rows to either. Scores beyond the range of a
long are told as its ends. Anchors without a positive and positives without a negative have no row, as has an
empty table. Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.registry import top_per
from .common import partitions, settled

#: Candidates whose components share one wide integer.
PACK = 4096
#: Most rows of a side of a tile, which bounds a task's memory, and least candidates of one.
TILE_ROWS, TILE_LEAST = 100_000, 1_000
LONG = np.iinfo(np.int64)


def quantized(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component, filled up to ``width``; Python's own integers where 64 bits might not hold them."""
    size = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(256.0 * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() >= 2.0**53:
        flat = np.array([int(x) for x in flat], object)
    else:
        flat = flat.astype(np.int64)
    out = np.zeros((len(size), width), flat.dtype)
    out[np.arange(width) < size[:, None]] = flat
    return out


class Pack:
    """Candidates' components in fields of wide integers, one integer a dimension."""

    def __init__(self, components: np.ndarray, reach: int):
        """reach: the most that any component of an anchor is away from zero."""
        self.n, width = components.shape
        far = max(1, int(np.abs(components).max(initial=0)))
        self.bias, self.lift = far, width * reach * 2 * far  # biased components are 0..2 * far
        bits = max(1, (2 * self.lift).bit_length())
        self.bytes = 4 if bits <= 32 else 8 if bits <= 64 else -(-bits // 8)
        fields = components + far
        if self.bytes <= 8:
            kind = f"<u{self.bytes}"
            self.wide = [int.from_bytes(fields[:, d].astype(kind).tobytes(), "little") for d in range(width)]
            self.base = int.from_bytes(np.full(self.n, self.lift, kind).tobytes(), "little")
        else:
            wide = lambda xs: int.from_bytes(b"".join(int(x).to_bytes(self.bytes, "little") for x in xs), "little")
            self.wide, self.base = [wide(fields[:, d]) for d in range(width)], wide([self.lift] * self.n)

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The exact inner products of the anchor with all candidates."""
        total = self.base
        for a, fields in zip(anchor, self.wide):
            if a:
                total += a * fields
        data = total.to_bytes(self.n * self.bytes, "little")
        less = self.lift + self.bias * sum(anchor)
        if self.bytes <= 8 and abs(less) < 2**62:
            return np.frombuffer(data, f"<u{self.bytes}").astype(np.int64) - less
        b = self.bytes
        return np.array([int.from_bytes(data[i : i + b], "little") - less for i in range(0, len(data), b)], object)


def _first(scores: np.ndarray, can: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores among the places can; of equal ones the earlier place comes first."""
    if len(can) > 4 * k:
        own = scores[can]
        can = can[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return can[np.argsort(-scores[can], kind="stable")[:k]]


def _tile(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pack of candidates (ordered by id) and each anchor: the anchor's place, and the pack's ids, labels and scores."""
    rows = rows.sort_by("vec_id").combine_chunks()
    va, vr = (t["vector"].combine_chunks() for t in (anchors, rows))
    width = max(int(np.diff(v.offsets.to_numpy()).max(initial=0)) for v in (va, vr))
    own = quantized(va, width)
    reach = max(1, int(np.abs(own).max(initial=0)))
    asked = own.tolist()
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    every = quantized(vr, width)
    for at in range(0, len(ids), PACK):
        pack = Pack(every[at : at + PACK], reach)
        for i, a in enumerate(asked):
            yield i, ids[at : at + PACK], labels[at : at + PACK], pack.scores(a)


def _met(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """run(anchors, candidates) of every tile."""
    n, m = rows.count(), anchors.count()
    deal = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    across = max(1, -(-n // TILE_ROWS), min(partitions(rows.sparkSession), n // TILE_LEAST))
    down = max(1, -(-m // TILE_ROWS))
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = anchors.withColumn("_a", deal("anchor_id", down)).withColumn("_r", every(across))
    # equal rows differ in nothing but their place, so candidates are dealt by all they have
    r = rows.withColumn("_r", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(across)).cast("int")).withColumn("_a", every(down))
    return a.groupBy("_a", "_r").cogroup(r.groupBy("_a", "_r")).applyInArrow(run, schema)


def _falling(score: str) -> list[Column]:
    """Sort keys for decimals of any length, the highest first."""
    below, digits = F.col(score).startswith("-"), F.ltrim(F.col(score), F.lit("-"))
    size = F.length(digits)
    return [F.when(below, -size).otherwise(size).desc(), F.when(~below, digits).desc(), F.when(below, digits).asc()]


def _long(score: str) -> Column:
    at_end = F.when(F.col(score).startswith("-"), F.lit(LONG.min)).otherwise(F.lit(LONG.max))
    return F.coalesce(F.col(score).try_cast("long"), at_end)


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    embeddings: vec_id, vector, label. An anchor's positives are its best rows of the same label; of each
    positive the best rows of another label follow whose score is low..high per cent of the positive's."""
    sound = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = settled(embeddings.where(sound & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", "vector", F.col("label").cast("long").alias("label"), is_anchor.alias("_anchor")))
    least = rows.where("_anchor").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "vector")).alias("x"))
    anchors = settled(least.select("anchor_id", "x.label", "x.vector"))
    rows = rows.drop("_anchor")

    def near(a: pa.Table, r: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(a) and len(r):
            names, labels = a["anchor_id"].to_pylist(), a["label"].to_pylist()
            best: list = [[] for _ in names]
            for i, ids, kinds, scores in _tile(a, r):
                top = _first(scores, np.flatnonzero((kinds == labels[i]) & (ids != names[i])), positives)
                best[i] = sorted([*best[i], *((-scores[j], ids[j]) for j in top)])[:positives]
            found = [(n, int(x), -s) for n, own in zip(names, best) for s, x in own]
        cols = list(zip(*found)) or [[], [], []]
        return pa.table({"anchor_id": pa.array(cols[0], pa.int64()), "positive_id": pa.array(cols[1], pa.int64()), "positive_score": pa.array([str(s) for s in cols[2]], pa.string())})

    # scores pass between the passes as decimals of any length, for exact order and margins
    met = _met(anchors, rows, near, "anchor_id long, positive_id long, positive_score string")
    kept = top_per(met, ["anchor_id"], [*_falling("positive_score"), "positive_id"], positives, "place")
    asked = settled(kept.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("wanted")))
    seekers = anchors.join(asked, "anchor_id")

    def far(a: pa.Table, r: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(a) and len(r):
            labels, wanted = a["label"].to_pylist(), a["wanted"].to_pylist()
            margins = [[(-(-low * s // 100), high * s // 100) for s in (int(w["positive_score"]) for w in ws)] for ws in wanted]
            best: list = [[[] for _ in ws] for ws in wanted]
            for i, ids, kinds, scores in _tile(a, r):
                other = kinds != labels[i]
                for own, (least, most) in zip(range(len(wanted[i])), margins[i]):
                    if least <= most:
                        top = _first(scores, np.flatnonzero(other & (scores >= least) & (scores <= most)), negatives)
                        best[i][own] = sorted([*best[i][own], *((-scores[j], ids[j]) for j in top)])[:negatives]
            names = a["anchor_id"].to_pylist()
            found = [(n, w["place"], w["positive_id"], int(x), w["positive_score"], -s) for n, ws, own in zip(names, wanted, best) for w, b in zip(ws, own) for s, x in b]
        cols = list(zip(*found)) or [[]] * 6
        return pa.table({"anchor_id": pa.array(cols[0], pa.int64()), "place": pa.array(cols[1], pa.int64()), "positive_id": pa.array(cols[2], pa.int64()), "negative_id": pa.array(cols[3], pa.int64()), "p": pa.array(cols[4], pa.string()), "n": pa.array([str(s) for s in cols[5]], pa.string())})

    seen = _met(seekers, rows, far, "anchor_id long, place long, positive_id long, negative_id long, p string, n string")
    ranked = top_per(seen, ["anchor_id", "place"], [*_falling("n"), "negative_id"], negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", _long("p").alias("positive_score"), _long("n").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", F.col("embedding").alias("vector"), label.alias("label")), F.col("vec_id") % 50 == 0)


OP12_SQL = """WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
