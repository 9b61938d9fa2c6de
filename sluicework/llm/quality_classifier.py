"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams of the whole text, hashed into ``BUCKETS`` places. Each is
scaled by the log ratio of its smoothed frequency under the two labels (counted over all labelled
training rows, in Spark), rows are scaled to unit length, and a linear hinge-loss model is fitted to
them by dual coordinate descent. A logistic curve fitted to margins of rows that the model has not
seen turns margins into scores.

The counts cover every labelled training row; the descent runs in one task on a sample of about
``FIT_ROWS`` of them, fewer where their n-grams would take more than ``FIT_BYTES``, drawn by the hash of
doc_id and text, with every n-gram of their whole texts.

Defined cases: a null or empty text has no n-grams and gets the score of a margin equal to the bias. A very
long text has at most BUCKETS distinct n-grams and is read as a whole. Labels other than 0 and 1, and null
ones, are ignored; a row with several labels is counted for each, a repeated row each time (its copies are
drawn together). A null doc_id is never labelled and not held out. With fewer than two labels in the
training rows, every score is their mean (0.5 without any); an empty table has no scores. Extra columns, of
any name, are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, released

BUCKETS = 1 << 18
#: n-gram lengths in bytes.
ORDERS = (2, 3, 4)
#: Labelled rows that the descent is fitted to, about; a quarter of them sets the logistic curve.
FIT_ROWS = 12_000
#: Bytes of their n-grams, about; one row has at most 4 * BUCKETS.
FIT_BYTES = 256 << 20
#: Labels are broadcast up to this number of rows (of 12 bytes); beyond it both sides are shuffled.
BROADCAST_LABELS = 1_000_000
EPOCHS, COST = 8, 1.0
_CHUNKS = 64


def features(text: bytes | None) -> np.ndarray:
    """The places of the n-grams that the text has, each once."""
    b = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    parts = []
    for n in ORDERS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, np.uint32)
            for j in range(n):
                h = (h ^ b[j : len(b) - n + 1 + j]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            parts.append(h & np.uint32(BUCKETS - 1))
    return np.unique(np.concatenate(parts)).astype(np.int32) if parts else np.empty(0, np.int32)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    labels = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return docs.select("doc_id", F.col("text").cast("binary").alias("_text")).join(labels, F.col("doc_id") == F.col("_id")).select("_id", "_y", "_text")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS), np.int64)
    rows = np.zeros(2, np.int64)
    for b in batches:
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            counts[y, features(t)] += 1
            rows[y] += 1
    if not rows.any():
        return
    parts = counts.reshape(2, _CHUNKS, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(_CHUNKS), pa.int32()), *[pa.array([parts[y, c].tobytes() for c in range(_CHUNKS)], pa.binary()) for y in (0, 1)], *[pa.array([int(rows[y])] * _CHUNKS, pa.int64()) for y in (0, 1)]],
        names=["chunk", "c0", "c1", "n0", "n1"],
    )


def _add(f: pd.DataFrame) -> pd.DataFrame:
    total = {c: sum((np.frombuffer(x, np.int64) for x in f[c]), np.zeros(BUCKETS // _CHUNKS, np.int64)).tobytes() for c in ("c0", "c1")}
    return pd.DataFrame({"chunk": [f["chunk"].iloc[0]], **{c: [v] for c, v in total.items()}, "n0": [f["n0"].sum()], "n1": [f["n1"].sum()]})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and a bias, by dual coordinate descent with the L1 hinge loss."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    share = np.bincount((y > 0).astype(int), minlength=2) / max(1, len(y))
    upper = cost * np.where(y > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9))  # both labels weigh the same
    lengths = [max(1e-12, float(np.sqrt((ratio[r] ** 2).sum()))) for r in rows]  # the scaled rows themselves take twice the room of rows
    order, rng = np.arange(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            r, s = rows[i], sign[i]
            v = ratio[r] / lengths[i]
            gradient = s * (float(w[r] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # the row's squared length with its bias entry is 2
            if step := new - alpha[i]:
                alpha[i] = new
                w[r] += step * s * v
                bias += step * s
    return w, bias


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of y over margin, by Newton steps with smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        d, g = np.maximum(p * (1 - p), 1e-9), p - target
        grad = np.array([(g * margin).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(d * margin * margin).sum() + 1e-3, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


class Model:
    """weight: of each place, ratio included; square: the squared ratios; margin = sum(weight) / sqrt(sum(square)) + bias."""

    def __init__(self, weight, square, bias, slope, intercept, constant=None):
        self.weight, self.square, self.bias, self.slope, self.intercept, self.constant = weight, square, bias, slope, intercept, constant

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        margin = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = features(t)
            margin[i] = self.bias + (self.weight[f].sum() / max(1e-12, np.sqrt(self.square[f].sum())) if len(f) else 0.0)
        return _sigmoid(self.slope * margin + self.intercept)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Learns from all rows of docs that have a label; leave held-out rows out of docs beforehand."""
    rows = _labelled(docs, labels, label)
    counted = rows.select("_y", "_text").mapInArrow(released(_count), "chunk int, c0 binary, c1 binary, n0 long, n1 long")
    total = sorted(counted.groupBy("chunk").applyInPandas(_add, "chunk int, c0 binary, c1 binary, n0 long, n1 long").collect(), key=lambda r: r["chunk"])
    n0, n1 = (total[0]["n0"], total[0]["n1"]) if total else (0, 0)
    if not n0 or not n1:
        return Model(None, None, 0.0, 0.0, 0.0, constant=(0.5 if not n0 + n1 else float(n1 > 0)))
    have = [np.concatenate([np.frombuffer(r[c], np.int64) for r in total]) + 1.0 for c in ("c0", "c1")]
    ratio = np.log(have[1] / have[1].sum()) - np.log(have[0] / have[0].sum())
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["h", "y", "f"])

    def fit(f: pa.Table) -> pa.Table:
        give_back()
        by = np.argsort(f["h"].to_numpy())
        r = [np.frombuffer(x.as_buffer(), np.int32) for x in f["f"]]  # where Arrow has them
        r, y = [r[i] for i in by], f["y"].to_numpy()[by]
        ratio = shared.value
        own = np.arange(len(r)) % 4 > 0
        if len(set(y[own])) < 2 or len(set(y[~own])) < 2:
            own[:] = True
        w, bias = fit_hinge([x for x, o in zip(r, own) if o], y[own], ratio)
        rest = np.flatnonzero(~own) if not own.all() else np.arange(len(r))
        margin = np.array([bias + (float(w[r[i]] @ ratio[r[i]]) / max(1e-12, float(np.sqrt((ratio[r[i]] ** 2).sum()))) if len(r[i]) else 0.0) for i in rest])
        a, b = fit_curve(margin, y[rest])
        return pa.table({"w": pa.array([w.astype(np.float32).tobytes()], pa.binary()), "bias": [float(bias)], "a": [float(a)], "b": [float(b)]})

    seen = int(sum(h.sum() - BUCKETS for h in have))  # n-grams of all rows, each of four bytes
    share = min(1.0, fit_rows / (n0 + n1), FIT_BYTES / max(1, 4 * seen))
    drawn = rows.withColumn("_h", F.xxhash64("_id", "_text"))
    if share < 1:
        drawn = drawn.where(F.col("_h") < int(share * 2.0**64) - (1 << 63))
    got = drawn.select("_h", "_y", "_text").mapInArrow(released(extract), "h long, y int, f binary").groupBy(F.lit(0).alias("g")).applyInArrow(fit, "w binary, bias double, a double, b double").collect()
    shared.unpersist()
    if not got:
        return Model(None, None, 0.0, 0.0, 0.0, constant=n1 / (n0 + n1))
    w = np.frombuffer(got[0]["w"], np.float32).astype(np.float64)
    return Model(w * ratio, ratio**2, got[0]["bias"], got[0]["a"], got[0]["b"])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of docs with a last double column, higher where label 1 is likelier; underscores follow its
    name where docs has a column of that name."""
    name = fresh(docs.columns, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.scores(texts), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op4_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
