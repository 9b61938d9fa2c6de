"""The two arms of search: nearest vectors and BM25, exact, for any number of queries.

Few queries of a checked size (SMALL_QUERIES, SMALL_BYTES) are broadcast and the index is read where it stands.
Beyond that queries and index are dealt to tiles, each a part of the queries against a part of the index, of at
most about TILE_QUERIES and TILE_ROWS rows; a task holds one tile, whatever the sizes of both tables. In a scoped
search rows are dealt by their user first, so that only what a query may see meets it, and a user who holds a
large share of all rows has as many tiles as that share needs. A tile scores CHUNK rows of the index at a time and
keeps each query's k best; those of all tiles are ranked together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.registry import spread, top_per

SMALL_QUERIES, SMALL_BYTES = 2_000, 32 << 20
TILE_QUERIES, TILE_ROWS, TILE_LEAST, CHUNK = 5_000, 100_000, 1_000, 1_024
#: Most groups that users are dealt into; their sizes are the only thing collected.
BUCKETS = 4_096
#: Numbers of a matrix of words, up to which the words of queries and rows are multiplied as such.
DENSE = 8 << 20
#: Scores that are equal to so many places tie.
PLACES = 9


class Best:
    """The k best rows of each query so far, as an Arrow table; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, kind: pa.DataType):
        self.k, self.queries = k, queries
        self.rows = pa.table({"q": pa.array([], pa.int64()), "r": pa.array([], pa.float64()), "id": pa.array([], kind), "score": pa.array([], pa.float64())})
        self.floor = np.full(queries, -np.inf)

    def add(self, asked: np.ndarray, ids: pa.ChunkedArray, scores: np.ndarray, can: np.ndarray | None) -> None:
        """scores[i, j] of query asked[i] and row j, where can[i, j]; rows are in the order of their ids."""
        r = np.round(scores, PLACES)
        r[np.isnan(r)] = -np.inf
        if can is not None:
            r[~can] = -np.inf
        r[r < self.floor[asked, None]] = -np.inf
        n = r.shape[1]
        if n > self.k:
            least = np.partition(r, n - self.k, axis=1)[:, n - self.k, None]
            tie = r == least
            room = self.k - (r > least).sum(axis=1, keepdims=True)
            keep = (r > least) | (tie & (np.cumsum(tie, axis=1) <= room))
        else:
            keep = np.ones(r.shape, bool)
        q, j = np.nonzero(keep & (r > -np.inf))
        if len(q):
            new = pa.table({"q": asked[q], "r": r[q, j], "id": ids.take(pa.array(j)), "score": scores[q, j]})
            self.rows = pa.concat_tables([self.rows, new.cast(self.rows.schema)])
            if len(self.rows) > 3 * self.k * self.queries:
                self.prune()

    def prune(self) -> pa.Table:
        rows = self.rows.sort_by([("q", "ascending"), ("r", "descending"), ("id", "ascending")])
        q = rows["q"].to_numpy()
        at = np.arange(len(q)) - np.searchsorted(q, q)
        rows = rows.filter(pa.array(at < self.k))
        self.rows = rows.combine_chunks()
        q, r, at = rows["q"].to_numpy(), rows["r"].to_numpy(), at[at < self.k]
        full = at == self.k - 1
        self.floor[q[full]] = r[full]
        return self.rows


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The lengths of a column's lists (null: 0) and all their elements."""
    column = column.combine_chunks()
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


class Cosine:
    """Cosine of vectors; 0 for those of another length, an empty or a zero one."""

    column = "vector"

    @staticmethod
    def _units(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        size, flat = lists(t["vector"])
        flat, start = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), np.cumsum(size) - size
        out = {}
        for d in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == d)
            m = flat[start[at, None] + np.arange(d)]
            n = np.sqrt((m * m).sum(axis=1, keepdims=True))
            out[d] = at, np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        return out

    def asked(self, queries: pa.Table):
        return len(queries), self._units(queries)

    def scores(self, asked, rows: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
        n, units = asked
        out = np.zeros((n, len(rows)))
        for d, (at, m) in self._units(rows).items():
            if d in units:
                out[np.ix_(units[d][0], at)] = units[d][1] @ m.T
        return out, None


class Bm25:
    """BM25 without inverse document frequency, of lists of words; a query's word counts as often as it occurs.

    The words of a chunk and of the queries are one sparse product: each common word adds the product of its
    weights in the queries and the rows that have it."""

    column = "w"

    def __init__(self, average: float, k1: float, b: float):
        self.average, self.k1, self.b = average, k1, b

    @staticmethod
    def _counted(size: np.ndarray, words: np.ndarray, seen: np.ndarray):
        """Ordered words, and for each where its rows and counts start."""
        pairs, tf = np.unique(words.astype(np.int64) * len(size) + np.repeat(np.arange(len(size)), size)[seen], return_counts=True)
        return pairs // max(1, len(size)), pairs % max(1, len(size)), tf

    def asked(self, queries: pa.Table):
        size, flat = lists(queries["w"])
        coded = flat.dictionary_encode()
        word, q, tf = self._counted(size, coded.indices.to_numpy(zero_copy_only=False), np.ones(len(flat), bool))
        edges = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
        tf, dense = tf.astype(np.float64), None
        if len(queries) * len(coded.dictionary) <= DENSE:
            dense = np.zeros((len(queries), len(coded.dictionary)))
            dense[q, word] = tf
        return len(queries), {w: i for i, w in enumerate(coded.dictionary.to_pylist())}, edges, q, tf, dense

    def scores(self, asked, rows: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
        n, known, edges, q, qtf, dense = asked
        size, flat = lists(rows["w"])
        coded = flat.dictionary_encode()
        own = np.array([known.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
        word = own[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        seen = word >= 0
        word, row, tf = self._counted(size, word[seen], seen)
        weight = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * size[row] / self.average))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        if dense is not None and len(starts) * len(rows) <= DENSE:
            weights = np.zeros((len(starts), len(rows)))
            weights[np.repeat(np.arange(len(starts)), np.diff([*starts, len(word)])), row] = weight
            out = dense[:, word[starts]] @ weights
            return out, out > 0
        out = np.zeros((n, len(rows)))
        for w, a, z in zip(word[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(word)]):
            at = slice(edges[w], edges[w + 1])
            out[np.ix_(q[at], row[a:z])] += np.multiply.outer(qtf[at], weight[a:z])
        return out, out > 0


def _scan(queries: pa.Table, parts: Iterator[pa.Table], arm, k: int, scoped: bool, kind: pa.DataType) -> pa.Table:
    """query_id, id, score of the k best rows that each query may see."""
    best = Best(len(queries), k, kind)
    users = np.array(queries["user_id"].to_pylist(), object) if scoped else None
    groups = {u: np.flatnonzero(users == u) for u in set(users)} if scoped else {None: np.arange(len(queries))}
    asked = {u: arm.asked(queries.take(pa.array(at))) for u, at in groups.items()}
    named = [set(d) if d else None for d in queries["doc_ids"].to_pylist()] if scoped else []
    for part in parts:
        for a in range(0, len(part), CHUNK):
            chunk = part.slice(a, CHUNK)
            order = pc.sort_indices(chunk["id"]).to_numpy()
            owners = np.array(chunk["user_id"].to_pylist(), object)[order] if scoped else None
            for u, at in groups.items():
                own = order[owners == u] if scoped else order
                if not len(own):
                    continue
                rows = chunk.take(pa.array(own))
                scores, can = arm.scores(asked[u], rows)
                if scoped and any(named[q] for q in at):
                    docs = rows["doc_id"].to_pylist()
                    whole = [True] * len(docs)
                    sees = np.array([[d in named[q] for d in docs] if named[q] is not None else whole for q in at])
                    can = sees if can is None else can & sees
                best.add(at, rows["id"], scores, can)
    found = best.prune()
    return pa.table({"query_id": queries["query_id"].take(found["q"]), "id": found["id"], "score": found["score"]})


def _dealt(queries: DataFrame, index: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, scoped: bool) -> DataFrame:
    spark = queries.sparkSession
    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = index.count()
    buckets = min(BUCKETS, max(cores, n // TILE_ROWS)) if scoped else 1
    most = max(TILE_LEAST, min(TILE_ROWS, n // cores))
    bucket = (F.pmod(F.xxhash64("user_id"), F.lit(buckets)) if scoped else F.lit(0)).cast("int").alias("_b")
    per = lambda df, rows: df.groupBy(bucket).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts"))
    down, across = per(queries, TILE_QUERIES).withColumnRenamed("parts", "_down"), per(index, most).withColumnRenamed("parts", "_across")
    plan = F.broadcast(down.join(across, "_b"))  # at most BUCKETS rows; users who ask nothing and users without rows drop out
    deal = lambda name, parts: F.pmod(F.xxhash64(name), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    q = queries.withColumn("_b", bucket).join(plan, "_b").withColumn("_q", deal("query_id", "_down")).withColumn("_i", every("_across")).drop("_down", "_across")
    i = index.withColumn("_b", bucket).join(plan, "_b").withColumn("_i", deal("id", "_across")).withColumn("_q", every("_down")).drop("_down", "_across")
    tile = ["_b", "_q", "_i"]
    return q.groupBy(*tile).cogroup(i.groupBy(*tile)).applyInArrow(run, schema)


def _topk(queries: DataFrame, index: DataFrame, arm, k: int, scoped: bool, tiled: bool | None, weight) -> DataFrame:
    scope_q, scope_i = (["user_id", "doc_ids"], ["user_id", "doc_id"]) if scoped else ([], [])
    q = queries.select("query_id", arm.column, *scope_q)
    i = index.where("id is not null").select("id", arm.column, *scope_i)
    if scoped:  # nobody's rows are nobody's to see
        q, i = q.where("user_id is not null"), i.where("user_id is not null")
    fields = {f.name: f.dataType.simpleString() for f in [*q.schema.fields, *i.schema.fields]}
    schema = f"query_id {fields['query_id']}, id {fields['id']}, score double"
    if tiled is None:
        n, size = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
        tiled = n > SMALL_QUERIES or size > SMALL_BYTES

    if tiled:
        def tile(asked: pa.Table, rows: pa.Table) -> pa.Table:
            return _scan(asked, iter([rows]), arm, k, scoped, rows["id"].type)

        found = _dealt(q, i, tile, schema, scoped)
    else:
        shared = q.sparkSession.sparkContext.broadcast(q.toArrow())  # at most SMALL_QUERIES rows of SMALL_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is not None and len(shared.value):
                yield from _scan(shared.value, _tables(first, batches), arm, k, scoped, first.schema.field("id").type).combine_chunks().to_batches()

        found = spread(i).mapInArrow(run, schema)
    return top_per(found, ["query_id"], [F.round("score", PLACES).desc(), F.col("id")], k)


def _tables(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    yield pa.Table.from_batches([first])
    for b in rest:
        yield pa.Table.from_batches([b])


def dense_topk(queries: DataFrame, index: DataFrame, k: int = 20, scoped: bool = False, tiled: bool | None = None) -> DataFrame:
    """query_id, id, score, rank: the k nearest of index (id, vector) by cosine to every query (query_id, vector).

    scoped: queries have user_id and doc_ids, the index user_id and doc_id, and a query sees its user's rows
    only, of its doc_ids where that is not empty; without a user it sees nothing. Ties go to the smaller id. A null
    vector is an empty one, a null component 0; rows without an id are not found. tiled: see the module; chosen by
    the size of the queries unless given."""
    cast = lambda df: df.withColumn("vector", F.col("vector").cast("array<double>"))
    size = F.greatest(F.coalesce(F.size("vector"), F.lit(0)), F.lit(0)) * 8
    return _topk(cast(queries), cast(index), Cosine(), k, scoped, tiled, size)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, scoped: bool = False, tiled: bool | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best of docs (id, text) by BM25 without inverse document frequency for
    every query (query_id, text). scoped, tiled: as in dense_topk. Rows that share no word are not found."""
    words = lambda df: df.withColumn("w", tokens(F.coalesce("text", F.lit(""))))
    index = words(docs)
    average = index.agg(F.avg(F.size("w"))).first()[0] or 1.0
    size = F.length(F.array_join("w", " "))
    return _topk(words(queries), index, Bm25(average, k1, b), k, scoped, tiled, size)
