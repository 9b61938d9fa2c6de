"""A chunk store of append-only parts with versions of documents, tombstones and compaction.

Below its path a store has ``parts/seq=N`` (the chunks that commit N has written, with the version of their
document), ``versions/seq=N`` (a row for every document of the commit: version, number of chunks, 0 for one that
has none any more), and ``commits/seq=N``, a single small file that is written last. What has no commit is not
seen, so a batch that fails half-way leaves the store as it was, and a batch that comes again under its name does
nothing. A commit writes its own chunks and reads none of the store's but the list of commits.

The chunks of a document are those of its last version. Compaction writes all of them as a new commit, from which
reading then starts; ``vacuum`` deletes what no reading needs any more. A store has one writer at a time; readers
may read while it writes, but not what vacuum deletes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch string, kind string, seq long"


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def commits(self) -> list:
        """(batch, kind, seq) of every commit in their order; compaction keeps their number small."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return sorted(rows, key=lambda r: r.seq)

    def _write(self, batch: str, kind: str, chunks: DataFrame, versions, seq: int) -> int:
        """versions is asked for once the chunks are written, so that it may be counted from them."""
        chunks.write.mode("overwrite").parquet(f"{self.path}/parts/seq={seq}")
        versions(self.spark.read.schema(chunks.schema).parquet(f"{self.path}/parts/seq={seq}")).write.mode("overwrite").parquet(f"{self.path}/versions/seq={seq}")
        self.spark.createDataFrame([(batch, kind)], "batch string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/seq={seq}")
        return seq

    def put(self, documents: DataFrame, chunks: DataFrame, batch: str) -> int:
        """Makes chunks what the store has of documents (the key column; every one of them, also those without a
        chunk, which vanish) and tells the commit's number. Chunks of other documents, or without a key, are not taken.

        All puts of a store have the same columns."""
        done = self.commits()
        for c in done:
            if c.batch == batch:
                return c.seq
        seq, key = (done[-1].seq + 1 if done else 1), self.key
        keys = documents.select(key).where(F.col(key).isNotNull()).distinct()
        own = chunks.join(keys, key, "left_semi").withColumn("version", F.lit(seq).cast("long"))

        def versions(written: DataFrame) -> DataFrame:
            counts = written.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"))
            return keys.join(counts, key, "left").select(key, F.lit(seq).cast("long").alias("version"), F.coalesce("n_chunks", F.lit(0)).cast("long").alias("n_chunks"))

        return self._write(batch, "put", own, versions, seq)

    def _seen(self, as_of: int | None) -> list[int]:
        """The commits that a reading as of one of them needs: from the last compaction before it on."""
        own = [c for c in self.commits() if as_of is None or c.seq <= as_of]
        if as_of is not None and not any(c.seq == as_of for c in own):
            raise ValueError(f"no commit {as_of}")
        start = max((c.seq for c in own if c.kind == "compact"), default=0)
        return [c.seq for c in own if c.seq >= start]

    def _table(self, name: str, seqs: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}/seq={n}" for n in seqs])

    def versions(self, as_of: int | None = None) -> DataFrame:
        """key, version, n_chunks of the last version of every document; those without chunks included until a compaction."""
        rows = self._table("versions", self._seen(as_of))
        last = rows.groupBy(self.key).agg(F.max(F.struct("version", "n_chunks")).alias("x"))
        return last.select(self.key, "x.version", "x.n_chunks")

    def read(self, as_of: int | None = None) -> DataFrame:
        """The chunks of the last version of every document, now or as of a commit, with that version.

        Only documents with several versions are looked up, so that a large store with few changes is read as it is."""
        seqs = self._seen(as_of)
        rows, known = self._table("parts", seqs), self._table("versions", seqs)
        if len(seqs) == 1:
            return rows
        last = known.groupBy(F.col(self.key).alias("_key")).agg(F.max("version").alias("_last"), F.min("version").alias("_first")).where("_first < _last")
        return rows.join(last.select("_key", "_last"), (F.col(self.key) == F.col("_key")) & (F.col("version") < F.col("_last")), "left_anti")

    def compact(self, batch: str) -> int:
        """Writes what read gives as a commit of its own; tombstones end here."""
        done = self.commits()
        for c in done:
            if c.batch == batch:
                return c.seq
        counts = lambda written: written.groupBy(self.key, "version").agg(F.count(F.lit(1)).alias("n_chunks"))
        return self._write(batch, "compact", self.read(), counts, done[-1].seq + 1)

    def vacuum(self) -> list[int]:
        """Deletes parts and versions from before the last compaction; their commits stay known by name."""
        needed, gone = set(self._seen(None)), []
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for c in self.commits():
            for name in ("parts", "versions"):
                folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/seq={c.seq}")
                if c.seq not in needed and folder.getFileSystem(conf).delete(folder, True) and name == "parts":
                    gone.append(c.seq)
        return gone
