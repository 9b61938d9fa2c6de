"""Corpus sources and registries: file scan, admission, content dedup, keys, replace-by-document, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
EXTENSIONS = ("csv", "docx", "html", "json", "md", "pdf", "pptx", "txt", "xlsx")
MAGIC = {"pdf": "255044462D", "docx": "504B0304", "pptx": "504B0304", "xlsx": "504B0304"}
OFFICE = "application/vnd.openxmlformats-officedocument"
MIME = {
    "pdf": ("application/pdf",),
    "docx": (f"{OFFICE}.wordprocessingml.document", "application/zip"),
    "pptx": (f"{OFFICE}.presentationml.presentation", "application/zip"),
    "xlsx": (f"{OFFICE}.spreadsheetml.sheet", "application/zip"),
    "txt": ("text/plain",),
    "md": ("text/plain", "text/markdown"),
    "csv": ("text/csv", "text/plain"),
    "json": ("application/json", "text/plain"),
    "html": ("text/html", "text/plain"),
}
MAX_BYTES = 50 * 1024 * 1024
KEY = r"(?s)^([^/]*)/(doc_[0-9a-f]{32})(?:_.*)?$"


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content, file_size, extension of every file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.col("length").alias("file_size"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))


def admit(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds reject_reason: the first check that fails (extension, size, signature, and mime where files have a
    detected_mime, whose null fails), or null."""
    head = F.hex(F.substring("content", 1, 5))
    wrong = F.lit(False)
    for ext, magic in MAGIC.items():
        wrong = wrong | ((F.col("extension") == ext) & ~head.startswith(magic))
    reason = F.when(~F.col("extension").isin(*EXTENSIONS), "extension").when(F.col("file_size") > max_bytes, "size").when(wrong, "signature")
    if "detected_mime" in files.columns:
        fits = F.lit(False)
        for ext, kinds in MIME.items():
            fits = fits | ((F.col("extension") == ext) & F.col("detected_mime").isin(*kinds))
        reason = reason.when(~F.coalesce(fits, F.lit(False)), "mime")
    return files.withColumn("reject_reason", reason)


def first_of_content(files: DataFrame, owner: str, content: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """The first row of each (owner, SHA-256 of content), less those that ``known`` (owner, sha256) has."""
    hashed = files.withColumn("sha256", F.sha2(F.col(content), 256))
    if known is not None:
        hashed = hashed.join(known.select(owner, "sha256"), [owner, "sha256"], "left_anti")
    keep = F.struct(*[F.col(c) for c in order])
    least = hashed.groupBy(owner, "sha256").agg(F.min(keep).alias("_least"))
    first = hashed.join(least, [owner, "sha256"]).where(keep.eqNullSafe(F.col("_least"))).drop("_least")
    return first.dropDuplicates([owner, "sha256"])  # of rows that tie in order, any one


def parse_key(key: Column) -> tuple[Column, Column]:
    """(user, doc_id) of an object key, or nulls."""
    ok = key.rlike(KEY)
    return F.when(ok, F.regexp_extract(key, KEY, 1)), F.when(ok, F.regexp_extract(key, KEY, 2))


def replace_by_document(old: DataFrame, new: DataFrame, key: str = "doc_id", touched: DataFrame | None = None) -> DataFrame:
    """The old rows of documents that are not touched, and the new rows; a rerun changes nothing.

    touched has the keys of all documents that were processed, so that one that has no rows now loses its old
    ones; without it the keys of the new rows are taken."""
    keys = new if touched is None else touched.select(key).unionByName(new.select(key))
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all tasks where they come from fewer files than that."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks) if 0 < len(df.inputFiles()) < tasks else df


def promote(df: DataFrame, fields: list[str], source: str = "metadata") -> DataFrame:
    """Lifts the named keys of a map to columns, null where absent; the map stays."""
    return df.select("*", *[F.try_element_at(F.col(source), F.lit(f)).alias(f) for f in fields])


# What of a chunk's metadata is filtered by.
FILTERS = ("embedder", "section_path", "mime_type", "strategy", "root", "sheet", "sheets", "pages", "slides", "row_start", "row_end", "line_start", "line_end", "json_paths", "dom_paths", "cell_ranges")
IDENTITY = ("user_id", "doc_id", "version_id", "chunk_id", "parent_chunk_id", "chunk_type", "chunk_index", "text")


def build_payload(chunks: DataFrame) -> DataFrame:
    """What the index holds of chunks: who they are (IDENTITY), filename and parser out of their metadata (null if not
    there), section_path and locations without nulls, and ``filters``, those of FILTERS that the metadata has.

    chunks: the columns of IDENTITY, section_path, locations (arrays), metadata (map of texts). Other keys stay out."""
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    known = F.map_filter(meta, lambda k, _: k.isin(*FILTERS))
    full = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast(chunks.schema[c].dataType)).alias(c)
    return chunks.select(*IDENTITY, F.try_element_at(meta, F.lit("filename")).alias("filename"), F.try_element_at(meta, F.lit("parser")).alias("parser"), full("section_path"), full("locations"), known.alias("filters"))


def count_agreement(chunks: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_dense, n_sparse, status: FAILED where the three counts differ."""
    ids = chunks.select("doc_id", "chunk_id")
    one = lambda v, n: v.select("chunk_id").distinct().withColumn(n, F.lit(1))
    both = ids.join(one(dense, "_d"), "chunk_id", "left").join(one(sparse, "_s"), "chunk_id", "left")
    out = both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("_d").alias("n_dense"), F.count("_s").alias("n_sparse"))
    same = (F.col("n_chunks") == F.col("n_dense")) & (F.col("n_chunks") == F.col("n_sparse"))
    return out.withColumn("status", F.when(same, "EMBEDDED").otherwise("FAILED"))


def list_documents(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its number of chunks, 0 if it has none."""
    counts = chunks.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return docs.join(counts, F.col("doc_id") == F.col("_id"), "left").drop("_id").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))


def own_documents(docs: DataFrame, chunks: DataFrame, owner: str, created: str) -> DataFrame:
    """list_documents with ``place``: from 1 for each owner's newest document on (ties by doc_id)."""
    listed = list_documents(docs, chunks)
    return listed.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.col(created).desc(), "doc_id")).cast("long"))


def owned(df: DataFrame, key: str, value, owner: str, user) -> DataFrame:
    """The row of that key if it belongs to the user, else nothing."""
    return df.where((F.col(key) == value) & (F.col(owner) == user))


def top_per(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= n)
