"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` applies them in turn. Stages that hand rows to Python bound the session's Arrow batches
(``small_batches``): one executor runs all stages, and what one of them took adds to what the next needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import decontamination, line_dedup, packing, quality_classifier, simhash_dedup
from sluicework.llm.common import cut, small_batches

#: A document goes if the classifier's score for good quality is below this.
LEAST_SCORE = 0.3


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects; it learns from the labelled ones among them.

    Null and empty texts get the score of a text without n-grams, so they stay or go together; repeated rows
    are scored each, and ties with LEAST_SCORE stay. Very long texts are scored whole. Without labels nothing
    is rejected. An empty table stays empty, extra columns of any name stay."""
    small_batches(spark)
    model = quality_classifier.train(docs.where(~quality_classifier.held_out(F.col("doc_id"))), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= LEAST_SCORE).select(*_own(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated runs of lines; n_chars, where documents has it, follows the text.

    Null and empty texts stay as they are. Of documents with equal runs the smallest doc_id keeps them, and a
    document of which no word is left goes; repeated rows share one result. A very long text is one document
    like others. An empty table stays empty, extra columns of any name stay."""
    out = line_dedup.dedup_lines(docs).select(*_own(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (0.8 of five-word shingles): the smallest doc_id.

    Null, empty and wordless texts are in no group and stay. Of rows with the same doc_id the smallest text
    hash stays, of repeated rows one; groups without any doc_id keep one row. Very long texts are compared by
    all their shingles. An empty table stays empty, extra columns of any name stay."""
    small_batches(spark)
    return simhash_dedup.drop_near_duplicates(docs, similarity=0.8, shingle=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of benchmark text.

    Null and empty texts hold none and stay; repeated rows go or stay together; very long texts are searched
    whole. Null benchmark texts match nothing. Empty tables drop nothing, extra columns of any name stay."""
    small_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens.

    A null or empty text is one piece of its end alone; a very long one is cut into pieces. Repeated rows are
    packed each, and which of two equal pieces comes first is left open. An empty table gives no pieces; of
    documents only doc_id and text are read."""
    small_batches(spark)
    return packing.pack(docs, packing.tokenizer_path()).drop("ids")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("best-fit packing", packed)]

#: A learned classifier and a tokenizer are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
