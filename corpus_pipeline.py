"""From raw documents to token ids: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever they are
called. Empty tables stay empty; texts of any length are read whole.

1. Null and empty texts have the score of difference nought and stay or go by it; repeated rows share their fate.
2. Rows of equal id and text are one document of a group; null and empty texts are in no group and all stay; a null id is
   larger than any other.
3. Null and empty texts stay as they are; rows that share an id judge nothing among themselves.
4. Texts without words are not taken; rows of equal id, source and size share what is taken of them; a null source is a source.
5. One row for each row; null and empty texts have no tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import byte_bpe, compression_quality, jaccard_join, mixing, substring_dedup
from strandlake.llm.common import remove, written
from strandlake.llm.queries import BPE_RANKS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted to the labels of the training folds, does not reject."""
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return compression_quality.keep_good(docs, model, threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of documents whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each_group(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller id has too."""
    return substring_dedup.without_repeats(docs, window=50)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    ids = byte_bpe.encode(docs, BPE_RANKS)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", source_mix),
    ("byte-level BPE", tokens),
]

#: SQL cannot express the classifier, the components and the merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written and read again before the next stage, and goes when that is
    written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(spark, docs, f"pipeline-{k}")
            if before:
                remove(spark, before)
            before = path
    return docs
