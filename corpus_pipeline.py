"""The corpus pipeline: documents to packed training sequences.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next stage's docs. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import decontaminate, jaccard_join, packing, quality_classifier, substring_dedup
from rasterloom.llm._session import discard, discarded_at_exit, prepared, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 1. Null texts are scored as empty ones."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs.select(COLUMNS), model, to="__score").filter("__score >= 0.5").drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id; rows with a null doc_id stay."""
    return jaccard_join.without_copies(docs.select(COLUMNS)).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur elsewhere; n_chars follows the text."""
    out = substring_dedup.dedup_substrings(docs.select(COLUMNS))
    changed = F.col("n_removed") > 0
    out = out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, each with its place in a sequence."""
    pieces = packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", sequences),
]

#: Learned trees, components and tokenisers can't be told in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir. What a stage wrote goes when the next one has read it, the last result with the session."""
    prepared(spark)
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{n}")
        if n:
            discard(spark, f"{base}/{n - 1}")
        else:
            discarded_at_exit(spark, base)
        docs = spark.read.parquet(f"{base}/{n}")
    return docs
