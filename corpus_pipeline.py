"""From raw documents to a training mix: five stages, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``; n_chars follows
the text. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import curriculum, decontaminate, line_dedup, ngram_join, quality_mil
from pagemill.llm.work import removed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality_mil.learned(docs.select("doc_id", "text"), labels, F.lit(True))
    return quality_mil.scored(docs, model).filter("score >= 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that match an earlier one; a document that is left without words, a copy of earlier lines as a whole, goes."""
    kept = line_dedup.deduplicated(docs).filter("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a similarity of 0.8."""
    return ngram_join.deduplicated(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row a document, by its first position."""
    return curriculum.in_order(docs).select("doc_id", "lang", "source", "size", "source_size", "target", "copies", "taken", "positions", "first_position")


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture)]

#: SQL can't express the classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            removed(docs)  # the table of the stage before
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
