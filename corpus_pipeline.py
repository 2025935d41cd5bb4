"""Corpus preparation in stages; each takes the documents that its predecessor kept.

Every stage but the last returns the columns of ``documents``. Between two stages the documents are written as Parquet
and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.llm import decontaminate, line_dedup, minhash, quality, segment
from panelcast.llm.common import materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier rejects; it learns from ``labels`` and these documents."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out multi-line chunks that occurred earlier; ``n_chars`` follows, documents left without text go."""
    out = line_dedup.clean(docs, paired=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each near-duplicate group."""
    return minhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their ids."""
    return segment.encode(docs, samples=2)


STAGES = [("quality classifier", good_quality), ("line dedup", without_repeated_lines),
          ("MinHash near-dedup", without_near_copies), ("benchmark decontamination", without_benchmark),
          ("SentencePiece encoding", encoded)]
#: A compression model can't be said in SQL; tests/llm compares the stages with plain Python instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
