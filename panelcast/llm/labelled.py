"""Bounded samples of labelled rows, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FOLDS = 5


def held_out(key: str = "doc_id"):
    """Rows no classifier learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(labels: DataFrame, target: str, limits: dict[int, int]) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """``(doc_id, label, part)`` of at most ``limits[label]`` learning rows per label, and all rows per label.

    Rows are taken in the order of a hash of their id. Part 0, two thirds, serves to fit a model, part 1 to calibrate it. A row
    without id or label is no example; of repeated ids the larger label counts.
    """
    rows = (labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    chosen = []
    for label, limit in limits.items():
        own = rows.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen += [(r["doc_id"], label, i % 3 // 2) for i, r in enumerate(own.collect())]
    return chosen, counts


def texts_of(docs: DataFrame, chosen: list[tuple[int, int, int]], half: int) -> DataFrame:
    """``doc_id, text, label`` of one part; the list is bounded by the sample's limits, so it may be broadcast."""
    ids = docs.sparkSession.createDataFrame([(d, y) for d, y, h in chosen if h == half], "doc_id long, label int")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc_id"))
