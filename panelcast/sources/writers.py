"""Sinks. Rows never pass through the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV folder with a header; parent folders are made by the writer."""
    df.write.mode("overwrite").option("sep", sep).csv(path, header=True)


def replace_parquet(df: DataFrame, path: str) -> None:
    """All-or-nothing overwrite: write beside the target, then swap by rename.

    Readers see the old table or the new one; a failed write leaves the old one in place. The new rows may be
    computed from the table they replace.
    """
    spark = df.sparkSession
    token = uuid.uuid4().hex
    staging, old = f"{path}.staging-{token}", f"{path}.old-{token}"
    df.write.parquet(staging)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    target = as_path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    had_old = fs.exists(target)
    if had_old and not fs.rename(target, as_path(old)):
        raise OSError(f"could not set aside {path}")
    if not fs.rename(as_path(staging), target):
        if had_old:
            fs.rename(as_path(old), target)
        raise OSError(f"could not move the new table to {path}")
    if had_old:
        fs.delete(as_path(old), True)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_run(spark: SparkSession, stage: str, root: str, path: str) -> None:
    """One audit row per finished stage."""
    row = spark.range(1).select(F.lit(stage).alias("stage"), F.current_timestamp().alias("generated_at_utc"),
                                F.lit(root).alias("data_root"))
    row.write.mode("append").json(path)


def write_record(df: DataFrame, path: str) -> None:
    """Nested record as JSON."""
    df.write.mode("overwrite").json(path)
