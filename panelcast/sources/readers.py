"""Scans with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).csv(path, header=True)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.OBSERVATIONS_RAW)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.ENTITIES_RAW)


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated detail table."""
    return read_csv(spark, path, schemas.DETAILS_RAW, sep="\t")


def read_staged(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A cleaned, curated or output table; Parquet carries its own schema unless one is demanded."""
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger table, empty before its first append."""
    return read_staged(spark, path, schema) if table_exists(spark, path) else spark.createDataFrame([], schema)


def sample_panel(ids: DataFrame, weeks: int = 260, start: str = "2018-01-07", noise: float = 15.0,
                 seed: int = 7) -> DataFrame:
    """Repeatable synthetic readings for the given ids, with day-first text dates."""
    rows = ids.select("id").withColumn("_week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    wave = F.lit(500.0) + F.lit(200.0) * F.sin(F.col("_week") / F.lit(26.0))
    if noise:
        # Box-Muller over hashes: the value belongs to (id, week), not to the order of rows in a partition
        def uniform(salt: int):
            bucket = F.pmod(F.xxhash64("id", "_week", F.lit(seed), F.lit(salt)), F.lit(2 ** 53))
            return (bucket.cast("double") + 1.0) / F.lit(2.0 ** 53 + 1)
        wave = wave + F.lit(noise) * F.sqrt(F.lit(-2.0) * F.log(uniform(1))) * F.cos(F.lit(2.0) * F.pi() * uniform(2))
    date = F.date_add(F.lit(start).cast("date"), F.col("_week") * 7)
    return rows.select(F.date_format(date, "dd/MM/yyyy").alias("date"), "id",
                       F.greatest(F.lit(0.0), wave).alias("storage"))
