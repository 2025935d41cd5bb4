"""Profiles: null counts, distributions, value counts, gaps, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window, functions as F

from panelcast.operators.quantiles import exact_quantiles

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column from one scan."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "nulls")


def describe(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, over everything or per group."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"))
    quarters = exact_quantiles(df, keys, column, QUARTILES)
    if keys:
        return base.join(quarters, keys, "left")
    row = quarters.select(F.struct(*QUARTILES)).scalar()
    return base.withColumn("_q", row).select("*", "_q.*").drop("_q")


def five_numbers(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Box-plot numbers per category."""
    ends = df.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("min"),
                                                                   F.max(column).alias("max"))
    return ends.join(exact_quantiles(df, keys, column, QUARTILES), list(keys))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins between the smallest and the largest value; the last bin is closed."""
    v = F.col(column)
    known = df.filter(v.isNotNull())
    ends = known.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    low, width = ends["low"], F.nullif(ends["high"] - ends["low"], F.lit(0.0))
    bucket = F.coalesce(F.least(F.lit(bins - 1), F.floor((v - low) * bins / width)), F.lit(0))
    return known.groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; equal counts in value order."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.orderBy(F.col("rows").desc(), F.col(column)).limit(n)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix as (left, right, r) rows, both triangles, from one aggregation."""
    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("left"), F.lit(y).alias("right"), F.col(f"r{i}").alias("r")))
    return row.select(F.inline(F.array(*cells)))


def seasonal_profile(panel: DataFrame) -> DataFrame:
    """Median storage of all entities per ISO week."""
    weeks = panel.select(F.weekofyear("date").alias("week_of_year"), "storage")
    return exact_quantiles(weeks, ["week_of_year"], "storage", {"median_storage": 0.5})


def rows_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def date_gaps(df: DataFrame) -> DataFrame:
    """Days since the previous reading of the same entity."""
    by_date = Window.partitionBy("id").orderBy("date")
    return df.select("id", "date", F.datediff("date", F.lag("date").over(by_date)).alias("gap_days"))


def gap_frequencies(df: DataFrame) -> DataFrame:
    gaps = date_gaps(df).filter(F.col("gap_days").isNotNull())
    return gaps.groupBy("gap_days").agg(F.count(F.lit(1)).alias("rows"))


def largest_gap_ids(df: DataFrame, sizes: int = 2) -> DataFrame:
    """Entities that show one of the largest distinct gaps."""
    gaps = date_gaps(df).filter(F.col("gap_days").isNotNull())
    top = gaps.select("gap_days").distinct().orderBy(F.col("gap_days").desc()).limit(sizes)
    return gaps.join(top, "gap_days", "left_semi").select("id").distinct()


def above_capacity_share(panel: DataFrame, capacity: DataFrame) -> DataFrame:
    """Entities with a reading above, and with a reading within, capacity."""
    flags = panel.join(capacity, "id").groupBy("id").agg(
        F.max(F.col("storage") > F.col("capacity")).alias("above"),
        F.max(F.col("storage") <= F.col("capacity")).alias("within"))
    return flags.agg(F.count_if("above").alias("above"), F.count_if("within").alias("within"))


def latest_date_share(panel: DataFrame) -> DataFrame:
    """Entities with and without a reading on the newest date."""
    last = panel.groupBy("id").agg(F.max("date").alias("last_date"))
    newest = panel.agg(F.max("date")).scalar()
    return last.agg(F.count_if(F.col("last_date") == newest).alias("with_data"),
                    F.count_if(F.col("last_date") < newest).alias("without_data"))


def repeated_keys(df: DataFrame, key: str, at_least: int = 3) -> DataFrame:
    """Rows whose key occurs at least that often."""
    often = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") >= at_least))
    return df.join(often, key, "left_semi")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Surplus copies of whole rows."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def starts_on(df: DataFrame, date: str) -> DataFrame:
    """Distinct entities, and how many of them begin on a given date."""
    first = df.groupBy("id").agg(F.min("date").alias("first_date"))
    return first.agg(F.count(F.lit(1)).alias("entities"),
                     F.count_if(F.col("first_date") == F.lit(date).cast("date")).alias("starting"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per text column, as (column, value) rows."""
    return df.unpivot([], list(columns), "column", "value").filter(F.col("value").isNotNull()).distinct()
