"""Data-quality checks as small aggregate tables, plus one action that raises on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, DateType, NumericType, StringType, TimestampType


#: What a column may be asked to hold
KINDS = {"anything": DataType, "number": NumericType, "date": (DateType, TimestampType), "text": StringType}


def conform(df: DataFrame, what: str, **kinds: str) -> None:
    """Compare a table's schema with the declared one, ``column="kind"``, before any job runs on it."""
    held = {field.name: field.dataType for field in df.schema.fields}
    wrong = [f"{name} should hold {kind} and {f'is {held[name].simpleString()}' if name in held else 'is not there'}"
             for name, kind in kinds.items() if not isinstance(held.get(name), KINDS[kind])]
    if wrong:
        raise ValueError(f"{what}: {'; '.join(wrong)}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def panel_violations(df: DataFrame) -> DataFrame:
    """Null keys, negative values and surplus rows per (id, date), as one row from one shuffle."""
    conform(df, "panel", id="anything", date="anything", storage="number")
    per_key = df.groupBy("id", "date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("storage") < 0).alias("neg"))
    unkeyed = F.col("id").isNull() | F.col("date").isNull()
    return per_key.agg(F.coalesce(F.sum(F.when(unkeyed, F.col("n"))), F.lit(0)).alias("null_keys"),
                       F.coalesce(F.sum("neg"), F.lit(0)).alias("negative_values"),
                       F.coalesce(F.sum(F.when(~unkeyed, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"))


def entity_violations(df: DataFrame) -> DataFrame:
    """Surplus rows per id and non-positive capacities, as one row."""
    conform(df, "entities", id="anything", capacity="number")
    per_id = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("capacity") <= 0).alias("bad"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"),
                      F.coalesce(F.sum("bad"), F.lit(0)).alias("non_positive_capacities"))


def reference_violations(panel: DataFrame, entities: DataFrame) -> DataFrame:
    """Per id: rows without an entity, rows whose entity has no capacity, and rows above it; clean ids do not appear."""
    known = entities.select("id", "capacity", F.lit(True).alias("_known"))
    return (panel.join(known, "id", "left").groupBy("id")
            .agg(F.count_if(F.col("_known").isNull()).alias("unknown_rows"),
                 F.count_if(F.col("_known") & F.col("capacity").isNull()).alias("rows_without_capacity"),
                 F.count_if(F.col("storage") > F.col("capacity")).alias("rows_above_capacity"))
            .filter((F.col("unknown_rows") > 0) | (F.col("rows_without_capacity") > 0) | (F.col("rows_above_capacity") > 0)))


def integrality(df: DataFrame, column: str) -> DataFrame:
    """How many values are whole numbers, to decide on narrowing to an integer."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column) % 1 == 0).alias("whole_values"))


def coverage(metrics: DataFrame, ids: DataFrame, models: Sequence[str], origins: int) -> DataFrame:
    """Expected against actual (id, model) evaluation rows; a row per gap, none when coverage is complete.

    ``origins_found`` below the expected number, a missing pair, an unexpected pair or a null metric all show up.
    """
    expected = ids.select("id").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    nulls = sum((F.count_if(F.col(c).isNull()) for c in ("mae", "rmse", "nmae_capacity", "nrmse_capacity")), F.lit(0))
    actual = metrics.groupBy("id", "model").agg(
        F.count_distinct(F.when(F.col("origin").between(0, origins - 1), F.col("origin"))).alias("origins_found"),
        F.count_if(~F.col("origin").between(0, origins - 1)).alias("unexpected_origins"), nulls.alias("null_metrics"))
    both = expected.withColumn("_e", F.lit(True)).join(actual, ["id", "model"], "full_outer")
    problem = (F.when(F.col("_e").isNull(), "unexpected")
               .when(F.coalesce("origins_found", F.lit(0)) < origins, "missing_origins")
               .when(F.col("unexpected_origins") > 0, "unexpected_origins")
               .when(F.col("null_metrics") > 0, "null_metrics"))
    return (both.select("id", "model", F.coalesce("origins_found", F.lit(0)).alias("origins_found"),
                        problem.alias("problem")).filter(F.col("problem").isNotNull()))


def enforce(violations: DataFrame, what: str) -> None:
    """Raise when a violation table (one row of counters) has a counter above zero."""
    row = violations.first().asDict()
    broken = {k: v for k, v in row.items() if v}
    if broken:
        raise ValueError(f"{what}: {broken}")


def enforce_empty(violations: DataFrame, what: str) -> None:
    """Raise, with up to three examples, when a table of offending rows is not empty."""
    rows = violations.limit(3).collect()
    if rows:
        raise ValueError(f"{what}, examples: {[r.asDict() for r in rows]}")
