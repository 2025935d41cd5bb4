"""Generic column helpers: safe casts, mapping lookups, bounds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def to_number(c: Column) -> Column:
    """Number, or null where the text is not one (ANSI mode stays on)."""
    return c.try_cast("double")


def comma_number(c: Column) -> Column:
    """Number written with a decimal comma, or null."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def clip(c: Column, low: Column, high: Column) -> Column:
    """Value kept inside [low, high]; a null bound leaves that side open."""
    return F.when(c.isNotNull(), F.greatest(low, F.least(c, high)))


def bounded_forecast(prediction: Column, capacity: Column) -> Column:
    """Clip to [0, capacity]; a missing or zero capacity leaves the forecast as it is."""
    usable = capacity.isNotNull() & (capacity != 0)
    return F.when(usable, clip(prediction, F.lit(0.0), capacity)).otherwise(prediction)


def sentinel_to_null(c: Column, sentinel: str) -> Column:
    """Null where the text equals the sentinel in any letter case."""
    return F.when(F.lower(c) == F.lit(sentinel.lower()), F.lit(None)).otherwise(c)


def literal_map(values: Mapping) -> Column:
    """Map literal of a fixed value table."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def map_value(c: Column, values: Mapping, keep: bool) -> Column:
    """Mapped value of a fixed table; unmapped input stays (``keep``) or becomes null."""
    hit = F.try_element_at(literal_map(values), c)
    return F.coalesce(hit, c) if keep else hit


def lower_names(df: DataFrame) -> DataFrame:
    """All column names in lower case."""
    return df.toDF(*[name.lower() for name in df.columns])


def null_safe(value: Column) -> Column:
    """Order key part that puts nulls last: pair it after ``isNull``."""
    return F.coalesce(value, F.lit(0.0))
