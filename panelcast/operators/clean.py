"""Raw readings to a weekly panel, and dimension cleaning.

A panel group (one entity) is bounded by the calendar: its dates are unique, so an entity that owns a third of the
raw readings still owns at most one panel row per week. Readings are therefore aggregated per (entity, date)
before anything is shuffled by entity, and windows by entity are safe at any data volume.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast import config
from panelcast.functions.columns import comma_number, lower_names, map_value, sentinel_to_null, to_number
from panelcast.functions.dates import parse_date
from panelcast.functions.text import name_key
from panelcast.operators.spatial import fill_from_nearest


def by_date():
    return Window.partitionBy("id").orderBy("date")


def newest_first():
    """Newest first with a running frame: linear, where "current row to the end" would rescan the rest each time."""
    return (Window.partitionBy("id").orderBy(F.col("date").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))


def standard_columns(df: DataFrame, mapping: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename by mapping and drop columns that happen to be present."""
    return df.withColumnsRenamed(dict(mapping)).drop(*drop)


def parse_readings(df: DataFrame) -> DataFrame:
    """Typed readings from text columns; bad numbers become null, rows without a key are dropped."""
    return (df.withColumn("storage", to_number(F.col("storage").cast("string")))
            .withColumn("date", parse_date(F.col("date").cast("string")))
            .na.drop(subset=["id", "date"]))


def require_dates(df: DataFrame) -> None:
    """Raise with up to three examples when a date text can be read by neither pass."""
    bad = df.filter(parse_date(F.col("date").cast("string")).isNull()).select("date").limit(3).collect()
    if bad:
        raise ValueError(f"invalid dates, examples: {[row['date'] for row in bad]}")


def reading_violations(df: DataFrame) -> DataFrame:
    """Unreadable dates, negative values and surplus rows per (id, date) of raw readings, from one scan."""
    per_key = (df.select("id", parse_date(F.col("date").cast("string")).alias("_d"),
                         to_number(F.col("storage").cast("string")).alias("_v"))
               .groupBy("id", "_d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") < 0).alias("neg")))
    keyed = F.col("id").isNotNull() & F.col("_d").isNotNull()
    return per_key.agg(F.coalesce(F.sum(F.when(F.col("_d").isNull(), F.col("n"))), F.lit(0)).alias("unreadable_dates"),
                       F.coalesce(F.sum("neg"), F.lit(0)).alias("negative_values"),
                       F.coalesce(F.sum(F.when(keyed, F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"))


def exclude_periods(df: DataFrame, rules: Sequence[tuple[int, int]] = tuple(config.SOURCE_EXCLUSIONS)) -> DataFrame:
    """Drop an entity's readings before its rule year. The rules are a short fixed list, so this is a filter."""
    bad = F.lit(False)
    for entity, before_year in rules:
        bad = bad | ((F.col("id") == entity) & (F.year("date") < before_year))
    return df.filter(~bad)


def exclude_periods_by_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Same, driven by a rule table ``id, before_year`` of any size."""
    r = rules.select(F.col("id").alias("_rule_id"), "before_year")
    return df.join(r, (F.col("id") == F.col("_rule_id")) & (F.year("date") < F.col("before_year")), "left_anti")


def weekly_grid(df: DataFrame, days: int = config.GRID_DAYS) -> DataFrame:
    """One row per entity and week from its first to its last date; missing weeks have null storage.

    Each on-grid reading expands into itself and the empty weeks up to the next one, so the grid needs one
    shuffle and no join. Readings off the grid of the first date drop out.
    """
    whole = Window.partitionBy("id")
    spaced = (df.withColumn("_first", F.min("date").over(whole)).withColumn("_last", F.max("date").over(whole))
              .filter(F.datediff("date", "_first") % days == 0)
              .withColumn("_next", F.lead("date").over(by_date())))
    step = F.expr(f"interval {days} days")
    stop = F.coalesce(F.date_sub("_next", days), F.col("_last"))
    return (spaced.withColumn("_week", F.explode(F.sequence("date", stop, step)))
            .select("id", F.col("_week").alias("date"),
                    F.when(F.col("_week") == F.col("date"), F.col("storage")).alias("storage")))


def flag_and_backfill(grid: DataFrame) -> DataFrame:
    """Flag missing weeks, take the next known value of the same entity, drop a tail that has none."""
    return (grid.withColumn("storage_imputed", F.col("storage").isNull().cast("int"))
            .withColumn("storage", F.last("storage", ignorenulls=True).over(newest_first()))
            .filter(F.col("storage").isNotNull()))


def weekly_panel(readings: DataFrame, days: int = config.GRID_DAYS) -> DataFrame:
    """Gap-free weekly panel with flagged back-fills.

    Equal to ``flag_and_backfill(weekly_grid(readings))`` in one pass: a reading and the empty weeks after it take
    the next known value, so a single sort per entity does both steps.
    """
    first = F.min("date").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    spaced = (readings.withColumn("_first", first).filter(F.datediff("date", "_first") % days == 0)
              .withColumns({"_next": F.lead("date").over(by_date()),
                            "_known": F.expr("lead(storage) IGNORE NULLS OVER (PARTITION BY id ORDER BY date)")}))
    stop = F.coalesce(F.date_sub("_next", days), F.col("date"))
    own = F.when(F.col("_week") == F.col("date"), F.col("storage"))
    return (spaced.withColumn("_week", F.explode(F.sequence("date", stop, F.expr(f"interval {days} days"))))
            .select("id", F.col("_week").alias("date"), F.coalesce(own, F.col("_known")).alias("storage"),
                    own.isNull().cast("int").alias("storage_imputed"))
            .filter(F.col("storage").isNotNull()))


def off_grid_count(df: DataFrame, days: int = config.GRID_DAYS) -> DataFrame:
    """How many readings the grid leaves out, per entity."""
    first = F.min("date").over(Window.partitionBy("id"))
    return (df.withColumn("_off", (F.datediff("date", first) % days != 0).cast("int"))
            .groupBy("id").agg(F.sum("_off").alias("off_grid")))


def fill_capacity(entities: DataFrame, panel: DataFrame) -> DataFrame:
    """Missing capacity becomes the largest storage ever seen, flagged."""
    peak = panel.groupBy("id").agg(F.max("storage").alias("_peak"))
    return (entities.join(peak, "id", "left").withColumn("capacity_imputed", F.col("capacity").isNull())
            .withColumn("capacity", F.coalesce("capacity", "_peak")).drop("_peak"))


def clean_entities(raw: DataFrame, panel: DataFrame) -> DataFrame:
    """Entity table: standard names, numeric capacity with fallback, comparable names."""
    df = standard_columns(raw, config.RESERVOIR_COLUMNS)
    df = df.withColumn("capacity", to_number(F.col("capacity").cast("string")))
    return fill_capacity(df, panel).withColumns({"name": name_key(F.col("name")), "scope": name_key(F.col("scope"))})


def best_row_per_key(df: DataFrame, key: str, best: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order.

    A ``min_by`` aggregate keeps one row per key and task before the shuffle, so a key that owns a third of the
    rows costs no more than any other; a ranked window would sort them all in one task.
    """
    others = [c for c in df.columns if c != key]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(best)])
    row = F.min_by(F.struct(*others), rank) if others else F.lit(None)
    return df.groupBy(key).agg(row.alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in others]) \
        .select(df.columns)


def tallest_per_name(df: DataFrame, tie: str = "id") -> DataFrame:
    """Keep the row with the greatest dam height per name, nulls last."""
    height = F.col("dam_height")
    return best_row_per_key(df, "name", [height.isNull(), -F.coalesce(height, F.lit(0.0)), F.col(tie)])


def clean_details(raw: DataFrame, tie: str = "id") -> DataFrame:
    """Detail table: plain names, decimal commas, nearest-neighbour fill, one row per name."""
    df = standard_columns(lower_names(raw), config.DETAIL_COLUMNS, drop=["code"])
    named = [c for c in ("name", "basin", "province", "autonomous_community", "type") if c in df.columns]
    df = df.withColumns({c: name_key(F.col(c)) for c in named}).drop("reservoir")
    df = df.withColumns({c: comma_number(F.col(c).cast("string")) for c in ("longitude", "latitude")})
    df = df.withColumn("riverbed", sentinel_to_null(F.col("riverbed"), config.UNNAMED))
    for column in ("riverbed", "crest_elevation"):
        df = fill_from_nearest(df, column, tie)
    df = df.withColumn("riverbed", name_key(F.col("riverbed")))
    df = df.withColumns({c: comma_number(F.col(c).cast("string")) for c in ("crest_elevation", "dam_height")})
    return tallest_per_name(df, tie)


def cap_at_capacity(panel: DataFrame, capacity: DataFrame) -> DataFrame:
    """Storage limited to the entity's capacity; a reading without a known capacity stays as it is."""
    return (panel.join(capacity.select("id", "capacity"), "id", "left")
            .withColumn("storage", F.least("storage", "capacity")).drop("capacity"))


def unify_province(df: DataFrame, mapping: Mapping[str, str] = config.UNIFIED_PROVINCES) -> DataFrame:
    return df.withColumn("province", map_value(F.col("province"), mapping, keep=True))


def community_of(df: DataFrame, mapping: Mapping[str, str] = config.PROVINCE_TO_COMMUNITY) -> DataFrame:
    return df.withColumn("autonomous_community", map_value(F.col("province"), mapping, keep=False))
