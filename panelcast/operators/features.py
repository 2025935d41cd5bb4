"""Lag, rolling and calendar features over one shared (entity, date) window, so that one sort serves them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast import config
from panelcast.functions.dates import calendar
from panelcast.operators import quality as dq


def by_date():
    return Window.partitionBy("id").orderBy("date")


def trailing(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def check_sizes(*sizes: int) -> None:
    if any(not isinstance(n, int) or isinstance(n, bool) or n <= 0 for n in sizes):
        raise ValueError("lags and rolling windows need positive integers")


def lag_columns(value: str, lags: Sequence[int], prefix: str | None = None) -> dict[str, Column]:
    check_sizes(*lags)
    return {f"{prefix or value}_lag_{n}w": F.lag(value, n).over(by_date()) for n in lags}


def full_window(expr: Column, value: str, n: int) -> Column:
    """Statistic that stays null until n known values are in the window."""
    return F.when(F.count(value).over(trailing(n)) == n, expr)


def rolling_columns(value: str, windows: Sequence[int], full: bool = True) -> dict[str, Column]:
    """Rolling mean and sample deviation; with ``full`` only over complete windows."""
    check_sizes(*windows)
    out = {}
    for n in windows:
        for label, stat in (("mean", F.avg), ("std", F.stddev_samp)):
            expr = stat(value).over(trailing(n))
            out[f"{value}_{label}_{n}w"] = full_window(expr, value, n) if full else expr
    return out


def extreme_columns(value: str, windows: Sequence[int]) -> dict[str, Column]:
    check_sizes(*windows)
    return {f"{value}_{label}_{n}w": stat(value).over(trailing(n))
            for n in windows for label, stat in (("min", F.min), ("max", F.max))}


def change_columns(value: str, steps: Sequence[int]) -> dict[str, Column]:
    check_sizes(*steps)
    return {f"{value}_change_{n}w": F.col(value) - F.lag(value, n).over(by_date()) for n in steps}


def trend_columns(value: str, windows: Sequence[int], position: str = "_t") -> dict[str, Column]:
    """Least-squares slope per step over complete windows; ``position`` numbers the rows of an entity."""
    check_sizes(*windows)
    return {f"{value}_trend_{n}w":
            full_window(F.regr_slope(F.col(value), F.col(position)).over(trailing(n)), value, n) for n in windows}


def volatility_columns(value: str, windows: Sequence[int]) -> dict[str, Column]:
    """Deviation divided by mean over complete windows; null for a zero mean."""
    out = {}
    for n in windows:
        mean, std = F.avg(value).over(trailing(n)), F.stddev_samp(value).over(trailing(n))
        out[f"{value}_volatility_{n}w"] = full_window(std / F.nullif(mean, F.lit(0.0)), value, n)
    return out


def distance_to_mean_columns(value: str, windows: Sequence[int]) -> dict[str, Column]:
    return {f"{value}_vs_{n}w_mean": F.col(value) - F.avg(value).over(trailing(n)) for n in windows}


def fill_both_ways(value: str) -> Column:
    """Previous known value, else the next one: only the rows before the first known value lack a previous one."""
    back = by_date().rowsBetween(Window.unboundedPreceding, 0)
    whole = by_date().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(whole))


def numbered(panel: DataFrame) -> DataFrame:
    """Row number per entity as a double, for slopes."""
    return panel.withColumn("_t", F.row_number().over(by_date()).cast("double"))


def require_metadata(panel: DataFrame, entities: DataFrame) -> None:
    """Stop when the join of readings to entities would repeat a reading or leave one without a capacity."""
    dq.enforce_empty(dq.duplicate_keys(entities, ["id"]), "entities that repeat an id")
    known = entities.filter(F.col("capacity").isNotNull()).select("id")
    dq.enforce_empty(panel.select("id").distinct().join(known, "id", "left_anti"), "readings without a capacity")


def join_metadata(panel: DataFrame, entities: DataFrame) -> DataFrame:
    """Left join to the entity table; its clashing columns get the suffix ``_reservoir``."""
    clash = [c for c in entities.columns if c != "id" and c in panel.columns]
    return panel.join(entities.withColumnsRenamed({c: f"{c}_reservoir" for c in clash}), "id", "left")


def build_features(panel: DataFrame, entities: DataFrame, lags: Sequence[int] = config.LAGS,
                   windows: Sequence[int] = config.ROLLING_WINDOWS) -> DataFrame:
    """Weekly features per entity: calendar, capacity fraction, lags, rolling statistics, next value as target."""
    check_sizes(*lags, *windows)
    frame = join_metadata(panel, entities)
    dates = calendar(F.col("date"))
    return (frame.withColumns({
        "week_of_year": dates["week_of_year"], "year": dates["year"],
        "storage_fraction": F.col("storage") / F.col("capacity"),
        **lag_columns("storage", lags), **rolling_columns("storage", windows),
        "target_storage": F.lead("storage", 1).over(by_date())}))


def extended_features(panel: DataFrame, entities: DataFrame) -> DataFrame:
    """The wide feature set used for stacking, remaining nulls filled forwards and then backwards."""
    frame = numbered(join_metadata(panel, entities)).withColumn("fraction", F.col("storage") / F.col("capacity"))
    built = frame.withColumns({
        **calendar(F.col("date")),
        **lag_columns("storage", (1, 2, 3, 4, 8, 12, 13, 26, 39, 52)),
        **lag_columns("fraction", (1, 2, 3, 4, 8, 12, 13, 26, 39, 52)),
        **rolling_columns("storage", (4, 12, 26), full=False), **extreme_columns("storage", (4, 12, 26)),
        **change_columns("storage", (1, 4, 12)), **change_columns("fraction", (1, 4)),
        **trend_columns("storage", (4, 12)), **volatility_columns("storage", (4, 12)),
        **distance_to_mean_columns("storage", (4, 12, 26))}).drop("_t")
    fresh = [c for c in built.columns if c not in {"id", "date", *panel.columns, *entities.columns}]
    return built.withColumns({c: fill_both_ways(c) for c in fresh})


def sequences(panel: DataFrame, columns: Sequence[str], length: int = 12) -> DataFrame:
    """The previous ``length`` feature rows as one array per row, with the row's own storage as target."""
    before = by_date().rowsBetween(-length, -1)
    window = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(before)
    return (panel.withColumn("window", window).filter(F.size("window") == length)
            .select("id", "date", "window", F.col("storage").alias("target")))


def last_rows(panel: DataFrame, n: int) -> DataFrame:
    """The most recent n rows of each entity."""
    newest = Window.partitionBy("id").orderBy(F.col("date").desc())
    return panel.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).drop("_r")
