"""Rolling-origin splits and backtests. A (id, origin) pair is treated as a series of its own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast import config
from panelcast.operators.forecast import Forecaster, bounded, run_models, with_ensemble
from panelcast.session import cut_lineage

KEYS = ("id", "origin")


def positioned(panel: DataFrame) -> DataFrame:
    """Row number and length of every series, nulls left out."""
    whole = Window.partitionBy("id")
    return panel.filter(F.col("storage").isNotNull()).select(
        "id", "date", F.col("storage").cast("double").alias("storage"),
        F.row_number().over(whole.orderBy("date")).alias("_rn"), F.count(F.lit(1)).over(whole).alias("_n"))


def origin_ends(n: Column, horizon: int, origins: int, step: int, min_history: int) -> Column:
    """(origin, end) pairs of a series of n rows, oldest first, numbered from 0; too short a series gives none."""
    back = F.sequence(F.lit(0), F.lit(origins - 1))
    ends = F.transform(back, lambda i: n - horizon - (F.lit(origins - 1) - i) * step)
    kept = F.filter(ends, lambda end: end >= min_history)
    return F.transform(kept, lambda end, i: F.struct(i.alias("origin"), end.cast("int").alias("end")))


def rolling_splits(panel: DataFrame, horizon: int = config.HORIZON, origins: int = config.ORIGINS,
                   step: int = config.ORIGIN_STEP, min_history: int = config.MIN_HISTORY) -> DataFrame:
    """``id, origin, end``: the train length of every split."""
    sizes = panel.filter(F.col("storage").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return sizes.select("id", F.inline(origin_ends(F.col("_n"), horizon, origins, step, min_history)))


def _exploded(panel: DataFrame, horizon: int, origins: int, step: int, min_history: int) -> DataFrame:
    rows = positioned(panel)
    splits = origin_ends(F.col("_n"), horizon, origins, step, min_history)
    return rows.withColumn("_s", F.explode(splits)).select("*", "_s.origin", "_s.end").drop("_s")


def training_sets(panel: DataFrame, horizon: int = config.HORIZON, origins: int = config.ORIGINS,
                  step: int = config.ORIGIN_STEP, min_history: int = config.MIN_HISTORY) -> DataFrame:
    rows = _exploded(panel, horizon, origins, step, min_history)
    return rows.filter(F.col("_rn") <= F.col("end")).select(*KEYS, "date", "storage")


def test_sets(panel: DataFrame, horizon: int = config.HORIZON, origins: int = config.ORIGINS,
              step: int = config.ORIGIN_STEP, min_history: int = config.MIN_HISTORY) -> DataFrame:
    rows = _exploded(panel, horizon, origins, step, min_history)
    inside = (F.col("_rn") > F.col("end")) & (F.col("_rn") <= F.col("end") + horizon)
    return rows.filter(inside).select(*KEYS, (F.col("_rn") - F.col("end")).alias("h"), "date",
                                      F.col("storage").alias("actual"))


def fold_blocks(panel: DataFrame, train_years: int = 4, period: int = config.HORIZON,
                max_years: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold blocks: train on a fixed number of years, test on the next one, aligned to the series end.

    Returns (train, test) with the block number in ``origin``.
    """
    rows = positioned(panel)
    years = F.floor(F.col("_n") / period).cast("int")
    years = F.least(years, F.lit(max_years)) if max_years else years
    rows = rows.withColumn("_y", years).filter(F.col("_y") > train_years)
    place = F.col("_rn") - 1 - (F.col("_n") - F.col("_y") * period)
    year = F.floor(place / period).cast("int")
    rows = rows.withColumns({"_place": place, "_year": year}).filter(F.col("_place") >= 0)
    # Year k trains the blocks k-train_years+1 .. k and tests the block k-train_years
    first = F.greatest(F.lit(0), F.col("_year") - train_years + 1)
    last = F.least(F.col("_year"), F.col("_y") - train_years - 1)
    train = rows.filter(first <= last).withColumn("origin", F.explode(F.sequence(first, last)))
    test = rows.filter(F.col("_year") >= train_years).withColumn("origin", F.col("_year") - train_years)
    h = (F.col("_place") % period + 1).cast("int")
    return (train.select(*KEYS, "date", "storage"),
            test.select(*KEYS, h.alias("h"), "date", F.col("storage").alias("actual")))


def score(train: DataFrame, test: DataFrame, capacity: DataFrame, models: Mapping[str, Forecaster],
          horizon: int = config.HORIZON, include_ensemble: bool = True,
          weights: Mapping[str, float] = config.ENSEMBLE_WEIGHTS, store: bool = False) -> tuple[DataFrame, DataFrame]:
    """Predictions beside actual values, aligned by step, and the failures.

    ``store`` keeps the fitted curves, for callers that read both tables.
    """
    every = run_models(train, capacity, models, horizon, KEYS)
    every = cut_lineage(every) if store else every
    failures = every.filter(F.col("error").isNotNull()).select("id", "model", "origin", "error")
    good = every.filter(F.col("error").isNull()).select(*KEYS, "model", "h", "date", "prediction")
    if include_ensemble:
        good = bounded(with_ensemble(good, weights, KEYS), capacity)
    return test.join(good.drop("date"), [*KEYS, "h"]), failures


def backtest(panel: DataFrame, capacity: DataFrame, models: Mapping[str, Forecaster],
             horizon: int = config.HORIZON, origins: int = config.ORIGINS, step: int = config.ORIGIN_STEP,
             min_history: int = config.MIN_HISTORY, include_ensemble: bool = True, only: DataFrame | None = None,
             store: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rolling-origin backtest: ``id, origin, model, h, date, actual, prediction`` and the failures.

    ``only`` names the (id, origin) pairs to fit; all by default.
    """
    size = dict(horizon=horizon, origins=origins, step=step, min_history=min_history)
    train, test = training_sets(panel, **size), test_sets(panel, **size)
    if only is not None:
        train, test = (t.join(only.select(*KEYS), list(KEYS), "left_semi") for t in (train, test))
    return score(train, test, capacity, models, horizon, include_ensemble, store=store)
