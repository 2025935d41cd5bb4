"""Forecasters and their combination.

A forecaster takes a series table (key columns, ``date``, ``storage``), a horizon and the key columns, and returns
``keys, h, date, prediction, error``. A key that cannot be forecast gives one row with an error text and no
prediction, so that one bad series never stops a run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast import config
from panelcast.functions.columns import bounded_forecast, literal_map
from panelcast.operators import learn

Forecaster = Callable[[DataFrame, int, Sequence[str]], DataFrame]
YEAR_DAYS = 365.25
HARMONICS = 10
SEASONAL_RIDGE = 0.1
LONG_AR = 13


def steps_ahead(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("h")


def seasonal_naive(series: DataFrame, horizon: int = config.HORIZON, keys: Sequence[str] = ("id",),
                   lag: int = config.SEASONAL_LAG) -> DataFrame:
    """Repeat the last seasonal cycle; a shorter series repeats its last value.

    Each of the last ``lag`` rows names the steps it is copied to, so no join back to the series is needed.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    known = series.filter(F.col("storage").isNotNull())
    ranked = known.select(
        *keys, "storage", F.row_number().over(whole.orderBy(F.col("date").desc())).alias("_r"),
        F.count(F.lit(1)).over(whole).alias("_n"), F.max("date").over(whole).alias("_last"))
    short = F.col("_n") < lag
    first = F.when(short, F.lit(1)).otherwise(F.lit(lag + 1) - F.col("_r"))
    used = ranked.filter(F.when(short, F.col("_r") == 1).otherwise(F.col("_r") <= lag)).filter(first <= horizon)
    stride = F.when(short, F.lit(1)).otherwise(F.lit(lag))
    made = used.withColumn("h", F.explode(F.sequence(first, F.lit(horizon), stride)))
    done = made.select(*keys, "h", F.date_add("_last", F.col("h") * config.GRID_DAYS).alias("date"),
                       F.col("storage").cast("double").alias("prediction"), F.lit(None).cast("string").alias("error"))
    empty = series.groupBy(*keys).agg(F.count("storage").alias("_n")).filter(F.col("_n") == 0)
    failed = empty.select(*keys, F.lit(None).cast("int").alias("h"), F.lit(None).cast("date").alias("date"),
                          F.lit(None).cast("double").alias("prediction"), F.lit("empty series").alias("error"))
    return done.unionByName(failed)


def future_dates(series: DataFrame, horizon: int = config.HORIZON, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The weekly dates after the last observation."""
    last = series.groupBy(*keys).agg(F.max("date").alias("_last"))
    return (last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .select(*keys, "h", F.date_add("_last", F.col("h") * config.GRID_DAYS).alias("date")))


def anchor(prediction: str, last_value: str, keys: Sequence[str] = ("id",)) -> Column:
    """Shift a forecast so that its first step equals the last observation."""
    first = F.first(prediction).over(steps_ahead(keys).rowsBetween(Window.unboundedPreceding, 0))
    return F.col(prediction) + (F.col(last_value) - first)


def lift_negatives(value: str, keys: Sequence[str] = ("id",)) -> Column:
    """Raise a forecast that goes below zero and carry every raise forward.

    The raise after step i is the largest ``-value`` seen up to i, never below zero, so one running maximum does it.
    """
    lowest = F.max(-F.col(value)).over(steps_ahead(keys).rowsBetween(Window.unboundedPreceding, 0))
    return F.col(value) + F.greatest(F.lit(0.0), lowest)


def harmonic_design(days: np.ndarray, start: float, span: float) -> np.ndarray:
    """Constant, straight trend and yearly sine and cosine pairs."""
    angle = 2 * np.pi * np.outer(days, np.arange(1, HARMONICS + 1)) / YEAR_DAYS
    return np.column_stack([np.ones_like(days), (days - start) / span, np.sin(angle), np.cos(angle)])


def fit_harmonic(days: np.ndarray, values: np.ndarray, future: np.ndarray) -> np.ndarray:
    """Ridge on the seasonal terms, plain least squares on level and trend."""
    if len(values) < 3:
        raise ValueError("at least three observations are needed")
    span = max(days[-1] - days[0], 1.0)
    x = harmonic_design(days, days[0], span)
    penalty = np.r_[0.0, 0.0, np.full(2 * HARMONICS, SEASONAL_RIDGE)]
    weights = np.linalg.lstsq(x.T @ x + np.diag(penalty), x.T @ values, rcond=None)[0]
    return harmonic_design(future, days[0], span) @ weights


def past(values: np.ndarray, lags: Sequence[int]) -> np.ndarray:
    """A column of earlier values per lag; what lies before the first value counts as zero."""
    reach = max(lags)
    padded = np.r_[np.zeros(reach), values]
    return np.column_stack([padded[reach - lag:len(padded) - lag] for lag in lags])


def estimate_arima(w: np.ndarray, season: int) -> tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]:
    """Two-stage least squares on a differenced series: lags, AR and shock weights, estimated shocks.

    A long autoregression that spans the season estimates the shocks; a second regression uses one, season and
    season-plus-one lags of the differences and of the shocks. The model has the same form at every length: values
    before the first difference count as zero, their expectation.
    """
    long_lags = sorted({*range(1, LONG_AR + 1), season, season + 1})
    stage_one = past(w, long_lags)
    shocks = w - stage_one @ np.linalg.lstsq(stage_one, w, rcond=None)[0]
    lags = (1, season, season + 1)
    x = np.column_stack([past(w, lags), past(shocks, lags)])
    gram = x.T @ x
    ridge = 1e-6 * max(np.trace(gram), 1e-12) * np.eye(len(gram))
    coefficients = np.linalg.lstsq(gram + ridge, x.T @ w, rcond=None)[0]
    # Roots outside the unit circle would make a year of recursion explode; the cross term is their product
    phi, theta = np.clip(coefficients[:len(lags)], -0.98, 0.98), coefficients[len(lags):]
    phi[2] = -phi[0] * phi[1]
    return lags, phi, theta, shocks


def fit_arima(values: np.ndarray, horizon: int, season: int = config.SEASONAL_LAG) -> np.ndarray:
    """Seasonal ARIMA(1,1,1)(1,1,1): difference once and once per season, estimate, roll forward, undo both.

    Two seasons of values are needed, the shortest history that a backtest origin may have.
    """
    if len(values) < 2 * season:
        raise ValueError(f"at least {2 * season} observations are needed")
    w = values[season + 1:] - values[season:-1] - values[1:-season] + values[:-season - 1]
    lags, phi, theta, shocks = estimate_arima(w, season)
    before = [0.0] * (season + 1)
    diffs, errors, level = before + list(w), before + list(shocks), list(values)
    for _ in range(horizon):
        step = sum(p * diffs[-lag] for p, lag in zip(phi, lags)) + sum(t * errors[-lag] for t, lag in zip(theta, lags))
        diffs.append(step)
        errors.append(0.0)
        level.append(step + level[-1] + level[-season] - level[-season - 1])
    return np.asarray(level[-horizon:])


def _fitted(series: DataFrame, horizon: int, keys: Sequence[str], solve) -> DataFrame:
    """Run a solver per series, then anchor and lift its curve.

    One task gets one series at a time: at most one row per week of one entity, whatever the data volume.
    """
    keys, grid = list(keys), config.GRID_DAYS
    types = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["h int", "prediction double", "error string",
                                                            "_end date", "_last double"])

    def run(key: tuple, series_table: pa.Table) -> pa.Table:
        days = series_table.column("date").cast(pa.int32()).to_numpy()
        values = series_table.column("storage").to_numpy()
        known = np.flatnonzero(~np.isnan(values))
        order = known[np.argsort(days[known])]
        days, values = days[order].astype(float), values[order]
        try:
            if not len(values):
                raise ValueError("empty series")
            curve = solve(days, values, days[-1] + grid * np.arange(1, horizon + 1))
            if not np.isfinite(curve).all():
                raise ValueError("the fitted curve is not finite")
            rows, end, error = len(curve), int(days[-1]), None
            columns = [np.arange(1, rows + 1, dtype="int32"), curve, [error] * rows,
                       pa.array([end] * rows, pa.int32()).cast(pa.date32()), [values[-1]] * rows]
        except (ValueError, np.linalg.LinAlgError) as exc:
            rows, columns = 1, [[None], [None], [str(exc)], [None], [None]]
        tail = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.string(), pa.date32(),
                                                         pa.float64()))]
        heads = [pa.array([k.as_py()] * rows, k.type) for k in key]
        return pa.Table.from_arrays(heads + tail, names=[*keys, "h", "prediction", "error", "_end", "_last"])

    raw = series.select(*keys, "date", F.col("storage").cast("double").alias("storage"))
    fitted = raw.groupBy(*keys).applyInArrow(run, schema)
    anchored = fitted.withColumn("prediction", anchor("prediction", "_last", keys))
    lifted = anchored.withColumn("prediction", F.when(F.col("error").isNull(), lift_negatives("prediction", keys)))
    return lifted.select(*keys, "h", F.date_add("_end", F.col("h") * config.GRID_DAYS).alias("date"), "prediction",
                         "error")


def trend_seasonal(series: DataFrame, horizon: int = config.HORIZON, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Straight trend plus yearly harmonics."""
    return _fitted(series, horizon, keys, lambda days, values, future: fit_harmonic(days, values, future))


def sarima(series: DataFrame, horizon: int = config.HORIZON, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Seasonal ARIMA by two-stage least squares."""
    return _fitted(series, horizon, keys, lambda days, values, future: fit_arima(values, len(future)))


def seasonal_mean(series: DataFrame, horizon: int = config.HORIZON, keys: Sequence[str] = ("id",), seasons: int = 2,
                  lag: int = config.SEASONAL_LAG) -> DataFrame:
    """Mean of the same week in the last seasons; a series of less than one season repeats its last value."""
    keys = list(keys)
    short = seasonal_naive(series, horizon, keys, lag).withColumnRenamed("prediction", "_naive")
    newest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    known = series.filter(F.col("storage").isNotNull())
    ranked = known.select(*keys, F.col("storage").cast("double").alias("storage"), F.row_number().over(newest).alias("_r"))
    place = F.lit(lag - 1) - F.pmod(F.col("_r") - 1, F.lit(lag))
    means = (ranked.filter(F.col("_r") <= seasons * lag).groupBy(*keys, place.alias("_place"))
             .agg(F.avg("storage").alias("_mean"), F.max("_r").alias("_r")))
    full = ranked.groupBy(*keys).agg((F.max("_r") >= lag).alias("_full"))
    joined = (short.withColumn("_place", F.pmod(F.col("h") - 1, F.lit(lag))).join(full, keys, "left")
              .join(means.drop("_r"), [*keys, "_place"], "left"))
    return joined.select(*keys, "h", "date", F.when(F.col("_full"), F.col("_mean")).otherwise(F.col("_naive")).alias("prediction"),
                         "error")


MODELS: dict[str, Forecaster] = {
    "seasonal_naive": seasonal_naive, "sarima": sarima, "trend_seasonal": trend_seasonal, "seasonal_mean": seasonal_mean,
    "boosted": learn.boosted_series, "linear": learn.linear_series}
#: The models of a release run
USUAL = ("seasonal_naive", "sarima", "trend_seasonal")


def pick_models(names: Sequence[str]) -> dict[str, Forecaster]:
    """The models of the names, in the given order; an unknown name is an error."""
    asked = [config.MODEL_ALIASES.get(name, name) for name in names]
    unknown = [name for name in asked if name not in MODELS]
    if unknown:
        raise ValueError(f"no such forecasting model: {', '.join(unknown)}")
    return {name: MODELS[name] for name in asked}


def bounded(forecasts: DataFrame, capacity: DataFrame) -> DataFrame:
    """Clip predictions to [0, capacity] where a capacity is known."""
    c = capacity.select("id", F.col("capacity").alias("_cap"))
    return (forecasts.join(c, "id", "left")
            .withColumn("prediction", bounded_forecast(F.col("prediction"), F.col("_cap"))).drop("_cap"))


def run_models(series: DataFrame, capacity: DataFrame, models: Mapping[str, Forecaster], horizon: int,
               keys: Sequence[str] = ("id",)) -> DataFrame:
    """All models over all series, long form, failures included as error rows."""
    stacked = None
    for name, forecaster in models.items():
        part = forecaster(series, horizon, keys).withColumn("model", F.lit(name))
        stacked = part if stacked is None else stacked.unionByName(part)
    if stacked is None:
        raise ValueError("no known forecasting model was asked for")
    return bounded(stacked, capacity)


def weighted_average(forecasts: DataFrame, weights: Mapping[str, float], keys: Sequence[str] = ("id",),
                     label: str = config.ENSEMBLE_MODEL) -> DataFrame:
    """Weighted mean over the models present, weights rescaled to those models; an unknown model is an error."""
    pick_models(list(weights))
    weight = F.try_element_at(literal_map(weights), F.col("model"))
    used = forecasts.filter(F.col("prediction").isNotNull()).withColumn("_w", weight).filter(F.col("_w").isNotNull())
    total = F.sum(F.col("_w") * F.col("prediction")) / F.sum("_w")
    return used.groupBy(*keys, "h", "date").agg(total.alias("prediction")).withColumn("model", F.lit(label))


def blend(panel: DataFrame, capacity: DataFrame, name: str, horizon: int = config.HORIZON,
          keys: Sequence[str] = ("id",)) -> DataFrame:
    """A fixed blend of the configuration: its members' forecasts and their weighted mean.

    Weights are rescaled where a member failed on a series; a member that no registry knows is an error.
    """
    every = run_models(panel, capacity, pick_models(list(config.BLENDS[name])), horizon, keys)
    return with_ensemble(every.filter(F.col("error").isNull()).drop("error"), config.BLENDS[name], keys, name)


def with_ensemble(forecasts: DataFrame, weights: Mapping[str, float] = config.ENSEMBLE_WEIGHTS,
                  keys: Sequence[str] = ("id",), label: str = config.ENSEMBLE_MODEL) -> DataFrame:
    """The forecasts plus their weighted mean, in one pass: a group is one step, with a row per model."""
    ok = forecasts.filter(F.col("prediction").isNotNull())
    models = F.collect_list(F.struct("model", "prediction"))
    weight = F.try_element_at(literal_map(weights), F.col("model"))
    mean = (F.sum(F.when(weight.isNotNull(), weight * F.col("prediction"))) / F.sum(weight))
    grouped = ok.groupBy(*keys, "h", "date").agg(models.alias("_models"), mean.alias("_mean"))
    extra = F.when(F.col("_mean").isNotNull(), F.array(F.struct(F.lit(label).alias("model"),
                                                                F.col("_mean").alias("prediction"))))
    every = F.concat("_models", F.coalesce(extra, F.array_except("_models", "_models")))
    return grouped.select(*keys, "h", "date", F.inline(every))


def split_failures(every: DataFrame, capacity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forecasts with their ensemble, and the skipped (id, model) with their errors. ``every`` is read twice."""
    failures = every.filter(F.col("error").isNotNull()).select("id", "model", "error")
    forecasts = with_ensemble(every.filter(F.col("error").isNull()).drop("error"))
    return bounded(forecasts, capacity), failures


def forecast_panel(panel: DataFrame, capacity: DataFrame, models: Sequence[str] = USUAL,
                   horizon: int = config.HORIZON) -> tuple[DataFrame, DataFrame]:
    """Forecasts of every entity (models and ensemble) and the table of skipped entities with their errors."""
    return split_failures(run_models(panel, capacity, pick_models(models), horizon), capacity)


def wide(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per entity and date with a column per model."""
    return forecasts.groupBy("id", "date").pivot("model", list(models)).agg(F.first("prediction"))
