"""Error metrics, summaries and model ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelcast import config
from panelcast.operators.quantiles import exact_quantiles
from panelcast.session import cut_lineage

METRICS = config.DECISION_METRICS
ALL_METRICS = (*METRICS, "mape")


def error_metrics(predictions: DataFrame, capacity: DataFrame | None = None,
                  keys: Sequence[str] = ("id", "origin", "model")) -> DataFrame:
    """MAE, RMSE, MAPE over non-zero actuals and the two errors divided by capacity, per series and model."""
    e = F.col("actual") - F.col("prediction")
    out = predictions.groupBy(*keys).agg(
        F.min("date").alias("test_start"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.when(F.col("actual") != 0, F.abs(e / F.nullif(F.col("actual"), F.lit(0.0))))).alias("mape"))
    if capacity is None:
        return out
    # A missing or zero capacity skips the normalised metrics
    cap = F.nullif(F.col("capacity"), F.lit(0.0))
    return (out.join(capacity.select("id", "capacity"), "id", "left")
            .withColumns({"nmae_capacity": F.col("mae") / cap, "nrmse_capacity": F.col("rmse") / cap}).drop("capacity"))


def regression_metrics(predictions: DataFrame, keys: Sequence[str] = ("id", "model")) -> DataFrame:
    """MSE, MAE and R² per series and model; R² is null for a constant series."""
    e = F.col("actual") - F.col("prediction")
    spread = F.nullif(F.var_pop("actual") * F.count("actual"), F.lit(0.0))
    return predictions.groupBy(*keys).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                                          (F.lit(1.0) - F.sum(e * e) / spread).alias("r2"))


def average_regression_metrics(predictions: DataFrame) -> DataFrame:
    per = regression_metrics(predictions)
    return per.groupBy("model").agg(*[F.avg(c).alias(c) for c in ("mse", "mae", "r2")])


def evaluation_summary(metrics: DataFrame, keys: Sequence[str] = ("configuration", "model")) -> DataFrame:
    """Rows, entities, means and medians per configuration and model. A model's group has no size bound."""
    keys = list(keys)
    base = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("metric_rows"), F.count_distinct("id").alias("entities"),
        F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean"), F.avg("mape").alias("mape_mean"),
        F.avg("nmae_capacity").alias("nmae_capacity_mean"), F.avg("nrmse_capacity").alias("nrmse_capacity_mean"))
    long = metrics.unpivot(keys, ["mae", "rmse"], "_metric", "_value")
    medians = exact_quantiles(long, [*keys, "_metric"], "_value", {"_median": 0.5}).groupBy(*keys).agg(*[
        F.max(F.when(F.col("_metric") == m, F.col("_median"))).alias(f"{m}_median") for m in ("mae", "rmse")])
    return base.join(medians, keys, "left")


def rank_models(metrics: DataFrame, baseline: str = config.BASELINE_MODEL) -> DataFrame:
    """Mean metrics per model against the baseline's; the lowest mean ratio ranks first.

    The averages (one row per model) are stored first: the baseline lookup would otherwise run the backtest again.
    """
    averages = cut_lineage(metrics.groupBy("model").agg(*[F.avg(m).alias(m) for m in METRICS]))
    base = averages.filter(F.col("model") == baseline).select(F.struct(*METRICS)).scalar()
    ratios = [F.col(m) / base[m] for m in METRICS]
    composite = sum(ratios[1:], ratios[0]) / len(ratios)
    scored = averages.withColumn("composite_score", composite)
    return (scored.withColumn("improvement_vs_baseline", F.lit(1.0) - F.col("composite_score"))
            .orderBy("composite_score", "nrmse_capacity", "rmse", "model"))


def long_metrics(metrics: DataFrame, names: Sequence[str] = ALL_METRICS) -> DataFrame:
    return metrics.unpivot(["id", "model", "origin"], list(names), "metric", "value")


def metric_distribution(metrics: DataFrame, names: Sequence[str] = ALL_METRICS) -> DataFrame:
    """Mean, median, sample deviation, 90th and 95th percentile and maximum per metric."""
    rows = long_metrics(metrics, names)
    base = rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                      F.max("value").alias("maximum"))
    return base.join(exact_quantiles(rows, ["metric"], "value", {"median": 0.5, "p90": 0.9, "p95": 0.95}), "metric")


def mean_by(metrics: DataFrame, key: str) -> DataFrame:
    return metrics.groupBy(key).agg(*[F.avg(m).alias(m) for m in METRICS])


def worst_entities(metrics: DataFrame, n: int = 10) -> DataFrame:
    return mean_by(metrics, "id").orderBy(F.col("nrmse_capacity").desc_nulls_last(), "id").limit(n)


def compare_splits(metrics: DataFrame) -> DataFrame:
    """Validation mean, test mean and their ratio per metric."""
    rows = metrics.unpivot(["split"], list(METRICS), "metric", "value")
    means = rows.groupBy("metric").agg(
        F.avg(F.when(F.col("split") == "validation", F.col("value"))).alias("validation_mean"),
        F.avg(F.when(F.col("split") == "test", F.col("value"))).alias("test_mean"))
    ratio = F.col("test_mean") / F.nullif(F.col("validation_mean"), F.lit(0.0))
    return means.withColumn("test_to_validation_ratio", ratio)


def forecast_summary(panel: DataFrame, curves: DataFrame, value: str = "prediction") -> DataFrame:
    """Last known value, low (10 %) and median forecast per entity. A curve has one row per step, so it is small."""
    last = panel.groupBy("id").agg(F.max_by("storage", "date").alias("last_known_value"))
    ahead = curves.groupBy("id").agg(F.percentile(value, F.lit(0.1)).alias("low_forecasted_value"),
                                     F.median(value).alias("median_forecasted_value"))
    return last.join(ahead, "id")


def order_statistics(panel: DataFrame, curves: DataFrame, value: str = "prediction") -> DataFrame:
    """Sixth smallest, fifth largest and 27th smallest forecast of a year, with the value before the horizon."""
    last = panel.groupBy("id").agg(F.max_by("storage", "date").alias("last_known_value"))
    ranked = curves.groupBy("id").agg(F.sort_array(F.collect_list(value)).alias("_v"))
    ahead = ranked.select("id", F.try_element_at("_v", F.lit(6)).alias("low_forecasted_value"),
                          F.try_element_at("_v", F.lit(-5)).alias("high_forecasted_value"),
                          F.try_element_at("_v", F.lit(27)).alias("median_forecasted_value"))
    return last.join(ahead, "id")


def decision_record(ranking: DataFrame, metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One nested record: the ranked models, the selected one and what the decision rests on."""
    fields = ["model", *METRICS, "composite_score", "improvement_vs_baseline"]
    order = F.struct("composite_score", "nrmse_capacity", "rmse", F.struct(*fields).alias("entry"))
    ranked = ranking.agg(F.sort_array(F.collect_list(order)).alias("_r")).select(
        F.transform("_r", lambda r: r["entry"]).alias("ranking"))
    scope = metrics.agg(F.struct(F.count_distinct("id").alias("entities"), F.count_distinct("origin").alias("origins"),
                                 F.count(F.lit(1)).alias("metrics_rows"))).scalar()
    return ranked.select(
        F.lit("validation").alias("split"), scope.alias("scope"),
        F.array(*[F.lit(m) for m in METRICS]).alias("decision_metrics"),
        F.lit(config.BASELINE_MODEL).alias("baseline_model"), "ranking",
        F.get("ranking", F.lit(0))["model"].alias("selected_model"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in weights]),
                          F.array(*[F.lit(v) for v in weights.values()])).alias("ensemble_weights"))
