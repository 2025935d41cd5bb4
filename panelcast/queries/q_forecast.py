"""Forecast, backtest and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast import config
from panelcast.operators import backtest as bt, evaluation as ev, forecast as fc, quality as dq
from panelcast.queries import fixtures as fx
from panelcast.queries.registry import query, with_ctes
from panelcast.session import cut_lineage


def shifted_naive(series, horizon, keys):
    """A second native forecast for queries whose SQL needs two models."""
    return fc.seasonal_naive(series, horizon, keys).withColumn("prediction", F.col("prediction") * 0.9 + 5)


TWO_MODELS = {"seasonal_naive": fc.seasonal_naive, "trend_seasonal": shifted_naive}

NUMBERED = """numbered AS (SELECT id, date, storage, row_number() OVER (PARTITION BY id ORDER BY date) AS rn,
 count(*) OVER (PARTITION BY id) AS n, max(date) OVER (PARTITION BY id) AS last FROM panel)"""
NAIVE = """naive AS (SELECT a.id, b.h, a.last + CAST(b.h * 7 AS INTEGER) AS date, a.storage AS prediction FROM numbered a,
 (SELECT unnest(generate_series(1, {H})) AS h) b WHERE a.rn = a.n - 52 + 1 + (b.h - 1) % 52)"""


@query("fc01_seasonal_naive", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=80)], "SELECT id, h, date, prediction FROM naive",
                                        t="date"))
def _(spark, sf):
    return fc.seasonal_naive(fx.panel(spark, sf), 80).select("id", "h", "date", "prediction")


@query("fc01_short_series", with_ctes([fx.ORDERS_WK], """SELECT o.id, b.h, last + CAST(b.h * 7 AS INTEGER) AS date, prediction
 FROM (SELECT id, max(date) AS last, arg_max(storage, date) AS prediction FROM orders_wk GROUP BY id
 HAVING count(*) < 52) o, (SELECT unnest(generate_series(1, 52)) AS h) b""", t="date"))
def _(spark, sf):
    series = fx.order_readings(spark, sf)
    sizes = series.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n < 52")
    return fc.seasonal_naive(series.join(sizes, "id", "left_semi")).select("id", "h", "date", "prediction")


@query("dat02_future_dates", with_ctes([fx.WK], """SELECT id, h, last + CAST(h * 7 AS INTEGER) AS date FROM
 (SELECT id, max(date) AS last FROM wk GROUP BY id), (SELECT unnest(generate_series(1, 52)) AS h)""", t="date"))
def _(spark, sf):
    return fc.future_dates(fx.readings(spark, sf))


CURVE = NAIVE.format(H=52) + ", low AS (SELECT id, h, prediction - 20 - h * 0.1::DOUBLE AS v FROM naive)"


def low_curve(spark, sf):
    made = fc.seasonal_naive(fx.panel(spark, sf))
    return made.select("id", "h", (F.col("prediction") - 20 - F.col("h") * 0.1).alias("v"))


@query("win14_lift_negatives", with_ctes([fx.PANEL, NUMBERED, CURVE], """SELECT id, h, v + greatest(0, max(-v) OVER (
 PARTITION BY id ORDER BY h)) AS lifted FROM low""", d="lifted"))
def _(spark, sf):
    return low_curve(spark, sf).withColumn("lifted", fc.lift_negatives("v")).drop("v")


@query("win15_anchor", with_ctes([fx.PANEL, NUMBERED, CURVE], """SELECT low.id, h, v + (l.storage - first_value(v) OVER (
 PARTITION BY low.id ORDER BY h)) AS anchored FROM low JOIN numbered l ON l.id = low.id AND l.rn = l.n""", d="anchored"))
def _(spark, sf):
    last = fx.panel(spark, sf).groupBy("id").agg(F.max_by("storage", "date").alias("last_value"))
    joined = low_curve(spark, sf).join(last, "id")
    return joined.withColumn("anchored", fc.anchor("v", "last_value")).select("id", "h", "anchored")


TWO = """two AS (SELECT id, h, date, 'seasonal_naive' AS model, prediction FROM naive UNION ALL
 SELECT id, h, date, 'trend_seasonal', prediction * 0.9::DOUBLE + 5 FROM naive)"""


def two_forecasts(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf)
    return fc.run_models(panel, capacity.filter(F.lit(False)), TWO_MODELS, config.HORIZON)


ENSEMBLE_SQL = """SELECT id, h, date, 'ensemble' AS model, sum(prediction * CASE model WHEN 'seasonal_naive' THEN 0.2::DOUBLE
 ELSE 0.3::DOUBLE END) / 0.5::DOUBLE AS prediction FROM two GROUP BY id, h, date"""


@query("fc04_weighted_ensemble", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=52), TWO], ENSEMBLE_SQL, t="date", d="prediction"))
def _(spark, sf):
    return fc.weighted_average(two_forecasts(spark, sf), config.ENSEMBLE_WEIGHTS)


@query("fc04_with_ensemble", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=52), TWO],
                                       ENSEMBLE_SQL + " UNION ALL SELECT id, h, date, model, prediction FROM two", t="date",
                                       d="prediction"))
def _(spark, sf):
    return fc.with_ensemble(two_forecasts(spark, sf))


@query("fc12_fixed_blend", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=52)], """SELECT id, h, date, 'blend' AS model,
 0.7::DOUBLE * prediction + 0.3::DOUBLE * (prediction * 0.9::DOUBLE + 5) AS prediction FROM naive""", t="date", d="prediction"))
def _(spark, sf):
    named = two_forecasts(spark, sf).withColumn("model", F.when(F.col("model") == "seasonal_naive", "sarima")
                                                .otherwise(F.col("model")))
    return fc.weighted_average(named, config.BLENDS["two_models"], label="blend")


SPLITS = """splits AS (SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY e) - 1 AS origin FROM (
 SELECT DISTINCT id, n - 52 - 52 * i AS e FROM numbered, (SELECT unnest(generate_series(0, 2)) AS i)) WHERE e >= 104)"""
BACKTEST = f"""{fx.PANEL}, {NUMBERED}, {SPLITS}, {fx.CAP}, naive_bt AS (SELECT t.id, s.origin, t.rn - s.e AS h, t.date,
 t.storage AS actual, p.storage AS raw, capacity FROM splits s JOIN numbered t ON t.id = s.id AND t.rn > s.e AND t.rn <= s.e + 52
 JOIN numbered p ON p.id = s.id AND p.rn = s.e - 52 + 1 + (t.rn - s.e - 1) % 52 JOIN cap ON cap.id = t.id),
 base_bt AS (SELECT id, origin, h, date, actual, capacity, 'seasonal_naive' AS model,
 coalesce(greatest(0, least(raw, capacity)), raw) AS prediction FROM naive_bt UNION ALL
 SELECT id, origin, h, date, actual, capacity, 'trend_seasonal', CASE WHEN capacity IS NULL THEN raw * 0.9::DOUBLE + 5
 ELSE greatest(0, least(raw * 0.9::DOUBLE + 5, capacity)) END FROM naive_bt),
 backtest AS (SELECT * FROM base_bt UNION ALL SELECT id, origin, h, date, any_value(actual), any_value(capacity), 'ensemble',
 sum(prediction * CASE model WHEN 'seasonal_naive' THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END) / 0.5::DOUBLE FROM base_bt
 GROUP BY id, origin, h, date),
 metrics AS (SELECT id, origin, model, min(date) AS test_start, avg(abs(actual - prediction)) AS mae,
 sqrt(avg(power(actual - prediction, 2))) AS rmse, avg(CASE WHEN actual <> 0 THEN abs((actual - prediction) / actual) END) AS mape,
 avg(abs(actual - prediction)) / any_value(capacity) AS nmae_capacity,
 sqrt(avg(power(actual - prediction, 2))) / any_value(capacity) AS nrmse_capacity FROM backtest GROUP BY id, origin, model)"""


def backtested(spark, sf):
    return bt.backtest(*fx.stored_panel(spark, sf), TWO_MODELS)[0]


def metrics(spark, sf):
    """Backtest metrics, stored once: the summaries below read them several times."""
    panel, capacity = fx.stored_panel(spark, sf)
    return cut_lineage(ev.error_metrics(bt.backtest(panel, capacity, TWO_MODELS)[0], capacity))


@query("fc06_rolling_splits", with_ctes([fx.PANEL, NUMBERED, SPLITS], 'SELECT id, origin, e AS "end" FROM splits'))
def _(spark, sf):
    return bt.rolling_splits(fx.panel(spark, sf))


@query("fc07_backtest", with_ctes([BACKTEST], "SELECT id, origin, model, h, date, actual, prediction FROM backtest", t="date",
                                  d="prediction"))
def _(spark, sf):
    return backtested(spark, sf)


METRIC_COLUMNS = "mae rmse mape nmae_capacity nrmse_capacity"
FOUR = "mae rmse nmae_capacity nrmse_capacity"


@query("agg02_error_metrics", with_ctes([BACKTEST], "SELECT * FROM metrics", t="test_start", d=METRIC_COLUMNS))
def _(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf)
    return ev.error_metrics(bt.backtest(panel, capacity, TWO_MODELS)[0], capacity)


FOLDS = """folds AS (SELECT DISTINCT id, n, i, n - 52 * (n // 52) + 52 * (i + 4) AS e FROM numbered,
 (SELECT unnest(generate_series(0, 30)) AS i) WHERE i + 5 <= n // 52)"""


@query("fc08_fold_blocks", with_ctes([fx.PANEL, NUMBERED, FOLDS], """SELECT f.id, f.i AS origin, t.rn - f.e AS h, t.date,
 t.storage AS actual, p.storage AS prediction FROM folds f JOIN numbered t ON t.id = f.id AND t.rn > f.e AND t.rn <= f.e + 52
 JOIN numbered p ON p.id = f.id AND p.rn = t.rn - 52""", t="date"))
def _(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf)
    train, test = bt.fold_blocks(panel)
    return bt.score(train, test, capacity.filter(F.lit(False)), {"seasonal_naive": fc.seasonal_naive},
                    include_ensemble=False)[0].drop("model")


@query("agg03_regression_metrics", with_ctes([BACKTEST], """SELECT model, avg(mse) AS mse, avg(mae) AS mae, avg(r2) AS r2 FROM (
 SELECT id, model, avg(power(actual - prediction, 2)) AS mse, avg(abs(actual - prediction)) AS mae,
 1 - sum(power(actual - prediction, 2)) / nullif(var_pop(actual) * count(*), 0) AS r2 FROM backtest GROUP BY id, model)
 GROUP BY model""", d="mse mae r2"))
def _(spark, sf):
    return ev.average_regression_metrics(backtested(spark, sf))


@query("agg04_evaluation_summary", with_ctes([BACKTEST], """SELECT 'two_models_h52_o3' AS configuration, model,
 count(*) AS metric_rows, count(DISTINCT id) AS entities, avg(mae) AS mae_mean, avg(rmse) AS rmse_mean, avg(mape) AS mape_mean,
 avg(nmae_capacity) AS nmae_capacity_mean, avg(nrmse_capacity) AS nrmse_capacity_mean, median(mae) AS mae_median,
 median(rmse) AS rmse_median FROM metrics GROUP BY model""",
                                             d="mae_mean rmse_mean mape_mean nmae_capacity_mean nrmse_capacity_mean mae_median rmse_median"))
def _(spark, sf):
    return ev.evaluation_summary(metrics(spark, sf).withColumn("configuration", F.lit("two_models_h52_o3")))


RANKED = """avgs AS (SELECT model, avg(mae) AS mae, avg(rmse) AS rmse, avg(nmae_capacity) AS nmae_capacity,
 avg(nrmse_capacity) AS nrmse_capacity FROM metrics GROUP BY model), ranking AS (SELECT a.*, (a.mae / b.mae + a.rmse / b.rmse
 + a.nmae_capacity / b.nmae_capacity + a.nrmse_capacity / b.nrmse_capacity) / 4 AS composite_score
 FROM avgs a, avgs b WHERE b.model = 'seasonal_naive')"""


@query("agg05_model_ranking", with_ctes([BACKTEST, RANKED], """SELECT *, 1 - composite_score AS improvement_vs_baseline
 FROM ranking""", d=FOUR + " composite_score improvement_vs_baseline"))
def _(spark, sf):
    return ev.rank_models(metrics(spark, sf))


@query("agg06_metric_distribution", with_ctes([BACKTEST], " UNION ALL ".join(
    f"SELECT '{m}' AS metric, avg({m}) AS mean, stddev_samp({m}) AS std, max({m}) AS maximum, median({m}) AS median, "
    f"quantile_cont({m}, 0.9) AS p90, quantile_cont({m}, 0.95) AS p95 FROM metrics" for m in METRIC_COLUMNS.split()),
                                              d="mean std maximum median p90 p95"))
def _(spark, sf):
    return ev.metric_distribution(metrics(spark, sf))


MEANS = "avg(mae) AS mae, avg(rmse) AS rmse, avg(nmae_capacity) AS nmae_capacity, avg(nrmse_capacity) AS nrmse_capacity"


@query("agg07_mean_by_origin", with_ctes([BACKTEST], f"SELECT origin, {MEANS} FROM metrics GROUP BY origin", d=FOUR))
def _(spark, sf):
    return ev.mean_by(metrics(spark, sf), "origin")


@query("agg08_worst_entities", with_ctes([BACKTEST], f"""SELECT id, {MEANS} FROM metrics GROUP BY id
 ORDER BY avg(nrmse_capacity) DESC NULLS LAST, id LIMIT 10""", d=FOUR))
def _(spark, sf):
    return ev.worst_entities(metrics(spark, sf))


SPLIT_OF = "CASE WHEN id % 5 = 0 THEN 'validation' ELSE 'test' END"


@query("agg09_split_comparison", with_ctes([BACKTEST, f"split_metrics AS (SELECT *, {SPLIT_OF} AS split FROM metrics)"],
                                           " UNION ALL ".join(f"""SELECT '{m}' AS metric, avg({m}) FILTER (split = 'validation') AS validation_mean,
 avg({m}) FILTER (split = 'test') AS test_mean, avg({m}) FILTER (split = 'test') / avg({m}) FILTER (split = 'validation')
 AS test_to_validation_ratio FROM split_metrics""" for m in FOUR.split()), d="validation_mean test_mean test_to_validation_ratio"))
def _(spark, sf):
    return ev.compare_splits(metrics(spark, sf).withColumn(
        "split", F.when(F.col("id") % 5 == 0, "validation").otherwise("test")))


LAST = "last AS (SELECT id, arg_max(storage, date) AS last_known_value FROM level GROUP BY id)"


@query("agg10_forecast_summary", with_ctes([fx.LEVEL, LAST], """SELECT c.id, any_value(last_known_value) AS last_known_value,
 quantile_cont(storage, 0.1) AS low_forecasted_value, median(storage) AS median_forecasted_value
 FROM curves c JOIN last ON last.id = c.id GROUP BY c.id""", d="last_known_value low_forecasted_value median_forecasted_value"))
def _(spark, sf):
    levels = cut_lineage(fx.level(spark, sf))
    return ev.forecast_summary(levels, fx.plan_curves(levels), "storage")


@query("agg11_order_statistics", with_ctes([fx.LEVEL, LAST, "v AS (SELECT id, list_sort(list(storage)) AS v FROM curves GROUP BY id)"],
                                           """SELECT v.id, last_known_value, v[6] AS low_forecasted_value, v[-5] AS high_forecasted_value,
 v[27] AS median_forecasted_value FROM v JOIN last ON last.id = v.id""",
                                           d="last_known_value low_forecasted_value high_forecasted_value median_forecasted_value"))
def _(spark, sf):
    levels = cut_lineage(fx.level(spark, sf))
    return ev.order_statistics(levels, fx.plan_curves(levels), "storage")


@query("dq05_coverage", with_ctes([BACKTEST, """kept AS (SELECT * FROM metrics WHERE NOT (id % 4 = 1 AND origin = 2)),
 want AS (SELECT s_suppkey AS id, unnest(['seasonal_naive', 'trend_seasonal', 'ensemble']) AS model FROM supplier
 WHERE s_suppkey % 6 <> 0), have AS (SELECT id, model, count(DISTINCT origin) AS origins_found,
 count(*) FILTER (nmae_capacity IS NULL) AS bad FROM kept GROUP BY id, model)"""],
       """SELECT coalesce(w.id, h.id) AS id, coalesce(w.model, h.model) AS model, coalesce(origins_found, 0) AS origins_found,
 CASE WHEN w.id IS NULL THEN 'unexpected' WHEN coalesce(origins_found, 0) < 3 THEN 'missing_origins' ELSE 'null_metrics' END AS problem
 FROM want w FULL OUTER JOIN have h ON h.id = w.id AND h.model = w.model
 WHERE w.id IS NULL OR coalesce(origins_found, 0) < 3 OR bad > 0"""))
def _(spark, sf):
    kept = metrics(spark, sf).filter(~((F.col("id") % 4 == 1) & (F.col("origin") == 2)))
    ids = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).filter("id % 6 <> 0")
    return dq.coverage(kept, ids, ["seasonal_naive", "trend_seasonal", "ensemble"], 3)


@query("jn16_split_membership", with_ctes([fx.PANEL, NUMBERED, SPLITS, fx.DIMS], """SELECT s_suppkey AS id, CASE
 WHEN s_suppkey NOT IN (SELECT id FROM dims WHERE lower(community) = 'europe') THEN 'community' ELSE 'history' END AS missing_in
 FROM supplier WHERE s_suppkey % 3 = 0 AND (s_suppkey NOT IN (SELECT id FROM dims WHERE lower(community) = 'europe')
 OR s_suppkey NOT IN (SELECT id FROM splits))"""))
def _(spark, sf):
    from panelcast.operators import curate as cu
    wanted = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).filter("id % 3 = 0")
    local = cu.in_community(fx.dims(spark, sf), "europe", "community")
    eligible = bt.rolling_splits(fx.panel(spark, sf)).select("id").distinct()
    no_community = cu.missing_members(wanted, local).withColumn("missing_in", F.lit("community"))
    no_history = cu.missing_members(cu.keep_listed(wanted, local), eligible).withColumn("missing_in", F.lit("history"))
    return no_community.unionByName(no_history)


@query("fc02_trend_seasonal")
def _(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf)
    return fc.bounded(fc.trend_seasonal(panel), capacity)


@query("fc03_sarima")
def _(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf)
    return fc.bounded(fc.sarima(panel), capacity)


@query("fc05_forecast_panel")
def _(spark, sf):
    return fc.forecast_panel(*fx.stored_panel(spark, sf))[0]


@query("fc05_forecast_failures", with_ctes([fx.ORDERS_WK], """SELECT id, 'sarima' AS model,
 'at least 104 observations are needed' AS error FROM orders_wk GROUP BY id HAVING count(*) < 104"""))
def _(spark, sf):
    return fc.forecast_panel(fx.order_readings(spark, sf), fx.no_capacity(spark, sf), ["seasonal_naive", "sarima"])[1]


@query("fc05_wide_forecasts", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=52)], """SELECT id, date,
 prediction AS seasonal_naive, prediction * 0.9::DOUBLE + 5 AS trend_seasonal FROM naive""", t="date", d="seasonal_naive trend_seasonal"))
def _(spark, sf):
    return fc.wide(two_forecasts(spark, sf), list(TWO_MODELS))


@query("fc07_backtest_all_models")
def _(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf, gaps=False)
    return ev.rank_models(ev.error_metrics(bt.backtest(panel, capacity, fc.pick_models(fc.USUAL))[0], capacity))


@query("snk04_decision_record")
def _(spark, sf):
    m = metrics(spark, sf)
    record = ev.decision_record(ev.rank_models(m), m, config.ENSEMBLE_WEIGHTS)
    return record.select("selected_model", F.to_json(F.struct("*")).alias("record"))
