import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import START, capacities, weekly
from panelcast import config
from panelcast.operators import backtest as bt, evaluation as ev, forecast as fc, quality as dq


def curve(df, value="prediction"):
    return [r[value] for r in df.orderBy("h").collect()]


def test_seasonal_naive(spark):
    made = fc.seasonal_naive(weekly(spark, {1: range(104)}))
    assert curve(made) == [float(v) for v in range(52, 104)]
    first = made.orderBy("h").first()
    assert first.date == START + dt.timedelta(weeks=104)
    assert curve(fc.seasonal_naive(weekly(spark, {1: [3, 4, 5]}), 4)) == [5.0] * 4
    longer = fc.seasonal_naive(weekly(spark, {1: range(60)}), 120)
    assert curve(longer) == [float(v) for v in np.resize(np.arange(8, 60), 120)]
    empty = fc.seasonal_naive(weekly(spark, {1: [None, None]})).collect()
    assert len(empty) == 1 and empty[0].error == "empty series" and empty[0].prediction is None


def test_weights_are_rescaled(spark):
    rows = [(1, h, dt.date(2020, 1, 5), m, v) for m, values in {"seasonal_naive": (10.0, 20.0), "sarima": (20.0, 40.0)}.items()
            for h, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "id long, h int, date date, model string, prediction double")
    weights = {"seasonal_naive": 0.10, "sarima": 0.25, "trend_seasonal": 0.65}
    assert curve(fc.weighted_average(df, weights)) == pytest.approx([17.142857142857142, 34.285714285714285])
    both = fc.with_ensemble(df, weights)
    assert both.count() == 6
    assert curve(both.filter("model = 'ensemble'")) == pytest.approx([17.142857142857142, 34.285714285714285])
    assert config.ENSEMBLE_WEIGHTS == {"seasonal_naive": 0.2, "sarima": 0.5, "trend_seasonal": 0.3}


def test_negative_lift_follows_the_step_by_step_rule(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 5, 60)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "id int, h int, v double")
    got = curve(df.withColumn("out", fc.lift_negatives("v")), "out")
    lift, want = 0.0, []
    for v in values:
        lift = max(lift, -v)
        want.append(v + lift)
    assert got == pytest.approx(want) and min(got) >= 0


def test_harmonic_fit_recovers_its_own_curve():
    days = np.arange(300) * 7.0
    truth = lambda d: 50 + 0.01 * d + 8 * np.sin(2 * np.pi * d / 365.25) + 3 * np.cos(4 * np.pi * d / 365.25)
    future = days[-1] + 7.0 * np.arange(1, 53)
    assert np.abs(fc.fit_harmonic(days, truth(days), future) - truth(future)).max() < 0.2


def test_arima_recovers_its_coefficients():
    rng, season = np.random.default_rng(5), 12
    errors = rng.normal(0, 1, 6000)
    w = np.zeros(6000)
    for t in range(season + 1, 6000):
        w[t] = (0.5 * w[t - 1] + 0.4 * w[t - season] - 0.2 * w[t - season - 1] + errors[t] + 0.3 * errors[t - 1])
    lags, phi, theta, _ = fc.estimate_arima(w[500:], season)
    assert lags == (1, 12, 13)
    assert phi == pytest.approx([0.5, 0.4, -0.2], abs=0.08) and theta[0] == pytest.approx(0.3, abs=0.1)


def test_fitted_models_start_at_the_last_value_and_stay_bounded(spark):
    t = np.arange(260)
    values = np.maximum(0, 100 + 80 * np.sin(2 * np.pi * t / 52) + np.random.default_rng(1).normal(0, 5, 260))
    panel, cap = weekly(spark, {1: values, 2: values[:20]}), capacities(spark, {1: 170, 2: 170})
    raw = fc.trend_seasonal(panel.filter("id = 1"))
    assert curve(raw)[0] == pytest.approx(values[-1])
    forecasts, failures = fc.forecast_panel(panel, cap)
    rows = forecasts.collect()
    assert all(0 <= r.prediction <= 170 for r in rows)
    assert {(r.id, r.model) for r in rows} == {(1, "seasonal_naive"), (1, "sarima"), (1, "trend_seasonal"), (1, "ensemble"),
                                              (2, "seasonal_naive"), (2, "trend_seasonal"), (2, "ensemble")}
    assert [(r.id, r.model) for r in failures.collect()] == [(2, "sarima")]
    assert list(fc.pick_models(["prophet", "seasonal_naive"])) == ["trend_seasonal", "seasonal_naive"]
    with pytest.raises(ValueError, match="unknown"):
        fc.pick_models(["prophet", "unknown", "seasonal_naive"])
    wide = fc.wide(forecasts, ["seasonal_naive", "ensemble"])
    assert wide.count() == 104 and wide.columns == ["id", "date", "seasonal_naive", "ensemble"]


def test_splits_restart_numbering_for_short_series(spark):
    panel = weekly(spark, {1: range(260), 2: range(208), 3: range(156), 4: range(155)})
    got = sorted((r.id, r.origin, r.end) for r in bt.rolling_splits(panel).collect())
    assert got == [(1, 0, 104), (1, 1, 156), (1, 2, 208), (2, 0, 104), (2, 1, 156), (3, 0, 104)]


def test_backtest_with_and_without_ensemble(spark):
    panel, cap = weekly(spark, {1: range(208)}), capacities(spark, {1: 500})
    models = fc.pick_models(["seasonal_naive"])
    made, failures = bt.backtest(panel, cap, models, origins=1)
    rows = made.collect()
    assert {r.model for r in rows} == {"seasonal_naive", "ensemble"} and len(rows) == 104 and failures.count() == 0
    assert [r.actual - r.prediction for r in rows] == pytest.approx([52] * 104)
    metric = ev.error_metrics(made, cap).filter("model = 'seasonal_naive'").first()
    assert metric.mae == 52 and metric.rmse == 52 and metric.nmae_capacity == pytest.approx(52 / 500)
    alone, _ = bt.backtest(panel, cap, models, origins=1, include_ensemble=False)
    assert {r.model for r in alone.collect()} == {"seasonal_naive"}


def test_fold_blocks(spark):
    train, test = bt.fold_blocks(weekly(spark, {1: range(52 * 6 + 5)}))
    got = {r.origin: (r.lo, r.hi, r.n) for r in train.groupBy("origin").agg(
        F.min("storage").alias("lo"), F.max("storage").alias("hi"), F.count("storage").alias("n")).collect()}
    assert got == {0: (5, 212, 208), 1: (57, 264, 208)}
    ends = {r.origin: (r.lo, r.hi) for r in test.groupBy("origin").agg(
        F.min("actual").alias("lo"), F.max("actual").alias("hi")).collect()}
    assert ends == {0: (213, 264), 1: (265, 316)}


def metric_rows(spark, errors, ids, origins=3):
    rows = [(i, o, m, e, e, e / 100, e / 100, e / 50) for i in ids for o in range(origins) for m, e in errors.items()]
    return spark.createDataFrame(rows, "id long, origin int, model string, mae double, rmse double, nmae_capacity double, "
                                       "nrmse_capacity double, mape double")


def test_ranking_and_coverage(spark):
    errors = {"seasonal_naive": 2.0, "trend_seasonal": 1.0, "sarima": 1.5, "ensemble": 1.2}
    metrics = metric_rows(spark, errors, range(10))
    ranked = ev.rank_models(metrics).collect()
    assert [r.model for r in ranked] == ["trend_seasonal", "ensemble", "sarima", "seasonal_naive"]
    assert ranked[0].composite_score == pytest.approx(0.5) and ranked[-1].improvement_vs_baseline == pytest.approx(0)
    ids = spark.range(10)
    assert dq.coverage(metrics, ids, list(errors), 3).count() == 0
    holes = metrics.filter("NOT (id = 3 AND origin = 2 AND model = 'sarima') AND id <> 7")
    problems = {(r.id, r.model): r.problem for r in dq.coverage(holes, ids, list(errors), 3).collect()}
    assert problems == {(3, "sarima"): "missing_origins", **{(7, m): "missing_origins" for m in errors}}
    record = ev.decision_record(ev.rank_models(metrics), metrics, config.ENSEMBLE_WEIGHTS).first()
    assert record.selected_model == "trend_seasonal" and record.scope.metrics_rows == 120
    assert [r.model for r in record.ranking][0] == "trend_seasonal"


def test_distribution_statistics(spark):
    values = np.random.default_rng(2).gamma(2, 3, 192)
    rows = [(i, 0, "m", *[float(v)] * 5) for i, v in enumerate(values)]
    metrics = spark.createDataFrame(rows, "id long, origin int, model string, mae double, rmse double, nmae_capacity double, "
                                          "nrmse_capacity double, mape double")
    for r in ev.metric_distribution(metrics).collect():
        assert [r["mean"], r["std"], r["median"], r["p90"], r["p95"], r["maximum"]] == pytest.approx(
            [values.mean(), values.std(ddof=1), *np.quantile(values, [.5, .9, .95]), values.max()])


def test_seasonal_mean_and_linear(spark):
    t = np.arange(160)
    values = 50 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 52)
    panel = weekly(spark, {1: values, 2: range(30), 3: [4.0] * 160})
    mean = {(r.id, r.h): r.prediction for r in fc.seasonal_mean(panel, 60).collect()}
    for h in (1, 52, 53):
        assert mean[1, h] == pytest.approx((values[107 + (h - 1) % 52 + 1] + values[55 + (h - 1) % 52 + 1]) / 2)
    assert mean[2, 9] == 29
    linear = fc.pick_models(["linear"])["linear"](panel, 10).collect()
    got = {r.h: r.prediction for r in linear if r.id == 1}
    assert len(got) == 10 and all(abs(got[h] - (50 + 0.5 * (159 + h) + 20 * np.sin(2 * np.pi * (159 + h) / 52))) < 8 for h in got)
    assert {r.id for r in linear if r.error} == {2, 3}


def test_blends_of_all_members_run(spark, monkeypatch):
    from panelcast.operators import learn
    t = np.arange(200)
    series = {i: 100 + 10 * i + 40 * np.sin(2 * np.pi * t / 52 + i) + np.random.default_rng(i).normal(0, 2, 200) for i in (1, 2)}
    panel, cap = weekly(spark, series), capacities(spark, {1: 300, 2: 300})
    monkeypatch.setitem(fc.MODELS, "boosted", lambda *a: learn.boosted_series(*a, trees=4, depth=3, step=13))
    for name, members in (("three_models", 3), ("four_models", 4)):
        rows = fc.blend(panel, cap, name, 26).collect()
        by = {}
        for r in rows:
            by.setdefault((r.id, r.h), {})[r.model] = r.prediction
        assert len(by) == 52 and all(len(v) == members + 1 for v in by.values())
        weights = fc.config.BLENDS[name]
        assert all(v[name] == pytest.approx(sum(w * v[m] for m, w in weights.items())) for v in by.values())
    with pytest.raises(ValueError):
        fc.weighted_average(fc.seasonal_naive(panel).withColumn("model", fc.F.lit("x")), {"no such model": 1.0})


def test_boosted_origins_see_nothing_of_each_other(spark):
    from panelcast.operators import learn
    t = np.arange(170)
    panel = weekly(spark, {1: 100 + 30 * np.sin(2 * np.pi * t / 52)})
    early = panel.filter("date < '2023-01-01'").withColumn("origin", fc.F.lit(0))
    both = early.unionByName(panel.withColumn("origin", fc.F.lit(1)))
    fit = lambda s: {(r.origin, r.h): r.prediction for r in learn.boosted_series(s, 4, ("id", "origin"), trees=3, depth=2).collect()}
    alone, among = fit(early), fit(both)
    assert alone and all(among[k] == pytest.approx(v) for k, v in alone.items()) and len(among) == 8
