import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import capacities, weekly
from panelcast.operators import incremental as inc, learn
from panelcast.session import cut_lineage, scratch_path
from panelcast.sources import readers, schemas, writers


def test_only_changed_entities_are_forecast_again(spark):
    path = scratch_path(spark, "ledger")
    panel, cap = weekly(spark, {1: range(120), 2: range(5, 125), 3: range(9, 129)}), capacities(spark, {1: 500, 2: 500, 3: 500})
    models = ["seasonal_naive"]
    first, counts = inc.forecast_with_ledger(spark, panel, cap, path, models)
    assert counts.first().computed == 3 and first.select("id").distinct().count() == 3
    _, counts = inc.forecast_with_ledger(spark, panel, cap, path, models)
    assert (counts.first().computed, counts.first().from_ledger) == (0, 3)
    changed = panel.withColumn("storage", F.when((F.col("id") == 2) & (F.col("storage") == 124.0), 99.0).otherwise(F.col("storage")))
    forecasts, counts = inc.forecast_with_ledger(spark, changed, cap, path, models)
    assert (counts.first().computed, counts.first().from_ledger) == (1, 2)
    assert forecasts.filter("model = 'seasonal_naive'").count() == 156
    assert forecasts.filter("id = 2 AND h = 52 AND model = 'seasonal_naive'").first().prediction == 99.0


def test_evaluation_resumes_entity_by_entity(spark):
    path = scratch_path(spark, "metrics")
    panel, cap = weekly(spark, {1: range(260), 2: range(260)}), capacities(spark, {1: 500, 2: 500})
    ids = spark.createDataFrame([(2, 0), (1, 1)], "id long, position int")
    args = (spark, panel, cap, ids, "validation", ["seasonal_naive"], path)
    assert {r.id for r in inc.evaluate_with_ledger(*args, limit=1).collect()} == {2}
    both = inc.evaluate_with_ledger(*args, limit=1)
    assert both.count() == 12 and {r.id for r in both.collect()} == {1, 2}
    assert inc.evaluate_with_ledger(*args).count() == 12


def test_tiny_changes_are_seen(spark):
    panel, cap = weekly(spark, {1: range(60)}), capacities(spark, {1: 500})
    changed = panel.withColumn("storage", F.when(F.col("storage") == 7, 7 + 1e-9).otherwise(F.col("storage")))
    one, other = (inc.fingerprints(p, cap, ["seasonal_naive"]).first().digest for p in (panel, changed))
    assert one != other


def test_failed_forecasts_are_kept_and_not_repeated(spark):
    path = scratch_path(spark, "ledger")
    panel, cap = weekly(spark, {1: range(120), 2: range(20)}), capacities(spark, {1: 500, 2: 500})
    _, counts = inc.forecast_with_ledger(spark, panel, cap, path, ["sarima"])
    assert (counts.first().computed, counts.first().skipped) == (2, 1)
    digests = inc.fingerprints(panel, cap, ["sarima"])
    assert [(r.id, r.model) for r in inc.forecast_failures(spark, digests, path).collect()] == [(2, "sarima")]
    _, counts = inc.forecast_with_ledger(spark, panel, cap, path, ["sarima"])
    assert (counts.first().computed, counts.first().from_ledger) == (0, 2)


@pytest.mark.parametrize("before", [True, False])
def test_a_broken_run_loses_no_entity(spark, monkeypatch, before):
    """Broken before or after the append and then repeated, a run gives what an unbroken one does."""
    panel = weekly(spark, {1: range(80), 2: range(120), 3: range(20)})
    cap, models = capacities(spark, {1: 500, 2: 500, 3: 500}), ["seasonal_naive", "sarima"]
    rows = lambda path: sorted(map(tuple, inc.forecast_with_ledger(spark, panel, cap, path, models)[0].collect()))
    want = rows(scratch_path(spark, "ledger"))
    assert {r[0] for r in want} == {1, 2, 3} and {r[0] for r in want if r[2] == "sarima"} == {2}
    write, path = inc.append_parquet, scratch_path(spark, "ledger")

    def broken(df, target):
        if not before:
            write(df, target)
        raise OSError("lost")

    monkeypatch.setattr(inc, "append_parquet", broken)
    with pytest.raises(OSError):
        rows(path)
    monkeypatch.setattr(inc, "append_parquet", write)
    assert rows(path) == want
    _, counts = inc.forecast_with_ledger(spark, panel, cap, path, models)
    assert tuple(counts.select("computed", "from_ledger", "skipped").first()) == (0, 3, 0)


def test_half_known_entities_are_fitted_again(spark):
    ledger = spark.createDataFrame([(1, "a", "x"), (1, "a", "ensemble"), (2, "b", "x"), (2, "b", "y"), (2, "c", "y")],
                                   "id long, digest string, model string")
    assert [tuple(r) for r in inc.answered(ledger, ["x", "y"]).collect()] == [(2, "b")]


def test_evaluation_keeps_predictions_failures_and_manifests(spark):
    path = scratch_path(spark, "metrics")
    panel, cap = weekly(spark, {1: range(260), 2: range(156)}), capacities(spark, {1: 500, 2: 500})
    ids = spark.createDataFrame([(1, 0), (2, 1)], "id long, position int")
    args = (spark, panel, cap, ids, "test", ["seasonal_naive", "sarima"], path)
    made = inc.evaluate_with_ledger(*args)
    assert made.filter("model = 'sarima'").count() == 4  # three origins of 1 and the only one of 2, from 104 rows on
    predictions = inc.results(spark, path, "predictions", schemas.PREDICTIONS)
    assert predictions.count() == 4 * 3 * 52
    manifests = {r.id: r for r in inc.latest_manifests(spark, path).collect()}
    assert manifests[1].status == "complete" and manifests[2].status == "in_progress" and manifests[2].completed_origins == [0]
    assert inc.assemble(made, inc.latest_manifests(spark, path)).select("id").distinct().collect()[0].id == 1
    # A further model finds the pairs pending again and nothing is counted twice
    assert inc.evaluate_with_ledger(*args).count() == made.count()
    with pytest.raises(ValueError, match="without enough history"):
        inc.evaluate_with_ledger(spark, panel, cap, spark.createDataFrame([(9, 0)], "id long, position int"), "test",
                                 ["seasonal_naive"], path)


def test_manifests_without_failure_field_are_ignored(spark):
    texts = ['{"status": "complete", "models": ["a"], "horizon": 52, "origins": 3, "completed_origins": [0, 1, 2]}',
             '{"status": "complete", "failure_recorded": true, "models": ["a"], "horizon": 52, "origins": 3, "completed_origins": [0, 1, 2]}',
             '{"status": "in_progress", "failure_recorded": true, "models": ["a"], "horizon": 52, "origins": 3, "completed_origins": [0]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", inc.parse_manifest(F.col("t")))
    assert [r[0] for r in df.select(inc.is_complete(F.col("m"), ["a"], 52, 3)).collect()] == [False, True, False]


def test_replace_is_all_or_nothing(spark):
    path = scratch_path(spark, "table")
    writers.replace_parquet(spark.range(5), path)
    broken = spark.range(10).withColumn("id", F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        writers.replace_parquet(broken, path)
    assert spark.read.parquet(path).count() == 5
    writers.replace_parquet(spark.read.parquet(path).filter("id < 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_csv_and_run_records(spark):
    folder = scratch_path(spark, "csv")
    raw = spark.createDataFrame([("01/01/2020", 1, "1,5")], "DATE string, ID long, CURRENT_WATER string")
    writers.write_csv(raw, f"{folder}/deep/water")
    assert [tuple(r) for r in readers.read_observations(spark, f"{folder}/deep/water").collect()] == [("01/01/2020", 1, "1,5")]
    for stage in ("a", "b"):
        writers.append_run(spark, stage, "root", f"{folder}/runs")
    assert sorted(r.stage for r in spark.read.json(f"{folder}/runs").collect()) == ["a", "b"]


def test_sample_panel_is_repeatable(spark):
    ids = spark.range(1, 4)
    a = sorted(map(tuple, readers.sample_panel(ids).collect()))
    b = sorted(map(tuple, readers.sample_panel(ids.repartition(5)).collect()))
    assert a == b and len(a) == 780
    noise = np.array([r.storage for r in readers.sample_panel(spark.range(200), noise=15.0).collect()])
    calm = np.array([r.storage for r in readers.sample_panel(spark.range(200), noise=0.0).collect()])
    assert abs((noise - calm).mean()) < 0.5 and abs((noise - calm).std() - 15) < 0.5


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_stacking_solves_the_normal_equations(spark, alpha):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 3, (200, 3)) + 10
    y = 2 + x @ [0.5, -0.3, 0.8] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y)], "id int, a double, b double, c double, y double")
    w = learn.fit_stack(df, ["id"], "y", ["a", "b", "c"], alpha).first()
    centred = x - x.mean(0)
    want = np.linalg.solve(centred.T @ centred + alpha * np.eye(3), centred.T @ (y - y.mean()))
    assert [w.w_a, w.w_b, w.w_c] == pytest.approx(list(want), rel=1e-8)
    assert w.intercept == pytest.approx(y.mean() - want @ x.mean(0))


def test_forest_scores_and_selection(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), float(5 * a + rng.normal(0, 0.1))) for i, (a, b) in enumerate(rng.random((200, 2)))]
    df = spark.createDataFrame(rows, "id long, useful double, useless double, y double")
    score = learn.cross_validate(df, "y", ["useful", "useless"], folds=3, trees=10).first()
    assert score.r2 > 0.9
    chosen = learn.forward_selection(df, "y", ["useless", "useful"], keep=1, folds=2, trees=5)
    assert chosen[0][0] == "useful"


def plain_tree(rows, place, depth):
    """Mean target of one tree at a place, split by split. ``rows``: (bins, weight, summed target)."""
    n, y = sum(w for _, w, _ in rows), sum(s for _, _, s in rows)
    best = None
    for f in range(len(place)) if depth else ():
        for cut in range(max(b[f] for b, _, _ in rows)):
            low = [r for r in rows if r[0][f] <= cut]
            a, c = sum(w for _, w, _ in low), sum(s for _, _, s in low)
            if 0 < a < n:
                fall = c * c / a + (y - c) ** 2 / (n - a) - y * y / n
                if fall > 1e-9 * (1 + y * y / n) and (best is None or fall > best[0]):
                    best = fall, f, cut
    if best is None:
        return y / n
    side = place[best[1]] <= best[2]
    return plain_tree([r for r in rows if (r[0][best[1]] <= best[2]) == side], place, depth - 1)


@pytest.mark.parametrize("depth", [0, 3, 30])
def test_tree_of_bins(depth):
    rng = np.random.default_rng(5)
    bins = learn._distinct(rng.integers(0, 6, (150, 3)).astype(np.uint8))[0]
    weight, target = rng.integers(1, 5, len(bins)), rng.normal(3, 2, len(bins))
    asked = rng.integers(0, 7, (60, 3)).astype(np.uint8)
    got = learn.tree_means(bins, weight, weight * target, asked, depth, 3, rng)
    rows = [(tuple(b), w, w * t) for b, w, t in zip(bins.tolist(), weight.tolist(), target.tolist())]
    assert got == pytest.approx([plain_tree(rows, place, depth) for place in asked.tolist()])


def test_forest_is_about_as_good_as_sparks(spark):
    """Rows that share an id and a place, a category, and no node of any tree on the driver."""
    from pyspark.ml import regression
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(3)
    rows = [(i // 2, float(a), float(b), f"c{i % 5}", float(3 * a + (b > .5) + i % 5 + rng.normal(0, .5)))
            for i, (a, b) in enumerate(np.repeat(rng.random((300, 2)), 2, 0))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, y double")
    got = learn.cross_validate(df, "y", ["a", "b"], ["c"], folds=3, trees=30, depth=12, per_split="all", smoothing=10.0).first()
    errors = []
    for fold in range(3):
        marked = learn.assign_folds(df, "id", 3)
        train = marked.filter(F.col("fold") != fold)
        means = learn.smoothed_encoding(train, "c", "y")
        vector = VectorAssembler(inputCols=["a", "b", "c_encoded"], outputCol="features")
        model = regression.RandomForestRegressor(labelCol="y", numTrees=30, maxDepth=12, featureSubsetStrategy="all", seed=1).fit(
            vector.transform(learn.encode(train, means, "c")))
        made = model.transform(vector.transform(learn.encode(marked.filter(F.col("fold") == fold), means, "c")))
        errors.append(made.agg(F.sqrt(F.avg((F.col("y") - F.col("prediction")) ** 2))).first()[0])
    assert got.rmse == pytest.approx(np.mean(errors), rel=0.05)


def test_boosted_forecast(spark):
    t = np.arange(180)
    wave = 100 + 50 * np.sin(2 * np.pi * t / 52)
    panel = weekly(spark, {1: wave, 2: wave * 2})
    made = learn.boosted(panel, capacities(spark, {1: 200, 2: 400}), trees=10, depth=4, step=4)
    rows = {(r.id, r.h): r.prediction for r in made.collect()}
    assert len(rows) == 104
    truth = 100 + 50 * np.sin(2 * np.pi * (t[-1] + np.arange(1, 53)) / 52)
    assert np.abs(np.array([rows[1, h] for h in range(1, 53)]) - truth).mean() < 10


def test_boosted_beyond_a_season(spark):
    t = np.arange(180)
    panel = weekly(spark, {1: 100 + 50 * np.sin(2 * np.pi * t / 52)})
    made = learn.boosted(panel, capacities(spark, {1: 200}), horizon=60, trees=3, depth=3, step=20)
    assert sorted(r.h for r in made.collect()) == list(range(1, 61))


def test_boosted_reports_what_it_cannot_forecast(spark):
    t = np.arange(180)
    wave = 100 + 50 * np.sin(2 * np.pi * t / 52)
    panel = weekly(spark, {1: wave, 2: wave, 3: wave[:40], 4: wave[:52]})
    made = learn.boosted(panel, capacities(spark, {1: 200, 2: None, 3: 200}), horizon=4, trees=2, depth=2)
    errors = {r.id: r.error for r in made.filter("error IS NOT NULL").collect()}
    assert errors == {2: "capacity is missing or zero", 3: "more than 52 observations are needed", 4: "capacity is missing or zero"}
    assert made.filter("error IS NULL").count() == 4


def test_boosted_trees_are_fitted_to_occupied_bins(spark, monkeypatch):
    """Fifty-two rows a week and entity would go through every level of every tree."""
    seen = []

    class Recorded(learn.GBTRegressor):
        def fit(self, frame):
            seen.append(frame.count())
            return super().fit(frame)

    monkeypatch.setattr(learn, "GBTRegressor", Recorded)
    panel = weekly(spark, {i: [(w * 7 + i) % 4 for w in range(120)] for i in range(40)})
    made = learn.boosted(panel, capacities(spark, {i: 10 for i in range(40)}), horizon=4, trees=2, depth=2)
    assert made.filter("error IS NULL").count() == 160
    rows = learn.horizon_rows(panel, capacities(spark, {i: 10 for i in range(40)}), 4, 1).filter("target IS NOT NULL")
    # Four levels, their four seasonal values, four horizons and 32 bins of weeks
    assert len(seen) == 1 and seen[0] <= 4 * 4 * 4 * 32 < rows.count()


def test_binned_means_give_the_trees_of_all_rows(spark):
    rng = np.random.default_rng(12)
    a, b = rng.normal(0, 1, 4000), rng.integers(0, 5, 4000)
    df = spark.createDataFrame([(float(x), float(y), float(np.sin(3 * x) * y + rng.normal(0, .3))) for x, y in zip(a, b)],
                               "a double, b double, y double")
    bins = learn.quantile_bins(df, ["a", "b"])
    assert [len(s) - 1 for s in bins.getSplitsArray()] == [32, 5]
    vector = learn.VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
    every, cells = vector.transform(bins.transform(df)), vector.transform(learn.binned_means(df, bins, "y"))
    assert cells.agg(F.sum("rows")).first()[0] == 4000 and cells.count() <= 160
    gbt = learn.GBTRegressor(labelCol="y", maxIter=8, maxDepth=4, seed=27, maxBins=1024)
    whole, short = gbt.fit(every), gbt.setWeightCol("rows").fit(cells)
    for r, s in zip(*[m.transform(every.coalesce(1)).select("prediction").collect() for m in (whole, short)]):
        assert r.prediction == pytest.approx(s.prediction, abs=1e-9)
    assert learn.quantile_bins(df.filter("a > 100"), ["a", "b"]) is None


def many_cells(n):
    """Combinations of five inputs with targets that are noise: a tree grown in full has a leaf for almost each."""
    rng = np.random.default_rng(31)
    draw = lambda m: np.stack([rng.integers(0, w, m) for w in (32, 32, 32, 6, 25)], 1).astype(np.uint8)
    cells = learn._distinct(draw(n))[0]
    weight = rng.integers(1, 4, len(cells)).astype(float)
    return cells, weight, weight * rng.integers(1, 51, len(cells)), draw(n)


def test_tree_holds_sums_of_few_nodes(monkeypatch):
    """Sums of all nodes of a level, an array for each input, took several times the memory of the rows."""
    cells, weight, total, asked = many_cells(200_000)
    held = sum(x.nbytes for x in (cells, weight, total, asked))
    tracemalloc.start()
    learn.tree_means(cells, weight, total, asked, 30, 5, np.random.default_rng(1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * held
    small = [x[:4000] for x in (cells, weight, total, asked)]
    whole = learn.tree_means(*small, 30, 5, np.random.default_rng(1))
    for name, value in (("NODES_AT_ONCE", 16), ("NODES_OF_PART", 4), ("ROWS_AT_ONCE", 100)):
        monkeypatch.setattr(learn, name, value)
    assert (learn.tree_means(*small, 30, 5, np.random.default_rng(1)) == whole).all()


def test_forest_sends_rows_once_per_task(spark, monkeypatch):
    """Not once per tree, and the trees are the same however they are dealt to tasks."""
    rng = np.random.default_rng(8)
    rows = [(i % 3, i % 4 == 0, int(a), int(b), float(a + b)) for i, (a, b) in enumerate(rng.integers(0, 20, (900, 2)))]
    df = cut_lineage(spark.createDataFrame(rows, "fold int, held boolean, a int, b int, y double"))
    sent, made, dealt = [], [], type(df).repartitionById

    def counted(self, *a):
        sent.append(self.selectExpr("sum(length(bins))").first()[0])
        return dealt(self, *a)

    monkeypatch.setattr(type(df), "repartitionById", counted)
    for tasks in (1, 100):
        monkeypatch.setattr(learn, "TASKS_OF_CORE", tasks)
        made.append({(r.fold, r.a, r.b): r.prediction for r in learn.forest_means(df, ["a", "b"], "y", 24, 9, "all").collect()})
    train = 2 * sum(not r[1] for r in rows)
    assert sent == [train * -(-spark.sparkContext.defaultParallelism // 3), train * 24]
    assert made[0] == pytest.approx(made[1])
    asked = {(r[0], r[2], r[3]) for r in rows if r[1]}
    assert set(made[0]) == asked


def test_boosted_rows_are_counted_not_made(spark, monkeypatch):
    """A row per week and horizon, of which there were fifty-two times as many as weeks, went through sorts and sums."""
    rng = np.random.default_rng(14)
    panel = weekly(spark, {i: [None if i == 5 and rng.random() < .04 else float(x) for x in rng.integers(1, 90, 50 + 9 * i)] for i in range(9)})
    panel = panel.unionByName(panel.filter("id = 7 AND date > '2021-12-01'"))  # weeks that come twice
    cap = capacities(spark, {i: None if i == 3 else 100 + i for i in range(9)})
    monkeypatch.setattr(learn, "WEEKS_AT_ONCE", 70)
    stored = learn.stored_series(panel.filter("id <> 7"), cap)
    for horizon, step in ((5, 1), (60, 20)):
        rows = learn.horizon_rows(panel.filter("id <> 7"), cap, horizon, step).filter("target IS NOT NULL").withColumn("h", F.col("h").cast("double"))
        bins = learn.quantile_bins(rows, learn.BOOST_INPUTS)
        assert learn.series_bins(stored, horizon, step).getSplitsArray() == bins.getSplitsArray()
        want, got = ({tuple(r[f"{c}_bin"] for c in learn.BOOST_INPUTS): (r.rows, r.target) for r in made.collect()} for made in (
            learn.binned_means(rows, bins, "target"), learn.series_means(stored, bins, horizon, step)))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    asked = learn.horizon_rows(panel, cap, 4, 1).groupBy("id").agg(F.max("date")).collect()
    monkeypatch.setattr(learn, "horizon_rows", None)
    made = learn.boosted(panel, cap, horizon=4, trees=2, depth=2).filter("error IS NULL")
    assert {(r.id, r.h) for r in made.collect()} == {(r.id, h) for r in asked for h in range(1, 5)}


def test_summaries_keep_ranks():
    rng = np.random.default_rng(3)
    value, weight = rng.lognormal(0, 2, 300_000), rng.integers(1, 53, 300_000).astype(float)
    parts = [learn._summary(value[i::6], weight[i::6]) for i in range(6)]
    got, share = learn._summary(*(np.concatenate(x) for x in zip(*parts)))
    order = np.argsort(value)
    upto = weight[order].cumsum() / weight.sum()
    true = upto[np.searchsorted(value[order], got, "right") - 1]
    assert len(got) <= learn.SUMMARY + 1 and got[0] == value.min()
    assert np.abs(true - (share.cumsum() - share / 2) / share.sum()).max() < 1e-4


def test_iso_week():
    days = np.arange(-20_000, 40_000, 3)
    want = [d.isocalendar().week for d in days.astype("M8[D]").astype(object)]
    assert learn.iso_week(days).tolist() == want
