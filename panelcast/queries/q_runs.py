"""Source, sink, incremental and learning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast import config
from panelcast.operators import backtest as bt, features as ft, forecast as fc, incremental as inc, learn
from panelcast.queries import fixtures as fx
from panelcast.queries.q_forecast import BACKTEST, NAIVE, NUMBERED, TWO_MODELS, metrics
from panelcast.queries.registry import query, with_ctes
from panelcast.session import scratch_path
from panelcast.sources import readers, writers


@query("src01_observations_csv", with_ctes([fx.WK, fx.RAW], """SELECT date AS DATE, id AS ID, storage AS CURRENT_WATER
 FROM raw_txt"""))
def _(spark, sf):
    path = scratch_path(spark, "observations")
    raw = fx.raw_text(spark, sf).select(F.col("date").alias("DATE"), F.col("id").alias("ID"),
                                        F.col("storage").alias("CURRENT_WATER"))
    writers.write_csv(raw, path)
    return readers.read_observations(spark, path)


@query("src02_entities_csv", with_ctes([fx.DIMS], """SELECT id AS ID, community AS SCOPE_NAME, name AS RESERVOIR_NAME,
 CASE WHEN id % 7 <> 0 THEN CAST(id * 10 AS VARCHAR) END AS TOTAL_WATER, id % 2 AS ELECTRIC_FLAG FROM dims"""))
def _(spark, sf):
    path = scratch_path(spark, "entities")
    raw = fx.dims(spark, sf).select(
        F.col("id").alias("ID"), F.col("community").alias("SCOPE_NAME"), F.col("name").alias("RESERVOIR_NAME"),
        F.when(F.col("id") % 7 != 0, (F.col("id") * 10).cast("string")).alias("TOTAL_WATER"),
        (F.col("id") % 2).alias("ELECTRIC_FLAG"))
    writers.write_csv(raw, path)
    return readers.read_entities(spark, path)


@query("src03_details_tsv", with_ctes([fx.DETAIL], """SELECT name AS NAME, riverbed AS RIVERBED, crest_elevation AS CREST_ELEVATION,
 province AS PROVINCE, type AS TYPE, 'a, b' AS REPORT FROM detail"""))
def _(spark, sf):
    path = scratch_path(spark, "details")
    made = {"NAME": "name", "RIVERBED": "riverbed", "CREST_ELEVATION": "crest_elevation", "PROVINCE": "province",
            "TYPE": "type"}
    from panelcast.sources.schemas import DETAILS_RAW
    columns = [c.split()[0] for c in DETAILS_RAW.split(", ")]
    raw = fx.detail(spark, sf).select(*[
        (F.col(made[c]) if c in made else F.lit("a, b" if c == "REPORT" else None).cast("string")).alias(c)
        for c in columns])
    writers.write_csv(raw, path, sep="\t")
    return readers.read_details(spark, path).select(*made, "REPORT")


@query("src04_staged_table", with_ctes([fx.PANEL], "SELECT id, date, storage, storage_imputed FROM panel", t="date"))
def _(spark, sf):
    from panelcast.sources.schemas import PANEL
    path = scratch_path(spark, "panel")
    writers.replace_parquet(fx.panel(spark, sf), path)
    return readers.read_staged(spark, path, PANEL)


@query("src05_saved_output", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=52)], "SELECT id, h, date, prediction FROM naive", t="date"))
def _(spark, sf):
    path = scratch_path(spark, "forecasts")
    writers.replace_parquet(fc.seasonal_naive(fx.panel(spark, sf)).select("id", "h", "date", "prediction"), path)
    return readers.read_staged(spark, path)


@query("src06_sample_panel", """SELECT strftime(DATE '2018-01-07' + CAST(w * 7 AS INTEGER), '%d/%m/%Y') AS date, s_suppkey AS id,
 round(greatest(0, 500 + 200 * sin(w / 26.0::DOUBLE)), 6) + 0.0 AS storage FROM supplier,
 (SELECT unnest(generate_series(0, 259)) AS w)""")
def _(spark, sf):
    ids = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return readers.sample_panel(ids, noise=0.0)


@query("src06_sample_panel_noise")
def _(spark, sf):
    return readers.sample_panel(fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")))


@query("snk01_write_csv", with_ctes([fx.PANEL], "SELECT id, date, storage FROM panel", t="date"))
def _(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(fx.panel(spark, sf).select("id", "date", "storage"), f"{path}/tables/panel")
    return readers.read_csv(spark, f"{path}/tables/panel", "id long, date date, storage double")


@query("snk02_replace_table", with_ctes([fx.WK], "SELECT id, date, storage * 2 AS storage FROM wk", t="date"))
def _(spark, sf):
    path = scratch_path(spark, "replaced")
    writers.replace_parquet(fx.readings(spark, sf), path)
    # The second version is computed from the first one
    writers.replace_parquet(spark.read.parquet(path).withColumn("storage", F.col("storage") * 2), path)
    return spark.read.parquet(path)


@query("snk03_run_ledger")
def _(spark, sf):
    path = scratch_path(spark, "runs")
    rows = fx.panel(spark, sf).count()
    for stage in ("observations", "entities"):
        writers.append_run(spark, stage, sf, path)
    return spark.read.schema("stage string, generated_at_utc timestamp, data_root string").json(path).select(
        "stage", "data_root", F.lit(rows).alias("panel_rows"))


MODELS = "['seasonal_naive', 'sarima', 'trend_seasonal']"


@query("inc01_fingerprint", with_ctes([fx.PANEL, fx.CAP], """SELECT p.id, sha256(string_agg(strftime(date, '%Y-%m-%d') || ':' ||
 CAST(storage AS VARCHAR), '|' ORDER BY date) || '|' || coalesce(CAST(any_value(capacity) AS VARCHAR), 'none')
 || '|seasonal_naive,sarima|52') AS digest FROM panel p JOIN cap ON cap.id = p.id GROUP BY p.id"""))
def _(spark, sf):
    return inc.fingerprints(fx.panel(spark, sf), fx.capacity(spark, sf), ["seasonal_naive", "sarima"])


@query("inc02_work_list", with_ctes([fx.PANEL], "SELECT DISTINCT id FROM panel WHERE id % 4 = 0 OR id % 9 = 1"))
def _(spark, sf):
    panel, cap = fx.panel(spark, sf), fx.no_capacity(spark, sf)
    now = inc.fingerprints(panel, cap, ["seasonal_naive"])
    # The stored run lacks some entities and saw another value for others
    before = panel.filter("id % 4 <> 0").withColumn(
        "storage", F.when((F.col("id") % 9 == 1) & (F.dayofyear("date") < 40), F.col("storage") + 1)
        .otherwise(F.col("storage")))
    return inc.work_list(now, inc.fingerprints(before, cap, ["seasonal_naive"])).select("id")


@query("inc02_forecast_ledger", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=52)],
                                          """SELECT id, model, h, date, prediction FROM (SELECT *, unnest(['seasonal_naive', 'ensemble']) AS model FROM naive)""",
                                          t="date"))
def _(spark, sf):
    path = scratch_path(spark, "ledger")
    panel, cap = fx.stored_panel(spark, sf)
    cap = cap.filter(F.lit(False))
    inc.forecast_with_ledger(spark, panel.filter("id % 3 <> 0"), cap, path, ["seasonal_naive"])
    forecasts, _ = inc.forecast_with_ledger(spark, panel, cap, path, ["seasonal_naive"])
    return forecasts.drop("digest")


@query("inc03_pending_origins", with_ctes([BACKTEST], """SELECT s_suppkey AS id, o AS origin FROM supplier,
 (SELECT unnest([0, 1, 2]) AS o) WHERE (s_suppkey, o) NOT IN (SELECT (id, origin) FROM metrics WHERE id % 3 <> 0 OR origin = 0)"""))
def _(spark, sf):
    ledger = metrics(spark, sf).filter("id % 3 <> 0 OR origin = 0").withColumn("configuration", F.lit("now"))
    stale = ledger.withColumn("configuration", F.lit("older"))
    ids = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return inc.pending_origins(ids, ledger.unionByName(stale), "now", 3)


@query("inc03_resumed_evaluation")
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    panel, cap = fx.stored_panel(spark, sf, gaps=False)
    ids = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("position"))
    half = fx.table(spark, sf, "supplier").count() // 2
    inc.evaluate_with_ledger(spark, panel, cap, ids, "validation", ["seasonal_naive"], path, limit=half)
    done = inc.evaluate_with_ledger(spark, panel, cap, ids, "validation", ["seasonal_naive"], path)
    return done.groupBy("model").agg(F.count_distinct("id").alias("entities"), F.count(F.lit(1)).alias("metric_rows"),
                                     F.avg("mae").alias("mae"))


# One manifest per customer and segment, told by customer fields
MANIFEST_SQL = """manifests AS (SELECT c_custkey AS id, c_mktsegment AS configuration, CASE WHEN c_custkey % 5 = 0
 THEN 'in_progress' ELSE 'complete' END AS status, c_custkey % 7 <> 0 AS recorded, 3 AS origins, c_custkey % 4 AS done FROM customer)"""


def manifests(spark, sf):
    key = F.col("c_custkey")
    done = F.when(key % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (key % 4 - 1).cast("int")))
    return fx.table(spark, sf, "customer").select(
        key.alias("id"), F.col("c_mktsegment").alias("configuration"),
        F.when(key % 5 == 0, "in_progress").otherwise("complete").alias("status"),
        (key % 7 != 0).alias("failure_recorded"), F.array(F.lit("seasonal_naive"), F.lit("sarima")).alias("models"),
        F.lit(52).alias("horizon"), F.lit(3).alias("origins"), done.alias("completed_origins"))


@query("jsn01_manifest_complete", with_ctes([MANIFEST_SQL], """SELECT id, status = 'complete' AND recorded AND done = 3 AS complete
 FROM manifests"""))
def _(spark, sf):
    written = manifests(spark, sf).select("id", F.to_json(F.struct(
        "status", "failure_recorded", "models", "horizon", "origins", "completed_origins")).alias("text"))
    manifest = inc.parse_manifest(F.col("text"))
    return written.withColumn("m", manifest).select(
        "id", inc.is_complete(F.col("m"), ["seasonal_naive", "sarima"], 52, 3).alias("complete"))


@query("inc04_assemble", with_ctes([MANIFEST_SQL], """SELECT id, configuration, id * 0.5::DOUBLE AS mae FROM manifests
 WHERE status = 'complete' AND recorded AND done = 3"""))
def _(spark, sf):
    m = manifests(spark, sf)
    return inc.assemble(m.select("id", "configuration", (F.col("id") * 0.5).alias("mae")), m)


@query("inc04_configuration_counts", with_ctes([MANIFEST_SQL], """SELECT count(*) AS configurations, count(*) FILTER (NOT any_done)
 AS ignored_configurations FROM (SELECT configuration || '-' || id % 60 AS c, bool_or(status = 'complete' AND recorded AND done = 3)
 AS any_done FROM manifests GROUP BY 1)"""))
def _(spark, sf):
    m = manifests(spark, sf)
    return inc.configuration_counts(m.withColumn("configuration", F.concat_ws(
        "-", "configuration", (F.col("id") % 60).cast("string"))))


@query("inc05_forecast_report", with_ctes([fx.PANEL, NUMBERED, NAIVE.format(H=52)], """SELECT id, date, 'observed' AS series,
 storage AS value FROM numbered WHERE rn > n - 104 UNION ALL SELECT id, date, 'seasonal_naive', prediction FROM naive""", t="date"))
def _(spark, sf):
    panel = fx.panel(spark, sf)
    return inc.forecast_report(panel, fc.seasonal_naive(panel).withColumn("model", F.lit("seasonal_naive")))


@query("inc05_validation_report", with_ctes([BACKTEST, """latest AS (SELECT b.* FROM backtest b JOIN (SELECT id, max(origin) AS o
 FROM backtest GROUP BY id) m ON m.id = b.id AND m.o = b.origin), span AS (SELECT id, min(date) AS f, max(date) AS t FROM latest
 GROUP BY id)"""], """SELECT p.id, p.date, 'observed' AS series, storage AS value FROM panel p JOIN span s ON s.id = p.id
 AND p.date >= s.f - INTERVAL 48 MONTH AND p.date <= s.t UNION ALL SELECT id, date, model, prediction FROM latest""", t="date", d="value"))
def _(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf)
    return inc.validation_report(panel, bt.backtest(panel, capacity, TWO_MODELS)[0])


@query("win16_report_window", with_ctes([BACKTEST, """span AS (SELECT id, min(date) AS f, max(date) AS t FROM (SELECT b.* FROM
 backtest b JOIN (SELECT id, max(origin) AS o FROM backtest GROUP BY id) m ON m.id = b.id AND m.o = b.origin) GROUP BY id)"""],
                                        """SELECT p.id, count(*) AS rows, min(p.date) AS first_date, max(p.date) AS last_date FROM panel p JOIN span s ON s.id = p.id
 AND p.date >= s.f - INTERVAL 48 MONTH AND p.date <= s.t GROUP BY p.id""", t="first_date last_date"))
def _(spark, sf):
    panel, capacity = fx.stored_panel(spark, sf)
    report = inc.validation_report(panel, bt.backtest(panel, capacity, TWO_MODELS)[0]).filter("series = 'observed'")
    return report.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"),
                                    F.max("date").alias("last_date"))


# --- learning -------------------------------------------------------------------
STACK = """stack AS (SELECT id, rn, n, storage AS y, lag(storage, 52) OVER w AS one_year, lag(storage, 104) OVER w AS two_years
 FROM numbered WINDOW w AS (PARTITION BY id ORDER BY rn)), fit AS (SELECT id, count(*)::DOUBLE AS c, avg(y) AS my,
 avg(one_year) AS m1, avg(two_years) AS m2, covar_pop(one_year, one_year) * count(*) + {alpha} AS a11,
 covar_pop(two_years, two_years) * count(*) + {alpha} AS a22, covar_pop(one_year, two_years) * count(*) AS a12,
 covar_pop(one_year, y) * count(*) AS b1, covar_pop(two_years, y) * count(*) AS b2 FROM stack
 WHERE two_years IS NOT NULL AND rn <= n - 52 GROUP BY id), solved AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1,
 (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS w2 FROM fit)"""
STACK_BODY = """SELECT s.id, s.rn AS position, (my - w1 * m1 - w2 * m2) + w1 * one_year + w2 * two_years AS prediction
 FROM stack s JOIN solved f ON f.id = s.id WHERE s.rn > s.n - 52 AND two_years IS NOT NULL"""


def stacked(spark, sf, alpha):
    rows = bt.positioned(fx.panel(spark, sf))
    rows = rows.withColumns({"one_year": F.lag("storage", 52).over(ft.by_date()),
                             "two_years": F.lag("storage", 104).over(ft.by_date())})
    inputs = ["one_year", "two_years"]
    known = learn.complete_cases(rows, inputs)
    weights = learn.fit_stack(known.filter("_rn <= _n - 52"), ["id"], "storage", inputs, alpha)
    made = learn.apply_stack(known.filter("_rn > _n - 52"), weights, ["id"], inputs)
    return made.select("id", F.col("_rn").alias("position"), "prediction")


@query("fc10_linear_stacking", with_ctes([fx.PANEL, NUMBERED, STACK.format(alpha=0)], STACK_BODY, d="prediction"))
def _(spark, sf):
    return stacked(spark, sf, 0.0)


@query("fc11_ridge_stacking", with_ctes([fx.PANEL, NUMBERED, STACK.format(alpha=1)], STACK_BODY, d="prediction"))
def _(spark, sf):
    return stacked(spark, sf, 1.0)


#: Out-of-fold predictions of two models, and weights for each block from the blocks before it
BLOCKS = """folds AS (SELECT DISTINCT id, n, i, n - 52 * (n // 52) + 52 * (i + 4) AS e FROM numbered,
 (SELECT unnest(generate_series(0, 30)) AS i) WHERE i + 5 <= n // 52),
 blocks AS (SELECT f.id, f.i AS origin, t.rn - f.e AS h, t.date, t.storage AS y, p.storage AS x1,
 (p.storage + q.storage) / 2 AS x2 FROM folds f JOIN numbered t ON t.id = f.id AND t.rn > f.e AND t.rn <= f.e + 52
 JOIN numbered p ON p.id = f.id AND p.rn = t.rn - 52 JOIN numbered q ON q.id = f.id AND q.rn = t.rn - 104),
 fit AS (SELECT b.id, b.origin, count(*)::DOUBLE AS c, avg(t.y) AS my, avg(t.x1) AS m1, avg(t.x2) AS m2,
 covar_pop(t.x1, t.x1) * count(*) + {alpha} AS a11, covar_pop(t.x2, t.x2) * count(*) + {alpha} AS a22,
 covar_pop(t.x1, t.x2) * count(*) AS a12, covar_pop(t.x1, t.y) * count(*) AS b1, covar_pop(t.x2, t.y) * count(*) AS b2
 FROM (SELECT id, origin, min(date) AS begins FROM blocks GROUP BY id, origin) b JOIN blocks t ON t.id = b.id AND t.date < b.begins
 GROUP BY b.id, b.origin), solved AS (SELECT *, (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) AS w1,
 (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) AS w2 FROM fit)"""
BLOCKS_BODY = """SELECT b.id, b.origin, h, date, y AS actual, 'stacked' AS model,
 (my - w1 * m1 - w2 * m2) + w1 * x1 + w2 * x2 AS prediction FROM blocks b JOIN solved s ON s.id = b.id AND s.origin = b.origin"""


def stacked_blocks(spark, sf, alpha):
    panel, capacity = fx.stored_panel(spark, sf)
    names = ["seasonal_naive", "seasonal_mean"]
    made, _ = bt.score(*bt.fold_blocks(panel), capacity.filter(F.lit(False)), fc.pick_models(names), include_ensemble=False)
    return learn.stack_blocks(made, names, alpha)


@query("fc10_stacking_on_predictions", with_ctes([fx.PANEL, NUMBERED, BLOCKS.format(alpha=0)], BLOCKS_BODY, t="date", d="actual prediction"))
def _(spark, sf):
    return stacked_blocks(spark, sf, 0.0)


@query("fc11_ridge_on_predictions", with_ctes([fx.PANEL, NUMBERED, BLOCKS.format(alpha=1)], BLOCKS_BODY, t="date", d="actual prediction"))
def _(spark, sf):
    return stacked_blocks(spark, sf, 1.0)


@query("fc13_chronological_split", with_ctes([fx.PANEL, NUMBERED, """lagged AS (SELECT id, date, lag(storage, 52) OVER
 (PARTITION BY id ORDER BY date) AS one_year FROM numbered), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date)
 AS r, count(*) OVER (PARTITION BY id) AS c FROM lagged WHERE one_year IS NOT NULL)"""], """SELECT id, date, one_year,
 CASE WHEN r <= floor(c * 0.9::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM ranked""", t="date"))
def _(spark, sf):
    rows = fx.panel(spark, sf).select("id", "date", F.lag("storage", 52).over(ft.by_date()).alias("one_year"))
    return learn.chronological_split(learn.complete_cases(rows, ["one_year"]))


@query("fc09_boosted_trees")
def _(spark, sf):
    return learn.boosted(*fx.stored_panel(spark, sf, gaps=False))


TRAIN = "fold AS (SELECT *, id % 5 = 0 AS held FROM points)"


@query("agg22_mean_encoding", with_ctes([fx.POINTS, TRAIN], """SELECT f.id, f.brand, e.m AS brand_encoded FROM fold f LEFT JOIN (
 SELECT brand, avg(dam_height) AS m FROM fold WHERE NOT held AND brand <> 'Brand#7' GROUP BY brand) e ON e.brand = f.brand""", d="brand_encoded"))
def _(spark, sf):
    points = fx.parts_on_map(spark, sf).select("id", "brand", "dam_height")
    table = learn.mean_encoding(points.filter("id % 5 <> 0 AND brand <> 'Brand#7'"), "brand", "dam_height")
    return learn.encode(points.select("id", "brand"), table, "brand")


@query("agg23_smoothed_encoding", with_ctes([fx.POINTS, TRAIN, """train AS (SELECT * FROM fold WHERE NOT held AND brand <> 'Brand#7'),
 g AS (SELECT avg(dam_height) AS gm FROM train), e AS (SELECT brand, avg(dam_height) AS m, 1 / (1 + exp(-(count(*) - 10.0))) AS w
 FROM train GROUP BY brand)"""], """SELECT f.id, f.brand, coalesce(gm * (1 - w) + m * w, gm) AS brand_encoded FROM fold f
 LEFT JOIN e ON e.brand = f.brand, g""", d="brand_encoded"))
def _(spark, sf):
    points = fx.parts_on_map(spark, sf).select("id", "brand", "dam_height")
    train = points.filter("id % 5 <> 0 AND brand <> 'Brand#7'")
    table = learn.smoothed_encoding(train, "brand", "dam_height")
    return learn.encode(points.select("id", "brand"), table, "brand", train.agg(F.avg("dam_height")).scalar())


@query("ml03_min_max_scaling", with_ctes([fx.POINTS], """SELECT id, (dam_height - lo) / (hi - lo) AS dam_height,
 (longitude - xlo) / (xhi - xlo) AS longitude FROM points, (SELECT min(dam_height) AS lo, max(dam_height) AS hi, min(longitude) AS xlo,
 max(longitude) AS xhi FROM points WHERE id % 5 <> 0)""", d="dam_height longitude"))
def _(spark, sf):
    points = fx.parts_on_map(spark, sf).select("id", "dam_height", "longitude")
    return learn.min_max_scale(points.filter("id % 5 <> 0"), points, ["dam_height", "longitude"])


INPUTS = ["longitude", "latitude", "crest_elevation"]
#: The reference's forests: 100 trees, split on any input, grown in full (Spark allows a depth of 30)
FOREST = {"trees": 100, "depth": 30, "per_split": "all"}


@query("ml01_forest_cv")
def _(spark, sf):
    return learn.cross_validate(fx.parts_on_map(spark, sf), "dam_height", INPUTS, folds=10, **FOREST)


@query("ml01_forest_cv_encoded")
def _(spark, sf):
    return learn.cross_validate(fx.parts_on_map(spark, sf), "dam_height", INPUTS, ["type", "brand"], folds=5, smoothing=10.0,
                                **FOREST)


@query("ml02_forward_selection")
def _(spark, sf):
    points = fx.parts_on_map(spark, sf).withColumn("noise", F.pmod(F.xxhash64("id"), F.lit(17)).cast("double"))
    chosen = learn.forward_selection(points, "dam_height", [*INPUTS, "noise"], keep=2, folds=3, **FOREST)
    return spark.createDataFrame([(i, name, rmse) for i, (name, rmse) in enumerate(chosen)],
                                 "step int, input string, rmse double")


# --- flows ------------------------------------------------------------------------
@query("etl_observations", with_ctes([fx.WK, fx.RAW, """kept AS (SELECT id, strptime(date, '%d/%m/%Y')::DATE AS date,
 TRY_CAST(storage AS DOUBLE) AS storage FROM raw_txt WHERE NOT (id = 3 AND year(strptime(date, '%d/%m/%Y')) < 1997)),
 g AS (SELECT b.id, b.date, k.storage FROM (SELECT id, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP,
 INTERVAL 7 DAY)) AS DATE) AS date FROM kept GROUP BY id) b LEFT JOIN kept k ON k.id = b.id AND k.date = b.date)"""],
                                     """SELECT * FROM (SELECT id, date, first_value(storage IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW
 AND UNBOUNDED FOLLOWING) AS storage, CAST(storage IS NULL AS BIGINT) AS storage_imputed FROM g) WHERE storage IS NOT NULL""", t="date"))
def _(spark, sf):
    from panelcast.plans.etl import clean_observations
    raw = fx.raw_text(spark, sf).withColumnsRenamed({"id": "ID", "date": "DATE", "storage": "CURRENT_WATER"})
    return clean_observations(raw, exclusions=[(3, 1997)])
