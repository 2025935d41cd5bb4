"""The release workflow over a folder of tables: curate, features, forecast, evaluate, select, plan, report.

Each step reads Parquet tables under one root and replaces its own, so a step can be run again on its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast import config
from panelcast.config import PlanRules
from panelcast.operators import clean, curate, evaluation as ev, features as ft, incremental as inc, quality as dq
from panelcast.operators import transfer as tp
from panelcast.plans import etl
from panelcast.session import cut_lineage
from panelcast.sources import schemas
from panelcast.sources.readers import read_details, read_entities, read_observations, read_staged, table_exists
from panelcast.sources.writers import append_run, replace_parquet, write_record

LOOKUPS = {
    "provinces": "name string, province string",
    "coordinates": "name string, latitude double, longitude double",
    "real_names": "name string, real_name string",
}


def run_etl(spark: SparkSession, raw: str, root: str, lookups: dict[str, DataFrame] | None = None) -> None:
    """Raw CSV and TSV files to the curated tables ``panel``, ``entities``, ``details`` and ``merged``."""
    lookups = {name: (lookups or {}).get(name, spark.createDataFrame([], schema)) for name, schema in LOOKUPS.items()}
    for name, table in lookups.items():
        dq.enforce_empty(dq.duplicate_keys(table, ["name"]), f"lookup {name} repeats a name")
    replace_parquet(etl.clean_observations(read_observations(spark, f"{raw}/water.csv")), f"{root}/cleaned/panel")
    append_run(spark, "observations", root, f"{root}/runs")
    panel = read_staged(spark, f"{root}/cleaned/panel")
    replace_parquet(etl.clean_entities(read_entities(spark, f"{raw}/reservoirs.csv"), panel), f"{root}/cleaned/entities")
    append_run(spark, "entities", root, f"{root}/runs")
    details = read_details(spark, f"{raw}/details.tsv").withColumn("id", F.xxhash64("NAME", "CODE", "X", "Y"))
    replace_parquet(clean.clean_details(details).drop("id"), f"{root}/cleaned/details")
    append_run(spark, "details", root, f"{root}/runs")
    manual = spark.createDataFrame(config.MANUAL_COORDINATES, LOOKUPS["coordinates"])
    tables = curate.curate(panel, read_staged(spark, f"{root}/cleaned/entities"),
                           read_staged(spark, f"{root}/cleaned/details"), lookups["provinces"],
                           lookups["coordinates"], manual, resolve_names(spark, lookups["real_names"]))
    for name, table in tables.items():
        replace_parquet(table, f"{root}/{name}")
    dq.enforce_empty(curate.invalid_points(read_staged(spark, f"{root}/merged")), "merged coordinates")
    for name in config.FINAL_COLUMNS:
        replace_parquet(curate.final_columns(read_staged(spark, f"{root}/{name}"), name), f"{root}/final/{name}")
    # What an outside lookup should be asked next
    merged = read_staged(spark, f"{root}/merged")
    wanted = [curate.to_resolve(merged, column, lookups[table]).withColumn("wanted", F.lit(column))
              for column, table in (("province", "provinces"), ("latitude", "coordinates"), ("real_name", "real_names"))]
    replace_parquet(wanted[0].unionByName(wanted[1]).unionByName(wanted[2]), f"{root}/outputs/to_resolve")
    append_run(spark, "curated", root, f"{root}/runs")


def resolve_names(spark: SparkSession, looked_up: DataFrame) -> DataFrame:
    """Display names: the useful part of each looked-up answer without prefixes, then the reviewed corrections."""
    from panelcast.functions.text import matching_part, strip_prefixes

    part = strip_prefixes(matching_part(F.col("name"), F.col("real_name")))
    resolved = looked_up.select("name", part.alias("real_name")).filter(F.col("real_name").isNotNull())
    schema = LOOKUPS["real_names"]
    reviewed = spark.createDataFrame(list(config.MANUAL_REAL_NAMES.items()), schema).join(resolved.select("name"), "name", "left_semi")
    missing = spark.createDataFrame(list(config.MISSING_REAL_NAMES.items()), schema)
    return curate.override([resolved, reviewed, missing], "name", "real_name")


def load_curated(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The panel and the merged entity table."""
    return read_staged(spark, f"{root}/panel"), read_staged(spark, f"{root}/merged")


def run_features(spark: SparkSession, root: str) -> None:
    panel, entities = load_curated(spark, root)
    known = entities.select("id", "capacity")
    listed = curate.keep_listed(panel, known)
    etl.check_curated(listed, known)
    ft.require_metadata(listed, known)
    replace_parquet(ft.build_features(listed, known), f"{root}/outputs/features")


def run_forecast(spark: SparkSession, root: str, community: str | None = "andalucia",
                 models: Sequence[str] = ("seasonal_naive", "trend_seasonal")) -> DataFrame:
    """Forecast a community's entities, reusing stored forecasts; returns the computed and reused counts."""
    panel, entities = load_curated(spark, root)
    chosen = entities.filter(tp.Area(community).holds())
    forecasts, counts = inc.forecast_with_ledger(spark, curate.keep_listed(panel, chosen), chosen,
                                                 f"{root}/ledger/forecasts", models)
    if forecasts.isEmpty():
        raise ValueError("no entity could be forecast; the forecast ledger's failures say why")
    replace_parquet(forecasts.drop("digest"), f"{root}/outputs/forecasts")
    return counts


def run_evaluation(spark: SparkSession, root: str, split_ids: DataFrame, split: str, models: Sequence[str],
                   limit: int = 0, include_ensemble: bool = True) -> DataFrame:
    """Backtest the next pending entities of a split; the table of all its metrics so far is replaced."""
    panel, entities = load_curated(spark, root)
    dq.enforce_empty(curate.missing_members(split_ids, entities), f"{split} ids without metadata")
    metrics = inc.evaluate_with_ledger(spark, panel, entities, split_ids, split, models, f"{root}/ledger/metrics",
                                       limit, include_ensemble=include_ensemble)
    replace_parquet(metrics, f"{root}/outputs/evaluation_{split}")
    return read_staged(spark, f"{root}/outputs/evaluation_{split}")


def analyze_validation(spark: SparkSession, root: str, split_ids: DataFrame, models: Sequence[str],
                       origins: int = config.ORIGINS) -> DataFrame:
    """Rank the models on complete validation metrics and store the decision record."""
    metrics = read_staged(spark, f"{root}/outputs/evaluation_validation")
    dq.enforce_empty(dq.coverage(metrics, split_ids, [*models, config.ENSEMBLE_MODEL], origins), "validation coverage")
    record = ev.decision_record(ev.rank_models(metrics), metrics, config.ENSEMBLE_WEIGHTS)
    write_record(record, f"{root}/outputs/validation_decision")
    return spark.read.schema(record.schema).json(f"{root}/outputs/validation_decision")


def run_test(spark: SparkSession, root: str, split_ids: DataFrame, limit: int = 0) -> DataFrame:
    """Evaluate the test split with the model that the validation decision selected, and with no other."""
    decision = f"{root}/outputs/validation_decision"
    if not table_exists(spark, decision):
        raise ValueError("the test split waits for a validation decision")
    chosen = spark.read.schema("selected_model string").json(decision).first()["selected_model"]
    blend = chosen == config.ENSEMBLE_MODEL
    models = list(config.ENSEMBLE_WEIGHTS) if blend else [chosen]
    metrics = run_evaluation(spark, root, split_ids, "test", models, limit, include_ensemble=blend)
    locked = cut_lineage(metrics.filter(F.col("model") == chosen))
    replace_parquet(locked, f"{root}/outputs/evaluation_test")
    return read_staged(spark, f"{root}/outputs/evaluation_test")


def run_validation_report(spark: SparkSession, root: str, split: str, models: Sequence[str],
                          horizon: int = config.HORIZON, origins: int = config.ORIGINS,
                          include_ensemble: bool = True) -> DataFrame:
    """The latest origin of each stored evaluation beside the history before it, ready to draw."""
    panel, _ = load_curated(spark, root)
    name = inc.configuration_name(models, horizon, origins, include_ensemble)
    stored = inc.results(spark, f"{root}/ledger/metrics", "predictions", schemas.PREDICTIONS).filter(
        (F.col("split") == split) & (F.col("configuration") == name))
    return inc.validation_report(curate.keep_listed(panel, stored.select("id").distinct()), stored)


def analyze_test(spark: SparkSession, root: str, split_ids: DataFrame, model: str,
                 origins: int = config.ORIGINS) -> dict[str, DataFrame]:
    """Distribution, per-origin means, worst entities and the comparison with validation of the locked model."""
    metrics = read_staged(spark, f"{root}/outputs/evaluation_test")
    dq.enforce_empty(dq.coverage(metrics, split_ids, [model], origins), "test coverage")
    validation = read_staged(spark, f"{root}/outputs/evaluation_validation").filter(F.col("model") == model)
    both = metrics.unionByName(validation.select(metrics.columns))
    return {"statistics": ev.metric_distribution(metrics), "by_origin": ev.mean_by(metrics, "origin"),
            "worst_entities": ev.worst_entities(metrics), "validation_comparison": ev.compare_splits(both)}


def run_plan(spark: SparkSession, root: str, area: tp.Area = tp.Area(), settings: PlanRules = PlanRules(),
             models: Sequence[str] = ("seasonal_naive", "trend_seasonal"), max_iterations: int = 10) -> None:
    """Select the area first, forecast it through the ledger, then plan transfers inside it."""
    panel, entities = load_curated(spark, root)
    chosen = cut_lineage(entities.filter(area.holds()))
    panel = curate.keep_listed(panel, chosen)
    forecasts, _ = inc.forecast_with_ledger(spark, panel, chosen, f"{root}/ledger/forecasts", models)
    summary = ev.forecast_summary(panel, forecasts.filter(F.col("model") == config.ENSEMBLE_MODEL))
    whole = chosen.withColumn("region", F.lit("selected"))
    state, log = tp.plan_transfers(tp.prepare_state(whole, summary, settings), settings, max_iterations)
    replace_parquet(state, f"{root}/outputs/transfer_final_state")
    replace_parquet(log, f"{root}/outputs/transfer_log")


def run_report(spark: SparkSession, root: str) -> DataFrame:
    """Recent history and stored forecasts, ready to draw."""
    panel, _ = load_curated(spark, root)
    forecasts = read_staged(spark, f"{root}/outputs/forecasts")
    return inc.forecast_report(curate.keep_listed(panel, forecasts.select("id").distinct()), forecasts)
