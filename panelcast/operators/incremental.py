"""Recompute only what changed: fingerprints, ledgers, work lists and report extracts.

Ledger tables (forecasts, metrics, manifests) are append-only Parquet; "what is left to do" is an anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelcast import config
from panelcast.operators.backtest import backtest, origin_ends
from panelcast.operators.evaluation import error_metrics
from panelcast.operators.features import last_rows
from panelcast.operators.forecast import pick_models, run_models, split_failures
from panelcast.operators.quality import enforce_empty
from panelcast.session import cut_lineage
from panelcast.sources import schemas
from panelcast.sources.readers import read_or_empty
from panelcast.sources.writers import append_parquet

MANIFEST_JSON = ("status string, failure_recorded boolean, models array<string>, horizon int, origins int, "
                 "include_ensemble boolean, completed_origins array<int>")


def fingerprints(panel: DataFrame, capacity: DataFrame, models: Sequence[str],
                 horizon: int = config.HORIZON) -> DataFrame:
    """SHA-256 per entity over its ordered series, capacity, models and horizon, numbers at full precision.

    The text of one entity holds at most one reading per week, so its list is bounded by the calendar.
    """
    reading = F.concat_ws(":", F.date_format("date", "yyyy-MM-dd"), F.col("storage").cast("string"))
    texts = panel.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(reading)), "|").alias("_text"))
    tail = f"{','.join(models)}|{horizon}"
    known = F.when(F.col("capacity").isNull(), "none").otherwise(F.col("capacity").cast("string"))
    return (texts.join(capacity.select("id", "capacity"), "id", "left")
            .select("id", F.sha2(F.concat_ws("|", "_text", known, F.lit(tail)), 256).alias("digest")))


def work_list(digests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Entities whose current fingerprint is not in the ledger."""
    return digests.join(ledger.select("id", "digest"), ["id", "digest"], "left_anti")


def stored(digests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows that are still valid."""
    return ledger.join(digests, ["id", "digest"], "left_semi")


def forecast_with_ledger(spark: SparkSession, panel: DataFrame, capacity: DataFrame, path: str,
                         models: Sequence[str] = ("seasonal_naive", "sarima", "trend_seasonal"),
                         horizon: int = config.HORIZON) -> tuple[DataFrame, DataFrame]:
    """Forecast only changed entities, append them to the ledger and return all valid forecasts.

    Forecasts and failures of an entity are rows of one table and of one file, written in one append, so a run that
    breaks off leaves all of an entity or nothing of it, and is simply repeated. An entity counts as known once each model has
    forecasts or a recorded failure; one none of whose models works isn't fitted again before its series, capacity or
    models change. The second table counts entities answered from the ledger, entities computed now, and entities
    without any forecast.
    """
    digests = cut_lineage(fingerprints(panel, capacity, models, horizon))
    chosen = pick_models(models)
    pending = cut_lineage(work_list(digests, answered(read_or_empty(spark, path, schemas.FORECASTS), list(chosen))))
    every = cut_lineage(run_models(panel.join(pending, "id", "left_semi"), capacity, chosen, horizon))
    fresh, failures = split_failures(every, capacity)
    none = F.lit(None)
    rows = (fresh.withColumn("error", none.cast("string")).select("id", "model", "h", "date", "prediction", "error")
            .unionByName(failures.select("id", "model", none.cast("int").alias("h"), none.cast("date").alias("date"),
                                         none.cast("double").alias("prediction"), "error")))
    typed = [F.col(c).cast(t).alias(c) for c, t in (field.split() for field in schemas.FORECASTS.split(", "))]
    append_parquet(rows.join(pending, "id").select(*typed).repartition("id"), path)
    valid = stored(digests, read_or_empty(spark, path, schemas.FORECASTS)).filter(F.col("error").isNull()).drop("error")
    served = valid.select("id").distinct()
    total = digests.agg(F.count(F.lit(1))).scalar()
    skipped = digests.join(served, "id", "left_anti").agg(F.count(F.lit(1))).scalar()
    counts = pending.agg(F.count(F.lit(1)).alias("computed")).withColumns(
        {"from_ledger": total - F.col("computed"), "skipped": skipped})
    return valid, counts


def answered(ledger: DataFrame, models: Sequence[str]) -> DataFrame:
    """(id, digest) pairs of which the ledger knows how each of the models went."""
    kinds = F.count_distinct(F.when(F.col("model").isin(list(models)), F.col("model")))
    return ledger.groupBy("id", "digest").agg(kinds.alias("_n")).filter(F.col("_n") == len(models)).drop("_n")


def forecast_failures(spark: SparkSession, digests: DataFrame, path: str) -> DataFrame:
    """``id, digest, model, error`` of the models that failed on the present state of an entity."""
    failed = read_or_empty(spark, path, schemas.FORECASTS).filter(F.col("error").isNotNull())
    return stored(digests, failed.select("id", "digest", "model", "error")).dropDuplicates(["id", "digest", "model"])


def is_complete(manifest: Column, models: Sequence[str], horizon: int, origins: int,
                include_ensemble: bool = True) -> Column:
    """Whether a stored manifest (struct) is finished and belongs to this configuration."""
    return F.coalesce(
        (manifest["status"] == "complete") & (manifest["failure_recorded"])
        & (manifest["models"] == F.array(*[F.lit(m) for m in models])) & (manifest["horizon"] == horizon)
        & (manifest["origins"] == origins)
        & (F.coalesce(manifest["include_ensemble"], F.lit(True)) == include_ensemble)
        & (F.size(manifest["completed_origins"]) == origins), F.lit(False))


def parse_manifest(text: Column) -> Column:
    return F.from_json(text, MANIFEST_JSON)


def pending_origins(ids: DataFrame, ledger: DataFrame, configuration: str, origins: int,
                    models: Sequence[str] = ()) -> DataFrame:
    """(id, origin) pairs of the split that the ledger does not hold under this configuration.

    With ``models`` a pair is held only if each of them has a row, be it metrics or a recorded failure.
    """
    wanted = ids.select("id").distinct().withColumn("origin", F.explode(F.sequence(F.lit(0), F.lit(origins - 1))))
    done = ledger.filter(F.col("configuration") == configuration)
    if not models:
        return wanted.join(done.select("id", "origin"), ["id", "origin"], "left_anti")
    each = wanted.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return each.join(done.select("id", "origin", "model"), ["id", "origin", "model"], "left_anti").select("id", "origin").distinct()


def next_entities(pending: DataFrame, positions: DataFrame, limit: int) -> DataFrame:
    """The first pending entities in split order; 0 takes them all."""
    ordered = positions.join(pending.select("id").distinct(), "id", "left_semi").select("id", "position")
    return ordered.orderBy("position").limit(limit) if limit else ordered


def assemble(metrics: DataFrame, manifests: DataFrame) -> DataFrame:
    """Metrics of finished entities only: complete, with recorded failures and every origin done."""
    done = manifests.filter(finished()).select("configuration", "id")
    return metrics.join(done, ["configuration", "id"], "left_semi")


def finished() -> Column:
    return F.coalesce((F.col("status") == "complete") & F.col("failure_recorded")
                      & (F.size("completed_origins") == F.col("origins")), F.lit(False))


def configuration_counts(manifests: DataFrame) -> DataFrame:
    """How many configurations there are and how many have no finished entity."""
    per = manifests.groupBy("configuration").agg(F.max(finished()).alias("_any"))
    return per.agg(F.count(F.lit(1)).alias("configurations"),
                   F.count_if(~F.col("_any")).alias("ignored_configurations"))


def configuration_name(models: Sequence[str], horizon: int, origins: int, include_ensemble: bool = True) -> str:
    return f"{'_'.join(models)}_h{horizon}_o{origins}{'' if include_ensemble else '_without_ensemble'}"


def evaluate_with_ledger(spark: SparkSession, panel: DataFrame, capacity: DataFrame, split_ids: DataFrame, split: str,
                         models: Sequence[str], path: str, limit: int = 0, horizon: int = config.HORIZON,
                         origins: int = config.ORIGINS, include_ensemble: bool = True) -> DataFrame:
    """Backtest the next pending entities of a split and append their results; returns all metrics of the split.

    ``split_ids`` has ``id`` and ``position``; an id whose history gives no origin is an error. Only pending
    (id, origin) pairs are fitted. Predictions, failures and manifests lie beside the metrics, in ``<path>-predictions``,
    ``<path>-failures`` and ``<path>-manifests``; metrics come last but one, so a run that breaks off is repeated.
    """
    name = configuration_name(models, horizon, origins, include_ensemble)
    chosen_models = pick_models(models)
    tag = {"configuration": F.lit(name), "split": F.lit(split)}
    sizes = panel.filter(F.col("storage").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    splits = cut_lineage(sizes.join(split_ids.select("id"), "id", "left_semi").select("id", F.inline(origin_ends(
        F.col("_n"), horizon, origins, config.ORIGIN_STEP, config.MIN_HISTORY))).select("id", "origin"))
    enforce_empty(split_ids.select("id").join(splits, "id", "left_anti"), f"{split} ids without enough history")
    done = results(spark, path, "metrics", schemas.METRICS).select("id", "origin", "model", "configuration").unionByName(
        results(spark, path, "failures", schemas.FAILURES).select("id", "origin", "model", "configuration"))
    pending = pending_origins(split_ids, done, name, origins, list(chosen_models)).join(splits, ["id", "origin"], "left_semi")
    pending = cut_lineage(pending)
    chosen = next_entities(pending, split_ids, limit).select("id")
    now = cut_lineage(pending.join(chosen, "id", "left_semi"))
    predictions, failures = backtest(panel.join(now, "id", "left_semi"), capacity, chosen_models, horizon, origins,
                                     include_ensemble=include_ensemble, only=now, store=True)
    predictions = cut_lineage(predictions)
    tables = {"predictions": (predictions, schemas.PREDICTIONS), "failures": (failures, schemas.FAILURES),
              "metrics": (error_metrics(predictions, capacity), schemas.METRICS)}
    for kind, (rows, schema) in tables.items():
        typed = [F.col(c).cast(t).alias(c) for c, t in (field.split() for field in schema.split(", "))]
        append_parquet(rows.withColumns(tag).select(*typed), result_path(path, kind))
    written = write_manifests(spark, now, split, name, models, path, horizon, origins, include_ensemble)
    append_parquet(written, result_path(path, "manifests"))
    return results(spark, path, "metrics", schemas.METRICS).filter(
        (F.col("split") == split) & (F.col("configuration") == name))


def result_path(path: str, kind: str) -> str:
    return path if kind == "metrics" else f"{path}-{kind}"


def results(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """A result table of evaluations; a run that broke off and was repeated counts once."""
    keys = [c for c in ("id", "origin", "model", "h", "configuration", "split") if f"{c} " in schema]
    return read_or_empty(spark, result_path(path, kind), schema).dropDuplicates(keys)


def write_manifests(spark: SparkSession, now: DataFrame, split: str, name: str, models: Sequence[str], path: str,
                    horizon: int, origins: int, include_ensemble: bool) -> DataFrame:
    """One manifest per entity just evaluated. Its lists hold at most models times origins items."""
    ids = now.select("id").distinct()
    mine = (F.col("configuration") == name) & (F.col("split") == split)
    kept = results(spark, path, "metrics", schemas.METRICS).filter(mine).select("id", "origin", "model",
                                                                               F.lit(None).cast("string").alias("error"))
    lost = results(spark, path, "failures", schemas.FAILURES).filter(mine).select("id", "origin", "model", "error")
    told = F.struct("model", "origin", "error")
    every = kept.unionByName(lost).join(ids, "id", "left_semi").groupBy("id").agg(
        F.sort_array(F.collect_set("origin")).alias("completed_origins"),
        F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), told))).alias("failures"))
    status = F.when(F.size("completed_origins") == origins, "complete").otherwise("in_progress")
    return every.select(
        F.lit(split).alias("split"), "id", F.lit(name).alias("configuration"), status.alias("status"),
        F.array(*[F.lit(m) for m in models]).alias("models"), F.lit(horizon).alias("horizon"),
        F.lit(origins).alias("origins"), F.lit(include_ensemble).alias("include_ensemble"), "completed_origins",
        "failures", F.lit(True).alias("failure_recorded"), F.current_timestamp().alias("generated_at_utc"))


def latest_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest of each entity and configuration."""
    every = read_or_empty(spark, result_path(path, "manifests"), schemas.MANIFESTS)
    row = F.max_by(F.struct(*every.columns), "generated_at_utc").alias("_m")
    return every.groupBy("split", "configuration", "id").agg(row).select("_m.*")


def forecast_report(panel: DataFrame, forecasts: DataFrame, weeks: int = 104) -> DataFrame:
    """Recent history and forecasts in one long table: ``id, date, series, value``."""
    history = last_rows(panel, weeks).select("id", "date", F.lit("observed").alias("series"),
                                             F.col("storage").alias("value"))
    return history.unionByName(forecasts.select("id", "date", F.col("model").alias("series"),
                                                F.col("prediction").alias("value")))


def validation_report(panel: DataFrame, predictions: DataFrame, months: int = 48) -> DataFrame:
    """The latest origin of each entity beside its history from four years before that origin to its end."""
    newest = Window.partitionBy("id")
    latest = (predictions.withColumn("_top", F.max("origin").over(newest)).filter(F.col("origin") == F.col("_top"))
              .select("id", "date", F.col("model").alias("series"), F.col("prediction").alias("value")))
    span = latest.groupBy("id").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    history = (panel.join(span, "id").filter((F.col("date") >= F.add_months("_from", -months))
                                             & (F.col("date") <= F.col("_to")))
               .select("id", "date", F.lit("observed").alias("series"), F.col("storage").alias("value")))
    return history.unionByName(latest)
