"""The whole workflow on synthetic readings."""

import pytest
from pyspark.sql import functions as F

from panelcast.operators.transfer import Area
from panelcast.plans import workflow as wf
from panelcast.session import scratch_path
from panelcast.sources import readers, schemas, writers


@pytest.fixture(scope="module")
def root(spark):
    folder = scratch_path(spark, "workflow")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    water = readers.sample_panel(ids).withColumn(
        "storage", F.when(F.col("id") == 2, F.col("storage") * 0.05).otherwise(F.col("storage")))
    writers.write_csv(water.select(F.col("date").alias("DATE"), F.col("id").alias("ID"),
                                   F.round("storage", 3).alias("CURRENT_WATER")), f"{folder}/raw/water.csv")
    entities = [(1, "Sur", "El Norte", "1000", 0), (2, "Sur", "Sur", "1200", 1), (3, "Sur", "Este", None, 0),
                (4, "Ebro", "Lejos", "900", 0)]
    writers.write_csv(spark.createDataFrame(entities, schemas.ENTITIES_RAW), f"{folder}/raw/reservoirs.csv")
    columns = [c.split()[0] for c in schemas.DETAILS_RAW.split(", ")]
    made = []
    for name, x, y, province, crest in [("El Norte", "-4,5", "37,2", "Jaén", "100,5"), ("Sur", "-4,2", "37,4", "Jaén", None),
                                        ("Este", "-4,0", "37,1", None, None), ("Lejos", "-0,5", "41,5", "Zaragoza", "300")]:
        row = dict.fromkeys(columns)
        row.update(NAME=name, RESERVOIR=name, X=x, Y=y, PROVINCE=province, CREST_ELEVATION=crest, RIVERBED="Río", BASIN="Sur", CODE="c")
        made.append(tuple(row[c] for c in columns))
    writers.write_csv(spark.createDataFrame(made, schemas.DETAILS_RAW), f"{folder}/raw/details.tsv", sep="\t")
    provinces = spark.createDataFrame([("este", "granada")], "name string, province string")
    names = spark.createDataFrame([("norte", "Embalse del Norte, Jaén")], "name string, real_name string")
    wf.run_etl(spark, f"{folder}/raw", f"{folder}/tables", {"provinces": provinces, "real_names": names})
    return f"{folder}/tables"


def test_curated_tables(spark, root):
    panel, merged = wf.load_curated(spark, root)
    got = {r.id: r for r in merged.collect()}
    assert panel.count() == 4 * 260 and set(got) == {1, 2, 3, 4}
    assert [got[i].autonomous_community for i in (1, 2, 3, 4)] == ["andalucia"] * 3 + ["aragon"]
    assert got[2].crest_elevation == 100.5  # copied from its neighbour while the details were cleaned
    assert got[1].real_name == "Norte" and got[3].capacity_imputed
    assert spark.read.json(f"{root}/runs").count() == 4


def test_published_tables_and_work_list(spark, root):
    from panelcast import config
    for name, columns in config.FINAL_COLUMNS.items():
        assert spark.read.parquet(f"{root}/final/{name}").columns == columns
    assert [len(c) for c in config.FINAL_COLUMNS.values()] == [19, 5, 14]
    wanted = {(r["name"], r.wanted) for r in spark.read.parquet(f"{root}/outputs/to_resolve").collect()}
    assert ("sur", "real_name") in wanted and ("norte", "real_name") not in wanted and ("este", "province") not in wanted


def test_metadata_must_fit(spark):
    from panelcast.operators import features as ft
    panel = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id long, storage double")
    table = lambda *rows: spark.createDataFrame(rows, "id long, capacity double")
    ft.require_metadata(panel, table((1, 9.0), (2, 9.0), (3, None)))
    with pytest.raises(ValueError, match="repeat an id"):
        ft.require_metadata(panel, table((1, 9.0), (2, 9.0), (2, 8.0)))
    with pytest.raises(ValueError, match="without a capacity"):
        ft.require_metadata(panel, table((1, 9.0), (2, None)))


def test_features_forecast_and_plan(spark, root):
    wf.run_features(spark, root)
    assert spark.read.parquet(f"{root}/outputs/features").count() == 4 * 260
    assert wf.run_forecast(spark, root).first().computed == 3
    # The plan needs the same three entities, so nothing is fitted again
    before = spark.read.parquet(f"{root}/ledger/forecasts").count()
    wf.run_plan(spark, root, Area("Andalucia"), max_iterations=3)
    assert spark.read.parquet(f"{root}/ledger/forecasts").count() == before == 3 * 3 * 52
    state = spark.read.parquet(f"{root}/outputs/transfer_final_state")
    log = spark.read.parquet(f"{root}/outputs/transfer_log")
    assert state.count() == 3 and {r.receiver for r in log.collect()} == {2}
    report = wf.run_report(spark, root)
    assert report.count() == 3 * 104 + 3 * 3 * 52


def test_evaluation_and_selection(spark, root):
    ids = spark.createDataFrame([(1, 0), (3, 1)], "id long, position int")
    models = ["seasonal_naive", "trend_seasonal"]
    wf.run_evaluation(spark, root, ids, "validation", models, limit=1)
    with pytest.raises(ValueError, match="coverage"):
        wf.analyze_validation(spark, root, ids, models)
    wf.run_evaluation(spark, root, ids, "validation", models)
    record = wf.analyze_validation(spark, root, ids, models).first()
    assert record.selected_model in {*models, "ensemble"} and len(record.ranking) == 3
    held = spark.createDataFrame([(2, 0)], "id long, position int")
    wf.run_evaluation(spark, root, held, "test", ["trend_seasonal"], include_ensemble=False)
    tables = wf.analyze_test(spark, root, held, "trend_seasonal")
    assert tables["by_origin"].count() == 3 and tables["statistics"].count() == 5
    assert tables["validation_comparison"].filter("test_to_validation_ratio IS NOT NULL").count() == 4
    report = wf.run_validation_report(spark, root, "validation", models)
    assert {r.series for r in report.select("series").distinct().collect()} == {"observed", *models, "ensemble"}
    # The test split is run with the selected model alone
    locked = wf.run_test(spark, root, held)
    assert {r.model for r in locked.collect()} == {record.selected_model}
    with pytest.raises(ValueError, match="without metadata"):
        wf.run_evaluation(spark, root, spark.createDataFrame([(99, 0)], "id long, position int"), "test", models)
