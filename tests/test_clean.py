import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import capacities, weekly
from panelcast.operators import clean, curate, features as ft, quality as dq
from panelcast.operators.spatial import fill_from_nearest, require_candidates
from panelcast.plans import etl


def test_gap_takes_the_next_value(spark):
    raw = spark.createDataFrame([("01/01/2020", 1, "10"), ("15/01/2020", 1, "20"), ("01/01/2020", 2, "99")],
                                "DATE string, ID long, CURRENT_WATER string")
    rows = {(r.id, r.date): (r.storage, r.storage_imputed) for r in etl.clean_observations(raw).collect()}
    assert rows == {(1, dt.date(2020, 1, 1)): (10.0, 0), (1, dt.date(2020, 1, 8)): (20.0, 1),
                    (1, dt.date(2020, 1, 15)): (20.0, 0), (2, dt.date(2020, 1, 1)): (99.0, 0)}


def test_one_pass_panel_equals_grid_then_fill(spark):
    day = dt.date(2021, 3, 1)
    rows = []
    for entity in range(6):
        for i in range(40):
            if (i * 7 + entity * 5) % 4:
                rows.append((entity, day + dt.timedelta(days=7 * i), None if (i + entity) % 5 == 0 else float(i)))
        rows.append((entity, day + dt.timedelta(days=7 * 20 + 3), 5.0))  # off the grid
        rows.append((entity, day + dt.timedelta(days=7 * 45), None))     # a tail that stays unknown
    df = spark.createDataFrame(rows, "id long, date date, storage double")
    one = sorted(map(tuple, clean.weekly_panel(df).collect()))
    two = sorted(map(tuple, clean.flag_and_backfill(clean.weekly_grid(df)).collect()))
    assert one == two and one
    by_id = {}
    for entity, date, *_ in one:
        by_id.setdefault(entity, []).append(date)
    assert all((b - a).days == 7 for dates in by_id.values() for a, b in zip(dates, dates[1:]))


def test_duplicates_and_bad_dates_are_rejected(spark):
    twice = spark.createDataFrame([("05/01/2020", 1, "1"), ("05/01/2020", 1, "2")],
                                  "DATE string, ID long, CURRENT_WATER string")
    with pytest.raises(ValueError, match="duplicate_rows"):
        etl.clean_observations(twice)
    bad = spark.createDataFrame([("not a date", 1, "1")], "DATE string, ID long, CURRENT_WATER string")
    with pytest.raises(ValueError, match="not a date"):
        etl.clean_observations(bad)
    with pytest.raises(ValueError, match="storage should hold number and is not there"):
        dq.conform(bad, "observations", storage="number")
    with pytest.raises(ValueError, match="DATE should hold date and is string"):
        dq.conform(bad, "observations", DATE="date", ID="number", CURRENT_WATER="text")


def test_dates_in_several_layouts(spark):
    df = spark.createDataFrame([("7/1/2018",), (" 07/01/2018 ",), ("2018-01-07",), ("07-01-2018",), ("soon",)], "d string")
    from panelcast.functions.dates import parse_date, parse_two_digit_year
    got = [r[0] for r in df.select(parse_date(F.col("d"))).collect()]
    assert got == [dt.date(2018, 1, 7)] * 4 + [None]
    old = spark.createDataFrame([("05/01/88 00:00:00",), ("05/01/21 10:00:00",)], "d string")
    assert [r[0].year for r in old.select(parse_two_digit_year(F.col("d"))).collect()] == [1988, 2021]


def test_capacity_falls_back_to_the_peak(spark):
    entities = spark.createDataFrame([(1, "Uno", None, "Sur")], "ID long, RESERVOIR_NAME string, TOTAL_WATER string, SCOPE_NAME string")
    row = etl.clean_entities(entities, weekly(spark, {1: [50, 75, 60]})).first()
    assert row.capacity == 75.0 and row.capacity_imputed and row.name == "uno"


def test_features(spark):
    panel = weekly(spark, {1: range(60), 2: range(60, 120)})
    rows = ft.build_features(panel, capacities(spark, {1: 200, 2: 200})).orderBy("id", "date").collect()
    assert len(rows) == 120 and rows[0].storage_lag_1w is None and rows[60].storage_lag_1w is None
    assert all(0 <= r.storage_fraction <= 1 for r in rows)
    assert rows[52].storage_lag_52w == 0 and rows[51].storage_mean_52w == 25.5 and rows[50].storage_mean_52w is None
    assert rows[59].target_storage is None and rows[0].target_storage == 1
    with pytest.raises(ValueError):
        ft.build_features(panel, capacities(spark, {1: 1}), lags=(0,))


def test_extended_features_have_no_nulls(spark):
    panel = weekly(spark, {1: [3 + i % 7 for i in range(80)]})
    made = ft.extended_features(panel, capacities(spark, {1: 50}))
    assert made.count() == 80
    assert made.na.drop().count() == 80


def test_detail_cleaning_copies_the_nearest_values(spark):
    columns = ["id", "NAME", "RESERVOIR", "X", "Y", "BASIN", "RIVERBED", "PROVINCE", "AUTONOMOUS_COMMUNITY", "TYPE",
               "CREST_ELEVATION", "DAM_HEIGHT", "CODE"]
    rows = [(1, "El Uno", "r", "-4,0", "37,0", "Sur", "Río Grande", "Jaén", "Andalucía", "x", "100,0", "10,5", "c"),
            (2, "Dos", "r", "-4,1", "37,1", "Sur", "Sin Nombre", "Jaén", "Andalucía", "x", None, None, "d"),
            (3, "DOS", "r", "-4,1", "37,1", "Sur", "Sin Nombre", "Jaén", "Andalucía", "x", None, "7,0", "d")]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'id' else 'string'}" for c in columns))
    got = {r.name: r for r in clean.clean_details(raw).collect()}
    assert set(got) == {"uno", "dos"}
    assert got["dos"].id == 3 and got["dos"].crest_elevation == 100.0 and got["dos"].crest_elevation_imputed
    assert got["dos"].riverbed == "rio grande" and got["dos"].riverbed_imputed and not got["uno"].riverbed_imputed


def test_fill_without_candidates(spark):
    df = spark.createDataFrame([(1, 37.0, -4.0, None), (2, None, -4.0, "x")],
                               "id long, latitude double, longitude double, v string")
    with pytest.raises(ValueError):
        require_candidates(df, "v")
    assert {r.id: r.v for r in fill_from_nearest(df, "v").collect()} == {1: None, 2: "x"}


def test_readings_are_never_lost_with_their_entity(spark):
    panel = weekly(spark, {1: [5, 60], 2: [7]})
    got = sorted((r.id, r.storage) for r in clean.cap_at_capacity(panel, capacities(spark, {1: 50})).collect())
    assert got == [(1, 5.0), (1, 50.0), (2, 7.0)]


def test_names_that_meet_after_aliasing(spark):
    entities = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    details = spark.createDataFrame([("a",), ("b",), ("d",)], "name string")
    got = sorted(map(tuple, curate.name_collisions(entities, details, {}, {"b": "a"}).collect()))
    assert got == [("details", "a", 2), ("entities", "a", 2)]


def test_hot_key_keeps_one_row(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("n"), (F.col("id") % 50).cast("string"))).alias("name"), (F.col("id") % 97).cast("double").alias("dam_height"))
    got = {r.name: r for r in clean.tallest_per_name(df).collect()}
    assert got["hot"].dam_height == 96.0 and got["hot"].id == min(i for i in range(0, 5000, 3) if i % 97 == 96)


def test_curated_checks(spark):
    panel = weekly(spark, {1: [5, 6], 2: [50, 60]})
    etl.check_curated(panel, capacities(spark, {1: 10, 2: 100}))
    with pytest.raises(ValueError, match="above_capacity"):
        etl.check_curated(panel, capacities(spark, {1: 10, 2: 55}))
    with pytest.raises(ValueError, match="unknown_rows"):
        etl.check_curated(panel, capacities(spark, {1: 10}))
