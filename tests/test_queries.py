"""Registered queries against their SQL in DuckDB. ``--all-queries`` checks every one of them."""

import os

import pytest

import oracle
from panelcast.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
# Ten suppliers in five regions have no transfer to plan, so those queries use the next scale
LARGER = "/root/testdata/sf0.01"
USUAL = [
    "weekly_features", "win02_weekly_panel", "win04_rolling_full", "win08_rolling_slope", "win17_sequences",
    "str01_name_key", "str04_matching_part", "str08_word_queries", "htm01_page_links", "prj04_parse_date",
    "jn02_join_details", "jn08_patch_coordinates", "jn13_nearest_fill", "jn17_override_union", "set02_set_difference",
    "dq02_panel_violations", "agg13_describe_by_status", "agg15_correlations", "agg19_histogram", "fc01_seasonal_naive",
    "fc07_backtest", "fc11_ridge_stacking", "agg05_model_ranking", "tp04_candidate_pairs", "tp05_one_step",
    "tp09_best_acceptable", "inc01_fingerprint", "inc02_work_list", "src01_observations_csv", "etl_observations",
]


@pytest.fixture(scope="module")
def connections():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return {folder: oracle.connect(folder) for folder in (SF, LARGER)}


def pytest_generate_tests(metafunc):
    if "name" in metafunc.fixturenames:
        names = list(QUERIES) if metafunc.config.getoption("--all-queries") else USUAL
        metafunc.parametrize("name", names)


def test_query(spark, connections, name):
    folder = LARGER if name.startswith("tp") else SF
    assert oracle.check(spark, connections[folder], name, folder) is None


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(USUAL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as driver
    df = driver.entry(spark)
    assert df.columns[:3] == ["id", "date", "storage"] and df.count() > 0
    assert set(driver.queries()) >= set(QUERIES) and set(driver.oracle_sql()) >= set(ORACLES)
