"""Profile and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import clean, profile as pf
from panelcast.queries import fixtures as fx
from panelcast.queries.registry import query, with_ctes


@query("agg01_capacity_fallback", with_ctes([fx.WK, fx.CAP], """SELECT cap.id, coalesce(capacity, peak) AS capacity,
 capacity IS NULL AS capacity_imputed FROM cap JOIN (SELECT id, max(storage) AS peak FROM wk GROUP BY id) m
 ON m.id = cap.id""", d="capacity"))
def _(spark, sf):
    return clean.fill_capacity(fx.capacity(spark, sf), fx.readings(spark, sf))


POINT_COLUMNS = ["id", "name", "type", "brand", "dam_height", "crest_elevation", "latitude", "longitude"]


@query("agg12_null_profile", with_ctes([fx.POINTS], " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM points" for c in POINT_COLUMNS)))
def _(spark, sf):
    return pf.null_profile(fx.parts_on_map(spark, sf).select(POINT_COLUMNS))


QUARTERS = """count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max,
 quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75"""
NUMBERS = "mean std min max q25 median q75"


@query("agg13_describe", with_ctes([fx.WK], f"SELECT {QUARTERS.format(c='storage')} FROM wk", d=NUMBERS))
def _(spark, sf):
    return pf.describe(fx.readings(spark, sf), "storage")


@query("agg13_describe_by_status", f"""SELECT o_orderstatus, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std,
 round(min, 6) + 0.0 AS min, round(max, 6) + 0.0 AS max, round(q25, 6) + 0.0 AS q25, round(median, 6) + 0.0 AS median,
 round(q75, 6) + 0.0 AS q75, count FROM (SELECT o_orderstatus, {QUARTERS.format(c='o_totalprice')} FROM orders GROUP BY 1)""")
def _(spark, sf):
    return pf.describe(fx.table(spark, sf, "orders"), "o_totalprice", ["o_orderstatus"])


@query("agg14_top_values", "SELECT p_name, count(*) AS rows FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return pf.top_values(fx.table(spark, sf, "part"), "p_name")


NUMERIC = ["dam_height", "crest_elevation", "latitude", "longitude"]


@query("agg15_correlations", with_ctes([fx.POINTS], " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) + 0.0 AS r FROM points"
    for a in NUMERIC for b in NUMERIC)))
def _(spark, sf):
    return pf.correlations(fx.parts_on_map(spark, sf), NUMERIC)


@query("agg16_seasonal_profile", with_ctes([fx.PANEL], """SELECT week(date) AS week_of_year, median(storage) AS median_storage
 FROM panel GROUP BY 1""", d="median_storage"))
def _(spark, sf):
    return pf.seasonal_profile(fx.panel(spark, sf))


@query("agg17_rows_per_year", with_ctes([fx.WK], "SELECT year(date) AS year, count(*) AS rows FROM wk GROUP BY 1"))
def _(spark, sf):
    return pf.rows_per_year(fx.readings(spark, sf))


GAPS = """gaps AS (SELECT id, date - lag(date) OVER (PARTITION BY id ORDER BY date) AS gap_days FROM orders_wk)"""


@query("agg18_gap_frequencies", with_ctes([fx.ORDERS_WK, GAPS], """SELECT gap_days, count(*) AS rows FROM gaps
 WHERE gap_days IS NOT NULL GROUP BY 1"""))
def _(spark, sf):
    return pf.gap_frequencies(fx.order_readings(spark, sf))


@query("agg18_largest_gap_ids", with_ctes([fx.ORDERS_WK, GAPS], """SELECT DISTINCT id FROM gaps WHERE gap_days IN (
 SELECT DISTINCT gap_days FROM gaps WHERE gap_days IS NOT NULL ORDER BY 1 DESC LIMIT 2)"""))
def _(spark, sf):
    return pf.largest_gap_ids(fx.order_readings(spark, sf))


@query("agg19_five_numbers", with_ctes([fx.POINTS], """SELECT type, min(dam_height) AS min, max(dam_height) AS max,
 quantile_cont(dam_height, 0.25) AS q25, quantile_cont(dam_height, 0.5) AS median, quantile_cont(dam_height, 0.75) AS q75
 FROM points GROUP BY type""", d="min max q25 median q75"))
def _(spark, sf):
    return pf.five_numbers(fx.parts_on_map(spark, sf), "dam_height", ["type"])


@query("agg19_histogram", """SELECT least(29, floor((o_totalprice - lo) * 30 / (hi - lo)))::BIGINT AS bin, count(*) AS rows
 FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1""")
def _(spark, sf):
    return pf.histogram(fx.table(spark, sf, "orders"), "o_totalprice", 30)


@query("agg20_above_capacity", with_ctes([fx.WK, fx.LOWCAP], """SELECT count(DISTINCT wk.id) FILTER (storage > capacity) AS above,
 count(DISTINCT wk.id) FILTER (storage <= capacity) AS within FROM wk JOIN lowcap ON lowcap.id = wk.id"""))
def _(spark, sf):
    return pf.above_capacity_share(fx.readings(spark, sf), fx.capacity(spark, sf, 0.8, gaps=False))


@query("agg20_latest_date", with_ctes([fx.ORDERS_WK], """SELECT count(*) FILTER (d = m) AS with_data,
 count(*) FILTER (d < m) AS without_data FROM (SELECT id, max(date) AS d FROM orders_wk GROUP BY id),
 (SELECT max(date) AS m FROM orders_wk)"""))
def _(spark, sf):
    return pf.latest_date_share(fx.order_readings(spark, sf))


@query("agg21_repeated_keys", """SELECT c_custkey, c_acctbal FROM (SELECT *, count(*) OVER (PARTITION BY
 CAST(floor(c_acctbal / 10) AS BIGINT)) AS n FROM customer) WHERE n >= 3""")
def _(spark, sf):
    c = fx.table(spark, sf, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 10))
    return pf.repeated_keys(c, "band", 3).select("c_custkey", "c_acctbal")


@query("agg24_duplicate_rows", """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand, p_size FROM part))
 AS duplicate_rows FROM part""")
def _(spark, sf):
    return pf.duplicate_rows(fx.table(spark, sf, "part").select("p_name", "p_brand", "p_size"))


@query("agg24_starts_on", with_ctes([fx.WK], """SELECT count(*) AS entities, count(*) FILTER (d = DATE '1995-01-02') AS starting
 FROM (SELECT id, min(date) AS d FROM wk GROUP BY id)"""))
def _(spark, sf):
    return pf.starts_on(fx.readings(spark, sf), "1995-01-02")


@query("agg24_distinct_values", """SELECT 'p_name' AS "column", p_name AS value FROM part GROUP BY 2 UNION ALL
 SELECT 'p_type', p_type FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand FROM part GROUP BY 2""")
def _(spark, sf):
    return pf.distinct_values(fx.table(spark, sf, "part"), ["p_name", "p_type", "p_brand"])
