"""Projection, filter, join and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.columns import bounded_forecast, lower_names, map_value
from panelcast.operators import clean, curate as cu, features as ft, quality as dq, spatial as sp
from panelcast.queries import fixtures as fx
from panelcast.queries.registry import query, with_ctes


def raw_columns(spark, sf):
    """Readings under the raw source's column names."""
    return fx.readings(spark, sf).withColumnsRenamed({"id": "ID", "date": "DATE", "storage": "CURRENT_WATER"})


@query("prj01_rename", with_ctes([fx.WK], "SELECT id, date, storage FROM wk", t="date"))
def _(spark, sf):
    renamed = clean.standard_columns(raw_columns(spark, sf).withColumn("CODE", F.lit(1)),
                                     {"DATE": "date", "CURRENT_WATER": "storage"}, drop=["CODE", "OTHER"])
    return lower_names(renamed)


@query("prj06_drop_null_keys", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS id
 FROM orders WHERE o_orderkey % 11 <> 0""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders")
    keyed = o.select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("id"))
    return keyed.na.drop(subset=["id"])


@query("prj08_cap_at_capacity", with_ctes([fx.WK, fx.LOWCAP], """SELECT wk.id, date, least(storage, capacity) AS storage
 FROM wk JOIN lowcap ON lowcap.id = wk.id""", t="date", d="storage"))
def _(spark, sf):
    return clean.cap_at_capacity(fx.readings(spark, sf), fx.capacity(spark, sf, 0.8, gaps=False))


@query("prj09_clip_forecast", with_ctes([fx.WK, fx.CAP], """SELECT wk.id, date, CASE WHEN capacity IS NULL
 THEN storage * 3 - 60 ELSE greatest(0, least(storage * 3 - 60, capacity)) END AS prediction
 FROM wk JOIN cap ON cap.id = wk.id""", t="date", d="prediction"))
def _(spark, sf):
    joined = fx.readings(spark, sf).join(fx.capacity(spark, sf), "id")
    return joined.select("id", "date", bounded_forecast(F.col("storage") * 3 - 60, F.col("capacity")).alias("prediction"))


@query("prj10_capacity_fraction", with_ctes([fx.WK, fx.FULLCAP], """SELECT wk.id, date, storage / capacity AS fraction
 FROM wk JOIN fullcap c ON c.id = wk.id""", t="date", d="fraction"))
def _(spark, sf):
    joined = fx.readings(spark, sf).join(fx.capacity(spark, sf, gaps=False), "id")
    return joined.select("id", "date", (F.col("storage") / F.col("capacity")).alias("fraction"))


@query("prj11_final_columns", with_ctes([fx.DETAIL], """SELECT name, longitude, latitude, NULL::VARCHAR AS basin, riverbed,
 NULL::VARCHAR AS google, NULL::VARCHAR AS openstreetmap, NULL::VARCHAR AS wikidata, province,
 community AS autonomous_community, type, crest_elevation, dam_height, NULL::VARCHAR AS report FROM detail""", d="longitude latitude"))
def _(spark, sf):
    unknown = {c: F.lit(None).cast("string") for c in ("basin", "google", "openstreetmap", "wikidata", "report")}
    rows = fx.detail(spark, sf).withColumnRenamed("community", "autonomous_community").withColumns(unknown)
    return cu.final_columns(rows, "details")


RULES = [(3, 1997), (8, 1998)]


@query("flt01_exclude_periods", with_ctes([fx.WK], """SELECT id, date, storage FROM wk WHERE NOT (
 (id = 3 AND year(date) < 1997) OR (id = 8 AND year(date) < 1998))""", t="date"))
def _(spark, sf):
    return clean.exclude_periods(fx.readings(spark, sf), RULES)


@query("flt01_exclude_by_table", with_ctes([fx.WK, """rules AS (SELECT s_suppkey AS id, 1992 + s_nationkey % 9 AS before_year
 FROM supplier WHERE s_suppkey % 3 = 0)"""], """SELECT id, date, storage FROM wk WHERE NOT EXISTS (SELECT 1 FROM rules r
 WHERE r.id = wk.id AND year(wk.date) < r.before_year)""", t="date"))
def _(spark, sf):
    rules = fx.table(spark, sf, "supplier").filter(F.col("s_suppkey") % 3 == 0).select(
        F.col("s_suppkey").alias("id"), (F.lit(1992) + F.col("s_nationkey") % 9).alias("before_year"))
    return clean.exclude_periods_by_table(fx.readings(spark, sf), rules)


@query("flt02_community", with_ctes([fx.DIMS], "SELECT id, name, community FROM dims WHERE lower(trim(community)) = 'europe'"))
def _(spark, sf):
    return cu.in_community(fx.dims(spark, sf), " Europe ", "community").select("id", "name", "community")


@query("flt03_key_list", with_ctes([fx.WK, fx.DIMS], """SELECT id, date, storage FROM wk WHERE id IN
 (SELECT id FROM dims WHERE lower(community) = 'asia')""", t="date"))
def _(spark, sf):
    return cu.keep_listed(fx.readings(spark, sf), cu.in_community(fx.dims(spark, sf), "asia", "community"))


@query("flt04_valid_ranges", """SELECT c_custkey, c_acctbal / 50 AS latitude, c_acctbal / 30 AS longitude FROM customer
 WHERE NOT (c_acctbal / 50 BETWEEN -90 AND 90) OR NOT (c_acctbal / 30 BETWEEN -180 AND 180)""".replace(
    "c_acctbal / 50 AS latitude, c_acctbal / 30 AS longitude",
    "round(c_acctbal / 50, 6) + 0.0 AS latitude, round(c_acctbal / 30, 6) + 0.0 AS longitude"))
def _(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 50).alias("latitude"),
                                               (F.col("c_acctbal") / 30).alias("longitude"))
    return cu.invalid_points(c)


@query("jn01_join_metadata", with_ctes([fx.WK, fx.DIMS], """SELECT wk.id, date, storage, name, province, community,
 latitude, longitude FROM wk LEFT JOIN dims ON dims.id = wk.id AND wk.id % 3 <> 0""", t="date",
                                       d="latitude longitude"))
def _(spark, sf):
    return ft.join_metadata(fx.readings(spark, sf), fx.dims(spark, sf).filter(F.col("id") % 3 != 0))


ENTITIES = """entities AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 100 = 7 THEN 'pt ' ELSE 'part ' END ||
 CASE WHEN p_partkey % 5 = 4 THEN p_partkey - 1 ELSE p_partkey END AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 0)"""
DETAILS = """details AS (SELECT 'part ' || p_partkey AS name, p_type AS type,
 CASE WHEN p_partkey % 7 <> 0 THEN lower(p_brand) END AS province, p_retailprice AS height FROM part WHERE p_partkey % 4 <> 0)"""


def named_entities(spark, sf):
    key = F.col("p_partkey")
    number = F.when(key % 5 == 4, key - 1).otherwise(key).cast("string")
    head = F.when(key % 100 == 7, F.lit("pt ")).otherwise(F.lit("part "))
    return fx.table(spark, sf, "part").filter(key % 3 != 0).select(
        key.alias("id"), F.concat(head, number).alias("name"), F.col("p_size").alias("size"))


def named_details(spark, sf):
    key = F.col("p_partkey")
    return fx.table(spark, sf, "part").filter(key % 4 != 0).select(
        F.concat(F.lit("part "), key.cast("string")).alias("name"), F.col("p_type").alias("type"),
        F.when(key % 7 != 0, F.lower("p_brand")).alias("province"), F.col("p_retailprice").alias("height"))


@query("jn02_join_details", with_ctes([ENTITIES, DETAILS, """one AS (SELECT id,
 CASE name WHEN 'part 1' THEN 'part 2' ELSE name END AS name, size FROM entities QUALIFY row_number() OVER (
 PARTITION BY CASE name WHEN 'part 1' THEN 'part 2' ELSE name END ORDER BY id) = 1)""", """aliased AS (SELECT id,
 CASE name WHEN 'pt 7' THEN 'part 7' ELSE name END AS name, size FROM one)"""],
       """SELECT a.id, a.name, CAST(a.size AS BIGINT) AS size, d.type, d.province, d.height
 FROM aliased a LEFT JOIN details d ON d.name = a.name"""))
def _(spark, sf):
    return cu.join_details(named_entities(spark, sf), named_details(spark, sf), {"part 1": "part 2"}, {"pt 7": "part 7"})


@query("jn03_map_with_fallback", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction'
 WHEN 'MACHINERY' THEN 'industry' ELSE c_mktsegment END AS segment FROM customer""")
def _(spark, sf):
    mapping = {"BUILDING": "construction", "MACHINERY": "industry"}
    return fx.table(spark, sf, "customer").select(
        "c_custkey", map_value(F.col("c_mktsegment"), mapping, keep=True).alias("segment"))


@query("jn04_map_without_fallback", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction'
 WHEN 'MACHINERY' THEN 'industry' END AS segment FROM customer""")
def _(spark, sf):
    mapping = {"BUILDING": "construction", "MACHINERY": "industry"}
    return fx.table(spark, sf, "customer").select(
        "c_custkey", map_value(F.col("c_mktsegment"), mapping, keep=False).alias("segment"))


PROVINCES = """provinces AS (SELECT 'part ' || p_partkey AS name, CASE WHEN p_partkey % 2 = 0 THEN 'looked up' END AS province
 FROM part WHERE p_partkey % 14 <> 0)"""


def province_table(spark, sf):
    key = F.col("p_partkey")
    return fx.table(spark, sf, "part").filter(key % 14 != 0).select(
        F.concat(F.lit("part "), key.cast("string")).alias("name"),
        F.when(key % 2 == 0, F.lit("looked up")).alias("province"))


@query("jn05_fill_where_null", with_ctes([DETAILS, "manual AS (SELECT n_nationkey * 7 AS k, lower(n_name) AS province FROM nation)"],
       """SELECT d.name, coalesce(d.province, m.province) AS province FROM details d
 LEFT JOIN manual m ON d.name = 'part ' || m.k"""))
def _(spark, sf):
    manual = fx.table(spark, sf, "nation").select(
        F.concat(F.lit("part "), (F.col("n_nationkey") * 7).cast("string")).alias("name"),
        F.lower("n_name").alias("province"))
    return cu.fill_missing(named_details(spark, sf).select("name", "province"), "province", manual)


@query("jn06_fill_from_lookup", with_ctes([DETAILS, PROVINCES], """SELECT d.name, coalesce(d.province, p.province) AS province
 FROM details d LEFT JOIN provinces p ON p.name = d.name"""))
def _(spark, sf):
    return cu.fill_missing(named_details(spark, sf).select("name", "province"), "province", province_table(spark, sf))


@query("jn06_to_resolve", with_ctes([DETAILS, PROVINCES], """SELECT DISTINCT d.name FROM details d
 WHERE d.province IS NULL AND NOT EXISTS (SELECT 1 FROM provinces p WHERE p.name = d.name AND p.province IS NOT NULL)"""))
def _(spark, sf):
    return cu.to_resolve(named_details(spark, sf), "province", province_table(spark, sf))


@query("jn07_join_lookup", with_ctes([ENTITIES, DETAILS], """SELECT e.id, e.name, d.type, d.height FROM entities e
 LEFT JOIN details d ON d.name = e.name"""))
def _(spark, sf):
    return cu.join_lookup(named_entities(spark, sf).select("id", "name"), named_details(spark, sf), "name",
                          ["type", "height"])


@query("jn08_patch_coordinates", with_ctes([fx.POINTS], """SELECT id, CASE WHEN id % 10 = 0 THEN 40.0 WHEN id % 4 = 0
 AND id % 3 <> 0 THEN 41.5 ELSE latitude END::DOUBLE AS latitude, CASE WHEN id % 10 = 0 THEN -3.0 WHEN id % 4 = 0
 AND id % 3 <> 0 THEN id / 1000.0 ELSE longitude END::DOUBLE AS longitude FROM points""", d="latitude longitude"))
def _(spark, sf):
    points = fx.parts_on_map(spark, sf).select("id", F.col("id").cast("string").alias("name"), "latitude", "longitude")
    manual = points.filter(F.col("id") % 10 == 0).select("name", F.lit(40.0).alias("latitude"), F.lit(-3.0).alias("longitude"))
    found = points.filter(F.col("id") % 4 == 0).select(
        "name", F.when(F.col("id") % 3 != 0, F.lit(41.5)).alias("latitude"), (F.col("id") / 1000.0).alias("longitude"))
    return cu.patch_coordinates(points, manual, found).select("id", "latitude", "longitude")


@query("jn09_fresh_ids", with_ctes([fx.ORDERS_WK], """SELECT id, max(date) AS last_date FROM orders_wk GROUP BY id
 HAVING max(date) >= (SELECT max(date) - 14 FROM orders_wk)""", t="last_date"))
def _(spark, sf):
    return cu.fresh_ids(fx.order_readings(spark, sf))


@query("jn11_reconcile_names", with_ctes([ENTITIES, DETAILS], """SELECT CASE WHEN e.name IS NULL THEN 'right_only'
 WHEN d.name IS NULL THEN 'left_only' ELSE 'paired' END AS side, count(*) AS names
 FROM (SELECT DISTINCT name FROM entities) e FULL OUTER JOIN (SELECT DISTINCT name FROM details) d ON d.name = e.name
 GROUP BY 1"""))
def _(spark, sf):
    return (cu.reconcile(named_entities(spark, sf), named_details(spark, sf)).groupBy("side")
            .agg(F.count(F.lit(1)).alias("names")))


@query("jn12_match_rate", """SELECT 'name' AS candidate, count(*) AS matches FROM part a JOIN part b ON a.p_name = b.p_name
 UNION ALL SELECT 'last_word', count(*) FROM part a JOIN part b ON regexp_replace(a.p_name, 'small |old ', '') = b.p_name""")
def _(spark, sf):
    parts = fx.table(spark, sf, "part")
    names = parts.select(F.col("p_name").alias("name"))
    return cu.match_rate(parts, F.col("p_name"), names, "name").unionByName(
        cu.match_rate(parts, F.regexp_replace("p_name", "small |old ", ""), names, "last_word"))


def nearest_sql(source: str, column: str, extra: str = "") -> str:
    return f"""SELECT t.id, coalesce(t.{column}, n.v) AS {column}, t.{column} IS NULL AND n.v IS NOT NULL AS {column}_imputed
 FROM {source} t LEFT JOIN (SELECT t.id, arg_min(c.{column}, {{'km': round({fx.km_sql('t', 'c')}, 6), 'id': c.id}}) AS v
 FROM {source} t, {source} c WHERE t.{column} IS NULL AND c.{column} IS NOT NULL AND t.latitude IS NOT NULL
 AND c.latitude IS NOT NULL GROUP BY t.id) n ON n.id = t.id"""


@query("jn13_nearest_fill", with_ctes([fx.POINTS], nearest_sql("points", "crest_elevation"), d="crest_elevation"))
def _(spark, sf):
    points = fx.parts_on_map(spark, sf)
    return sp.fill_from_nearest(points, "crest_elevation").select("id", "crest_elevation", "crest_elevation_imputed")


@query("jn13_nearest_riverbed", with_ctes([fx.DETAIL, """named AS (SELECT id, latitude, longitude,
 CASE WHEN lower(riverbed) <> 'sin nombre' THEN riverbed END AS riverbed FROM detail)"""], nearest_sql("named", "riverbed")))
def _(spark, sf):
    d = fx.detail(spark, sf)
    named = d.withColumn("riverbed", clean.sentinel_to_null(F.col("riverbed"), "sin nombre"))
    return sp.fill_from_nearest(named, "riverbed").select("id", "riverbed", "riverbed_imputed")


@query("jn14_distances_within", with_ctes([fx.DIMS], f"""SELECT a.id AS l_id, b.id AS r_id, {fx.km_sql('a', 'b')} AS km
 FROM dims a JOIN dims b ON a.id <> b.id AND {fx.km_sql('a', 'b')} <= 250""", d="km"))
def _(spark, sf):
    d = fx.dims(spark, sf).select("id", "latitude", "longitude")
    return sp.pairs_within(d, d, 250.0).filter(F.col("l_id") != F.col("r_id")).select("l_id", "r_id", "km")


@query("jn15_within_radius", with_ctes([fx.POINTS], f"""SELECT id, latitude, longitude FROM points x,
 (SELECT 40.0::DOUBLE AS latitude, -3.5::DOUBLE AS longitude) home WHERE {fx.km_sql('home', 'x')} <= 90""".replace(
    "SELECT id, latitude, longitude", "SELECT id, x.latitude, x.longitude"), d="latitude longitude"))
def _(spark, sf):
    return sp.within_radius(fx.parts_on_map(spark, sf), 40.0, -3.5, 90.0).select("id", "latitude", "longitude")


@query("jn18_unmatched_names", with_ctes([ENTITIES, DETAILS], """SELECT DISTINCT name FROM entities
 WHERE name NOT IN (SELECT name FROM details)"""))
def _(spark, sf):
    return cu.missing_members(named_entities(spark, sf), named_details(spark, sf), "name").distinct()


@query("jn17_override_union", with_ctes([ENTITIES], """SELECT name, max_by(real_name, p) AS real_name FROM (
 SELECT name, 'resolved ' || name AS real_name, 0 AS p FROM (SELECT DISTINCT name FROM entities)
 UNION ALL SELECT 'part ' || p_partkey, 'reviewed ' || p_partkey, 1 FROM part WHERE p_partkey % 6 = 0
 UNION ALL SELECT 'part ' || p_partkey, 'missing ' || p_partkey, 2 FROM part WHERE p_partkey % 10 = 0) GROUP BY name"""))
def _(spark, sf):
    p, key = fx.table(spark, sf, "part"), F.col("p_partkey").cast("string")

    def layer(divisor, word):
        return p.filter(F.col("p_partkey") % divisor == 0).select(
            F.concat(F.lit("part "), key).alias("name"), F.concat(F.lit(word), key).alias("real_name"))

    resolved = named_entities(spark, sf).select("name").distinct().withColumn(
        "real_name", F.concat(F.lit("resolved "), F.col("name")))
    return cu.override([resolved, layer(6, "reviewed "), layer(10, "missing ")], "name", "real_name")


@query("set01_union", with_ctes([fx.WK, fx.ORDERS_WK], """SELECT id, date, storage, 'supplier' AS kind FROM wk
 UNION ALL SELECT id, date, storage, 'customer' FROM orders_wk""", t="date"))
def _(spark, sf):
    a = fx.readings(spark, sf).withColumn("kind", F.lit("supplier"))
    return a.unionByName(fx.order_readings(spark, sf).withColumn("kind", F.lit("customer")))


@query("set02_set_difference", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right_only'
 ELSE 'left_only' END AS side FROM (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F') a
 FULL OUTER JOIN (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'O') b ON a.id = b.id
 WHERE a.id IS NULL OR b.id IS NULL""")
def _(spark, sf):
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return cu.set_difference(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), "id")


@query("set03_distinct_by_key", """SELECT l_suppkey AS id, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_order
 FROM lineitem GROUP BY 1""")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"),
                                                   F.col("l_orderkey").alias("first_order"), "l_linenumber")
    return clean.best_row_per_key(lines, "id", [F.col("first_order"), F.col("l_linenumber")]).drop("l_linenumber")


@query("srt01_sorted_panel", with_ctes([fx.PANEL], "SELECT id, date, storage FROM panel ORDER BY id, date", t="date"))
def _(spark, sf):
    return fx.panel(spark, sf).select("id", "date", "storage").orderBy("id", "date")


@query("srt02_first_pending", """SELECT o_custkey AS id, min(o_orderkey) AS position FROM orders GROUP BY 1
 ORDER BY 2 LIMIT 25""")
def _(spark, sf):
    pending = (fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"))
               .agg(F.min("o_orderkey").alias("position")))
    return pending.orderBy("position").limit(25)


@query("srt04_largest_ten", with_ctes([fx.WK, fx.FULLCAP], "SELECT id, capacity FROM fullcap ORDER BY capacity DESC, id LIMIT 10",
                                      d="capacity"))
def _(spark, sf):
    return fx.capacity(spark, sf, gaps=False).orderBy(F.col("capacity").desc(), "id").limit(10)


@query("srt04_random_ten")
def _(spark, sf):
    # A seeded hash order is a repeatable random sample without a second pass
    ids = fx.readings(spark, sf).select("id").distinct()
    return ids.orderBy(F.xxhash64("id", F.lit(27)), "id").limit(10)


@query("dq01_required_columns", with_ctes([fx.WK], "SELECT id, date, storage FROM wk", t="date"))
def _(spark, sf):
    readings = fx.readings(spark, sf)
    dq.conform(readings, "readings", id="number", date="date", storage="number")
    return readings


@query("dq02_panel_violations", """SELECT count(*) FILTER (id IS NULL) AS null_keys,
 count(*) FILTER (storage < 0) AS negative_values, count(*) FILTER (id IS NOT NULL) - count(DISTINCT CASE WHEN id IS NOT NULL
 THEN id * 100000000 + year(date) * 10000 + month(date) * 100 + day(date) END) AS duplicate_rows FROM (SELECT
 CASE WHEN c_custkey % 50 <> 0 THEN c_custkey % 400 END AS id, DATE '2020-01-01' AS date, c_acctbal AS storage FROM customer)""")
def _(spark, sf):
    c = fx.table(spark, sf, "customer")
    rows = c.select(F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey") % 400).alias("id"),
                    F.lit("2020-01-01").cast("date").alias("date"), F.col("c_acctbal").alias("storage"))
    return dq.panel_violations(rows)


@query("dq03_entity_violations", """SELECT count(*) - count(DISTINCT c_custkey % 700) AS duplicate_ids,
 count(*) FILTER (c_acctbal <= 0) AS non_positive_capacities FROM customer""")
def _(spark, sf):
    return dq.entity_violations(fx.table(spark, sf, "customer").select(
        (F.col("c_custkey") % 700).alias("id"), F.col("c_acctbal").alias("capacity")))


@query("dq04_reference_violations", with_ctes([fx.WK, fx.LOWCAP], """SELECT wk.id, count(*) FILTER (c.id IS NULL) AS unknown_rows,
 count(*) FILTER (c.id IS NOT NULL AND capacity IS NULL) AS rows_without_capacity,
 count(*) FILTER (storage > capacity) AS rows_above_capacity FROM wk LEFT JOIN (SELECT id, CASE WHEN id % 7 <> 0 THEN capacity END
 AS capacity FROM lowcap WHERE id % 9 <> 0) c ON c.id = wk.id GROUP BY wk.id HAVING count(*) FILTER (c.id IS NULL) > 0
 OR count(*) FILTER (c.id IS NOT NULL AND capacity IS NULL) > 0 OR count(*) FILTER (storage > capacity) > 0"""))
def _(spark, sf):
    cap = fx.capacity(spark, sf, 0.8).filter(F.col("id") % 9 != 0)
    return dq.reference_violations(fx.readings(spark, sf), cap)


@query("dq06_integrality", """SELECT count(*) AS rows, count(*) FILTER (o_totalprice % 1 = 0) AS whole_values FROM orders""")
def _(spark, sf):
    return dq.integrality(fx.table(spark, sf, "orders"), "o_totalprice")


@query("dq02_duplicate_keys", """SELECT l_orderkey, l_partkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf):
    return dq.duplicate_keys(fx.table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"])


@query("win01_off_grid_count", """WITH days AS (SELECT DISTINCT l_suppkey AS id, CAST(l_shipdate AS DATE) AS date FROM lineitem),
 firsts AS (SELECT id, min(date) AS f FROM days GROUP BY id) SELECT d.id, count(*) FILTER ((d.date - f) % 7 <> 0) AS off_grid
 FROM days d JOIN firsts ON firsts.id = d.id GROUP BY d.id""")
def _(spark, sf):
    days = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"),
                                                  F.to_date("l_shipdate").alias("date")).distinct()
    return clean.off_grid_count(days)
