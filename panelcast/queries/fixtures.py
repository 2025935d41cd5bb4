"""Panel-shaped tables derived from the driver tables, in Spark and as SQL helper tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.functions.dates import week_start
from panelcast.operators.clean import weekly_panel
from panelcast.operators.features import last_rows, trailing
from panelcast.session import cut_lineage, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly readings per supplier: partial sums collapse a hot supplier before the shuffle."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").alias("id"), week_start(F.col("l_shipdate")).alias("date"))
            .agg(F.sum("l_quantity").alias("storage")))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly panel; a supplier and week has a row of ``lineitem`` at least, so their number tells the tasks."""
    return weekly_panel(spread(readings(spark, sf), table(spark, sf, "lineitem").count(), "id"))


def order_readings(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "orders")
            .groupBy(F.col("o_custkey").alias("id"), week_start(F.col("o_orderdate")).alias("date"))
            .agg(F.count(F.lit(1)).cast("double").alias("storage")))


def dims(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                    F.col("n_name").alias("province"), F.col("r_name").alias("community"),
                    (F.lit(36.0) + (F.col("s_suppkey") * 37 % 700) / F.lit(100.0)).alias("latitude"),
                    (F.lit(-9.0) + (F.col("s_suppkey") * 53 % 1200) / F.lit(100.0)).alias("longitude")))


def capacity(spark: SparkSession, sf: str, factor: float = 1.1, gaps: bool = True) -> DataFrame:
    peak = readings(spark, sf).groupBy("id").agg((F.max("storage") * F.lit(factor)).alias("capacity"))
    return peak.withColumn("capacity", F.when(F.col("id") % 7 != 0, F.col("capacity"))) if gaps else peak


def stored_panel(spark: SparkSession, sf: str, gaps: bool = True) -> tuple[DataFrame, DataFrame]:
    """The panel, written once for queries that read it along several branches, and the capacities from it.

    Back-fills copy known values, so the peak of the panel is the peak of the readings.
    """
    stored = cut_lineage(panel(spark, sf))
    weeks = spread(stored, stored.count(), "id")
    cap = weeks.groupBy("id").agg((F.max("storage") * F.lit(1.1)).alias("capacity"))
    return weeks, cap.withColumn("capacity", F.when(F.col("id") % 7 != 0, F.col("capacity"))) if gaps else cap


def no_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """An empty capacity table: forecasts stay unbounded."""
    return capacity(spark, sf).filter(F.lit(False))


def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    marked = (F.col("id") + F.weekofyear("date")) % 97 == 0
    return readings(spark, sf).select(
        "id", F.date_format("date", "dd/MM/yyyy").alias("date"),
        F.when(marked, F.lit("n/a")).otherwise(F.col("storage").cast("string")).alias("storage"))


#: Parts per supplier at every scale
PARTS_OF_SUPPLIER = 20


def detail(spark: SparkSession, sf: str) -> DataFrame:
    """Detail rows of all parts, twenty at each supplier, with unnamed riverbeds and decimal-comma elevations."""
    key = F.col("p_partkey")
    p = table(spark, sf, "part").select(key.alias("id"), F.floor(key / PARTS_OF_SUPPLIER).alias("_at"), "p_name", "p_type",
                                        "p_size", "p_retailprice")
    d = p.join(dims(spark, sf).withColumnRenamed("id", "_at").drop("name"), "_at")
    river = (F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 5 == 0, F.lit("Sin Nombre"))
             .otherwise(F.col("p_name")))
    crest = F.when(F.col("id") % 6 != 0, F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")))
    height = F.when(F.col("id") % 4 != 0, F.col("p_size").cast("double"))
    return d.select("id", F.col("p_name").alias("name"), "province", "community", "latitude", "longitude",
                    river.alias("riverbed"), crest.alias("crest_elevation"), height.alias("dam_height"),
                    F.col("p_type").alias("type"))


def parts_on_map(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as points; price is missing for every ninth part."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("brand"),
        F.col("p_size").cast("double").alias("dam_height"),
        F.when(key % 9 != 0, F.col("p_retailprice")).alias("crest_elevation"),
        F.when(key % 41 != 0, F.lit(36.0) + (key * 37 % 700) / F.lit(100.0)).alias("latitude"),
        (F.lit(-9.0) + (key * 53 % 1200) / F.lit(100.0)).alias("longitude"))


def level(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed storage: 26-row mean of twenty times the weekly sum, full windows only."""
    mean = F.avg(F.col("storage") * 20).over(trailing(26))
    full = F.count("storage").over(trailing(26)) == 26
    return (panel(spark, sf).select("id", "date", F.when(full, mean).alias("storage"))
            .filter(F.col("storage").isNotNull()))


def plan_capacity(levels: DataFrame) -> DataFrame:
    return levels.groupBy("id").agg(
        (F.max("storage") * (F.lit(1.05) + (F.col("id") * 13 % 40) / F.lit(2.0))).alias("capacity"))


def plan_curves(levels: DataFrame) -> DataFrame:
    """The last 52 levels of each entity, used as its forecast curve."""
    return last_rows(levels, 52)


def plan_entities(spark: SparkSession, sf: str, levels: DataFrame) -> DataFrame:
    return (dims(spark, sf).join(plan_capacity(levels), "id")
            .select("id", "name", "province", "community", "capacity", "latitude", "longitude"))


# --- the same tables as SQL ----------------------------------------------------
WK = """wk AS (SELECT l_suppkey AS id, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
 sum(l_quantity) AS storage FROM lineitem GROUP BY 1, 2)"""
GRID = WK + """, grid AS (SELECT g.id, g.date, wk.storage FROM (
 SELECT id, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 7 DAY)) AS DATE) AS date
 FROM wk GROUP BY id) g LEFT JOIN wk ON wk.id = g.id AND wk.date = g.date)"""
PANEL = GRID + """, panel AS (SELECT * FROM (SELECT id, date,
 first_value(storage IGNORE NULLS) OVER (PARTITION BY id ORDER BY date
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS storage,
 CAST(storage IS NULL AS BIGINT) AS storage_imputed FROM grid) WHERE storage IS NOT NULL)"""
ORDERS_WK = """orders_wk AS (SELECT o_custkey AS id, CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
 CAST(count(*) AS DOUBLE) AS storage FROM orders GROUP BY 1, 2)"""
DIMS = """dims AS (SELECT s_suppkey AS id, s_name AS name, n_name AS province, r_name AS community,
 36.0::DOUBLE + (s_suppkey * 37 % 700) / 100.0::DOUBLE AS latitude,
 -9.0::DOUBLE + (s_suppkey * 53 % 1200) / 100.0::DOUBLE AS longitude
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
CAP = """cap AS (SELECT id, CASE WHEN id % 7 <> 0 THEN max(storage) * 1.1::DOUBLE END AS capacity FROM wk GROUP BY id)"""
FULLCAP = "fullcap AS (SELECT id, max(storage) * 1.1::DOUBLE AS capacity FROM wk GROUP BY id)"
LOWCAP = "lowcap AS (SELECT id, max(storage) * 0.8::DOUBLE AS capacity FROM wk GROUP BY id)"
RAW = """raw_txt AS (SELECT id, strftime(date, '%d/%m/%Y') AS date, CASE WHEN (id + week(date)) % 97 = 0 THEN 'n/a'
 ELSE CAST(storage AS VARCHAR) END AS storage FROM wk)"""
DETAIL = DIMS + """, detail AS (SELECT p_partkey AS id, p_name AS name, province, community, latitude, longitude,
 CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Sin Nombre' ELSE p_name END AS riverbed,
 CASE WHEN p_partkey % 6 <> 0 THEN replace(CAST(p_retailprice AS VARCHAR), '.', ',') END AS crest_elevation,
 CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS dam_height, p_type AS type
 FROM part JOIN dims d ON d.id = p_partkey // 20)"""
POINTS = """points AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS brand,
 CAST(p_size AS DOUBLE) AS dam_height, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS crest_elevation,
 CASE WHEN p_partkey % 41 <> 0 THEN 36.0::DOUBLE + (p_partkey * 37 % 700) / 100.0::DOUBLE END AS latitude,
 -9.0::DOUBLE + (p_partkey * 53 % 1200) / 100.0::DOUBLE AS longitude FROM part)"""
LEVEL = PANEL + """, level AS (SELECT id, date, storage FROM (SELECT id, date,
 avg(storage * 20) OVER w AS storage, count(*) OVER w AS n FROM panel
 WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)) WHERE n = 26)
, curves AS (SELECT id, date, storage FROM level
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC) <= 52)
, plancap AS (SELECT id, max(storage) * (1.05::DOUBLE + (id * 13 % 40) / 2.0::DOUBLE) AS capacity
 FROM level GROUP BY id)"""
KM = ("(12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin(radians({b}latitude - {a}latitude) / 2), 2) "
      "+ cos(radians({a}latitude)) * cos(radians({b}latitude)) "
      "* power(sin(radians({b}longitude - {a}longitude) / 2), 2)))))")


def km_sql(a: str, b: str) -> str:
    return KM.format(a=f"{a}." if a else "", b=f"{b}." if b else "")
