"""Transfer planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import Limits, PlanRules
from panelcast.operators import evaluation as ev, transfer as tp
from panelcast.queries import fixtures as fx
from panelcast.queries.registry import query, with_ctes
from panelcast.session import cut_lineage

# Regions are communities; the distance limit is the planner's own option
NEAR = PlanRules(limits=Limits(km=250.0))


def state(spark, sf):
    levels = cut_lineage(fx.level(spark, sf))
    summary = ev.forecast_summary(levels, fx.plan_curves(levels), "storage")
    entities = fx.plan_entities(spark, sf, levels).withColumnRenamed("community", "region")
    return cut_lineage(tp.prepare_state(entities, summary, NEAR))


def balanced(spark, sf):
    levels = cut_lineage(fx.level(spark, sf))
    summary = ev.order_statistics(levels, fx.plan_curves(levels), "storage")
    entities = fx.plan_entities(spark, sf, levels).withColumnRenamed("community", "region")
    return cut_lineage(tp.balanced_state(entities, summary, NEAR))


SUMMARY = """last AS (SELECT id, arg_max(storage, date) AS last_known_value FROM level GROUP BY id),
 summary AS (SELECT c.id, any_value(last_known_value) AS last_known_value, quantile_cont(storage, 0.1) AS low_forecasted_value,
 median(storage) AS median_forecasted_value FROM curves c JOIN last ON last.id = c.id GROUP BY c.id)"""
STATE = f"""{fx.LEVEL}, {fx.DIMS}, {SUMMARY}, state AS (SELECT d.id, name, province, community AS region, capacity, latitude,
 longitude, last_known_value, low_forecasted_value, median_forecasted_value, low_forecasted_value / capacity AS need_rate,
 median_forecasted_value / capacity AS donor_rate, low_forecasted_value / capacity < 0.075 AS critical,
 low_forecasted_value / capacity < 0.15 AS worrying, median_forecasted_value / capacity > 0.25 AS eligible_donor
 FROM dims d JOIN plancap p ON p.id = d.id JOIN summary s ON s.id = d.id)"""
STATE_NUMBERS = ("capacity latitude longitude last_known_value low_forecasted_value median_forecasted_value need_rate "
                 "donor_rate")
RECEIVERS = """receivers AS (SELECT s.* FROM state s JOIN (SELECT region, bool_or(critical) AS any_critical FROM state GROUP BY region) a
 ON a.region = s.region WHERE critical OR (worrying AND NOT any_critical))"""
PAIRS = f"""pairs AS (SELECT *, distance_km / greatest(volume, 1e-9) AS cost FROM (SELECT d.region, d.id AS donor, r.id AS receiver,
 least(greatest(0, d.last_known_value - (d.last_known_value + r.last_known_value) / (d.capacity + r.capacity) * d.capacity),
 d.capacity * 0.25::DOUBLE, r.capacity - r.last_known_value) AS volume, {fx.km_sql('d', 'r')} AS distance_km
 FROM state d JOIN receivers r ON r.region = d.region AND r.id <> d.id WHERE d.eligible_donor) WHERE volume > 0
 AND distance_km <= 250 AND distance_km / greatest(volume, 1e-9) < 1.5)"""


@query("jn10_state_join", with_ctes([STATE], """SELECT id, region, capacity, last_known_value, low_forecasted_value
 FROM state""", d="capacity last_known_value low_forecasted_value"))
def _(spark, sf):
    return state(spark, sf).select("id", "region", "capacity", "last_known_value", "low_forecasted_value")


@query("tp01_planning_state", with_ctes([STATE], "SELECT * FROM state", d=STATE_NUMBERS))
def _(spark, sf):
    return state(spark, sf)


@query("tp02_receivers", with_ctes([STATE, RECEIVERS], "SELECT id, region, critical, worrying FROM receivers"))
def _(spark, sf):
    return tp.receivers(state(spark, sf)).select("id", "region", "critical", "worrying")


@query("tp03_pair_volume", with_ctes([STATE, RECEIVERS], f"""SELECT d.id AS donor, r.id AS receiver, least(greatest(0,
 d.last_known_value - (d.last_known_value + r.last_known_value) / (d.capacity + r.capacity) * d.capacity),
 d.capacity * 0.25::DOUBLE, 120, r.capacity - r.last_known_value) AS volume FROM state d JOIN state r ON r.region = d.region
 AND r.id <> d.id AND {fx.km_sql('d', 'r')} <= 250""", d="volume"))
def _(spark, sf):
    from panelcast.operators.spatial import pairs_within
    s = state(spark, sf).select("region", *tp.PAIR_COLUMNS)
    limited = PlanRules(limits=Limits(volume=120.0))
    pairs = pairs_within(s, s, 250.0, ["region"]).filter("l_id <> r_id")
    return pairs.select(F.col("l_id").alias("donor"), F.col("r_id").alias("receiver"),
                        tp.pair_volume(limited).alias("volume"))


@query("tp04_candidate_pairs", with_ctes([STATE, RECEIVERS, PAIRS], "SELECT * FROM pairs", d="volume distance_km cost"))
def _(spark, sf):
    return tp.candidate_pairs(state(spark, sf), NEAR)


@query("tp04_candidate_pairs_any_distance", with_ctes([STATE, RECEIVERS, PAIRS.replace("AND distance_km <= 250 ", "")],
                                                      "SELECT * FROM pairs", d="volume distance_km cost"))
def _(spark, sf):
    return tp.candidate_pairs(state(spark, sf))


@query("srt03_cheapest_pair", with_ctes([STATE, RECEIVERS, PAIRS], """SELECT * FROM pairs QUALIFY row_number() OVER (
 PARTITION BY region ORDER BY cost, donor, receiver) = 1""", d="volume distance_km cost"))
def _(spark, sf):
    return tp.best_pairs(state(spark, sf), NEAR)


@query("tp05_one_step", with_ctes([STATE, RECEIVERS, PAIRS, """best AS (SELECT * FROM pairs QUALIFY row_number() OVER (
 PARTITION BY region ORDER BY cost, donor, receiver) = 1), moves AS (SELECT donor AS id, -volume AS d FROM best UNION ALL
 SELECT receiver, volume FROM best), moved AS (SELECT s.id, region, capacity, last_known_value + coalesce(d, 0) AS last_known_value,
 low_forecasted_value + coalesce(d, 0) AS low_forecasted_value, median_forecasted_value + coalesce(d, 0) AS median_forecasted_value
 FROM state s LEFT JOIN moves m ON m.id = s.id)"""], """SELECT *, low_forecasted_value / capacity < 0.075 AS critical,
 low_forecasted_value / capacity < 0.15 AS worrying, median_forecasted_value / capacity > 0.25 AS eligible_donor FROM moved""",
                                  d="capacity last_known_value low_forecasted_value median_forecasted_value"))
def _(spark, sf):
    after, _ = tp.plan_transfers(state(spark, sf), NEAR, max_iterations=1)
    return after.select("id", "region", "capacity", *tp.STORED, "critical", "worrying", "eligible_donor")


@query("tp05_greedy_log")
def _(spark, sf):
    return tp.plan_transfers(state(spark, sf), NEAR)[1]


@query("tp06_select_region", with_ctes([fx.DIMS], f"""SELECT x.id, name, community FROM dims x, (SELECT 38.5::DOUBLE AS latitude,
 -4.0::DOUBLE AS longitude) home WHERE lower(community) = 'asia' AND {fx.km_sql('home', 'x')} <= 350"""))
def _(spark, sf):
    chosen = fx.dims(spark, sf).filter(tp.Area("ASIA", (38.5, -4.0), 350.0).holds("community"))
    return chosen.select("id", "name", "community")


ORDERED = """ranked AS (SELECT id, list_sort(list(storage)) AS v FROM curves GROUP BY id), last AS (SELECT id,
 arg_max(storage, date) AS last_known_value FROM level GROUP BY id)"""
BALANCED = f"""{fx.LEVEL}, {fx.DIMS}, {ORDERED}, base AS (SELECT d.id, community AS region, capacity, latitude, longitude,
 last_known_value, v[6] AS low_forecasted_value, v[-5] AS high_forecasted_value, v[27] AS median_forecasted_value
 FROM dims d JOIN plancap p ON p.id = d.id JOIN ranked r ON r.id = d.id JOIN last l ON l.id = d.id),
 state AS (SELECT *, low_forecasted_value / capacity AS need_rate, median_forecasted_value / capacity AS donor_rate,
 low_forecasted_value / capacity < 0.075 AS critical, low_forecasted_value / capacity < 0.15 AS worrying,
 median_forecasted_value / capacity > 0.25 AS give_if_critical, median_forecasted_value / capacity > 0.35 AS give_if_worrying,
 median_forecasted_value / capacity > 0.6 AS able_to_donate FROM base)"""
FACTORS = f"""spans AS (SELECT a.region, max({fx.km_sql('a', 'b')}) AS dmax FROM state a JOIN state b ON b.region = a.region GROUP BY 1),
 medians AS (SELECT region, median(capacity) AS med FROM state GROUP BY 1),
 costs AS (SELECT d.region, d.id AS donor, r.id AS receiver, {fx.km_sql('d', 'r')} AS km,
 1 / (1 / (4 * {fx.km_sql('d', 'r')} / dmax + 1e-10) * (d.capacity / med * (d.donor_rate + 1e-6))
 / (r.capacity / med * (r.need_rate + 1e-6))) AS cost, CASE WHEN r.critical THEN 1 WHEN r.worrying THEN 2 ELSE 3 END AS tier,
 d.last_known_value - d.capacity / (d.capacity + r.capacity) * (d.last_known_value + r.last_known_value) AS difference,
 r.critical, r.worrying, d.give_if_critical, d.give_if_worrying, d.able_to_donate, d.low_forecasted_value AS d_low,
 r.low_forecasted_value AS r_low, d.capacity AS d_cap, r.capacity AS r_cap FROM state d JOIN state r ON r.region = d.region
 AND r.id <> d.id JOIN spans ON spans.region = d.region JOIN medians ON medians.region = d.region
 WHERE d.give_if_critical), cheap AS (SELECT * FROM costs WHERE cost < 1.5 AND km <= 250)"""
BEST = """best AS (SELECT region, tier, cost, donor, receiver, difference AS volume FROM cheap
 WHERE (tier = 1 AND (d_low - difference) / d_cap >= 0.075 AND (r_low + difference) / r_cap >= 0.075)
 OR (tier = 2 AND give_if_worrying AND (d_low - difference) / d_cap >= 0.15 AND (r_low + difference) / r_cap >= 0.15)
 QUALIFY row_number() OVER (PARTITION BY region ORDER BY tier, cost, donor, receiver) = 1)"""


@query("tp07_region_diameter", with_ctes([BALANCED, FACTORS], "SELECT region, dmax AS diameter_km FROM spans", d="diameter_km"))
def _(spark, sf):
    return tp.diameter_km(balanced(spark, sf), ["region"])


@query("tp07_factor_costs", with_ctes([BALANCED, FACTORS], "SELECT region, donor, receiver, cost FROM cheap", d="cost"))
def _(spark, sf):
    return tp.factor_costs(balanced(spark, sf), NEAR).select(
        "region", F.col("l_id").alias("donor"), F.col("r_id").alias("receiver"), "cost")


@query("tp07_factor_costs_any_distance", with_ctes([BALANCED, FACTORS.replace(" AND km <= 250", "")],
                                                   "SELECT region, donor, receiver, cost FROM cheap", d="cost"))
def _(spark, sf):
    return tp.factor_costs(balanced(spark, sf)).select(
        "region", F.col("l_id").alias("donor"), F.col("r_id").alias("receiver"), "cost")


@query("tp08_ranked_candidates", with_ctes([BALANCED, FACTORS], """SELECT region, tier, donor, receiver, difference, cost, critical,
 worrying, give_if_critical, give_if_worrying, able_to_donate FROM cheap""", d="difference cost"))
def _(spark, sf):
    return tp.ranked_candidates(balanced(spark, sf), NEAR)


@query("tp09_best_acceptable", with_ctes([BALANCED, FACTORS, BEST], "SELECT * FROM best", d="cost volume"))
def _(spark, sf):
    return tp.best_acceptable(balanced(spark, sf), NEAR)


@query("tp10_equal_percentage", with_ctes([BALANCED, FACTORS, BEST, """moves AS (SELECT donor AS id, -volume AS d FROM best UNION ALL
 SELECT receiver, volume FROM best)"""], """SELECT s.id, last_known_value + coalesce(d, 0) AS last_known_value,
 low_forecasted_value + coalesce(d, 0) AS low_forecasted_value, high_forecasted_value + coalesce(d, 0) AS high_forecasted_value,
 median_forecasted_value + coalesce(d, 0) AS median_forecasted_value, (low_forecasted_value + coalesce(d, 0)) / capacity < 0.075
 AS critical FROM state s LEFT JOIN moves m ON m.id = s.id""",
                                          d="last_known_value low_forecasted_value high_forecasted_value median_forecasted_value"))
def _(spark, sf):
    s = balanced(spark, sf)
    return tp.equalise(s, tp.best_acceptable(s, NEAR), NEAR).select("id", *tp.BALANCED, "critical")


@query("tp11_curves_after", with_ctes([BALANCED, FACTORS, BEST, """net AS (SELECT id, sum(d) AS net FROM (SELECT donor AS id, -volume AS d
 FROM best UNION ALL SELECT receiver, volume FROM best) GROUP BY id)"""], """SELECT c.id, c.date,
 (c.storage + coalesce(net, 0)) / s.capacity AS fraction FROM curves c JOIN state s ON s.id = c.id LEFT JOIN net ON net.id = c.id""",
                                     t="date", d="fraction"))
def _(spark, sf):
    s = balanced(spark, sf)
    return tp.curves_after(fx.plan_curves(fx.level(spark, sf)), tp.best_acceptable(s, NEAR), s, "storage")


@query("tp12_balanced_plan")
def _(spark, sf):
    return tp.plan_balanced(balanced(spark, sf), NEAR)[1]
