"""Weekly grid, lags, rolling statistics and other window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast import config
from panelcast.operators import clean, features as ft
from panelcast.queries import fixtures as fx
from panelcast.queries.registry import query, with_ctes

W = "OVER (PARTITION BY id ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def names(df, *wanted):
    return df.select(*wanted)


@query("win01_weekly_grid", with_ctes([fx.GRID], "SELECT id, date, storage FROM grid", t="date"))
def _(spark, sf):
    return clean.weekly_grid(fx.readings(spark, sf))


@query("win02_backfill_flag", with_ctes([fx.PANEL], "SELECT id, date, storage, storage_imputed FROM panel", t="date"))
def _(spark, sf):
    return clean.flag_and_backfill(clean.weekly_grid(fx.readings(spark, sf)))


@query("win02_weekly_panel", with_ctes([fx.PANEL], "SELECT id, date, storage, storage_imputed FROM panel", t="date"))
def _(spark, sf):
    return clean.weekly_panel(fx.readings(spark, sf))


def lag_sql(lags, value="storage"):
    return ", ".join(f"lag({value}, {n}) {W} AS {value}_lag_{n}w" for n in lags)


@query("win03_lags", with_ctes([fx.PANEL], f"SELECT id, date, {lag_sql(config.LAGS)} FROM panel", t="date"))
def _(spark, sf):
    return fx.panel(spark, sf).select("id", "date", *[
        c.alias(k) for k, c in ft.lag_columns("storage", config.LAGS).items()])


def rolling_sql(windows, full=True, value="storage"):
    out = []
    for n in windows:
        for label, fn in (("mean", "avg"), ("std", "stddev_samp")):
            stat = f"{fn}({value}) {frame(n)}"
            out.append((f"CASE WHEN count({value}) {frame(n)} = {n} THEN {stat} END" if full else stat)
                       + f" AS {value}_{label}_{n}w")
    return ", ".join(out)


def cols(kinds, windows, value="storage"):
    return " ".join(f"{value}_{k}_{n}w" for n in windows for k in kinds)


@query("win04_rolling_full", with_ctes([fx.PANEL], f"SELECT id, date, {rolling_sql(config.ROLLING_WINDOWS)} FROM panel",
                                       t="date", d=cols(("mean", "std"), config.ROLLING_WINDOWS)))
def _(spark, sf):
    return fx.panel(spark, sf).select("id", "date", *[
        c.alias(k) for k, c in ft.rolling_columns("storage", config.ROLLING_WINDOWS).items()])


@query("win05_next_target", with_ctes([fx.PANEL], f"SELECT id, date, lead(storage) {W} AS target_storage FROM panel",
                                      t="date"))
def _(spark, sf):
    return fx.panel(spark, sf).select("id", "date", F.lead("storage").over(ft.by_date()).alias("target_storage"))


PARTIAL = (4, 12, 26)
EXTREMES = ", ".join(f"{fn}(storage) {frame(n)} AS storage_{fn}_{n}w" for n in PARTIAL for fn in ("min", "max"))


@query("win06_rolling_partial",
       with_ctes([fx.PANEL], f"SELECT id, date, {rolling_sql(PARTIAL, full=False)}, {EXTREMES} FROM panel",
                 t="date", d=cols(("mean", "std"), PARTIAL)))
def _(spark, sf):
    made = {**ft.rolling_columns("storage", PARTIAL, full=False), **ft.extreme_columns("storage", PARTIAL)}
    return fx.panel(spark, sf).select("id", "date", *[c.alias(k) for k, c in made.items()])


FRACTION = (fx.PANEL + ", " + fx.FULLCAP + """, fr AS (SELECT p.id, p.date, p.storage, p.storage / c.capacity AS fraction
 FROM panel p JOIN fullcap c ON c.id = p.id)""")


def with_fraction(spark, sf):
    cap = fx.capacity(spark, sf, gaps=False)
    return ft.join_metadata(fx.panel(spark, sf), cap).withColumn("fraction", F.col("storage") / F.col("capacity"))


CHANGES = ", ".join([f"storage - lag(storage, {n}) {W} AS storage_change_{n}w" for n in (1, 4, 12)]
                    + [f"fraction - lag(fraction, {n}) {W} AS fraction_change_{n}w" for n in (1, 4)])


@query("win07_differences", with_ctes([FRACTION], f"SELECT id, date, {CHANGES} FROM fr", t="date",
                                      d="fraction_change_1w fraction_change_4w"))
def _(spark, sf):
    made = {**ft.change_columns("storage", (1, 4, 12)), **ft.change_columns("fraction", (1, 4))}
    return with_fraction(spark, sf).select("id", "date", *[c.alias(k) for k, c in made.items()])


@query("win08_rolling_slope", with_ctes([fx.PANEL, """numbered AS (SELECT *,
 CAST(row_number() OVER (PARTITION BY id ORDER BY date) AS DOUBLE) AS t FROM panel)"""], "SELECT id, date, " + ", ".join(
    f"CASE WHEN count(storage) {frame(n)} = {n} THEN regr_slope(storage, t) {frame(n)} END AS storage_trend_{n}w"
    for n in (4, 12)) + " FROM numbered", t="date", d="storage_trend_4w storage_trend_12w"))
def _(spark, sf):
    made = ft.trend_columns("storage", (4, 12))
    return ft.numbered(fx.panel(spark, sf)).select("id", "date", *[c.alias(k) for k, c in made.items()])


@query("win09_volatility", with_ctes([fx.PANEL], "SELECT id, date, " + ", ".join(
    [f"CASE WHEN count(storage) {frame(n)} = {n} THEN stddev_samp(storage) {frame(n)} "
     f"/ nullif(avg(storage) {frame(n)}, 0) END AS storage_volatility_{n}w" for n in (4, 12)]
    + [f"storage - avg(storage) {frame(n)} AS storage_vs_{n}w_mean" for n in PARTIAL]) + " FROM panel",
    t="date", d="storage_volatility_4w storage_volatility_12w " + " ".join(f"storage_vs_{n}w_mean" for n in PARTIAL)))
def _(spark, sf):
    made = {**ft.volatility_columns("storage", (4, 12)), **ft.distance_to_mean_columns("storage", PARTIAL)}
    return fx.panel(spark, sf).select("id", "date", *[c.alias(k) for k, c in made.items()])


@query("win10_fill_both_ways", with_ctes([fx.GRID, """holes AS (SELECT id, date,
 CASE WHEN dayofyear(date) > 100 THEN storage END AS storage FROM grid)"""], """SELECT id, date, coalesce(
 last_value(storage IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(storage IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
 ) AS storage FROM holes""", t="date"))
def _(spark, sf):
    holes = clean.weekly_grid(fx.readings(spark, sf)).withColumn(
        "storage", F.when(F.dayofyear("date") > 100, F.col("storage")))
    return holes.withColumn("storage", ft.fill_both_ways("storage"))


LONG_LAGS = (8, 12, 13, 26, 39, 52)


@query("win11_long_lags", with_ctes([FRACTION], f"SELECT id, date, {lag_sql(LONG_LAGS)}, {lag_sql(LONG_LAGS, 'fraction')}"
                                    " FROM fr", t="date", d=cols(("lag",), LONG_LAGS, "fraction")))
def _(spark, sf):
    made = {**ft.lag_columns("storage", LONG_LAGS), **ft.lag_columns("fraction", LONG_LAGS)}
    return with_fraction(spark, sf).select("id", "date", *[c.alias(k) for k, c in made.items()])


@query("win12_tallest_per_name", with_ctes([fx.POINTS], """SELECT id, name, type, brand, dam_height, crest_elevation
 FROM (SELECT *, CASE WHEN id % 5 <> 0 THEN dam_height END AS h FROM points)
 QUALIFY row_number() OVER (PARTITION BY name ORDER BY h DESC NULLS LAST, id) = 1"""))
def _(spark, sf):
    points = fx.parts_on_map(spark, sf)
    masked = points.withColumn("_h", F.col("dam_height")).withColumn(
        "dam_height", F.when(F.col("id") % 5 != 0, F.col("dam_height")))
    return clean.tallest_per_name(masked).select(
        "id", "name", "type", "brand", F.col("_h").alias("dam_height"), "crest_elevation")


@query("win13_first_per_name", with_ctes([fx.POINTS], """SELECT id, name, type, brand FROM points
 QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1"""))
def _(spark, sf):
    points = fx.parts_on_map(spark, sf).select("id", "name", "type", "brand")
    return clean.best_row_per_key(points, "name", [F.col("id")])


@query("win16_trailing_rows", with_ctes([fx.PANEL], """SELECT id, date, storage FROM panel
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY date DESC) <= 104""", t="date"))
def _(spark, sf):
    return ft.last_rows(fx.panel(spark, sf), 104).select("id", "date", "storage")


@query("win17_sequences", with_ctes([fx.PANEL, """numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date)
 AS rn FROM panel)"""], """SELECT a.id, a.date, string_agg(CAST(CAST(b.storage AS BIGINT) AS VARCHAR) || ':' ||
 CAST(b.storage_imputed AS VARCHAR), ',' ORDER BY b.rn) AS steps, max(a.storage) AS target
 FROM numbered a JOIN numbered b ON a.id = b.id AND b.rn BETWEEN a.rn - 12 AND a.rn - 1
 WHERE a.rn > 12 GROUP BY a.id, a.date""", t="date"))
def _(spark, sf):
    made = ft.sequences(fx.panel(spark, sf), ["storage", "storage_imputed"], 12)
    step = F.transform("window", lambda s: F.concat_ws(":", s[0].cast("bigint"), s[1].cast("bigint")))
    return made.select("id", "date", F.array_join(step, ",").alias("steps"), "target")


@query("weekly_features", with_ctes([fx.PANEL, fx.FULLCAP, "j AS (SELECT p.*, c.capacity FROM panel p JOIN fullcap c ON c.id = p.id)"],
       f"""SELECT id, date, storage, storage_imputed, capacity, week(date) AS week_of_year, year(date) AS year,
 storage / capacity AS storage_fraction, {lag_sql(config.LAGS)}, {rolling_sql(config.ROLLING_WINDOWS)},
 lead(storage) {W} AS target_storage FROM j""", t="date",
       d="capacity storage_fraction " + cols(("mean", "std"), config.ROLLING_WINDOWS)))
def weekly_features(spark, sf):
    return ft.build_features(fx.panel(spark, sf), fx.capacity(spark, sf, gaps=False))


def extended_sql() -> str:
    lags = (1, 2, 3, 4, 8, 12, 13, 26, 39, 52)
    made = [lag_sql(lags), lag_sql(lags, "fraction"), rolling_sql(PARTIAL, full=False), EXTREMES, CHANGES]
    made += [f"CASE WHEN count(storage) {frame(n)} = {n} THEN regr_slope(storage, t) {frame(n)} END AS storage_trend_{n}w, "
             f"CASE WHEN count(storage) {frame(n)} = {n} THEN stddev_samp(storage) {frame(n)} / nullif(avg(storage) {frame(n)}, 0) "
             f"END AS storage_volatility_{n}w" for n in (4, 12)]
    made += [f"storage - avg(storage) {frame(n)} AS storage_vs_{n}w_mean" for n in PARTIAL]
    fresh = ([f"{v}_lag_{n}w" for v in ("storage", "fraction") for n in lags]
             + [f"storage_{k}_{n}w" for k in ("mean", "std", "min", "max") for n in PARTIAL]
             + [f"storage_change_{n}w" for n in (1, 4, 12)] + [f"fraction_change_{n}w" for n in (1, 4)]
             + [f"storage_{k}_{n}w" for k in ("trend", "volatility") for n in (4, 12)]
             + [f"storage_vs_{n}w_mean" for n in PARTIAL])
    filled = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER past, first_value({c} IGNORE NULLS) OVER future) AS {c}"
                       for c in fresh)
    ctes = [FRACTION, """base AS (SELECT fr.*, p.storage_imputed, c.capacity, CAST(row_number() OVER (PARTITION BY fr.id
 ORDER BY fr.date) AS DOUBLE) AS t FROM fr JOIN panel p ON p.id = fr.id AND p.date = fr.date JOIN fullcap c ON c.id = fr.id)""",
            f"wide AS (SELECT id, date, storage, storage_imputed, capacity, fraction, {', '.join(made)} FROM base)"]
    body = f"""SELECT id, date, storage, storage_imputed, capacity, fraction, week(date) AS week_of_year, year(date) AS year,
 month(date) AS month, dayofyear(date) AS day_of_year, CAST(month(date) BETWEEN 6 AND 9 AS BIGINT) AS is_summer,
 CAST(month(date) IN (12, 1, 2) AS BIGINT) AS is_winter, {filled} FROM wide
 WINDOW past AS (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 future AS (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
    return with_ctes(ctes, body, t="date", d="capacity fraction " + " ".join(fresh))


@query("extended_features", extended_sql())
def _(spark, sf):
    return ft.extended_features(fx.panel(spark, sf), fx.capacity(spark, sf, gaps=False))
