"""Joining cleaned tables into the curated outputs.

No join here carries a broadcast hint: dimension sizes grow with the data, so Spark decides from measured sizes
(``autoBroadcastJoinThreshold`` and adaptive execution) and falls back to a shuffled, skew-split join.
Fixed value tables from ``config`` are map literals and need no join at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelcast import config
from panelcast.functions.columns import map_value
from panelcast.operators.clean import best_row_per_key, cap_at_capacity, community_of, unify_province
from panelcast.operators.quality import conform, duplicate_keys, enforce_empty
from panelcast.operators.spatial import fill_from_nearest


def first_per_key(df: DataFrame, key: str, order: str = "id") -> DataFrame:
    return best_row_per_key(df, key, [F.col(order)])


def join_details(entities: DataFrame, details: DataFrame, names: Mapping[str, str] = config.DETAIL_NAME_OF,
                 aliases: Mapping[str, str] = config.NAME_ALIASES) -> DataFrame:
    """One-to-one left join of entities and details on the alias-normalised name."""
    left = first_per_key(entities.withColumn("name", map_value(F.col("name"), names, keep=True)), "name")
    left = left.withColumn("name", map_value(F.col("name"), aliases, keep=True))
    right = details.withColumn("name", map_value(F.col("name"), aliases, keep=True))
    extra = [c for c in right.columns if c != "name" and c in left.columns]
    return left.join(right.drop(*extra), "name", "left")


def name_collisions(entities: DataFrame, details: DataFrame, names: Mapping[str, str] = config.DETAIL_NAME_OF,
                    aliases: Mapping[str, str] = config.NAME_ALIASES) -> DataFrame:
    """``side, name, rows``: names that several rows of one side share in ``join_details``; empty when it is one-to-one."""
    known = first_per_key(entities.withColumn("name", map_value(F.col("name"), names, keep=True)), "name")
    sides = [df.select(F.lit(side).alias("side"), map_value(F.col("name"), aliases, keep=True).alias("name"))
             for side, df in (("entities", known), ("details", details))]
    return duplicate_keys(sides[0].unionByName(sides[1]).filter(F.col("name").isNotNull()), ["side", "name"])


def fill_missing(df: DataFrame, column: str, table: DataFrame, key: str = "name") -> DataFrame:
    """Fill nulls of a column from a lookup table with a unique key; known values stay."""
    t = table.select(key, F.col(column).alias("_known"))
    return df.join(t, key, "left").withColumn(column, F.coalesce(column, "_known")).drop("_known")


def to_resolve(df: DataFrame, column: str, table: DataFrame, key: str = "name") -> DataFrame:
    """Keys whose value is missing here and in the lookup table: the work list for an outside lookup."""
    known = table.filter(F.col(column).isNotNull()).select(key)
    return df.filter(F.col(column).isNull()).select(key).join(known, key, "left_anti").distinct()


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Many-to-one left join to a stored lookup whose schema is checked here and its key by ``duplicate_keys``."""
    conform(lookup, "lookup", **dict.fromkeys([key, *columns], "anything"))
    return df.join(lookup.select(key, *columns), key, "left")


def override(layers: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Union of layers in which a later layer wins; one row per key, ties inside a layer to the greater value."""
    stacked = None
    for priority, layer in enumerate(layers):
        part = layer.select(key, value, F.lit(priority).alias("_p"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(key).agg(F.max_by(F.col(value), F.struct("_p", value)).alias(value))


def patch_coordinates(df: DataFrame, manual: DataFrame, looked_up: DataFrame, manual_first: bool = True) -> DataFrame:
    """Overwrite coordinates of the names listed in the manual or the looked-up table; incomplete rows are ignored."""
    complete = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    layers = [t.filter(complete).select("name", F.struct("latitude", "longitude").alias("_point"))
              for t in ((looked_up, manual) if manual_first else (manual, looked_up))]
    patch = override(layers, "name", "_point")
    return (df.join(patch, "name", "left")
            .withColumn("latitude", F.coalesce("_point.latitude", "latitude"))
            .withColumn("longitude", F.coalesce("_point.longitude", "longitude")).drop("_point"))


def fresh_ids(panel: DataFrame, weeks: int = config.MAX_STALENESS_WEEKS) -> DataFrame:
    """Ids whose last date is at most the given number of weeks behind the newest date of all."""
    last = panel.groupBy("id").agg(F.max("date").alias("last_date"))
    newest = panel.agg(F.max("date")).scalar()
    return last.filter(F.col("last_date") >= F.date_sub(newest, 7 * weeks))


def keep_listed(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def in_community(df: DataFrame, community: str, column: str = "autonomous_community") -> DataFrame:
    return df.filter(F.lower(F.trim(F.col(column))) == community.strip().lower())


def reconcile(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Every name of either side, classed as paired, left_only or right_only."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    side = (F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("paired"))
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def match_rate(rows: DataFrame, key: Column, names: DataFrame, label: str) -> DataFrame:
    """How many joined rows a candidate key gives. Both sides are counted per key first, so no pair is formed."""
    a = rows.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_a"))
    b = names.groupBy(F.col("name").alias("_k")).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, "_k").agg(F.lit(label).alias("candidate"),
                               F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("matches"))


def missing_members(wanted: DataFrame, available: DataFrame, key: str = "id") -> DataFrame:
    return wanted.select(key).join(available.select(key), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Values of exactly one side, with the side; empty when the two sets are equal."""
    return reconcile(left, right, key).filter(F.col("side") != "paired")


def curate(panel: DataFrame, entities: DataFrame, details: DataFrame, provinces: DataFrame,
           coordinates: DataFrame, manual_coordinates: DataFrame, real_names: DataFrame,
           manual_provinces: Mapping[str, str] = config.MANUAL_PROVINCES,
           communities: Mapping[str, str] = config.PROVINCE_TO_COMMUNITY) -> dict[str, DataFrame]:
    """The curated tables: ``panel``, ``entities``, ``details`` and ``merged``.

    Raises when two rows of a side end up under one name, when readings have no entity or no capacity, or when a value
    is missing that no row can give.
    """
    enforce_empty(name_collisions(entities, details), "names that are not unique after aliasing")
    ids = panel.select("id").distinct()
    enforce_empty(missing_members(ids, entities), "readings without an entity")
    enforce_empty(missing_members(ids, entities.filter(F.col("capacity").isNotNull())), "readings without a capacity")
    fresh = fresh_ids(panel)
    merged = keep_listed(join_details(entities, details), fresh)
    merged = fill_missing(merged, "province", provinces)
    merged = merged.withColumn("province", F.coalesce(
        "province", map_value(F.col("name"), manual_provinces, keep=False)))
    merged = community_of(unify_province(merged), communities)
    merged = patch_coordinates(merged, manual_coordinates, coordinates)
    for column in ("crest_elevation", "riverbed", "basin"):
        if column in merged.columns:
            merged = fill_from_nearest(merged, column, required=True)
    merged = join_lookup(merged, real_names, "name", ["real_name"])
    return {"panel": keep_listed(cap_at_capacity(panel, entities), fresh),
            "entities": keep_listed(entities, fresh), "details": details, "merged": merged}


def final_columns(df: DataFrame, table: str) -> DataFrame:
    """The published columns of ``merged``, ``entities`` or ``details``, in order; one that is missing is an error."""
    wanted = config.FINAL_COLUMNS[table]
    conform(df, table, **dict.fromkeys(wanted, "anything"))
    return df.select(*wanted)


def invalid_points(df: DataFrame) -> DataFrame:
    """Rows with a coordinate outside the globe's ranges; missing coordinates are allowed."""
    return df.filter("NOT coalesce(latitude BETWEEN -90 AND 90, true) OR NOT coalesce(longitude BETWEEN -180 AND 180, true)")
