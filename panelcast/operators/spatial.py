"""Nearest neighbour, range join and diameter over points, blocked by cube cells instead of cross joins.

Both sides of the range join are exploded copies of their input. Spark's size estimate does not see that growth, so
it asks for a merge join rather than risk a broadcast many times the allowed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.functions import geo
from panelcast.session import cut_lineage

EVERY_LEVEL = f"sequence(0, {geo.FINEST})"
# Levels of the pyramids, from the whole sphere to cubes of a fraction of a millimetre
LEVELS = (0, 4, 8, 13, 20, 28, 36)
SPREAD_LEVELS = (0, 3, 6, 9, 12, 15, 18, 22, 26, 30, 34, 38)
# Rounding of straight-line distances on the unit sphere, and of kilometres to six places
TOLERANCE = 1e-9
# Keys among which the left rows of one cube are dealt
DEALS = 16
# Tasks for each core of a join with a fixed reach, whose work grows faster than its bytes
TASKS_OF_CORE = 4
# Cubes down to this level are about 100,000
FEW_CUBES = 8


def _at_levels(df: DataFrame, levels: str) -> DataFrame:
    return (df.withColumn("_level", F.explode(F.expr(levels)))
            .withColumn("_cell", geo.cell("latitude", "longitude", "_level")))


def pyramid(points: DataFrame, coarse: int, fine: int, on: Sequence[str] = ()) -> DataFrame:
    """Occupied cubes of the coarse level with the occupied cubes of the fine level in them.

    ``points`` are distinct and have ``x, y, z`` and ``leaf``. A fine cube tells its number of points ``n`` and one of
    them. A coarse cube holds at most the fine cubes that the sphere passes through, however many points there are.
    """
    side, shift = geo.cube_side(fine), fine - coarse
    cell = F.struct(*[F.expr(f"CAST(floor(({i} + 1.5D) / {side}) AS BIGINT)").alias(i) for i in "xyz"])
    cubes = points.groupBy(*on, cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y", "z", "leaf")).alias("p"))
    parent = F.struct(*[F.shiftright(f"cell.{i}", shift).alias(i) for i in "xyz"])
    return cubes.groupBy(*on, parent.alias("_cell")).agg(F.collect_list(F.struct("cell", "n", "p")).alias("_kids"))


def nearest(targets: DataFrame, candidates: DataFrame, value: str, id_col: str = "id") -> DataFrame:
    """Nearest candidate of every distinct target point: ``latitude, longitude, km, id, value``.

    Exact, best-first down an occupancy pyramid: a target holds the cubes that may have its nearest candidate. Each
    step replaces them by the finer cubes in them, measures one candidate of each, and keeps those no farther away than
    the nearest candidate measured so far. So a target far from a dense cluster looks at the cluster's near edge only. Cubes of one
    candidate are decided at once. Candidates and targets are first reduced to distinct points (ties go to the smaller
    id), so copies of one point cost nothing.
    """
    points = geo.on_sphere(targets.select("latitude", "longitude").distinct(), prefix="_t")
    best_of_point = (candidates.groupBy("latitude", "longitude")
                     .agg(F.min(F.struct(F.col(id_col).alias("id"), F.col(value).alias("value"))).alias("_hit")))
    placed = cut_lineage(best_of_point)
    leaves = geo.on_sphere(placed.select("latitude", "longitude", F.struct(
        F.col("_hit.id").alias("id"), "latitude", "longitude").alias("leaf"))).select("x", "y", "z", "leaf")
    rows = points.select("*", F.lit(4.0).alias("_bound"), F.lit(None).cast(near_type(placed)).alias("_near"),
                         F.expr("named_struct('x', 0L, 'y', 0L, 'z', 0L)").alias("_cell"))
    finished = []
    for step, (coarse, fine) in enumerate(zip(LEVELS[:-1], LEVELS[1:])):
        cubes = pyramid(leaves, coarse, fine)
        # Cubes down to level 8 are bounded by the sphere itself: about 100,000
        cubes = F.broadcast(cubes) if fine <= 8 else cubes.hint("merge")
        state = _descend(rows.join(cubes, "_cell"), fine, alone=step == 0)
        if fine >= 8:
            state = cut_lineage(state)
            finished.append(state.filter("size(_open) = 0").select("latitude", "longitude", "_near"))
        rows = state.withColumn("_cell", F.explode("_open")).drop("_open")
        if fine >= 8 and rows.isEmpty():
            break
    else:
        # Cubes of the last level are far smaller than the rounding of a distance: any point of one will do
        finished.append(state.filter("size(_open) > 0").select("latitude", "longitude", F.expr(
            "array_min(array_append(_last, _near))").alias("_near")))
    found = finished[0]
    for more in finished[1:]:
        found = found.unionByName(more)
    hits = placed.select(F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.col("_hit.value").alias("value"))
    return (found.join(hits, (F.col("_near.latitude") == F.col("_lat")) & (F.col("_near.longitude") == F.col("_lon")))
            .select("latitude", "longitude", F.col("_near.km").alias("km"), F.col("_near.id").alias("id"), "value"))


def near_type(placed: DataFrame) -> str:
    kind = placed.schema["_hit"].dataType["id"].dataType.simpleString()
    return f"struct<km: double, id: {kind}, latitude: double, longitude: double>"


def _descend(rows: DataFrame, level: int, alone: bool) -> DataFrame:
    """One step of ``nearest``: measure the finer cubes, and keep what may hold the nearest candidate.

    ``alone`` marks the first step, in which a target has one row and nothing is decided yet; else its rows are
    gathered first.
    """
    # Distances in kilometres are worked out for what is left only
    hit = f"""named_struct('km', round({geo.haversine_sql('latitude', 'longitude', 's.leaf.latitude', 's.leaf.longitude')}, 6),
        'id', s.leaf.id, 'latitude', s.leaf.latitude, 'longitude', s.leaf.longitude)"""
    scored = rows.withColumn("_kids", F.expr(f"""transform(_kids, k -> named_struct('low', {geo.box_gap_sql('k.cell', '_t', level)},
        'high', {geo.span_sql('k.p.', '_t')}, 'cell', k.cell, 'n', k.n, 'leaf', k.p.leaf))"""))
    scored = scored.withColumn("_bound", F.expr("least(_bound, array_min(transform(_kids, s -> s.high)))"))
    possible = f"filter(_kids, s -> s.low <= _bound + {TOLERANCE!r}D)"
    scored = scored.withColumn("_kids", F.expr(possible))
    if not alone:
        scored = scored.groupBy("latitude", "longitude").agg(
            *[F.first(c).alias(c) for c in ("_tx", "_ty", "_tz")], F.min("_bound").alias("_bound"),
            F.min("_near").alias("_near"), F.flatten(F.collect_list("_kids")).alias("_kids"))
        scored = scored.withColumn("_kids", F.expr(possible))
    decided = "false" if alone else "s.n = 1"
    return scored.select(
        "latitude", "longitude", "_tx", "_ty", "_tz", "_bound",
        F.expr(f"array_min(array_append(transform(filter(_kids, s -> {decided}), s -> {hit}), _near))").alias("_near"),
        F.expr(f"transform(filter(_kids, s -> NOT ({decided})), s -> s.cell)").alias("_open"),
        *([F.expr(f"transform(filter(_kids, s -> s.n > 1), s -> {hit})").alias("_last")] if level == LEVELS[-1] else []))


def fill_from_nearest(df: DataFrame, column: str, id_col: str = "id", required: bool = False) -> DataFrame:
    """Fill nulls of a column from the nearest row that has it, flagged in ``<column>_imputed``.

    Rows without valid coordinates are neither filled nor copied from. ``required`` makes it an error if values are
    missing and no row can give any.
    """
    if required:
        require_candidates(df, column)
    fillable = F.col(column).isNull() & geo.valid_point()
    near = nearest(df.filter(fillable), df.filter(F.col(column).isNotNull() & geo.valid_point()), column, id_col)
    patch = near.select("latitude", "longitude", F.col("value").alias("_near"))
    # Only rows to fill take part in the join; the rest pass through
    filled = (df.filter(fillable).join(patch, ["latitude", "longitude"], "left")
              .withColumn(column, F.col("_near")).withColumn(f"{column}_imputed", F.col("_near").isNotNull()))
    kept = df.filter(~fillable).withColumn(f"{column}_imputed", F.lit(False))
    order = list(dict.fromkeys([*df.columns, f"{column}_imputed"]))
    return kept.select(order).unionByName(filled.select(order))


def require_candidates(df: DataFrame, column: str) -> None:
    """Raise when something is missing but nothing can be copied."""
    row = df.agg(F.max(F.col(column).isNull()).alias("missing"),
                 F.max(F.col(column).isNotNull() & geo.valid_point()).alias("usable")).first()
    if row["missing"] and not row["usable"]:
        raise ValueError(f"{column} has gaps, but no row with a value and a place to copy it from")


def pairs_within(left: DataFrame, right: DataFrame, reach_km: float | Column, on: Sequence[str] = ()) -> DataFrame:
    """Pairs (left, right) no farther apart than the left row's reach, with their distance ``km``.

    Left columns come back prefixed ``l_``, right columns ``r_``. An equi-join on (group, level, cube) replaces the
    cross join; each left row uses the level that fits its own reach. Few cubes may hold all points, so with a fixed reach
    the left rows of a cube are dealt to ``DEALS`` keys. Rows cross the network with one number for cube and deal, and only to
    cubes that hold points; what the test of a pair needs is worked out behind it. Straight lines tell pairs that are near enough.
    """
    on = list(on)
    fixed = not isinstance(reach_km, Column)
    reach = F.lit(float(reach_km)) if fixed else reach_km
    probe = left.withColumn("_reach", reach).filter("_reach >= 0")
    level = min(geo.level_for(reach_km), geo.FINEST_NUMBERED) if fixed else None
    probe = probe.withColumn("_level", F.lit(level) if fixed else geo.level_sql("_reach"))
    probe = probe.withColumn("_own", geo.cell("latitude", "longitude", "_level"))
    build = _at_levels(right, f"array({level})" if fixed else EVERY_LEVEL)
    own, others = [[F.col(c).alias(f"{side}_{c}") for c in df.columns] for side, df in (("l", left), ("r", right))]
    if fixed:
        keys = [*on, "_cell"]
        deal = F.pmod(F.xxhash64(*left.columns), F.lit(DEALS)).alias("_deal")
        lhs = probe.select(*on, deal, F.explode(geo.touching_cells("_own")).alias("_cell"), *own).withColumn("_cell", geo.cell_number("_cell"))
        if level <= FEW_CUBES:
            # Bounded by the sphere itself, whatever the groups are
            lhs = lhs.join(F.broadcast(build.select(geo.cell_number("_cell").alias("_cell")).distinct()), "_cell", "left_semi")
        rhs = build.select(*on, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))).alias("_deal"),
                           geo.cell_number("_cell").alias("_cell"), *others)
        context = left.sparkSession.sparkContext
        tasks = max(TASKS_OF_CORE * context.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        lhs, rhs = (df.withColumn("_cell", F.col("_cell") + F.col("_deal")).drop("_deal").repartition(tasks, *keys) for df in (lhs, rhs))
        lhs = lhs.withColumn("_reach", reach)
    else:
        keys = [*on, "_level", "_cell"]
        lhs = probe.select(*on, "_level", "_reach", F.explode(geo.touching_cells("_own")).alias("_cell"), *own)
        rhs = build.select(*keys, *others)
    lhs, rhs = (geo.on_sphere(df, f"{side}_latitude", f"{side}_longitude", f"_{side}").withColumn(
        f"_{side}cos", F.expr(f"cos(radians({side}_latitude))")) for side, df in (("l", lhs), ("r", rhs)))
    lhs = lhs.withColumns({"_most": F.expr(f"pow({geo.chord_sql('_reach')} + {TOLERANCE!r}D, 2)"),
                           "_sure": F.expr(f"pow(greatest({geo.chord_sql('_reach')} - {TOLERANCE!r}D, 0D), 2)")})
    straight = "((_lx - _rx) * (_lx - _rx) + (_ly - _ry) * (_ly - _ry) + (_lz - _rz) * (_lz - _rz))"
    # The kilometres decide where rounding of the straight line could; they are worked out once for each pair that stays
    close = f"""{straight} <= _most AND ({straight} < _sure
        OR {geo.haversine_sql('l_latitude', 'l_longitude', 'r_latitude', 'r_longitude')} <= _reach)"""
    up, along = "sin(radians(r_latitude - l_latitude) / 2)", "sin(radians(r_longitude - l_longitude) / 2)"
    km = F.expr(f"{2 * geo.EARTH_RADIUS_KM}D * asin(sqrt(least(1D, {up} * {up} + _lcos * _rcos * {along} * {along})))")
    near = lhs.join(rhs.hint("merge"), keys).filter(close)
    return near.select(*on, *[f"l_{c}" for c in left.columns], *[f"r_{c}" for c in right.columns], km.alias("km"))


def within_radius(df: DataFrame, latitude: float, longitude: float, radius_km: float) -> DataFrame:
    """Rows no farther than the radius from a point, with a box pre-filter."""
    return df.filter(geo.in_disc(latitude, longitude, radius_km))


def diameter_km(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Largest distance between two points of each group, exact, without forming all pairs of points.

    Pairs of cubes are refined together. A pair stays while the largest distance its cubes allow reaches the largest
    distance between two points measured so far in the group; cubes of one point are decided. How many pairs
    stay depends on how close to farthest they are, not on the number of points, and no key holds more of them
    than a cube has partners.
    """
    on = list(on)
    leaf = F.struct("latitude", "longitude").alias("leaf")
    points = cut_lineage(geo.on_sphere(df.select(*on, "latitude", "longitude").distinct()).select(*on, "x", "y", "z", leaf))
    root = F.expr("named_struct('x', 0L, 'y', 0L, 'z', 0L)")
    alive = points.select(*on).distinct().select(*on, root.alias("_a"), root.alias("_b"), F.lit(0.0).alias("_best"))
    far = None
    for coarse, fine in zip(SPREAD_LEVELS[:-1], SPREAD_LEVELS[1:]):
        # Both pyramids of the step are the same table: one exchange
        cubes = pyramid(points, coarse, fine, on)
        left = cubes.select(*on, F.col("_cell").alias("_a"), F.col("_kids").alias("_left"))
        right = cubes.select(*on, F.col("_cell").alias("_b"), F.col("_kids").alias("_right"))
        widest = geo.box_span_sql("k.cell", fine, "_b", coarse)
        half = alive.join(left.hint("merge"), [*on, "_a"]).withColumn("_left", F.expr(
            f"filter(_left, k -> {widest} >= _best - {TOLERANCE!r}D)")).select(
            *on, "_a", "_b", "_best", F.explode("_left").alias("_k"))
        twin = "_a = _b AND (k.cell.x, k.cell.y, k.cell.z) < (_k.cell.x, _k.cell.y, _k.cell.z)"
        wide = geo.box_span_sql("k.cell", fine, "_k.cell", fine)
        full = half.join(right.hint("merge"), [*on, "_b"]).withColumn("_right", F.expr(
            f"filter(_right, k -> {wide} >= _best - {TOLERANCE!r}D AND NOT ({twin}))")).select(
            *on, "_k", F.explode("_right").alias("_l"))
        full = cut_lineage(full.select(
            *on, F.col("_k.cell").alias("_a"), F.col("_l.cell").alias("_b"), (F.col("_k.n") * F.col("_l.n") > 1).alias("_more"),
            F.expr(geo.span_sql("_k.p.", "_l.p.")).alias("_span"),
            F.expr(geo.box_span_sql("_k.cell", fine, "_l.cell", fine)).alias("_wide"),
            F.col("_k.p.leaf").alias("_pa"), F.col("_l.p.leaf").alias("_pb")))
        best = full.groupBy(*on).agg(F.max(F.struct("_span", "_pa", "_pb")).alias("_far"))
        if far is not None:
            best = far.unionByName(best).groupBy(*on).agg(F.max("_far").alias("_far"))
        far = cut_lineage(best)
        alive = (full.filter("_more").select(*on, "_a", "_b", "_wide").join(far.select(*on, F.col("_far._span").alias("_best")), on)
                 .filter(F.col("_wide") >= F.col("_best") - TOLERANCE).drop("_wide"))
        if alive.isEmpty():
            break
    km = geo.haversine_km("_far._pa.latitude", "_far._pa.longitude", "_far._pb.latitude", "_far._pb.longitude")
    return far.select(*on, km.alias("diameter_km"))
