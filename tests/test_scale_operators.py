"""The operators that replace a collect or a cross join, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import km
from panelcast.operators import spatial as sp
from panelcast.operators.quantiles import exact_quantiles
from panelcast.session import cut_lineage, shared_dir


def points(spark, lat, lon, **extra):
    rows = [(i, float(a), float(b), *[v[i] for v in extra.values()]) for i, (a, b) in enumerate(zip(lat, lon))]
    columns = "id long, latitude double, longitude double" + "".join(f", {k} {t}" for k, t in
                                                                     zip(extra, ["string"] * len(extra)))
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("values", [
    np.random.default_rng(1).lognormal(0, 3, 4000),
    np.r_[np.zeros(3000), np.random.default_rng(2).normal(0, 1, 900)],  # one hot value
    1e6 + np.random.default_rng(3).random(3000) * 1e-3,                  # all in a narrow band
    np.array([5.0]),
])
@pytest.mark.parametrize("part", [1 << 20, 20])
def test_exact_quantiles(spark, values, part):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    # Group 0 holds most rows
    rows = [(int(i % 7 == 0), float(v)) for i, v in enumerate(values)] + [(2, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs, part).collect()}
    for g in (0, 1):
        mine = values[[i for i in range(len(values)) if int(i % 7 == 0) == g]]
        if len(mine):
            want = np.quantile(mine, list(probs.values()))
            assert np.allclose([got[g][k] for k in probs], want, rtol=1e-12)
    assert 2 not in got
    # A missing key is a group like any other
    unknown = df.withColumn("g", F.when(F.col("g") == 1, F.col("g")))
    some = {r.g: r for r in exact_quantiles(unknown, ["g"], "v", probs, part).collect()}
    others = values[[i for i in range(len(values)) if i % 7]]
    if len(others):
        assert np.allclose([some[None][k] for k in probs], np.quantile(others, list(probs.values())), rtol=1e-12)
    whole = exact_quantiles(df, [], "v", probs, part).first()
    assert np.allclose([whole[k] for k in probs], np.quantile(values, list(probs.values())), rtol=1e-12)


def sphere(n, seed):
    rng = np.random.default_rng(seed)
    return np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)


@pytest.mark.parametrize("spread", ["sphere", "poles", "date_line", "cluster"])
def test_nearest_fill(spark, spread):
    rng = np.random.default_rng(4)
    lat, lon = {"sphere": sphere(300, 5), "poles": (rng.uniform(88, 90, 300), rng.uniform(-180, 180, 300)),
                "date_line": (rng.uniform(-2, 2, 300), np.where(rng.random(300) < .5, -180, 178) + rng.random(300) * 2),
                "cluster": (40 + rng.integers(0, 8, 300) * 1e-4, -3 + rng.integers(0, 8, 300) * 1e-4)}[spread]
    missing = rng.random(300) < 0.4
    value = [None if m else f"v{i}" for i, m in enumerate(missing)]
    got = {r.id: r for r in sp.fill_from_nearest(points(spark, lat, lon, v=value), "v").collect()}
    known = np.flatnonzero(~missing)
    for i in range(300):
        if missing[i]:
            d = np.round(km(lat[i], lon[i], lat[known], lon[known]), 6)
            assert got[i].v == f"v{known[np.argmin(d)]}" and got[i].v_imputed
        else:
            assert got[i].v == value[i] and not got[i].v_imputed


@pytest.mark.parametrize("radius", [5.0, 400.0, 9000.0, 25000.0])
def test_pairs_within(spark, radius):
    lat, lon = sphere(120, 6)
    df = points(spark, lat, lon)
    got = {(r.l_id, r.r_id): r.km for r in sp.pairs_within(df, df, radius).collect()}
    d = km(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    want = {(i, j) for i in range(120) for j in range(120) if d[i, j] <= radius}
    edge = {(i, j) for i in range(120) for j in range(120) if abs(d[i, j] - radius) < 1e-6}
    assert set(got) - edge == want - edge


def test_pairs_with_own_reach(spark):
    lat, lon = sphere(80, 7)
    df = points(spark, lat, lon)
    got = {(r.l_id, r.r_id) for r in sp.pairs_within(df, df, F.col("id") * 60.0).collect()}
    d = km(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    assert got == {(i, j) for i in range(80) for j in range(80) if d[i, j] <= i * 60.0}


def test_pairs_of_one_cube_are_dealt(spark):
    """Points in one cube are no single key, and distances are those of all pairs."""
    lat, lon = 40 + np.arange(60) * 1e-3, -3 + np.arange(60) % 7 * 1e-3
    df = points(spark, lat, lon)
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sp.pairs_within(df, df, 3.0).select("l_id", "r_id", "km", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    d = km(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    assert {(r.l_id, r.r_id) for r in got} == {(i, j) for i in range(60) for j in range(60) if d[i, j] <= 3.0}
    assert all(abs(r.km - d[r.l_id, r.r_id]) < 1e-9 for r in got)
    assert len({r.task for r in got}) > 1


def test_pairs_send_few_bytes(spark, monkeypatch):
    """Rows went to all 27 cubes around theirs, occupied or not, with seven derived numbers and a cube of three."""
    lat, lon = 40 + np.arange(50) * 1e-3, -3 + np.arange(50) % 7 * 1e-3
    df, sent, dealt = points(spark, lat, lon), [], type(spark.range(1)).repartition

    def counted(self, *a):
        sent.append((self.columns, self.count()))
        return dealt(self, *a)

    monkeypatch.setattr(type(df), "repartition", counted)
    got = {(r.l_id, r.r_id) for r in sp.pairs_within(df, df, 250.0).collect()}
    assert got == {(i, j) for i in range(50) for j in range(50)}
    (left, n), (right, m) = sent
    assert left == ["_cell", "l_id", "l_latitude", "l_longitude"] and right == ["_cell", "r_id", "r_latitude", "r_longitude"]
    assert n == 50 and m == 50 * sp.DEALS


@pytest.mark.parametrize("radius", [-1.0, 0.0, 0.002, 1.0, 250.0])
def test_pairs_of_near_points_and_groups(spark, radius):
    """Points that repeat or are metres apart, at the date line and a pole, some without a place; two groups."""
    rng = np.random.default_rng(17)
    lat = np.r_[np.round(rng.uniform(10, 10.0001, 30), 6), rng.uniform(89.99, 90, 15), rng.uniform(-1, 1, 15)]
    lon = np.r_[np.round(rng.uniform(20, 20.0001, 30), 6), rng.uniform(-180, 180, 15), np.where(rng.random(15) < .5, -179.9, 179.9)]
    lat[:4], lon[:4] = 10, 20
    df = points(spark, lat, lon, g=[f"g{i % 2}" for i in range(60)])
    lost = spark.createDataFrame([(99, None, 1.0, "g0"), (98, 1.0, None, "g1")], df.schema)
    all_ = df.unionByName(lost)
    got = sp.pairs_within(all_, all_.drop("g").withColumn("g", F.col("id") % 2).selectExpr(
        "id", "latitude", "longitude", "concat('g', g) AS g"), radius, ["g"]).select("g", "l_id", "r_id", "km").collect()
    d = km(lat[:, None], lon[:, None], lat[None, :], lon[None, :])
    want = {(i, j) for i in range(60) for j in range(60) if d[i, j] <= radius and i % 2 == j % 2}
    edge = {(i, j) for i in range(60) for j in range(60) if abs(d[i, j] - radius) < 1e-6}
    assert len(got) == len({(r.l_id, r.r_id) for r in got})
    assert {(r.l_id, r.r_id) for r in got} - edge == want - edge
    assert all(abs(r.km - d[r.l_id, r.r_id]) < 1e-6 for r in got)


@pytest.mark.parametrize("n,gap", [(2000, 10.0), (300, 0.0)])
def test_nearest_in_a_far_cluster(spark, monkeypatch, n, gap):
    """Targets beside a dense cluster of candidates meet its near edge, not all of it."""
    rng = np.random.default_rng(12)
    lat, lon = np.r_[rng.normal(46, .5, n), rng.normal(46 - gap, .5, n)], rng.normal(2, .5, 2 * n)
    value = [None] * n + [f"v{i}" for i in range(n)]
    met, cut = [], sp.cut_lineage

    def counted(df):
        out = cut(df)
        if "_open" in out.columns:
            met.append(out.selectExpr("sum(size(_open))").first()[0])
        return out

    monkeypatch.setattr(sp, "cut_lineage", counted)
    df = points(spark, lat, lon, v=value)
    got = {r.latitude: r.value for r in sp.nearest(df.filter("v IS NULL"), df.filter("v IS NOT NULL"), "v").collect()}
    for i in range(n):
        assert got[lat[i]] == f"v{np.argmin(np.round(km(lat[i], lon[i], lat[n:], lon[n:]), 6))}"
    assert sum(met) < 50 * n


def farthest(lat, lon):
    if len(lat) < 1000:
        return km(lat[:, None], lon[:, None], lat[None, :], lon[None, :]).max()
    x = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)),
                  np.sin(np.radians(lat))], axis=1)
    low = [(x[i:i + 1000] @ x.T) for i in range(0, len(x), 1000)]
    at = [np.unravel_index(np.argmin(m), m.shape) for m in low]
    return max(km(lat[i * 1000 + a], lon[i * 1000 + a], lat[b], lon[b]) for i, (a, b) in enumerate(at))


def test_diameter(spark):
    lat, lon = sphere(60, 8)
    rng = np.random.default_rng(9)
    groups = {"a": (lat, lon), "b": (40 + rng.random(60), rng.random(60)), "one": (np.array([5.0]), np.array([6.0])),
              "same": (np.full(9, 1.5), np.full(9, 2.5)), "close": (1 + rng.random(200) * 1e-7, np.zeros(200)),
              "circle": (np.zeros(720), np.arange(720) / 2 - 180), "globe": sphere(20_000, 13)}
    df = points(spark, *(np.concatenate([g[i] for g in groups.values()]) for i in (0, 1)),
                region=[name for name, g in groups.items() for _ in g[0]])
    got = {r.region: r.diameter_km for r in sp.diameter_km(df, ["region"]).collect()}
    for region, (a, b) in groups.items():
        assert got[region] == pytest.approx(farthest(a, b), abs=2e-6), region


def test_within_radius(spark):
    lat, lon = sphere(400, 11)
    got = {r.id for r in sp.within_radius(points(spark, lat, lon), 41.0, 179.0, 3000.0).collect()}
    assert got == set(np.flatnonzero(km(41.0, 179.0, lat, lon) <= 3000.0))


def test_lineage_is_cut_by_a_reliable_checkpoint(spark):
    df = cut_lineage(spark.range(10).selectExpr("id * 2 AS v"))
    assert df.count() == 10 and shared_dir(spark)
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_weekly_rows_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    """Compressed bytes, by which adaptive execution sizes tasks, would put them all into one."""
    from panelcast import session
    from panelcast.queries import fixtures as fx

    monkeypatch.setattr(session, "ROWS_OF_TASK", 500)
    spark.range(12_000).selectExpr(
        "id % 60 AS l_suppkey", "date_add(DATE '2020-01-06', CAST(id DIV 60 * 7 AS INT)) AS l_shipdate",
        "CAST(id % 11 AS DOUBLE) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    for made in (fx.panel(spark, str(tmp_path)), fx.stored_panel(spark, str(tmp_path))[0]):
        assert made.count() == 12_000
        assert made.rdd.getNumPartitions() == 24
        # An entity stays in one task
        assert made.select("id", F.spark_partition_id().alias("p")).distinct().count() == 60
