"""Exact interpolated quantiles for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task. That is fine for a group bounded by the
calendar (one entity's weeks) but not for "all weeks of all entities". Here a group is first reduced to
(value, count) pairs. While some part that may hold a wanted rank has more pairs than one task should sort, a mergeable
sketch cuts each part into bins of about equal size, the counts of the bins say which of them hold a wanted rank, and
only those go on. A round leaves about one pair in 256, so a few rounds do for any size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.session import cut_lineage

#: Pairs that one task may sort
PART = 1 << 20
#: Bins of a round, and the halves by which one is found among them
BINS = 256
HALVES = "128, 64, 32, 16, 8, 4, 2, 1"
SALTS = 16


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                    part: int = PART) -> DataFrame:
    """One row per group with a linearly interpolated quantile per named probability."""
    keys = list(keys)
    pairs = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v"))
             .agg(F.count(F.lit(1)).alias("_n")))
    # Stored once: all rounds read the reduced pairs, never the input again
    pairs = cut_lineage(pairs.withColumns({"_part": F.lit(0).cast("long"), "_start": F.lit(0).cast("long")}))
    totals = pairs.groupBy(*keys).agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_pairs"))
    largest = totals.agg(F.max("_pairs")).first()[0] or 0
    while largest > part:
        pairs = cut_lineage(_narrowed(pairs, keys, totals.drop("_pairs"), probs))
        largest = pairs.groupBy(*keys, "_part").count().agg(F.max("count")).first()[0] or 0
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_start") + F.sum("_n").over(inside) - F.col("_n")
    placed = _with_totals(pairs.withColumn("_first", first), keys, totals.drop("_pairs"))
    picks = []
    for i, (exact, low, high) in enumerate(_ranks(probs)):
        picks += [F.max(F.when(_holds(F.col("_first"), F.col("_n"), low), F.col("_v"))).alias(f"_lo{i}"),
                  F.max(F.when(_holds(F.col("_first"), F.col("_n"), high), F.col("_v"))).alias(f"_hi{i}"),
                  F.max(exact - low).alias(f"_w{i}")]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(name)
        for i, name in enumerate(probs)])


def _ranks(probs: Mapping[str, float]) -> list[tuple[Column, Column, Column]]:
    """Wanted place of each probability among ``_total`` values, and the two ranks around it."""
    places = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs.values()]
    return [(place, F.floor(place), F.ceil(place)) for place in places]


def _holds(start: Column, size: Column, rank: Column) -> Column:
    return (start <= rank) & (rank < start + size)


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Equi-join in which a null key is a group like any other."""
    condition = F.lit(True)
    for k in on:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(right.withColumnsRenamed({k: f"_of_{k}" for k in on}), condition).drop(*[f"_of_{k}" for k in on])


def _with_totals(rows: DataFrame, keys: list[str], totals: DataFrame) -> DataFrame:
    if not keys:
        return rows.withColumn("_total", totals.select("_total").scalar())
    return _joined(rows, totals, keys)


def _narrowed(pairs: DataFrame, keys: list[str], totals: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """One round: the pairs of those bins of each part that hold a wanted rank, as parts of their own."""
    grid = [i / BINS for i in range(1, BINS)]
    cuts = pairs.groupBy(*keys, "_part").agg(F.percentile_approx("_v", grid, 10 * BINS).alias("_cuts"))
    # Salted so that one group's pairs spread over many tasks when the cut table is too big to broadcast
    salted = pairs.withColumn("_s", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    spread = cuts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    located = _joined(salted, spread, [*keys, "_part", "_s"])
    # Bin number = cuts below the value, by bisection: eight comparisons instead of 255
    bisect = F.expr(f"aggregate(array({HALVES}), 0, (i, half) -> i + IF(_cuts[i + half - 1] < _v, half, 0))")
    binned = located.select(*keys, "_part", "_start", "_v", "_n", bisect.alias("_bin"))
    upto = Window.partitionBy(*keys, "_part").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (binned.groupBy(*keys, "_part", "_bin").agg(F.sum("_n").alias("_size"), F.min("_start").alias("_start"))
            .withColumn("_start", F.col("_start") + F.sum("_size").over(upto) - F.col("_size")))
    wanted = F.lit(False)
    for _, low, high in _ranks(probs):
        wanted = wanted | _holds(F.col("_start"), F.col("_size"), low) | _holds(F.col("_start"), F.col("_size"), high)
    bins = _with_totals(bins, keys, totals).filter(wanted).select(*keys, "_part", "_bin", "_start")
    kept = _joined(binned.drop("_start"), bins, [*keys, "_part", "_bin"])
    return kept.select(*keys, "_v", "_n", (F.col("_part") * BINS + F.col("_bin")).alias("_part"), "_start")
