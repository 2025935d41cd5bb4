"""Encoders, scaling, stacking and tree models."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.ml import regression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructField, StructType

from panelcast import config
from panelcast.operators.features import by_date
from panelcast.session import cut_lineage, spread


#: Fits that are sent to the cluster side by side, and rows of a task of one
AT_ONCE = 8
ROWS_OF_TASK = 200_000


def side_by_side(df: DataFrame, work: Callable, items: Iterable) -> list:
    """Results of a few independent Spark programs, in order. A fit is a chain of small jobs, and one chain alone leaves
    most of a cluster idle between them."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), list(items), chunksize=1)


def packed(df: DataFrame) -> DataFrame:
    """Stored rows in as many tasks as their number asks for: every level of a tree is a job over all of them."""
    stored = cut_lineage(df)
    return stored.repartition(max(1, -(-stored.count() // ROWS_OF_TASK)))


def mean_encoding(train: DataFrame, category: str, target: str) -> DataFrame:
    """Mean target per category of the train rows."""
    return train.filter(F.col(category).isNotNull()).groupBy(category).agg(F.avg(target).alias(f"{category}_encoded"))


def smoothed_encoding(train: DataFrame, category: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """Category mean pulled towards the overall mean where the category is rare."""
    overall = train.agg(F.avg(target)).scalar()
    weight = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_n") - smoothing)))
    per = train.filter(F.col(category).isNotNull()).groupBy(category).agg(F.avg(target).alias("_mean"),
                                                                         F.count(target).alias("_n"))
    return per.select(category, (overall * (F.lit(1.0) - weight) + F.col("_mean") * weight).alias(f"{category}_encoded"))


def encode(df: DataFrame, table: DataFrame, category: str, default: Column | None = None) -> DataFrame:
    """Attach an encoding fitted elsewhere; unseen categories get the default, or stay null."""
    out = df.join(table, category, "left")
    name = f"{category}_encoded"
    return out.withColumn(name, F.coalesce(name, default)) if default is not None else out


def min_max_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns scaled to [0, 1] of the train range; a constant column becomes 0."""
    ends = train.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    names = ends.columns
    row = ends.select(F.struct(*names)).scalar()
    scaled = {}
    for c in columns:
        low, high = row[f"{c}_lo"], row[f"{c}_hi"]
        scaled[c] = F.coalesce((F.col(c) - low) / F.nullif(high - low, F.lit(0.0)), F.col(c) - low)
    return df.withColumns(scaled)


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def chronological_split(df: DataFrame, share: float = 0.9, key: str = "id", order: str = "date") -> DataFrame:
    """Mark the earliest share of each series as train, the rest as validation."""
    whole = Window.partitionBy(key)
    rank, size = F.row_number().over(whole.orderBy(order)), F.count(F.lit(1)).over(whole)
    return df.withColumn("part", F.when(rank <= F.floor(size * share), "train").otherwise("validation"))


def _determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    total = None
    for j, head in enumerate(m[0]):
        minor = [[v for k, v in enumerate(row) if k != j] for row in m[1:]]
        term = head * _determinant(minor)
        total = term if total is None else (total + term if j % 2 == 0 else total - term)
    return total


def fit_stack(train: DataFrame, keys: Sequence[str], target: str, inputs: Sequence[str],
              alpha: float = 0.0) -> DataFrame:
    """Linear (``alpha`` 0) or ridge combination of a few predictions, one per key, from centred sums alone.

    ``keys, intercept, w_<input>``. The sums are ordinary aggregates with partial results per task, so a key may
    have any number of rows. A singular system gives nulls.
    """
    rows = complete_cases(train, [target, *inputs])
    n = len(inputs)
    sums = [F.count(F.lit(1)).cast("double").alias("_n"), F.avg(target).alias("_my")]
    sums += [F.avg(x).alias(f"_m{i}") for i, x in enumerate(inputs)]
    sums += [F.covar_pop(x, target).alias(f"_b{i}") for i, x in enumerate(inputs)]
    sums += [F.covar_pop(inputs[i], inputs[j]).alias(f"_a{i}{j}") for i in range(n) for j in range(i, n)]
    s = rows.groupBy(*keys).agg(*sums)
    a = [[F.col(f"_a{min(i, j)}{max(i, j)}") * F.col("_n") + (alpha if i == j else 0.0) for j in range(n)]
         for i in range(n)]
    b = [F.col(f"_b{i}") * F.col("_n") for i in range(n)]
    s = s.withColumn("_det", F.nullif(_determinant(a), F.lit(0.0)))
    weights = {}
    for k, x in enumerate(inputs):
        swapped = [[b[i] if j == k else a[i][j] for j in range(n)] for i in range(n)]
        weights[f"w_{x}"] = _determinant(swapped) / F.col("_det")
    s = s.withColumns(weights)
    explained = sum((F.col(f"w_{x}") * F.col(f"_m{i}") for i, x in enumerate(inputs)), F.lit(0.0))
    return s.select(*keys, (F.col("_my") - explained).alias("intercept"), *weights)


def apply_stack(df: DataFrame, weights: DataFrame, keys: Sequence[str], inputs: Sequence[str],
                label: str = "prediction") -> DataFrame:
    value = sum((F.col(f"w_{x}") * F.col(x) for x in inputs), F.col("intercept"))
    return df.join(weights, list(keys)).withColumn(label, value).drop("intercept", *[f"w_{x}" for x in inputs])


def horizon_rows(panel: DataFrame, capacity: DataFrame, horizon: int, step: int) -> DataFrame:
    """Direct multi-step rows: each week with the value a horizon ahead, one season before that, and the calendar.

    Values are fractions of capacity, so that entities of all sizes can share one model. The arrays come from the
    entity's own window, so no self-join is needed.
    """
    season = config.SEASONAL_LAG
    ahead = by_date().rowsBetween(1, horizon)
    behind = by_date().rowsBetween(-season, 0)
    arrays = (levels(panel, capacity).select("id", "date", "level", F.collect_list("level").over(ahead).alias("_ahead"),
                           F.collect_list("level").over(behind).alias("_behind"))
              .filter(F.size("_behind") == season + 1))
    return _steps_ahead(arrays, horizon, step, F.get("_ahead", F.col("h") - 1).alias("target"))


def levels(panel: DataFrame, capacity: DataFrame) -> DataFrame:
    # A row an entity: a merge join would sort all weeks by the entity alone, before the window sorts them again
    joined = panel.join(capacity.filter("capacity > 0").select("id", "capacity").hint("shuffle_hash"), "id")
    return joined.withColumn("level", F.col("storage") / F.col("capacity"))


def _steps_ahead(arrays: DataFrame, horizon: int, step: int, *more: Column) -> DataFrame:
    season = config.SEASONAL_LAG
    # Beyond a season ahead, the seasonal value is that of the same week in the season last observed
    steps = arrays.withColumn("h", F.explode(F.sequence(F.lit(step), F.lit(horizon), F.lit(step))))
    return steps.select(
        "id", "date", "level", "h", F.get("_behind", F.lit(0)).alias("level_year_ago"),
        F.get("_behind", F.pmod(F.col("h") - 1, F.lit(season)) + 1).alias("seasonal"),
        F.weekofyear(F.date_add("date", F.col("h") * 7)).cast("double").alias("week"), *more)


#: Weeks of whole series that are packed into one row
WEEKS_AT_ONCE = 50_000


def stored_series(panel: DataFrame, capacity: DataFrame) -> DataFrame:
    """Levels as ``horizon_rows`` takes them, some series to a row, stored once.

    ``level``, ``known``, ``day`` and ``first`` are arrays as bytes: the weeks of all series in order, and where each
    begins. ``ends`` has the last week of each series that a whole season lies behind: ``id, date, _behind``.
    """
    season = config.SEASONAL_LAG

    def one_row(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        level = table.column("level").combine_chunks()
        known = level.is_valid().to_numpy(zero_copy_only=False)
        level = level.fill_null(0.0).to_numpy()
        day = table.column("date").combine_chunks().cast(pa.int32()).fill_null(NO_DAY).to_numpy()
        first = np.flatnonzero(table.column("_n").to_numpy() == 1)
        base, series = _bases(known, first)
        if len(base) and (np.isnan(level[known]).any() or (day[base] == NO_DAY).any()):
            raise ValueError("a week has no date, or its level is no number")
        last = np.full(len(first), NO_DAY, np.int32)
        np.maximum.at(last, series, day[base])
        end = base[day[base] == last[series]]
        behind = pa.array(level[end[:, None] + np.arange(-season, 1)].ravel())
        ends = pa.StructArray.from_arrays([
            table.column("id").combine_chunks().take(pa.array(end)), table.column("date").combine_chunks().take(pa.array(end)),
            pa.ListArray.from_arrays(pa.array(np.arange(len(end) + 1) * (season + 1), pa.int32()), behind)], ["id", "date", "_behind"])
        return pa.RecordBatch.from_arrays([
            *[pa.array([x.tobytes()], pa.binary()) for x in (level, known, day, first)],
            pa.ListArray.from_arrays(pa.array([0, len(end)], pa.int32()), ends)], ["level", "known", "day", "first", "ends"])

    def packed_rows(stream):
        held, count = [], 0
        for batch in stream:
            held.append(batch)
            count += batch.num_rows
            if count < WEEKS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(table.column("_n").to_numpy() == 1)[-1])
            if cut:
                yield one_row(table.slice(0, cut))
                held, count = table.slice(cut).to_batches(), count - cut
        if count:
            yield one_row(pa.Table.from_batches(held))

    fields = panel.select("id", "date").schema.fields
    end = StructType([*fields, StructField("_behind", ArrayType(DoubleType()))])
    schema = StructType([*[StructField(c, BinaryType()) for c in ("level", "known", "day", "first")], StructField("ends", ArrayType(end))])
    # The window puts the weeks of a series side by side and in order, and numbers them
    rows = levels(panel, capacity).select("id", "date", F.col("level").cast("double").alias("level"),
                                          F.row_number().over(by_date()).alias("_n"))
    return cut_lineage(rows.mapInArrow(packed_rows, schema))


NO_DAY = -(1 << 31)


def _bases(known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weeks that a whole season of known ones lies behind, and the number of the series of each."""
    season, begins = config.SEASONAL_LAG, np.zeros(len(known), np.int64)
    begins[first[1:]] = 1
    series = begins.cumsum()
    upto = np.append(0, known.cumsum())
    at = np.arange(len(known))
    base = np.flatnonzero((at - first[series] >= season) & (upto[at + 1] - upto[np.maximum(at - season, 0)] == season + 1))
    return base, series[base]


class _Series:
    """One row of ``stored_series``: what ``horizon_rows`` says of it, as places in its arrays."""

    def __init__(self, row: dict):
        self.level, known, self.day, first = (np.frombuffer(row[c], kind) for c, kind in (
            ("level", float), ("known", bool), ("day", np.int32), ("first", np.int64)))
        self.base, series = _bases(known, first)
        self.places, self.rank = np.flatnonzero(known), known.cumsum()[self.base]
        self.last = np.append(first[1:], len(known))[series] - 1
        self.lowest = int(self.day[self.base].min()) if len(self.base) else 0

    def steps(self, horizon: int, step: int):
        """For each horizon: it, the weeks that have a target, their seasonal values, targets and weeks of the year."""
        season = config.SEASONAL_LAG
        if not len(self.base):
            return
        weeks = iso_week(np.arange(self.lowest, int(self.day[self.base].max()) + 7 * horizon + 1))
        limit = np.minimum(self.base + horizon, self.last)
        for h in range(step, horizon + 1, step):
            number = self.rank + h - 1
            ahead = self.places[np.minimum(number, len(self.places) - 1)]
            there = (number < len(self.places)) & (ahead <= limit)
            at = self.base[there]
            yield h, at, at - season + (h - 1) % season + 1, ahead[there], weeks[self.day[at] + (7 * h - self.lowest)]


def iso_week(day: np.ndarray) -> np.ndarray:
    """Week of the year of days since 1970, that of the week's Thursday."""
    thursday = day - (day + 3) % 7 + 3
    new_year = thursday.astype("M8[D]").astype("M8[Y]").astype("M8[D]").astype(np.int64)
    return (thursday - new_year) // 7 + 1


def _series_of(stream):
    for batch in stream:
        for row in batch.to_pylist():
            yield _Series(row)


BOOST_INPUTS = ("level", "seasonal", "h", "week")
#: Bins of one input, Spark's own number for trees
BINS = 32


def quantile_bins(df: DataFrame, inputs: Sequence[str]) -> Bucketizer | None:
    """Bins of about equally many rows per input, told by all rows; an input of few values has a bin for each.

    The binned inputs are named ``<input>_bin``; None where there are no rows.
    """
    fine = [i / 1000 for i in range(1001)]
    found = df.agg(*[F.percentile_approx(c, F.array(*map(F.lit, fine)), 10_000).alias(c) for c in inputs]).first()
    return _bins_between({c: found[c] for c in inputs})


def _bins_between(found: dict[str, list[float] | None]) -> Bucketizer | None:
    """Bins told by 1,001 quantiles of each input."""
    if any(values is None for values in found.values()):
        return None
    inputs, splits = list(found), []
    for c in inputs:
        values = sorted(set(found[c]))
        if len(values) > BINS:
            values = sorted({found[c][0], *(found[c][round(1000 * i / BINS)] for i in range(1, BINS))})
        splits.append([-float("inf"), *(values[1:] or values), float("inf")])
    return Bucketizer(splitsArray=splits, inputCols=list(inputs), outputCols=[f"{c}_bin" for c in inputs])


def binned_means(df: DataFrame, bins: Bucketizer, target: str) -> DataFrame:
    """One row per occupied combination of bins, with its number of ``rows`` and their mean target.

    A tree sees of its inputs the bins only, and the gain of a split does not depend on how targets vary inside a
    combination. So trees fitted to these weighted rows are those of all rows, and their number has a bound of its own.
    """
    return bins.transform(df).groupBy(*bins.getOutputCols()).agg(
        F.count(F.lit(1)).cast("double").alias("rows"), F.avg(target).alias(target))


#: Weighted values that stand for all of an input, and summaries that are put together at a time
SUMMARY, SUMMARIES_AT_ONCE = 20_000, 32


def _summary(value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their weight; of many, as many of equal weight as ``SUMMARY`` says. No rank moves by more
    than half of such a weight."""
    value, number = np.unique(value, return_inverse=True)
    weight = np.bincount(number, weight, len(value))
    if len(value) <= SUMMARY:
        return value, weight
    upto = weight.cumsum()
    share = upto[-1] / SUMMARY
    some = np.searchsorted(upto, (np.arange(SUMMARY) + 0.5) * share)
    # The least value stays itself
    return np.append(value[0], value[some]), np.append(share * 1e-9, np.full(SUMMARY, share))


def _added_up(found: list[dict[str, bytes]]) -> dict[str, bytes]:
    out = {}
    for c in BOOST_INPUTS:
        value, weight = (np.concatenate([np.frombuffer(x[f"{c}_{part}"], float) for x in found]) for part in ("value", "weight"))
        out[f"{c}_value"], out[f"{c}_weight"] = (x.tobytes() for x in _summary(value, weight))
    return out


def series_bins(series: DataFrame, horizon: int, step: int) -> Bucketizer | None:
    """``quantile_bins`` of the rows of ``horizon_rows`` that have a target, from ``stored_series``.

    A week is one level of many rows and the seasonal value of many others, so it is counted instead of repeated. Tasks
    send summaries, of which a few are put together at a time.
    """
    names = [f"{c}_{part}" for c in BOOST_INPUTS for part in ("value", "weight")]
    schema = ", ".join(f"{name} binary" for name in names)

    def counted(stream):
        found = []
        for own in _series_of(stream):
            level, seasonal, weeks, hs = np.zeros(len(own.level)), np.zeros(len(own.level)), np.zeros(54), np.zeros(horizon + 1)
            for h, at, before, _, week in own.steps(horizon, step):
                level[at] += 1
                seasonal[before] += 1
                weeks += np.bincount(week, minlength=54)
                hs[h] += len(at)
            row = {}
            for c, value, weight in (("level", own.level, level), ("seasonal", own.level, seasonal),
                                     ("h", np.arange(horizon + 1.0), hs), ("week", np.arange(54.0), weeks)):
                row[f"{c}_value"], row[f"{c}_weight"] = value[weight > 0].tobytes(), weight[weight > 0].tobytes()
            found.append(row)
            if len(found) == SUMMARIES_AT_ONCE:
                found = [_added_up(found)]
        if found:
            yield pa.RecordBatch.from_pylist([_added_up(found)], pa.schema([(name, pa.binary()) for name in names]))

    def together(stream):
        found = []
        for batch in stream:
            for row in batch.to_pylist():
                found.append(row)
                if len(found) == SUMMARIES_AT_ONCE:
                    found = [_added_up(found)]
        if found:
            yield pa.RecordBatch.from_pylist([_added_up(found)], pa.schema([(name, pa.binary()) for name in names]))

    tasks, summaries = series.rdd.getNumPartitions(), series.drop("ends").mapInArrow(counted, schema)
    while tasks > SUMMARIES_AT_ONCE:
        tasks = -(-tasks // SUMMARIES_AT_ONCE)
        summaries = summaries.repartition(tasks).mapInArrow(together, schema)
    found = [r.asDict() for r in summaries.collect()]
    whole = _added_up(found) if found else {}
    if not whole or not whole["level_value"]:
        return None
    quantiles = {}
    for c in BOOST_INPUTS:
        value, upto = np.frombuffer(whole[f"{c}_value"], float), np.frombuffer(whole[f"{c}_weight"], float).cumsum()
        ranks = np.ceil(np.arange(1001) / 1000 * upto[-1] - 1e-6)
        quantiles[c] = value[np.minimum(np.searchsorted(upto, np.maximum(ranks, 0.5) - 1e-6), len(value) - 1)].tolist()
    return _bins_between(quantiles)


def series_means(series: DataFrame, bins: Bucketizer, horizon: int, step: int) -> DataFrame:
    """``binned_means`` of the rows of ``horizon_rows`` that have a target, from ``stored_series``.

    A task adds up all its rows in arrays with a place for each combination of bins, so no row of a horizon is made.
    """
    inner = {c: np.array(splits[1:-1]) for c, splits in zip(bins.getInputCols(), bins.getSplitsArray())}
    n = [len(inner[c]) + 1 for c in BOOST_INPUTS]

    def added(stream):
        # By horizon first: its weeks have one bin there
        rows, total = np.zeros((n[2], n[0] * n[1] * n[3])), np.zeros((n[2], n[0] * n[1] * n[3]))
        week_bin = np.searchsorted(inner["week"], np.arange(54.0), "right")
        for own in _series_of(stream):
            high = np.searchsorted(inner["level"], own.level, "right") * (n[1] * n[3])
            middle = np.searchsorted(inner["seasonal"], own.level, "right") * n[3]
            for h, at, before, ahead, week in own.steps(horizon, step):
                cell = high[at] + middle[before] + week_bin[week]
                slot = np.searchsorted(inner["h"], float(h), "right")
                rows[slot] += np.bincount(cell, minlength=rows.shape[1])
                total[slot] += np.bincount(cell, own.level[ahead], rows.shape[1])
        some = np.flatnonzero(rows.ravel())
        for i in range(0, len(some), 1 << 16):
            own = some[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(rows.ravel()[own]), pa.array(total.ravel()[own])],
                                             ["cell", "rows", "total"])

    tasks = min(series.rdd.getNumPartitions(), 2 * series.sparkSession.sparkContext.defaultParallelism)
    sums = (series.drop("ends").coalesce(max(1, tasks)).mapInArrow(added, "cell long, rows double, total double")
            .groupBy("cell").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")))
    parts = {"h": (n[0] * n[1] * n[3], n[2]), "level": (n[1] * n[3], n[0]), "seasonal": (n[3], n[1]), "week": (1, n[3])}
    return sums.select(*[F.expr(f"CAST(cell DIV {parts[c][0]} % {parts[c][1]} AS DOUBLE)").alias(f"{c}_bin") for c in BOOST_INPUTS],
                       "rows", (F.col("total") / F.col("rows")).alias("target"))


def boosted(panel: DataFrame, capacity: DataFrame, horizon: int = config.HORIZON, trees: int = 100, depth: int = 6,
            rate: float = 0.1, step: int = 1, clip: bool = True) -> DataFrame:
    """Boosted trees over all entities with the horizon as an input, forecasting from each entity's last week.

    The last week is shifted to last year's level before prediction and the shift is taken off afterwards. Training
    uses every week at every horizon; a ``step`` above 1 trains on each such horizon only. ``clip`` keeps predictions at
    or below capacity. An entity that cannot be forecast gives one row with an ``error`` and no prediction. The trees are
    fitted to means of the rows per combination of bins (``binned_means``), of which there are at most 32 to the power of the inputs.
    """
    season = config.SEASONAL_LAG
    series = stored_series(panel, capacity)
    asked = series.select(F.inline("ends")).withColumn("level", F.get("_behind", F.lit(season)))
    ask = _steps_ahead(asked, horizon, 1, F.col("date").alias("_end")).withColumn("shift", F.col("level_year_ago") - F.col("level"))
    ends = panel.groupBy("id").agg(F.count("storage").alias("_n"), F.max("date").alias("date"))
    known = ends.join(capacity.select("id", "capacity"), "id", "left")
    why = (F.when(~F.coalesce(F.col("capacity") > 0, F.lit(False)), "capacity is missing or zero")
           .when(F.col("_n") <= config.SEASONAL_LAG, f"more than {config.SEASONAL_LAG} observations are needed")
           .otherwise("the last season has a gap"))
    failed = known.join(asked.select("id", "date").distinct(), ["id", "date"], "left_anti").select(
        "id", F.lit(None).cast("int").alias("h"), F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("double").alias("prediction"), F.lit("boosted").alias("model"), why.alias("error"))
    bins = series_bins(series, horizon, step)
    if bins is None:
        return failed
    vector = VectorAssembler(inputCols=bins.getOutputCols(), outputCol="features")
    cells = cut_lineage(vector.transform(series_means(series, bins, horizon, step)).select("features", "target", "rows"))
    # With the square of the bins as its limit, Spark looks for splits in all combinations, not in a sample of them
    model = GBTRegressor(labelCol="target", weightCol="rows", maxIter=trees, maxDepth=depth, stepSize=rate, seed=27,
                         maxBins=BINS * BINS, checkpointInterval=10).fit(spread(cells, cells.count()))
    shifted = ask.withColumns({"level": F.col("level") + F.col("shift"), "seasonal": F.col("seasonal") + F.col("shift"),
                               "_h": F.col("h"), "h": F.col("h").cast("double")})
    made = model.transform(vector.transform(bins.transform(shifted))).join(capacity.select("id", "capacity"), "id")
    value = (F.col("prediction") - F.col("shift")) * F.col("capacity")
    done = made.select("id", F.col("_h").alias("h"), F.date_add("_end", F.col("_h") * 7).alias("date"),
                       (F.least(value, F.col("capacity")) if clip else value).alias("prediction"), F.lit("boosted").alias("model"),
                       F.lit(None).cast("string").alias("error"))
    return done.unionByName(failed)


def boosted_series(series: DataFrame, horizon: int = config.HORIZON, keys: Sequence[str] = ("id",), **settings) -> DataFrame:
    """``boosted`` as a forecaster of series: levels are taken relative to the largest value of each.

    One model is shared by the entities. Series that differ in other keys, as the origins of a backtest, overlap in time,
    so each value of these keys has a model of its own that sees nothing of the others.
    """
    others = [k for k in keys if k != "id"]
    parts = []
    for group in (series.select(*others).distinct().collect() if others else [None]):
        own = series if group is None else series.filter(reduce(and_, (F.col(k) == group[k] for k in others)))
        peak = own.groupBy("id").agg(F.max("storage").alias("capacity"))
        made = boosted(own.select("id", "date", "storage"), peak, horizon, clip=False, **settings)
        parts.append(made.select("id", *[F.lit(group[k]).cast(series.schema[k].dataType).alias(k) for k in others],
                                 "h", "date", "prediction", "error"))
    if not parts:
        return series.select(*keys, F.lit(0).alias("h"), "date", F.lit(0.0).alias("prediction"), F.lit("").alias("error"))
    return reduce(DataFrame.unionByName, parts).select(*keys, "h", "date", "prediction", "error")


def linear_series(series: DataFrame, horizon: int = config.HORIZON, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Direct linear forecast of each series: the value a horizon ahead from the last value, the value one season before
    the wanted week, and how far ahead it is. Weights come from sums over all weeks and horizons of the series."""
    keys = list(keys)
    whole = F.struct(*keys).alias("id")
    panel = series.filter(F.col("storage").isNotNull()).select(whole, "date", F.col("storage").cast("double").alias("storage"))
    one = panel.select("id", F.lit(1.0).alias("capacity")).distinct()
    rows = horizon_rows(panel, one, horizon, 1).withColumn("ahead", F.col("h").cast("double"))
    inputs = ["level", "seasonal", "ahead"] if horizon > 1 else ["level", "seasonal"]
    weights = fit_stack(rows, ["id"], "target", inputs)
    ends = panel.groupBy("id").agg(F.max("date").alias("_end"))
    ask = rows.join(ends, "id").filter(F.col("date") == F.col("_end"))
    made = apply_stack(ask, weights, ["id"], inputs).filter(F.col("prediction").isNotNull())
    done = made.select("id.*", "h", F.date_add("_end", F.col("h") * config.GRID_DAYS).alias("date"), "prediction",
                       F.lit(None).cast("string").alias("error"))
    failed = series.select(whole).distinct().join(made.select("id").distinct(), "id", "left_anti").select(
        "id.*", F.lit(None).cast("int").alias("h"), F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("double").alias("prediction"), F.lit("too short or too even a series for a linear fit").alias("error"))
    return done.unionByName(failed)


def stack_blocks(blocks: DataFrame, models: Sequence[str], alpha: float = 0.0, label: str = "stacked") -> DataFrame:
    """Level two on out-of-fold predictions: ``id, origin, h, date, actual, model, prediction``.

    ``blocks`` holds the models' predictions of blocks they were not trained on. The weights for a block are fitted on
    the entity's predictions dated before the block begins, so the years expand and nothing leaks. The first block of an
    entity has nothing before it and is not predicted, nor is one whose earlier predictions leave the weights open.
    """
    named = [F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(m) for m in models]
    wide = blocks.groupBy("id", "origin", "h", "date").agg(F.max("actual").alias("actual"), *named)
    begins = wide.groupBy("id", "origin").agg(F.min("date").alias("_from")).withColumnRenamed("origin", "_for")
    # An entity has a few blocks, one a year at most
    train = wide.join(begins, "id").filter(F.col("date") < F.col("_from"))
    weights = fit_stack(train, ["id", "_for"], "actual", models, alpha)
    made = apply_stack(wide.withColumn("_for", F.col("origin")), weights, ["id", "_for"], models)
    return (made.filter(F.col("prediction").isNotNull())
            .select("id", "origin", "h", "date", "actual", F.lit(label).alias("model"), "prediction"))


def assign_folds(df: DataFrame, key: str, folds: int, seed: int = 27) -> DataFrame:
    """Repeatable shuffled folds from a hash of the key."""
    return df.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int"))


def split_inputs(per_split: str, n: int) -> int:
    """How many of n inputs a split may choose from, by Spark's names."""
    named = {"all": n, "auto": math.ceil(n / 3), "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)),
             "log2": max(1, math.ceil(math.log2(n)))}
    return named[per_split] if per_split in named else max(1, min(n, int(per_split)))


#: Nodes of a level whose sums are held at a time, nodes of a part when there are more, and rows summed at a time
NODES_AT_ONCE, NODES_OF_PART, ROWS_AT_ONCE = 4096, 256, 1 << 18


def tree_means(bins: np.ndarray, weight: np.ndarray, total: np.ndarray, asked: np.ndarray, depth: int, choice: int,
               random: np.random.Generator) -> np.ndarray:
    """Mean target that one regression tree gives to each asked combination of bins.

    The tree is grown on combinations with their weight and summed target, all nodes of a level at a time, by the
    largest fall of the squared error over ``choice`` inputs. Nodes that no asked combination reaches are left alone.
    When a level has many nodes, parts of them are grown to their end one after the other, so the sums held do not
    grow with the tree.
    """
    out = np.zeros(len(asked))
    waiting = [(0, bins, weight, total, np.zeros(len(bins), np.int32), np.arange(len(asked), dtype=np.int32), asked,
                np.zeros(len(asked), np.int32))]
    del bins, weight, total, asked
    while waiting:
        waiting.extend(_grown(out, waiting.pop(), depth, choice, random))
    return out


def _grown(out: np.ndarray, part: tuple, depth: int, choice: int, random: np.random.Generator) -> list[tuple]:
    """Grow nodes level by level and write the means of their leaves to ``out``; the parts left when there are many nodes."""
    start, bins, weight, total, node, ask, asked, place = part
    del part
    for level in range(start, depth + 1):
        if not len(place):
            return []
        k = int(place.max()) + 1
        if k > NODES_AT_ONCE:
            return _parted(level, bins, weight, total, node, ask, asked, place)
        blocks = [slice(i, i + ROWS_AT_ONCE) for i in range(0, len(bins), ROWS_AT_ONCE)]
        whole = sum(np.bincount(node[b], weight[b], k) for b in blocks)
        sums = sum(np.bincount(node[b], total[b], k) for b in blocks)
        gain, by, cut = 1e-9 * (1 + sums ** 2 / whole), np.full(k, -1, np.int8), np.zeros(k, np.uint8)
        drawn = np.argsort(np.argsort(random.random((k, bins.shape[1])), 1), 1) < choice
        for f in range(bins.shape[1]) if level < depth else ():
            width = int(bins[:, f].max()) + 1
            w, s = np.zeros(k * width), np.zeros(k * width)
            for b in blocks:
                at = node[b].astype(np.int64) * width + bins[b, f]
                w += np.bincount(at, weight[b], k * width)
                s += np.bincount(at, total[b], k * width)
            w, s = (x.reshape(k, width).cumsum(1)[:, :-1] for x in (w, s))
            other, rest = whole[:, None] - w, sums[:, None] - s
            ok = (w > 0.5) & (other > 0.5) & drawn[:, f, None] if choice < bins.shape[1] else (w > 0.5) & (other > 0.5)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                fall = np.where(ok, s * s / w + rest * rest / other, -np.inf)
            best = fall.argmax(1)
            value = fall[np.arange(k), best] - sums ** 2 / whole
            better = value > gain
            gain[better], by[better], cut[better] = value[better], f, best[better]
        ends = by[place] < 0
        out[ask[ends]] = (sums / whole)[place[ends]]
        ask, asked, place = ask[~ends], asked[~ends], place[~ends]
        place = 2 * place + (asked[np.arange(len(asked)), by[place]] > cut[place])
        # Nodes reached are numbered anew; of the others, and of leaves, nothing is kept
        number = np.full(2 * k, -1, np.int32)
        number[place] = 0
        reached = number == 0
        number[reached] = np.arange(reached.sum())
        for b in blocks:
            own = node[b]
            split = by[own]
            side = bins[b][np.arange(len(own)), split] > cut[own]
            node[b] = np.where(split < 0, -1, number[2 * own + side])
        place, kept = number[place], node >= 0
        bins, weight, total, node = bins[kept], weight[kept], total[kept], node[kept]
    return []


def _parted(level: int, bins: np.ndarray, weight: np.ndarray, total: np.ndarray, node: np.ndarray, ask: np.ndarray,
            asked: np.ndarray, place: np.ndarray) -> list[tuple]:
    """The nodes of a level in parts, last first, each with rows and asked combinations of its own."""
    order = np.argsort(node // NODES_OF_PART, kind="stable")
    bins, weight, total, node = bins[order], weight[order], total[order], node[order]
    order = np.argsort(place // NODES_OF_PART, kind="stable")
    ask, asked, place = ask[order], asked[order], place[order]
    firsts = np.arange(0, int(place[-1] // NODES_OF_PART + 1) * NODES_OF_PART, NODES_OF_PART)
    rows = np.append(np.searchsorted(node // NODES_OF_PART, firsts // NODES_OF_PART), len(node))
    asks = np.append(np.searchsorted(place // NODES_OF_PART, firsts // NODES_OF_PART), len(place))
    return [(level, bins[r], weight[r], total[r], node[r] - first, ask[a], asked[a], place[a] - first)
            for first, r, a in reversed([(firsts[i], slice(rows[i], rows[i + 1]), slice(asks[i], asks[i + 1]))
                                         for i in range(len(firsts))])]


def _distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a byte matrix, in order, and the number of each row among them."""
    n = bins.shape[1]
    bits = max(1, int(bins.max()).bit_length()) if len(bins) else 1
    if bits * n > 64:
        whole = np.ascontiguousarray(bins).view(np.dtype((np.void, n))).ravel()
        values, number = np.unique(whole, return_inverse=True)
        return values.view(np.uint8).reshape(-1, n), number.astype(np.int32)
    code = np.zeros(len(bins), np.uint32 if bits * n <= 32 else np.uint64)
    for i in range(n):
        code <<= code.dtype.type(bits)
        code |= bins[:, i]
    values, number = np.unique(code), np.empty(len(code), np.int32)
    for i in range(0, len(code), ROWS_AT_ONCE):
        number[i:i + ROWS_AT_ONCE] = np.searchsorted(values, code[i:i + ROWS_AT_ONCE])
    last = values.dtype.type((1 << bits) - 1)
    return np.stack([(values >> values.dtype.type(bits * (n - 1 - i)) & last).astype(np.uint8) for i in range(n)], 1), number


#: Tasks for each core that grow the trees of a forest, and predictions added up at a time
TASKS_OF_CORE = 4
ASKED_AT_ONCE = 1 << 16


def forest_means(rows: DataFrame, inputs: Sequence[str], target: str, trees: int, depth: int, per_split: str = "auto",
                 seed: int = 27) -> DataFrame:
    """``fold, <inputs>, prediction``: a random forest per fold, at the combinations of bins of its held-out rows.

    ``rows`` have ``fold``, ``held``, inputs that are bins, and the target. A task grows some of the trees of a fold, one
    after the other, from the train rows of the fold as a byte a bin and a number. They are sent once per task, not
    once per tree: how often a tree takes a row is drawn again where the tree grows, from the state that the
    generator of the row's task had. A tree sees the bins only, so it is grown on sums per combination of bins. Trees never leave
    their tasks; of their predictions, the sums over a task's trees are sent.
    """
    n = len(inputs)
    folds = (rows.agg(F.max("fold")).first()[0] or 0) + 1
    groups = max(1, min(trees, -(-TASKS_OF_CORE * rows.sparkSession.sparkContext.defaultParallelism // folds)))
    firsts = [trees * g // groups for g in range(groups + 1)]

    def dealt(stream):
        tables = list(stream)
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        bins = np.stack([table.column(c).to_numpy().astype(np.uint8) for c in inputs], 1)
        fold, held, y = (table.column(c).to_numpy() for c in ("fold", "held", target))
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for own in np.unique(fold).tolist():
            train, test = (fold == own) & ~held, (fold == own) & held
            states = []
            for tree in range(trees):
                if tree in firsts:
                    states.append(pickle.dumps(random.bit_generator.state))
                random.poisson(1.0, int(train.sum()))
            yield pa.RecordBatch.from_arrays([
                pa.array([own], pa.int32()), pa.array([states], pa.list_(pa.binary())), *[
                    pa.array([x.tobytes()], pa.binary()) for x in (bins[train], y[train], _distinct(bins[test])[0])]],
                names=["fold", "states", "bins", "target", "asked"])

    def grown(stream):
        parts, first, generators = {"bins": [], "target": [], "asked": []}, None, []
        for batch in stream:
            for i in range(batch.num_rows):
                first = first or (batch.column("fold")[i].as_py(), batch.column("group")[i].as_py())
                generators.append(np.random.Generator(np.random.PCG64()))
                generators[-1].bit_generator.state = pickle.loads(batch.column("state")[i].as_py())
                for name, kind in (("bins", np.uint8), ("target", float), ("asked", np.uint8)):
                    parts[name].append(np.frombuffer(batch.column(name)[i].as_buffer(), kind))
        if first is None:
            return
        fold, group = first
        ends = np.cumsum([len(x) for x in parts["target"]])
        # What was received is let go before the trees are grown
        bins, asked, y = (np.concatenate(parts.pop(name)) for name in ("bins", "asked", "target"))
        del batch
        cells, number = _distinct(bins.reshape(-1, n))
        del bins
        asked = _distinct(asked.reshape(-1, n))[0]
        added, made = np.zeros(len(asked)), 0
        for tree in range(firsts[group], firsts[group + 1]):
            weight, total = np.zeros(len(cells), np.float32), np.zeros(len(cells))
            for end, size, random in zip(ends, np.diff(ends, prepend=0), generators):
                times, own = random.poisson(1.0, size), slice(end - size, end)
                np.add.at(weight, number[own], times.astype(np.float32))
                np.add.at(total, number[own], times * y[own])
            some = weight > 0
            weight, total = weight[some], total[some]
            if len(asked) and len(weight):
                added += tree_means(cells[some], weight, total, asked, depth, split_inputs(per_split, n),
                                    np.random.default_rng([seed, fold, tree]))
                made += 1
        for block, i in enumerate(range(0, len(asked) if made else 0, ASKED_AT_ONCE)):
            some = slice(i, i + ASKED_AT_ONCE)
            yield pa.RecordBatch.from_arrays([
                pa.array([fold], pa.int32()), pa.array([block], pa.int32()), pa.array([made], pa.int32()), *[
                    pa.array([x], pa.binary()) for x in (asked[some].tobytes(), added[some].tobytes())]],
                names=["fold", "block", "trees", "asked", "added"])

    def averaged(table: pa.Table) -> pa.Table:
        asked = np.frombuffer(table.column("asked")[0].as_buffer(), np.uint8).reshape(-1, n)
        added = sum(np.frombuffer(x.as_buffer(), float) for x in table.column("added"))
        return pa.table({"fold": pa.array(np.full(len(asked), table.column("fold")[0].as_py()), pa.int32()),
                         **{c: pa.array(asked[:, i], pa.int32()) for i, c in enumerate(inputs)},
                         "prediction": added / sum(table.column("trees").to_pylist())})

    sent = rows.select("fold", "held", *inputs, target).mapInArrow(
        dealt, "fold int, states array<binary>, bins binary, target binary, asked binary")
    sent = sent.select("fold", F.posexplode("states").alias("group", "state"), "bins", "target", "asked")
    # A task for each group of trees: dealt by hash, some tasks would have several and others none
    own = sent.repartitionById(folds * groups, (F.col("fold") * groups + F.col("group")).cast("int"))
    made = own.mapInArrow(grown, "fold int, block int, trees int, asked binary, added binary")
    fields = "".join(f"{c} int, " for c in inputs)
    return made.groupBy("fold", "block").applyInArrow(averaged, f"fold int, {fields}prediction double")


class RandomForestRegressor(regression.RandomForestRegressor):
    """A forest of Spark's parameters whose nodes are split inside tasks.

    Spark's own sends sums of each node, input and bin across the cluster for every level and keeps all trees on the
    driver; trees grown in full have a node for almost every row. ``fit`` takes the rows of ``forest_means`` and returns
    its predictions; every column that is none of ``fold``, ``held`` and the label is an input.
    """

    def fit(self, dataset: DataFrame, params: dict | None = None) -> DataFrame:
        asked = self.copy(params) if params else self
        label = asked.getLabelCol()
        return forest_means(dataset, [c for c in dataset.columns if c not in ("fold", "held", label)], label, asked.getNumTrees(),
                            asked.getMaxDepth(), asked.getFeatureSubsetStrategy(), asked.getSeed())


def cross_validate(df: DataFrame, target: str, inputs: Sequence[str], categories: Sequence[str] = (), folds: int = 10,
                   key: str = "id", smoothing: float | None = None, trees: int = 100, depth: int = 5,
                   per_split: str = "auto") -> DataFrame:
    """Random-forest cross-validation: RMSE, MAE and R² averaged over the folds.

    Encoders and bins are fitted on the train side of each fold; ``per_split`` says how many inputs a split may choose
    from, in Spark's terms. Folds, a fixed small number, are prepared side by side; the trees of all are grown together.
    """
    needed = complete_cases(df, [target, *inputs])
    rows = packed(assign_folds(needed, key, folds).select(key, "fold", F.col(target).cast("double").alias(target), *inputs,
                                                          *categories))
    names = [*inputs, *[f"{c}_encoded" for c in categories]]
    numbered = [f"in{i}" for i in range(len(names))]

    def binned(fold: int) -> DataFrame:
        train, test = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        overall = train.agg(F.avg(target)).scalar()
        for c in categories:
            table = (mean_encoding(train, c, target) if smoothing is None
                     else smoothed_encoding(train, c, target, smoothing))
            train, test = encode(train, table, c, overall), encode(test, table, c, overall)
        bins = quantile_bins(train, names)
        if bins is None:
            raise ValueError("a fold has no rows to train on")
        both = train.withColumn("held", F.lit(False)).unionByName(test.withColumn("held", F.lit(True)))
        return bins.transform(both).select(F.lit(fold).alias("fold"), "held", F.col(target).alias("actual"), *[
            F.col(f"{c}_bin").cast("int").alias(i) for c, i in zip(names, numbered)])

    ready = cut_lineage(reduce(DataFrame.unionByName, side_by_side(df, binned, range(folds))))
    forest = RandomForestRegressor(labelCol="actual", numTrees=trees, maxDepth=depth, seed=27, featureSubsetStrategy=per_split)
    scored = ready.filter("held").join(forest.fit(spread(ready, ready.count())), ["fold", *numbered])
    e = F.col("actual") - F.col("prediction")
    per_fold = scored.groupBy("fold").agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.sum(e * e) / F.nullif(F.var_pop("actual") * F.count("actual"), F.lit(0.0))).alias("r2"))
    return per_fold.agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"))


def forward_selection(df: DataFrame, target: str, inputs: Sequence[str], keep: int | None = None, folds: int = 3,
                      key: str = "id", trees: int = 100, depth: int = 5, per_split: str = "auto") -> list[tuple[str, float]]:
    """Add, one at a time, the input that lowers the cross-validated RMSE most; half of the inputs by default.

    Returns the inputs in the order chosen with the RMSE reached. The search is over columns, not rows; the tries of a
    step are independent and run side by side.
    """
    keep = keep or max(1, len(inputs) // 2)
    rows = cut_lineage(complete_cases(df, [target, *inputs]).select(key, target, *inputs))
    chosen: list[tuple[str, float]] = []
    while len(chosen) < keep:
        taken = [name for name, _ in chosen]

        def scored(name: str) -> tuple[float, str]:
            made = cross_validate(rows, target, [*taken, name], folds=folds, key=key, trees=trees, depth=depth, per_split=per_split)
            return made.first()["rmse"], name

        best, name = min(side_by_side(rows, scored, [name for name in inputs if name not in taken]))
        chosen.append((name, best))
    return chosen
