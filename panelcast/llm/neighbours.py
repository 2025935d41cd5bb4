"""Nearest neighbours by a block matrix join: int8 product tiles bound every inner product, floats decide.

Vectors are cut into slabs of bounded size. Every query slab meets every candidate slab in one task, a tile. There both
sides are rounded to int8 codes with one scale per vector, ``x = s * code + rest``. The product of the codes gives
``x * y`` up to ``|s * code(x)| * |rest(y)| + |rest(x)| * |y|``, so a pair whose upper bound stays below what the query
already holds is done with. The others are recomputed from the original numbers, and each query keeps its best ``k``
of a tile in a bounded heap; the heaps of all tiles are merged by Spark, which again keeps only ``k`` rows per query and task.

Equal vectors are one class with its smallest ids, so a vector that a third of all rows share is compared once and
its ties still come out by id. Results are exact: recall is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.llm.common import materialise

#: Bytes of vectors in a slab; a tile holds two slabs
SLAB_BYTES = 4 << 20
#: Queries and candidates whose products are in memory together, and surviving pairs recomputed together
QUERIES, CANDIDATES, PAIRS = 512, 4096, 1 << 16
#: Products of int8 codes are whole numbers; float32 adds this many of them without rounding
EXACT_DIMS = (1 << 24) // (127 * 127)
#: Rounding of the bounds themselves, relative to both norms and absolute
SLACK, TINY = 2e-6, 1e-30

SLAB = "kind int, slab int, dim int, ids binary, sizes binary, vectors binary"
HIT = "rep long, vec_id long, score double"


def search(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for every row that ``is_query`` marks.

    Nearest first, ties to the smaller id; the score is the inner product in double precision, added up in order of the
    components. Rows without id and vectors that are null, empty, zero or hold null or non-finite components take no
    part, neither as queries nor as candidates. Vectors of different lengths are never compared. A query never finds its
    own id. Rows that repeat both id and vector count once; an id with several vectors takes part with each of them.
    With fewer candidates than ``k`` all are returned; an empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    kind = "double" if rows.schema[vector].dataType.elementType.typeName() == "double" else "float"
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"),
                         F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable = (usable.filter(F.col("id").isNotNull() & v.isNotNull()).filter(~bad & F.exists(v, lambda x: x != 0))
              .withColumn("h", F.xxhash64("v")))
    # Only the k + 1 smallest ids of a class can be among the k nearest of any query
    once = usable.groupBy("h", "v", "id").agg(F.max("asks").alias("asks"))
    by_id = Window.partitionBy("h", "v").orderBy("id")
    classes = (once.select("h", "v", "id", F.row_number().over(by_id).alias("n")).filter(F.col("n") <= k + 1)
               .groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    classes = materialise(classes.withColumn("rep", F.col("ids")[0]), "classes")
    members = materialise(usable.filter("asks").join(classes, ["h", "v"]).select(F.col("id").alias("query_id"), "h", "rep")
                          .distinct(), "members")
    asking = classes.join(members.select("h", "rep").distinct(), ["h", "rep"], "left_semi")

    width = F.sum(F.size("v")) * (8 if kind == "double" else 4)
    slabs = [max(1, -(-(t.agg(width).first()[0] or 0) // slab_bytes)) for t in (asking, classes)]
    parts = [t.select(F.lit(side).alias("kind"), F.pmod(F.xxhash64("h", "rep"), F.lit(n)).cast("int").alias("slab"),
                      F.size("v").alias("dim"), "h", "ids", "v")
             for side, (t, n) in enumerate(zip((asking, classes), slabs))]
    packed = parts[0].unionByName(parts[1]).groupBy("kind", "slab", "dim").applyInArrow(_pack(kind), SLAB + ", h binary")
    meeting = packed.withColumn("other", F.explode(F.expr(
        f"IF(kind = 0, sequence(0, {slabs[1] - 1}), sequence(0, {slabs[0] - 1}))")))
    meeting = meeting.select("dim", F.expr("IF(kind = 0, slab, other)").alias("q"),
                             F.expr("IF(kind = 0, other, slab)").alias("c"), "kind", "ids", "sizes", "vectors", "h")
    hits = meeting.groupBy("dim", "q", "c").applyInArrow(_tile(kind, k + 1), "h long, " + HIT)

    nearest = Window.partitionBy("h", "rep").orderBy(F.desc("score"), "vec_id")
    merged = (hits.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= k + 1).groupBy("h", "rep")
              .agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("near")))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (members.join(merged, ["h", "rep"]).select("query_id", F.posexplode(others).alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    F.col("hit.score").alias("score")))


def _pack(kind: str):
    """All classes of a slab in one row."""
    dtype = np.float64 if kind == "double" else np.float32

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, vectors = table.column("ids").combine_chunks(), table.column("v").combine_chunks()
        out = [[table.column(c)[0].as_py()] for c in ("kind", "slab", "dim")]
        out += [[ids.flatten().to_numpy().astype(np.int64).tobytes()],
                [np.diff(ids.offsets.to_numpy()).astype(np.int32).tobytes()],
                [vectors.flatten().to_numpy().astype(dtype).tobytes()],
                [table.column("h").to_numpy().astype(np.int64).tobytes()]]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)],
                                    names=["kind", "slab", "dim", "ids", "sizes", "vectors", "h"])

    return pack


class Coded:
    """int8 codes of vectors in units of their largest norm, with what bounds the rounding."""

    def __init__(self, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        peak = np.abs(x).max(axis=1)
        self.norm = peak * np.sqrt(np.square(x / peak[:, None]).sum(axis=1))
        self.unit = float(self.norm.max())
        step = np.maximum(peak / 127, np.finfo(np.float64).tiny)
        self.codes = np.rint(x / step[:, None]).astype(np.int8)
        coded = self.codes * step[:, None]
        self.rest = (np.linalg.norm((x - coded) / self.unit, axis=1)).astype(np.float32)
        self.coded = (np.linalg.norm(coded / self.unit, axis=1)).astype(np.float32)
        self.size = (self.norm / self.unit).astype(np.float32)
        self.step = (step / self.unit).astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, exact: each float32 product sums few enough whole numbers."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    cuts = range(0, a.shape[1], EXACT_DIMS)
    return sum((a[:, i:i + EXACT_DIMS].astype(np.float32) @ b[:, i:i + EXACT_DIMS].astype(np.float32).T)
               .astype(np.float64) for i in cuts)


def bounds(q: Coded, c: Coded, rows: slice, columns: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimated products of a block, in units of both largest norms, and how far they may be off."""
    near = products(q.codes[rows], c.codes[columns]) * q.step[rows, None] * c.step[None, columns]
    off = (q.coded[rows, None] * c.rest[None, columns]
           + (q.rest[rows] + np.float32(SLACK) * q.size[rows])[:, None] * c.size[None, columns] + np.float32(TINY))
    return near, off


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added up component by component."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j].astype(np.float64) * b[:, j]
    return out


class Heaps:
    """The best ``k`` classes of every query by (score, smaller id); ``least`` is what a new one has to reach."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.which = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.least = np.full(n, -np.inf)

    def push(self, query: np.ndarray, which: np.ndarray, score: np.ndarray, smallest: np.ndarray) -> None:
        query, which = np.concatenate([self.query, query]), np.concatenate([self.which, which])
        score = np.concatenate([self.score, score])
        order = np.lexsort((smallest[which], -score, query))
        query = query[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        kept = place < self.k
        order, query = order[kept], query[kept]
        self.query, self.which, self.score = query, which[order], score[order]
        full = place[kept] == self.k - 1
        self.least[query[full]] = self.score[full]


def _tile(kind: str, k: int):
    dtype = np.float64 if kind == "double" else np.float32

    def tile(table: pa.Table) -> pa.Table:
        sides = {r["kind"]: r for r in table.to_pylist()}
        empty = pa.table({"h": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()),
                          "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if len(sides) < 2:
            return empty
        dim = sides[0]["dim"]
        vq, vc = (np.frombuffer(sides[s]["vectors"], dtype).reshape(-1, dim) for s in (0, 1))
        ids = np.frombuffer(sides[1]["ids"], np.int64)
        ends = np.cumsum(np.frombuffer(sides[1]["sizes"], np.int32))
        starts = ends - np.frombuffer(sides[1]["sizes"], np.int32)
        query, which, score = nearest_classes(vq, vc, ids[starts], k)

        # Classes become rows: every id of a class has its score
        n = ends[which] - starts[which]
        at = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query, found, score = np.repeat(query, n), ids[at], np.repeat(score, n)
        order = np.lexsort((found, -score, query))
        query = query[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        order, query = order[kept], query[kept]
        own = np.frombuffer(sides[0]["ids"], np.int64)
        own_ends = np.cumsum(np.frombuffer(sides[0]["sizes"], np.int32))
        reps = own[own_ends - np.frombuffer(sides[0]["sizes"], np.int32)]
        names = np.frombuffer(sides[0]["h"], np.int64)
        return pa.table({"h": names[query], "rep": reps[query], "vec_id": found[order], "score": score[order]})

    return tile


def nearest_classes(vq: np.ndarray, vc: np.ndarray, smallest: np.ndarray, k: int):
    """(query, class, score) of the best ``k`` classes of each query among the candidates of one tile."""
    q, c = Coded(vq), Coded(vc)
    unit = q.unit * c.unit
    heaps = []
    for first in range(0, len(vq), QUERIES):
        rows = slice(first, min(first + QUERIES, len(vq)))
        heap = Heaps(rows.stop - first, k)
        for left in range(0, len(vc), CANDIDATES):
            columns = slice(left, min(left + CANDIDATES, len(vc)))
            near, off = bounds(q, c, rows, columns)
            least = heap.least / unit
            if left == 0 and columns.stop >= k:
                # k candidates are at least this good, whatever their exact products
                least = np.maximum(least, -np.partition(off - near, k - 1, axis=1)[:, k - 1].astype(np.float64))
            least = np.where(np.isfinite(least), least - SLACK * np.abs(least), -np.inf)
            found = np.flatnonzero((near + off).ravel() >= np.repeat(least.astype(np.float32), columns.stop - left))
            for some in range(0, len(found), PAIRS):
                i, j = np.divmod(found[some:some + PAIRS], columns.stop - left)
                heap.push(i, j + left, exact(vq[i + first], vc[j + left]), smallest)
        heaps.append((heap.query + first, heap.which, heap.score))
    return tuple(np.concatenate(x) for x in zip(*heaps))
