"""Row keys, Arrow access to texts, words and rolling hashes shared by the text operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelcast.session import scratch_path

U = np.uint64
#: Odd multiplier of the rolling hashes
BASE = 0x9E3779B97F4A7C15
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Text is handled in blocks of about so many bytes, which bounds the arrays; a longer text is a block of its own
BLOCK_BYTES = 2 << 20


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: later steps never recompute it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> tuple[DataFrame, bool]:
    """``(key, doc_id, text)`` with a distinct, ordered ``key`` per row, nulls read as empty texts.

    The key is the id itself when ids are distinct. Rows that repeat an id, or have none, are ordered by (id, text)
    with nulls first and numbered in that order, so each row stays a document of its own; equal rows are
    interchangeable, hence the order among them does not matter. The second value says whether the key is the id.
    ``carry`` adds the whole row as a struct ``row``, so that no name of the input can clash with one used here.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *whole)
    extra = ["row"] if carry else []
    # Only the id column is read for this check; one row per id and task is exchanged
    worst = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n").alias("n"), F.max(F.col("doc_id").isNull()).alias("null")).first()
    if worst["n"] is None or (worst["n"] == 1 and not worst["null"]):
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text", *extra), True
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), "text")
    numbered = ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", *extra)
    return materialise(numbered, "keyed"), False


def restore(rows: DataFrame, own_ids: bool, out: DataFrame) -> DataFrame:
    """Put the ids of ``keyed`` rows in the place of their keys."""
    if own_ids:
        return out.withColumnRenamed("key", "doc_id")
    rest = [c for c in out.columns if c != "key"]
    return out.join(rows.select("key", "doc_id"), "key").select("doc_id", *rest)


def pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences; each byte place is stored together, which compresses the high zeros."""
    steps = np.diff(values, prepend=values[:1] * U(0)) if len(values) else values
    return pack_planes(steps)


def pack_planes(values: np.ndarray) -> bytes:
    """Integers with each byte place stored together."""
    return pack(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unpack_planes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(blob), dtype=U)


def return_freed_memory() -> None:
    """Give back what earlier batches of a Python worker have freed.

    Workers are reused from task to task. By default the C library keeps what arrays once took, and Arrow keeps a pool of
    its own, so a worker would stay as large as its largest task. Where the C library has no such call nothing changes.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the n + 1 offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes, one text at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random value per byte, which bytes separate words, and lower case."""
    random = np.random.default_rng(20_24)
    separator = np.zeros(256, bool)
    separator[list(SEPARATORS)] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return random.integers(1, 2 ** 63, 256, dtype=np.uint64), separator, lower


BYTE_VALUES, IS_SEPARATOR, LOWER = _tables()


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 1))
        _POWERS[:] = [_chain(BASE, size), _chain(pow(BASE, -1, 2 ** 64), size)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _chain(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Rolling:
    """Hash of any slice of a sequence of 64-bit values in constant time."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.empty(len(values) + 1, U)
        self.sums[0] = 0
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all slices of one size, by start."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + U(size)) if n > 0 else np.zeros(0, U)


def byte_values(data: np.ndarray) -> np.ndarray:
    return BYTE_VALUES[data]


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a block of texts, and where each text's words begin (n + 1 places)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SEPARATOR[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    at = offsets[:-1][filled]
    begins[at] = solid[at]
    last = offsets[1:][filled] - 1
    ends[last] = solid[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(byte_values(data)).slices(start, end)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of n places covered by windows of one width."""
    if not len(starts):
        return np.zeros(n, bool)
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + width, n), minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())
