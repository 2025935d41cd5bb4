"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest hashes of a text's 5-word shingles. Sketches of parts merge to the sketch of the whole;
from two of them follow the resemblance and the containment of the sets, from one the number of distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import BLOCK_BYTES, U, buffers, keyed, restore
from panelcast.llm.minhash import shingles

#: Hashes in a sketch, and bytes kept of each
K, WIDTH = 128, 5
SCALE = 2.0 ** (8 * WIDTH)


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes, by their leading bytes."""
    return np.unique(hashes[:2 * k] >> U(64 - 8 * WIDTH))[:k]


def to_text(values: np.ndarray) -> str:
    return base64.b64encode(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH:].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - WIDTH:] = raw
    return out.view(">u8").ravel().astype(U)


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """Sketch of the union of the parts' shingle sets."""
    return np.unique(np.concatenate([np.zeros(0, U), *sketches]))[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * SCALE / max(float(a[k - 1]), 1.0)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity, from the k smallest hashes of the union. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty set is contained in every set."""
    if not len(a):
        return 1.0
    j = resemblance(a, b, k)
    return min(1.0, j * (distinct(a, k) + distinct(b, k)) / ((1 + j) * distinct(a, k)))


def sketches_of(texts: list[str], k: int = K) -> list[np.ndarray]:
    out = []
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_BYTES // 2 or i + 1 == len(texts):
            out += [sketch(s, k) for s in shingles(*buffers(pa.array(texts[first:i + 1], pa.large_string())))]
            first, size = i + 1, 0
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` (estimated) of each whole text. Null and empty texts have an empty sketch."""
    def run(stream):
        for rows in stream:
            own = sketches_of(rows.column("_text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([to_text(s) for s in own], pa.string()),
                                              pa.array([distinct(s, k) for s in own], pa.float64())],
                                             names=["doc_id", "fingerprint", "n_shingles"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("_text"))
            .mapInArrow(run, "doc_id long, fingerprint string, n_shingles double"))


def merge_by(parts: DataFrame, group: str, k: int = K) -> DataFrame:
    """``group, fingerprint, n_shingles``: the merged sketch of each group's parts.

    Each task first merges what it holds of a group, so one row per group and task is exchanged.
    """
    def local(stream):
        found: dict = {}
        for rows in stream:
            for g, f in zip(rows.column(group).to_pylist(), rows.column("fingerprint").to_pylist()):
                found[g] = merge([found.get(g, np.zeros(0, U)), from_text(f or "")], k)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array([to_text(x) for x in found.values()],
                                                                                 pa.string())],
                                         names=[group, "fingerprint"])

    def whole(table):
        all_ = merge([from_text(f) for f in table.column("fingerprint").to_pylist()], k)
        return pa.table({group: table.column(group)[:1], "fingerprint": [to_text(all_)], "n_shingles": [distinct(all_, k)]})

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(parts.schema[group].dataType)
    name = f"`{group}` {parts.schema[group].dataType.simpleString()}"
    sent = parts.select(group, "fingerprint").mapInArrow(local, f"{name}, fingerprint string")
    return sent.groupBy(group).applyInArrow(whole, f"{name}, fingerprint string, n_shingles double")


SCHEMA = ("key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_shingles double, contained double")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprint every text, its edited text and their likeness to it and to the next text.

    The next text is that of the next smaller id; after the smallest comes the largest. The edited text has its last
    third (rounded down, in code points) replaced by as many, or all, code points from the start of the next one.
    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles,
    contained`` (share of the text's shingles that the edited one keeps). Null texts are empty; texts without words have
    an empty fingerprint, which is like another empty one (1) and unlike any other (0). Rows that repeat an id or have
    none come in the order (id, text), nulls first.

    Rows are dealt once by ranges of the id and sorted there; the largest id of a range is copied to the range above,
    whose smallest id needs it. The borders come from quantiles, as many as there are shuffle partitions.
    """
    rows, own_ids = keyed(docs, key, text)
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / parts for i in range(1, parts)]
    borders = sorted({int(b) for b in rows.approxQuantile("key", shares, 0.25 / parts)}) if shares else []
    edges = np.array(borders, np.int64)

    def ranged(stream):
        for batch in stream:
            at = np.searchsorted(edges, batch.column("key").to_numpy(), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("key")], names=["part", "key"])

    # One row per range: the largest id of each goes to the next range that has rows, the very largest to the lowest
    tops = sorted((r["part"], r["top"]) for r in rows.select("key").mapInArrow(ranged, "part int, key long")
                  .groupBy("part").agg(F.max("key").alias("top")).collect())
    guests = {top: tops[(i + 1) % len(tops)][0] for i, (_, top) in enumerate(tops)}

    def deal(stream):
        for batch in stream:
            keys = batch.column("key").to_numpy()
            part = np.searchsorted(edges, keys, side="left").astype(np.int32)
            extra = [(i, guests[x]) for i, x in enumerate(keys.tolist()) if x in guests]
            yield _with(batch, part, False)
            if extra:
                at = pa.array([i for i, _ in extra])
                yield _with(batch.take(at), np.array([p for _, p in extra], np.int32), True)

    def compared(stream):
        pending, rest = None, []
        for batch in stream:
            columns = (batch.column(c).to_pylist() for c in ("part", "guest", "key", "text"))
            for part, guest, doc, body in zip(*columns):
                if pending is not None:
                    rest.append((*pending, body))
                pending = None if guest else (doc, body)
                if len(rest) >= 256 or sum(len(x[1]) for x in rest[-1:]) > BLOCK_BYTES:
                    yield _compare(rest, k)
                    rest = []
        if rest:
            yield _compare(rest, k)

    dealt = rows.select("key", "text").mapInArrow(deal, "part int, guest boolean, key long, text string")
    lined = dealt.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("key"))
    return restore(rows, own_ids, lined.mapInArrow(compared, SCHEMA))


def _with(batch, part, guest):
    flags = pa.array(np.full(batch.num_rows, guest))
    return pa.RecordBatch.from_arrays([pa.array(part), flags, batch.column("key"), batch.column("text")],
                                      names=["part", "guest", "key", "text"])


def _compare(rows: list[tuple[int, str, str]], k: int) -> pa.RecordBatch:
    edited = []
    for _, body, after in rows:
        cut = len(body) // 3
        edited.append(body[:len(body) - cut] + after[:cut])
    # Neighbours follow each other, so most next texts are the following row's own
    own = sketches_of([body for _, body, _ in rows], k)
    following = {i: own[i + 1] for i in range(len(rows) - 1) if rows[i][2] == rows[i + 1][1]}
    alone = [i for i in range(len(rows)) if i not in following]
    following.update(zip(alone, sketches_of([rows[i][2] for i in alone], k)))
    changed = sketches_of(edited, k)
    columns = [[key for key, _, _ in rows], [len(body) for _, body, _ in rows],
               [hashlib.sha256(e.encode()).hexdigest() for e in edited], [to_text(s) for s in own],
               [to_text(s) for s in changed], [resemblance(a, b, k) for a, b in zip(own, changed)],
               [resemblance(a, following[i], k) for i, a in enumerate(own)], [distinct(a, k) for a in own],
               [containment(a, b, k) for a, b in zip(own, changed)]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                      names=[c.split()[0] for c in SCHEMA.split(", ")])
