"""Quality by compression: a text resembles the class whose dictionary makes it smaller.

Two zstandard dictionaries are built from pieces of well and badly rated texts. A text is compressed with both; the
difference of the sizes, divided by the larger one, is turned into a probability by a logistic curve that also sees how
well the text compresses at all and how long it is (texts of one repeated phrase compress to nothing with either).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelcast.llm import labelled, logistic
from panelcast.llm.common import return_freed_memory

#: Bounds of the learning sample: rows per label, pieces per label, characters of a piece, dictionary bytes
ROWS_PER_LABEL, PIECES, PIECE_CHARS, DICTIONARY = 3000, 2000, 2000, 65536
LEVEL = 3
THRESHOLD = 0.3
FEATURES = 5


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality") -> tuple[bytes, bytes, np.ndarray]:
    """Dictionaries of label 1 and label 0, and the calibration weights, from a bounded sample of labelled rows."""
    chosen, counts = labelled.sample(labels, target, {1: ROWS_PER_LABEL, 0: ROWS_PER_LABEL})
    pieces = F.expr(f"transform(sequence(0, greatest(length(text) - 1, 0) div {PIECE_CHARS}), "
                    f"i -> substring(text, i * {PIECE_CHARS} + 1, {PIECE_CHARS}))")
    cut = labelled.texts_of(docs, chosen, 0).select("label", "doc_id", F.posexplode(pieces).alias("i", "piece"))
    cut = cut.filter("length(piece) >= 8")
    dictionaries = []
    for label in (1, 0):
        own = cut.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id", "i"), "piece").limit(PIECES)
        dictionaries.append(_dictionary([r["piece"].encode() for r in own.select("piece").collect()]))
    good, bad = dictionaries

    def measure(stream):
        measured = _measure(good, bad)
        for rows in stream:
            x = np.array([measured(t) for t in rows.column("text").to_pylist()], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([rows.column("label"), *(pa.array(c) for c in x.T)],
                                             names=["label", *"abcde"])

    schema = "label int, a double, b double, c double, d double, e double"
    found = labelled.texts_of(docs, chosen, 1).select("text", "label").mapInArrow(measure, schema).collect()
    x = np.array([tuple(r)[1:] for r in found], float).reshape(-1, FEATURES)
    y = np.array([r["label"] for r in found], float)
    share = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    return good, bad, logistic.fit(x, y, share)


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train one."""
    try:
        size = min(DICTIONARY, max(1024, sum(map(len, pieces)) // 4))
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:DICTIONARY]


def _measure(good: bytes, bad: bytes):
    """A function from a text to its features."""
    def compressor(content):
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        own = zstandard.ZstdCompressionDict(content)
        own.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)

    one, other = compressor(good), compressor(bad)

    def measured(text: str) -> tuple[float, ...]:
        raw = text.encode()
        a, b = len(one.compress(raw)), len(other.compress(raw))
        difference, ratio, size = (b - a) / max(a, b), min(a, b) / max(len(raw), 16), float(np.log1p(len(raw)))
        return difference, difference * size, ratio, min(ratio, 1.0) ** 2, size

    return measured


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD,
          keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``, and the columns named in ``keep``.

    Learns from ``labels(doc_id, target)`` outside the held-out fold. The score is the probability of label 1 of the
    whole text; a null text counts as empty and gets the score of an empty text. Rows are scored one by one, so
    repeated or missing ids (held_out false) are no matter. Without labelled rows of both kinds every score
    is the share of label 1, 0.5 without any.
    """
    good, bad, weights = learn(docs, labels, target)

    def scored(stream):
        return_freed_memory()
        measured = _measure(good, bad)
        for rows in stream:
            x = np.array([measured(t or "") for t in rows.column("_text").to_pylist()], float).reshape(-1, FEATURES)
            others = [rows.column(i) for i in range(rows.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*others, pa.array(logistic.predict(x, weights))],
                                             names=[*rows.schema.names[:-1], "score"])

    wanted = docs.select(F.col("doc_id"), labelled.held_out().alias("held_out"), *[F.col(c) for c in keep if c != "doc_id"],
                         F.col("text").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return (wanted.mapInArrow(scored, f"{fields}, score double")
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))




def keep_good(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1; all columns pass through unchanged."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return score(rows, labels, target, threshold, keep=("row",)).filter("predicted = 1").select("row.*")
