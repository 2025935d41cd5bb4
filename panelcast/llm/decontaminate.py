"""Find passages of a benchmark in training texts by spaced seeds.

A seed is a mask over consecutive words: only the words under a 1 are hashed, the others may differ. All seeds of the
benchmark are held sorted; every place of every text is looked up under each mask. A hit fixes how the two texts lie
to each other, and the aligned words around it are compared one by one: some stretch of them must hold enough matching
words, in number and in share. A matching word counts 1 and a differing one -3, so that a stretch scores 0 or more
exactly if it holds the share; the one with the highest score is reported, or, where that has too few words, the one
with the most.

The benchmark is worked off in blocks of a bounded number of seeds, which are small enough to send to every task; each
block meets all texts. A text never leaves its task, so common phrases cause no skew.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import Rolling, U, blocks, buffers, byte_values, mix, return_freed_memory

#: The masks
MASKS = ("111111", "11101011", "110100111", "1011010101", "11001010011")
#: A match needs so many equal words, or this share of a shorter passage's words, and this share of its stretch
MIN_WORDS, MIN_SHARE, MIN_EQUAL = 12, 0.8, 0.75
#: Benchmark words of one block; with five masks about 40 bytes each in every task
BLOCK_WORDS = 400_000
SCHEMA = "doc_id long, item_id long, start long, n_words long, n_equal long, n_hits long"
#: Bytes of a word: letters, digits and all of UTF-8's longer characters
IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, without punctuation, and where each text's words begin."""
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    filled = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][filled]] = IN_WORD[data[offsets[:-1][filled]]]
    last = offsets[1:][filled] - 1
    ends[last] = IN_WORD[data[last]]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Rolling(byte_values(data)).slices(start, end), np.searchsorted(start, offsets)


def seeds(values: np.ndarray, mask: str) -> np.ndarray:
    """Hash under a mask at every place where the mask fits."""
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, len(mask) * 31 + int(mask, 2), U)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * U(0x9E3779B97F4A7C15) + values[i:i + n]
    return mix(out)


#: Score of a differing word: a stretch breaks even at the share of equal words
DIFFERS = -MIN_EQUAL / (1 - MIN_EQUAL)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the highest score; the first and longest of equal ones."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, DIFFERS))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    return int(np.flatnonzero(total[:end + 1] == low[end])[0]), end


def fullest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the stretch with the most equal words of those that hold the share; the first of equal ones."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, DIFFERS))])
    # The earliest start from which the score isn't negative, for each end
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    same = np.concatenate([[0], np.cumsum(equal)])
    end = int(np.argmax(same - same[start]))
    s = int(start[end])
    return s + int(np.argmax(equal[s:end])) if end > s else s, end


class Block:
    """Words and sorted seeds of a part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        column = pc.utf8_lower(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.values, self.bounds = word_values(*buffers(column))
        found = []
        for m, mask in enumerate(MASKS):
            h = seeds(self.values, mask)
            at = np.arange(len(h))
            item = np.searchsorted(self.bounds, at, side="right") - 1
            inside = at + len(mask) <= self.bounds[item + 1] if len(at) else np.zeros(0, bool)
            found.append(np.stack([h[inside], at[inside].astype(U), np.full(int(inside.sum()), m, U)], 1))
        table = np.concatenate(found)
        order = np.argsort(table[:, 0], kind="stable")
        self.hashes, self.at = table[order, 0], table[order, 1].astype(np.int64)
        #: The first bits of each seed, to pass over most places at once
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> U(42)).astype(np.int64)] = True

    def matches(self, values: np.ndarray):
        """(item, start in the text, words, equal words, hits) of the best stretch of each item in one text."""
        hits: dict[tuple[int, int], int] = {}
        for mask in MASKS:
            h = seeds(values, mask)
            at = np.flatnonzero(self.filter[(h >> U(42)).astype(np.int64)])
            lo = np.searchsorted(self.hashes, h[at])
            hi = np.searchsorted(self.hashes, h[at], side="right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for place in self.at[a:b].tolist():
                    item = int(np.searchsorted(self.bounds, place, side="right")) - 1
                    key = item, p - place
                    hits[key] = hits.get(key, 0) + 1
        best: dict[int, tuple] = {}
        for (item, shift), n in hits.items():
            first, last = int(self.bounds[item]), int(self.bounds[item + 1])
            a, b = max(first, -shift), min(last, len(values) - shift)
            equal = self.values[a:b] == values[a + shift:b + shift]
            s, e = best_stretch(equal)
            same = int(equal[s:e].sum())
            need = min(MIN_WORDS, math.ceil(MIN_SHARE * (last - first)))
            if same < need <= int(equal.sum()):
                s, e = fullest_stretch(equal)
                same = int(equal[s:e].sum())
            if same >= need and same >= MIN_EQUAL * (e - s):
                old = best.get(item)
                found = (-same, a + shift + s, e - s, same, n)
                if old is None:
                    best[item] = found
                else:
                    best[item] = (*min(old, found)[:4], old[4] + n)
        return [(self.ids[i], s, w, same, n) for i, (_, s, w, same, n) in best.items()]


def find(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, start, n_words, n_equal, n_hits``: the best match of each benchmark item in each text.

    Words are runs of letters and digits (and characters beyond ASCII), lower-cased. ``start`` counts words. Whole
    texts are searched; null and empty ones match nothing. Items with fewer words than the shortest mask (6) carry no
    seed and can't be found; null ids are kept as null. Repeated rows give repeated results. Up to 4 of 20 words may
    differ as far as some mask finds six equal ones.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = [texts.mapInArrow(_search(block), SCHEMA) for block in _blocks(benchmark, block_words)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` whose text matches no benchmark item; all columns pass through unchanged."""
    for block in _blocks(benchmark, block_words):
        docs = docs.mapInArrow(_without(block, docs.columns.index(text)), docs.schema)
    return docs


def _blocks(benchmark: DataFrame, block_words: int) -> list:
    """The items in blocks of about so many words, each sent to all tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+"))).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / block_words))
    out = []
    for b in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = sorted(((r["item_id"], r["text"]) for r in own.toLocalIterator()), key=str)
        out.append(benchmark.sparkSession.sparkContext.broadcast(rows))
    return out


def _without(block, position):
    def keep(stream):
        return_freed_memory()
        seeds_of = Block(block.value)
        for rows in stream:
            data, offsets = buffers(pc.utf8_lower(rows.column(position)))
            clear = []
            for first, last in blocks(offsets):
                values, bounds = word_values(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                clear += [not seeds_of.matches(values[bounds[i]:bounds[i + 1]]) for i in range(last - first)]
            yield rows.filter(pa.array(clear, pa.bool_()))

    return keep


def _search(block):
    def search(stream):
        return_freed_memory()
        seeds_of = Block(block.value)
        for rows in stream:
            ids = rows.column("doc_id").to_pylist()
            data, offsets = buffers(pc.utf8_lower(rows.column("text")))
            out = []
            for first, last in blocks(offsets):
                values, bounds = word_values(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                for i in range(last - first):
                    out += [(ids[first + i], *m) for m in seeds_of.matches(values[bounds[i]:bounds[i + 1]])]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                             names=["doc_id", "item_id", "start", "n_words", "n_equal", "n_hits"])

    return search
