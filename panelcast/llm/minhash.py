"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact check of the survivors.

1. A text becomes its set of 5-word shingles. Equal sets are one class, represented by its first text.
2. 128 minima in 32 bands of 4 put texts of similarity 0.75 into a common bucket with probability 1 - 5e-6.
3. Within a bucket signatures are compared in batches of minima. After each batch a pair goes on only if the posterior
   probability that its similarity reaches the threshold, given the matches so far and a flat prior, is at least the
   chosen miss probability.
4. The survivors are checked on their full sets.

Only connectivity is asked for, so a bucket first proposes a spanning forest of its best survivors, not all pairs.
After those links are checked and components formed, texts outside the main component of one of their buckets
are compared with all others of that bucket, so that no link between components is lost. Buckets are split into
blocks: no task ever holds a whole hot bucket.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import (Rolling, U, blocks, buffers, fold_case, keyed, materialise, mix, restore,
                                  return_freed_memory, word_hashes, words)
from panelcast.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Minima kept in a signature, one byte each, and compared in batches
MINIMA, BATCH = 192, 32
#: Probability of missing a true link that a comparison may take
MISS = 1e-6
#: Texts of one block of a bucket
BLOCK = 1000
PROFILE = "key long, n long, s1 long, s2 long, signature binary, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block; a text of fewer words is one shingle, none has none."""
    data = fold_case(data)
    start, end, bounds = words(data, offsets)
    rolling = Rolling(word_hashes(data, start, end))
    windows = rolling.windows(SHINGLE)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a:b - SHINGLE + 1]))
        else:
            out.append(rolling.slices(np.array([a]), np.array([b])) if b > a else np.zeros(0, U))
    return out


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(11)
    return random.integers(0, 2 ** 32, MINIMA, dtype=np.uint32) | np.uint32(1), random.integers(0, 2 ** 32, MINIMA,
                                                                                              dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of each non-empty set under ``MINIMA`` hash functions."""
    values = (np.concatenate(sets) >> U(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), MINIMA), np.uint32)
    for j, (a, b) in enumerate(zip(*_multipliers())):
        out[:, j] = np.minimum.reduceat(values * a + b, starts)
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    out = np.empty((len(minima), BANDS), U)
    for band in range(BANDS):
        h = np.full(len(minima), band + 1, U)
        for j in range(band * ROWS, band * ROWS + ROWS):
            h = mix(h + minima[:, j].astype(U))
        out[:, band] = h
    return out


def profiles(rows: DataFrame) -> DataFrame:
    """Set size, set digest, signature and band hashes of each text."""
    def profile(stream):
        return_freed_memory()
        for batch in stream:
            keys = batch.column("key").to_numpy()
            data, offsets = buffers(batch.column("text"))
            for first, last in blocks(offsets):
                sets = shingles(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                n = np.array([len(s) for s in sets])
                digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                                    for s in sets])
                filled = np.flatnonzero(n)
                signature, bands = [b""] * len(sets), [None] * len(sets)
                if len(filled):
                    minima = signatures([sets[i] for i in filled])
                    hashes = _bands(minima).view(np.int64)
                    for row, i in enumerate(filled.tolist()):
                        signature[i], bands[i] = minima[row].astype(np.uint8).tobytes(), hashes[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first:last]), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                     pa.array(signature, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["key", "n", "s1", "s2", "signature", "bands"])

    return rows.select("key", "text").mapInArrow(profile, PROFILE)


def least_matches(threshold: float, miss: float) -> list[int]:
    """For each batch, the fewest matches so far with which a pair still goes on.

    With a flat prior on the similarity, the posterior probability that it is t or more, after m matches in n minima,
    is the probability of at most m successes in n + 1 draws of probability t. A byte matches by chance once in 256.
    """
    t = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, MINIMA + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(signature: np.ndarray, others: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the other signatures are not pruned against one signature, and their matches."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, fewest in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (others[left, part] == signature[part]).sum(1)
        go_on = matches >= fewest
        left, matches = left[go_on], matches[go_on]
        if not len(left):
            break
    return left, matches


def forest(signature: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs of a block, by most matches."""
    n = len(signature)
    near = np.zeros((n, n), np.uint8)
    for i in range(n - 1):
        at, matches = survivors(signature[i], signature[i + 1:], least)
        near[i, i + 1 + at] = matches
        near[i + 1 + at, i] = matches
    best, parent, inside, out = near[0].copy(), np.zeros(n, np.int64), np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        best[inside] = 0
        i = int(np.argmax(best))
        if not best[i]:  # another tree
            i = int(np.argmin(inside))
        else:
            out.append((int(parent[i]), i))
        inside[i] = True
        closer = near[i] > best
        parent[closer] = i
        best = np.maximum(best, near[i])
    return out


def _propose(least):
    """Forest of one block of a bucket."""
    def propose(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        _, first = np.unique(keys, return_index=True)  # the leader may be in its own block twice
        keys = keys[first]
        raw = table.column("signature").combine_chunks().take(pa.array(first)).to_pylist()
        pairs = forest(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, MINIMA), least)
        a = np.array([keys[i] for i, _ in pairs], np.int64)
        b = np.array([keys[j] for _, j in pairs], np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return propose


def _sweep(least, percent):
    """Links between components, of the strays of one block with the members of another.

    A pair that shares several buckets is looked at in the first of them only. A surviving pair is checked on the full
    sets right here, unless links found before have joined its components.
    """
    def sweep(table: pa.Table) -> pa.Table:
        keys, roots = table.column("key").to_numpy(), table.column("root").to_numpy().tolist()
        stray = table.column("stray").to_numpy(zero_copy_only=False)
        outside = table.column("outside").to_numpy(zero_copy_only=False)
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, MINIMA)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        earlier = int(np.argmax(bands[0] == table.column("bucket")[0].as_py()))
        data, offsets = buffers(table.column("text"))
        sets = []
        for first, last in blocks(offsets):
            sets += shingles(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        joined = {r: r for r in roots}

        def find(r):
            while joined[r] != r:
                r = joined[r]
            return r

        members, out = np.flatnonzero(~stray), []
        root_of = np.array(roots)
        for i in np.flatnonzero(stray).tolist():
            # Of two texts outside the main component both look for the other: the smaller one counts
            own = members[(root_of[members] != roots[i]) & (~outside[members] | (keys[members] > keys[i]))]
            own = own[~(bands[own, :earlier] == bands[i, :earlier]).any(1)]
            at, matches = survivors(signature[i], signature[own], least)
            for j in own[at[np.argsort(-matches)]].tolist():
                x, y = sets[i], sets[j]
                a, b = find(roots[i]), find(roots[j])
                if a == b or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    joined[a] = b
                    out.append((int(keys[i]), int(keys[j])))
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(1), "b": pairs.max(1)})

    return sweep


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    def check(stream):
        return_freed_memory()
        for rows in stream:
            sides = []
            for name in ("x", "y"):
                data, offsets = buffers(rows.column(name))
                sets = []
                for first, last in blocks(offsets):
                    sets += shingles(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                sides.append(sets)
            link = []
            for x, y in zip(*sides):
                both = len(np.intersect1d(x, y, assume_unique=True))
                link.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = pa.array(link, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"]).filter(kept)

    x = texts.select(F.col("key").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def links(rows: DataFrame, reps: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Verified links ``a, b`` between representatives that join all that belong together."""
    least, percent = least_matches(threshold, MISS), round(100 * threshold)
    banded = reps.select("key", "signature", F.explode("bands").alias("bucket"))
    shared = (banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("leader"))
              .filter("size > 1").withColumn("n_blocks", F.ceil(F.col("size") / block).cast("int")))
    places = materialise(reps.select("key", F.explode("bands").alias("bucket")).join(shared, "bucket"), "near-places")
    texts = materialise(rows.select("key", "text").join(places.select("key").distinct(), "key", "left_semi"), "near-texts")
    marks = reps.select("key", "signature", "bands").join(places.select("key").distinct(), "key", "left_semi")
    marks = materialise(marks, "near-signatures")
    members = places.withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("n_blocks")).cast("int"))
    # The first text of a bucket takes part in each of its blocks and so ties them together
    leaders = (places.filter("key = leader and n_blocks > 1")
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))))
    blocked = (members.unionByName(leaders).select("key", "bucket", "block")
               .join(marks.select("key", "signature"), "key"))
    pairs = blocked.groupBy("bucket", "block").applyInArrow(_propose(least), "a long, b long").distinct()
    found = materialise(_verify(pairs, texts, percent), "near-links")
    roots = components(found)
    rooted = places.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = materialise(rooted.select("bucket", "key", "root"), "near-roots")
    main = (rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("size"),
                                   F.max("n").alias("most")).filter("most < size"))
    main = (main.withColumn("stray_blocks", F.ceil((F.col("size") - F.col("most")) / block).cast("int"))
            .withColumn("blocks", F.ceil(F.col("size") / block).cast("int")))
    open_ = (rooted.join(main, "bucket").withColumn("outside", F.col("root") != F.col("main"))
             .join(marks, "key").join(texts, "key"))
    spread = F.xxhash64("key", "bucket")
    copies = open_.withColumn("stray", F.lit(False)).withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
    copies = copies.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)))
    strays = open_.filter("outside").withColumn("stray", F.lit(True))
    strays = strays.withColumn("other", F.pmod(spread, F.col("stray_blocks")).cast("int"))
    strays = strays.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["bucket", "block", "other", "key", "root", "stray", "outside", "signature", "bands", "text"]
    swept = (copies.select(columns).unionByName(strays.select(columns)).groupBy("bucket", "block", "other")
             .applyInArrow(_sweep(least, percent), "a long, b long"))
    return found.unionByName(swept)


def dedup(docs: DataFrame, threshold: float = 0.75, key: str = "doc_id", text: str = "text",
          block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: near-duplicate components of whole texts.

    Texts are linked when the Jaccard similarity of their sets of 5-word shingles is at least ``threshold`` (whole
    per cent); words are parted by white space and A-Z are lower-cased. The component is named by its smallest id, and
    that text is kept. A text of fewer than five words is one shingle; null, empty and blank texts have none and stand
    alone. Rows that repeat an id or have none are texts of their own, ordered by (id, text), nulls first; then
    ``component_id`` is the id of the component's first row. Other columns of the input are not read.
    """
    rows, own_ids = keyed(docs, key, text)
    out = _grouped(rows, threshold, block)
    if not own_ids:
        names = rows.select(F.col("key").alias("component_id"), F.col("doc_id").alias("_name"))
        out = out.join(names, "component_id").select("key", "n_shingles", F.col("_name").alias("component_id"), "kept")
    return restore(rows, own_ids, out)


def keep_first(docs: DataFrame, threshold: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component; all columns pass through unchanged."""
    rows, _ = keyed(docs, key, text, carry=True)
    first = _grouped(rows.select("key", "doc_id", "text"), threshold, BLOCK).filter("kept").select("key")
    return rows.select("key", "row").join(first, "key", "left_semi").select("row.*")


def _grouped(rows: DataFrame, threshold: float, block: int) -> DataFrame:
    profiled = materialise(profiles(rows), "near-profiles")
    classes = profiled.filter("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("rep"))
    classes = materialise(classes, "near-classes")
    reps = profiled.join(classes.select(F.col("rep").alias("key")), "key", "left_semi")
    roots = components(links(rows, reps, threshold, block)).select(F.col("node").alias("rep"), "root")
    of_class = classes.join(roots, "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = (profiled.select("key", "n", "s1", "s2").join(of_class, ["s1", "s2"], "left")
           .select("key", F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("component_id"))
           .withColumn("kept", F.col("key") == F.col("component_id")))
    return out
