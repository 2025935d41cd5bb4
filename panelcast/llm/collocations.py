"""Phrases by collocation strength, counted on a weighted de Bruijn graph of words.

Only the longest phrase that starts at each word is counted: four words, an edge from the node of its first three
words to the node of its last three, or fewer where the piece ends. A node's count is the flow out of it, that is
the sum of its edges plus the pieces that end there, so the counts of all shorter phrases follow by summing along
the sorted edges and none of them is ever counted in the texts. A phrase cannot be more frequent than
its rarest word, hence rare words end a run as a piece end does; what the runs lose has no part in a frequent phrase.

A node whose whole flow leaves by one edge is a unary step of a path. It is compacted into that edge: it stays as a
count to look up, but is no phrase of its own, as a longer phrase holds it every time.

Texts are read once and stored as numbers by batch, with the batch's own words. The words of all batches meet by a join
to learn which are frequent; no vocabulary is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelcast.llm.common import fold_case, materialise, pack_planes, unpack_planes
from panelcast.llm.tokens import cuts, encoded, slices, solid_bytes, spans, strings_of

#: Bytes that end a piece, and those that separate its words
PIECE_ENDS = [*b".,;:!?", *range(0x0A, 0x0E)]
BLANKS = [0x20, 0x09]
LONGEST = 4
SOLID_PIECE, SOLID_WORD = solid_bytes(PIECE_ENDS), solid_bytes(PIECE_ENDS + BLANKS)

#: Text of one batch; a longer text is a batch of its own
BATCH_BYTES = 8 << 20
#: Frequent words are numbered within so many groups; phrases are ranked within so many groups first
GROUPS = 256

BATCH = ("batch long, langs array<string>, sizes array<long>, lang_of array<int>, words array<string>, counts array<long>, "
         "codes binary")
ARROW = pa.schema([("batch", pa.int64()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())),
                   ("lang_of", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
                   ("codes", pa.binary())])
FLOW = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64())])


def numbered(batch: int, langs: np.ndarray, names: list[str], data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """A batch of texts as one row: its distinct (language, word) pairs with counts, and its words as numbers.

    Numbers are doubled, and odd where a word begins a piece.
    """
    codes, fresh, lang, words, known = [], [], [], [], 0
    for first, last in cuts(data, offsets, SOLID_PIECE):
        part = fold_case(data[first:last])
        start, end = spans(part, SOLID_WORD, offsets[(offsets > first) & (offsets < last)] - first)
        if not len(start):
            continue
        code, own = encoded(strings_of(part, start, end))
        text = np.searchsorted(offsets, start + first, side="right") - 1
        piece = np.cumsum(~SOLID_PIECE[part])[start]
        fresh.append((np.diff(piece, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        codes.append(code + known)
        lang.append(langs[text])
        words.append(own)
        known += len(own)
    if not words:
        return pa.RecordBatch.from_pylist([], schema=ARROW)
    number, distinct = encoded(pa.concat_arrays(words))
    pairs, at, counts = np.unique(number[np.concatenate(codes)] * len(names) + np.concatenate(lang),
                                  return_inverse=True, return_counts=True)
    spelt = distinct.cast(pa.binary()).cast(pa.string()).take(pa.array(pairs // len(names)))
    sizes = np.bincount(pairs % len(names), weights=counts, minlength=len(names)).astype(np.int64)
    body = pack_planes(at.astype(np.int64) * 2 + np.concatenate(fresh))

    def one(values, kind):
        values = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    columns = [pa.array([batch], pa.int64()), one(names, pa.string()), one(sizes, pa.int64()),
               one(pairs % len(names), pa.int32()), one(spelt, pa.string()), one(counts, pa.int64()),
               pa.array([body], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def _batches(stream):
    number = TaskContext.get().partitionId() << 32
    for rows in stream:
        coded = rows.column("lang").dictionary_encode()
        names = coded.dictionary.to_pylist()
        langs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for first, last, data, offsets in slices(rows, "text", BATCH_BYTES):
            yield numbered(number, langs[first:last], names, data, offsets)
            number += 1


def longest_grams(words: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct longest phrases of two words at least with their counts, four words in two numbers (0: none).

    ``words`` holds 0 for a rare word; ``fresh`` marks the first words of pieces.
    """
    slots = [words]
    for step in range(1, LONGEST):
        after = np.zeros_like(words)
        after[:-step] = words[step:]
        joined = np.zeros(len(words), bool)
        joined[:-step] = ~fresh[step:]
        slots.append(np.where(joined & (slots[-1] != 0), after, 0))
    used = np.flatnonzero(slots[1])
    k1 = (slots[0][used] << 32) | slots[1][used]
    k2 = (slots[2][used] << 32) | slots[3][used]
    left, i = np.unique(k1, return_inverse=True)
    right, j = np.unique(k2, return_inverse=True)
    both, n = np.unique(i * len(right) + j, return_counts=True)
    return left[both // max(len(right), 1)], right[both % max(len(right), 1)], n


def _emit(texts: pa.Table, known: pa.Table) -> pa.Table:
    out = []
    for body in texts.column("codes").to_pylist():
        codes = unpack_planes(body).astype(np.int64)
        number = np.zeros(int(codes.max()) // 2 + 1, np.int64)
        number[known.column("place").to_numpy()] = known.column("word_id").to_numpy()
        out.append(longest_grams(number[codes >> 1], (codes & 1).astype(bool)))
    k1, k2, n = map(np.concatenate, zip(*out)) if out else [np.zeros(0, np.int64)] * 3
    return pa.table([k1, k2, n], schema=FLOW)


def _flows(least: int):
    """Sums along edges sorted by words: phrases of four and three words that are frequent, and shares of word pairs.

    A node of three words lies in one partition, so its count is whole; of a pair, each partition knows a share.
    A negative count marks a unary node.
    """
    def totals(k1, k2, n):
        new = np.ones(len(k1), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        at = np.flatnonzero(new)
        return k1[at], k2[at], np.add.reduceat(n, at) if len(at) else n

    def rows(k1, k2, n):
        k1, k2, n = totals(k1, k2, n)
        frequent = (n >= least) & (k2 & 0xFFFFFFFF != 0)
        node1, node2, flow = totals(k1, k2 & ~np.int64(0xFFFFFFFF), n)
        # A single edge with all the flow of its node
        only = np.zeros(len(flow), bool)
        at = np.searchsorted(np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] >> 32 != k2[:-1] >> 32))),
                             np.flatnonzero(frequent), side="right") - 1
        only[at] = flow[at] == n[frequent]
        third = (flow >= least) & (node2 != 0)
        pair1, _, share = totals(node1, np.zeros_like(node1), flow)
        return [(k1[frequent], k2[frequent], n[frequent]),
                (node1[third], node2[third], np.where(only[third], -flow[third], flow[third])),
                (pair1, np.zeros_like(pair1), share)]

    def run(stream):
        # What belongs to the last node of an Arrow batch waits for the next one; it is summed up to keep it small
        held = [np.zeros(0, np.int64)] * 3
        for batch in stream:
            k1, k2, n = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, FLOW.names))
            if not len(k1):
                continue
            same = (k1 == k1[-1]) & (k2 >> 32 == k2[-1] >> 32)
            held = totals(k1[same], k2[same], n[same])
            for part in rows(k1[~same], k2[~same], n[~same]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], schema=FLOW)
        for part in rows(*held):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], schema=FLOW)

    return run


def mine(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two to four words.

    Texts are lower-cased (A-Z), a null or empty text has no words, a null language is ``und``. ``a`` is the count of a
    phrase within pieces, overlaps included, ``least`` at least; ``l`` and ``r`` are the counts of its two parts at the
    cut with the smallest score ``floor(2000000 * a / (l + r))`` (ties: the earliest cut), ``n`` all words of the
    language. A phrase inside a longer one that has ``share`` percent of its count is left out. Order: score and ``a``
    descending, then the phrase by bytes. Repeated rows count each time; other columns are not read; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    batches = materialise(plain.mapInArrow(_batches, BATCH), "pieces")
    sizes = (batches.select(F.explode(F.arrays_zip("langs", "sizes")).alias("s"))
             .groupBy(F.col("s.langs").alias("lang")).agg(F.sum("s.sizes").alias("n")))
    own = (batches.select("batch", "langs", F.posexplode(F.arrays_zip("lang_of", "words", "counts")).alias("place", "w"))
           .select("batch", "place", F.col("langs")[F.col("w.lang_of")].alias("lang"), F.col("w.words").alias("word"),
                   F.col("w.counts").alias("count")))
    words = own.groupBy("lang", "word").agg(F.sum("count").alias("f")).filter(F.col("f") >= least)
    words = words.withColumn("bucket", F.pmod(F.xxhash64("word", "lang"), F.lit(GROUPS)))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("word", "lang"))
    words = materialise(words.withColumn("word_id", number * GROUPS + F.col("bucket")).drop("bucket"), "words")
    if (words.agg(F.max("word_id")).first()[0] or 0) >= 2 ** 31:
        raise ValueError("more frequent words than fit 31 bits")

    known = own.join(words, ["lang", "word"]).select(
        F.col("batch").alias("of_batch"), "place", "word_id")
    edges = (batches.select("batch", "codes").groupBy("batch").cogroup(known.groupBy("of_batch"))
             .applyInArrow(_emit, "k1 long, k2 long, n long"))
    # One node, one partition: its flow is complete there. A node has at most one row per batch and edge
    dealt = edges.repartition("k1", F.shiftright("k2", 32)).sortWithinPartitions("k1", "k2")
    flows = dealt.mapInArrow(_flows(least), "k1 long, k2 long, n long")
    grams = flows.groupBy("k1", "k2").agg(F.sum("n").alias("flow")).filter(F.abs("flow") >= least)
    grams = materialise(grams.select("k1", "k2", F.abs("flow").alias("n"), (F.col("flow") < 0).alias("unary")), "grams")
    return ranked(grams, words, sizes, top, share)


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 32).bitwiseOR(b)


def _key(slots: list[Column]) -> tuple[Column, Column]:
    """The two numbers of a phrase of one to four words."""
    full = [*slots, *[F.lit(0).cast("long")] * (LONGEST - len(slots))]
    return _pair(full[0], full[1]), _pair(full[2], full[3])


def ranked(grams: DataFrame, words: DataFrame, sizes: DataFrame, top: int, share: int) -> DataFrame:
    """Score, drop what longer phrases hold, and number the best phrases of each language."""
    low = F.lit(0xFFFFFFFF).cast("long")
    slots = [F.shiftright("k1", 32), F.col("k1").bitwiseAND(low), F.shiftright("k2", 32), F.col("k2").bitwiseAND(low)]
    counts = grams.select("k1", "k2", "n").unionByName(words.select(
        F.shiftleft("word_id", 32).alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("f").alias("n")))
    size = F.when(F.col("k2") == 0, 2).when(slots[3] == 0, 3).otherwise(4)
    phrases = grams.withColumn("size", size)

    def entry(some: list[Column], **more) -> Column:
        k1, k2 = _key(some)
        return F.struct(k1.alias("p1"), k2.alias("p2"), *[F.lit(v).alias(k) for k, v in more.items()])

    # Inner phrases of the longer ones: three of two words and two of three in four words, two of two in three
    inner = {m: F.array(*[entry(slots[i:i + k]) for k in range(2, m) for i in range(m - k + 1)]) for m in (3, 4)}
    held = (phrases.filter("size > 2")
            .select("n", F.explode(F.when(F.col("size") == 3, inner[3]).otherwise(inner[4])).alias("p"))
            .groupBy(F.col("p.p1").alias("k1"), F.col("p.p2").alias("k2")).agg(F.max("n").alias("longer")))
    free = (phrases.filter(~F.col("unary")).join(held, ["k1", "k2"], "left")
            .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n"))).drop("longer", "unary"))

    sides = {m: F.array(*[entry(some, cut=k, left=left) for k in range(1, m)
                          for left, some in ((True, slots[:k]), (False, slots[k:m]))]) for m in (2, 3, 4)}
    parts = free.select("k1", "k2", "n", F.explode(F.when(F.col("size") == 2, sides[2]).when(
        F.col("size") == 3, sides[3]).otherwise(sides[4])).alias("p"))
    found = parts.select("k1", "k2", "n", "p.*").join(
        counts.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n").alias("f")), ["p1", "p2"])
    of_cut = [F.max(F.when((F.col("cut") == k) & (F.col("left") == F.lit(left)), F.col("f"))).alias(f"{'rl'[left]}{k}")
              for k in range(1, LONGEST) for left in (True, False)]
    wide = found.groupBy("k1", "k2", "n").agg(*of_cut)
    # Decimal: the product may pass 64 bits
    tried = [F.when(F.col(f"l{k}").isNotNull(), F.struct(
        F.expr(f"(CAST(n AS DECIMAL(20, 0)) * 2000000) div CAST(l{k} + r{k} AS DECIMAL(20, 0))").alias("score"),
        F.lit(k).alias("cut"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = wide.select("k1", "k2", F.col("n").alias("a"), F.array_min(F.array(*tried)).alias("best"))

    spelt = (scored.select("k1", "k2", F.posexplode(F.array(*slots)).alias("at", "word_id")).filter("word_id > 0")
             .join(words.select("word_id", "word", "lang"), "word_id").groupBy("k1", "k2")
             .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelt"), F.first("lang").alias("lang")))
    rows = scored.join(spelt, ["k1", "k2"]).select(
        "lang", F.array_join(F.col("spelt.word"), " ").alias("phrase"), "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # Ranked in groups first, so that no task sorts all phrases of a language
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    near = (rows.withColumn("group", group)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order)))
            .filter(F.col("rank") <= top).drop("group"))
    best = (near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
            .filter(F.col("rank") <= top))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
