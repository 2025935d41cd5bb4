"""Ranked lexical search: an inverted index in shards of documents, searched by Block-Max MaxScore.

``build`` gives every term of every document a posting list per shard, cut into blocks of ``BLOCK`` postings. A block
has its first and last document, the largest impact in it and its place in the compressed list, so what a
block can add to a score is known without opening it. ``search`` brings the lists of a block of items' terms and a
shard together in one task. There, lists are taken in order of their global bound until the rest can't lift a
new document into the best ``k``: these are the essential lists. Documents found in them are kept only while their
score and the block maxima of the other lists reach the best ``k``; only blocks that still hold such a document are
decompressed. Every shard returns ``k`` rows per item at most, and Spark merges these heaps.

All scores are whole numbers, hence exact in any order of addition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from panelcast.llm.common import materialise, pack, unpack
from panelcast.llm.tokens import slices, solid_bytes, spans, term_counts

#: What isn't part of a term, as ranges of bytes and as a pattern, and the weights of the score
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, TF_WEIGHT, LENGTH_WEIGHT, FLAT, SLOPE = 10 ** 9, 1000, 8, 10, 90

SOLID = solid_bytes(SEPARATORS)
#: Postings of one block
BLOCK = 128
#: Text of one shard; a longer text is a shard of its own
SHARD_BYTES = 8 << 20
#: Terms of the items that are searched together
ITEM_TERMS = 50_000

INDEX = ("shard long, term string, df int, top long, firsts array<int>, lasts array<int>, tops array<long>, "
         "places array<int>, payload binary, extra binary")
ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int32()), ("top", pa.int64()),
                   ("firsts", pa.list_(pa.int32())), ("lasts", pa.list_(pa.int32())), ("tops", pa.list_(pa.int64())),
                   ("places", pa.list_(pa.int32())), ("payload", pa.binary()), ("extra", pa.binary())])
FOUND = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def sizes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents hold a term, and how many terms all of them hold, repeats included."""
    def count(stream):
        for rows in stream:
            full = terms = 0
            for _, _, data, offsets in slices(rows, "text", SHARD_BYTES):
                start, _ = spans(data, SOLID, offsets)
                per = np.diff(np.searchsorted(start, offsets))
                full, terms = full + int((per > 0).sum()), terms + int(per.sum())
            yield pa.RecordBatch.from_pydict({"n": [full], "l": [terms]})

    row = (docs.select(F.col(text).alias("text")).mapInArrow(count, "n long, l long")
           .agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first())
    return row["n"] or 0, row["l"] or 0


def impacts(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score per unit of a term's weight; ``damping`` grows with the text."""
    return (SCALE * tf) // (TF_WEIGHT * tf + LENGTH_WEIGHT * damping)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the last byte of a value below 128; and the number of bytes of each value."""
    n = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        n += rest > 0
        rest >>= 7
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        some = np.flatnonzero(n > k)
        out[at[some] + k] = ((values[some] >> (7 * k)) & 127) | ((n[some] > k + 1) << 7)
    return out, n


def from_varints(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)
    n = ends - starts + 1
    out = (raw[starts] & 127).astype(np.int64)
    for k in range(1, int(n.max(initial=1))):
        some = np.flatnonzero(n > k)
        out[some] |= (raw[starts[some] + k] & 127).astype(np.int64) << (7 * k)
    return out


def shard_rows(shard: int, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    """Index rows of one shard: its documents (no term) and a list for each term."""
    doc, term, tf, words = term_counts(data, offsets, SOLID)
    length = np.bincount(doc, weights=tf, minlength=len(offsets) - 1).astype(np.int64)
    damping = FLAT + (SLOPE * length * n_docs) // max(n_terms, 1)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(first, len(term)))
    impact = impacts(tf, damping[doc])

    place = np.arange(len(doc)) - np.repeat(first, df)
    begin = np.flatnonzero(place % BLOCK == 0)
    end = np.append(begin[1:], len(doc))
    gap = np.diff(doc, prepend=0)
    gap[begin] = 0
    raw, n = varints(np.stack([gap, tf], axis=1).ravel())
    bytes_at = np.append(0, np.cumsum(n.reshape(-1, 2).sum(axis=1)))
    of_term = term[begin]
    list_at = np.append(np.searchsorted(begin, first), len(begin)).astype(np.int32)
    payload_at = bytes_at[np.append(first, len(doc))].astype(np.int32)

    def lists(values, kind):
        return pa.ListArray.from_arrays(pa.array(np.append(list_at[0], list_at), pa.int32()), pa.array(values, kind))

    none = np.zeros(0, np.int64)
    top = np.maximum.reduceat(impact, begin) if len(begin) else none
    whole = np.maximum.reduceat(impact, first) if len(first) else none
    places = bytes_at[begin] - bytes_at[first][of_term] if len(begin) else none
    valid = np.array(ids.is_valid().to_numpy(zero_copy_only=False), bool)
    names = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(list_at):
        list_at = np.zeros(1, np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(payload_at.tobytes()), pa.py_buffer(raw.tobytes())])
    columns = [np.full(len(first) + 1, shard),
               pa.concat_arrays([pa.array([None], pa.string()), words.cast(pa.binary()).cast(pa.string())]),
               np.append(len(names), df), np.append(0, whole), lists(doc[begin], pa.int32()),
               lists(doc[end - 1] if len(begin) else none, pa.int32()), lists(top, pa.int64()), lists(places, pa.int32()),
               pa.concat_arrays([pa.array([pack(names)], pa.binary()), payload]),
               pa.array([pack(np.stack([damping, valid.astype(np.int64)]))] + [None] * len(first), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c
                                       for c, f in zip(columns, ARROW)], schema=ARROW)


def build(docs: DataFrame, key: str = "doc_id", text: str = "text",
          shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int, int]:
    """The written index of all terms of all documents, the number of documents with a term and of all their terms."""
    n_docs, n_terms = sizes(docs, text)

    def emit(stream):
        number = TaskContext.get().partitionId() << 32
        for rows in stream:
            for first, last, data, offsets in slices(rows, "text", shard_bytes):
                ids = rows.column("doc_id").slice(first, last - first)
                yield shard_rows(number, ids, data, offsets, n_docs, n_terms)
                number += 1

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialise(plain.mapInArrow(emit, INDEX), "index"), n_docs, n_terms


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
           item: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0.

    Equal scores come by ascending id, rows without id last. A null or empty text has no term: such a document is
    never found and not counted, such an item finds nothing. Every row of ``docs`` is a document of its own, also where
    an id or a whole row repeats. Equal rows of ``items`` count once; an id with several texts is searched with
    each of them, and its ranks count for each text alone. Other columns are not read.
    """
    index, n_docs, _ = build(docs, key, text, shard_bytes)
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).distinct()
    asked = materialise(asked.withColumn("item", F.monotonically_increasing_id()), "items")
    words = asked.select("item", F.explode(F.array_distinct(F.regexp_extract_all(
        F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))).alias("term"))
    groups = max(1, -(-words.count() // ITEM_TERMS))
    wanted = (words.withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int"))
              .groupBy("group", "term").agg(F.collect_list("item").alias("items")))

    lists = materialise(index.filter(F.col("term").isNotNull()).join(wanted.select("term").distinct(), "term", "left_semi"), "lists")
    weights = lists.groupBy("term").agg(F.floor(1000 * F.log(
        F.lit(2.0 * n_docs + 2) / (2 * F.sum("df") + 1).cast("double"))).cast("long").alias("weight"))
    work = lists.join(wanted.join(weights, "term"), "term")
    shards = (index.filter(F.col("term").isNull())
              .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
              .withColumns({"items": F.lit(None).cast("array<long>"), "weight": F.lit(None).cast("long")}))
    found = (shards.unionByName(work).groupBy("group", "shard")
             .applyInArrow(_searcher(k), "item long, doc_id long, score long"))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    merged = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return merged.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


class Lists:
    """The posting lists of one shard for one group of items; blocks are opened when asked for and kept."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        whole = table.filter(pc.is_null(table.column("term")))
        self.ids = unpack(whole.column("payload")[0].as_py(), np.int64)
        self.damping, valid = unpack(whole.column("extra")[0].as_py(), np.int64).reshape(2, -1)
        self.valid = valid.astype(bool)
        own = table.filter(pc.is_valid(table.column("term")))
        self.weight = own.column("weight").to_numpy().astype(np.int64)
        self.df = own.column("df").to_numpy()
        self.bound = self.weight * own.column("top").to_numpy()
        self.firsts, self.lasts, self.tops, self.places = (
            self._parts(own.column(c)) for c in ("firsts", "lasts", "tops", "places"))
        self.payload = own.column("payload")
        self.items = own.column("items").to_pylist()
        self.opened: dict[int, tuple] = {}
        #: How many blocks the lists have, and how many were opened
        self.blocks = sum(map(len, self.firsts))
        self.read = 0

    @staticmethod
    def _parts(column) -> list[np.ndarray]:
        if not len(column):
            return []
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
        return np.split(values, ends[:-1])

    def open(self, i: int, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a list, of the asked blocks at least; the impact of unread places is 0."""
        if i not in self.opened:
            raw = np.frombuffer(self.payload[i].as_py(), np.uint8)
            self.opened[i] = (raw, np.zeros(len(self.firsts[i]), bool), np.zeros(self.df[i], np.int64),
                              np.zeros(self.df[i], np.int64))
        raw, seen, docs, impact = self.opened[i]
        need = np.flatnonzero(~seen) if blocks is None else blocks[~seen[blocks]]
        if len(need):
            self.read += len(need)
            ends = np.append(self.places[i][1:], len(raw))
            part = raw if len(need) == len(seen) else np.concatenate([raw[self.places[i][b]:ends[b]] for b in need])
            gap, tf = from_varints(part).reshape(-1, 2).T
            n = np.minimum(BLOCK, self.df[i] - need * BLOCK)
            start = np.cumsum(n) - n
            sums = np.cumsum(gap)
            found = sums - np.repeat(sums[start] - self.firsts[i][need], n)
            at = np.repeat(need * BLOCK - start, n) + np.arange(len(gap))
            docs[at], impact[at] = found, impacts(tf, self.damping[found])
            seen[need] = True
        return docs, impact

    def best(self, lists: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of one item that may be among its best ``k``, with whole scores."""
        lists = lists[np.argsort(-self.bound[lists], kind="stable")]
        rest = np.append(np.cumsum(self.bound[lists][::-1])[::-1], 0)
        score = np.zeros(len(self.ids), np.int64)
        least, used = 1, 0
        while used < len(lists) and rest[used] >= least:
            docs, impact = self.open(lists[used])
            score[docs] += self.weight[lists[used]] * impact
            used += 1
            least = max(least, kth(score, k))
        docs = np.flatnonzero(score)
        others = lists[used:]
        if len(others) and len(docs):
            block = [np.searchsorted(self.lasts[i], docs) for i in others]
            limit = np.zeros((len(others), len(docs)), np.int64)
            for row, (i, b) in enumerate(zip(others, block)):
                held = np.minimum(b, len(self.lasts[i]) - 1)
                inside = (b < len(self.lasts[i])) & (self.firsts[i][held] <= docs)
                limit[row, inside] = self.weight[i] * self.tops[i][held[inside]]
            left = limit.sum(axis=0)
            alive = np.flatnonzero(score[docs] + left >= least)
            for row, i in enumerate(others):
                hit = alive[limit[row, alive] > 0]
                if len(hit):
                    blocks = np.unique(block[row][hit])
                    known, impact = self.open(i, blocks)
                    at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                    at = at[at < self.df[i]]
                    add = np.zeros(len(self.ids), np.int64)
                    add[known[at]] = self.weight[i] * impact[at]
                    score[docs[hit]] += add[docs[hit]]
                left -= limit[row]
                least = max(least, kth(score[docs[alive]], k))
                alive = alive[score[docs[alive]] + left[alive] >= least]
            docs = docs[alive]
        return docs, score[docs]


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def _searcher(k: int):
    def run(table: pa.Table) -> pa.Table:
        lists = Lists(table)
        of_item: dict[int, list[int]] = {}
        for i, items in enumerate(lists.items):
            for item in items:
                of_item.setdefault(item, []).append(i)
        out = []
        for item, own in of_item.items():
            docs, score = lists.best(np.array(own), k)
            order = np.lexsort((lists.ids[docs], ~lists.valid[docs], -score))[:k]
            order = order[score[order] > 0]
            out.append((np.full(len(order), item), docs[order], score[order]))
        if not out:
            return FOUND.empty_table()
        item, docs, score = map(np.concatenate, zip(*out))
        return pa.Table.from_arrays([pa.array(item, pa.int64()), pa.array(lists.ids[docs], pa.int64(), mask=~lists.valid[docs]),
                                     pa.array(score, pa.int64())], schema=FOUND)

    return run
