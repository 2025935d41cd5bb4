"""Which hashes of a batch of texts occur elsewhere: sorted hash lists meet by hash range and report back.

Moving one row per hash would cost tens of bytes for each word of the corpus. Here every batch of texts (one task's
share, at most ``BATCH_BYTES``) sends, for each hash range, one sorted list of its distinct hashes coded as differences
(about three bytes a hash). A range gets at most one entry per batch and hash, however often the hash occurs, so a
passage that a third of all texts share costs one entry per batch. The answer, the subset that some other
batch has too or that the batch itself has twice, goes back to the batch, which meets its texts again.

Batches are named by the key of their first text. The input must therefore give the same rows in the same order
when read again, as files do; ``meet`` stops with an error if a batch changed in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from panelcast.llm.common import (U, buffers, pack, pack_planes, pack_sorted, return_freed_memory, unpack,
                                  unpack_planes, unpack_sorted)

#: Text of one batch; a longer text is a batch of its own
BATCH_BYTES = 24 << 20
#: A piece of a batch's texts that is compressed together
PIECE_BYTES = 2 << 20
ROWS = "part int, batch long, kind int, a binary, b binary, c binary, d binary"
ARROW = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()),
                   ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
Batch = tuple[int, np.ndarray, list[np.ndarray], list[np.ndarray]]


def row(part=-1, batch=0, kind=0, a=None, b=None, c=None, d=None) -> tuple:
    return part, batch, kind, a, b, c, d


def to_arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    """Regroup a task's rows (key, text) into batches of bounded size: keys and (bytes, offsets) pieces."""
    return_freed_memory()
    keys, pieces, size = [], [], 0
    for rows in stream:
        column = rows.column("text")
        ids = rows.column("key").to_numpy(zero_copy_only=False)
        data, offsets = buffers(column)
        first = 0
        while first < len(ids):
            room = min(PIECE_BYTES, BATCH_BYTES - size)
            last = int(np.searchsorted(offsets, offsets[first] + room, side="right")) - 1
            if last <= first:
                if size:  # does not fit any more
                    yield np.concatenate(keys), pieces
                    keys, pieces, size = [], [], 0
                    continue
                last = first + 1
            last = min(last, len(ids))
            own = offsets[first:last + 1]
            keys.append(ids[first:last].astype(np.int64))
            pieces.append((np.array(data[own[0]:own[-1]]), own - own[0]))
            size += int(own[-1] - own[0])
            first = last
            if size >= BATCH_BYTES:
                yield np.concatenate(keys), pieces
                keys, pieces, size = [], [], 0
    if keys:
        yield np.concatenate(keys), pieces


def scatter(batch: int, hashes: np.ndarray, parts: int) -> list[tuple]:
    """Rows with the distinct hashes of a batch by range, and which of them it has more than once."""
    values, counts = np.unique(hashes, return_counts=True)
    out = []
    cuts = cuts_of(values, parts)
    for part in range(parts):
        own = slice(cuts[part], cuts[part + 1])
        if cuts[part + 1] > cuts[part]:
            out.append(row(part, batch, 0, pack_sorted(values[own]), pack(np.packbits(counts[own] > 1))))
    return out


def cuts_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in a sorted list; the last place is its length."""
    step = 2 ** 64 // parts
    borders = np.array([i * step for i in range(parts)], dtype=U)
    return np.append(np.searchsorted(values, borders), len(values))


def _settle(table: pa.Table) -> pa.Table:
    """One hash range of ``shared_hashes``: plain hashes, and entries whose first place matters."""
    return_freed_memory()
    kinds = table.column("kind").to_numpy()
    plain, first = table.filter(pa.array(kinds == 0)), table.filter(pa.array(kinds != 0))
    tables = [f(t) for f, t in ((shared_of, plain), (settle_firsts, first)) if len(t)]
    return pa.concat_tables(tables)


def shared_of(table: pa.Table) -> pa.Table:
    """For every batch, those of its hashes that occur more than once in all."""
    names = table.column("batch").to_numpy()
    lists = [unpack_sorted(x) for x in table.column("a").to_pylist()]
    many = [np.unpackbits(unpack(x, np.uint8))[:len(v)].astype(bool)
            for x, v in zip(table.column("b").to_pylist(), lists)]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.concatenate(many)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out, at = [], 0
    for name, own in zip(names.tolist(), lists):
        found = own[twice[at:at + len(own)]]
        at += len(own)
        if len(found):
            out.append(row(0, name, 1, pack_sorted(found)))
    return pa.Table.from_batches([to_arrow(out)])


def shared_hashes(docs: DataFrame, hashes_of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
                  parts: int, firsts_of: Callable | None = None) -> DataFrame:
    """Rows of kind 1: for each batch of ``docs(key, text)``, lists of its hashes that occur more than once.

    ``hashes_of(keys, data, offsets)`` gives the hashes of one piece of texts. ``firsts_of`` may give entries as for
    ``first_rows``; their answers are rows of kind 2.
    """
    def emit(stream):
        for keys, pieces in batches(stream):
            at, found, entries = 0, [], []
            for data, offsets in pieces:
                own = keys[at:at + len(offsets) - 1]
                found.append(hashes_of(own, data, offsets))
                if firsts_of:
                    entries.append(firsts_of(own, data, offsets))
                at += len(offsets) - 1
            rows = scatter(int(keys[0]), np.concatenate(found), parts)
            if entries:
                rows += first_rows(int(keys[0]), *map(np.concatenate, zip(*entries)), parts, kind=5)
            if rows:
                yield to_arrow(rows)

    sent = docs.select("key", "text").mapInArrow(emit, ROWS)
    return sent.groupBy("part").applyInArrow(_settle, ROWS)


def payloads(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: the texts of each batch, compressed, in pieces."""
    def emit(stream):
        for keys, pieces in batches(stream):
            at = 0
            for number, (data, offsets) in enumerate(pieces):
                n = len(offsets) - 1
                text = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
                yield to_arrow([row(number, int(keys[0]), 0, text, pack(np.diff(offsets)), pack(keys[at:at + n]))])
                at += n

    return docs.select("key", "text").mapInArrow(emit, ROWS)


def open_payload(blob: bytes, sizes: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, bytes and offsets of one piece."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(unpack(sizes, np.int64))])
    return unpack(keys, np.int64), data, offsets


def meet(texts: DataFrame, answers: DataFrame, handle: Callable, schema: str) -> DataFrame:
    """Bring a batch's texts and all answers for it together: ``handle(batch, pieces, answers)`` yields Arrow tables.

    ``pieces`` are the payload rows in order, ``answers`` the other rows, both as dicts. ``handle`` returns one table.
    """
    def grouped(table: pa.Table) -> pa.Table:
        return_freed_memory()
        rows = table.to_pylist()
        pieces = sorted((r for r in rows if r["kind"] == 0), key=lambda r: r["part"])
        if not pieces:
            raise RuntimeError("the input changed between two reads: a batch of texts is gone")
        return handle(rows[0]["batch"], pieces, [r for r in rows if r["kind"] != 0])

    return texts.unionByName(answers).groupBy("batch").applyInArrow(grouped, schema)


def parts_of(docs: DataFrame) -> int:
    """How many hash ranges to use: as many as the session has shuffle partitions."""
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def known(answers: list[dict], kind: int = 1) -> np.ndarray:
    """All hashes of the answers of one kind, sorted."""
    found = [unpack_sorted(r["a"]) for r in answers if r["kind"] == kind]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U)


def among(values: np.ndarray, known_sorted: np.ndarray) -> np.ndarray:
    """Mask of the values that are in a sorted list."""
    if not len(known_sorted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known_sorted, values)
    at[at == len(known_sorted)] = 0
    return known_sorted[at] == values



def _distinct(first, check, keys, spots):
    """Distinct entries in order of both hashes, each with its first (key, spot) and how many there are."""
    order = np.lexsort((spots, keys, check, first))
    first, check, keys, spots = first[order], check[order], keys[order], spots[order]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (check[1:] != check[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(first)))
    return first[at], check[at], keys[at], spots[at], sizes, order, np.cumsum(new) - 1


def first_rows(batch: int, first, check, keys, spots, parts: int, kind: int = 0) -> list[tuple]:
    """Rows for things known by 96 bits of hash: each distinct one of a batch with its first (key, spot)."""
    first, check, keys, spots, sizes, _, _ = _distinct(first, check, keys, spots)
    spots = spots * 2 + (sizes > 1)
    out = []
    cuts = cuts_of(first, parts)
    for part in range(parts):
        own = slice(cuts[part], cuts[part + 1])
        if cuts[part + 1] > cuts[part]:
            out.append(row(part, batch, kind, pack_sorted(first[own]), pack(check[own].astype(np.uint32)),
                           pack_planes(keys[own]), pack_planes(spots[own])))
    return out


def settle_firsts(table: pa.Table) -> pa.Table:
    """One hash range: every batch learns which of its entries occur twice and where the first one is (kind 2)."""
    names = table.column("batch").to_pylist()
    first = [unpack_sorted(x) for x in table.column("a").to_pylist()]
    check = [unpack(x, np.uint32) for x in table.column("b").to_pylist()]
    keys = [unpack_planes(x).view(np.int64) for x in table.column("c").to_pylist()]
    spots = [unpack_planes(x).view(np.int64) for x in table.column("d").to_pylist()]
    more = np.concatenate(spots) & 1
    _, _, k, s, sizes, order, group = _distinct(np.concatenate(first), np.concatenate(check),
                                                np.concatenate(keys), np.concatenate(spots) >> 1)
    many = np.bincount(group, weights=more[order], minlength=len(sizes)) + sizes - 1
    place = np.empty(len(order), np.int64)
    place[order] = group
    out, at = [], 0
    for name, f, c in zip(names, first, check):
        own = place[at:at + len(f)]
        at += len(f)
        keep = many[own] > 0
        if keep.any():
            out.append(row(0, name, 2, pack_sorted(f[keep]), pack(c[keep]),
                           pack_planes(k[own[keep]]), pack_planes(s[own[keep]])))
    return pa.Table.from_batches([to_arrow(out)])


class FirstIndex:
    """Answers of ``settle_firsts`` for one batch, to be asked by both hashes."""

    def __init__(self, answers: list[dict]):
        lists = [(unpack_sorted(r["a"]), unpack(r["b"], np.uint32), unpack_planes(r["c"]).view(np.int64),
                  unpack_planes(r["d"]).view(np.int64)) for r in answers if r["kind"] == 2]
        kinds = (U, np.uint32, np.int64, np.int64)
        self.first, self.check, self.keys, self.spots = (
            map(np.concatenate, zip(*lists)) if lists else (np.zeros(0, kind) for kind in kinds))
        order = np.lexsort((self.check, self.first))
        self.first, self.check = self.first[order], self.check[order]
        self.keys, self.spots = self.keys[order], self.spots[order]

    def __len__(self):
        return len(self.first)

    def find(self, first: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each entry in ``keys`` and ``spots``, or -1."""
        at = np.searchsorted(self.first, first)
        out = np.full(len(first), -1, np.int64)
        left = np.flatnonzero(at < len(self.first))
        while len(left):
            left = left[self.first[at[left]] == first[left]]
            hit = self.check[at[left]] == check[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < len(self.first)]
        return out
