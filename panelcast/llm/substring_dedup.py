"""Remove word sequences that already occurred earlier, found through difference-cover anchors.

A difference cover D of a period v holds, for any two positions i and j, a shift t < v such that both i + t and j + t
fall on D modulo v. Hashes of short word runs are taken at those positions only (4 of 13 for windows of 20 words);
whichever way two equal windows are aligned, they share at least one such anchor. Only windows around an anchor that
occurs twice are then extended to their full length, hashed, and ordered by (document, start).

Both meetings use sorted hash lists by hash range (``exchange``): a window that a third of all documents
share costs one entry per batch of texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelcast.llm import exchange as ex
from panelcast.llm.common import Rolling, U, cover, keyed, mix, restore, word_hashes, words

#: Perfect difference covers by period
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Least words of an anchor, unless the window is shorter
ANCHOR = 8
SCHEMA = "key long, n_words long, n_removed long, kept_sha256 string"


def plan(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for a window: the longest period that leaves an anchor of 8 words."""
    period = max((v for v in COVERS if window - v + 1 >= min(ANCHOR, window - 2)), default=0)
    return (period, COVERS[period], window - period + 1) if period else (1, (0,), window)


def _anchors(hashes: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of a block that carry an anchor, and the anchors' hashes."""
    period, residues, length = plan(window)
    n = np.diff(bounds)
    local = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
    wanted = np.isin(np.arange(period), residues)[local % period]
    # An anchor of a text shorter than the window can't be part of a window
    wanted &= (local + length <= np.repeat(n, n)) & np.repeat(n >= window, n)
    at = np.flatnonzero(wanted)
    return at, Rolling(hashes).slices(at, at + length)


def _windows(hashes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Word positions at which a whole window of one text starts."""
    n = np.diff(bounds)
    local = np.arange(len(hashes)) - np.repeat(bounds[:-1], n)
    return np.flatnonzero(local + window <= np.repeat(n, n))


def _identity(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window, 96 bits in all."""
    first = Rolling(hashes).slices(starts, starts + window)
    second = Rolling(mix(hashes ^ U(0xD6E8FEB86659FD93))).slices(starts, starts + window)
    return first, second >> U(32)


def dedup(docs: DataFrame, window: int = 20, key: str = "doc_id", text: str = "text", parts: int | None = None,
          with_text: bool = False) -> DataFrame:
    """Remove every word covered by a window of ``window`` words whose sequence starts earlier as well.

    Earlier means a smaller id, or the same document and a smaller start; windows are judged on the input. Returns
    ``doc_id, n_words, n_removed, kept_sha256`` (of the kept words joined by single spaces) and, on request, that
    text as ``kept``. Null, empty and blank texts have no words. Rows that repeat an id or have none are documents of
    their own, ordered by (id, text), nulls first. Other columns of the input are not read.
    """
    rows, own_ids = keyed(docs, key, text)
    parts = parts or ex.parts_of(docs)
    _, _, length = plan(window)
    period = window - length + 1

    def anchors_of(keys, data, offsets):
        start, end, bounds = words(data, offsets)
        return _anchors(word_hashes(data, start, end), bounds, window)[1]

    def extend(batch, pieces, answers):
        """Candidate windows around shared anchors, hashed at full length and sent to their range."""
        shared = ex.known(answers)
        found = []
        for piece in pieces if len(shared) else []:
            keys, data, offsets = ex.open_payload(piece["a"], piece["b"], piece["c"])
            start, end, bounds = words(data, offsets)
            hashes = word_hashes(data, start, end)
            at, anchors = _anchors(hashes, bounds, window)
            hit = at[ex.among(anchors, shared)]
            near = cover(np.maximum(hit - period + 1, 0), period, len(hashes))
            starts = _windows(hashes, bounds, window)
            starts = starts[near[starts]]
            text_of = np.searchsorted(bounds, starts, side="right") - 1
            found.append((*_identity(hashes, starts, window), keys[text_of], starts - bounds[text_of]))
        rows = ex.first_rows(batch, *map(np.concatenate, zip(*found)), parts) if found else []
        return pa.Table.from_batches([ex.to_arrow(rows)])

    def remove(batch, pieces, answers):
        index = ex.FirstIndex(answers)
        columns = [[], [], [], [], []]
        for piece in pieces:
            keys, data, offsets = ex.open_payload(piece["a"], piece["b"], piece["c"])
            start, end, bounds = words(data, offsets)
            gone = np.zeros(len(start), bool)
            if len(index):
                hashes = word_hashes(data, start, end)
                starts = _windows(hashes, bounds, window)
                place = index.find(*_identity(hashes, starts, window))
                hit = place >= 0
                starts, place = starts[hit], place[hit]
                text_of = np.searchsorted(bounds, starts, side="right") - 1
                later = (index.keys[place] != keys[text_of]) | (index.spots[place] != starts - bounds[text_of])
                gone = cover(starts[later], window, len(start))
            kept, cuts = join_kept(data, offsets, start, end, bounds, ~gone)
            columns[0].append(keys)
            columns[1].append(np.diff(bounds))
            columns[2].append(np.add.reduceat(np.append(gone, False), bounds[:-1]) * (np.diff(bounds) > 0))
            raw = kept.tobytes()
            bodies = [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            columns[3] += [hashlib.sha256(b).hexdigest() for b in bodies]
            columns[4] += [b.decode() for b in bodies] if with_text else []
        arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in columns[:3]] + [pa.array(columns[3], pa.string())]
        names = ["key", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            arrays.append(pa.array(columns[4], pa.string()))
            names.append("kept")
        return pa.Table.from_arrays(arrays, names=names)

    texts = ex.payloads(rows)
    sent = ex.meet(texts, ex.shared_hashes(rows, anchors_of, parts), extend, ex.ROWS)
    answers = sent.groupBy("part").applyInArrow(ex.settle_firsts, ex.ROWS)
    out = ex.meet(texts, answers, remove, SCHEMA + (", kept string" if with_text else ""))
    return restore(rows, own_ids, out)


def join_kept(data, offsets, start, end, bounds, kept) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each text with single spaces between them, and where each text's bytes begin."""
    at = np.flatnonzero(kept)
    text_of = np.searchsorted(bounds, at, side="right") - 1
    more = np.zeros(len(at), bool)
    more[:-1] = text_of[1:] == text_of[:-1]
    edge = np.zeros(len(data) + 2, np.int8)
    edge[start[at]] += 1
    edge[end[at] + more] -= 1
    chosen = np.cumsum(edge[:len(data)], dtype=np.int8) > 0
    plain = data.copy()
    plain[np.minimum(end[at][more], max(len(data) - 1, 0))] = 0x20
    total = np.concatenate([[0], np.cumsum(chosen)])
    return plain[chosen], total[offsets]
