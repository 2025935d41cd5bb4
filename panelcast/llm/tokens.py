"""Tokens between single-byte separators: spans, counts and Arrow strings, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from panelcast.llm.common import BLOCK_BYTES, buffers, fold_case


def solid_bytes(separators: Iterable[int]) -> np.ndarray:
    """Which of the 256 bytes belong to tokens."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def slices(rows: pa.RecordBatch, text: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of about ``limit`` bytes of text, one row at least: first, last, bytes, offsets."""
    data, offsets = buffers(rows.column(text))
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1))
        own = offsets[first:last + 1]
        yield first, last, data[own[0]:own[-1]], own - own[0]
        first = last


def spans(data: np.ndarray, solid: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of solid bytes; a run also ends at each of the ``breaks``."""
    mark = solid[data]
    begins, ends = mark.copy(), mark.copy()
    begins[1:] &= ~mark[:-1]
    ends[:-1] &= ~mark[1:]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    begins[at] = mark[at]
    ends[at - 1] = mark[at - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def cuts(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` bytes that end at a text's end or a separator: no token is cut, however long
    a text is. Only a token longer than the limit makes a range longer."""
    first, n = 0, len(data)
    while first < n:
        last = min(n, first + limit)
        if last < n:
            inside = offsets[(offsets > first) & (offsets <= last)]
            gaps = np.flatnonzero(~solid[data[first:last]])
            ends = [int(x) for x in (inside[-1:], gaps[-1:] + first + 1) for x in x]
            if ends:
                last = max(ends)
            else:
                after = np.flatnonzero(~solid[data[last:]])
                ends = [int(x) for x in (offsets[offsets > last][:1], after[:1] + last) for x in x]
                last = min(ends)
        yield first, last
        first = last


def strings_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of a text as one Arrow array, without a Python object per token."""
    sizes = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    body = data[np.cumsum(inside[:-1]).astype(bool)] if len(start) else data[:0]
    # Two ranges that touch leave no edge between them, so their bytes are simply next to each other
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()),
                                                               pa.py_buffer(np.ascontiguousarray(body).tobytes())])


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value in a list of the distinct ones, and that list."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def term_counts(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray):
    """Counts of lower-cased (A-Z) tokens by text: text number, term number, count, and the terms.

    Sorted by term number, then by text.
    """
    texts, terms, counts, words, known = [], [], [], [], 0
    for first, last in cuts(data, offsets, solid):
        part = fold_case(data[first:last])
        inner = offsets[(offsets > first) & (offsets < last)] - first
        start, end = spans(part, solid, inner)
        if not len(start):
            continue
        code, own = encoded(strings_of(part, start, end))
        text = np.searchsorted(offsets, start + first, side="right") - 1
        pairs, n = np.unique(code * len(offsets) + text, return_counts=True)
        texts.append(pairs % len(offsets))
        terms.append(pairs // len(offsets) + known)
        counts.append(n)
        words.append(own)
        known += len(own)
    if not words:
        none = np.zeros(0, np.int64)
        return none, none, none, pa.array([], pa.large_binary())
    number, distinct = encoded(pa.concat_arrays(words))
    key = number[np.concatenate(terms)] * len(offsets) + np.concatenate(texts)
    pairs, at = np.unique(key, return_inverse=True)
    n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
    return pairs % len(offsets), pairs // len(offsets), n, distinct
