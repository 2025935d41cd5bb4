"""Plain Python counterparts of the text operators, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_bytes(texts: list[str | None], length: int):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def repeated_words(texts: list[str | None], window: int):
    """(n_words, n_removed, kept) of each text, in their order."""
    seen, out = set(), []
    for t in texts:
        words = WORD.findall((t or "").encode())
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            own = tuple(words[i:i + window])
            if own in seen:
                gone[i:i + window] = [True] * window
            seen.add(own)
        out.append((len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def shingles(text: str | None) -> frozenset:
    words = [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in WORD.findall((text or "").encode())]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def near_components(texts: list[str | None], percent: int = 75):
    """(set size, position of the component's first text)."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def repeated_chunks(texts: list[str | None], every: int = 4):
    """(lines, lines removed, kept) of each text, as ``line_dedup`` cuts them."""
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        chunks, own = [], []
        for i, x in enumerate(lines):
            own.append(x)
            if i == len(lines) - 1 or sum(5 ** k * h[i - k] for k in range(3) if i >= k) % every == 0:
                chunks.append("\n".join(own))
                own = []
        kept, removed = [], 0
        for c in chunks:
            if "\n" in c and len(c) >= 20 and c in seen:
                removed += c.count("\n") + 1
            else:
                kept.append(c)
            seen.add(c)
        out.append((len(lines), removed, "\n".join(kept)))
    return out
