"""Remove every byte of a string of 400 bytes that occurs twice: sparse suffix runs, sorted, exchanged and merged.

Sorting all suffixes of a corpus would move each byte hundreds of times, so three exact reductions come first:

1. Copies of a whole text are told by their digest; only the first one goes on, standing for all.
2. Hashes of 64-byte strings at content-chosen places (one in 12) are counted over the corpus. A long string that holds
   one occurring once can't repeat, so only the stretches between such places go on.
3. In these stretches suffixes are taken at content-chosen cuts only (about one in 256 bytes), in both directions: a
   suffix that starts at a cut and a reversed prefix that ends there.

Each batch of texts sorts its distinct strings to a run, codes it by common prefix with the string before
(front coding) and deals it out by sampled range borders. A range merges its runs with a loser tree that carries the
length of the known common prefix of each loser with the last winner and compares bytes beyond it only. The common
prefix of neighbours in the merged order tells, for each cut, how far the best match reaches.

A match that holds a cut reaches over all its windows right of it (forward) or left of it (backward); a cut whose best
match ends early rules windows out. Of the windows that neither proves nor rules out (matches barely longer than a
window, or made of parts of several texts) those whose hash occurs twice, be it in a proven window, are sorted and
merged themselves, in the same way. The result is exact: hashes only rule out, strings decide.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from panelcast.llm import exchange as ex
from panelcast.llm.common import (Rolling, buffers, byte_values, keyed, materialise, pack, pack_sorted, restore, return_freed_memory,
                                  runs_of, unpack, unpack_sorted)

#: Bytes of an anchor, and one place in so many has one
GRAM, EVERY = 64, 12
#: Bytes that decide on a cut, and one place in so many is one
CUT_GRAM, CUT_EVERY = 16, 256
#: Sampled strings per range, from which the borders of the ranges are chosen; they decide on balance, not on results
SAMPLES = 40
SCHEMA = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RUN, RANGES, WHOLE, REACH, PROVEN, LEFT, OPEN, REPEATED = 10, 11, 12, 20, 30, 31, 32, 40


# Sorted runs and their merge


def common(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n, step = min(len(x), len(y)), 32
    while at < n:
        end = min(at + step, n)
        a, b = x[at:end], y[at:end]
        if a != b:
            differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
            return at + (8 * len(a) - differ.bit_length()) // 8
        at, step = end, step * 2
    return n


def run_rows(batch: int, strings: dict[bytes, list[int]], borders: list[bytes]) -> list[tuple]:
    """One batch's sorted run, front coded, a row for each range. ``strings``: number and count by string."""
    ordered = sorted(strings)
    out, first = [], 0
    for part in range(len(borders) + 1):
        last = bisect.bisect_left(ordered, borders[part]) if part < len(borders) else len(ordered)
        if last > first:
            out.append(ex.row(part, batch, RUN, *_front_code(ordered[first:last], strings)))
        first = last
    return out


def _front_code(own: list[bytes], strings: dict[bytes, list[int]]) -> tuple[bytes, ...]:
    shared, rest, before = [], [], b""
    for x in own:
        n = common(before, x, 0)
        shared.append(n)
        rest.append(x[n:])
        before = x
    marks = [strings[x][0] * 2 + (strings[x][1] > 1) for x in own]
    return (zstandard.ZstdCompressor(level=1).compress(b"".join(rest)), pack(np.array(shared, np.uint32)),
            pack(np.array([len(x) for x in rest], np.uint32)), pack(np.array(marks, np.int64)))


def open_run(a: bytes, b: bytes, c: bytes, d: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """Strings, common prefix with the one before, and marks (number and whether the batch has it twice)."""
    rest = zstandard.ZstdDecompressor().decompress(a)
    shared, sizes = unpack(b, np.uint32).tolist(), unpack(c, np.uint32).tolist()
    out, before, at = [], b"", 0
    for n, size in zip(shared, sizes):
        before = before[:n] + rest[at:at + size]
        at += size
        out.append(before)
    return out, shared, unpack(d, np.int64).tolist()


def merge(runs: list[tuple[list[bytes], list[int]]]):
    """(run, place in it, common prefix with the string before) in the order of all strings.

    A tournament of losers. ``known[r]`` is the common prefix of run r's string with the last winner it met. Of two
    that both follow that winner, the one with the longer known prefix is smaller; only equal ones are compared, from
    there on. The next string of the winning run has its known prefix from the front coding.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place, current, known = [0] * k, [None] * k, [-1] * k
    for r, (strings, _) in enumerate(runs):
        if strings:
            current[r], known[r] = strings[0], 0
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = current[a], current[b]
        n = common(x, y, known[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        upper = []
        for i in range(0, len(level), 2):
            winner, losers[node + i // 2] = play(level[i], level[i + 1])
            upper.append(winner)
        level = upper
    winner = level[0]
    while known[winner] >= 0:
        yield winner, place[winner], known[winner]
        place[winner] += 1
        strings, shared = runs[winner]
        if place[winner] < len(strings):
            current[winner], known[winner] = strings[place[winner]], shared[place[winner]]
        else:
            current[winner], known[winner] = None, -1
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def merge_range(table: pa.Table, borders: list[bytes]) -> pa.Table:
    """One range: for each string of each run, the longest common prefix with any other string.

    Strings outside lie beyond the range's borders, so their common prefix is at most that with the border: the
    answer has the best length found in the range and the upper bound.
    """
    return_freed_memory()
    part = table.column("part")[0].as_py()
    names = table.column("batch").to_pylist()
    opened = [open_run(*x) for x in zip(*(table.column(c).to_pylist() for c in "abcd"))]
    best = [np.zeros(len(x[0]), np.int64) for x in opened]
    before = None
    for r, i, n in merge([x[:2] for x in opened]):
        best[r][i] = n
        if before is not None and n > best[before[0]][before[1]]:
            best[before[0]][before[1]] = n
        before = r, i
    out = []
    low, high = (borders[part - 1] if part else None), (borders[part] if part < len(borders) else None)
    for name, (strings, _, marks), found in zip(names, opened, best):
        marks = np.array(marks, np.int64)
        twice = np.flatnonzero(marks & 1)
        found[twice] = [len(strings[i]) for i in twice]
        bound = found.copy()
        for edge, order in ((low, range(len(strings))), (high, range(len(strings) - 1, -1, -1))):
            for i in order if edge is not None else ():
                n = common(edge, strings[i], 0)
                if n < 8:  # strings further inside share less
                    bound[i] = max(bound[i], n)
                    break
                bound[i] = max(bound[i], n)
        bound = np.maximum(bound, 8)
        out.append(ex.row(0, name, REACH, pack(marks >> 1), pack(found), pack(bound)))
    return pa.Table.from_batches([ex.to_arrow(out)])


# Texts to stretches and cuts


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors that lie within one text of a block."""
    hashes = Rolling(byte_values(data)).windows(GRAM)
    at = np.flatnonzero(hashes % np.uint64(EVERY) == 0)
    at = at[at + GRAM <= offsets[np.searchsorted(offsets, at, side="right")]]
    return at, hashes[at]


def _cuts(hashes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(hashes % np.uint64(CUT_EVERY) == 1)


def _fill(hashes: np.ndarray, cuts: np.ndarray, start: int, end: int) -> list[int]:
    """More cuts where the next one is far: each time the last place of the least hash among the next ones.

    Text that repeats itself with a period may hold no cut at all. These places only serve to prove matches.
    """
    out, at = [], start
    for stop in [*cuts.tolist(), end]:
        while stop - at > 2 * CUT_EVERY:
            ahead = hashes[at + 1:min(at + 1 + CUT_EVERY, stop)]
            at += len(ahead) - int(np.argmin(ahead[::-1]))
            out.append(at)
        at = stop
    return out


def _stretches(offsets, unique, length) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the maximal stretches whose windows hold no anchor that occurs once."""
    starts = np.sort(np.concatenate([offsets[:-1], unique + 1]))
    ends = np.sort(np.concatenate([offsets[1:], unique + GRAM - 1]))
    long = ends - starts >= length
    starts, ends = starts[long], ends[long]
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def stretch_strings(text: bytes, cuts: list[int], more: list[int], length: int, ways: tuple[int, ...] = (0, 1)):
    """(place, direction, whether a cut, string) of one stretch: cut to next cut and a window, both ways."""
    n = len(text)
    back, sure = text[::-1], set(cuts)
    inner = sorted({c for c in (*cuts, *more) if 0 < c < n})
    places = [0, *inner] if 0 in ways else []
    for i, c in enumerate(places):
        stop = places[i + 1] + length if i + 1 < len(places) else n
        yield c, 0, c in sure, b"\0" + text[c:stop]
    ends = [*inner, n]
    for i, c in enumerate(ends if 1 in ways else []):
        start = max(ends[i - 1] - length, 0) if i else 0
        yield c, 1, c in sure, b"\1" + back[n - c:n - start]


def _sample(docs: DataFrame, parts: int, length: int) -> list[bytes]:
    """Range borders from strings at random places of a bounded sample of texts."""
    n = docs.count()
    wanted = SAMPLES * parts
    some = docs.select("text") if n <= wanted else docs.select("text").sample(min(1.0, 1.5 * wanted / n), seed=7)

    def strings(stream):
        random = np.random.default_rng(7)
        for rows in stream:
            data, offsets = buffers(rows.column("text"))
            out = []
            for i in range(len(offsets) - 1):
                text = data[offsets[i]:offsets[i + 1]].tobytes()
                if len(text) >= length:
                    at = int(random.integers(0, len(text) - 64))
                    out += [b"\0" + text[at:at + 64], b"\1" + text[at:at + 64][::-1]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["s"])

    found = sorted(bytes(r["s"]) for r in some.mapInArrow(strings, "s binary").limit(4 * wanted).collect())
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def dedup(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", parts: int | None = None,
          with_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Strings lie within one text, may overlap, and are judged on the input. Returns ``doc_id, n_bytes, n_removed,
    n_spans`` (maximal removed runs) and ``kept_sha256`` of the remaining bytes, which ``with_text`` adds as binary
    ``kept``. Null texts are empty; texts shorter than ``length`` are kept. Rows that repeat an id or have none
    are documents of their own. Other columns of the input are not read. ``length`` is at least 128.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    rows, own_ids = keyed(docs, key, text)
    parts = parts or ex.parts_of(docs)
    borders = _sample(rows, parts, length)

    def digests(keys, data, offsets):
        raw = data.tobytes()
        long = np.flatnonzero(np.diff(offsets) >= length)
        found = [hashlib.blake2b(raw[offsets[i]:offsets[i + 1]], digest_size=16).digest() for i in long.tolist()]
        pairs = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        return (pairs[:, 0].copy(), (pairs[:, 1] >> np.uint64(32)).astype(np.uint32), keys[long],
                np.zeros(len(long), np.int64))

    def cut_up(batch, pieces, answers):
        """Stretches of the batch and the sorted runs of their strings, one for each direction."""
        shared, copies = ex.known(answers), ex.FirstIndex(answers)
        whole, kept, places, cut_at, out, entries, count = [], [], [], [], [], [], 0
        for piece in pieces:
            keys, data, offsets = ex.open_payload(piece["a"], piece["b"], piece["c"])
            first, check, long, _ = digests(keys, data, offsets)
            at = copies.find(first, check)
            whole.append(long[at >= 0])
            passed_on = set(long[at >= 0][copies.keys[at[at >= 0]] != long[at >= 0]].tolist())
            anchors, hashes = _anchors(data, offsets)
            text_of, starts, ends = _stretches(offsets, anchors[~ex.among(hashes, shared)], length)
            grams = Rolling(byte_values(data)).windows(CUT_GRAM) if len(starts) else np.zeros(0, np.uint64)
            cuts = _cuts(grams)
            raw = data.tobytes()
            for t, s, e in zip(text_of.tolist(), starts.tolist(), ends.tolist()):
                if int(keys[t]) in passed_on:
                    continue
                inside = cuts[np.searchsorted(cuts, s):np.searchsorted(cuts, e - CUT_GRAM, side="right")]
                body = raw[s:e]
                places.append((int(keys[t]), s - int(offsets[t]), e - s))
                kept.append(body)
                more = _fill(grams, inside, s, e - CUT_GRAM)
                cut_at.append(((inside - s).tolist(), [c - s for c in more]))
        # Strings hold a text several times over: those of one direction are gone before the other's are made
        for way in (0, 1):
            strings: dict[bytes, list[int]] = {}
            return_freed_memory()
            for number, (body, (cuts, more)) in enumerate(zip(kept, cut_at)):
                for at_, _, sure, string in stretch_strings(body, cuts, more, length, (way,)):
                    have = strings.setdefault(string, [count + len(strings), 0])
                    have[1] += 1
                    entries.append((number, at_, way * 2 + sure, have[0]))
            out += run_rows(batch, strings, borders)
            count += len(strings)
        out.append(ex.row(0, batch, WHOLE, pack(np.concatenate(whole))))
        if places:
            out.append(ex.row(0, batch, RANGES, zstandard.ZstdCompressor(level=1).compress(b"".join(kept)),
                              pack(np.array(places, np.int64)), pack(np.array(sorted(entries), np.int64))))
        return pa.Table.from_batches([ex.to_arrow(out)])

    def weigh(table):
        """Windows proven by the reach of a match, those left open, and the hashes of both."""
        return_freed_memory()
        rows_ = table.to_pylist()
        batch = rows_[0]["batch"]
        ranges = [r for r in rows_ if r["kind"] == RANGES]
        if not ranges:
            return pa.Table.from_batches([ex.to_arrow([])])
        text = zstandard.ZstdDecompressor().decompress(ranges[0]["a"])
        places = unpack(ranges[0]["b"], np.int64).reshape(-1, 3)
        entries = unpack(ranges[0]["c"], np.int64).reshape(-1, 4)
        reach = np.zeros((int(entries[:, 3].max()) + 1, 2), np.int64)
        for r in rows_:
            if r["kind"] == REACH:
                # The first byte of a string only tells its direction
                reach[unpack(r["a"], np.int64)] = np.stack([unpack(r["b"], np.int64), unpack(r["c"], np.int64)], 1) - 1
        bounds = np.searchsorted(entries[:, 0], np.arange(len(places) + 1))
        proven, left, hashes, at = [], [], {True: [], False: []}, 0
        for number, (doc, start, n) in enumerate(places.tolist()):
            yes, no = decide(n, entries[bounds[number]:bounds[number + 1]], reach, length)
            for found, mask in ((proven, yes), (left, ~yes & ~no)):
                for a, b in zip(*runs_of(mask)):
                    found.append((doc, start + a, b - a, at + a))
                    hashes[found is left].append(window_hashes(text, at + a, b - a, length))
            at += n
        out = []
        for open_, found in hashes.items():
            for r in ex.scatter(batch, np.concatenate(found), parts) if found else []:
                out.append(ex.row(r[0], batch, LEFT if open_ else PROVEN, *r[3:]))
        for kind, found in ((PROVEN, proven), (LEFT, left)):
            if found:
                out.append(ex.row(-1, batch, kind, pack(np.array(found, np.int64))))
        return pa.Table.from_batches([ex.to_arrow(out)])

    def line_up(table):
        """Of the open windows, and the proven ones like them, those whose hash occurs twice, as a sorted run."""
        return_freed_memory()
        by = {kind: [r for r in table.to_pylist() if r["kind"] == kind] for kind in (RANGES, PROVEN, LEFT, 1)}
        if not by[1]:
            return pa.Table.from_batches([ex.to_arrow([])])
        batch = by[1][0]["batch"]
        text = zstandard.ZstdDecompressor().decompress(by[RANGES][0]["a"])
        twice = ex.known(by[1])
        strings, open_at = {}, []
        for kind in (LEFT, PROVEN):
            for doc, place, n, at in unpack(by[kind][0]["a"], np.int64).reshape(-1, 4).tolist() if by[kind] else []:
                for i in np.flatnonzero(ex.among(window_hashes(text, at, n, length), twice)).tolist():
                    have = strings.setdefault(text[at + i:at + i + length], [len(strings), 0])
                    have[1] += 1
                    if kind == LEFT:
                        open_at.append((doc, place + i, have[0]))
        out = run_rows(batch, strings, plain_borders)
        out.append(ex.row(-1, batch, OPEN, pack(np.array(open_at, np.int64))))
        return pa.Table.from_batches([ex.to_arrow(out)])

    def merge_open(table):
        out = merge_range(table, plain_borders).to_pylist()
        rows_ = [ex.row(0, r["batch"], REPEATED, pack(unpack(r["a"], np.int64)[unpack(r["b"], np.int64) >= length]))
                 for r in out]
        return pa.Table.from_batches([ex.to_arrow(rows_)])

    def remove(batch, pieces, answers):
        by = {kind: [r for r in answers if r["kind"] == kind] for kind in (WHOLE, PROVEN, OPEN, REPEATED)}
        whole = set(np.concatenate([unpack(r["a"], np.int64) for r in by[WHOLE]] or [np.zeros(0)]).tolist())
        found = [unpack(r["a"], np.int64).reshape(-1, 4)[:, :3] for r in by[PROVEN]]
        found = [np.stack([f[:, 0], f[:, 1], f[:, 1] + f[:, 2]], 1) for f in found]
        if by[OPEN]:
            repeated = np.concatenate([unpack(r["a"], np.int64) for r in by[REPEATED]] or [np.zeros(0, np.int64)])
            left = unpack(by[OPEN][0]["a"], np.int64).reshape(-1, 3)
            left = left[np.isin(left[:, 2], repeated)]
            found.append(np.stack([left[:, 0], left[:, 1], left[:, 1] + 1], 1))
        found = np.concatenate(found or [np.zeros((0, 3), np.int64)])
        found = found[np.argsort(found[:, 0], kind="stable")]
        columns = [[] for _ in range(6)]
        for piece in pieces:
            keys, data, offsets = ex.open_payload(piece["a"], piece["b"], piece["c"])
            raw = data.tobytes()
            lo, hi = np.searchsorted(found[:, 0], keys), np.searchsorted(found[:, 0], keys, side="right")
            for i, doc in enumerate(keys.tolist()):
                body = raw[offsets[i]:offsets[i + 1]]
                n, removed, spans = len(body), 0, 0
                if doc in whole:
                    removed, spans, body = n, 1, b""
                elif hi[i] > lo[i]:
                    depth = np.zeros(n + 1, np.int32)
                    np.add.at(depth, found[lo[i]:hi[i], 1], 1)
                    np.add.at(depth, found[lo[i]:hi[i], 2] - 1 + length, -1)
                    gone = np.cumsum(depth[:n]) > 0
                    removed, spans = int(gone.sum()), len(runs_of(gone)[0])
                    body = data[offsets[i]:offsets[i + 1]][~gone].tobytes()
                for column, value in zip(columns, (doc, n, removed, spans, hashlib.sha256(body).hexdigest(), body)):
                    column.append(value)
        names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        size = 6 if with_text else 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns[:size], kinds)], names=names[:size])

    plain_borders = [b[1:] for b in borders if b[:1] == b"\0"]
    texts = ex.payloads(rows)
    answers = ex.shared_hashes(rows, lambda keys, data, offsets: _anchors(data, offsets)[1], parts, digests)
    sent = materialise(ex.meet(texts, answers, cut_up, ex.ROWS), "suffix-runs")
    reach = (sent.filter(F.col("kind") == RUN).groupBy("part")
             .applyInArrow(lambda table: merge_range(table, borders), ex.ROWS))
    stretches = sent.filter(F.col("kind") == RANGES)
    weighed = materialise(stretches.unionByName(reach).groupBy("batch").applyInArrow(weigh, ex.ROWS), "suffix-open")
    twice = weighed.filter("part >= 0").groupBy("part").applyInArrow(settle_open, ex.ROWS)
    left = weighed.filter("part < 0").unionByName(stretches).unionByName(twice)
    lined = materialise(left.groupBy("batch").applyInArrow(line_up, ex.ROWS), "suffix-windows")
    repeated = lined.filter(F.col("kind") == RUN).groupBy("part").applyInArrow(merge_open, ex.ROWS)
    facts = (weighed.filter((F.col("kind") == PROVEN) & (F.col("part") < 0)).unionByName(sent.filter(F.col("kind") == WHOLE))
             .unionByName(lined.filter(F.col("kind") == OPEN)).unionByName(repeated))
    out = ex.meet(texts, facts, remove, SCHEMA + (", kept binary" if with_text else ""))
    return restore(rows, own_ids, out)


def settle_open(table: pa.Table) -> pa.Table:
    """One hash range of windows: for every batch, its hashes that occur twice and are open somewhere."""
    return_freed_memory()
    names, kinds = table.column("batch").to_pylist(), table.column("kind").to_numpy()
    lists = [unpack_sorted(x) for x in table.column("a").to_pylist()]
    many = np.concatenate([np.unpackbits(unpack(x, np.uint8))[:len(v)] for x, v in
                           zip(table.column("b").to_pylist(), lists)])
    _, group = np.unique(np.concatenate(lists), return_inverse=True)
    open_ = np.repeat(kinds == LEFT, [len(v) for v in lists])
    wanted = (np.bincount(group, weights=open_) > 0) & (np.bincount(group, weights=many + 1) > 1)
    out, at = [], 0
    for name, own in zip(names, lists):
        found = own[wanted[group[at:at + len(own)]]]
        at += len(own)
        if len(found):
            out.append(ex.row(0, name, 1, pack_sorted(found)))
    return pa.Table.from_batches([ex.to_arrow(out)])


def window_hashes(text: bytes, at: int, n: int, length: int) -> np.ndarray:
    """Hashes of n windows of a text from one place on."""
    return Rolling(byte_values(np.frombuffer(text, np.uint8, n + length - 1, at))).windows(length)


def decide(n: int, entries: np.ndarray, reach: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a stretch of n bytes that are proven to repeat, and those that are ruled out."""
    windows = n - length + 1
    yes, no = np.zeros(windows + 1, np.int32), np.zeros(windows + 1, np.int32)
    for place, kind, number in entries[:, 1:].tolist():
        found, bound = reach[number]
        if kind < 2:
            a, b = place, place + found - length
            # A window that holds the bytes which make the cut and ends beyond the best match can't repeat
            c, d = max(place + bound - length + 1, place - length + CUT_GRAM), place
        else:
            a, b = place - found, place - length
            c, d = place - length + CUT_GRAM, min(place - bound - 1, place)
        for marks, x, y, sure in ((yes, a, b, True), (no, c, d, kind & 1)):
            x, y = max(x, 0), min(y, windows - 1)
            if sure and x <= y:
                marks[x] += 1
                marks[y + 1] -= 1
    return np.cumsum(yes[:windows]) > 0, np.cumsum(no[:windows]) > 0
