"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

The pieces of a vocabulary that match a text form a lattice; a segmentation is a path through it, with a probability
proportional to the product of its pieces' weights. Gumbel top-k sampling gives every path a perturbed log probability
and returns the k best, which are k distinct paths drawn without replacement. In the equivalent language of
arrival times (exp of minus the perturbed value) a path arrives after an exponential time with its probability as the
rate. The search is A* from the root: a set of paths with a common beginning arrives when its first path does; the
child that holds that path is drawn by probability, and by lack of memory each other child arrives an exponential time
later, with its own probability as the rate. The earliest open child is expanded next.

Paths never cross the space that begins a word, so the lattice of each distinct word is built once per block, for all
words at a time, and all words of a block advance together, piece by piece. Children far along a path have rates so
small that even the smallest possible draw comes too late; they are not looked at.

All draws are hashes of (row key, number of the path, place), so a row's result depends on nothing else.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelcast.llm.common import Rolling, U, keyed, mix, restore, return_freed_memory

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Weight of a byte of a character that the vocabulary lacks
BYTE_LOG = -12.0
#: Characters of one block
BLOCK = 3 << 15
#: Rows decoded together
DECODED = 256
#: No draw is smaller than exp(-37)
SMALLEST = -37.0
#: Log arrival before which the children that go on come, but in rare texts
SOON = 8.0


class Vocabulary:
    """Pieces with a space for the word mark, their log weights, and the ids of the 256 bytes."""

    def __init__(self, pieces: list[str], logs: np.ndarray, bytes_: np.ndarray, normal: np.ndarray):
        self.raw = [p.encode() for p in pieces]
        for b, i in enumerate(bytes_.tolist()):
            self.raw[i] = bytes([b])
        self.logs, self.bytes = logs, bytes_
        known = [i for i in np.flatnonzero(normal).tolist()]
        self.longest = max(len(pieces[i]) for i in known)
        joined = Rolling(mix(_codes("".join(pieces[i] for i in known)).astype(U)))
        lengths = np.array([len(pieces[i]) for i in known])
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        hashes = joined.slices(start, start + lengths)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(known)[order]
        #: Place of a piece by the first bits of its hash; -1 for none, -2 where several have the same
        first = (self.hashes >> U(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[first] = np.arange(len(first))
        self.slot[first[1:][first[1:] == first[:-1]]] = -2
        #: By length, the first bits of the hashes of all beginnings of longer pieces
        self.begins = np.zeros((self.longest + 1, 1 << 18), bool)
        for size in range(1, self.longest):
            own = start[lengths > size]
            self.begins[size, (joined.slices(own, own + size) >> U(46)).astype(np.int64)] = True
        self.sizes = np.array([len(r) for r in self.raw])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.data = np.frombuffer(b"".join(self.raw), np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def load(model: str = MODEL) -> tuple:
    """The vocabulary of a SentencePiece model. A merge vocabulary's scores are ranks; a piece weighs 1 / (rank + 2)."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    n = processor.get_piece_size()
    pieces = [processor.id_to_piece(i).replace("▁", " ") for i in range(n)]
    scores = np.array([processor.get_score(i) for i in range(n)])
    byte = np.array([processor.is_byte(i) for i in range(n)])
    normal = ~(byte | np.array([processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)
                                for i in range(n)]))
    ids = np.zeros(256, np.int64)
    for i in np.flatnonzero(byte).tolist():
        ids[int(pieces[i][3:5], 16)] = i
    ranks = scores[normal].max() == 0 or scores[normal].min() < -1000
    return pieces, -np.log(2 - scores) if ranks else scores, ids, normal


class Lattice:
    """All lattices of a list of distinct words. State ``base[w] + i`` is place i of word w."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary):
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.base = first[:-1] + np.arange(len(sizes))
        self.last = self.base + sizes
        place = np.arange(len(codes))
        unit = np.repeat(np.arange(len(sizes)), sizes)
        state, left = place + unit, first[1:][unit] - place
        rolling = Rolling(mix(codes.astype(U)))
        src, dst, ids, logs = [], [], [], []
        single = np.zeros(len(codes), bool)
        alive = place
        for size in range(1, vocabulary.longest + 1):
            at = alive[left[alive] >= size]
            if not len(at):
                break
            h = rolling.slices(at, at + size)
            alive = at[vocabulary.begins[size, (h >> U(46)).view(np.int64)]]
            k = vocabulary.slot[(h >> U(44)).view(np.int64)]
            maybe = np.flatnonzero(k != -1)
            at, h, k = at[maybe], h[maybe], k[maybe].astype(np.int64)
            several = np.flatnonzero(k < 0)
            k[several] = np.minimum(np.searchsorted(vocabulary.hashes, h[several]), len(vocabulary.hashes) - 1)
            hit = np.flatnonzero(vocabulary.hashes[k] == h)
            at, piece = at[hit], vocabulary.ids[k[hit]]
            if size == 1:
                single[at] = True
            src.append(state[at])
            dst.append(state[at] + size)
            ids.append(piece)
            logs.append(vocabulary.logs[piece])
        # A character without a piece is spelt in bytes; its arc is named by its code
        rare = np.flatnonzero(~single)
        code = codes[rare].astype(np.int64)
        src.append(state[rare])
        dst.append(state[rare] + 1)
        ids.append(-1 - code)
        logs.append(BYTE_LOG * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)))
        src, dst, ids, logs = (np.concatenate(x) for x in (src, dst, ids, logs))
        order = np.argsort(src, kind="stable")
        src, self.dst, self.ids, logs = src[order], dst[order], ids[order], logs[order]
        n = len(codes) + len(sizes)
        self.src = src
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        # Log of the summed weights from each state to its word's end, from the ends backwards
        total = np.zeros(n)
        distance = np.repeat(self.last, sizes + 1) - np.arange(n)
        if len(sizes) and sizes.max() < 1 << 16:
            distance = distance.astype(np.uint16)  # numbers of two bytes are sorted in linear time
        by, of_arc = np.argsort(distance, kind="stable"), distance[src]
        arcs = np.argsort(of_arc, kind="stable")
        weights, ahead = logs[arcs], self.dst[arcs]
        steps, ends = (np.cumsum(np.bincount(d, minlength=int(sizes.max(initial=0)) + 1)) for d in (distance, of_arc))
        counts = np.diff(self.ptr)[by]
        begins = np.cumsum(counts) - counts
        for a, b, p, q in zip(steps[:-1].tolist(), steps[1:].tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            begin = begins[a:b] - p
            value = weights[p:q] + total[ahead[p:q]]
            top = np.maximum.reduceat(value, begin)
            total[by[a:b]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts[a:b])), begin))
        self.logp = logs + total[self.dst] - total[src]
        cumulated = np.cumsum(np.exp(self.logp))
        before = np.concatenate([[0], cumulated])[self.ptr[src]]
        self.upto = cumulated - before
        self.upto[self.ptr[1:][self.ptr[1:] > self.ptr[:-1]] - 1] = 2.0  # the last arc takes what is left

    def walk(self, states: np.ndarray, ends: np.ndarray, seeds: np.ndarray):
        """Draw a path from each state to its end: arcs per walker, and all arcs in order."""
        n = len(states)
        walkers, step, found = np.arange(n), 0, []
        active = states < ends
        walkers, states, seeds = walkers[active], states[active], seeds[active]
        ends = ends[active]
        while len(walkers):
            draw = uniform(seeds + U(step * 0x2545F4914F6CDD1D % 2 ** 64))
            arcs = self.ptr[states]
            below = np.flatnonzero(self.upto[arcs] < draw)
            while len(below):
                arcs[below] += 1
                below = below[self.upto[arcs[below]] < draw[below]]
            found.append((walkers, np.full(len(walkers), step), arcs))
            states = self.dst[arcs]
            on = np.flatnonzero(states < ends)
            walkers, states, ends, seeds = walkers[on], states[on], ends[on], seeds[on]
            step += 1
        if not found:
            return np.zeros(n, np.int64), np.zeros(0, np.int64)
        walkers, steps, arcs = (np.concatenate(x) for x in zip(*found))
        taken = np.bincount(walkers, minlength=n)
        at = (np.cumsum(taken) - taken)[walkers] + steps
        out = np.empty(len(arcs), arcs.dtype)
        out[at] = arcs
        return taken, out


def split(texts: list[str], vocabulary: Vocabulary):
    """Words of all texts as numbers of distinct ones, where each text's words begin, and the distinct ones' lattice.

    A word begins with the spaces before it; a space is put before each text.
    """
    codes = _codes("".join(" " + t for t in texts if t))
    sizes = np.array([len(t) + 1 if t else 0 for t in texts])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    space = codes == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][sizes > 0]] = True
    start = np.flatnonzero(begins)
    bounds = np.searchsorted(start, offsets)
    if not len(start):
        return start, bounds, None
    end = np.append(start[1:], len(codes))
    _, at, flat = np.unique(Rolling(mix(codes.astype(U))).slices(start, end), return_index=True, return_inverse=True)
    lengths = (end - start)[at]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    chars = np.repeat(start[at] - begin, lengths) + np.arange(int(lengths.sum()))
    return flat, bounds, Lattice(codes[chars], lengths, vocabulary)


def uniform(seeds: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit seeds."""
    return ((mix(seeds) >> U(12)).astype(np.float64) + 0.5) * 2.0 ** -52


def _children(lattice, arcs, text_of, step, logp_before, arrival_log, salt):
    """Other children beside the given steps of paths: (step's place, arc, log probability, log arrival)."""
    state = lattice.src[arcs]
    counts = lattice.ptr[state + 1] - lattice.ptr[state]
    owner = np.repeat(np.arange(len(arcs)), counts)
    other = np.repeat(lattice.ptr[state] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    real = np.flatnonzero(other != arcs[owner])
    owner, other = owner[real], other[real]
    logp = logp_before[owner] + lattice.logp[other]
    text_of = text_of[owner]
    seeds = salt[text_of] + step[owner].astype(U) * U(0xD1342543DE82EF95) + other_rank(lattice, other)
    late = np.log(-np.log(uniform(mix(seeds)))) - logp
    return owner, other, logp, np.logaddexp(arrival_log[text_of], late)


def _earliest(when: np.ndarray, first: int, end: int, n: int) -> np.ndarray:
    """Places of the n smallest values from ``first`` to ``end``, smallest first, equal ones in their order."""
    own = when[first:end]
    if len(own) > n:
        some = np.flatnonzero(own <= np.partition(own, n - 1)[n - 1])
        return first + some[np.argsort(own[some], kind="stable")[:n]]
    return first + np.argsort(own, kind="stable")


def other_rank(lattice, arcs):
    """Number of an arc among those of its state; it doesn't depend on the block."""
    return (arcs - lattice.ptr[lattice.src[arcs]] + 1).astype(U) * U(0xA0761D6478BD642F)


def sample_block(keys: np.ndarray, texts: list[str], samples: int, vocabulary: Vocabulary):
    """For each text and rank: (text, rank, ids, log probability, log arrival, log inclusion)."""
    n = len(texts)
    flat, bounds, lattice = split(texts, vocabulary)
    text_of_word = np.repeat(np.arange(n), np.diff(bounds))
    order_in_text = np.arange(len(flat)) - bounds[:-1][text_of_word]
    seed = mix(keys.astype(np.int64).view(U) + U(0x632BE59BD9B4E019))
    arrival = np.log(-np.log(uniform(seed + U(1))))
    open_: list[list] = [[] for _ in range(n)]  # children not expanded: (log arrival, path, step, arc, log probability)
    paths: list[list] = [[] for _ in range(n)]  # per path: its arcs, the word of each, log probability, arrival
    start_word, start_state = bounds[:-1].copy(), np.full(n, -1, np.int64)
    heads: list = [None] * n
    live = np.ones(n, bool)
    for rank in range(samples):
        salt = mix(seed + U((rank + 2) * 0x9E3779B97F4A7C15 % 2 ** 64))
        wanted = np.flatnonzero(live[text_of_word] & (np.arange(len(flat)) >= start_word[text_of_word]))
        arcs, cut = np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        if len(wanted):
            states = lattice.base[flat[wanted]]
            resumed = np.flatnonzero((start_state[text_of_word[wanted]] >= 0)
                                     & (wanted == start_word[text_of_word[wanted]]))
            states[resumed] = start_state[text_of_word[wanted[resumed]]]
            seeds = mix(salt[text_of_word[wanted]] + order_in_text[wanted].astype(U) * U(0x94D049BB133111EB))
            taken, arcs = lattice.walk(states, lattice.last[flat[wanted]], seeds)
            ends_of = np.concatenate([[0], np.cumsum(taken)])
            cut = ends_of[np.searchsorted(wanted, bounds)]
        base = np.array([h[2] if h else 0.0 for h in heads])
        offset = np.array([len(h[0]) if h else 0 for h in heads])
        running = np.concatenate([[0.0], np.cumsum(lattice.logp[arcs])]) if len(arcs) else np.zeros(1)
        total = base + running[cut[1:]] - running[cut[:-1]]
        todo = np.flatnonzero(live)
        # Steps whose other children can matter: the path up to there isn't too improbable. A child further along arrives
        # after ``late``, so if enough of a text's children arrive before that, the shorter reach has lost none
        for late in (SOON, -SMALLEST):
            far = np.searchsorted(-running, late - SMALLEST + base - running[cut[:-1]], side="left")
            sizes = np.clip(np.minimum(far, cut[1:]) - cut[:-1], 0, None)
            text_of = np.repeat(np.arange(n), sizes)
            inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            near = cut[:-1][text_of] + inner
            few = {}
            if len(near):
                step = inner + offset[text_of]
                owner, other, logp, when = _children(lattice, arcs[near], text_of, step, base[text_of] + running[near]
                                                     - running[cut[:-1]][text_of], arrival, salt)
                edge = np.searchsorted(text_of[owner], np.arange(n + 1)).tolist()
                # More than the samples still to come are never needed
                few = {t: _earliest(when, edge[t], edge[t + 1], samples - rank) for t in todo.tolist() if edge[t] < edge[t + 1]}
            short = np.flatnonzero(far < cut[1:]).tolist()
            if all(t in few and len(few[t]) == samples - rank and when[few[t][-1]] < late for t in short if live[t]):
                break
        word = wanted[np.searchsorted(ends_of, near, side="right") - 1] if len(near) else near
        begin = np.cumsum(sizes) - sizes
        for t in todo.tolist():
            prefix, words_before = heads[t][:2] if heads[t] else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            own_words = word[begin[t]:begin[t] + sizes[t]]
            paths[t].append((np.concatenate([prefix, arcs[cut[t]:cut[t + 1]]]),
                             np.concatenate([words_before, own_words]), total[t], arrival[t]))
        for t, own in few.items():
            open_[t] += zip(when[own].tolist(), [rank] * samples, step[owner[own]].tolist(), other[own].tolist(),
                            logp[own].tolist())
        for t in todo.tolist():
            if not open_[t]:
                live[t] = False
                continue
            open_[t].sort()
            arrival[t], path, at, arc, logp = open_[t][0]
            if rank + 1 < samples:
                del open_[t][0]
                own, words_of = paths[t][path][:2]
                heads[t] = np.append(own[:at], arc), np.append(words_of[:at], words_of[at]), logp
                start_word[t], start_state[t] = words_of[at], lattice.dst[arc]
    out = []
    for t in range(n):
        # The arrival of the first path that is not in the sample; none if these are all
        limit = open_[t][0][0] if open_[t] else np.inf
        for rank, (arcs, _, logp, when) in enumerate(paths[t]):
            inclusion = 0.0 if limit == np.inf else _log_inclusion(logp + limit)
            out.append((t, rank + 1, arcs, logp, when, inclusion))
    return lattice, out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))"""
    return float(np.log(-np.expm1(-np.exp(min(x, 50.0))))) if x > -30 else float(x)


def spell(ids: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Arc names to piece ids, and how many each became: characters without a piece become the ids of their bytes."""
    sizes = np.ones(len(ids), np.int64)
    rare = np.flatnonzero(ids < 0)
    if not len(rare):
        return ids.astype(np.int32), sizes
    spelt = [chr(-1 - c).encode() for c in ids[rare].tolist()]
    sizes[rare] = [len(s) for s in spelt]
    out = np.repeat(ids, sizes)
    out[out < 0] = vocabulary.bytes[np.frombuffer(b"".join(spelt), np.uint8)]
    return out.astype(np.int32), sizes


def _pieces_of_rows(stream, limit):
    for rows in stream:
        keys, texts = rows.column("key").to_numpy(), rows.column("text").to_pylist()
        first, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= limit:
                yield keys[first:i + 1], texts[first:i + 1]
                first, size = i + 1, 0
        if first < len(texts):
            yield keys[first:], texts[first:]


def _batch(keys: np.ndarray, texts: list[str], samples: int, vocabulary: Vocabulary, names: list[str]) -> pa.RecordBatch:
    """The result rows of one block; its lattice is gone before the next block begins."""
    lattice, found = sample_block(keys, texts, samples, vocabulary)
    arcs = np.concatenate([np.zeros(0, np.int64), *[path[2] for path in found]])
    ids, sizes = spell(lattice.ids[arcs] if len(arcs) else arcs, vocabulary)
    ends = np.append(0, np.cumsum(sizes))[np.cumsum([0] + [len(path[2]) for path in found])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
    little = ids.astype("<i4", copy=False)
    # The very lists that are returned are decoded, by what ``decode`` uses
    back = decode_lists(lists, vocabulary)
    text, rank, _, logp, when, inclusion = zip(*found)
    columns = {
        "key": pa.array(keys[list(text)], pa.int64()), "rank": pa.array(rank, pa.int32()),
        "n_pieces": pa.array(np.diff(ends), pa.int64()), "log_prob": pa.array(logp, pa.float64()),
        "log_arrival": pa.array(np.array(when, float), pa.float64()), "log_inclusion": pa.array(inclusion, pa.float64()),
        "ids_sha256": pa.array([hashlib.sha256(little[a:b]).hexdigest() for a, b in pairwise(ends.tolist())], pa.string()),
        "exact": pc.equal(back, pa.array(texts, pa.large_string()).take(pa.array(text))), "ids": lists}
    if "decoded_sha256" in names:
        columns["decoded_sha256"] = pa.array([hashlib.sha256(x.as_buffer()).hexdigest()
                                              for x in back.cast(pa.large_binary())], pa.string())
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def encode(docs: DataFrame, samples: int = 2, model: str = MODEL, key: str = "doc_id", text: str = "text",
           with_ids: bool = True, block: int = BLOCK, with_text_hash: bool = False) -> DataFrame:
    """``doc_id, rank, n_pieces, log_prob, log_arrival, log_inclusion, ids_sha256, exact`` and, on request, ``ids``
    and ``decoded_sha256``, the hash of the text that the ids decode to.

    ``samples`` distinct segmentations of each whole text in the order of their perturbed probability, fewer where a
    text has fewer. ``log_prob`` is the log probability of the segmentation under the lattice, ``log_inclusion`` the log of
    the probability that a segmentation as likely as it gets into the sample. ``exact`` says that the ids decode to the
    text. Null texts are empty; an empty text has one segmentation, of no pieces. The draws depend on the row's id
    only: rows that repeat an id or have none are numbered by (id, text) first. Other columns are not read. About
    ``block`` characters are searched at a time, which bounds the memory of a task but for a single longer text.
    """
    rows, own_ids = keyed(docs, key, text)
    content = load(model)
    schema = SCHEMA + ["ids array<int>"] * with_ids + ["decoded_sha256 string"] * with_text_hash
    names = [c.split()[0] for c in schema]

    def sampled(stream):
        return_freed_memory()
        vocabulary = Vocabulary(*content)
        for keys, texts in _pieces_of_rows(stream, block):
            yield _batch(keys, texts, samples, vocabulary, names)

    return restore(rows, own_ids, rows.select("key", "text").mapInArrow(sampled, ", ".join(schema)))


SCHEMA = ["key long", "rank int", "n_pieces long", "log_prob double", "log_arrival double", "log_inclusion double",
          "ids_sha256 string", "exact boolean"]


def decode_lists(column: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """Texts of a column of id lists, all lists at once: no id becomes a Python object."""
    ids = column.flatten().to_numpy().astype(np.int64)
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = vocabulary.sizes[ids]
    ends = np.cumsum(sizes)
    at = np.repeat(vocabulary.starts[ids] - (ends - sizes), sizes)
    at += np.arange(len(at))
    body = vocabulary.data[at]
    cuts = np.append(0, ends)[np.append(0, np.cumsum(counts))]
    # The first byte of a text is the space put before it
    kept = np.ones(len(body), bool)
    kept[cuts[:-1][counts > 0]] = False
    offsets = np.append(0, np.cumsum(np.diff(cuts) - (counts > 0)))
    known = column.is_valid()
    texts = pa.Array.from_buffers(pa.large_binary(), len(column), [
        None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(body[kept].tobytes())])
    try:
        spelt = texts.cast(pa.large_string())
    except pa.ArrowInvalid:  # ids that no text has
        spelt = pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())
    return pc.if_else(known, spelt, pa.scalar(None, pa.large_string()))


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "text", keep: bool = False) -> DataFrame:
    """Replace a column of ids by the text they spell; null ids stay null, no ids are an empty text.

    ``keep`` leaves the ids in place. Other columns pass through, whatever their names; one named ``to`` is replaced.
    """
    content = load(model)
    names = [c for c in encoded.columns if c != to and (keep or c != ids)]
    others = [c for c in names if c != ids]

    def decoded(stream):
        return_freed_memory()
        vocabulary = Vocabulary(*content)
        for rows in stream:
            own = rows.column(0)
            # A few rows at a time: the place of every byte is a number of eight bytes
            for first in range(0, rows.num_rows, DECODED):
                part = rows.slice(first, DECODED)
                yield pa.RecordBatch.from_arrays([*part.columns[0 if keep else 1:], decode_lists(
                    own.slice(first, DECODED), vocabulary).cast(pa.string())], names=passed + ["text"])

    # Numbered names, so that no name of the input can clash with one used here
    wanted = encoded.select(F.col(f"`{ids}`").alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    passed = wanted.columns[0 if keep else 1:]
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in wanted.schema.fields if f.name in passed)
    out = wanted.mapInArrow(decoded, f"{fields}text string")
    back = {**{f"c{i}": c for i, c in enumerate(others)}, "c": ids}
    out = out.toDF(*[back[c] for c in passed], to)
    return out.select(*[f"`{c}`" for c in names], f"`{to}`")
