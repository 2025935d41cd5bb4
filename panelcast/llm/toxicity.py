"""Toxicity by a weighted grammar over clauses, composed of small transducers.

Words are first mapped to classes: insults (learned words and word beginnings, each with its log odds), threats,
targets, negations, reports and modal verbs. Four deterministic transducers read the classes of a clause and
multiply the weight of each insult or threat: a negation shortly before weakens it, a verb of reporting weakens the rest
of the clause, a target shortly before strengthens it, and a threat counts in full only after a modal verb. Their
composition is one table. The scores of the matched clauses of a text, summed and the largest, are calibrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelcast.llm import labelled, logistic
from panelcast.llm.common import Rolling, blocks, buffers, byte_values, word_hashes

#: Bounds of the learning sample: rows by label, and the learned words and word beginnings
ROWS, LEXICON = {1: 4000, 0: 16000}, 5000
#: Bytes of the word beginnings that are learned beside whole words
BEGINNINGS = (4, 5, 6, 7)
#: Least likelihood ratio (about chi square) and log odds of a learned insult
EVIDENCE, ODDS = 20.0, 2.0
THRESHOLD = 0.5
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MODAL = range(7)

#: Words of the grammar by class
GRAMMAR = {
    THREAT: "kill hurt destroy beat burn punish töten schlagen tuer frapper matar golpear",
    TARGET: "you your they them their he him she her people dich du sie ihr toi vous eux tú ustedes ellos",
    NEGATION: "not no never nobody neither isn't aren't don't nicht kein nie pas jamais aucun nunca jamás",
    REPORT: "said says told called wrote reported quoted sagte schrieb dit écrit dijo escribió",
    MODAL: "will shall gonna must should werde wird soll vais va voy",
}
#: Weight of a threat, and the factors of the transducers
THREAT_WEIGHT, NEGATED, REPORTED, AIMED, BARE_THREAT = 3.0, 0.3, 0.5, 1.3, 0.2
#: Bytes of a word: letters and digits, the apostrophe, and all of UTF-8's longer characters
IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
IN_WORD[ord("'")] = True
ENDS_CLAUSE = np.isin(np.arange(256), [ord(c) for c in ".!?;:\n"])


class Transducer:
    """Deterministic: ``step[state][class]`` is the next state, ``factor[state][class]`` multiplies the weight."""

    def __init__(self, step: np.ndarray, factor: np.ndarray):
        self.step, self.factor = step, factor

    @classmethod
    def window(cls, opener: int, reach: int, inside: float, outside: float, on: tuple[int, ...]) -> Transducer:
        """A class opens a window of so many words; in and outside of it, weights of the classes ``on`` are scaled."""
        states = reach + 1
        step = np.repeat(np.maximum(np.arange(states) - 1, 0)[:, None], 7, axis=1)
        step[:, opener] = reach
        factor = np.ones((states, 7))
        for c in on:
            factor[:, c] = inside
            factor[0, c] = outside
        return cls(step, factor)

    @classmethod
    def rest(cls, opener: int, inside: float, on: tuple[int, ...]) -> Transducer:
        """As ``window``, up to the end of the clause."""
        step = np.array([[0] * 7, [1] * 7])
        step[0, opener] = 1
        factor = np.ones((2, 7))
        factor[1, list(on)] = inside
        return cls(step, factor)

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes; weights are multiplied."""
        n, m = len(self.step), len(other.step)
        step = (self.step[:, None, :] * m + other.step[None, :, :]).reshape(n * m, 7)
        factor = (self.factor[:, None, :] * other.factor[None, :, :]).reshape(n * m, 7)
        return Transducer(step, factor)

    def weigh(self, classes: list[int], weights: list[float]) -> float:
        """Score of a clause: the transduced weights of its words."""
        state, total = 0, 0.0
        for c, w in zip(classes, weights):
            if w:
                total += w * self.factor[state, c]
            state = self.step[state, c]
        return total


def grammar() -> Transducer:
    hits = (INSULT, THREAT)
    return (Transducer.window(NEGATION, 3, NEGATED, 1.0, hits)
            .compose(Transducer.rest(REPORT, REPORTED, hits))
            .compose(Transducer.window(TARGET, 4, AIMED, 1.0, hits))
            .compose(Transducer.window(MODAL, 3, 1.0, BARE_THREAT, (THREAT,))))


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words of a block, and where each text's words begin."""
    inside = np.concatenate([[False], IN_WORD[data], [False]])
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    filled = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][filled]] = IN_WORD[data[offsets[:-1][filled]]]
    last = offsets[1:][filled] - 1
    ends[last] = IN_WORD[data[last]]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; 0 where the word is shorter."""
    rolling = Rolling(byte_values(data))
    out = [rolling.slices(start, end)]
    for n in BEGINNINGS:
        out.append(np.where(end - start > n, rolling.slices(start, np.minimum(start + n, len(data))), np.uint64(0)))
    return out


def _fixed_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grammar's words, sorted, and their classes."""
    pairs = sorted((int(_hash_of(w)), c) for c, words in GRAMMAR.items() for w in words.split())
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Insults (hashes, log odds) and calibration weights from a bounded sample of labelled rows."""
    chosen, counts = labelled.sample(labels, target, ROWS)

    def occurrences(stream):
        """Texts of each label that hold a word or beginning, per task."""
        for rows in stream:
            data, offsets = buffers(pc.utf8_lower(rows.column("text")))
            label = rows.column("label").to_numpy()
            start, end, bounds = _tokens(data, offsets)
            text_of = np.repeat(np.arange(len(label)), np.diff(bounds))
            pairs = np.concatenate([np.stack([f, text_of.astype(np.uint64)], 1)[f != 0]
                                    for f in _features(data, start, end)] or [np.zeros((0, 2), np.uint64)])
            pairs = np.unique(pairs, axis=0)
            hashes, at = np.unique(pairs[:, 0], return_inverse=True)
            bad = np.bincount(at, weights=label[pairs[:, 1].astype(np.int64)], minlength=len(hashes)).astype(np.int64)
            n = np.bincount(at, minlength=len(hashes))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bad), pa.array(n - bad)],
                                             names=["h", "bad", "good"])

    half = {y: sum(1 for _, label, h in chosen if label == y and h == 0) for y in (0, 1)}
    hashes, odds = np.zeros(0, np.uint64), np.zeros(0)
    if half[0] and half[1]:
        base = half[1] / (half[0] + half[1])
        counted = (labelled.texts_of(docs, chosen, 0).select("text", "label")
                   .mapInArrow(occurrences, "h long, bad long, good long")
                   .groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
        odds_sql = F.log((F.col("bad") + 0.5) / (half[1] + 1)) - F.log((F.col("good") + 0.5) / (half[0] + 1))
        ratio = 2 * (F.col("bad") * F.log((F.col("bad") + 1e-9) / ((F.col("bad") + F.col("good")) * base))
                     + F.col("good") * F.log((F.col("good") + 1e-9) / ((F.col("bad") + F.col("good")) * (1 - base))))
        best = (counted.withColumn("odds", odds_sql).withColumn("evidence", ratio)
                .filter((F.col("odds") >= ODDS) & (F.col("evidence") >= EVIDENCE))
                .orderBy(F.desc("evidence"), "h").limit(LEXICON).select("h", "odds").collect())
        if best:
            hashes = np.array([r["h"] for r in best], np.int64).view(np.uint64)
            odds = np.array([r["odds"] for r in best])
            order = np.argsort(hashes)
            hashes, odds = hashes[order], odds[order]

    def measure(stream):
        measured = _measure(hashes, odds)
        for rows in stream:
            x = measured(rows.column("text"))
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                             names=["label", "a", "b"])

    found = (labelled.texts_of(docs, chosen, 1).select("text", "label")
             .mapInArrow(measure, "label int, a double, b double").collect())
    x = np.array([(r["a"], r["b"]) for r in found], float).reshape(-1, 2)
    y = np.array([r["label"] for r in found], float)
    share = counts.get(1, 0) / max(sum(counts.values()), 1) if counts else 0.5
    return hashes, odds, logistic.fit(x, y, share)


def _measure(hashes: np.ndarray, odds: np.ndarray):
    """A function from a column of texts to (log of the summed clause scores, largest clause score)."""
    machine = grammar()
    fixed, classes_of = _fixed_words()

    def block(data, offsets):
        out = np.zeros((len(offsets) - 1, 2))
        start, end, bounds = _tokens(data, offsets)
        if not len(start):
            return out
        features = _features(data, start, end)
        weight = np.zeros(len(start))
        if len(hashes):
            for f in features:
                at = np.searchsorted(hashes, f)
                at[at == len(hashes)] = 0
                np.maximum(weight, np.where(hashes[at] == f, odds[at], 0.0), out=weight)
        classes = np.where(weight > 0, INSULT, OTHER)
        at = np.searchsorted(fixed, features[0])
        at[at == len(fixed)] = 0
        known = (fixed[at] == features[0]) & (weight == 0)
        classes[known] = classes_of[at[known]]
        weight[classes == THREAT] = THREAT_WEIGHT
        hits = np.flatnonzero(weight > 0)
        if not len(hits):
            return out
        # A clause ends at its punctuation and at the end of its text
        clause = np.searchsorted(np.flatnonzero(ENDS_CLAUSE[data]), start)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        new = np.ones(len(start), bool)
        new[1:] = (clause[1:] != clause[:-1]) | (text_of[1:] != text_of[:-1])
        opens = np.append(np.flatnonzero(new), len(start))
        for k in np.unique(np.searchsorted(opens, hits, side="right") - 1).tolist():
            a, b = opens[k], opens[k + 1]
            value = machine.weigh(classes[a:b].tolist(), weight[a:b].tolist())
            t = text_of[a]
            out[t, 0] += value
            out[t, 1] = max(out[t, 1], value)
        out[:, 0] = np.log1p(out[:, 0])
        return out

    def measured(column) -> np.ndarray:
        data, offsets = buffers(pc.utf8_lower(column))
        parts = [block(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in blocks(offsets)]
        return np.concatenate(parts) if parts else np.zeros((0, 2))

    return measured


def score(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from ``labels(doc_id, target)`` outside the held-out fold. The score is the probability of label 1 given the
    matched clauses of the whole text; null and empty texts match nothing. Rows are scored one by one, so
    repeated or missing ids (held_out false) are no matter. Without labelled rows of both kinds there are no learned
    insults and every score is the share of label 1, 0.5 without any.
    """
    hashes, odds, weights = learn(docs, labels, target)

    def scored(stream):
        measured = _measure(hashes, odds)
        for rows in stream:
            x = measured(rows.column("_text"))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"),
                                              pa.array(logistic.predict(x, weights))],
                                             names=["doc_id", "held_out", "score"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), labelled.held_out().alias("held_out"),
                         F.coalesce("text", F.lit("")).alias("_text"))
    return (wanted.mapInArrow(scored, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))
