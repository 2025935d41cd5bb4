"""Phrase mining, lexical search and nearest neighbours against plain Python."""

import collections
import math
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelcast.llm import collocations, lexical, neighbours, tokens
from panelcast.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

SF = "/root/testdata/sf0.001"
PIECE = re.compile("[.,;:!?\x0a-\x0d]")
TERM = re.compile(lexical.TERM)
ASCII = str.maketrans(lexical.UPPER, lexical.LOWER)


# --- phrases ------------------------------------------------------------------
def plain_phrases(rows, least, top, share):
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in PIECE.split((text or "").translate(ASCII)):
            words = [w for w in re.split("[ \t]", piece) if w]
            sizes["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {g for g, n in f.items() if n >= least and len(g) > 1}
        held = collections.Counter()
        for g in frequent:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i:i + k]] = max(held[g[i:i + k]], f[g])
        found = []
        for g in frequent:
            if 100 * held[g] >= share * f[g]:
                continue
            score, _, left, right = min((2000000 * f[g] // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -f[g], " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def phrase_rows():
    r = random.Random(3)
    vocabulary = ["ein", "zwei", "Drei", "été", "x\x01y", "a", "b"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(n))
    rows = [(r.choice(["de", "fr", None]), text(r.randint(0, 200))) for _ in range(60)]
    return rows + [("de", None), ("de", ""), ("und", "a a a a a a a a"), ("de", "\n.,"), (None, "a b"), ("fr", "la " * 300)] + rows[:9]


@pytest.mark.parametrize("least,top,share", [(5, 1000, 80), (2, 7, 100), (30, 2000, 80)])
def test_phrases(spark, least, top, share):
    rows = phrase_rows()
    docs = spark.createDataFrame([(lang, t, 1, "w") for lang, t in rows], "lang string, text string, n int, word string").repartition(4)
    got = sorted(tuple(x) for x in collocations.mine(docs, least, top, share).collect())
    assert got == plain_phrases(rows, least, top, share) and got


def test_phrases_across_batches(spark, monkeypatch):
    """A text longer than a block and a batch, and a batch per text."""
    rows = phrase_rows()
    rows.append(("de", " ".join(t for _, t in rows if t) * 3))
    monkeypatch.setattr(collocations, "BATCH_BYTES", 1)
    names = ["de"]
    whole = collocations.numbered(0, np.zeros(1, np.int64), names, *_bytes([rows[-1][1]]))
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 64)
    monkeypatch.setattr(collocations, "cuts", lambda data, offsets, solid: tokens.cuts(data, offsets, solid, 64))
    small = collocations.numbered(0, np.zeros(1, np.int64), names, *_bytes([rows[-1][1]]))
    assert sorted(zip(*[small.column(c)[0].as_py() for c in ("words", "counts")])) == \
        sorted(zip(*[whole.column(c)[0].as_py() for c in ("words", "counts")]))
    spelt = [[b.column("words")[0].as_py()[x >> 1] + "|" * (x & 1) for x in
              collocations.unpack_planes(b.column("codes")[0].as_py()).astype(int)] for b in (small, whole)]
    assert spelt[0] == spelt[1]


def _bytes(texts):
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    return np.frombuffer("".join(texts).encode(), np.uint8), offsets


def test_no_phrases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(none).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "one two")], "lang string, text string")).collect() == []


def test_scores_beyond_64_bits(spark):
    """2000000 times a count of this size doesn't fit a long."""
    big = 9 * 10 ** 15
    words = spark.createDataFrame([("en", "a", big, 257), ("en", "b", big + 1, 258)], "lang string, word string, f long, word_id long")
    grams = spark.createDataFrame([((257 << 32) | 258, 0, big - 7, False)], "k1 long, k2 long, n long, unary boolean")
    row = collocations.ranked(grams, words, spark.createDataFrame([("en", 5)], "lang string, n long"), 10, 80).first()
    assert row.score == 2000000 * (big - 7) // (2 * big + 1) and (row.l, row.r) == (big, big + 1)


# --- lexical search -----------------------------------------------------------
def plain_search(docs, items, k):
    terms = [TERM.findall((t or "").translate(ASCII)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, terms)), sum(map(len, terms))
    df = collections.Counter(w for t in terms for w in set(t))
    out = []
    for item, text in set(items):
        asked = set(TERM.findall((text or "").translate(ASCII)))
        scores = []
        for (doc, _), own in zip(docs, terms):
            tf, m = collections.Counter(own), 10 + (90 * len(own) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * tf[w]) // (1000 * tf[w] + 8 * m))
                        for w in asked if tf[w])
            scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


def search_rows():
    r = random.Random(11)
    vocabulary = [f"w{int(r.paretovariate(0.5)) % 400}" for _ in range(3000)] + ["Über", "Ärger", "naïve"]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", "-x"]) for _ in range(n))
    docs = [(i, text(int(r.paretovariate(0.7)) % 300)) for i in range(900)]
    docs += [(5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2 w3"), (901, None), (902, ""), (903, "..."), (904, "w1 " * 500)]
    items = [(i, text(12)) for i in range(25)] + [(3, "W1 w2"), (3, "W1 w2"), (30, None), (31, ""), (32, "unknown"), (33, "w1")]
    return docs, items


@pytest.mark.parametrize("shard", [8 << 20, 700])
def test_search(spark, shard):
    docs, items = search_rows()
    a = spark.createDataFrame([(i, t, "s", 3) for i, t in docs], "doc_id long, text string, shard string, df int").repartition(3)
    b = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id long, text string, term string")
    got = sorted((tuple(x) for x in lexical.search(a, b, shard_bytes=shard).collect()), key=repr)
    want = plain_search(docs, items, 10)
    # Row 5 is there twice and id 3 has two texts, so equal rows of the result are told apart by nothing
    assert got == want


def test_search_of_nothing(spark):
    docs, items = search_rows()
    a, b = (spark.createDataFrame(x, s) for x, s in ((docs[:5], "doc_id long, text string"), (items, "item_id long, text string")))
    none = lambda df: df.filter("false")
    assert lexical.search(none(a), b).collect() == [] == lexical.search(a, none(b)).collect()


def _one_shard(docs):
    data, offsets = _bytes([t or "" for _, t in docs])
    counts = [len(TERM.findall(t or "")) for _, t in docs]
    rows = pa.Table.from_batches([lexical.shard_rows(0, pa.array([i for i, _ in docs], pa.int64()), data, offsets,
                                                     sum(map(bool, counts)), sum(counts))])
    return rows, data, offsets


def test_blocks_are_skipped_unopened():
    """Block maxima reject documents: long lists of weak terms stay closed but for a few blocks, results stay whole."""
    r = random.Random(2)
    docs = [(i, " ".join(["common"] * r.randint(1, 3) + [f"x{r.randrange(9000)}" for _ in range(9)])) for i in range(30000)]
    rows, _, _ = _one_shard(docs)
    asked = ["common", "x3", "x4", "x5"]
    own = rows.filter(pa.compute.or_kleene(pa.compute.is_null(rows.column("term")),
                                           pa.compute.is_in(rows.column("term"), pa.array(asked))))
    weight = [0 if w is None else (2 if w == "common" else 6000) for w in own.column("term").to_pylist()]
    own = own.append_column("weight", pa.array(weight, pa.int64()))
    own = own.append_column("items", pa.array([[7] for _ in weight], pa.list_(pa.int64())))
    lists = lexical.Lists(own)
    docs_found, score = lists.best(np.arange(len(lists.items)), 10)
    assert lists.read < lists.blocks / 2
    every = lexical.Lists(own)
    total = np.zeros(len(docs), np.int64)
    for i in range(len(every.items)):
        at, impact = every.open(i)
        total[at] += every.weight[i] * impact
    assert every.read == every.blocks
    best = sorted(zip(-score, docs_found))[:10]
    assert best == sorted(zip(-total, range(len(docs))))[:10]


@pytest.mark.parametrize("values", [[], [0], [127, 128, 16383, 16384, 2 ** 31, 2 ** 40, 5]])
def test_varints(values):
    raw, n = lexical.varints(np.array(values, np.int64))
    assert raw.size == n.sum()
    if values:
        assert lexical.from_varints(raw).tolist() == values


def test_tokens_of_long_texts():
    """Blocks end at separators, so the counts don't depend on their size."""
    texts = ["ab cd ab", "", "x" * 200, " yy zz " * 40, "end"]
    data, offsets = _bytes(texts)
    for limit in (1, 7, 50, 10 ** 6):
        found = []
        for first, last in tokens.cuts(data, offsets, lexical.SOLID, limit):
            start, end = tokens.spans(data[first:last], lexical.SOLID, offsets[(offsets > first) & (offsets < last)] - first)
            found += [bytes(data[first + a:first + b]).decode() for a, b in zip(start, end)]
        assert found == [w for t in texts for w in t.split()], limit


# --- nearest neighbours -------------------------------------------------------
def plain_neighbours(rows, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in usable:
        if q % 20:
            continue
        scored = []
        for c, w in usable:
            if c != q and len(w) == len(v):
                total = 0.0
                for x, y in zip(v, w):
                    total += x * y
                scored.append((-total, c))
        out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def vectors(r, scale=1.0):
    real = lambda n: [float(np.float32(r.gauss(0, 1) * scale)) for _ in range(n)]
    hot, base = real(8), real(8)
    rows = [(i, real(8)) for i in range(300)] + [(300 + i, hot) for i in range(200)]
    rows += [(500 + i, [x + float(np.float32(1e-6 * r.random())) for x in base]) for i in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(None, real(8)), (600, None), (620, []), (640, [0.0] * 8), (660, [1.0, None] * 4), (680, [math.nan] + [1.0] * 7),
             (700, [math.inf] + [1.0] * 7), (720, real(3)), (721, real(3)), (740, real(5)), (20, rows[20][1]), (40, real(8)),
             (760, [-0.0, 1.0] + [0.0] * 6), (761, [0.0, 1.0] + [0.0] * 6)]
    return rows


@pytest.mark.parametrize("kind,scale,slab,k", [("float", 1.0, 4 << 20, 20), ("float", 1e15, 900, 5), ("double", 1e-30, 3000, 20)])
def test_neighbours(spark, kind, scale, slab, k):
    rows = vectors(random.Random(1), scale)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, h string, rank int").repartition(3)
    got = sorted(tuple(x) for x in neighbours.search(df, F.col("vec_id") % 20 == 0, k, slab_bytes=slab).collect())
    assert got == plain_neighbours(rows, k)


def test_no_neighbours(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(none, F.col("vec_id") % 20 == 0).collect() == []
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert neighbours.search(one, F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("dim", [3, 64, 2500])
def test_bounds_hold(dim):
    """No exact product lies outside the bounds of its codes, and most pairs are decided by the bounds."""
    r = np.random.default_rng(dim)
    a, b = r.normal(size=(40, dim)), r.normal(size=(300, dim)) * np.exp(r.normal(size=(300, 1)) * 3)
    q, c = neighbours.Coded(a), neighbours.Coded(b)
    near, off = neighbours.bounds(q, c, slice(0, 40), slice(0, 300))
    true = a @ b.T / (q.unit * c.unit)
    assert (np.abs(true - near) <= off).all()
    top = np.sort(near - off, axis=1)[:, -20]
    assert ((near + off) >= top[:, None]).mean() < 0.5


@pytest.mark.parametrize("name", ["op11_collocations", "op12_lexical_search", "op13_neighbours"])
def test_search_queries_and_sql(spark, name):
    con = oracle.connect(SF)
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = [tuple(x[columns.index(c)] for c in df.columns) for x in cursor.fetchall()]
    got = [tuple(x) for x in df.collect()]
    assert got and sorted(got, key=repr) == sorted(want, key=repr)
