"""Which rows each stage of the pipeline keeps and what it makes of them, against plain Python."""

import math
import re

import plain
import pytest
from test_whole import paired_chunks

from panelcast.llm import decontaminate, quality, segment

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[0-9a-zA-Z\x80-\xff]+", (text or "").lower().encode())


def places(own, mask):
    """Words under a mask, for every place where it fits."""
    return [(tuple(own[i + k] for k, c in enumerate(mask) if c == "1"), i) for i in range(len(own) - len(mask) + 1)]


def holds(doc, item, shifts):
    """Whether some stretch on one of these diagonals has enough equal words."""
    need = min(decontaminate.MIN_WORDS, math.ceil(decontaminate.MIN_SHARE * len(item)))
    for shift in shifts:
        same = [doc[i + shift] == item[i] for i in range(max(0, -shift), min(len(item), len(doc) - shift))]
        for a in range(len(same)):
            n = 0
            for b in range(a, len(same)):
                n += same[b]
                if n >= need and n >= decontaminate.MIN_EQUAL * (b + 1 - a):
                    return True
    return False


def leaked(texts, items):
    """Positions of the texts that hold a passage of an item."""
    found = {}
    for k, item in enumerate(items):
        for mask in decontaminate.MASKS:
            for seed, at in places(item, mask):
                found.setdefault((mask, seed), []).append((k, at))
    out = set()
    for i, text in enumerate(texts):
        own, shifts = words(text), {}
        for mask in decontaminate.MASKS:
            for seed, at in places(own, mask):
                for k, place in found.get((mask, seed), ()):
                    shifts.setdefault(k, set()).add(at - place)
        if any(holds(own, items[k], s) for k, s in shifts.items()):
            out.add(i)
    return out


def good(spark, rows, docs):
    chosen = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted == 1}
    return [r for r in rows if r["doc_id"] in chosen]


def fewer_lines(spark, rows, docs):
    cut = paired_chunks([r["text"] or "" for r in rows])
    out = [r | {"text": kept} if removed else r for r, (removed, kept) in zip(rows, cut) if kept or not removed]
    return [r | {"n_chars": None if r["text"] is None else len(r["text"])} for r in out]


def no_near_copies(spark, rows, docs):
    return [r for i, (r, (_, first)) in enumerate(zip(rows, plain.near_components([r["text"] for r in rows]))) if first == i]


def no_benchmark(spark, rows, docs):
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = leaked([r["text"] for r in rows], items)
    return [r for i, r in enumerate(rows) if i not in gone]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of each stage but the last, and the input of that."""
    import corpus_pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, SF), "test-rows")
        out.append((docs, after))
        docs = after
    return out, docs


@pytest.mark.parametrize("k, expected", enumerate([good, fewer_lines, no_near_copies, no_benchmark]))
def test_rows_of_stage(spark, steps, k, expected):
    rows = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"])
    docs, after = steps[0][k]
    before = rows(docs)
    assert len({r["doc_id"] for r in before}) == len(before)
    want = expected(spark, before, docs)
    assert rows(after) == want and want != before


def test_rows_of_encoding(spark, steps):
    import corpus_pipeline

    docs = steps[1]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    back = segment.decode(corpus_pipeline.STAGES[-1][1](spark, docs, SF)).collect()
    assert {r.doc_id for r in back if r["rank"] == 1} == set(texts)
    assert all(r.text == texts[r.doc_id] for r in back)


def test_segmentation_query_returns_ids(spark):
    """The sampled ids themselves, and the hash of what decode() makes of them."""
    import hashlib

    import numpy as np

    from panelcast.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_sentencepiece"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert len(r.ids) == r.n_pieces
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest()
        assert r.exact == (r.decoded_sha256 == plain.sha(texts[r.doc_id].encode())) and r.exact
