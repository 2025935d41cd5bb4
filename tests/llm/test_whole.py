"""Parts of the job that were once left out."""

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa

from panelcast.llm import decontaminate, line_dedup, url_filter
from panelcast.llm.common import buffers

#: Context lengths of the URL models
LADDER = [0, 1, *(m for k in range(1, 12) for m in (2 ** k, 3 * 2 ** (k - 1)))]


def paired_chunks(texts):
    """(lines removed, kept) of each text, cut into chunks of two lines at least."""
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        chunks, own = [], []
        for i, x in enumerate(lines):
            own.append(x)
            if len(own) > 1 and sum(5 ** k * h[i - k] for k in range(3) if i >= k) % 4 == 0:
                chunks.append(own)
                own = []
        if len(own) == 1 and chunks:
            chunks[-1] += own
        elif own:
            chunks.append(own)
        kept, removed = [], 0
        for c in map("\n".join, chunks):
            if "\n" in c and len(c) >= 20 and c in seen:
                removed += c.count("\n") + 1
            else:
                kept.append(c)
            seen.add(c)
        out.append((removed, "\n".join(kept)))
    return out


def test_paired_chunks_remove_whole_copies(spark):
    r = random.Random(7)
    line = lambda: f"some words in a line {r.randrange(10 ** 9)}"
    first = [[line() for _ in range(r.randint(2, 25))] for _ in range(60)]
    nested = [[line(), line(), *t, line()] for t in first]
    texts = ["\n".join(t) for t in [*first, *nested, *first]] + ["", "x", "x\ny", "x\n\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {x.doc_id: (x.n_removed, x.kept) for x in line_dedup.dedup(docs, paired=True).collect()}
    assert [rows[i] for i in range(len(texts))] == paired_chunks(texts)
    # True repeats: every later copy goes whole, as not one line of it is new
    assert all(rows[i] == (len(first[i - 120]), "") for i in range(120, 180))
    kept = {x.doc_id for x in line_dedup.clean(docs, paired=True).collect()}
    assert not kept & set(range(120, 180))


def test_pipeline_removes_whole_copies(spark):
    import corpus_pipeline

    r = random.Random(8)
    texts = ["\n".join(f"some words in a line {r.randrange(10 ** 9)}" for _ in range(n)) for n in range(2, 30)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts + texts)],
                                 "doc_id long, text string, n_chars long")
    out = corpus_pipeline.without_repeated_lines(spark, docs, "")
    assert {x.doc_id for x in out.collect()} == set(range(len(texts)))


def url_scores(examples, urls):
    """Scores by plain Python: counts of every context of a length on the ladder, the begin mark a part of it."""
    marked = lambda u: [None, *u.encode()]
    counts = {}
    for u, n, verdict in examples:
        for at in range(1, len(marked(u))):
            for k in (k for k in LADDER if k <= at):
                own = counts.setdefault(tuple(marked(u)[at - k:at]), {"allow": {}, "block": {}})[verdict]
                own[marked(u)[at]] = own.get(marked(u)[at], 0) + n
    out = {}
    for u in urls:
        total = 0.0
        for at in range(1, len(marked(u))):
            p = {"allow": 1 / 256, "block": 1 / 256}
            for k in (k for k in LADDER if k <= at):
                own = counts.get(tuple(marked(u)[at - k:at]))
                if own is None or sum(sum(c.values()) for c in own.values()) < 2:
                    continue
                for v, c in own.items():
                    if c:
                        p[v] = (c.get(marked(u)[at], 0) + len(c) * p[v]) / (sum(c.values()) + len(c))
            total += math.log(p["block"]) - math.log(p["allow"])
        out[u] = total / len(u.encode())
    return out


def test_url_models_of_any_length(spark):
    """Models of variable-length contexts over all bytes, against plain Python."""
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ta", "né", "?q=", "Xi", "um&", "_", "京"]) for _ in range(r.randint(1, 9)))
    urls = [f"http://h{r.randrange(30)}.{r.choice(['good', 'bad', 'other'])}/{word()}" for _ in range(150)] + ["http://x.good/" + "lo/ng" * 60]
    urls += urls[:40] + [None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    rules = [("allow", ("good", "/")), ("block", ("bad", "/"))]
    rows = {x.page_id: x for x in url_filter.judge(pages, rules).collect()}
    assert len(rows) == len(urls) and rows[len(urls) - 1].score == rows[len(urls) - 2].score == 0
    verdict = {u: "allow" if ".good/" in u else "block" for u in urls if u and ".other/" not in u}
    examples = [(u, urls.count(u), v) for u, v in verdict.items() if zlib.crc32(u.encode()) % url_filter.FOLDS]
    want = url_scores(examples, {u for u in urls if u})
    assert all(abs(rows[i].score - want[u]) < 1e-9 for i, u in enumerate(urls) if u)


def test_url_models_see_long_contexts_and_all_bytes(spark):
    """Examples that differ five bytes back, or in bytes beyond ASCII only."""
    rows = [f"http://h{i}.{host}/{path}" for i in range(40) for host, path in
            [("good", "a?????z é"), ("good", "b?????y 京"), ("bad", "b?????z ü"), ("bad", "a?????y 東")]]
    asked = ["http://q.other/a?????z", "http://q.other/b?????z", "http://q.other/é", "http://q.other/ü"]
    pages = spark.createDataFrame(list(enumerate(rows + asked)), "page_id long, url string")
    out = {x.page_id: x.score for x in url_filter.judge(pages, [("allow", ("good", "/")), ("block", ("bad", "/"))]).collect()}
    a, b, c, d = (out[len(rows) + i] for i in range(4))
    assert a < b and c < d


def _aligned(pattern):
    """What is found of an item in a text that differs from it where the pattern has a 0."""
    item = [f"w{i}" for i in range(len(pattern))]
    text = " ".join(w if same else f"x{i}" for i, (w, same) in enumerate(zip(item, pattern)))
    values, bounds = decontaminate.word_values(*buffers(pa.array([text])))
    return decontaminate.Block([(1, " ".join(item))]).matches(values)


def test_passages_beside_weaker_stretches():
    """A passage that holds the share is found whatever surrounds it."""
    assert _aligned([1] * 20 + [0, 0, 1, 1, 1, 1, 1] * 25)[0][:4] == (1, 0, 20, 20)
    # The highest score (11) has too few words; twelve of sixteen hold the share
    assert _aligned([1] * 11 + [0] * 20 + [1, 1, 1, 0] * 4)[0][0] == 1
    assert _aligned([1] * 11 + [0] * 20 + [1, 1, 0, 0] * 4) == []


def test_stretches_against_all_pairs():
    r = random.Random(11)
    for _ in range(300):
        equal = np.array([r.random() < r.choice([0.5, 0.75, 0.9]) for _ in range(r.randint(1, 40))])
        most = max((int(equal[a:b].sum()) for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
                    if equal[a:b].mean() >= decontaminate.MIN_EQUAL), default=0)
        s, e = decontaminate.fullest_stretch(equal)
        assert int(equal[s:e].sum()) == most and (e == s or equal[s:e].mean() >= decontaminate.MIN_EQUAL)


def test_strings_of_one_direction():
    """Both directions' strings of a stretch can be made apart, so that a batch need not hold both."""
    from panelcast.llm.suffix_dedup import stretch_strings

    text = bytes(i * 7 % 251 for i in range(3000))
    both = list(stretch_strings(text, [300, 900, 2000], [1500], 400))
    apart = [list(stretch_strings(text, [300, 900, 2000], [1500], 400, (way,))) for way in (0, 1)]
    assert apart[0] + apart[1] == both and {x[1] for x in apart[0]} == {0} and {x[1] for x in apart[1]} == {1}
