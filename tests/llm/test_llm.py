"""Text operators against plain Python on small inputs with nulls, empty and long texts, ties and clashing columns."""

import os
import random

import numpy as np
import plain
import pytest

from panelcast.llm import (decontaminate, fingerprint, line_dedup, minhash, quality, segment, substring_dedup,
                           suffix_dedup, toxicity, url_filter)
from panelcast.llm.components import components
from panelcast.llm.queries import ORACLES, QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, part int, kept string, n long, score string"


def _texts():
    """Copies, edits, passages shared at odd places, periodic and awkward texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ta", "né", "ro", "Xi", "um"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(90), prose(120)
    edited = base.split(" ")
    edited[60] = "other"
    texts = [None, "", " \t\n", "one", "One", "a b c d e", prose(300), shared + prose(7), prose(5) + shared + prose(3),
             prose(2) + " " + shared, base, base, " ".join(edited), base + " tail", "la " * 400, "la " * 400 + "x",
             "\n".join([shared] * 3), prose(3000)]
    lines = [prose(6) for _ in range(12)]
    return texts + ["\n".join(lines), "\n".join(["new line"] + lines), "\n".join(lines[3:]), "\n\n\n", "x\ny\nz"]


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "k", 3, "kept", 7, "s") for i, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, repeated ids and missing ids."""
    t = " ".join(f"w{i}" for i in range(150))
    rows = [(None, t), (None, t), (None, None), (4, t), (4, t), (4, "other"), (2, t + " more"), (9, "")]
    return spark.createDataFrame([(i, x, "k", 3, "kept", 7, "s") for i, x in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    rows = {r["doc_id"]: r for r in df.collect()}
    return [rows[i] for i in sorted(rows)]


def ordered(odd):
    """The order that the operators give to rows without distinct ids."""
    return sorted([(r["doc_id"], r["text"]) for r in odd.collect()],
                  key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


@pytest.mark.parametrize("length", [128, 400])
def test_suffix_dedup(docs, texts, length):
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in by_id(suffix_dedup.dedup(docs, length, parts=5))]
    assert got == plain.repeated_bytes(texts, length)


def test_suffix_dedup_odd_rows(odd, none):
    rows = ordered(odd)
    want = [(i, *x) for (i, _), x in zip(rows, plain.repeated_bytes([t for _, t in rows], 128))]
    assert sorted(map(tuple, suffix_dedup.dedup(odd, 128).collect()), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.dedup(none).collect() == []


def test_loser_tree_merges_in_order():
    r = random.Random(1)
    runs = []
    for _ in range(7):
        strings = sorted({bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 30))})
        runs.append((strings, [suffix_dedup.common(a, b, 0) for a, b in zip([b"", *strings], strings)]))
    merged = [(runs[k][0][i], n) for k, i, n in suffix_dedup.merge(runs)]
    assert [x for x, _ in merged] == sorted(x for strings, _ in runs for x in strings)
    for (a, _), (b, n) in zip(merged, merged[1:]):
        assert n == len(os.path.commonprefix([a, b]))


@pytest.mark.parametrize("window", [6, 20, 40])
def test_substring_dedup(docs, texts, window):
    got = [(r.n_words, r.n_removed, r.kept_sha256) for r in by_id(substring_dedup.dedup(docs, window, parts=5))]
    assert got == plain.repeated_words(texts, window)


def test_substring_dedup_odd_rows(odd, none):
    rows = ordered(odd)
    want = [(i, *x) for (i, _), x in zip(rows, plain.repeated_words([t for _, t in rows], 20))]
    assert sorted(map(tuple, substring_dedup.dedup(odd).collect()), key=repr) == sorted(want, key=repr)
    assert substring_dedup.dedup(none).collect() == []


def test_difference_covers():
    for period, residues in substring_dedup.COVERS.items():
        for shift in range(period):
            assert any((x + shift) % period in residues for x in residues)


@pytest.mark.parametrize("block", [3, 1000])
def test_near_duplicates(docs, texts, block):
    got = [(r.n_shingles, r.component_id, r.kept) for r in by_id(minhash.dedup(docs, block=block))]
    assert got == [(n, first, first == i) for i, (n, first) in enumerate(plain.near_components(texts))]


def test_near_duplicates_chain(spark):
    """Texts that are linked only through others, in blocks smaller than their bucket."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        words[r.randrange(120)] = f"v{r.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.n_shingles, r.component_id) for r in by_id(minhash.dedup(docs, block=8))]
    assert got == plain.near_components(texts)


def test_near_duplicates_odd_rows(odd, none):
    rows = ordered(odd)
    want = [(i, n, rows[first][0], first == k) for k, ((i, _), (n, first)) in
            enumerate(zip(rows, plain.near_components([t for _, t in rows])))]
    assert sorted(map(tuple, minhash.dedup(odd).collect()), key=repr) == sorted(want, key=repr)
    assert minhash.dedup(none).collect() == [] and minhash.keep_first(none).columns == none.columns
    assert minhash.keep_first(odd).columns == odd.columns and minhash.keep_first(odd).count() == sum(w[3] for w in want)


def test_pruning_bounds():
    least = minhash.least_matches(0.75, 1e-6)
    assert least == sorted(least) and len(least) == minhash.MINIMA // minhash.BATCH
    assert 0.4 * minhash.MINIMA < least[-1] < 0.75 * minhash.MINIMA


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (40, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 150: 100}


def test_line_dedup(docs, texts, odd, none):
    got = [(r.n_lines, r.n_removed, r.kept) for r in by_id(line_dedup.dedup(docs))]
    assert got == plain.repeated_chunks(texts)
    assert any(removed for _, removed, _ in got)
    rows = ordered(odd)
    want = [(i, *x) for (i, _), x in zip(rows, plain.repeated_chunks([t for _, t in rows]))]
    found = [(r.doc_id, r.n_lines, r.n_removed, r.kept) for r in line_dedup.dedup(odd).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert line_dedup.dedup(none).collect() == []
    cleaned = line_dedup.clean(docs)
    assert cleaned.dtypes == docs.dtypes
    kept = {r.doc_id: r.text for r in cleaned.collect()}
    assert kept == {i: t if not removed else left for i, (t, (_, removed, left)) in
                    enumerate(zip(texts, plain.repeated_chunks(texts))) if not removed or left}


def test_decontamination(spark, docs, odd, none):
    r = random.Random(2)
    item = [f"item{r.randrange(500)}" for _ in range(40)]
    other = item[:]
    for i in (4, 13, 22, 31):
        other[i] = "changed"
    filler = " ".join(f"f{i}" for i in range(60))
    rows = [(0, f"{filler} {' '.join(item)}. {filler}"), (1, " ".join(other).upper()), (2, filler), (3, None), (4, ""),
            (5, " ".join(item[:10])), (6, " ".join(item[5:25])), (None, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (None, "", 1), (9, "too short", 1)],
                                  "item_id long, text string, doc_id long")
    found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = {r.doc_id: (r.item_id, r.start, r.n_words, r.n_equal) for r in found.collect()}
    assert got == {0: (7, 60, 40, 40), 1: (7, 0, 40, 36), 6: (7, 0, 20, 20), None: (7, 0, 40, 40)}
    blocks = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_words=10)
    assert {r.doc_id for r in blocks.collect()} == set(got)
    assert decontaminate.find(none, bench).collect() == [] and decontaminate.find(docs, none.selectExpr(
        "doc_id item_id", "text")).collect() == []
    clean = decontaminate.clean(odd, bench)
    assert clean.dtypes == odd.dtypes and clean.count() == odd.count()


def test_segmentation_is_exact_and_distinct(docs, texts, odd, none):
    rows = segment.encode(docs, samples=3).collect()
    assert all(r.exact for r in rows)
    per = {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
    assert set(per) == set(range(len(texts)))
    for i, own in per.items():
        own.sort(key=lambda r: r["rank"])
        # A very short text has fewer segmentations than were asked for
        assert len({tuple(r.ids) for r in own}) == len(own) and len(own) == (3 if len(texts[i] or "") > 20 else len(own))
        assert 1 <= len(own) <= (3 if texts[i] else 1)
        assert [r.log_arrival for r in own] == sorted(r.log_arrival for r in own)
    again = {(r.doc_id, r["rank"]): r.ids_sha256 for r in segment.encode(docs.filter("doc_id > 5"), samples=3).collect()}
    assert again == {(r.doc_id, r["rank"]): r.ids_sha256 for r in rows if r.doc_id > 5}
    back = {(r.doc_id, r["rank"]): r.text for r in segment.decode(segment.encode(docs, samples=2)).collect()}
    assert all(text == (texts[i] or "") for (i, _), text in back.items())
    assert segment.encode(odd).count() == 2 * (odd.count() - 2) + 2 and segment.encode(none).collect() == []


def test_segmentation_draws_without_replacement():
    """First draws follow the probabilities; the second follows them among the rest."""
    vocabulary, n = segment.Vocabulary(*segment.load()), 6000
    lattice, out = segment.sample_block(np.arange(n), ["then"] * n, 2, vocabulary)
    p, first, second = {}, {}, {}
    for _, rank, arcs, logp, _, _ in out:
        path = tuple(lattice.ids[arcs])
        p[path] = np.exp(logp)
        count = first if rank == 1 else second
        count[path] = count.get(path, 0) + 1
    for path, share in p.items():
        want = sum(p[o] * share / (1 - p[o]) for o in p if o != path)
        assert abs(first.get(path, 0) / n - share) < 0.03 and abs(second.get(path, 0) / n - want) < 0.03


def test_segmentation_looks_no_further_along_a_path_than_needed(monkeypatch):
    vocabulary = segment.Vocabulary(*segment.load())
    texts = ["the quick brown fox jumps over the lazy dog " * 40, "", "of", " 日本", "x" * 3000]
    keys, children, lowest = np.arange(len(texts)), segment._children, []

    def drawn(samples=3):
        lattice, out = segment.sample_block(keys, texts, samples, vocabulary)
        return [(t, rank, lattice.ids[arcs].tolist(), *numbers) for t, rank, arcs, *numbers in out]

    def recorded(lattice, arcs, text_of, step, logp_before, arrival, salt):
        lowest.append(logp_before.min())
        return children(lattice, arcs, text_of, step, logp_before, arrival, salt)

    monkeypatch.setattr(segment, "_children", recorded)
    short = drawn()
    assert min(lowest) >= segment.SMALLEST - segment.SOON
    for soon in (-60.0, -segment.SMALLEST):  # too short for any text, and the full reach at once
        monkeypatch.setattr(segment, "SOON", soon)
        assert drawn() == short
    assert min(lowest) < 2 * segment.SMALLEST + 10


def test_all_paths_are_spelt_together():
    vocabulary = segment.Vocabulary(*segment.load())
    ids, sizes = segment.spell(np.array([5, -1 - ord("é"), 7, -1 - 0x1F600]), vocabulary)
    spelt = [vocabulary.bytes[b] for b in "é".encode()], [vocabulary.bytes[b] for b in "😀".encode()]
    assert ids.tolist() == [5, *spelt[0], 7, *spelt[1]] and sizes.tolist() == [1, 2, 1, 4] and ids.dtype == np.int32


def test_url_rules(spark):
    urls = [None, "", "no-scheme.net/x", "http://a.NET", "http://www.example.net/en/1?q", "http://example.net/fr",
            "https://m.example.com/de/5#x", "http://example.com/de", "http://x.org/fr/9", "http://badexample.net/en/",
            "http://net?x", "http://é.org/fr/", "http://example.netx/en/"]
    pages = spark.createDataFrame([(i, u, 1.0, "h") for i, u in enumerate(urls)],
                                  "page_id long, url string, score double, host string")
    rows = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert [rows[i].rule for i in range(len(urls))] == [None, None, None, None, "example.net/en/",
                                                        "net/", "example.com/de/", None, "org/fr/", "net/", None,
                                                        "org/fr/", None]
    assert (rows[3].host, rows[3].path, rows[4].host, rows[4].path) == ("a.net", "", "www.example.net", "/en/1")
    assert (rows[2].host, rows[0].host, rows[10].host, rows[10].path) == ("", "", "net", "")
    assert {r.verdict for r in rows.values()} <= {"allow", "block"}
    assert url_filter.judge(pages.limit(0), URL_RULES).collect() == []


def test_fingerprints(docs, texts, odd, none):
    rows = by_id(fingerprint.compare_with_next(docs))
    sets = [plain.shingles(t) for t in texts]
    for i, r in enumerate(rows):
        text, after = texts[i] or "", texts[i - 1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == plain.sha(edited.encode())
        for got, a, b in ((r.near_edited, sets[i], plain.shingles(edited)), (r.near_next, sets[i], sets[i - 1])):
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(got - want) < (1e-9 if len(a | b) <= fingerprint.K else 0.2)
    assert rows[10].fingerprint == rows[11].fingerprint
    assert fingerprint.compare_with_next(odd).count() == odd.count()
    assert fingerprint.compare_with_next(none).collect() == []


def test_fingerprints_merge(spark):
    a = np.unique(np.random.default_rng(0).integers(0, 2 ** 63, 3000, dtype=np.uint64) * np.uint64(2))
    whole = fingerprint.sketch(a)
    parts = [fingerprint.sketch(a[i::3]) for i in range(3)]
    assert (fingerprint.merge(parts) == whole).all() and (fingerprint.from_text(fingerprint.to_text(whole)) == whole).all()
    assert abs(fingerprint.distinct(whole) / len(a) - 1) < 0.3 and fingerprint.containment(whole, whole) == 1
    df = spark.createDataFrame([("x", fingerprint.to_text(p)) for p in parts] + [("y", ""), ("y", None)],
                               "g string, fingerprint string")
    got = {r.g: r for r in fingerprint.merge_by(df, "g").collect()}
    assert got["x"].fingerprint == fingerprint.to_text(whole) and got["y"].fingerprint == ""


@pytest.mark.parametrize("operator, target", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, docs, odd, none, operator, target):
    sf = SF.replace("0.001", "0.01")
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    labels = read("labels")
    out = operator.score(read("documents"), labels)
    rows = {r.doc_id: r for r in out.collect()}
    tried = [(rows[r.doc_id].predicted, r[target]) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(tried) > 40 and np.mean([a == b for a, b in tried]) > 0.9
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    for some in (docs, odd):
        scores = operator.score(some, labels).collect()
        assert len(scores) == some.count() and all(0 <= r.score <= 1 for r in scores)
    assert operator.score(none, labels).collect() == []
    assert {r.score for r in operator.score(odd, labels.limit(0)).collect()} == {0.5}


def test_toxic_grammar():
    machine = toxicity.grammar()
    weigh = lambda *classes: machine.weigh(list(classes), [1.0 if c in (1, 2) else 0.0 for c in classes])
    o, insult, threat, target, negation, report, modal = range(7)
    assert weigh(o, insult) == 1 and weigh(target, o, insult) == toxicity.AIMED
    assert weigh(negation, insult) == toxicity.NEGATED and weigh(negation, o, o, o, o, insult) == 1
    assert weigh(report, o, o, o, o, insult) == toxicity.REPORTED
    assert weigh(modal, threat) == 1 and weigh(threat) == toxicity.BARE_THREAT
    assert abs(weigh(report, target, insult) - toxicity.REPORTED * toxicity.AIMED) < 1e-12


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        assert after.dtypes == docs.dtypes and 0 < after.count() <= before, name
        docs, before = after, after.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).filter("rank = 1 and exact").count() == before


def test_queries_and_sql(spark):
    import duckdb

    import __spark_entry__ as driver

    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(QUERIES)
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
        want = con.execute(sql)
        columns = [d[0] for d in want.description]
        assert got == sorted(tuple(dict(zip(columns, r))[c] for c in sorted(columns)) for r in want.fetchall())
