"""Registered queries of the text operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelcast.llm import (collocations, decontaminate, fingerprint, lexical, line_dedup, minhash, neighbours, quality,
                           segment, substring_dedup, suffix_dedup, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity")
def op10(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_line_dedup", "WITH " + line_dedup.SQL.format(source="documents") + """
SELECT doc_id, n_lines, n_removed, n_chunks_removed, sha256(kept) AS kept_sha256 FROM deduped""")
def op3(spark, sf_dir):
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_chunks_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_decontamination")
def op4(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_minhash_near_dedup")
def op2(spark, sf_dir):
    return minhash.dedup(table(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    return segment.encode(table(spark, sf_dir, "documents"), with_text_hash=True)


#: The rules of the URL query
URL_RULES = [("block", ("net", "/")), ("allow", ("example.net", "/en/")), ("block", ("example.com", "/de/")),
             ("allow", ("org", "/fr/"))]


@query("op7_url_filter")
def op7(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op8_fingerprints")
def op8(spark, sf_dir):
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


@query("op13_neighbours", """
WITH usable AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, vec_id, score FROM scored)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 20""")
def op13(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op12_lexical_search", r"""
WITH terms AS (
  SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT count(DISTINCT doc) AS n_docs, count(*) AS n_terms FROM terms),
damped AS (SELECT doc, 100 - 90 + (90 * count(*) * max(n_docs)) // max(n_terms) AS m FROM terms, sizes GROUP BY doc),
counted AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM terms GROUP BY doc, term),
weighted AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, sizes GROUP BY term),
items AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, text, doc, any_value(doc_id) AS doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN counted USING (term) JOIN weighted USING (term) JOIN damped USING (doc)
  GROUP BY item_id, text, doc),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS n
  FROM scored WHERE score > 0)
SELECT item_id, CAST(n AS INTEGER) AS rank, doc_id, score FROM ranked WHERE n <= 10""")
def op12(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_collocations", r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
pieces AS (
  SELECT lang, list_filter(string_split_regex(unnest(pieces), '[\x20\x09]'), lambda w: w <> '') AS words FROM texts),
places AS (SELECT lang, words, unnest(generate_series(1, len(words))) AS i FROM pieces WHERE len(words) > 0),
sizes AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS MATERIALIZED (
  SELECT lang, words[i:i + k - 1] AS g, k, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words)
  GROUP BY ALL HAVING count(*) >= 30),
held AS MATERIALIZED (
  SELECT lang, k, g, max(f) AS longer FROM (
    SELECT b.lang, s.k, b.g[j:j + s.k - 1] AS g, f
    FROM grams b, (SELECT unnest([2, 3]) AS k) s, (SELECT unnest([1, 2, 3]) AS j) p
    WHERE b.k > s.k AND j + s.k - 1 <= b.k)
  GROUP BY ALL),
split AS MATERIALIZED (
  SELECT lang, g, f, cut, array_to_string(g[1:cut], ' ') AS p, array_to_string(g[cut + 1:], ' ') AS q
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM grams WHERE k > 1)),
counts AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS phrase, f FROM grams),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, cut, (c.f::HUGEINT * 2000000) // (x.f + y.f) AS score
  FROM split c JOIN counts x ON x.lang = c.lang AND x.phrase = c.p JOIN counts y ON y.lang = c.lang AND y.phrase = c.q
  LEFT JOIN held h ON h.lang = c.lang AND h.g = c.g
  WHERE h.longer IS NULL OR 100 * h.longer < 80 * c.f),
chosen AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM cuts),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
  FROM chosen WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""")
def op11(spark, sf_dir):
    return collocations.mine(table(spark, sf_dir, "documents"))
