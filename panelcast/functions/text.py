"""Name normalisation, variants and stored-answer parsing."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from panelcast import config

BLANKS = " \t\n\r\f\v"
#: Rows that a table function hands over at a time
BATCH_ROWS = 4096
#: Characters that the compatibility decomposition leaves as marks on their letters
MARKS = re.compile("[" + "".join(map(chr, (c for c in range(0x110000) if unicodedata.combining(chr(c))))) + "]+")


def strip(c: Column) -> Column:
    """Trim blanks, tabs and line ends on both sides."""
    return F.btrim(c, F.lit(BLANKS))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replace_chars(c: Column, mapping: Mapping[str, str]) -> Column:
    return F.translate(c, "".join(mapping), "".join(mapping.values()))


def name_key(c: Column) -> Column:
    """Comparison key of a name: lower case, plain letters, no articles; inner blanks are kept."""
    key = F.concat(F.lit(" "), replace_chars(F.lower(c), config.NAME_REPLACEMENTS), F.lit(" "))
    for article in config.ARTICLES:
        key = F.replace(key, F.lit(f" {article} "), F.lit(" "))
    return strip(key)


def repair_mojibake(c: Column) -> Column:
    """UTF-8 text that was once read as Latin-1, put right; anything else stays."""
    # \x{0}-\x{ff} only: other letters have no Latin-1 byte
    latin = F.when(c.contains("Ã") & c.rlike(r"^[\x{0}-\x{ff}]*$"), c)
    repaired = F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    return F.coalesce(repaired, c)


@pandas_udf(StringType())
def _without_marks(values: pd.Series) -> pd.Series:
    # NFKD covers all of Unicode; Spark SQL has no normalisation function
    return values.str.normalize("NFKD").str.replace(MARKS, "", regex=True)


def normal_form(c: Column) -> Column:
    """Repaired, unaccented, lower-case text with single blanks."""
    plain = _without_marks(repair_mojibake(c))
    return F.regexp_replace(F.lower(strip(plain)), r"\s+", " ")


def plain_lower(c: Column) -> Column:
    return replace_chars(F.lower(c), config.ACCENTS)


def contains_plain(needle: Column, haystack: Column) -> Column:
    """Accent- and case-insensitive containment; false when either side is missing."""
    return F.coalesce(F.contains(plain_lower(haystack), plain_lower(strip(needle))), F.lit(False))


def matching_part(name: Column, answer: Column) -> Column:
    """First comma part of the answer that contains a word of the name, words tried in order; null without one."""
    words = F.filter(F.split(plain_lower(name), " "), lambda w: strip(w) != "")
    parts = F.transform(F.split(answer, ","), lambda p: F.struct(p.alias("raw"), plain_lower(p).alias("plain")))
    hits = let(parts, lambda ps: F.flatten(
        F.transform(words, lambda w: F.filter(ps, lambda p: F.contains(p["plain"], strip(w))))))
    return strip(F.try_element_at(hits, F.lit(1))["raw"])


def strip_prefixes(c: Column, prefixes: Iterable[str] = config.NAME_PREFIXES) -> Column:
    """Keep the text after the first occurrence of each listed prefix, one prefix after the other."""
    listed = F.array(*[F.lit(p) for p in prefixes])

    def after(text: Column, prefix: Column) -> Column:
        start = F.position(prefix, text) + F.length(prefix)
        return F.when(F.contains(text, prefix), strip(F.substring(text, start, F.length(text)))).otherwise(text)

    return F.aggregate(listed, c, after)


def title_case(c: Column) -> Column:
    """Capitalised words; particles stay in lower case except at the ends."""
    particles = F.array(*[F.lit(p) for p in config.TITLE_PARTICLES])

    def shape(word: Column, i: Column, n: Column) -> Column:
        small = F.array_contains(particles, F.lower(word)) & (i > 0) & (i < n - 1)
        # A first letter may grow in upper case (ß becomes SS): only the first of the two stays large
        first = F.upper(F.substring(word, 1, 1))
        rest = F.concat(F.substring(first, 2, 2), F.substring(word, F.lit(2), F.length(word)))
        return F.when(small, F.lower(word)).otherwise(F.concat(F.substring(first, 1, 1), F.lower(rest)))

    return let(F.split(strip(c), r"\s+"), lambda words: F.array_join(
        F.transform(words, lambda word, i: shape(word, i, F.size(words))), " "))


def enumerated(df: DataFrame, column: str, texts_of: Callable[[str], Iterator[str]], to: str, number: str) -> DataFrame:
    """Table function: a row per text that ``texts_of`` yields for the value of a column, numbered from 1.

    Rows leave a task a few thousand at a time while the texts are still being made, so a name with millions of them
    never stands in one row or in memory, and a limit stops the making. A null gives no row. The input column goes.
    """
    kept = [c for c in df.columns if c != column]

    def run(stream):
        for rows in stream:
            passed, values = rows.select(kept), rows.column(column).to_pylist()
            every = ((i, n, text) for i, value in enumerate(values) if value is not None
                     for n, text in enumerate(texts_of(value), 1))
            while some := list(itertools.islice(every, BATCH_ROWS)):
                at, numbers, texts = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [*passed.take(pa.array(at)).columns, pa.array(numbers, pa.int64()), pa.array(texts, pa.string())],
                    names=[*kept, number, to])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name != column)
    return df.select(*[F.col(f"`{c}`") for c in kept], column).mapInArrow(run, f"{fields}`{number}` long, `{to}` string")


def spelling_variants(name: str) -> Iterator[str]:
    """Every spelling with a non-empty subset of n written as ñ; spelling m uses the bits of m as the subset."""
    places = [i for i, c in enumerate(name) if c in "nN"]
    for mask in range(1, 1 << len(places)):
        letters = list(name)
        for k, i in enumerate(places):
            if mask >> k & 1:
                letters[i] = "Ñ" if letters[i] == "N" else "ñ"
        yield "".join(letters)


def word_queries(name: str) -> Iterator[str]:
    """Search texts for a long name: single words by length, then ordered word groups by size; one word gives none."""
    words = re.split(f"[{BLANKS}]+", name.strip(BLANKS))
    if len(words) > 1:
        yield from sorted(words, key=len, reverse=True)
        for size in range(2, len(words) + 1):
            yield from map(" ".join, itertools.combinations(words, size))


def expand_templates(c: Column, templates: Iterable[str]) -> Column:
    """One search text per template."""
    return F.transform(F.array(*[F.lit(t) for t in templates]), lambda t: F.replace(t, F.lit("{name}"), c))


def mentions(c: Column, terms: Iterable[str]) -> Column:
    """True where any of the terms occurs, in any letter case."""
    return c.rlike("(?i)" + "|".join(terms))


def first_feature(answer: Column) -> dict[str, Column]:
    """Longitude, latitude and name of the first feature of a stored geocoder answer."""
    schema = ("features array<struct<geometry: struct<coordinates: array<double>>, "
              "properties: struct<name: string, osm_value: string>>>")
    feature = F.get(F.from_json(answer, schema)["features"], F.lit(0))
    point = feature["geometry"]["coordinates"]
    properties = feature["properties"]
    named = F.when(properties["name"] != "", properties["name"])
    return {"longitude": F.get(point, F.lit(0)), "latitude": F.get(point, F.lit(1)),
            "real_name": F.coalesce(named, properties["osm_value"])}


def page_links(html: Column) -> Column:
    """All links of a stored page as (position, href, text), in page order."""
    pattern = r"""<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>"""
    hrefs = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(hrefs.alias("href"), texts.alias("text")), lambda link, i: F.struct(
        i.alias("position"), strip(link["href"]).alias("href"), strip(F.lower(link["text"])).alias("text")))


def result_link(html: Column, name: Column, base_url: str) -> Column:
    """Address of the first link whose text contains the name or lies inside it."""
    wanted = strip(F.lower(name))
    hit = F.filter(page_links(html), lambda k: F.contains(k["text"], wanted) | F.contains(wanted, k["text"]))
    href = F.get(hit, F.lit(0))["href"]
    return F.when(href.startswith("/"), F.concat(F.lit(base_url), href)).otherwise(href)


def labelled_field(html: Column, label: str) -> Column:
    """Text of the value box that follows the given label in a stored detail page; null when absent or empty."""
    pattern = (r'(?is)<div class="CampoInf">\s*' + label + r'\s*:?\s*</div>\s*'
               r'<div class="ResultadoInf">([^<]*)</div>')
    value = F.regexp_replace(strip(F.regexp_extract(html, pattern, 1)), r"(?U)^\W+", "")
    return F.when(value != "", normal_form(value))
