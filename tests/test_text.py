import itertools
import unicodedata

import pytest
from pyspark.sql import functions as F

from panelcast import config
from panelcast.functions import text as tx


def apply(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("s"))).collect()]


def listed(spark, values, texts_of):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    out = [[] for _ in values]
    for r in tx.enumerated(df, "s", texts_of, "text", "n").collect():
        out[r.i].append((r.n, r.text))
    assert all([n for n, _ in own] == list(range(1, len(own) + 1)) for own in out)
    return [[text for _, text in own] for own in out]


def test_name_key(spark):
    assert apply(spark, ["El Grado", "La Presa de la Toba", "San José, del Río/Niño", "Peñarroya-Pueblo", None], tx.name_key) == [
        "grado", "presa toba", "san jose  rio nino", "penarroya pueblo", None]


def test_normal_form_covers_unicode(spark):
    samples = ["Córdoba", "CÃ³rdoba", "  Jaén\n y\tLeón ", "ﬁlò Ⅷ ½", "Łódź", "Ã", None]

    def plain(text):
        if text is None:
            return None
        try:
            text = text.encode("latin1").decode("utf-8") if "Ã" in text else text
        except (UnicodeDecodeError, UnicodeEncodeError):
            pass
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return " ".join(text.strip().lower().split())

    assert apply(spark, samples, tx.normal_form) == [plain(s) for s in samples]


def test_spelling_variants(spark):
    names = ["nan", "Niño", "sol", "anon Norte"]

    def variants(name):
        spots = [i for i, c in enumerate(name) if c in "nN"]
        out = []
        for mask in range(1, 2 ** len(spots)):
            letters = list(name)
            for j, spot in enumerate(spots):
                if mask >> j & 1:
                    letters[spot] = {"n": "ñ", "N": "Ñ"}[letters[spot]]
            out.append("".join(letters))
        return out

    assert listed(spark, names, tx.spelling_variants) == [variants(n) for n in names]


def test_word_queries(spark):
    def queries(name):
        words = name.split()
        if len(words) < 2:
            return []
        groups = [" ".join(words[i] for i in c) for k in range(2, len(words) + 1)
                  for c in itertools.combinations(range(len(words)), k)]
        return sorted(words, key=len, reverse=True) + groups

    names = ["uno", "uno dos", "los tres rios altos", "a bb a"]
    assert listed(spark, names, tx.word_queries) == [queries(n) for n in names]


@pytest.mark.parametrize("texts_of,name", [(tx.spelling_variants, "n" * 40), (tx.word_queries, " ".join(f"w{i}" for i in range(40)))])
def test_enumeration_stops_at_a_limit(spark, texts_of, name):
    df = spark.createDataFrame([(1, None), (2, name)], "i int, s string")
    rows = tx.enumerated(df, "s", texts_of, "text", "n").limit(9000).collect()
    assert [(r.i, r.n, r.text) for r in rows] == [(2, n, t) for n, t in enumerate(itertools.islice(texts_of(name), 9000), 1)]


def test_prefixes_and_titles(spark):
    assert apply(spark, ["Embalse de la Toba", "Presa de Embalse del Agua", "Pantà de Foix", "Tous"], tx.strip_prefixes) == [
        "Toba", "Agua", "Foix", "Tous"]
    assert apply(spark, ["el PUENTE de los rios", "la  toba", "ßa y o"], tx.title_case) == [
        "El Puente de los Rios", "La Toba", "Ssa y O"]
    assert len(config.NAME_PREFIXES) == 38


def test_matching_part(spark):
    df = spark.createDataFrame([("canal taibilla", "Embalse del Taibilla, Murcia, España"), ("grado", "Aragón, El Gradó"),
                                ("a  b", "xyz, c")], "name string, answer string")
    got = [r[0] for r in df.select(tx.matching_part(F.col("name"), F.col("answer"))).collect()]
    assert got == ["Embalse del Taibilla", "El Gradó", None]


def test_stored_answers(spark):
    answers = ['{"features": [{"geometry": {"coordinates": [-4.5, 37.2]}, "properties": {"name": "Lago"}}]}',
               '{"features": [{"geometry": {"coordinates": [1, 2]}, "properties": {"osm_value": "water"}}]}',
               '{"features": []}', "broken"]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in tx.first_feature(F.col("a")).items()]).collect()]
    assert got == [(-4.5, 37.2, "Lago"), (1.0, 2.0, "water"), (None, None, None), (None, None, None)]


def test_stored_pages(spark):
    page = ('<div class="CampoInf">Río:</div><div class="ResultadoInf">Duero</div>'
            '<div class="CampoInf"> Provincia: </div>\n<div class="ResultadoInf"> » Ávila </div>')
    assert apply(spark, [page, "<p></p>"], lambda c: tx.labelled_field(c, "provincia")) == ["avila", None]
    links = '<a class="x" href="/uno">Embalse Uno</a><a href="http://b/dos">dos</a>'
    assert apply(spark, [links], lambda c: tx.result_link(c, F.lit("UNO"), "https://x")) == ["https://x/uno"]
    assert apply(spark, [links], lambda c: tx.result_link(c, F.lit("los dos"), "https://x")) == ["http://b/dos"]
