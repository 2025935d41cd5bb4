"""Scalar and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast import config
from panelcast.functions import text as tx
from panelcast.functions.columns import comma_number, sentinel_to_null, to_number
from panelcast.functions.dates import calendar, cyclic, parse_date, parse_two_digit_year
from panelcast.functions.geo import haversine_km
from panelcast.queries import fixtures as fx
from panelcast.queries.registry import query, with_ctes

BLANK = "(E' \\t\\n\\r' || chr(12) || chr(11))"


def sql_list(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def docs(spark, sf):
    return fx.table(spark, sf, "documents")


ARTICLES = sql_list([f" {a} " for a in config.ARTICLES])
KEY = (f"trim(list_reduce({ARTICLES}, lambda acc, a: replace(acc, a, ' '), "
       "' ' || translate(lower({c}), 'áéíóúñüç,-/', 'aeiounuc   ') || ' '), " + BLANK + ")")


@query("str01_name_key", f"SELECT doc_id, {KEY.format(c='text')} AS name_key FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.name_key(F.col("text")).alias("name_key"))


@query("str02_text_normal_form", """SELECT doc_id, regexp_replace(lower(trim(strip_accents(text), (E' \\t\\n\\r' || chr(12) || chr(11)))),
 '\\s+', ' ', 'g') AS plain FROM documents""")
def _(spark, sf):
    # Texts that hold an accented Latin-1 letter are read with the wrong charset, then repaired
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    seen = F.when(F.col("text").rlike("[À-ÿ]") & (F.col("doc_id") % 2 == 0), broken).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", tx.normal_form(seen).alias("plain"))


@query("str03_contains_plain", """SELECT doc_id, contains(translate(lower(text), 'áéíóúüñ', 'aeiouun'),
 trim(translate(lower(split_part(text, ' ', 2)), 'áéíóúüñ', 'aeiouun'), (E' \\t\\n\\r' || chr(12) || chr(11)))) AS own,
 contains(translate(lower(text), 'áéíóúüñ', 'aeiouun'), 'cion') AS has_cion FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.contains_plain(F.split_part("text", F.lit(" "), F.lit(2)), F.col("text")).alias("own"),
        tx.contains_plain(F.lit("CIÓN "), F.col("text")).alias("has_cion"))


@query("str04_matching_part", """WITH named AS (SELECT doc_id, text,
 split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 1) AS name FROM documents),
 words AS (SELECT doc_id, unnest(string_split(translate(lower(name), 'áéíóúüñ', 'aeiouun'), ' ')) AS w,
 generate_subscripts(string_split(translate(lower(name), 'áéíóúüñ', 'aeiouun'), ' '), 1) AS wi FROM named),
 parts AS (SELECT doc_id, unnest(string_split(text, ',')) AS p, generate_subscripts(string_split(text, ','), 1) AS pi
 FROM named)
 SELECT w.doc_id, trim(arg_min(p, wi * 1000000 + pi), (E' \\t\\n\\r' || chr(12) || chr(11))) AS real_name FROM words w
 JOIN parts p ON p.doc_id = w.doc_id AND contains(translate(lower(p), 'áéíóúüñ', 'aeiouun'),
 trim(w, (E' \\t\\n\\r' || chr(12) || chr(11)))) WHERE trim(w, (E' \\t\\n\\r' || chr(12) || chr(11))) <> '' GROUP BY w.doc_id""")
def _(spark, sf):
    name = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(3)), F.split_part("text", F.lit(" "), F.lit(1)))
    return (docs(spark, sf).select("doc_id", tx.matching_part(name, F.col("text")).alias("real_name"))
            .filter(F.col("real_name").isNotNull()))


PREFIXES = sql_list(config.NAME_PREFIXES)


@query("str05_strip_prefixes", f"""WITH named AS (SELECT p_partkey, coalesce(
 {PREFIXES}[CAST(p_partkey % 45 AS INTEGER)], 'Cerca de ') || 'la ' || p_name AS full_name FROM part)
 SELECT p_partkey, list_reduce({PREFIXES}, lambda acc, p: CASE WHEN contains(acc, p)
 THEN trim(substr(acc, CAST(strpos(acc, p) + length(p) AS BIGINT)), {BLANK}) ELSE acc END, full_name) AS real_name
 FROM named""")
def _(spark, sf):
    listed = F.array(*[F.lit(p) for p in config.NAME_PREFIXES])
    prefix = F.coalesce(F.get(listed, (F.col("p_partkey") % 45).cast("int") - 1), F.lit("Cerca de "))
    full = F.concat(prefix, F.lit("la "), F.col("p_name"))
    return fx.table(spark, sf, "part").select("p_partkey", tx.strip_prefixes(full).alias("real_name"))


@query("str06_title_case", """WITH s AS (SELECT doc_id,
 regexp_split_to_array(trim(text, (E' \\t\\n\\r' || chr(12) || chr(11))), '\\s+') AS w FROM documents)
 SELECT doc_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN list_contains(
 ['de', 'del', 'la', 'las', 'los', 'y', 'el'], lower(x)) AND i > 1 AND i < len(w) THEN lower(x)
 ELSE replace(upper(x[1:1]), 'ẞ', 'Ss') || lower(x[2:]) END), ' ') AS title FROM s""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", tx.title_case(F.col("text")).alias("title"))


def long_name():
    return F.concat_ws(" ", "p_name", F.initcap("p_type"), "p_brand")


LONG = """named AS (SELECT p_partkey, p_name || ' ' || upper(p_type[1:1]) || lower(p_type[2:]) || ' ' || p_brand AS name
 FROM part)"""


@query("str07_spelling_variants", f"""WITH {LONG}, counted AS (SELECT p_partkey, name,
 length(regexp_replace(name, '[^nN]', '', 'g')) AS k FROM named),
 masks AS (SELECT *, unnest(generate_series(1, CAST(power(2, k) AS BIGINT) - 1)) AS m FROM counted)
 SELECT p_partkey, m AS variant, array_to_string(list_transform(generate_series(1, length(name)), lambda i:
 CASE WHEN lower(name[i:i]) = 'n' AND (m >> length(regexp_replace(name[1:i-1], '[^nN]', '', 'g'))) % 2 = 1
 THEN CASE WHEN name[i:i] = 'N' THEN 'Ñ' ELSE 'ñ' END ELSE name[i:i] END), '') AS spelling FROM masks""")
def _(spark, sf):
    names = fx.table(spark, sf, "part").select("p_partkey", long_name().alias("name"))
    return tx.enumerated(names, "name", tx.spelling_variants, "spelling", "variant")


@query("str08_word_queries", f"""WITH {LONG}, s AS (SELECT p_partkey, string_split(name, ' ') AS w FROM named),
 masks AS (SELECT *, unnest(generate_series(1, CAST(power(2, len(w)) AS BIGINT) - 1)) AS m FROM s WHERE len(w) > 1),
 picked AS (SELECT p_partkey, w, list_filter(generate_series(1, len(w)), lambda i: (m >> (i - 1)) % 2 = 1) AS ix
 FROM masks)
 SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY len(ix),
 CASE WHEN len(ix) = 1 THEN -length(w[ix[1]]) ELSE 0 END, ix) AS position,
 array_to_string(list_transform(ix, lambda i: w[i]), ' ') AS query FROM picked""")
def _(spark, sf):
    names = fx.table(spark, sf, "part").select("p_partkey", long_name().alias("name"))
    return tx.enumerated(names, "name", tx.word_queries, "query", "position")


TEMPLATES = config.COORDINATE_QUERY_TEMPLATES + config.NAME_QUERY_TEMPLATES


@query("str09_query_templates", f"""SELECT p_partkey, replace(t, '{{name}}', p_name) AS query
 FROM part, (SELECT unnest({sql_list(TEMPLATES)}) AS t)""")
def _(spark, sf):
    return fx.table(spark, sf, "part").select(
        "p_partkey", F.explode(tx.expand_templates(F.col("p_name"), TEMPLATES)).alias("query"))


@query("str10_term_classes", """SELECT doc_id, regexp_matches(text, '(?i)reservoir|dam|embalse') AS dam_terms,
 regexp_matches(text, '(?i)rio|arroyo|riu|rambla|barranc') AS river_terms FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select(
        "doc_id", tx.mentions(F.col("text"), ["reservoir", "dam", "embalse"]).alias("dam_terms"),
        tx.mentions(F.col("text"), ["rio", "arroyo", "riu", "rambla", "barranc"]).alias("river_terms"))


@query("dat01_calendar", with_ctes([fx.WK], """SELECT id, date, week(date) AS week_of_year, year(date) AS year,
 month(date) AS month, dayofyear(date) AS day_of_year, CAST(month(date) BETWEEN 6 AND 9 AS BIGINT) AS is_summer,
 CAST(month(date) IN (12, 1, 2) AS BIGINT) AS is_winter FROM wk""", t="date"))
def _(spark, sf):
    made = calendar(F.col("date"))
    return fx.readings(spark, sf).select("id", "date", *[c.alias(k) for k, c in made.items()])


@query("mth01_haversine", with_ctes([fx.DIMS], f"""SELECT id, {fx.KM.format(a='x.', b='x.')} * 0 +
 {fx.km_sql('home', 'x')} AS km FROM dims x, (SELECT 40.4168::DOUBLE AS latitude, -3.7038::DOUBLE AS longitude) home""",
                                    d="km"))
def _(spark, sf):
    return fx.dims(spark, sf).select("id", haversine_km("40.4168D", "-3.7038D", "latitude", "longitude").alias("km"))


@query("mth02_cyclic", with_ctes([fx.WK], """SELECT id, date, sin(2 * pi() * week(date) / 52.0) AS week_sin,
 cos(2 * pi() * week(date) / 52.0) AS week_cos, sin(2 * pi() * (month(date) - 1) / 12.0) AS month_sin,
 cos(2 * pi() * (month(date) - 1) / 12.0) AS month_cos FROM wk""", t="date",
                                 d="week_sin week_cos month_sin month_cos"))
def _(spark, sf):
    made = cyclic(F.col("date"))
    return fx.readings(spark, sf).select("id", "date", *[c.alias(k) for k, c in made.items()])


ANSWERS = """answers AS (SELECT id, CASE WHEN id % 5 = 0 THEN '{"features": []}' ELSE
 '{"features": [{"geometry": {"coordinates": [' || longitude || ', ' || latitude || ']}, "properties": {' ||
 CASE WHEN id % 3 = 0 THEN '' ELSE '"name": "' || name || '", ' END || '"osm_value": "water"}}]}' END AS answer FROM dims)"""


@query("jsn02_first_feature", with_ctes([fx.DIMS, ANSWERS], """SELECT id,
 CAST(answer->>'$.features[0].geometry.coordinates[0]' AS DOUBLE) AS longitude,
 CAST(answer->>'$.features[0].geometry.coordinates[1]' AS DOUBLE) AS latitude,
 coalesce(answer->>'$.features[0].properties.name', answer->>'$.features[0].properties.osm_value') AS real_name
 FROM answers""", d="longitude latitude"))
def _(spark, sf):
    d = fx.dims(spark, sf)
    named = F.when(F.col("id") % 3 != 0, F.col("name"))
    feature = F.struct(
        F.struct(F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
        F.struct(named.alias("name"), F.lit("water").alias("osm_value")).alias("properties"))
    answer = F.when(F.col("id") % 5 == 0, F.lit('{"features": []}')).otherwise(
        F.to_json(F.struct(F.array(feature).alias("features"))))
    stored = d.select("id", answer.alias("answer"))
    return stored.select("id", *[c.alias(k) for k, c in tx.first_feature(F.col("answer")).items()])


LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
 unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) AS pos FROM pages)"""


@query("htm01_result_link", with_ctes([LINKS, "wanted AS (SELECT page_id, trim(lower(text)) AS name FROM links WHERE pos = 3)"],
       """SELECT w.page_id, arg_min(CASE WHEN starts_with(href, '/') THEN 'https://example.org' || href ELSE href END, pos)
 AS url FROM wanted w JOIN links l ON l.page_id = w.page_id AND (contains(trim(lower(l.text)), w.name)
 OR contains(w.name, trim(lower(l.text)))) GROUP BY w.page_id"""))
def _(spark, sf):
    name = F.get(tx.page_links(F.col("html")), F.lit(2))["text"]
    return (fx.table(spark, sf, "pages").filter(name.isNotNull())
            .select("page_id", tx.result_link(F.col("html"), name, "https://example.org").alias("url")))


@query("htm01_page_links", with_ctes([LINKS], """SELECT page_id, pos - 1 AS position, trim(href) AS href,
 trim(lower(text)) AS text FROM links"""))
def _(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.inline(tx.page_links(F.col("html"))))


@query("htm01_labelled_field", with_ctes([fx.DIMS], """SELECT id, CASE WHEN id % 6 <> 0 THEN lower(province) END
 AS province FROM dims"""))
def _(spark, sf):
    value = F.when(F.col("id") % 6 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" » "), F.col("province")))
    page = F.concat(F.lit('<html><div class="FilaSeccion"><div class="CampoInf">Río:</div><div class="ResultadoInf">'),
                    F.col("name"), F.lit('</div></div><div class="FilaSeccion"><div class="CampoInf"> Provincia: '
                                         '</div><div class="ResultadoInf">'), value, F.lit("</div></div></html>"))
    return fx.dims(spark, sf).select("id", tx.labelled_field(page, "provincia").alias("province"))


@query("prj02_safe_number", with_ctes([fx.WK, fx.RAW], """SELECT id, date, TRY_CAST(storage AS DOUBLE) AS storage
 FROM raw_txt"""))
def _(spark, sf):
    return fx.raw_text(spark, sf).select("id", "date", to_number(F.col("storage")).alias("storage"))


@query("prj03_decimal_comma", with_ctes([fx.POINTS], """SELECT id, crest_elevation AS value FROM points""", d="value"))
def _(spark, sf):
    written = F.replace(F.col("crest_elevation").cast("string"), F.lit("."), F.lit(","))
    return fx.parts_on_map(spark, sf).select("id", comma_number(F.coalesce(written, F.lit("n/d"))).alias("value"))


@query("prj04_parse_date", with_ctes([fx.WK], "SELECT id, date AS parsed, storage FROM wk", t="parsed"))
def _(spark, sf):
    # Four written forms of the same date: strict, unpadded, and two that need the lenient pass
    forms = [F.date_format("date", f) for f in ("dd/MM/yyyy", "d/M/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")]
    i = F.col("id") % 4
    written = F.when(i == 0, forms[0]).when(i == 1, F.concat(F.lit(" "), forms[1])).when(i == 2, forms[2]) \
        .otherwise(forms[3])
    return fx.readings(spark, sf).select("id", parse_date(written).alias("parsed"), "storage")


@query("prj05_two_digit_year", with_ctes([fx.WK], "SELECT id, date, storage FROM wk", t="date"))
def _(spark, sf):
    written = F.date_format("date", "dd/MM/yy 00:00:00")
    return fx.readings(spark, sf).select("id", parse_two_digit_year(written).alias("date"), "storage")


@query("prj07_sentinel", with_ctes([fx.POINTS], """SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE name END AS riverbed
 FROM points"""))
def _(spark, sf):
    named = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 2 == 0, "Sin Nombre").otherwise("SIN NOMBRE"))
    return fx.parts_on_map(spark, sf).select(
        "id", sentinel_to_null(F.coalesce(named, F.col("name")), config.UNNAMED).alias("riverbed"))
