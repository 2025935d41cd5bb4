"""Remove multi-line chunks that occur again, in DataFrame functions only.

A text is cut into chunks of lines where a rolling hash over the last three line hashes is divisible by four, and at its
end. The places follow the content, so lines inserted before a passage shift its chunks but leave them as they are.
Chunks of two lines and more are told apart by digest; of each digest the first place in order (id, chunk) stays, and
a later chunk goes only after its bytes were compared with those of the first.

Ends may follow each other directly, and a chunk of one line is never removed. With ``paired`` an end counts only once
its chunk has two lines, and a last single line joins the chunk before it, so every line of a text of two lines and
more can go. The registered query keeps the cut of ``SQL``, which knows no pairs; the pipeline uses pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import keyed, materialise

#: Lines under the rolling hash, and one line in so many ends a chunk
REACH, EVERY = 3, 4
#: A chunk of fewer lines, or of fewer characters, is never removed
MIN_LINES, MIN_CHARS = 2, 20


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row: a generator keeps the optimiser from copying the expression."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _paired(ends: str) -> str:
    """Of these ends (the last line among them) those that leave at least two lines to each chunk of a longer text."""
    far = f"aggregate({ends}, cast(array() as array<int>), (a, i) -> if(i - coalesce(get(a, size(a) - 1), -1) >= 2, " \
          "array_append(a, i), a))"
    last = "size(h) - 1"
    # A single line is left behind the last end: that chunk ends with it instead
    return (f"transform(array({far}), a -> if(get(a, size(a) - 1) = {last}, a, "
            f"array_append(if(size(a) > 0, slice(a, 1, size(a) - 1), a), {last})))[0]")


def _chunks(rows: DataFrame, text: Column, paired: bool) -> DataFrame:
    """Add ``chunks``: number, line count and body of each chunk of a text; null for a null text."""
    df = _settled(rows, "lines", F.split(text, "\n"))
    df = _settled(df, "h", F.expr("transform(lines, x -> cast(conv(substring(md5(x), 1, 7), 16, 10) as bigint))"))
    rolled = " + ".join(f"{5 ** i} * coalesce(get(h, i - {i}), 0)" for i in range(REACH))
    df = _settled(df, "ends", F.expr(f"if(h is null, null, filter(sequence(0, size(h) - 1), "
                                     f"i -> i = size(h) - 1 or ({rolled}) % {EVERY} = 0))"))
    if paired:
        df = _settled(df.withColumnRenamed("ends", "all_ends"), "ends",
                      F.expr(f"if(all_ends is null, null, {_paired('all_ends')})")).drop("all_ends")
    start = "if(k = 0, 0, get(ends, k - 1) + 1)"
    body = f"array_join(slice(lines, {start} + 1, get(ends, k) + 1 - ({start})), '\\n')"
    chunk = (f"if(ends is null, null, transform(sequence(0, size(ends) - 1), k -> named_struct('chunk', k, "
             f"'n', get(ends, k) + 1 - ({start}), 'body', {body})))")
    return _settled(df, "chunks", F.expr(chunk)).drop("lines", "h", "ends")


def _listed(rows: DataFrame, paired: bool) -> DataFrame:
    """One row per chunk that may be removed."""
    return (_chunks(rows, F.col("text"), paired).select("key", F.inline("chunks"))
            .filter((F.col("n") >= MIN_LINES) & (F.length("body") >= MIN_CHARS)))


def repeats(rows: DataFrame, paired: bool = False) -> DataFrame:
    """``key, chunk`` of the chunks whose bytes occur at an earlier place."""
    named = _listed(rows, paired).select("key", "chunk", F.md5("body").alias("digest"))
    first = (named.groupBy("digest").agg(F.min(F.struct("key", "chunk")).alias("first"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("digest", "first"))
    # Every place of a repeated digest; the smallest one is what the others are compared with
    places = materialise(named.join(first, "digest").select("digest", "key", "chunk",
                                                            (F.struct("key", "chunk") == F.col("first")).alias("lead")),
                         "line-places")
    wanted = places.groupBy("key").agg(F.collect_list(F.struct("chunk", "digest", "lead")).alias("wanted"))
    # Merge joins throughout: the texts move once for each, whatever the other side's size
    held = _chunks(rows.select("key", "text").join(wanted.hint("merge"), "key"), F.col("text"), paired)
    bodies = (held.select("key", F.explode("wanted").alias("w"), "chunks")
              .select("key", "w.*", F.expr("get(chunks, w.chunk).body").alias("body")))
    lead = bodies.filter("lead").select("digest", F.col("body").alias("lead_body"))
    return (bodies.filter("not lead").join(lead, "digest").filter("body = lead_body").select("key", "chunk"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", paired: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, n_chunks_removed, kept``: texts without chunks that occurred earlier.

    Lines are parted by line feeds and joined again by them; an empty or null text is one empty line. Earlier means a
    smaller id, or the same text and a smaller place. Rows that repeat an id or have none are texts of their own,
    ordered by (id, text), nulls first. Other columns of the input are not read.
    """
    rows, _ = keyed(docs, key, text)
    return _removed(rows, paired).drop("key")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", paired: bool = False) -> DataFrame:
    """The rows of ``docs`` with their repeated chunks taken out of the text; rows that lose all of it go.

    A row whose text was empty or null from the start stays. Other columns pass through unchanged.
    """
    rows, _ = keyed(docs, key, text, carry=True)
    kept = _removed(rows.select("key", "doc_id", "text"), paired).filter("n_removed > 0").select("key", "kept")
    out = rows.select("key", "row").join(kept, "key", "left").filter("kept is null or kept <> ''")
    row = [F.when(F.col("kept").isNotNull(), F.col("kept")).otherwise(F.col(f"row.`{c}`")).alias(c) if c == text
           else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*row)


def _removed(rows: DataFrame, paired: bool) -> DataFrame:
    gone = repeats(rows, paired).groupBy("key").agg(F.collect_set("chunk").alias("gone"))
    df = rows.select("key", "doc_id", "text").join(gone.hint("merge"), "key", "left")
    df = _chunks(df, F.when(F.col("gone").isNotNull(), F.col("text")), paired)
    plain = F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + 1
    lines = "aggregate({}, 0L, (a, c) -> a + c.n)"
    cut = "filter(chunks, c -> array_contains(gone, c.chunk))"
    left = "array_join(transform(filter(chunks, c -> not array_contains(gone, c.chunk)), c -> c.body), '\\n')"
    return df.select("key", "doc_id", F.coalesce(F.expr(lines.format("chunks")), plain.cast("long")).alias("n_lines"),
                     F.coalesce(F.expr(lines.format(cut)), F.lit(0).cast("long")).alias("n_removed"),
                     F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_chunks_removed"),
                     F.coalesce(F.expr(left), "text").alias("kept"))


#: The same in DuckDB SQL, over ``documents`` with distinct ids; ``{source}`` gives doc_id and text
SQL = f"""
ln AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i,
              len(string_split(text, chr(10))) AS n
       FROM (SELECT doc_id, coalesce(text, '') AS text FROM {{source}})),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM ln),
rolled AS (SELECT *, {' + '.join(f'{5 ** i} * coalesce(lag(h, {i}) OVER w, 0)' if i else 'h' for i in range(REACH))} AS r
           FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, line, i, n, coalesce(sum(CASE WHEN r % {EVERY} = 0 THEN 1 ELSE 0 END) OVER (
                 PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
             FROM rolled),
chunks AS (SELECT doc_id, chunk, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body
           FROM numbered GROUP BY doc_id, chunk),
ranked AS (SELECT *, CASE WHEN lines >= {MIN_LINES} AND length(body) >= {MIN_CHARS} THEN row_number() OVER (
               PARTITION BY body, lines >= {MIN_LINES} ORDER BY doc_id, chunk) ELSE 1 END AS place FROM chunks),
deduped AS (SELECT doc_id, CAST(sum(lines) AS BIGINT) AS n_lines,
                   CAST(coalesce(sum(lines) FILTER (place > 1), 0) AS BIGINT) AS n_removed,
                   CAST(count(*) FILTER (place > 1) AS BIGINT) AS n_chunks_removed,
                   coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (place = 1), '') AS kept
            FROM ranked GROUP BY doc_id)"""
