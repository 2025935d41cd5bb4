"""Filter URLs by rules and, where none fits, by two character language models.

The longest rule that fits decides. URLs decided by a rule are the examples of accepted and rejected ones: all of them
are counted, each byte behind contexts of variable length up to everything before it, and two variable-order Markov
models (each length smoothed with the next shorter one by the number of distinct followers) are made of the counts. An
undecided URL is rejected when the difference of its log likelihoods per byte exceeds a threshold calibrated on examples
that the models have not seen.

The model is a table in Spark, one row per context that the examples hold twice: it grows with the pages, takes in all
bytes as they are, and never passes the driver. URLs are dealt into batches by hash; a batch asks the table for its
distinct contexts only. Contexts are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelcast.llm.common import Rolling, U, blocks, buffers, byte_values, materialise

#: Stands for the begin of a URL in a context; no byte has this value
BEGIN = U(0xD1B54A32D192ED03)
#: A context counts once the examples hold it so often; else the next shorter one is used alone
SUPPORT = 2
#: Bytes of distinct URLs in a batch, on average
BATCH_BYTES = 1 << 18
#: Examples kept out of the counts to calibrate the threshold: crc32(url) modulo this is 0
FOLDS = 5
#: Steps of the threshold search, between these differences per character
GRID = np.linspace(-3.0, 3.0, 601)
Rule = tuple[str, str]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    after = F.expr(f"CASE WHEN instr({url}, '://') > 0 THEN substring({url}, instr({url}, '://') + 3) ELSE '' END")
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def decide(rules: Sequence[tuple[str, Rule]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits ``host`` and ``path``; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, (host, path) in sorted(rules, key=lambda r: (len(r[1][0]) + len(r[1][1]), r[1])):
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path))
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, action).otherwise(verdict)
    return text, verdict


def lengths(longest: int) -> Iterator[int]:
    """Context lengths 0, 1, 2, 3, 4, 6, 8, 12, 16, 24, ... up to ``longest``."""
    yield from range(min(longest, 1) + 1)
    n = 2
    while n <= longest:
        yield n
        if n + n // 2 <= longest:
            yield n + n // 2
        n *= 2


def contexts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, hashes of their contexts, and hashes of context and byte, for each context length from 0 on.

    The begin mark is part of a context, so a place has contexts up to its number in the text plus 1.
    """
    sizes = np.diff(offsets)
    own = np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(len(data)) - offsets[own] + 1
    rolling = Rolling(np.insert(byte_values(data), offsets[:-1], BEGIN))
    for n in lengths(int(depth.max(initial=0))):
        at = np.flatnonzero(depth >= n)
        end = at + own[at] + 1
        yield at, rolling.slices(end - n, end), rolling.slices(end - n, end + 1)


def _counted(stream):
    """Sums of each context and byte over a block of examples."""
    for rows in stream:
        data, offsets = buffers(rows.column("url"))
        n = rows.column("n").to_numpy(zero_copy_only=False)
        bad = rows.column("bad").to_numpy(zero_copy_only=False)
        for first, last in blocks(offsets):
            part, cuts = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            own = np.repeat(np.arange(first, last), np.diff(cuts))
            for at, context, gram in contexts(part, cuts):
                _, index, inverse = np.unique(gram, return_index=True, return_inverse=True)
                weight, block = n[own[at]], bad[own[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context[index].view(np.int64)), pa.array(part[at[index]].astype(np.int16)),
                     *[pa.array(np.bincount(inverse, weight * is_own, len(index)).astype(np.int64))
                       for is_own in (~block, block)]], names=["context", "byte", "allow", "block"])


def _wanted(table: pa.Table) -> pa.Table:
    """The distinct contexts of a batch."""
    data, offsets = buffers(table.column("url"))
    found = [np.unique(np.concatenate([np.unique(context) for _, context, _ in contexts(
        data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])])) for a, b in blocks(offsets) if offsets[a] < offsets[b]]
    distinct = np.unique(np.concatenate(found)) if found else np.zeros(0, U)
    batch = pa.array(np.full(len(distinct), table.column("batch")[0].as_py()), pa.int32())
    return pa.table({"batch": batch, "context": pa.array(distinct.view(np.int64))})


class Table:
    """The rows of the model that a batch asked for."""

    def __init__(self, rows: pa.Table):
        context = rows.column("context").to_numpy().view(U)
        order = np.argsort(context)
        followers = rows.column("followers").combine_chunks().take(pa.array(order))
        size = np.diff(followers.offsets.to_numpy())
        flat = followers.flatten()
        self.context = context[order]
        row = np.repeat(np.arange(len(order)), size)
        byte = flat.field("byte").to_numpy().astype(np.int64)
        place = np.argsort(row * 256 + byte)
        self.gram = (row * 256 + byte)[place]
        #: Counts of context and byte, and sums and distinct followers of the context, for allow and block
        self.counts = [flat.field(v).to_numpy()[place].astype(float) for v in ("allow", "block")]
        self.total = [np.bincount(row[place], c, len(order)) for c in self.counts]
        self.kinds = [np.bincount(row[place], c > 0, len(order)) for c in self.counts]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log likelihood difference per byte of texts, none of them empty."""
        p = [np.full(len(data), 1 / 256) for _ in range(2)]
        for at, context, _ in contexts(data, offsets):
            if not len(self.context):
                break
            row = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
            known = self.context[row] == context
            at, row = at[known], row[known]
            if not len(at):
                break  # no longer context is known either
            wanted = row * 256 + data[at]
            place = np.minimum(np.searchsorted(self.gram, wanted), len(self.gram) - 1)
            hit = self.gram[place] == wanted
            for v in range(2):
                total, kinds = self.total[v][row], self.kinds[v][row]
                # Witten-Bell: the more distinct followers a context has, the more goes to the shorter context
                own = (np.where(hit, self.counts[v][place], 0) + kinds * p[v][at]) / np.maximum(total + kinds, 1)
                p[v][at] = np.where(total > 0, own, p[v][at])
        return np.add.reduceat(np.log(p[1]) - np.log(p[0]), offsets[:-1]) / np.diff(offsets)


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    data, offsets = buffers(left.column("url"))
    table = Table(right)
    values = [table.scores(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in blocks(offsets)]
    return pa.table([*[left.column(c) for c in ("url", "n", "verdict")], pa.array(np.concatenate(values))],
                    names=["url", "n", "verdict", "score"])


def scored(decided: DataFrame) -> DataFrame:
    """``url, n, verdict, score`` of each distinct, filled ``url`` of ``url, verdict``; ``n`` counts its rows.

    The score is the log likelihood difference per byte. The models are made of the rule-decided URLs among them.
    """
    urls = materialise(decided.filter("url <> ''").groupBy("url", "verdict").agg(F.count(F.lit(1)).alias("n")), "urls")
    size = urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    # The number of batches follows from the bytes alone, as each batch asks for the common contexts once more
    dealt = urls.withColumn("batch", F.pmod(F.xxhash64("url"), F.lit(max(1, -(-size // BATCH_BYTES)))).cast("int"))
    examples = urls.filter(F.col("verdict").isNotNull() & ~held_out()).select(
        "url", "n", (F.col("verdict") == "block").alias("bad"))
    counts = (examples.mapInArrow(_counted, "context long, byte short, allow long, block long")
              .groupBy("context", "byte").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    model = (counts.groupBy("context").agg(F.collect_list(F.struct("byte", "allow", "block")).alias("followers"),
                                           F.sum(F.col("allow") + F.col("block")).alias("n"))
             .filter(F.col("n") >= SUPPORT).drop("n"))
    wanted = dealt.select("batch", "url").groupBy("batch").applyInArrow(_wanted, "batch int, context long")
    # A merge join: both sides grow with the pages, whatever the estimate
    asked = wanted.join(model.hint("merge"), "context").select("batch", "context", "followers")
    return materialise(dealt.groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(
        _scored, "url string, n long, verdict string, score double"), "url-scores")


def held_out() -> Column:
    return F.crc32(F.col("url").cast("binary")) % FOLDS == 0


def calibrated(scores: DataFrame) -> float:
    """The threshold by the examples that the models have not seen."""
    step = F.least(F.greatest(F.round((F.col("score") + 3.0) * 100), F.lit(0.0)), F.lit(600.0)).cast("int")
    tried = (scores.filter(F.col("verdict").isNotNull() & held_out())
             .groupBy("verdict", step.alias("step")).agg(F.sum("n").alias("n")).collect())
    hist = {v: np.zeros(601) for v in ("allow", "block")}
    for r in tried:
        hist[r["verdict"]][r["step"]] = r["n"]
    return threshold(hist["allow"], hist["block"])


def threshold(allow: np.ndarray, block: np.ndarray) -> float:
    """Difference above which a url is rejected: the middle of the best balanced accuracy, 0 without both kinds."""
    if not allow.sum() or not block.sum():
        return 0.0
    quality = np.cumsum(allow) / allow.sum() + 1 - np.cumsum(block) / block.sum()
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    return float((GRID[best[0]] + GRID[best[-1]]) / 2 + 0.005)


def judge(pages: DataFrame, rules: Sequence[tuple[str, Rule]], key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``rules`` are (``allow`` or ``block``, (host, path)); a rule fits its host and all its subdomains if the path starts
    with its path, and the longest one wins. Without a fitting rule the models decide; a null or empty url scores 0 and
    is rejected only if the threshold is below 0. If the rules decide no row either way both models are equal, all
    scores are 0 and the threshold is 0: everything else is allowed. Repeated rows are judged alike.
    """
    host, path = host_and_path("url")
    rows = (pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
            .withColumn("host", host).withColumn("path", path))
    rule, verdict = decide(rules)
    decided = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    scores = scored(decided.select("url", "verdict"))
    limit = calibrated(scores)
    # Rows without a url have nothing to join with, and could be many
    filled = F.coalesce(F.col("url") != "", F.lit(False))
    out = (decided.filter(filled).join(scores.select("url", "score").hint("merge"), "url")
           .unionByName(decided.filter(~filled).withColumn("score", F.lit(0.0))))
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "verdict", F.when(F.col("score") > limit, "block").otherwise("allow")).alias("verdict"), "score")
