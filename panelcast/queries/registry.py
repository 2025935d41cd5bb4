"""Query registry: a Spark callable and, where SQL can say it, the same question in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its result gets ISO dates and doubles rounded to six places, as the SQL does."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf: present(fn(spark, sf))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def present(df: DataFrame) -> DataFrame:
    """Engine-neutral output types."""
    out = []
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind == "double":
            c = F.round(c, 6) + F.lit(0.0)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)


def neutral(sql: str, **kinds: str) -> str:
    """The SQL side of ``present``: ``d`` lists double columns, ``t`` date columns, ``i`` integer columns."""
    parts = [f"round({c}, 6) + 0.0 AS {c}" for c in kinds.get("d", "").split()]
    parts += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in kinds.get("t", "").split()]
    parts += [f"CAST({c} AS BIGINT) AS {c}" for c in kinds.get("i", "").split()]
    if not parts:
        return sql
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql}) AS result"


def with_ctes(ctes: list[str], body: str, **kinds: str) -> str:
    """``WITH`` the named helper tables; ``body`` is one SELECT."""
    if kinds:
        body = neutral(body, **kinds)
    return (f"WITH {', '.join(ctes)}\n" if ctes else "") + body
