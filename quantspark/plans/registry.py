"""Registry of checkable queries: a Spark callable and, where SQL fits, its oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions.expr import Node
from quantspark.operators.panel import with_factors
from quantspark.plans.oracle import factor_sql
from quantspark.sources.panels import VIEW_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: values that end exactly half-way between two roundings go the same way in both engines
HALF_NUDGE = 1e-9

_tables: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, root: str) -> Tables:
    """One Tables per session and folder, so measured sizes are taken once."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _tables:
        _tables[key] = Tables(spark, root)
    return _tables[key]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the views it names, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def tidy(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round the named doubles (and drop negative zero) so that results compare by value."""
    return df.select(
        *[
            (F.round(F.col(c) + HALF_NUDGE, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c)
            for c in df.columns
        ]
    )


def tidy_sql(sql: str, digits: dict[str, int]) -> str:
    if not digits:
        return with_views(sql)
    cols = ", ".join(f"round({c} + {HALF_NUDGE}, {d}) + 0.0 AS {c}" for c, d in digits.items())
    inner = with_views(sql)
    return f"SELECT * REPLACE ({cols}) FROM ({inner}) checked_"


def query(name: str, sql: str | None = None, **digits: int):
    """Register ``fn(tables) -> DataFrame``; ``digits`` names the doubles to round."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, root: tidy(fn(tables(spark, root)), digits)
        if sql is not None:
            ORACLES[name] = tidy_sql(sql, digits)
        return fn

    return wrap


def factor(name: str, node: Node, panel: str = "panel_d", digits: int = 6, bars=None, source=None):
    """Register one factor expression evaluated over a whole panel.

    ``bars``/``source`` replace the panel by a prepared frame and its SQL twin.
    """

    def build(t: Tables) -> DataFrame:
        df = bars(t) if bars else getattr(t, panel)
        rows, section_rows = t.sizes_l if panel in ("panel_l", "panel_m") else t.sizes_d
        out = with_factors(df, {"value": node}, section_rows=section_rows, rows=rows)
        return tidy(out.select("symbol", "trade_date", "value"), {"value": digits})

    QUERIES[name] = lambda spark, root: build(tables(spark, root))
    ORACLES[name] = with_views(factor_sql(source or panel, {"value": node}, digits=digits))
