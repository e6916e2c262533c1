"""Dataset quality: duplicates, bad days, JSON validity, text patterns, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.operators.joins import newest


def compact_minutes(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """One row per key; deterministic where any row would do."""
    return newest(df, keys, order)


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before, distinct keys (= rows after)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))


def without_days(df: DataFrame, bad: DataFrame, day: str = "trade_date") -> DataFrame:
    return df.join(bad.select(day).distinct(), day, "left_anti")


def json_report(df: DataFrame, column: str, table: str) -> DataFrame:
    """Count of unparsable values with the smallest one as example."""
    bad = F.col(column).isNotNull() & F.try_parse_json(column).isNull()
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(bad).alias("invalid"),
        F.min(F.when(bad, F.col(column))).alias("example"),
    ).select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "row_count", "invalid", "example")


def range_report(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    def one(name, df, day):
        return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(F.to_date(day)).alias("min_date"),
                      F.max(F.to_date(day)).alias("max_date")).select(F.lit(name).alias("table_name"), "*")

    return reduce(lambda a, b: a.unionByName(b), [one(n, df, d) for n, (df, d) in tables.items()])


def pattern_report(df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str]) -> DataFrame:
    """Rows whose text columns match each named pattern; whole texts are searched."""
    text = F.concat_ws("\n", *columns)
    row = df.agg(*[F.count_if(text.rlike(p)).alias(n) for n, p in patterns.items()])
    return row.unpivot([], list(patterns), "pattern", "hits")


def pick_symbols(index: DataFrame, n: int) -> DataFrame:
    """Heaviest members of the newest snapshot."""
    last = index.agg(F.max("trade_date")).scalar()
    return index.where(F.col("trade_date") == last).orderBy(F.desc("weight"), "symbol").limit(n).select("symbol")


def consistent_sample(tables: Mapping[str, DataFrame], symbols: DataFrame, start, end) -> dict[str, DataFrame]:
    """The same symbols and date window of every table."""
    out = {}
    for name, df in tables.items():
        rows = df.join(F.broadcast(symbols), "symbol", "left_semi")  # a pick of n symbols
        out[name] = rows.where(F.col("trade_date").between(start, end))
    return out
