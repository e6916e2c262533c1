"""Versioned factor store: an append-only long table where the newest version wins."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.functions.expr import Node
from quantspark.operators.joins import newest
from quantspark.operators.panel import with_factors

KEY = ["symbol", "trade_date", "as_of_time", "factor_name", "params_hash"]
COLUMNS = [*KEY, "value", "source", "version"]


def params_hash(params: Mapping | None) -> str:
    """First 16 hex digits of the SHA-1 of the canonical JSON of ``params``."""
    text = json.dumps(dict(params or {}), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def params_hash_column(params: Column) -> Column:
    """The same hash for a string-to-string map column."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(params)))
    return F.substring(F.sha1(F.to_json(ordered)), 1, 16)


def normal_time(text: Column) -> Column:
    """'9:5', '0905' or '09:05:00' to 'HH:MM'; empty stays empty."""
    t = F.trim(F.coalesce(text, F.lit("")))
    digits = F.when(t.rlike("^[0-9]{4}$"), F.concat(F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2))).otherwise(t)
    parts = F.split(digits, ":")
    padded = F.concat(F.lpad(parts[0], 2, "0"), F.lit(":"), F.lpad(F.get(parts, F.lit(1)), 2, "0"))
    return F.when(t == "", "").otherwise(padded)


def normalise(batch: DataFrame, source: str = "batch", version: int | None = None) -> DataFrame:
    """Append-ready rows: defaults filled, numbers cast, nulls dropped, last row per key kept."""
    have = set(batch.columns)
    if "factor_name" not in have and "feature_name" in have:
        batch = batch.withColumnRenamed("feature_name", "factor_name")
    missing = {"symbol", "trade_date", "factor_name", "value"} - set(batch.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")

    def default(name: str, value):
        return F.coalesce(F.col(name), F.lit(value)) if name in have else F.lit(value)

    rows = batch.withColumns(
        {
            "as_of_time": default("as_of_time", ""),
            "params_hash": default("params_hash", params_hash({})),
            "source": default("source", source),
            "version": default("version", 0 if version is None else version),
            "value": F.expr("try_cast(value AS double)"),
        }
    )
    value = F.col("value")
    rows = rows.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return newest(rows.select(*COLUMNS), KEY, F.struct("version", "value"))


def append(batch: DataFrame, path: str, **defaults) -> None:
    rows = normalise(batch, **defaults)
    rows = rows.withColumns({"year": F.year("trade_date"), "month": F.date_format("trade_date", "MM")})
    # months go together; AQE splits a month that outgrows a task
    rows.hint("rebalance", F.col("year"), F.col("month")).sortWithinPartitions(
        "year", "month", "factor_name", "symbol", "trade_date"
    ).write.mode("append").partitionBy("year", "month").parquet(path)


def latest(store: DataFrame) -> DataFrame:
    """Newest version of every logical key; the greater value where versions tie."""
    return newest(store, KEY, F.struct("version", "value"))


def load(store, names=None, start=None, end=None, symbols=None, as_of_time=None, hash_=None) -> DataFrame:
    """Latest-wins values; filters run before the versions are compared."""
    if names:
        store = store.where(F.col("factor_name").isin(list(names)))
    if start is not None:
        store = store.where(F.col("trade_date") >= start)
    if end is not None:
        store = store.where(F.col("trade_date") <= end)
    if symbols:
        store = store.where(F.col("symbol").isin(list(symbols)))
    if as_of_time is not None:
        store = store.where(F.col("as_of_time") == as_of_time)
    if hash_ is not None:
        store = store.where(F.col("params_hash") == hash_)
    return latest(store)


def cross_section(store, name, day, **filters) -> DataFrame:
    """One value per symbol on a date."""
    rows = load(store, [name], day, day, **filters)
    return newest(rows, ["symbol"], F.struct("version", "as_of_time", "params_hash"), ["value"])


def preview(store, name, day, limit=20) -> DataFrame:
    return cross_section(store, name, day).orderBy("value", "symbol").limit(limit)


def coverage(store: DataFrame) -> DataFrame:
    """Rows, symbols, dates and date range per factor on the latest-wins view.

    Two-level counting (factor, symbol) then (factor) keeps a big factor off one task.
    """
    rows = latest(store)
    by_symbol = rows.groupBy("factor_name", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")
    )
    totals = by_symbol.groupBy("factor_name").agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("symbols"),
        F.min("lo").alias("min_date"), F.max("hi").alias("max_date"),
    )
    dates = rows.groupBy("factor_name", "trade_date").agg(F.lit(1).alias("d")).groupBy("factor_name").agg(
        F.count("d").alias("dates")
    )
    return totals.join(dates, "factor_name")


def variants(store: DataFrame, limit_per_factor=10, default_hash: str | None = None) -> DataFrame:
    """(factor, params_hash, as_of_time) variants, the fullest few per factor."""
    groups = latest(store).groupBy("factor_name", "params_hash", "as_of_time").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("trade_date").alias("max_date")
    )
    w = Window.partitionBy("factor_name").orderBy(F.desc("row_count"), "params_hash", "as_of_time")
    ranked = groups.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit_per_factor)
    is_default = F.col("params_hash") == (default_hash or params_hash({}))
    return ranked.withColumn("is_default", is_default).drop("rn")


def common_date_before(store, names: Sequence[str], day) -> DataFrame:
    """Latest date before ``day`` that every named factor has reached; NULL if one has none."""
    last = (
        store.where(F.col("factor_name").isin(list(names)) & (F.col("trade_date") < day))
        .groupBy("factor_name").agg(F.max("trade_date").alias("last"))
    )
    return last.agg(F.when(F.count(F.lit(1)) == len(set(names)), F.min("last")).alias("trade_date"))


def mixed_dates(store, effective: Mapping[str, object]) -> DataFrame:
    """Wide cross-section in which each factor comes from its own effective date."""
    cond = F.lit(False)
    for name, day in effective.items():
        cond = cond | ((F.col("factor_name") == name) & (F.col("trade_date") == F.lit(day)))
    rows = latest(store.where(cond))
    return rows.groupBy("symbol").pivot("factor_name", list(effective)).agg(F.max("value"))


def to_long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Factor columns to (symbol, trade_date, factor_name, value), NULLs dropped."""
    long = df.select("symbol", "trade_date", *names).unpivot(
        ["symbol", "trade_date"], list(names), "factor_name", "value"
    )
    return long.where(F.col("value").isNotNull())


def batch_values(panel: DataFrame, factors: Mapping[str, Node], start=None, end=None, **kw) -> DataFrame:
    """All factors of a family in one job: shared windows, one unpivot."""
    wide = with_factors(panel, factors, **kw)
    if start is not None:
        wide = wide.where(F.col("trade_date") >= start)
    if end is not None:
        wide = wide.where(F.col("trade_date") <= end)
    return to_long(wide, list(factors))


def expression_hash(text: str) -> str:
    return hashlib.sha256(text.replace(" ", "").lower().encode()).hexdigest()[:16]
