"""Scans over bar, minute, indicator and dataset tables.

Filters stay plain comparisons on stored columns so that they reach the Parquet reader;
``month_filter`` adds the partition predicate that the date range implies.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.operators.joins import newest


def month_filter(start: date, end: date) -> Column:
    """Partition predicate on year/month columns for a date range."""
    first, last = start.year * 12 + start.month, end.year * 12 + end.month
    return (F.col("year").cast("int") * 12 + F.col("month").cast("int")).between(first, last)


def _selected(df: DataFrame, symbols: Sequence | None) -> DataFrame:
    """An empty or missing symbol list means all symbols."""
    return df.where(F.col("symbol").isin(list(symbols))) if symbols else df


def _partitioned(df: DataFrame, start, end) -> DataFrame:
    return df.where(month_filter(start, end)) if {"year", "month"} <= set(df.columns) else df


def load_daily(df, symbols, start, end, columns=None, order: Column | None = None) -> DataFrame:
    """Bars of a date range, one row per (symbol, trade_date): the first by ``order``."""
    df = _partitioned(_selected(df, symbols), start, end)
    df = df.where(F.col("trade_date").between(start, end))
    cols = list(columns or [c for c in df.columns if c not in ("symbol", "trade_date")])
    if order is None:
        return df.select("symbol", "trade_date", *cols)
    picked = df.groupBy("symbol", "trade_date").agg(F.min_by(F.struct(*cols), order).alias("r"))
    return picked.select("symbol", "trade_date", "r.*")


def minute_of(hhmm: str) -> int:
    hour, minute = hhmm.split(":")
    return int(hour) * 60 + int(minute)


def load_minute(full, symbols, start, end, timer_times=None, sparse=None) -> DataFrame:
    """Minute bars in [start, end). For timer times, the sparse table's rows come first, then the
    full table's rows whose (symbol, day, minute) it lacks."""

    def read(df):
        df = _selected(df, symbols)
        df = df.where((F.col("trade_date") >= start) & (F.col("trade_date") < end))
        if timer_times:
            df = df.where(F.col("minute_of_day").isin([minute_of(t) for t in timer_times]))
        return df

    if sparse is not None and timer_times:
        keys = ["symbol", "trade_date", "minute_of_day"]
        rows = read(sparse)
        return rows.unionByName(read(full).join(rows.select(*keys), keys, "left_anti"))
    return read(full)


def minute_volume_sum(minute, symbols, start, end) -> DataFrame:
    rows = _selected(minute, symbols).where(
        (F.col("trade_date") >= start) & (F.col("trade_date") < end)
    )
    return rows.groupBy("symbol").agg(F.sum("volume").alias("volume"))


def cumulative_volume_at(minute, cum_table, day: date, at: str) -> DataFrame:
    """Volume of the day up to and including ``at``: the stored value, else summed bars."""
    limit = minute_of(at)
    todays = minute.where((F.col("trade_date") == day) & (F.col("minute_of_day") <= limit))
    summed = todays.groupBy("symbol").agg(F.sum("volume").alias("summed"))
    stored = cum_table.where((F.col("trade_date") == day) & (F.col("minute_of_day") == limit)).select(
        "symbol", F.col("cum_volume").alias("stored")
    )
    both = summed.join(stored, "symbol", "full")
    return both.select("symbol", F.coalesce("stored", "summed").alias("cum_volume"))


def latest_values(df, field: str, start, end, symbols=None) -> DataFrame:
    df = _selected(df, symbols).where(F.col("trade_date").between(start, end) & F.col(field).isNotNull())
    return df.groupBy("symbol").agg(F.max_by(field, "trade_date").alias(field))


def has_data(df, symbols, start, end) -> bool:
    rows = _selected(df, symbols).where(F.col("trade_date").between(start, end))
    return not rows.limit(1).isEmpty()


def trading_dates(df, start, end, symbols=None) -> DataFrame:
    rows = _selected(df, symbols).where(F.col("trade_date").between(start, end))
    return rows.select("trade_date").distinct()


def benchmark_returns(df, symbol, start, end) -> DataFrame:
    """Close-to-close return of one series; the first return is 0."""
    rows = df.where((F.col("symbol") == symbol) & F.col("trade_date").between(start, end))
    w = Window.partitionBy("symbol").orderBy("trade_date")
    prev = F.lag("close").over(w)
    ret = F.try_divide(F.col("close"), F.nullif(prev, F.lit(0.0))) - 1.0
    return rows.select("trade_date", F.coalesce(ret, F.lit(0.0)).alias("ret"))


def top_by_avg_amount(df, start, end, limit: int) -> DataFrame:
    rows = df.where(F.col("trade_date").between(start, end) & (F.col("amount") > 0) & (F.col("close") > 0))
    means = rows.groupBy("symbol").agg(F.avg("amount").alias("avg_amount"))
    return means.orderBy(F.desc("avg_amount"), "symbol").limit(limit)


def coverage(df, symbols=None, timer_times=None) -> DataFrame:
    df = _selected(df, symbols)
    if timer_times:
        df = df.where(F.col("minute_of_day").isin([minute_of(t) for t in timer_times]))
    return df.groupBy("symbol").agg(
        F.min("trade_date").alias("min_date"),
        F.max("trade_date").alias("max_date"),
        F.count(F.lit(1)).alias("row_count"),
    )


def indicator_cross_section(store, names, day, symbols=None) -> DataFrame:
    rows = _selected(store, symbols)
    return rows.where(F.col("factor_name").isin(list(names)) & (F.col("trade_date") == day))


def indicator_series(store, names, start, end, symbols=None) -> DataFrame:
    rows = _selected(store, symbols).where(F.col("factor_name").isin(list(names)))
    return rows.where((F.col("trade_date") >= start) & (F.col("trade_date") < F.date_add(F.lit(end), 1)))


def latest_date(store, names=None, symbols=None) -> DataFrame:
    rows = _selected(store, symbols)
    if names:
        rows = rows.where(F.col("factor_name").isin(list(names)))
    return rows.agg(F.max("trade_date").alias("trade_date"))


def common_latest_date(df, symbols: Sequence) -> DataFrame:
    """Earliest of the symbols' latest dates; NULL when one of them has no row."""
    last = df.where(F.col("symbol").isin(list(symbols))).groupBy("symbol").agg(
        F.max("trade_date").alias("last")
    )
    return last.agg(
        F.when(F.count(F.lit(1)) == len(set(symbols)), F.min("last")).alias("trade_date")
    )


def kline_page(df, symbol, start, end, page: int, size: int) -> DataFrame:
    """Newest-first page with the total and prices as decimals."""
    rows = df.where((F.col("symbol") == symbol) & F.col("trade_date").between(start, end))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    money = {c: F.col(c).cast("decimal(18,4)").alias(c) for c in ("open", "high", "low", "close")}
    paged = rows.orderBy(F.desc("trade_date")).offset((page - 1) * size).limit(size)
    return paged.select(
        "symbol", "trade_date", *money.values(), F.col("amount").cast("decimal(18,2)").alias("amount"),
        total.scalar().alias("total"),
    )


def wide_returns(long: DataFrame, symbols: Sequence) -> DataFrame:
    """(date, symbol, ret_1d) to one ``<symbol>_ret_1d`` column per symbol; wide input passes."""
    if "symbol" not in long.columns:
        return long
    pivoted = long.groupBy("trade_date").pivot("symbol", list(symbols)).agg(F.max("ret_1d"))
    return pivoted.select("trade_date", *[F.col(f"`{s}`").alias(f"{s}_ret_1d") for s in symbols])


REQUIRED_BAR_COLUMNS = ("datetime", "open", "high", "low", "close", "volume")


def sane_bars(df: DataFrame) -> DataFrame:
    """Rows whose prices are present, positive and consistent and whose volume is not negative."""
    ok = F.col("low") > 0
    for c in ("open", "close"):
        ok = ok & F.col(c).between(F.col("low"), F.col("high"))
    return df.where(ok & (F.col("volume") >= 0))


def read_symbol_csvs(spark: SparkSession, folder: str, by_folder: bool = False) -> DataFrame:
    """One CSV per symbol; header case is ignored and the symbol is the file name
    (``by_folder``: the name of a ``symbol=...`` folder)."""
    raw = spark.read.option("header", True).csv(folder)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = [c for c in REQUIRED_BAR_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    name = F.col("symbol") if by_folder else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    nums = [F.expr(f"try_cast({c} AS double)").alias(c) for c in REQUIRED_BAR_COLUMNS[1:]]
    when = F.expr("try_cast(datetime AS timestamp_ntz)").alias("datetime")
    return sane_bars(raw.select(name.alias("symbol"), when, *nums).dropna())


#: exchange suffix rewrites of vendor minute files
SUFFIXES = {".XSHE": ".SZ", ".XSHG": ".SH", ".XBSE": ".BJ"}


def rewrite_suffix(code: Column) -> Column:
    for old, new in SUFFIXES.items():
        code = F.regexp_replace(code, old.replace(".", r"\.") + "$", new)
    return code


def vendor_minutes(df: DataFrame, start, end) -> DataFrame:
    """Vendor minute rows: code rewrite, casts, validity filter, exact duplicates dropped."""
    day = F.to_date("datetime")
    rows = df.select(
        rewrite_suffix(F.col("code")).alias("symbol"), "datetime",
        *[F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume")],
    )
    return sane_bars(rows.where(day.between(start, end))).distinct()


def latest_minutes(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Newest vendor row per (symbol, minute) within a task's range."""
    rows = df.where(F.col("datetime").between(start, end)).withColumn(
        "minute", F.date_format("datetime", "yyyy-MM-dd HH:mm")
    )
    return newest(rows, ["symbol", "minute"], F.struct("datetime", "event_id"))


#: money units and volume lots of the raw feeds
INDEX_AMOUNT_UNIT = 1000.0
INDEX_VOLUME_LOT = 100.0
DAILY_AMOUNT_UNIT = 1000.0


def normal_daily(df: DataFrame) -> DataFrame:
    """Daily feed rows: amount in currency, only complete positive bars."""
    rows = df.withColumn("amount", F.col("amount") * DAILY_AMOUNT_UNIT)
    return rows.dropna(subset=["open", "high", "low", "close"]).where("close > 0 and volume >= 0")


def normal_index(df: DataFrame) -> DataFrame:
    return df.where("close > 0").withColumns(
        {
            "amount": F.col("amount") * INDEX_AMOUNT_UNIT,
            "volume": F.col("volume") * INDEX_VOLUME_LOT,
        }
    )


def normal_limits(df: DataFrame) -> DataFrame:
    return df.where("up_limit > 0 and down_limit > 0 and up_limit >= down_limit")


#: dataset -> (label, category, date column, symbol column)
CATALOG = {
    "panel_d": ("Daily bars", "market", "trade_date", "symbol"),
    "panel_l": ("Daily bars, long history", "market", "trade_date", "symbol"),
    "panel_m": ("Monthly bars", "market", "trade_date", "symbol"),
    "ticks": ("Intraday rows", "market", "trade_date", "symbol"),
    "fin": ("Statements", "fundamental", "report_date", "symbol"),
    "basic": ("Daily fundamentals", "fundamental", "trade_date", "symbol"),
    "idx": ("Index members", "membership", "trade_date", "symbol"),
    "posts": ("Posts", "text", "published_at", "doc_id"),
    "store": ("Factor values", "factor", "trade_date", "symbol"),
}


def dataset_bounds(name: str, df: DataFrame) -> DataFrame:
    label, category, day, symbol = CATALOG[name]
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.min(day).alias("min_date"), F.max(day).alias("max_date")
    ).select(
        F.lit(name).alias("dataset"), F.lit(label).alias("label"), F.lit(category).alias("category"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"), "row_count", "min_date", "max_date",
    )
