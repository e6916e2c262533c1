"""Aggregations: bars, coverage, freshness, gaps, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.operators.joins import asof_join, each_day


def week_end(day: Column) -> Column:
    """Sunday that ends the week of ``day``."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def resample(bars: DataFrame, bucket: Column) -> DataFrame:
    """Bars of a coarser period: first open, extreme high/low, last close, summed volume."""
    return bars.groupBy("symbol", bucket.alias("period")).agg(
        F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "trade_date").alias("close"),
        F.sum("volume").alias("volume"), F.sum("amount").alias("amount"),
    )


def day_coverage(minute: DataFrame) -> DataFrame:
    """Distinct symbols and (symbol, minute) points per day, counted in two levels."""
    points = minute.groupBy("trade_date", "symbol", "minute_of_day").agg(F.lit(1).alias("one"))
    per_symbol = points.groupBy("trade_date", "symbol").agg(F.count("one").alias("points"))
    return per_symbol.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("points").alias("points")
    )


def earliest_covered(minute, n_symbols: int, n_times: int, min_symbols=0.8, min_points=0.8) -> DataFrame:
    days = day_coverage(minute)
    ok = (F.col("symbols") >= min_symbols * n_symbols) & (
        F.col("points") >= min_points * n_symbols * n_times
    )
    return days.where(ok).agg(F.min("trade_date").alias("trade_date"))


def day_counts(minute) -> DataFrame:
    """Rows, symbols, rows with volume and volume of every day; symbols meet map-side first."""
    per_symbol = minute.groupBy("trade_date", "symbol").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("volume") > 0).alias("pos"),
        F.sum("volume").alias("vol"),
    )
    return per_symbol.groupBy("trade_date").agg(
        F.sum("n").alias("row_count"), F.count(F.lit(1)).alias("symbols"),
        F.sum("pos").alias("positive_rows"), F.sum("vol").alias("volume"),
    )


def _below(min_rows, min_symbols, min_positive: float):
    return (F.col("row_count") < min_rows) | (F.col("symbols") < min_symbols) | (
        F.col("positive_rows") < min_positive * F.col("row_count")
    )


def suspicious_days(minute, min_rows: int, min_symbols: int, min_positive: float) -> DataFrame:
    """Days whose row, symbol or positive-volume counts fall below the thresholds."""
    return day_counts(minute).where(_below(min_rows, min_symbols, min_positive))


def untypical_days(minute, share: float, min_positive: float) -> DataFrame:
    """Days below ``share`` of the table's own median day, by rows or by symbols, or short of positive volume."""
    days = day_counts(minute)
    typical = days.agg(F.percentile("row_count", 0.5).alias("rows_"), F.percentile("symbols", 0.5).alias("symbols_"))
    # typical: a single row
    bad = days.join(F.broadcast(typical)).where(_below(share * F.col("rows_"), share * F.col("symbols_"), min_positive))
    return bad.drop("rows_", "symbols_")


def freshness(df: DataFrame, day: str, today, stale_after: int) -> DataFrame:
    """good / stale / missing by days since the newest row."""
    last = F.max(day)
    age = F.datediff(F.lit(today), last)
    status = F.when(last.isNull(), "missing").when(age > stale_after, "stale").otherwise("good")
    return df.agg(last.alias("latest_date"), age.alias("age_days"), status.alias("status"))


def dependency_gaps(needs: DataFrame, have: DataFrame) -> DataFrame:
    """needs(dependency, start, end) against have(dependency, min_date, max_date)."""
    j = needs.join(have, "dependency", "left")
    missing = F.col("max_date").isNull()
    late = F.col("max_date") < F.col("end_date")
    early = F.col("min_date") > F.col("start_date")
    return j.select(
        "dependency",
        F.when(missing | early, F.col("start_date")).when(late, F.date_add("max_date", 1)).alias("gap_start"),
        F.when(missing | late, F.col("end_date")).when(early, F.date_sub("min_date", 1)).alias("gap_end"),
        F.when(missing, "error").when(late | early, "warning").otherwise("ok").alias("severity"),
    )


def incremental_start(df: DataFrame, day: str, end, lookback: int) -> DataFrame:
    last = F.max(day)
    start = F.coalesce(F.date_add(last, 1), F.date_sub(F.lit(end), lookback))
    return df.agg(start.alias("start_date")).select("start_date", F.lit(end).alias("end_date")).withColumn(
        "needed", F.col("start_date") <= F.col("end_date")
    )


def missing_points(have: DataFrame, days: DataFrame, symbols: DataFrame, minutes: Sequence[int]) -> DataFrame:
    """(symbol, year, month) ranges of the calendar points that have no row.

    Points present are counted first, so only the expected grid (symbols x days x the few
    listed times) is compared, never raw rows.
    """
    times = F.explode(F.array(*map(F.lit, minutes))).alias("minute_of_day")
    grid = each_day(symbols, days).select("symbol", "trade_date", times)
    seen = have.where(F.col("minute_of_day").isin(list(minutes))).groupBy(
        "symbol", "trade_date", "minute_of_day"
    ).agg(F.lit(1).alias("s_"))
    gaps = grid.join(seen, ["symbol", "trade_date", "minute_of_day"], "left_anti")
    return gaps.groupBy("symbol", F.year("trade_date").alias("year"), F.month("trade_date").alias("month")).agg(
        F.min("trade_date").alias("from_date"), F.max("trade_date").alias("to_date"),
        F.count(F.lit(1)).alias("points"),
    )


def dividend_yield(dividends: DataFrame, bars: DataFrame) -> DataFrame:
    """Trailing-365-day dividend sum per ex-date and its yield on the price known then."""
    days = F.datediff("ex_date", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("symbol").orderBy("d_").rangeBetween(-365, 0)
    summed = dividends.withColumn("d_", days).withColumn("trailing_sum", F.sum("dividend").over(w)).drop("d_")
    prices = bars.select("symbol", F.col("trade_date").alias("price_date"), "close")
    known = asof_join(summed, prices, "ex_date", "price_date", ["close"])
    ratio = F.try_divide(F.col("trailing_sum"), F.nullif("close", F.lit(0.0)))
    return known.withColumn("dividend_yield", ratio)


def top_words(df: DataFrame, words: Column, group: str, n=10) -> DataFrame:
    """Per group the n most frequent words as one ordered, comma-joined string.

    Counting happens before ranking, and Spark keeps n words per group in every task before it
    shuffles them, so no task holds a group's vocabulary.
    """
    counts = df.select(group, F.explode(words).alias("w")).groupBy(group, "w").agg(F.count(F.lit(1)).alias("c"))
    rn = Window.partitionBy(group).orderBy(F.desc("c"), "w")
    top = counts.withColumn("rn", F.row_number().over(rn)).where(F.col("rn") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "w")))
    return top.groupBy(group).agg(F.array_join(F.transform(ordered, lambda s: s["w"]), ",").alias("keywords"))


def sentiment_overview(posts: DataFrame) -> DataFrame:
    """Totals per source and overall in one pass."""
    per_lang = posts.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.max("published_at").alias("latest"), F.sum("reply_count").alias("r")
    )
    out = per_lang.rollup("source").agg(
        F.sum("n").alias("posts"), F.countDistinct("lang").alias("langs"),
        F.sum("r").alias("replies"), F.max("latest").alias("latest_date"),
    )
    return out.select(F.coalesce("source", F.lit("(all)")).alias("source"), "posts", "langs", "replies", "latest_date")


def trade_analysis(fills: DataFrame) -> DataFrame:
    """Counts and notional by day, side, status and overall from one scan."""
    base = fills.groupBy("trade_date", "side", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("order_value").alias("v")
    )
    sets = [["trade_date"], ["side"], ["status"], []]
    out = base.groupingSets([[F.col(c) for c in s] for s in sets], "trade_date", "side", "status").agg(
        F.sum("n").alias("orders"), F.sum("v").alias("notional"),
        F.sum(F.when(F.col("status") == "filled", F.col("n")).otherwise(0)).alias("filled_orders"),
        F.grouping_id().alias("level"),
    )
    return out


def trade_top_symbols(fills: DataFrame, n=10) -> DataFrame:
    totals = fills.groupBy("symbol").agg(F.count(F.lit(1)).alias("orders"), F.sum("order_value").alias("notional"))
    return totals.orderBy(F.desc("notional"), "symbol").limit(n)


def pending_effect(orders: DataFrame) -> DataFrame:
    """Cash reserved and net position change of pending orders per symbol."""
    buy = F.col("side") == "BUY"
    return orders.where("status = 'pending'").groupBy("symbol").agg(
        F.sum(F.when(buy, F.col("quantity") * F.col("price")).otherwise(0.0)).alias("reserved_cash"),
        F.sum(F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))).alias("net_quantity"),
    )


def volume_ratio(bars: DataFrame, n=5) -> DataFrame:
    """Last bar's volume over the mean of the n bars before it."""
    w = Window.partitionBy("symbol").orderBy("trade_date")
    before = F.avg("volume").over(w.rowsBetween(-n, -1))
    rows = bars.select("symbol", "trade_date", F.try_divide("volume", F.nullif(before, F.lit(0.0))).alias("ratio"))
    return rows.groupBy("symbol").agg(
        F.max("trade_date").alias("trade_date"), F.max_by("ratio", "trade_date").alias("volume_ratio")
    )


def facets(runs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Row and distinct-factor counts per value of each field."""
    long = runs.select("factor_name", *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        ["factor_name"], list(fields), "field", "facet"
    )
    inner = long.groupBy("field", "facet", "factor_name").agg(F.count(F.lit(1)).alias("n"))
    return inner.groupBy("field", "facet").agg(F.sum("n").alias("runs"), F.count(F.lit(1)).alias("factors"))


def snapshot_matrix(store: DataFrame, names: Sequence[str], dates=None) -> DataFrame:
    """Wide feature snapshot with the share of features present per row."""
    rows = store.where(F.col("factor_name").isin(list(names)))
    if dates:
        rows = rows.where(F.col("trade_date").isin(list(dates)))
    wide = rows.groupBy("symbol", "trade_date").pivot("factor_name", list(names)).agg(F.max_by("value", "version"))
    present = sum((F.when(F.col(n).isNotNull(), 1.0).otherwise(0.0) for n in names), F.lit(0.0))
    return wide.withColumn("coverage", present / float(len(names)))


def inventory(df: DataFrame, name: str, day: str) -> DataFrame:
    """Exact rows and date range per month partition."""
    return df.groupBy(F.year(day).alias("year"), F.month(day).alias("month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(day).alias("min_date"), F.max(day).alias("max_date")
    ).select(F.lit(name).alias("dataset"), "*")


def partition_inventory(spark, path: str) -> DataFrame:
    """Files and partitions of a stored dataset from the file listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option(
        "recursiveFileLookup", "true").load(path).select("path", "length")
    part = F.regexp_extract("path", "(year=[^/]+/month=[^/]+)", 1)
    return files.groupBy(part.alias("partition")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")
    )
