"""Intraday factors from minute bars.

Raw ticks are first combined into minute bars (map-side), so every window or array below
holds at most the minutes of one symbol-day, or of five of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.functions.expr import field, mean, mean_of, rank
from quantspark.operators.panel import with_factors
from quantspark.operators.rowwise import sdiv
from quantspark.sources.scan import minute_of

DAY = ["symbol", "trade_date"]


def minute_vwap(bars: DataFrame) -> DataFrame:
    volume = F.sum("volume")
    value = F.when(volume > 0, F.sum(F.col("close") * F.col("volume")) / volume)
    return bars.groupBy(*DAY).agg(value.alias("vwap"))


def shape(bars: DataFrame, min_bars: int = 20) -> DataFrame:
    """Slope and convexity of the log price path of each symbol-day on x in [-1, 1]."""
    path = Window.partitionBy(*DAY).orderBy("minute_of_day")
    day = Window.partitionBy(*DAY)
    n = F.count(F.lit(1)).over(day)
    rows = bars.where("close is not null").withColumns(
        {
            "n": n,
            "x": -1.0 + 2.0 * (F.row_number().over(path) - 1) / F.nullif(n - 1, F.lit(0)),
            "first": F.first("close").over(path),
        }
    ).where((F.col("n") >= min_bars) & (F.col("first") > 0) & (F.col("close") > 0))
    rows = rows.withColumns({"y": F.ln(F.col("close") / F.col("first")), "xx": F.col("x") * F.col("x")})
    rows = rows.withColumn("bow", F.col("xx") - F.avg("xx").over(day))
    return rows.groupBy(*DAY).agg(
        sdiv(F.sum(F.col("x") * F.col("y")), F.sum("xx")).alias("slope"),
        sdiv(F.sum(F.col("bow") * F.col("y")), F.sum(F.col("bow") * F.col("bow"))).alias("convexity"),
    )


def shape_composite(bars: DataFrame) -> DataFrame:
    score = mean_of(rank(mean(field("slope"), 20, 10)), rank(mean(field("convexity"), 20, 10)))
    return with_factors(shape(bars), {"value": score}).select(*DAY, "value")


def array_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a sorted, non-empty array."""
    at = (F.size(values) - 1) * q
    low = F.floor(at).cast("int")
    lo, hi = F.get(values, low), F.get(values, F.ceil(at).cast("int"))
    return lo + (hi - lo) * (at - low)


def active_thresholds(bars: DataFrame, days: int = 5, q: float = 0.9, need: int = 20, whole=False) -> DataFrame:
    """Volume above which a minute counts as active: pooled over the symbol's last days.

    ``whole`` requires all ``days`` previous days to exist.
    """
    per_day = bars.groupBy(*DAY).agg(F.collect_list("volume").alias("vs"))
    before = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-days, -1)
    pooled = per_day.select(
        *DAY,
        F.array_sort(F.flatten(F.collect_list("vs").over(before))).alias("pool"),
        F.count(F.lit(1)).over(before).alias("n_days"),
    )
    if whole:
        pooled = pooled.where(F.col("n_days") == days)
    return pooled.where(F.size("pool") >= need).select(*DAY, array_quantile(F.col("pool"), q).alias("threshold"))


def trend_fund(bars: DataFrame) -> DataFrame:
    """VWAP ratio and signed support of the active minutes of each day."""
    j = bars.join(active_thresholds(bars), DAY)
    hot = F.col("volume") > F.col("threshold")
    v, cv = F.col("volume"), F.col("close") * F.col("volume")
    day_vwap = F.when(F.sum("volume") > 0, F.sum(cv) / F.sum("volume"))
    hot_v = F.sum(F.when(hot, v))
    hot_vwap = F.when(hot_v > 0, F.sum(F.when(hot, cv)) / hot_v)
    support = F.sum(F.when(hot, F.signum(F.col("close") - F.col("open")) * v))
    return j.groupBy(*DAY).agg(
        F.count_if(hot).alias("n_hot"),
        F.when(day_vwap > 0, (hot_vwap - day_vwap) / day_vwap).alias("vwap_ratio"),
        F.when(hot_v > 0, support / hot_v).alias("support"),
    ).where("n_hot > 0").drop("n_hot")


def trend_signals(bars: DataFrame, min_bars: int = 10, min_hot: int = 3) -> DataFrame:
    """Daily B (active money below VWAP) and C (net volume below the mean price) signals."""
    thresholds = active_thresholds(bars, need=1, whole=True).where("threshold > 0")
    day = Window.partitionBy(*DAY)
    j = bars.join(thresholds, DAY).withColumn("mean_close", F.avg("close").over(day))
    hot = F.col("volume") > F.col("threshold")
    low, high = F.col("close") < F.col("mean_close"), F.col("close") > F.col("mean_close")

    def vol(cond):
        return F.sum(F.when(cond, F.col("volume")).otherwise(0.0))

    hot_vwap = sdiv(F.sum(F.when(hot, F.col("amount"))), vol(hot))
    all_vwap = sdiv(F.sum("amount"), F.sum("volume"))
    n_hot = F.count_if(hot)
    out = j.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("n_bars"),
        n_hot.alias("n_hot"),
        F.first("threshold").alias("threshold"),
        F.when((n_hot >= min_hot) & (all_vwap > 0), hot_vwap / all_vwap - 1.0).alias("b_value"),
        F.when(n_hot >= min_hot, vol(hot & low) - vol(hot & high)).alias("c_value"),
    ).where(F.col("n_bars") >= min_bars)
    return out.withColumns(
        {
            "b_hit": F.coalesce(F.col("b_value") < 0, F.lit(False)),
            "c_hit": F.coalesce(F.col("c_value") > 0, F.lit(False)),
        }
    )


def calendar_index(days: DataFrame) -> DataFrame:
    """Dense day number; the un-partitioned window sees one row per trading day."""
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    return days.select("trade_date").distinct().withColumn("day_no", F.row_number().over(w))


def fuse_signals(signals: DataFrame, calendar: DataFrame, days: int = 3, need: int = 2) -> DataFrame:
    """Composite when B and C each triggered on at least ``need`` of the last ``days`` days."""
    rows = signals.join(F.broadcast(calendar_index(calendar)), "trade_date")  # one row per day
    w = Window.partitionBy("symbol").orderBy("day_no").rangeBetween(-(days - 1), 0)
    both = (F.sum(F.col("b_hit").cast("int")).over(w) >= need) & (
        F.sum(F.col("c_hit").cast("int")).over(w) >= need
    )
    return rows.withColumn("composite", both & (F.col("day_no") >= days))


def basket(fused: DataFrame, calendar: DataFrame, look_back: int = 5, size: int = 5) -> DataFrame:
    """Per day the symbols with the best composite score over the previous days."""
    days = calendar_index(calendar)
    score = F.coalesce(-F.col("b_value") * 100.0, F.lit(0.0)) + F.coalesce(
        F.when(F.col("threshold") > 0, F.col("c_value") / F.col("threshold")), F.lit(0.0)
    )
    hits = fused.where("composite").select("symbol", "day_no", score.alias("score"))
    ahead = F.sequence(F.col("day_no") + 1, F.col("day_no") + look_back)
    best = (
        hits.select("symbol", "score", F.explode(ahead).alias("day_no"))
        .groupBy("day_no", "symbol").agg(F.max("score").alias("score"))
        .join(F.broadcast(days), "day_no")  # one row per day
    )
    w = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).select(
        "trade_date", "symbol", "score", "rank"
    )


def cumulative_volume(bars: DataFrame, times: Sequence[str]) -> DataFrame:
    """Volume of the day up to each listed HH:MM, for every symbol-day with a bar then."""
    run = Window.partitionBy(*DAY).orderBy("minute_of_day").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.select(*DAY, "minute_of_day", F.sum("volume").over(run).alias("cum_volume"))
    return rows.where(F.col("minute_of_day").isin([minute_of(t) for t in times]))


def timer_rows(bars: DataFrame, times: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Valid bars at the listed times that are not stored yet."""
    rows = bars.where(F.col("minute_of_day").isin([minute_of(t) for t in times]))
    rows = rows.where("open > 0 and high > 0 and low > 0 and close > 0")
    keys = [*DAY, "minute_of_day"]
    return rows if existing is None else rows.join(existing.select(*keys), keys, "left_anti")


def anchor_price(bars: DataFrame, minutes: int, tick_vwap: DataFrame, max_gap: float = 0.2) -> DataFrame:
    """Rolling anchor: VWAP of the last bars, else last close, else a plausible tick VWAP."""
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"), F.desc("minute_of_day"))
    last = bars.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= minutes)
    good = (F.col("close") > 0) & (F.col("volume") > 0)
    agg = last.groupBy("symbol").agg(
        sdiv(F.sum(F.when(good, F.col("close") * F.col("volume"))), F.sum(F.when(good, F.col("volume")))).alias("bar_vwap"),
        F.max_by(F.when(F.col("close") > 0, F.col("close")), F.struct("trade_date", "minute_of_day")).alias("last_close"),
    )
    j = agg.join(tick_vwap, "symbol", "left")
    near = F.abs(F.col("tick_vwap") / F.col("last_close") - 1.0) <= max_gap
    plausible = F.when(near | F.col("last_close").isNull(), F.col("tick_vwap"))
    return j.select("symbol", F.coalesce("bar_vwap", "last_close", plausible).alias("anchor"))


def quotes(ticks: DataFrame, pre_close: DataFrame) -> DataFrame:
    """Newest quote per symbol with its change against the previous close."""
    last = ticks.groupBy("symbol").agg(
        F.max("datetime").alias("quoted_at"),
        F.max_by("price", F.struct("datetime", "event_id")).alias("price"),
    )
    change = sdiv(F.col("price") - F.col("pre_close"), F.col("pre_close"))
    return last.join(pre_close, "symbol", "left").withColumn("change", change)


def adjust_price_space(bars: DataFrame, daily: DataFrame, close_minute: int, columns: Sequence[str]) -> DataFrame:
    """Scale minute prices by previous daily close / previous minute close (default 1)."""
    last = bars.where(F.col("minute_of_day") <= close_minute).groupBy(*DAY).agg(
        F.max_by("close", "minute_of_day").alias("minute_close")
    )
    w = Window.partitionBy("symbol").orderBy("trade_date")
    ratio = daily.select(*DAY, F.col("close").alias("daily_close")).join(last, DAY, "left").select(
        *DAY, sdiv(F.lag("daily_close").over(w), F.lag("minute_close").over(w)).alias("ratio")
    )
    factor = F.when(F.col("ratio") > 0, F.col("ratio")).otherwise(1.0)
    return bars.join(ratio, DAY, "left").withColumns(
        {c: F.when(F.col(c) > 0, F.col(c) * factor).otherwise(F.col(c)) for c in columns}
    ).drop("ratio")
