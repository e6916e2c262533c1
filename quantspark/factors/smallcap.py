"""Small-cap core factors."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.bars import CLOSE, HIGH, LOW, VOLUME
from quantspark.functions.expr import (
    Node, bars_total, bfill, clip, coalesce, ema, ffill, field, flag, greatest, isnull, mean,
    prior_max, rank, rmax, rmin, total, where, xsum,
)
from quantspark.operators.batch import Outcome, run_factors, run_frames
from quantspark.operators.cross_section import section_position
from quantspark.operators.filters import special_days
from quantspark.operators.panel import with_factors
from quantspark.session import drop_folder, new_folder
from quantspark.sources.store import params_hash

KEYS = ["symbol", "trade_date"]
#: price distance that still counts as touching a limit
TOUCH = 1e-4


def market_cap(basic: DataFrame) -> DataFrame:
    return basic.select(*KEYS, F.coalesce("circ_mv", "total_mv").alias("value"))


def filled(x) -> Node:
    """Forward-, then back-filled, then 0."""
    return coalesce(ffill(x), bfill(x), 0.0)


def _v4gv() -> tuple[Node, Node]:
    c, h, l = filled(CLOSE), filled(HIGH), filled(LOW)

    def width(n):
        span = rmax(h, n) - rmin(l, n)
        return where(span.eq(0.0), 1e-6, span)

    rsv34 = 100.0 * (c - rmin(l, 34)) / width(34)
    rsv55 = 100.0 * (c - rmin(l, 55)) / width(55)
    base = mean(rsv34, 5) - 20.0
    blend = (ema(rsv55, 5) + base) / 2.0
    upper = ema(-100.0 * (rmax(h, 34) - c) / width(34), 4) + 100.0
    value = ((ema(rsv34, 3) + upper) / 2.0 + blend) / 2.0
    return value, (value + mean(value, 2)) / 2.0


V4GV, V4GV_SIGNAL = _v4gv()
_DIF = ema(filled(CLOSE), 12) - ema(filled(CLOSE), 26)
MACD_POSITIVE = flag((_DIF > ema(_DIF, 9)) & (_DIF > 0.0))


def _known(x) -> Node:
    return where((V4GV > -1e300) & (V4GV_SIGNAL > -1e300), x, None)


_buy = flag((V4GV > V4GV_SIGNAL) & (V4GV > 0.0) & (MACD_POSITIVE > 0.0))
_stretch = greatest(V4GV - V4GV_SIGNAL, 0.0) / greatest(abs(V4GV_SIGNAL), 1.0)

BAR_FACTORS: dict[str, Node] = {
    "v4gv": where(bars_total() >= 60.0, V4GV, None),
    "v4gv_signal": where(bars_total() >= 60.0, V4GV_SIGNAL, None),
    "macd_positive": MACD_POSITIVE,
    "indicator_buy_signal": _known(_buy),
    "tsmf_overheat_penalty": _known(_buy + clip(_stretch, 0.0, 3.0)),
    "v4gv_dead_cross": _known(
        flag((V4GV < V4GV_SIGNAL) & (V4GV_SIGNAL > 0.0) & (MACD_POSITIVE <= 0.0))
    ),
}


def high_volume(window: int = 120, threshold: float = 0.9, lots: float = 100.0) -> dict[str, Node]:
    """Cumulative volume now against the largest of the previous daily volumes (in lots)."""
    now = field("cum_volume")
    peak = greatest(prior_max(VOLUME * lots, window - 1, window - 1), now)
    known = where(prior_max(VOLUME, window - 1, window - 1) > -1e300, peak, None)
    ratio = now / where(known > 0.0, known, None)
    return {
        "cum_volume_at_time": where(ratio >= 0.0, now, None),
        "rolling_max_volume": where(ratio >= 0.0, known, None),
        "high_volume_ratio": ratio,
        "avoid_high_volume_ratio": clip(1.0 - ratio, 0.0, 1.0),
        "high_volume_signal": where(ratio >= 0.0, flag(ratio > threshold), None),
    }


def cap_rank(caps: DataFrame, wide: bool = False) -> DataFrame:
    """Position by capitalisation, smallest first, ties by symbol."""
    placed = section_position(caps.where("value is not null"), ["trade_date"], "value", "symbol", "rank_", wide=wide)
    return placed.select(*KEYS, F.col("rank_").cast("double").alias("value"))


def day_grid(symbols: DataFrame, days: DataFrame, hits: DataFrame, hit: float, other: float) -> DataFrame:
    """Every symbol on every calendar day: ``hit`` on its days in ``hits``, which may repeat, else ``other``.

    A word of bits says which of 64 days are hit. Words are shuffled, one row for each symbol and word,
    and opened to their days where they are, so the grid itself is never shuffled or sorted.
    """
    w = Window.orderBy("trade_date")  # calendar rows only
    numbered = days.where("trade_date is not null").select("trade_date", (F.dense_rank().over(w) - 1).alias("at"))
    calendar = numbered.select("trade_date", F.shiftright("at", 6).alias("word"), (F.col("at") % 64).alias("bit"))
    words = calendar.groupBy("word").agg(F.collect_list(F.struct("bit", "trade_date")).alias("days"))
    bits = hits.select(*KEYS).join(F.broadcast(calendar), "trade_date").groupBy("symbol", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    every = symbols.select("symbol").crossJoin(F.broadcast(words.select("word")))
    opened = every.join(bits, ["symbol", "word"], "left").join(F.broadcast(words), "word").select("symbol", "bits", F.inline("days"))
    return opened.select(*KEYS, F.when(F.getbit("bits", "bit") == 1, hit).otherwise(other).alias("value"))


def st_flags(stocks, changes, days) -> DataFrame:
    """Dense 1.0/0.0 grid: every symbol on every calendar day (that is the definition)."""
    return day_grid(stocks, days, special_days(stocks, changes, days), 1.0, 0.0)


def paused_flags(symbols, days, bars, minute: int) -> DataFrame:
    return day_grid(symbols, days, bars.where(F.col("minute_of_day") == minute), 0.0, 1.0)


def limit_flags(prices: DataFrame, limits: DataFrame, price: str = "close") -> DataFrame:
    """1.0 where the price touches its limit; NULL-limit rows are 0."""
    j = prices.join(limits, KEYS, "left")
    up = (F.col("up_limit") > 0) & (F.col(price) >= F.col("up_limit") - TOUCH)
    down = (F.col("down_limit") > 0) & (F.col(price) <= F.col("down_limit") + TOUCH)
    return j.select(
        *KEYS,
        F.when(up, 1.0).otherwise(0.0).alias("is_limit_up"),
        F.when(down, 1.0).otherwise(0.0).alias("is_limit_down"),
    )


def yesterday_limit_up(bars: DataFrame, limits: DataFrame) -> DataFrame:
    """Limit-up flag of the previous trading day of the market, not of the symbol."""
    return market_yesterday(bars, limit_flags(bars, limits), bars.select("trade_date").distinct())


def market_yesterday(bars: DataFrame, flags: DataFrame, days: DataFrame) -> DataFrame:
    """``yesterday_limit_up`` out of ``limit_flags`` and the market's calendar ``days``."""
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")  # calendar rows only
    calendar = days.withColumn("prev", F.lag("trade_date").over(w))
    flags = flags.select("symbol", F.col("trade_date").alias("prev"), F.col("is_limit_up").alias("up"))
    rows = bars.select(*KEYS).join(F.broadcast(calendar), "trade_date")
    return rows.join(flags, ["symbol", "prev"], "left").select(
        *KEYS, F.coalesce("up", F.lit(0.0)).alias("yesterday_limit_up")
    )


def limit_heat() -> Node:
    """Limit-up days among the last 20 bars; NULL below ten bars."""
    up = flag((CLOSE > 0.0) & (field("up_limit") > 0.0) & (CLOSE >= field("up_limit") - TOUCH))
    return total(up, 20, 10)


def drop_hottest(heat: DataFrame, pct: float = 0.2, minimum: int = 5, section_rows=None) -> DataFrame:
    """Drop the hottest share of each date unless too few names would remain."""
    value = field("value")
    keep = flag(isnull(value) | (rank(value) <= 1.0 - pct))
    rows = with_factors(heat, {"keep_": keep, "left_": xsum(keep)}, section_rows=section_rows)
    return rows.where((F.col("keep_") > 0) | (F.col("left_") < minimum)).select(*KEYS, "value")


# --- the core job ------------------------------------------------------------


def stamps(timer: str = "10:30", late: str = "14:30", window: int = 120, threshold: float = 0.9, lots: float = 100.0) -> dict[str, tuple[str, Mapping]]:
    """As-of time and parameters under which the core job stores each factor; daily ones have none."""
    at, volume = {"time": timer}, {"time": late, "window": window, "daily_volume_to_share_multiplier": lots}
    daily = ["market_cap", "market_cap_rank", "is_st", "yesterday_limit_up", *BAR_FACTORS]
    timed = ["is_paused", "is_limit_up", "is_limit_down"]
    return {
        **{n: ("", {}) for n in daily}, **{n: (timer, at) for n in timed}, "cum_volume_at_time": (late, {"time": late}),
        **{n: (late, volume) for n in ("rolling_max_volume", "high_volume_ratio", "avoid_high_volume_ratio")},
        "high_volume_signal": (late, {**volume, "threshold": threshold}),
    }


def stamped(values: DataFrame, of: Mapping[str, tuple[str, Mapping]]) -> DataFrame:
    """Long values with the as-of time and parameter hash of their factor: rows for the store."""
    pairs = [F.struct(F.lit(time).alias("as_of_time"), F.lit(params_hash(params)).alias("params_hash")) for time, params in of.values()]
    lookup = F.create_map(*[x for name, pair in zip(of, pairs) for x in (F.lit(name), pair)])
    mark = F.try_element_at(lookup, F.col("factor_name"))
    return values.select(*KEYS, mark["as_of_time"].alias("as_of_time"), "factor_name", mark["params_hash"].alias("params_hash"), "value")


def core_batch(bars: DataFrame, basic: DataFrame, limits: DataFrame, stocks: DataFrame, changes: DataFrame, minutes: DataFrame, *, minute: int = 630,
               window: int = 120, threshold: float = 0.9, lots: float = 100.0, rows: int | None = None) -> list[Outcome]:
    """The eighteen core factors: bar factors as one planned batch, the status frames part by part.

    ``bars`` carries ``cum_volume`` (the volume up to the late timer); ``minutes`` has ``symbol,
    trade_date, minute_of_day``. Calendars and names come from the bars and the stock list.
    ``rows`` is the number of bars, or more. A part that fails leaves the others their values. ``bars`` has
    many readers; what several parts share beside it is written by the first of them.
    """
    formulas = {**BAR_FACTORS, **high_volume(window, threshold, lots)}
    folder = new_folder(bars.sparkSession)

    shared = {"caps": lambda: market_cap(basic), "days": lambda: bars.select("trade_date").distinct(), "flags": lambda: limit_flags(bars, limits)}

    @cache
    def once(name: str) -> DataFrame:
        df = shared[name]()
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    seen = minutes.select("symbol", "trade_date", "minute_of_day")
    frames = {
        "market_cap": lambda: once("caps").withColumnRenamed("value", "market_cap"),
        "market_cap_rank": lambda: cap_rank(once("caps")).withColumnRenamed("value", "market_cap_rank"),
        "is_st": lambda: st_flags(stocks, changes, once("days")).withColumnRenamed("value", "is_st"),
        "is_paused": lambda: paused_flags(bars.select("symbol").distinct(), once("days"), seen, minute).withColumnRenamed("value", "is_paused"),
        "is_limit_up, is_limit_down": lambda: once("flags"),
        "yesterday_limit_up": lambda: market_yesterday(bars, once("flags"), once("days")),
    }
    try:
        return [run_factors(bars, formulas, section_rows=1, rows=rows), run_frames(bars, frames)]
    finally:
        drop_folder(bars.sparkSession, folder)


def timer_batch(bars: DataFrame, limits: DataFrame, minutes: DataFrame, minute: int = 630) -> Outcome:
    """The three status factors of one timer point, without the daily ones."""
    days = bars.select("trade_date").distinct()
    seen = minutes.select("symbol", "trade_date", "minute_of_day")
    return run_frames(bars, {
        "is_paused": lambda: paused_flags(bars.select("symbol").distinct(), days, seen, minute).withColumnRenamed("value", "is_paused"),
        "is_limit_up, is_limit_down": lambda: limit_flags(bars, limits),
    })
