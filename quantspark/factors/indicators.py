"""Indicator library: one value per symbol and date from its trailing bars and statements."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.bars import AMOUNT, CLOSE, HIGH, LOW, OPEN, RET
from quantspark.functions.expr import (
    Node, coalesce, delay, delta, first_value, greatest, mean, slope, stdev_pop, total, where,
)
from quantspark.operators.joins import asof_join
from quantspark.operators.rowwise import sdiv

_positive_close = where(CLOSE > 0.0, CLOSE, None)


def _return(n: int) -> Node:
    """Percent change over n bars, or since the oldest bar when there are fewer."""
    return (CLOSE / coalesce(delay(CLOSE, n), first_value(CLOSE)) - 1.0) * 100.0


def _rsi() -> Node:
    move = delta(CLOSE, 1)
    gain = total(greatest(move, 0.0), 14) / 14.0
    loss = total(greatest(-move, 0.0), 14) / 14.0
    known = where(total(move, 14) > -1e300, 100.0 - 100.0 / (1.0 + gain / loss), None)
    return where(loss.eq(0.0) & (total(move, 14) > -1e300), 100.0, known)


_base = coalesce(delay(CLOSE, 1), OPEN)

BAR_INDICATORS: dict[str, Node] = {
    "price_to_ma250w": CLOSE / mean(_positive_close, 250, 20),
    "ma250_weekly": mean(_positive_close, 250, 20),
    "return_5d": _return(5),
    "return_20d": _return(20),
    "return_60d": _return(60),
    "ma5_slope": slope(CLOSE, 5, 3) / mean(CLOSE, 5, 3) * 100.0,
    "volatility_20d": stdev_pop(RET * 100.0, 19, 4) * math.sqrt(252.0),
    "avg_amplitude": mean(where(_base > 0.0, (HIGH - LOW) / _base * 100.0, None), 20, 1),
    "avg_amount_20d": mean(where(AMOUNT > 0.0, AMOUNT, None), 20, 1),
    "ma5": mean(CLOSE, 5),
    "ma10": mean(CLOSE, 10),
    "ma20": mean(CLOSE, 20),
    "rsi_14": _rsi(),
}


def valuation(basic: DataFrame, statements: DataFrame, unit: float = 1.0) -> DataFrame:
    """PE, PB and PS: the stored ratio, else market value over the statement figure."""
    j = basic.join(statements, "symbol", "left")
    mv = F.col("total_mv") * unit
    return j.select(
        "symbol", "trade_date",
        F.coalesce("pe_ttm", sdiv(mv, F.col("net_profit"))).alias("pe_ttm"),
        F.coalesce("pb", sdiv(mv, F.col("total_equity"))).alias("pb"),
        sdiv(mv, F.col("revenue")).alias("ps_ttm"),
    )


def quality(statements: DataFrame) -> DataFrame:
    """ROE, debt ratio and gross margin in percent: stored, else computed."""
    profit, assets = F.col("net_profit"), F.col("total_assets")
    return statements.select(
        "symbol", "report_date",
        F.coalesce(F.col("roe") * 100.0, sdiv(profit, F.col("total_equity")) * 100.0).alias("roe"),
        (sdiv(F.col("total_liability"), assets) * 100.0).alias("debt_ratio"),
        F.coalesce("gross_margin", sdiv(profit, F.col("revenue")) * 100.0).alias("gross_margin"),
    )


#: position in the industry chain as a number
CHAIN_POSITION = {"upstream": 1.0, "midstream": 2.0, "downstream": 3.0}


def chain_position(text: Column) -> Column:
    out = F.lit(None).cast("double")
    for word, value in CHAIN_POSITION.items():
        out = F.when(F.lower(text) == word, value).otherwise(out)
    return out


#: hard gates of the deep-value screen
PRICE_TO_MA_MAX, PE_MIN, PE_MAX, YIELD_MIN = 0.9, 0.0, 40.0, 3.5


def deep_value(snapshot: DataFrame, limit: int = 10, price_max=PRICE_TO_MA_MAX, pe_max=PE_MAX, yield_min=YIELD_MIN) -> DataFrame:
    """Cheap against the long average, modest PE, good yield; up to 50 points for each side."""
    ok = (F.col("ratio") < price_max) & (F.col("pe") > PE_MIN) & (F.col("pe") < pe_max) & (
        F.col("dividend_yield") > yield_min
    )
    discount = F.least((1.0 - F.col("ratio")) / 0.5, F.lit(1.0)) * 50.0
    pay = F.least(F.col("dividend_yield") / 15.0, F.lit(1.0)) * 50.0
    return snapshot.where(ok).withColumn("score", F.round(discount + pay, 4)).orderBy(
        F.desc("score"), "symbol"
    ).limit(limit)


def annual_rebalance_dates(days: DataFrame, month: int = 5) -> DataFrame:
    """First trading day of the month in every year."""
    return days.where(F.month("trade_date") == month).groupBy(F.year("trade_date").alias("year")).agg(
        F.min("trade_date").alias("trade_date")
    )


def whole_market_baskets(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Every name in every period (entry_date, exit_date) that begins on its first bar or later.

    A name is opened to its own years, which meet the periods by an equi-join.
    """
    years = spans.withColumn("year", F.year("entry_date"))
    last = years.agg(F.max("year").alias("last"))  # one row
    listed = bars.groupBy("symbol").agg(F.min("trade_date").alias("first")).join(F.broadcast(last))
    opened = listed.where("last >= year(first)").select("symbol", "first", F.explode(F.sequence(F.year("first"), "last")).alias("year"))
    return opened.join(F.broadcast(years), "year").where("first <= entry_date").select("symbol", "entry_date", "exit_date")  # a few periods a year


def basket_returns(baskets: DataFrame, bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """Equal-weight total return per holding period and its compounded value.

    ``baskets`` has symbol, entry_date, exit_date; holding periods may overlap. The dividends of a
    period are the difference of two running sums, found as of its two dates.
    """
    prices = bars.select("symbol", F.col("trade_date").alias("price_date"), "close")
    upto = Window.partitionBy("symbol").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0)
    daily = dividends.groupBy("symbol", "ex_date").agg(F.sum("dividend").alias("dividend"))
    running = daily.select("symbol", "ex_date", F.sum("dividend").over(upto).alias("sum_"))
    held = baskets
    for side in ("entry", "exit"):
        held = asof_join(held, prices, f"{side}_date", "price_date", ["close"]).withColumnRenamed("close", f"{side}_price").drop("price_date")
        held = asof_join(held, running, f"{side}_date", "ex_date", ["sum_"]).withColumnRenamed("sum_", f"{side}_sum").drop("ex_date")
    held = held.where("entry_price > 0 and exit_price is not null")
    paid = F.coalesce("exit_sum", F.lit(0.0)) - F.coalesce("entry_sum", F.lit(0.0))
    gain = (F.col("exit_price") + paid) / F.col("entry_price") - 1.0
    periods = held.groupBy("entry_date", "exit_date").agg(
        F.count(F.lit(1)).alias("names"), F.avg(gain).alias("ret")
    )
    run = Window.partitionBy(F.lit(0)).orderBy("entry_date").rowsBetween(Window.unboundedPreceding, 0)
    return periods.withColumn("nav", F.product(1.0 + F.col("ret")).over(run))  # one row per period
