"""Streaming jobs run to completion, their batch twins, and user-code surfaces."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.functions import udf
from quantspark.plans.registry import query
from quantspark.sources.store import latest
from quantspark.streaming import jobs

def tick_stream(t):
    return jobs.tick_stream(t.spark, t.root, "events.parquet")


@query("st01_stream_bars", """SELECT symbol, date_trunc('minute', datetime) AS start, arg_min(price, (datetime, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (datetime, event_id)) AS close, sum(volume) AS volume
 FROM ticks GROUP BY 1, 2""", open=6, high=6, low=6, close=6)
def _(t):
    return jobs.run_upserts(jobs.stream_bars(tick_stream(t)), ["symbol", "start"])


@query("st02_stream_dedupe", "SELECT event_id, symbol, price FROM ticks", price=6)
def _(t):
    ticks = tick_stream(t)
    return jobs.run_available(jobs.stream_dedupe(ticks, ["event_id"]).select("event_id", "symbol", "price"))


@query("st03_stream_cum_volume", """SELECT symbol, trade_date, sum(volume) FILTER (minute_of_day <= 630) AS v_1030, sum(volume) FILTER (minute_of_day <= 840) AS v_1400 FROM ticks GROUP BY 1, 2""")
def _(t):
    return jobs.run_upserts(jobs.stream_cum_volume(tick_stream(t), ["10:30", "14:00"]), ["symbol", "trade_date"])


def day_and_minute():
    return F.to_date("start").alias("trade_date"), (F.hour("start") * 60 + F.minute("start")).alias("minute_of_day")


_REF = "(SELECT symbol, max(volume) AS max_volume, max(close) * 0.98 AS up_limit, min(close) + 0.5 AS down_limit FROM bars_m GROUP BY 1)"


def reference(t):
    return t.bars_m.groupBy("symbol").agg(F.max("volume").alias("max_volume"), (F.max("close") * 0.98).alias("up_limit"), (F.min("close") + 0.5).alias("down_limit"))


@query("st04_alerts", f"""SELECT * FROM (SELECT b.symbol, trade_date, minute_of_day, volume / nullif(max_volume, 0) AS share, volume / nullif(max_volume, 0) > 0.9 AS high_volume, close >= up_limit AS touch_up, close <= down_limit AS touch_down
 FROM bars_m b JOIN {_REF} r USING (symbol)) WHERE high_volume OR touch_up OR touch_down""", share=6)
def _(t):
    path = jobs.work_folder(t.spark)
    reference(t).write.parquet(path)  # one row per symbol, computed once for all micro-batches
    flags = jobs.alert_flags(jobs.stream_bars(tick_stream(t)), t.spark.read.parquet(path))
    found = jobs.run_upserts(flags, ["symbol", "start"]).where(jobs.ALERT)
    return found.select("symbol", *day_and_minute(), "share", "high_volume", "touch_up", "touch_down")


GRID = """g0 AS (SELECT symbol, trade_date, minute_of_day, close, sum(close * volume) OVER w / sum(volume) OVER w AS anchor FROM bars_m WINDOW w AS (PARTITION BY symbol ORDER BY trade_date, minute_of_day ROWS 19 PRECEDING)),
 g1 AS (SELECT *, last_value(CASE WHEN rn = 1 OR abs(close / anchor - 1) > 0.5 THEN anchor END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date, minute_of_day ROWS UNBOUNDED PRECEDING) AS reference FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date, minute_of_day) AS rn FROM g0))"""


def anchored(t):
    """Minute bars with a 20-bar rolling VWAP; a symbol has at most 1,440 bars per day."""
    w = Window.partitionBy("symbol").orderBy("trade_date", "minute_of_day")
    roll = w.rowsBetween(-19, 0)
    anchor = F.sum(F.col("close") * F.col("volume")).over(roll) / F.sum("volume").over(roll)
    start = F.expr("cast(trade_date as timestamp_ntz) + make_dt_interval(0, 0, minute_of_day)")
    return t.bars_m.select("symbol", start.alias("start"), "close", anchor.alias("anchor"))


@query("st05_grid_signals", f"""WITH {GRID} SELECT symbol, trade_date, minute_of_day, reference, CASE WHEN close <= reference * 0.8 THEN 'BUY' WHEN close >= reference * 1.2 THEN 'SELL' ELSE 'HOLD' END AS action FROM g1""", reference=6)
def _(t):
    path = jobs.work_folder(t.spark)
    bars = anchored(t)
    bars.write.parquet(path + "/all")
    bars = t.spark.read.schema(bars.schema).parquet(path + "/all")
    # a replay: slices of ten days arrive in order, their files in any
    first, last = bars.agg(F.min("start"), F.max("start")).first()
    schema, n = "symbol string, start timestamp_ntz, close double, anchor double", 0
    while first is not None and first <= last:
        until = first + timedelta(days=10)
        bars.where((F.col("start") >= first) & (F.col("start") < until)).repartition(4).write.parquet(f"{path}/slices/{n:05d}")
        first, n = until, n + 1
    if n == 0:
        return t.spark.createDataFrame([], "symbol string, trade_date date, minute_of_day int, reference double, action string")
    out = jobs.replay_grid_signals(t.spark, path + "/slices", schema, 0.2, 0.5, "10 days", 4)
    return out.select("symbol", *day_and_minute(), "reference", "action")


@query("st06_stream_vwap", """SELECT symbol, start, sum(price * volume) / sum(volume) AS vwap FROM (SELECT symbol, price, volume, unnest([time_bucket(INTERVAL 10 MINUTE, datetime), time_bucket(INTERVAL 10 MINUTE, datetime) - INTERVAL 10 MINUTE, time_bucket(INTERVAL 10 MINUTE, datetime) - INTERVAL 20 MINUTE]) AS start FROM ticks)
 GROUP BY 1, 2""", vwap=6)
def _(t):
    return jobs.run_upserts(jobs.stream_vwap(tick_stream(t)), ["symbol", "start"])


@query("st07_stream_append", """SELECT symbol, CAST(datetime AS DATE) AS trade_date, 'tick_price' AS factor_name, arg_max(price, (datetime, price)) AS value FROM ticks GROUP BY 1, 2""", value=6)
def _(t):
    folder = jobs.work_folder(t.spark)
    values = tick_stream(t).select(
        "symbol", F.to_date("datetime").alias("trade_date"), F.lit("tick_price").alias("factor_name"), F.col("price").alias("value"),
        F.unix_micros("datetime").alias("version"))
    jobs.stream_append(values, folder + "/store", folder + "/state").start().awaitTermination()
    return latest(t.spark.read.parquet(folder + "/store")).select("symbol", "trade_date", "factor_name", "value")


def momentum(bars, context):
    out = bars[["symbol", "trade_date"]].copy()
    out["value"] = bars["close"] / bars["close"].shift(context["n"]) - 1.0
    return out


@query("u01_python_factor", """SELECT * FROM (SELECT symbol, trade_date, close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS value FROM panel_d WHERE close > 0) WHERE value IS NOT NULL AND trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", value=6)
def _(t):
    return udf.run_python_factor(t.panel_d.where("close > 0"), momentum, date(2024, 1, 5), date(2024, 1, 20), {"n": 3})


@query("u02_model_scorer", "SELECT symbol, trade_date, 0.7 * close - 0.1 * volume - avg(close) OVER (PARTITION BY trade_date) AS score FROM panel_d", score=6)
def _(t):
    return udf.score_sections(t.panel_d.select("symbol", "trade_date", "close", "volume"), lambda s: 0.7 * s["close"] - 0.1 * s["volume"] - s["mean_close"], {"mean_close": F.avg("close")})


@query("u02_row_scorer", "SELECT symbol, trade_date, 0.7 * close - 0.1 * volume AS score FROM panel_d", score=6)
def _(t):
    return udf.score_rows(t.panel_d.select("symbol", "trade_date", "close", "volume"), lambda s: 0.7 * s["close"] - 0.1 * s["volume"])


@query("u03_signal", """SELECT symbol, trade_date, CAST(CASE WHEN close > m THEN 1 WHEN close < m THEN -1 ELSE 0 END AS INTEGER) AS signal FROM (SELECT *, round(avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), 9) AS m FROM panel_d)""")
def _(t):
    def crossing(h):
        gap = h["close"] - h["close"].rolling(5, min_periods=1).mean().round(9)
        return (gap > 0).astype(int) - (gap < 0).astype(int)

    return udf.run_signal(t.panel_d, crossing)
