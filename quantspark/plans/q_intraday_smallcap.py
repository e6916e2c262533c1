"""Intraday and small-cap factor queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.factors import intraday as intra
from quantspark.factors import smallcap as sc
from quantspark.operators.panel import with_factors
from quantspark.plans.q_filters import CHANGES, STOCKS, changes, stocks
from quantspark.plans.oracle import factor_sql
from quantspark.plans.registry import factor, query

DAY = "symbol, trade_date"

THRESHOLD = """th AS (SELECT a.symbol, a.trade_date, quantile_cont(b.volume, 0.9) AS thr, count(*) AS n_obs, any_value(a.nd) AS nd FROM
 (SELECT symbol, trade_date, dn, least(dn - 1, 5) AS nd FROM days) a JOIN days d2 ON d2.symbol = a.symbol AND d2.dn BETWEEN a.dn - 5 AND a.dn - 1
 JOIN bars_m b ON b.symbol = d2.symbol AND b.trade_date = d2.trade_date GROUP BY 1, 2)"""
DAYS = "days AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) AS dn FROM (SELECT DISTINCT symbol, trade_date FROM bars_m))"
TREND = f"""{DAYS}, {THRESHOLD}, tf AS (SELECT b.symbol, b.trade_date, sum(close * volume) / sum(volume) AS dv, sum(close * volume) FILTER (volume > thr) / sum(volume) FILTER (volume > thr) AS tv,
 sum(sign(close - open) * volume) FILTER (volume > thr) / sum(volume) FILTER (volume > thr) AS support FROM bars_m b JOIN th USING (symbol, trade_date) WHERE n_obs >= 20 GROUP BY 1, 2 HAVING count(*) FILTER (volume > thr) > 0)"""
SIGNALS = f"""{DAYS}, {THRESHOLD}, mc AS (SELECT symbol, trade_date, avg(close) AS mc FROM bars_m GROUP BY 1, 2),
 sg AS (SELECT b.symbol, b.trade_date, count(*) AS n_bars, count(*) FILTER (volume > thr) AS n_hot, any_value(thr) AS threshold,
 CASE WHEN count(*) FILTER (volume > thr) >= 3 THEN (sum(amount) FILTER (volume > thr) / sum(volume) FILTER (volume > thr)) / (sum(amount) / sum(volume)) - 1 END AS b_value,
 CASE WHEN count(*) FILTER (volume > thr) >= 3 THEN coalesce(sum(volume) FILTER (volume > thr AND close < mc), 0) - coalesce(sum(volume) FILTER (volume > thr AND close > mc), 0) END AS c_value
 FROM bars_m b JOIN th USING (symbol, trade_date) JOIN mc USING (symbol, trade_date) WHERE nd = 5 AND thr > 0 GROUP BY 1, 2 HAVING count(*) >= 10),
 sf AS (SELECT *, coalesce(b_value < 0, false) AS b_hit, coalesce(c_value > 0, false) AS c_hit FROM sg)"""
FUSED = f"""{SIGNALS}, cal AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS day_no FROM (SELECT DISTINCT trade_date FROM bars_m)),
 fu AS (SELECT sf.*, day_no, day_no >= 3 AND sum(CAST(b_hit AS INT)) OVER w >= 2 AND sum(CAST(c_hit AS INT)) OVER w >= 2 AS composite FROM sf JOIN cal USING (trade_date)
 WINDOW w AS (PARTITION BY symbol ORDER BY day_no RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query("in01_minute_vwap", f"SELECT {DAY}, sum(close * volume) / nullif(sum(volume), 0) AS vwap FROM bars_m GROUP BY 1, 2", vwap=6)
def _(t):
    return intra.minute_vwap(t.bars_m)


_SHAPE = """b0 AS (SELECT *, count(*) OVER (PARTITION BY symbol, trade_date) AS n, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY minute_of_day) AS rn,
 first_value(close) OVER (PARTITION BY symbol, trade_date ORDER BY minute_of_day) AS c0 FROM bars_m),
 b1 AS (SELECT symbol, trade_date, -1 + 2.0 * (rn - 1) / (n - 1) AS x, ln(close / c0) AS y FROM b0 WHERE n >= 20 AND c0 > 0 AND close > 0),
 b2 AS (SELECT *, x * x - avg(x * x) OVER (PARTITION BY symbol, trade_date) AS bow FROM b1),
 sh AS (SELECT symbol, trade_date, sum(x * y) / sum(x * x) AS slope, sum(bow * y) / sum(bow * bow) AS convexity FROM b2 GROUP BY 1, 2)"""


@query("in02_intraday_shape", f"WITH {_SHAPE} SELECT * FROM sh", slope=6, convexity=6)
def _(t):
    return intra.shape(t.bars_m)


@query("in02_shape_composite", f"""WITH {_SHAPE}, m AS (SELECT *, CASE WHEN count(slope) OVER w >= 10 THEN round(avg(slope) OVER w, 10) END AS s, CASE WHEN count(convexity) OVER w >= 10 THEN round(avg(convexity) OVER w, 10) END AS c
 FROM sh WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)),
 r AS (SELECT symbol, trade_date, CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, s) - 1) / 2.0) / count(s) OVER (PARTITION BY trade_date) END AS a,
 CASE WHEN c IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY c NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, c) - 1) / 2.0) / count(c) OVER (PARTITION BY trade_date) END AS b FROM m)
 SELECT symbol, trade_date, (coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0) AS value FROM r""", value=6)
def _(t):
    return intra.shape_composite(t.bars_m)


@query("in03_trend_vwap_ratio", f"WITH {TREND} SELECT symbol, trade_date, (tv - dv) / dv AS vwap_ratio FROM tf", vwap_ratio=6)
def _(t):
    return intra.trend_fund(t.bars_m).select("symbol", "trade_date", "vwap_ratio")


@query("in04_trend_support", f"WITH {TREND} SELECT symbol, trade_date, support FROM tf", support=6)
def _(t):
    return intra.trend_fund(t.bars_m).select("symbol", "trade_date", "support")


@query("in05_trend_signals", f"WITH {SIGNALS} SELECT symbol, trade_date, n_bars, n_hot, threshold, b_value, c_value, b_hit, c_hit FROM sf", threshold=6, b_value=6)
def _(t):
    return intra.trend_signals(t.bars_m)


@query("in06_fused_signals", f"WITH {FUSED} SELECT symbol, trade_date, composite FROM fu")
def _(t):
    return intra.fuse_signals(intra.trend_signals(t.bars_m), t.bars_m).select("symbol", "trade_date", "composite")


@query("in07_basket", f"""WITH {FUSED}, sc AS (SELECT symbol, day_no, coalesce(-b_value * 100, 0) + coalesce(c_value / nullif(threshold, 0), 0) AS score FROM fu WHERE composite),
 be AS (SELECT c.day_no, c.trade_date, s.symbol, max(s.score) AS score FROM sc s JOIN cal c ON c.day_no BETWEEN s.day_no + 1 AND s.day_no + 5 GROUP BY 1, 2, 3)
 SELECT trade_date, symbol, score, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS INTEGER) AS rank FROM be QUALIFY rank <= 5""", score=5)
def _(t):
    fused = intra.fuse_signals(intra.trend_signals(t.bars_m), t.bars_m)
    return intra.basket(fused, t.bars_m)


@query("in08_cumulative_volume", """SELECT symbol, trade_date, minute_of_day, sum(volume) OVER (PARTITION BY symbol, trade_date ORDER BY minute_of_day) AS cum_volume FROM bars_m QUALIFY minute_of_day IN (570, 630, 690, 840)""")
def _(t):
    return intra.cumulative_volume(t.bars_m, ["09:30", "10:30", "11:30", "14:00"])


@query("in09_timer_rows", """SELECT symbol, trade_date, minute_of_day, close FROM bars_m WHERE minute_of_day IN (570, 630, 840) AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND trade_date >= DATE '2024-01-10'""", close=6)
def _(t):
    stored = t.bars_m.where("trade_date < date'2024-01-10'")
    return intra.timer_rows(t.bars_m, ["09:30", "10:30", "14:00"], stored).select("symbol", "trade_date", "minute_of_day", "close")


@query("in10_anchor_price", """WITH l AS (SELECT * FROM bars_m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC, minute_of_day DESC) <= 30)
 SELECT symbol, sum(close * volume) FILTER (close > 0 AND volume > 0) / sum(volume) FILTER (close > 0 AND volume > 0) AS anchor FROM l GROUP BY 1""", anchor=6)
def _(t):
    vw = t.ticks.groupBy("symbol").agg((F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("tick_vwap"))
    return intra.anchor_price(t.bars_m, 30, vw)


@query("in11_quotes", """WITH q AS (SELECT symbol, max(datetime) AS quoted_at, arg_max(price, (datetime, event_id)) AS price FROM ticks GROUP BY 1),
 p AS (SELECT symbol, avg(close) AS pre_close FROM bars_m GROUP BY 1) SELECT q.symbol, quoted_at, price, pre_close, (price - pre_close) / nullif(pre_close, 0) AS change FROM q LEFT JOIN p USING (symbol)""", price=6, pre_close=6, change=6)
def _(t):
    return intra.quotes(t.ticks, t.bars_m.groupBy("symbol").agg(F.avg("close").alias("pre_close")))


# --- small-cap core -------------------------------------------------------------


@query("scf01_market_cap", "SELECT symbol, trade_date, coalesce(circ_mv, total_mv) AS value FROM basic", value=2)
def _(t):
    return sc.market_cap(t.basic)


@query("scf02_market_cap_rank", "SELECT symbol, trade_date, CAST(row_number() OVER (PARTITION BY trade_date ORDER BY coalesce(circ_mv, total_mv), symbol) AS DOUBLE) AS value FROM basic")
def _(t):
    return sc.cap_rank(sc.market_cap(t.basic))


@query("scf03_is_st", f"""WITH d AS (SELECT DISTINCT trade_date FROM panel_d), s AS ({STOCKS}),
 h AS (SELECT trade_date, symbol FROM d, ({CHANGES}) c WHERE contains(name, 'ST') AND start_date <= trade_date AND (end_date IS NULL OR end_date >= trade_date)
 UNION SELECT trade_date, symbol FROM d, s WHERE is_st > 0 OR contains(name, 'ST') UNION SELECT trade_date, symbol FROM d, s WHERE delist_date <= trade_date)
 SELECT s.symbol, d.trade_date, CASE WHEN h.symbol IS NULL THEN 0.0 ELSE 1.0 END AS value FROM s CROSS JOIN d LEFT JOIN h ON h.symbol = s.symbol AND h.trade_date = d.trade_date""", value=1)
def _(t):
    return sc.st_flags(stocks(t), changes(t), t.panel_d.select("trade_date").distinct())


@query("scf04_is_paused", """SELECT s.symbol, d.trade_date, CASE WHEN b.symbol IS NULL THEN 1.0 ELSE 0.0 END AS value FROM (SELECT DISTINCT symbol FROM ticks) s CROSS JOIN (SELECT DISTINCT trade_date FROM ticks) d
 LEFT JOIN (SELECT DISTINCT symbol, trade_date FROM ticks WHERE minute_of_day = 630) b ON b.symbol = s.symbol AND b.trade_date = d.trade_date""", value=1)
def _(t):
    return sc.paused_flags(t.ticks.select("symbol").distinct(), t.ticks.select("trade_date").distinct(), t.ticks, 630)


@query("scf05_limit_flags", """SELECT p.symbol, p.trade_date, CASE WHEN up_limit > 0 AND close >= up_limit - 0.0001 THEN 1.0 ELSE 0.0 END AS is_limit_up,
 CASE WHEN down_limit > 0 AND close <= down_limit + 0.0001 THEN 1.0 ELSE 0.0 END AS is_limit_down FROM panel_l p LEFT JOIN limits_l USING (symbol, trade_date)""", is_limit_up=1, is_limit_down=1)
def _(t):
    return sc.limit_flags(t.panel_l, t.limits_l)


@query("scf06_yesterday_limit_up", """WITH c AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM panel_l))
 SELECT p.symbol, p.trade_date, CASE WHEN EXISTS (SELECT 1 FROM panel_l q JOIN limits_l l USING (symbol, trade_date) WHERE q.symbol = p.symbol AND q.trade_date = c.prev AND l.up_limit > 0 AND q.close >= l.up_limit - 0.0001) THEN 1.0 ELSE 0.0 END AS yesterday_limit_up
 FROM panel_l p JOIN c USING (trade_date)""", yesterday_limit_up=1)
def _(t):
    return sc.yesterday_limit_up(t.panel_l, t.limits_l)


for _name, _node in sc.BAR_FACTORS.items():
    _no = {"v4gv": "07", "v4gv_signal": "07", "macd_positive": "08"}.get(_name, "09")
    factor(f"scf{_no}_{_name}", _node, "panel_l")

_HV = sc.high_volume(20, 0.9, 1.0)
_HV_SOURCE = "(SELECT *, volume * (0.5 + (symbol % 10) / 10.0) AS cum_volume FROM panel_l)"


@query("scf10_high_volume", factor_sql(_HV_SOURCE, _HV))
def _(t):
    bars = t.panel_l.withColumn("cum_volume", F.col("volume") * (0.5 + (F.col("symbol") % 10) / 10.0))
    out = with_factors(bars, _HV, section_rows=1).select("symbol", "trade_date", *_HV)
    return out.select("symbol", "trade_date", *[(F.round(F.col(c) + 1e-9, 6) + 0.0).alias(c) for c in _HV])


_HEAT = "(SELECT p.*, l.up_limit FROM panel_l p LEFT JOIN limits_l l USING (symbol, trade_date))"
factor("scf12_limit_up_heat", sc.limit_heat(), "panel_l", source=_HEAT,
       bars=lambda t: t.panel_l.join(t.limits_l.select("symbol", "trade_date", "up_limit"), ["symbol", "trade_date"], "left"))


@query("scf12_drop_hottest", f"""WITH h AS ({factor_sql(_HEAT, {'value': sc.limit_heat()})}),
 r AS (SELECT *, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, value) - 1) / 2.0) / count(value) OVER (PARTITION BY trade_date) END AS pct FROM h),
 k AS (SELECT *, count(*) FILTER (value IS NULL OR pct <= 0.8) OVER (PARTITION BY trade_date) AS left_ FROM r)
 SELECT symbol, trade_date, value FROM k WHERE value IS NULL OR pct <= 0.8 OR left_ < 5""", value=3)
def _(t):
    bars = t.panel_l.join(t.limits_l.select("symbol", "trade_date", "up_limit"), ["symbol", "trade_date"], "left")
    return sc.drop_hottest(with_factors(bars, {"value": sc.limit_heat()}, section_rows=1).select("symbol", "trade_date", "value"),
                           section_rows=t.section_rows_l)
