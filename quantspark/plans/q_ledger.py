"""Ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.bars import AMOUNT, CLOSE, VOLUME
from quantspark.functions import expr as x
from quantspark.operators import aggregates as ag
from quantspark.operators import ledger as ld
from quantspark.plans.registry import factor, query

FILLED = "(SELECT * FROM ledger WHERE status = 'filled')"
FIFO = f"""b AS (SELECT *, sum(quantity) OVER w AS e1, sum(quantity) OVER w - quantity AS e0 FROM {FILLED} WHERE side = 'BUY' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date, seq, quantity, price ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, sum(quantity) OVER w AS e1, sum(quantity) OVER w - quantity AS e0 FROM {FILLED} WHERE side = 'SELL' WINDOW w AS (PARTITION BY symbol ORDER BY trade_date, seq, quantity, price ROWS UNBOUNDED PRECEDING)),
 fifo AS (SELECT s.symbol, s.seq, s.e0, any_value(s.trade_date) AS trade_date, any_value(s.quantity) AS quantity, sum(least(b.e1, s.e1) - greatest(b.e0, s.e0)) AS matched,
 sum((least(b.e1, s.e1) - greatest(b.e0, s.e0)) * (s.price - b.price)) AS realised, max(b.trade_date) < any_value(s.trade_date) AS t_plus_1 FROM s JOIN b ON b.symbol = s.symbol AND b.e0 < s.e1 AND s.e0 < b.e1 GROUP BY 1, 2, 3)"""


#: a symbol-day is split by ranges of the sequence number; one range spans 10,000 orders of all symbols
SEQ_RANGE = 10_000 * 1_000_000_000


def part():
    return F.expr(f"seq div {SEQ_RANGE}")


def filled(t):
    return t.ledger.where("status = 'filled'")


@query("ld01_fifo_realised", f"WITH {FIFO} SELECT symbol, seq, trade_date, quantity, matched, realised, t_plus_1 FROM fifo", realised=2)
def _(t):
    return ld.fifo_realised(filled(t), part())


RECONCILE = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date, seq, quantity, price) AS rn FROM {FILLED}),
 z AS (SELECT symbol, rn, CASE WHEN side = 'BUY' THEN quantity ELSE 0.0 END AS q, CASE WHEN side = 'BUY' THEN order_value / quantity ELSE 0.0 END AS a, 0.0::DOUBLE AS r, CASE WHEN side = 'BUY' THEN -order_value ELSE 0.0 END AS c FROM o WHERE rn = 1
 UNION ALL SELECT o.symbol, o.rn, CASE WHEN side = 'BUY' THEN q + quantity ELSE q - least(q, quantity) END, CASE WHEN side = 'BUY' THEN (a * q + order_value) / (q + quantity) ELSE a END,
 CASE WHEN side = 'BUY' THEN r ELSE r + (price - a) * least(q, quantity) END, CASE WHEN side = 'BUY' THEN c - order_value ELSE c + round(least(q, quantity) * price, 2) END FROM z JOIN o ON o.symbol = z.symbol AND o.rn = z.rn + 1)
 SELECT symbol, q AS quantity, CASE WHEN q > 1e-6 THEN a END AS avg_cost, r AS realised, c AS cash_flow FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1"""


@query("ld02_average_cost", RECONCILE, quantity=3, avg_cost=4, realised=1, cash_flow=1)
def _(t):
    return ld.average_cost(filled(t), part())


@query("ld03_apply_pending", f"""WITH p AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS quantity FROM {FILLED} GROUP BY 1),
 n AS (SELECT symbol, sum(CASE WHEN side = 'BUY' THEN quantity * price ELSE 0 END) AS reserved_cash, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS net_quantity FROM ledger WHERE status = 'pending' GROUP BY 1)
 SELECT coalesce(p.symbol, n.symbol) AS symbol, greatest(0.0, coalesce(quantity, 0) + coalesce(net_quantity, 0)) AS quantity_after, coalesce(reserved_cash, 0) AS reserved_cash FROM p FULL JOIN n ON p.symbol = n.symbol""", quantity_after=2, reserved_cash=1)
def _(t):
    pos = filled(t).groupBy("symbol").agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("quantity"))
    return ld.apply_pending(pos, ag.pending_effect(t.ledger))


@query("ld04_first_exit", """WITH e AS (SELECT symbol, trade_date AS entry_date, close AS entry_price FROM panel_d WHERE day(trade_date) % 7 = 1 AND close > 0),
 j AS (SELECT e.*, p.trade_date, p.close, greatest(max(p.close) OVER (PARTITION BY e.symbol, e.entry_date ORDER BY p.trade_date), entry_price) AS peak FROM e JOIN panel_d p ON p.symbol = e.symbol AND p.trade_date > e.entry_date),
 h AS (SELECT *, CASE WHEN close / entry_price - 1 <= -0.1 THEN 'stop_loss' WHEN close / peak - 1 <= -0.15 THEN 'trailing_stop' WHEN close / entry_price - 1 >= 0.3 THEN 'take_profit' END AS rule FROM j),
 f AS (SELECT symbol, entry_date, min(trade_date) AS exit_date, min_by(rule, trade_date) AS rule, min_by(close, trade_date) AS exit_price FROM h WHERE rule IS NOT NULL GROUP BY 1, 2)
 SELECT e.symbol, e.entry_date, entry_price, exit_date, rule, exit_price FROM e LEFT JOIN f ON e.symbol = f.symbol AND e.entry_date = f.entry_date""", entry_price=4, exit_price=4)
def _(t):
    e = t.panel_d.where("dayofmonth(trade_date) % 7 = 1 and close > 0").select("symbol", F.col("trade_date").alias("entry_date"), F.col("close").alias("entry_price"))
    return ld.first_exit(e, t.panel_d)


@query("ld04_first_exit_long", """WITH b AS (SELECT *, volume > 0.9 * max(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AND count(*) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) = 20 AS hot FROM panel_l),
 e AS (SELECT symbol, trade_date AS entry_date, close AS entry_price FROM panel_l WHERE day(trade_date) = 3),
 j AS (SELECT e.*, p.trade_date, p.close, p.hot, greatest(max(p.close) OVER (PARTITION BY e.symbol, e.entry_date ORDER BY p.trade_date), entry_price) AS peak FROM e JOIN b p ON p.symbol = e.symbol AND p.trade_date > e.entry_date),
 h AS (SELECT *, CASE WHEN close / entry_price - 1 <= -0.6 THEN 'stop_loss' WHEN close / peak - 1 <= -0.7 THEN 'trailing_stop' WHEN close / entry_price - 1 >= 1.5 THEN 'take_profit' WHEN hot THEN 'risk' END AS rule FROM j),
 f AS (SELECT symbol, entry_date, min(trade_date) AS exit_date, min_by(rule, trade_date) AS rule, min_by(close, trade_date) AS exit_price FROM h WHERE rule IS NOT NULL GROUP BY 1, 2)
 SELECT e.symbol, e.entry_date, entry_price, exit_date, rule, exit_price FROM e LEFT JOIN f ON e.symbol = f.symbol AND e.entry_date = f.entry_date""", entry_price=4, exit_price=4)
def _(t):
    before = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-20, -1)
    hot = (F.col("volume") > 0.9 * F.max("volume").over(before)) & (F.count("*").over(before) == 20)
    e = t.panel_l.where("dayofmonth(trade_date) = 3").select("symbol", F.col("trade_date").alias("entry_date"), F.col("close").alias("entry_price"))
    return ld.first_exit(e, t.panel_l.withColumn("hot", hot), 0.6, 0.7, 1.5, risk="hot")


_BARS = "(SELECT l_partkey % 50 AS symbol, CAST(l_shipdate AS DATE) AS trade_date, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"


@query("ld05_order_flags", f"""SELECT l.symbol, l.trade_date, l.seq, l.quantity, coalesce(l.price BETWEEN b.close * 0.9 AND b.close * 1.1, false) AS price_ok, coalesce(l.quantity <= 0.25 * b.volume, false) AS liquid_ok
 FROM ledger l LEFT JOIN {_BARS} b ON b.symbol = l.symbol AND b.trade_date = l.trade_date""", quantity=2)
def _(t):
    bars = t.ledger.groupBy("symbol", "trade_date").agg((F.sum("order_value") / F.sum("quantity")).alias("close"), F.sum("quantity").alias("volume"))
    return ld.order_flags(t.ledger, bars)


@query("ld06_trade_rollup", f"WITH {FIFO} SELECT symbol, count(*) AS trades, count(*) FILTER (realised > 0) AS wins, avg(realised) AS mean_pnl, count(*) FILTER (realised > 0) * 1.0 / count(*) AS win_rate FROM fifo GROUP BY 1", mean_pnl=2, win_rate=6)
def _(t):
    return ld.trade_rollup(ld.fifo_realised(filled(t), part()))


factor("ld06_mavg", x.mean(CLOSE, 5, 1))
factor("ld06_vwap", x.total(AMOUNT, 5, 1) / x.total(VOLUME, 5, 1))
