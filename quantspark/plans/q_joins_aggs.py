"""Join and aggregation queries."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from quantspark.factors.bars import RET
from quantspark.operators import aggregates as ag
from quantspark.operators import joins as jn
from quantspark.operators.panel import with_factors
from quantspark.operators.statements import DERIVED, align_statements
from quantspark.plans.q_filters import STOCKS, stocks
from quantspark.plans.registry import query
from quantspark.sources.store import latest

union = lambda *dfs: reduce(lambda a, b: a.unionByName(b), dfs)
_W = "(PARTITION BY p.symbol ORDER BY p.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("jn01_basic_ffill", f"""SELECT p.symbol, p.trade_date, last_value(b.pb IGNORE NULLS) OVER {_W} AS pb, last_value(b.total_mv IGNORE NULLS) OVER {_W} AS total_mv
 FROM panel_l p LEFT JOIN basic b ON p.symbol = b.symbol AND p.trade_date = b.trade_date""", pb=6, total_mv=2)
def _(t):
    return jn.attach_filled(t.panel_l, t.basic, ["pb", "total_mv"]).select("symbol", "trade_date", "pb", "total_mv")


@query("jn02_limits", """SELECT p.symbol, p.trade_date, up_limit, down_limit FROM panel_l p LEFT JOIN limits_l USING (symbol, trade_date)""", up_limit=5, down_limit=5)
def _(t):
    return jn.attach_optional(t.panel_l, t.limits_l, ["up_limit", "down_limit"]).select("symbol", "trade_date", "up_limit", "down_limit")


@query("jn02_missing_table", "SELECT symbol, trade_date, CAST(NULL AS DOUBLE) AS up_limit FROM panel_l")
def _(t):
    return jn.attach_optional(t.panel_l, None, ["up_limit"]).select("symbol", "trade_date", "up_limit")


@query("jn03_statement_asof", """SELECT p.symbol, p.trade_date, f.report_date, f.quarter_revenue_yoy, f.debt_ratio FROM panel_l p ASOF LEFT JOIN
 (SELECT * FROM fin_q QUALIFY row_number() OVER (PARTITION BY symbol, available_date ORDER BY report_date DESC) = 1) f
 ON p.symbol = f.symbol AND p.trade_date >= f.available_date""", quarter_revenue_yoy=6, debt_ratio=6)
def _(t):
    return align_statements(t.panel_l, t.fin_q, ["quarter_revenue_yoy", "debt_ratio"]).select(
        "symbol", "trade_date", "report_date", "quarter_revenue_yoy", "debt_ratio")


@query("jn04_report_date_asof", "SELECT symbol, trade_date, report_date, revenue, total_assets FROM research_l", revenue=0, total_assets=0)
def _(t):
    return t.research_l.select("symbol", "trade_date", "report_date", "revenue", "total_assets")


@query("jn05_metadata", "SELECT p.symbol, p.trade_date, coalesce(d.industry, '') AS industry, coalesce(d.sector, '') AS sector FROM panel_l p LEFT JOIN dim_l d USING (symbol)")
def _(t):
    return jn.attach_metadata(t.panel_l, t.dim_l, ["industry", "sector"]).select("symbol", "trade_date", "industry", "sector")


@query("jn06_pit_snapshot", """SELECT symbol, report_date, ann_date, revenue FROM fin WHERE ann_date <= DATE '2000-06-30'
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ann_date DESC, report_date DESC) = 1""", revenue=2)
def _(t):
    known = t.fin.where(F.col("ann_date") <= date(2000, 6, 30)).select("symbol", "report_date", "ann_date", "revenue")
    return jn.newest(known, ["symbol"], F.struct("ann_date", "report_date"))


_ACTIVE = """(SELECT d.trade_date, s.trade_date AS snapshot FROM (SELECT DISTINCT trade_date FROM panel_l) d ASOF JOIN (SELECT DISTINCT trade_date FROM idx) s ON d.trade_date >= s.trade_date)"""


@query("jn07_membership_pit", f"""SELECT p.symbol, p.trade_date, p.close FROM panel_l p JOIN {_ACTIVE} a USING (trade_date)
 JOIN idx m ON m.trade_date = a.snapshot AND m.symbol = p.symbol""", close=6)
def _(t):
    return jn.membership(t.panel_l, t.idx).select("symbol", "trade_date", "close")


@query("jn07_membership_static", """SELECT symbol, trade_date, close FROM panel_l WHERE symbol IN (SELECT symbol FROM idx WHERE trade_date = (SELECT max(trade_date) FROM idx))""", close=6)
def _(t):
    return jn.membership(t.panel_l, t.idx, "static").select("symbol", "trade_date", "close")


@query("jn07_membership_union", "SELECT symbol, trade_date, close FROM panel_l WHERE symbol IN (SELECT symbol FROM idx)", close=6)
def _(t):
    return jn.membership(t.panel_l, t.idx, "union").select("symbol", "trade_date", "close")


@query("jn08_pool_symbols", """SELECT DISTINCT symbol FROM idx WHERE trade_date BETWEEN DATE '1999-06-01' - 370 AND DATE '1999-12-31'""")
def _(t):
    start, end = date(1999, 6, 1), date(1999, 12, 31)
    hit = t.idx.where(F.col("trade_date").between(F.date_sub(F.lit(start), 370), F.lit(end)))
    if hit.limit(1).isEmpty():  # no snapshot in range: the newest one before it
        last = t.idx.where(F.col("trade_date") <= end).agg(F.max("trade_date")).scalar()
        hit = t.idx.where(F.col("trade_date") == last)
    return hit.select("symbol").distinct()


@query("jn09_block_members", """WITH m AS (SELECT industry AS block, symbol, max(trade_date) AS member_date FROM idx JOIN dim_l USING (symbol) GROUP BY 1, 2),
 f AS (SELECT industry AS block, trade_date, sum(amount) AS net FROM panel_m JOIN dim_l USING (symbol) GROUP BY 1, 2)
 SELECT f.trade_date, m.symbol, m.block, f.net FROM f JOIN m USING (block)""", net=2)
def _(t):
    member = t.idx.join(t.dim_l, "symbol").groupBy(F.col("industry").alias("block"), "symbol").agg(F.max("trade_date").alias("member_date"))
    flow = t.panel_m.join(t.dim_l, "symbol").groupBy(F.col("industry").alias("block"), "trade_date").agg(F.sum("amount").alias("net"))
    return jn.spread_join(flow, member, "block").select("trade_date", "symbol", "block", "net")  # few blocks, each with many pairs


@query("jn10_prior_external_day", """WITH e AS (SELECT trade_date AS ext_date, avg(price) AS level FROM ticks WHERE day(trade_date) % 3 <> 0 GROUP BY 1),
 j AS (SELECT d.trade_date, e.ext_date, e.level FROM (SELECT DISTINCT trade_date FROM panel_d) d ASOF LEFT JOIN e ON d.trade_date > e.ext_date)
 SELECT trade_date, CASE WHEN trade_date - ext_date <= 5 THEN ext_date END AS ext_date, CASE WHEN trade_date - ext_date <= 5 THEN level END AS level FROM j""", level=6)
def _(t):
    ext = t.ticks.where(F.dayofmonth("trade_date") % 3 != 0).groupBy(F.col("trade_date").alias("ext_date")).agg(F.avg("price").alias("level"))
    days = t.panel_d.select("trade_date").distinct().withColumn("k", F.lit(0))
    j = jn.asof_join(days, ext.withColumn("k", F.lit(0)), "trade_date", "ext_date", ["level"], key="k", strict=True)
    fresh = F.datediff("trade_date", "ext_date") <= 5
    return j.select("trade_date", F.when(fresh, F.col("ext_date")).alias("ext_date"), F.when(fresh, F.col("level")).alias("level"))


@query("jn11_expand_signal", """WITH s AS (SELECT symbol, trade_date AS f, lead(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS u, close FROM panel_m)
 SELECT s.symbol, d.trade_date, s.close FROM s JOIN (SELECT DISTINCT trade_date FROM panel_l) d ON d.trade_date >= s.f AND (s.u IS NULL OR d.trade_date < s.u)""", close=6)
def _(t):
    return jn.expand_signal(t.panel_m, t.panel_l.select("trade_date").distinct(), ["close"])


@query("jn12_model_merge", """SELECT a.symbol, a.trade_date, a.close AS m1, b.volume AS m2 FROM panel_d a JOIN panel_d b USING (symbol, trade_date) WHERE a.close > 20 AND b.volume > 50""", m1=6)
def _(t):
    a = t.panel_d.where("close > 20").select("symbol", "trade_date", F.col("close").alias("m1"))
    b = t.panel_d.where("volume > 50").select("symbol", "trade_date", F.col("volume").alias("m2"))
    return a.join(b, ["symbol", "trade_date"])


_NAVS = """WITH s AS (SELECT trade_date, avg(close) AS v FROM panel_d GROUP BY 1), b AS (SELECT trade_date, avg(price) AS v FROM ticks WHERE day(trade_date) > 2 GROUP BY 1),
 j AS (SELECT s.trade_date, s.v AS sv, b.v AS bv FROM s JOIN b USING (trade_date) WHERE s.v > 0 AND b.v > 0)
 SELECT trade_date, sv / first_value(sv) OVER (ORDER BY trade_date) AS strategy, bv / first_value(bv) OVER (ORDER BY trade_date) AS benchmark FROM j"""


@query("jn13_benchmark_align", _NAVS, strategy=6, benchmark=6)
def _(t):
    from quantspark.operators.portfolio import align_navs

    s = t.panel_d.groupBy("trade_date").agg(F.avg("close").alias("nav"))
    b = t.ticks.where(F.dayofmonth("trade_date") > 2).groupBy("trade_date").agg(F.avg("price").alias("nav"))
    return align_navs(s, b)


@query("jn14_align_frames", """WITH r AS (SELECT symbol, trade_date, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS ret FROM panel_d),
 f AS (SELECT symbol, trade_date, volume AS factor FROM panel_d WHERE day(trade_date) <> 7),
 d AS (SELECT trade_date FROM f GROUP BY 1 HAVING count(factor) > 0 INTERSECT SELECT trade_date FROM r GROUP BY 1 HAVING count(ret) > 0)
 SELECT coalesce(f.symbol, r.symbol) AS symbol, d.trade_date, f.factor, r.ret FROM d JOIN (f FULL JOIN r ON f.symbol = r.symbol AND f.trade_date = r.trade_date) ON d.trade_date = coalesce(f.trade_date, r.trade_date)""", ret=6)
def _(t):
    r = with_factors(t.panel_d, {"ret": RET}, section_rows=1).select("symbol", "trade_date", "ret")
    f = t.panel_d.where(F.dayofmonth("trade_date") != 7).select("symbol", "trade_date", F.col("volume").alias("factor"))
    both = f.join(r, ["symbol", "trade_date"], "full")
    days = both.groupBy("trade_date").agg(F.count("factor").alias("nf"), F.count("ret").alias("nr")).where("nf > 0 and nr > 0")
    return both.join(F.broadcast(days.select("trade_date")), "trade_date").select("symbol", "trade_date", "factor", "ret")  # one row per day


@query("jn15_orphans", """SELECT 'lineitem.orders' AS relation, count(*) AS orphan_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT 'lineitem.part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT 'lineitem.customer', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT c_custkey FROM customer)""")
def _(t):
    li = t.raw("lineitem")
    return union(jn.orphans(li, t.raw("orders"), "l_orderkey", "o_orderkey", "lineitem.orders"),
                 jn.orphans(li, t.raw("part"), "l_partkey", "p_partkey", "lineitem.part"),
                 jn.orphans(li, t.raw("customer"), "l_partkey", "c_custkey", "lineitem.customer"))


_ALIAS = "(SELECT item_id AS symbol, upper(regexp_extract(text, '[A-Za-z]{6,}')) AS alias FROM benchmark WHERE length(regexp_extract(text, '[A-Za-z]{6,}')) >= 3)"


@query("jn16_mentions", f"SELECT DISTINCT p.doc_id, a.symbol FROM posts p JOIN {_ALIAS} a ON contains(replace(upper(p.text), 'ẞ', 'SS'), a.alias)")  # Spark's capital of ß is SS
def _(t):
    alias = F.upper(F.regexp_extract("text", "[A-Za-z]{6,}", 0))
    aliases = t.raw("benchmark").select(F.col("item_id").alias("symbol"), alias.alias("alias"))
    return jn.mentions(t.posts.select("doc_id", "text"), aliases)


@query("jn16_codes", r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text || ' sz' || lpad(CAST(doc_id % 1000 AS VARCHAR), 6, '0') || ', BJ12'), '\b((?:SH|SZ|BJ)\d{6})\b', 1)) AS symbol FROM posts""")
def _(t):
    # the given texts hold no codes, so each gets one
    code = F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0")
    return jn.code_mentions(t.posts.select("doc_id", F.concat("text", F.lit(" sz"), code, F.lit(", BJ12")).alias("text")))


@query("jn17_latest_financial", """SELECT symbol, max(report_date) AS report_date, max_by(revenue, report_date) AS revenue, max_by(net_profit, report_date) AS net_profit FROM fin GROUP BY symbol""", revenue=2, net_profit=2)
def _(t):
    return jn.newest(t.fin, ["symbol"], F.col("report_date"), ["report_date", "revenue", "net_profit"])


@query("jn18_watchlist", f"""WITH w AS (SELECT o_custkey - 1 AS symbol, max(o_orderdate) AS added FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
 c AS (SELECT symbol, array_to_string(list_sort(list(DISTINCT event_type))[1:12], ',') AS concepts FROM (SELECT user_id AS symbol, event_type FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)) GROUP BY symbol)
 SELECT w.symbol, s.name, s.industry, CAST(w.added AS DATE) AS added, c.concepts FROM w LEFT JOIN ({STOCKS}) s USING (symbol) LEFT JOIN c USING (symbol)""")
def _(t):
    w = t.raw("orders").where("o_orderpriority = '1-URGENT'").groupBy((F.col("o_custkey") - 1).alias("symbol")).agg(F.max("o_orderdate").alias("added"))
    day = t.ticks.agg(F.max("trade_date")).scalar()
    tags = t.raw("events").where(F.to_date("ts") == day).groupBy(F.col("user_id").alias("symbol")).agg(
        F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 12), ",").alias("concepts"))
    return w.join(stocks(t), "symbol", "left").join(tags, "symbol", "left").orderBy(F.desc("added"), "symbol").select(
        "symbol", "name", "industry", F.to_date("added").alias("added"), "concepts")


@query("jn19_price_space", """WITH d AS (SELECT symbol, trade_date, avg(close) * 1.02 AS close FROM bars_m GROUP BY 1, 2),
 m AS (SELECT symbol, trade_date, arg_max(close, minute_of_day) AS close FROM bars_m WHERE minute_of_day <= 900 GROUP BY 1, 2),
 r AS (SELECT symbol, trade_date, lag(d.close) OVER w / nullif(lag(m.close) OVER w, 0) AS ratio FROM d LEFT JOIN m USING (symbol, trade_date) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
 SELECT b.symbol, b.trade_date, b.minute_of_day, CASE WHEN close > 0 THEN close * CASE WHEN ratio > 0 THEN ratio ELSE 1 END ELSE close END AS close FROM bars_m b LEFT JOIN r USING (symbol, trade_date)""", close=5)
def _(t):
    from quantspark.factors.intraday import adjust_price_space

    daily = t.bars_m.groupBy("symbol", "trade_date").agg((F.avg("close") * 1.02).alias("close"))
    return adjust_price_space(t.bars_m, daily, 900, ["close"]).select("symbol", "trade_date", "minute_of_day", "close")


@query("jn20_yesterday_limit_up", """WITH c AS (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM panel_l)),
 u AS (SELECT p.symbol, p.trade_date, CASE WHEN p.close >= l.up_limit - 0.0001 THEN 1.0 ELSE 0.0 END AS up FROM panel_l p JOIN limits_l l USING (symbol, trade_date) WHERE l.up_limit > 0)
 SELECT p.symbol, p.trade_date, coalesce(u.up, 0.0) AS yesterday_limit_up FROM panel_l p JOIN c USING (trade_date) LEFT JOIN u ON u.symbol = p.symbol AND u.trade_date = c.prev""")
def _(t):
    from quantspark.factors.smallcap import yesterday_limit_up

    return yesterday_limit_up(t.panel_l, t.limits_l)


@query("jn21_statement_assembly", """WITH a AS (SELECT symbol, report_date, ann_date, revenue FROM fin WHERE revenue > 0), b AS (SELECT symbol, report_date, total_assets FROM fin WHERE month(report_date) <> 9),
 j AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.report_date, b.report_date) AS report_date, a.ann_date, a.revenue, b.total_assets FROM a FULL JOIN b ON a.symbol = b.symbol AND a.report_date = b.report_date)
 SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) <= 8""", revenue=2, total_assets=2)
def _(t):
    from pyspark.sql.window import Window

    a = t.fin.where("revenue > 0").select("symbol", "report_date", "ann_date", "revenue")
    b = t.fin.where("month(report_date) <> 9").select("symbol", "report_date", "total_assets")
    w = Window.partitionBy("symbol").orderBy(F.desc("report_date"))
    return a.join(b, ["symbol", "report_date"], "full").withColumn("rn", F.row_number().over(w)).where("rn <= 8").drop("rn")


# --- aggregations -------------------------------------------------------------


@query("ag01_weekly_bars", """SELECT symbol, CAST(date_trunc('week', trade_date) + INTERVAL 6 DAY AS DATE) AS period, min_by(open, trade_date) AS open, max(high) AS high,
 min(low) AS low, max_by(close, trade_date) AS close, sum(volume) AS volume, sum(amount) AS amount FROM panel_d GROUP BY 1, 2""", open=6, high=6, low=6, close=6, amount=3)
def _(t):
    return ag.resample(t.panel_d, ag.week_end(F.col("trade_date")))


@query("ag02_earliest_coverage", """SELECT min(trade_date) AS trade_date FROM (SELECT trade_date, count(DISTINCT symbol) AS s, count(DISTINCT (symbol, minute_of_day)) AS p FROM ticks GROUP BY 1) WHERE s >= 4 AND p >= 0.8 * 5 * 60""")
def _(t):
    return ag.earliest_covered(t.ticks, 5, 60)


@query("ag03_suspicious_days", """WITH days AS (SELECT trade_date, count(*) AS row_count, count(DISTINCT symbol) AS symbols, count(*) FILTER (volume > 0) AS positive_rows, sum(volume) AS volume FROM ticks GROUP BY 1)
 SELECT * FROM days WHERE row_count < 0.98 * (SELECT median(row_count) FROM days) OR symbols < 0.98 * (SELECT median(symbols) FROM days) OR positive_rows < 0.9 * row_count""")
def _(t):
    return ag.untypical_days(t.ticks, 0.98, 0.9)


@query("ag03_thin_days", """WITH days AS (SELECT trade_date, count(*) AS row_count, count(DISTINCT symbol) AS symbols, count(*) FILTER (volume > 0) AS positive_rows, sum(volume) AS volume FROM ticks GROUP BY 1)
 SELECT * FROM days WHERE row_count < 335 OR symbols < 5 OR positive_rows < 0.9 * row_count""")
def _(t):
    return ag.suspicious_days(t.ticks, 335, 5, 0.9)


@query("ag04_factor_coverage", """SELECT factor_name, count(*) AS row_count, count(DISTINCT symbol) AS symbols, min(trade_date) AS min_date, max(trade_date) AS max_date, count(DISTINCT trade_date) AS dates FROM latest GROUP BY 1""")
def _(t):
    from quantspark.sources import store

    return store.coverage(t.store)


@query("ag05_variants", """SELECT factor_name, params_hash, as_of_time, count(*) AS row_count, max(trade_date) AS max_date, params_hash = 'h0' AS is_default FROM latest GROUP BY 1, 2, 3
 QUALIFY row_number() OVER (PARTITION BY factor_name ORDER BY row_count DESC, params_hash, as_of_time) <= 10""")
def _(t):
    from quantspark.sources import store

    return store.variants(t.store, 10, "h0")


@query("ag06_required_coverage", """SELECT min(c) AS coverage FROM (SELECT factor_name, count(DISTINCT symbol) * 1.0 / (SELECT count(DISTINCT symbol) FROM panel_d) AS c FROM latest WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-06' GROUP BY 1)""", coverage=6)
def _(t):
    rows = latest(t.store).where(F.col("trade_date").between(date(2024, 1, 5), date(2024, 1, 6)))
    n = t.panel_d.select("symbol").distinct().agg(F.count(F.lit(1))).scalar()
    per = rows.select("factor_name", "symbol").distinct().groupBy("factor_name").agg(F.count(F.lit(1)).alias("s"))
    return per.agg(F.min(F.col("s") / n).alias("coverage"))


@query("ag07_freshness", """SELECT 'panel_d' AS dataset, max(trade_date) AS latest_date, CAST(DATE '2024-02-03' - max(trade_date) AS INTEGER) AS age_days, CASE WHEN DATE '2024-02-03' - max(trade_date) > 3 THEN 'stale' ELSE 'good' END AS status FROM panel_d
 UNION ALL SELECT 'panel_l', max(trade_date), CAST(DATE '2024-02-03' - max(trade_date) AS INTEGER), CASE WHEN DATE '2024-02-03' - max(trade_date) > 3 THEN 'stale' ELSE 'good' END FROM panel_l
 UNION ALL SELECT 'empty', NULL, NULL, 'missing'""")
def _(t):
    today = date(2024, 2, 3)
    named = lambda n, df: ag.freshness(df, "trade_date", today, 3).select(F.lit(n).alias("dataset"), "*")
    return union(named("panel_d", t.panel_d), named("panel_l", t.panel_l), named("empty", t.panel_l.where("symbol < 0")))


@query("ag08_dependency_gaps", """WITH h AS (SELECT factor_name AS dependency, min(trade_date) AS lo, max(trade_date) AS hi FROM store GROUP BY 1),
 n AS (SELECT n_name AS dependency, DATE '2023-12-20' AS s, DATE '2024-01-25' AS e FROM nation UNION ALL SELECT DISTINCT factor_name, DATE '2024-01-03', DATE '2024-02-10' FROM store)
 SELECT dependency, CASE WHEN hi IS NULL OR lo > s THEN s WHEN hi < e THEN hi + 1 END AS gap_start, CASE WHEN hi IS NULL OR hi < e THEN e WHEN lo > s THEN lo - 1 END AS gap_end,
 CASE WHEN hi IS NULL THEN 'error' WHEN hi < e OR lo > s THEN 'warning' ELSE 'ok' END AS severity FROM n LEFT JOIN h USING (dependency)""")
def _(t):
    have = t.store.groupBy(F.col("factor_name").alias("dependency")).agg(F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"))
    d = lambda s: F.lit(s).cast("date")
    needs = union(t.raw("nation").select(F.col("n_name").alias("dependency"), d("2023-12-20").alias("start_date"), d("2024-01-25").alias("end_date")),
                  t.store.select(F.col("factor_name").alias("dependency")).distinct().select("dependency", d("2024-01-03").alias("start_date"), d("2024-02-10").alias("end_date")))
    return ag.dependency_gaps(needs, have)


@query("ag09_incremental_plan", """SELECT max(trade_date) + 1 AS start_date, DATE '2024-02-10' AS end_date, max(trade_date) + 1 <= DATE '2024-02-10' AS needed FROM panel_d""")
def _(t):
    return ag.incremental_start(t.panel_d, "trade_date", date(2024, 2, 10), 30)


@query("ag10_missing_points", """WITH g AS (SELECT s.symbol, d.trade_date, m.minute_of_day FROM (SELECT DISTINCT symbol FROM ticks) s, (SELECT DISTINCT trade_date FROM ticks) d, (SELECT unnest([570, 630, 840]) AS minute_of_day) m)
 SELECT symbol, CAST(year(trade_date) AS INTEGER) AS year, CAST(month(trade_date) AS INTEGER) AS month, min(trade_date) AS from_date, max(trade_date) AS to_date, count(*) AS points FROM g
 WHERE NOT EXISTS (SELECT 1 FROM ticks k WHERE k.symbol = g.symbol AND k.trade_date = g.trade_date AND k.minute_of_day = g.minute_of_day) GROUP BY 1, 2, 3""")
def _(t):
    return ag.missing_points(t.ticks, t.ticks.select("trade_date").distinct(), t.ticks.select("symbol").distinct(), [570, 630, 840])


@query("ag11_dividend_yield", """WITH d AS (SELECT symbol, report_date AS ex_date, 0.001 * total_assets / 1000 AS dividend FROM fin),
 s AS (SELECT *, sum(dividend) OVER (PARTITION BY symbol ORDER BY ex_date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS trailing_sum FROM d)
 SELECT s.symbol, s.ex_date, s.trailing_sum, s.trailing_sum / nullif(p.close, 0) AS dividend_yield FROM s ASOF LEFT JOIN panel_l p ON s.symbol = p.symbol AND s.ex_date >= p.trade_date""", trailing_sum=6, dividend_yield=6)
def _(t):
    div = t.fin.select("symbol", F.col("report_date").alias("ex_date"), (0.001 * F.col("total_assets") / 1000).alias("dividend"))
    return ag.dividend_yield(div, t.panel_l).select("symbol", "ex_date", "trailing_sum", "dividend_yield")


@query("ag12_quarterly", "SELECT symbol, report_date, available_date, " + ", ".join(DERIVED) + " FROM fin_q", **{c: 6 for c in DERIVED})
def _(t):
    return t.fin_q.select("symbol", "report_date", "available_date", *DERIVED)


@query("ag13_sentiment_summary", """WITH k AS (SELECT source, w, count(*) AS c FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM posts) GROUP BY 1, 2),
 t AS (SELECT source, string_agg(w, ',' ORDER BY rn) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY c DESC, w) AS rn FROM k) WHERE rn <= 10 GROUP BY 1)
 SELECT p.source, count(*) AS posts, sum(reply_count) AS comments, avg(CASE WHEN like_count >= 4 THEN 1.0 ELSE 0.0 END) AS bullish, avg(CASE WHEN like_count <= 1 THEN 1.0 ELSE 0.0 END) AS bearish, any_value(t.keywords) AS keywords
 FROM posts p LEFT JOIN t ON p.source = t.source GROUP BY p.source""", bullish=6, bearish=6)
def _(t):
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    stats = t.posts.groupBy("source").agg(F.count(F.lit(1)).alias("posts"), F.sum("reply_count").alias("comments"),
                                          one(F.col("like_count") >= 4).alias("bullish"), one(F.col("like_count") <= 1).alias("bearish"))
    words = ag.top_words(t.posts, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)), "source")
    return stats.join(words, "source", "left")


@query("ag14_sentiment_overview", """SELECT coalesce(source, '(all)') AS source, count(*) AS posts, count(DISTINCT lang) AS langs, CAST(sum(reply_count) AS BIGINT) AS replies, max(published_at) AS latest_date FROM posts GROUP BY ROLLUP (source)""")
def _(t):
    return ag.sentiment_overview(t.posts)


@query("ag15_trade_analysis", """SELECT trade_date, side, status, count(*) AS orders, sum(order_value) AS notional, CAST(count(*) FILTER (status = 'filled') AS BIGINT) AS filled_orders, CAST(grouping(trade_date, side, status) AS BIGINT) AS level
 FROM ledger GROUP BY GROUPING SETS ((trade_date), (side), (status), ())""", notional=1)
def _(t):
    return ag.trade_analysis(t.ledger)


@query("ag15_top_symbols", "SELECT symbol, count(*) AS orders, sum(order_value) AS notional FROM ledger GROUP BY 1 ORDER BY notional DESC, symbol LIMIT 10", notional=1)
def _(t):
    return ag.trade_top_symbols(t.ledger)


@query("ag16_pending_effect", """SELECT symbol, sum(CASE WHEN side = 'BUY' THEN quantity * price ELSE 0 END) AS reserved_cash, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS net_quantity
 FROM ledger WHERE status = 'pending' GROUP BY 1""", reserved_cash=1)
def _(t):
    return ag.pending_effect(t.ledger)


@query("ag17_feature_snapshot", """SELECT symbol, trade_date, max(value) FILTER (factor_name = 'close_level') AS close_level, max(value) FILTER (factor_name = 'volume_level') AS volume_level, CAST(NULL AS DOUBLE) AS absent_level,
 (CAST(count(*) FILTER (factor_name = 'close_level') > 0 AS INT) + CAST(count(*) FILTER (factor_name = 'volume_level') > 0 AS INT)) / 3.0 AS coverage FROM latest GROUP BY 1, 2""", close_level=6, coverage=6)
def _(t):
    return ag.snapshot_matrix(t.store, ["close_level", "volume_level", "absent_level"])


@query("ag18_facets", """SELECT 'as_of_time' AS field, as_of_time AS facet, count(*) AS runs, count(DISTINCT factor_name) AS factors FROM store GROUP BY 2
 UNION ALL SELECT 'params_hash', params_hash, count(*), count(DISTINCT factor_name) FROM store GROUP BY 2 UNION ALL SELECT 'version', CAST(version AS VARCHAR), count(*), count(DISTINCT factor_name) FROM store GROUP BY 2""")
def _(t):
    return ag.facets(t.store, ["as_of_time", "params_hash", "version"])


@query("ag18_combinations", """SELECT substr(sha1(params_hash || '|' || CAST(version AS VARCHAR)), 1, 16) AS combo, count(*) AS runs, array_to_string(list_sort(list(DISTINCT factor_name)), ',') AS factors FROM store GROUP BY 1""")
def _(t):
    combo = F.substring(F.sha1(F.concat_ws("|", "params_hash", F.col("version").cast("string"))), 1, 16)
    return t.store.groupBy(combo.alias("combo")).agg(F.count(F.lit(1)).alias("runs"), F.array_join(F.array_sort(F.collect_set("factor_name")), ",").alias("factors"))


@query("ag19_inventory", """SELECT 'panel_l' AS dataset, CAST(year(trade_date) AS INTEGER) AS year, CAST(month(trade_date) AS INTEGER) AS month, count(*) AS row_count, min(trade_date) AS min_date, max(trade_date) AS max_date FROM panel_l GROUP BY 2, 3""")
def _(t):
    return ag.inventory(t.panel_l, "panel_l", "trade_date")


@query("ag20_volume_ratio", """SELECT symbol, max(trade_date) AS trade_date, arg_max_null(r, trade_date) AS volume_ratio FROM (SELECT symbol, trade_date, volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS r FROM panel_d) GROUP BY 1""", volume_ratio=6)
def _(t):
    return ag.volume_ratio(t.panel_d)


@query("ag21_pool_summary", "SELECT index_symbol, count(DISTINCT trade_date) AS snapshots, min(trade_date) AS min_date, max(trade_date) AS max_date, count(DISTINCT symbol) AS symbols FROM idx GROUP BY 1")
def _(t):
    days = t.idx.groupBy("index_symbol", "trade_date").agg(F.lit(1).alias("d")).groupBy("index_symbol").agg(
        F.count("d").alias("snapshots"), F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"))
    names = t.idx.groupBy("index_symbol", "symbol").agg(F.lit(1).alias("s")).groupBy("index_symbol").agg(F.count("s").alias("symbols"))
    return days.join(names, "index_symbol")


@query("ag22_benchmark_summary", """SELECT count(ret) AS days, min(trade_date) AS min_date, max(trade_date) AS max_date, count(ret) >= 20 AS ok FROM (SELECT trade_date, avg(close) AS ret FROM panel_d GROUP BY 1)""")
def _(t):
    return t.panel_d.groupBy("trade_date").agg(F.avg("close").alias("ret")).agg(
        F.count("ret").alias("days"), F.min("trade_date").alias("min_date"), F.max("trade_date").alias("max_date"), (F.count("ret") >= 20).alias("ok"))


@query("ag23_watchlist_groups", "SELECT n_nationkey AS group_id, n_name AS group_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS members FROM nation")
def _(t):
    n = t.raw("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("group_id")).agg(F.count(F.lit(1)).alias("m"))
    g = t.raw("nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name"))
    return g.join(n, "group_id", "left").select("group_id", "group_name", F.coalesce("m", F.lit(0)).alias("members"))


@query("ag24_top_analysts", """SELECT s_name AS analyst, min(rank_) AS first_rank FROM (SELECT s_name, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank_ FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1 ORDER BY 2 LIMIT 15""")
def _(t):
    # rank order is a sort key, so the first row per analyst is a min over that key
    order = F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber", "l_partkey")
    rows = t.raw("lineitem").select("l_suppkey", order.alias("o"))
    first = rows.groupBy("l_suppkey").agg(F.min("o").alias("first")).orderBy("first").limit(15)
    named = first.join(t.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_name").alias("analyst"), "first")
    # exact position: rows at or before each of the 15 keys
    marks = F.broadcast(named)  # 15 rows
    lowest = named.agg(F.max("first.p")).scalar()  # rows below the last key's price are never compared
    pairs = rows.where(F.col("o.p") <= lowest).join(marks, F.col("o") <= F.col("first"))
    return pairs.groupBy("analyst").agg(F.count(F.lit(1)).cast("long").alias("first_rank"))


@query("ag24_quarter_periods", """SELECT CAST(q AS DATE) AS period FROM (SELECT unnest(generate_series(date_trunc('quarter', (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 21 MONTH, date_trunc('quarter', (SELECT max(l_shipdate) FROM lineitem)), INTERVAL 3 MONTH)) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS q)""")
def _(t):
    last = t.raw("lineitem").agg(F.trunc(F.to_date(F.max("l_shipdate")), "quarter").alias("q"))
    months = F.sequence(F.add_months("q", -21), F.col("q"), F.expr("interval 3 months"))
    return last.select(F.explode(months).alias("m")).select(F.date_sub(F.add_months("m", 3), 1).alias("period"))
