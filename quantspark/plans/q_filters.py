"""Filter, screen and search queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.bars import CLOSE, OPEN, VOLUME
from quantspark.functions import expr as x
from quantspark.operators import filters as pf
from quantspark.operators.joins import newest
from quantspark.operators.panel import with_factors
from quantspark.plans.registry import query
from quantspark.sources.store import latest

DAY = date(2024, 1, 10)

#: master data of the dense panel with listing dates and a display name
STOCKS = """SELECT c_custkey - 1 AS symbol, c_name AS name, c_mktsegment AS industry, r_name AS sector,
 CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS is_st,
 CAST(DATE '2023-12-20' + CAST(c_custkey % 40 AS INT) AS DATE) AS list_date,
 CASE WHEN c_custkey % 11 = 0 THEN CAST(DATE '2024-01-05' + CAST(c_custkey % 30 AS INT) AS DATE) END AS delist_date,
 CASE WHEN c_custkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS exchange
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def stocks(t):
    key = F.col("c_custkey")
    dims = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    day = lambda text, n: F.date_add(F.lit(text).cast("date"), (key % n).cast("int"))
    return t.raw("customer").join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select(
        (key - 1).alias("symbol"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"),
        F.col("r_name").alias("sector"), F.when(key % 17 == 0, 1).otherwise(0).alias("is_st"),
        day("2023-12-20", 40).alias("list_date"), F.when(key % 11 == 0, day("2024-01-05", 30)).alias("delist_date"),
        F.when(key % 2 == 0, "SH").otherwise("SZ").alias("exchange"))


@query("pf01_filter_builder", """SELECT symbol, trade_date, close, volume FROM panel_d WHERE close > 20 AND volume BETWEEN 50 AND 200
 AND trade_date <> DATE '2024-01-03' AND contains(CAST(symbol AS VARCHAR), '1') AND open IS NOT NULL""", close=6)
def _(t):
    rules = [{"column": "close", "op": ">", "value": 20}, {"column": "volume", "op": "between", "value": (50, 200)},
             {"column": "trade_date", "op": "!=", "value": date(2024, 1, 3)},
             {"column": "symbol", "op": "contains", "value": "1"}, {"column": "open", "op": "not null"},
             {"column": "high", "op": ">", "value": ""}]
    return pf.apply_filters(t.panel_d, rules).select("symbol", "trade_date", "close", "volume")


@query("pf02_quick_search", """SELECT symbol, trade_date, version, value FROM store WHERE symbol IN (1, 2, 14)
 AND trade_date >= DATE '2024-01-05' AND factor_name = 'close_level'""", value=6)
def _(t):
    rules = pf.quick_filters("store", {"symbols": "1,2，14", "start": date(2024, 1, 5), "factor_name": "close_level"}, t.store.columns)
    return pf.apply_filters(t.store, rules).select("symbol", "trade_date", "version", "value")


@query("pf03_search", """SELECT symbol, trade_date, close FROM panel_d WHERE close >= 30 ORDER BY close DESC, symbol, trade_date LIMIT 50 OFFSET 50""", close=6)
def _(t):
    return pf.search_table(t.panel_d, [{"column": "close", "op": ">=", "value": 30}], ["symbol", "trade_date", "close"],
                           [F.desc("close"), "symbol", "trade_date"], 2, 50)


@query("pf04_preview", """SELECT symbol, trade_date, close, CAST(101 AS BIGINT) AS total FROM panel_d ORDER BY trade_date, symbol LIMIT 50 OFFSET 50""", close=6)
def _(t):
    rows, total = pf.preview(t.panel_d.select("symbol", "trade_date", "close"), 2, 50, ["trade_date", "symbol"])
    return rows.join(F.broadcast(total))  # one row


@query("pf04_preview_exact", """SELECT symbol, trade_date, close, (SELECT count(*) FROM panel_d) AS total FROM panel_d ORDER BY trade_date, symbol LIMIT 50 OFFSET 50""", close=6)
def _(t):
    rows, total = pf.preview(t.panel_d.select("symbol", "trade_date", "close"), 2, 50, ["trade_date", "symbol"], include_total=True)
    return rows.join(F.broadcast(total))  # one row


@query("pf05_distinct_values", "SELECT DISTINCT p_brand AS value FROM part WHERE contains(p_brand, '3') ORDER BY 1 LIMIT 100")
def _(t):
    return pf.distinct_values(t.raw("part"), "p_brand", "3", limit=100)


@query("pf06_read_only_sql", "SELECT symbol, count(*) AS bars FROM panel_d GROUP BY symbol ORDER BY bars DESC, symbol LIMIT 25")
def _(t):
    t.panel_d.createOrReplaceTempView("quantspark_bars")
    return pf.read_only_sql(t.spark, "SELECT symbol, count(*) AS bars FROM quantspark_bars GROUP BY symbol ORDER BY bars DESC, symbol", 25)


_LATEST_BASIC = """(SELECT symbol, max_by(total_mv, trade_date) AS total_mv, arg_max_null(pe_ttm, trade_date) AS pe_ttm FROM basic_d GROUP BY symbol)"""


def latest_basic(t):
    return newest(t.basic_d, ["symbol"], F.col("trade_date"), ["total_mv", "pe_ttm"])


@query("pf07_screen", f"""WITH u AS (SELECT s.symbol, s.industry, b.total_mv, b.pe_ttm FROM ({STOCKS}) s JOIN {_LATEST_BASIC} b USING (symbol)
 WHERE is_st = 0 AND total_mv >= 1000 AND (pe_ttm IS NULL OR pe_ttm <= 400))
 SELECT *, (SELECT count(*) FROM u) AS total FROM u ORDER BY total_mv DESC NULLS LAST, symbol LIMIT 30""", total_mv=3, pe_ttm=4)
def _(t):
    df = stocks(t).join(latest_basic(t), "symbol").select("symbol", "industry", "is_st", "total_mv", "pe_ttm")
    top, total = pf.screen_fundamentals(df, exclude_st=True, min_mv=1000, max_pe=400, limit=30)
    return top.drop("is_st").withColumn("total", total.scalar())


@query("pf08_indicator_screen", """SELECT * FROM (SELECT symbol, max(value) FILTER (factor_name = 'close_level') AS close_level,
 max(value) FILTER (factor_name = 'volume_level') AS volume_level FROM latest WHERE trade_date = DATE '2024-01-10' GROUP BY symbol)
 WHERE close_level >= 20 AND volume_level < 200 ORDER BY volume_level DESC NULLS LAST, symbol LIMIT 50""", close_level=6, volume_level=6)
def _(t):
    return pf.screen_indicators(latest(t.store), [{"name": "close_level", "op": ">=", "value": 20}, {"name": "volume_level", "op": "<", "value": 200}],
                                DAY, "volume_level", limit=50)


@query("pf09_expression_screen", """SELECT symbol FROM (SELECT symbol, trade_date, close > open AND volume > avg(volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING) AS hit
 FROM panel_d) WHERE hit AND trade_date = DATE '2024-01-10' ORDER BY symbol""")
def _(t):
    out = with_factors(t.panel_d, {"hit": (CLOSE > OPEN) & (VOLUME > x.mean(VOLUME, 5, 1))})
    return out.where((F.col("trade_date") == DAY) & F.col("hit")).select("symbol").orderBy("symbol")


@query("pf10_stock_search", f"""SELECT symbol, name, industry FROM ({STOCKS}) WHERE (CAST(symbol AS VARCHAR) LIKE '%1%' OR name LIKE '%1%') AND is_st = 0
 AND symbol IN (SELECT symbol FROM idx) ORDER BY symbol LIMIT 20 OFFSET 20""")
def _(t):
    return pf.search_stocks(stocks(t), "1", None, 0, t.idx.select("symbol").distinct(), 2, 20).select("symbol", "name", "industry")


@query("pf11_theme_filter", f"""WITH k AS (SELECT * FROM ({STOCKS}) WHERE NOT contains(lower(concat_ws(' ', industry, sector)), 'africa')),
 m AS (SELECT * FROM k WHERE contains(lower(concat_ws(' ', industry, sector)), 'auto') OR contains(lower(concat_ws(' ', industry, sector)), 'machin'))
 SELECT symbol, industry, sector FROM m WHERE (SELECT count(*) FROM m) >= 10 UNION ALL SELECT symbol, industry, sector FROM k WHERE (SELECT count(*) FROM m) < 10""")
def _(t):
    return pf.theme_filter(stocks(t), ["auto", "machin"], ["africa"], 10).select("symbol", "industry", "sector")


@query("pf12_top_n", """SELECT symbol, trade_date, close FROM panel_d WHERE trade_date = (SELECT max(trade_date) FROM panel_d WHERE close IS NOT NULL) AND close IS NOT NULL
 ORDER BY close DESC, symbol LIMIT 20""", close=6)
def _(t):
    return pf.extreme_n(t.panel_d.select("symbol", "trade_date", "close"), "close")


@query("pf13_smallest_caps", """WITH g AS (SELECT s.symbol, d.trade_date FROM (SELECT DISTINCT symbol FROM basic_d) s, (SELECT DISTINCT trade_date FROM panel_d) d),
 k AS (SELECT g.symbol, g.trade_date, b.total_mv FROM g ASOF LEFT JOIN basic_d b ON g.symbol = b.symbol AND g.trade_date >= b.trade_date),
 c AS (SELECT symbol, trade_date FROM k WHERE total_mv IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY total_mv, symbol) <= 30)
 SELECT p.symbol, p.trade_date, p.close FROM panel_d p WHERE EXISTS (SELECT 1 FROM c WHERE c.symbol = p.symbol AND c.trade_date = p.trade_date) OR p.symbol IN (1, 2)""", close=6)
def _(t):
    days = t.panel_d.select("trade_date").distinct()
    picked = pf.smallest_caps(t.basic_d.select("symbol", "trade_date", "total_mv"), days, 30).withColumn("in_", F.lit(True))
    kept = t.panel_d.join(picked, ["symbol", "trade_date"], "left").where(F.col("in_") | F.col("symbol").isin(1, 2))
    return kept.select("symbol", "trade_date", "close")


@query("pf14_universe", f"""SELECT symbol FROM ({STOCKS}) WHERE list_date <= DATE '2024-01-20' AND exchange IN ('SH')
 AND (delist_date IS NULL OR delist_date > DATE '2024-01-20' OR delist_date >= DATE '2024-01-10')""")
def _(t):
    return pf.universe_as_of(stocks(t), date(2024, 1, 20), date(2024, 1, 10), ["SH"], True)


#: name-change intervals, derived from customer keys
CHANGES = """SELECT c_custkey - 1 AS symbol, CASE WHEN c_custkey % 3 = 0 THEN 'ST ' || c_name ELSE c_name END AS name,
 CAST(DATE '2024-01-01' + CAST(c_custkey % 20 AS INT) AS DATE) AS start_date,
 CASE WHEN c_custkey % 2 = 0 THEN CAST(DATE '2024-01-10' + CAST(c_custkey % 20 AS INT) AS DATE) END AS end_date FROM customer WHERE c_acctbal < 0"""


def changes(t):
    key = F.col("c_custkey")
    day = lambda text: F.date_add(F.lit(text).cast("date"), (key % 20).cast("int"))
    return t.raw("customer").where("c_acctbal < 0").select(
        (key - 1).alias("symbol"), F.when(key % 3 == 0, F.concat(F.lit("ST "), "c_name")).otherwise(F.col("c_name")).alias("name"),
        day("2024-01-01").alias("start_date"), F.when(key % 2 == 0, day("2024-01-10")).alias("end_date"))


@query("pf15_special_treatment", f"""WITH d AS (SELECT DISTINCT trade_date FROM panel_d), s AS ({STOCKS})
 SELECT trade_date, symbol FROM d, ({CHANGES}) c WHERE contains(name, 'ST') AND start_date <= trade_date AND (end_date IS NULL OR end_date >= trade_date)
 UNION SELECT trade_date, symbol FROM d, s WHERE is_st > 0 OR contains(name, 'ST')
 UNION SELECT trade_date, symbol FROM d, s WHERE delist_date <= trade_date""")
def _(t):
    return pf.special_treatment(stocks(t), changes(t), t.panel_d.select("trade_date").distinct())


@query("pf16_industries", f"SELECT industry, count(*) AS n FROM ({STOCKS}) GROUP BY industry ORDER BY n DESC, industry")
def _(t):
    return stocks(t).groupBy("industry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "industry")


@query("pf17_stock_detail", """WITH f AS (SELECT * FROM fin_full QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) = 1)
 SELECT d.symbol, d.name, f.report_date, f.total_liability / nullif(f.total_assets, 0) AS debt_ratio, f.net_profit / nullif(f.revenue, 0) AS net_margin,
 CASE WHEN abs(f.gross_margin) > 1.5 THEN f.gross_margin / 100 ELSE f.gross_margin END AS gross_margin, coalesce(f.total_equity, d.shares) AS equity
 FROM dim_l d LEFT JOIN f USING (symbol)""", debt_ratio=6, net_margin=6, gross_margin=6, equity=2)
def _(t):
    last = newest(t.fin_full, ["symbol"], F.col("report_date"))
    return t.dim_l.join(last, "symbol", "left").select(
        "symbol", "name", "report_date",
        (F.col("total_liability") / F.nullif("total_assets", F.lit(0.0))).alias("debt_ratio"),
        (F.col("net_profit") / F.nullif("revenue", F.lit(0.0))).alias("net_margin"),
        pf.percent_to_ratio(F.col("gross_margin")).alias("gross_margin"),
        F.coalesce("total_equity", "shares").alias("equity"))


@query("pf18_review", f"""WITH b AS (SELECT symbol, max_by(total_mv, trade_date) AS total_mv, max(trade_date) AS basic_date FROM basic WHERE trade_date <= DATE '2000-06-30' GROUP BY symbol),
 l AS (SELECT symbol, count(*) AS limit_rows, min(trade_date) AS first_limit FROM (SELECT symbol, trade_date FROM limits_l WHERE trade_date BETWEEN DATE '2000-05-01' AND DATE '2000-06-30'
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 10) GROUP BY symbol)
 SELECT d.symbol, b.total_mv, b.basic_date, coalesce(l.limit_rows, 0) AS limit_rows, l.first_limit FROM dim_l d LEFT JOIN b USING (symbol) LEFT JOIN l USING (symbol)""", total_mv=2)
def _(t):
    day, since = date(2000, 6, 30), date(2000, 5, 1)
    basic = t.basic.where(F.col("trade_date") <= day).groupBy("symbol").agg(
        F.max_by("total_mv", "trade_date").alias("total_mv"), F.max("trade_date").alias("basic_date"))
    w = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    last10 = t.limits_l.where(F.col("trade_date").between(since, day)).withColumn("rn", F.row_number().over(w)).where("rn <= 10")
    limits = last10.groupBy("symbol").agg(F.count(F.lit(1)).alias("limit_rows"), F.min("trade_date").alias("first_limit"))
    return t.dim_l.select("symbol").join(basic, "symbol", "left").join(limits, "symbol", "left").select(
        "symbol", "total_mv", "basic_date", F.coalesce("limit_rows", F.lit(0)).alias("limit_rows"), "first_limit")


@query("pf19_board", """SELECT factor_name, params_hash, count(*) AS n, avg(value) AS score FROM latest
 WHERE contains(lower(factor_name || ' ' || params_hash), 'level') GROUP BY 1, 2 ORDER BY score DESC NULLS LAST, factor_name LIMIT 20""", score=6)
def _(t):
    rows = latest(t.store).where(F.lower(F.concat_ws(" ", "factor_name", "params_hash")).contains("level"))
    board = rows.groupBy("factor_name", "params_hash").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("score"))
    return board.orderBy(F.desc_nulls_last("score"), "factor_name").limit(20)


@query("pf20_exclusion", """SELECT symbol, trade_date FROM panel_d p WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.symbol = p.symbol AND l.trade_date = p.trade_date
 AND ((factor_name = 'close_level' AND value > 60) OR (factor_name = 'volume_level' AND value <= 50)))""")
def _(t):
    return pf.exclude_by_factor(t.panel_d.select("symbol", "trade_date"), latest(t.store),
                                [{"name": "close_level", "op": ">", "value": 60}, {"name": "volume_level", "op": "<=", "value": 50}])


@query("pf21_last_reports", """SELECT symbol, report_date, revenue, net_profit FROM fin
 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) <= 4""", revenue=2, net_profit=2)
def _(t):
    w = Window.partitionBy("symbol").orderBy(F.desc("report_date"))
    return t.fin.withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("symbol", "report_date", "revenue", "net_profit")
