"""Indicator, vendor-feed and text queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors import indicators as ind
from quantspark.functions import symbols as sy
from quantspark.functions import text as tx
from quantspark.operators.joins import newest
from quantspark.operators.panel import with_factors
from quantspark.plans.oracle import factor_sql
from quantspark.plans.q_evaluate import long_sql
from quantspark.plans.registry import factor, query
from quantspark.sources import store as fs
from quantspark.sources import vendor as vn

_IDS = {"price_to_ma250w": "02", "ma250_weekly": "02", "return_5d": "06", "return_20d": "06", "return_60d": "06", "ma5_slope": "07",
        "volatility_20d": "08", "avg_amplitude": "09", "avg_amount_20d": "10", "ma5": "11", "ma10": "11", "ma20": "11", "rsi_14": "11"}
for _n, _node in ind.BAR_INDICATORS.items():
    factor(f"id{_IDS[_n]}_{_n}", _node, "panel_l" if _IDS[_n] == "02" else "panel_d", digits=4)

LASTFIN = "(SELECT * FROM fin_full QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) = 1)"


@query("id01_valuation", f"""SELECT b.symbol, b.trade_date, coalesce(pe_ttm, total_mv / nullif(net_profit, 0)) AS pe_ttm, coalesce(pb, total_mv / nullif(total_equity, 0)) AS pb, total_mv / nullif(revenue, 0) AS ps_ttm
 FROM basic b LEFT JOIN {LASTFIN} f USING (symbol)""", pe_ttm=3, pb=3, ps_ttm=3)
def _(t):
    last = newest(t.fin_full, ["symbol"], F.col("report_date"), ["net_profit", "total_equity", "revenue"])
    return ind.valuation(t.basic, last)


@query("id03_dividend_yield", "SELECT symbol, arg_max_null(value, trade_date) AS dividend_yield FROM latest WHERE factor_name = 'close_level' GROUP BY 1", dividend_yield=6)
def _(t):
    return fs.load(t.store, ["close_level"]).groupBy("symbol").agg(F.max_by("value", "trade_date").alias("dividend_yield"))


@query("id04_growth", "SELECT symbol, report_date, revenue_yoy AS revenue_growth, profit_yoy AS profit_growth FROM fin_full", revenue_growth=6, profit_growth=6)
def _(t):
    return t.fin_full.select("symbol", "report_date", F.col("revenue_yoy").alias("revenue_growth"), F.col("profit_yoy").alias("profit_growth"))


@query("id05_quality", "SELECT symbol, report_date, roe * 100 AS roe, 100 * total_liability / total_assets AS debt_ratio, gross_margin FROM fin_full", roe=5, debt_ratio=5, gross_margin=5)
def _(t):
    return ind.quality(t.fin_full)


@query("id10_turnover_float", "SELECT symbol, trade_date, turnover_rate, circ_mv AS free_float_mv FROM basic_d", turnover_rate=6, free_float_mv=3)
def _(t):
    return t.basic_d.select("symbol", "trade_date", "turnover_rate", F.col("circ_mv").alias("free_float_mv"))


@query("id12_theme", """SELECT p_partkey AS symbol, p_size / 50.0 AS business_purity, CASE WHEN p_size % 4 = 0 THEN 1.0 WHEN p_size % 4 = 1 THEN 2.0 WHEN p_size % 4 = 2 THEN 3.0 END AS chain_position FROM part""", business_purity=6, chain_position=1)
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ["Upstream", "MIDSTREAM", "downstream", "other"])), (F.col("p_size") % 4 + 1).cast("int"))
    return t.raw("part").select(F.col("p_partkey").alias("symbol"), (F.col("p_size") / 50.0).alias("business_purity"), ind.chain_position(kind).alias("chain_position"))


@query("id13_batch_indicators", long_sql(ind.BAR_INDICATORS, "panel_d").replace("+ 1e-9, 6)", "+ 1e-9, 4)"), value=4)
def _(t):
    return fs.batch_values(t.panel_d, ind.BAR_INDICATORS, section_rows=1)


@query("id14_indicator_lookup", """SELECT symbol, factor_name, arg_max_null(value, trade_date) AS value, max(trade_date) AS trade_date FROM latest WHERE trade_date <= DATE '2024-01-20' GROUP BY 1, 2""", value=6)
def _(t):
    rows = fs.load(t.store, None, None, date(2024, 1, 20))
    return rows.groupBy("symbol", "factor_name").agg(F.max_by("value", "trade_date").alias("value"), F.max("trade_date").alias("trade_date"))


_MA = factor_sql("panel_l", {"ratio": ind.BAR_INDICATORS["price_to_ma250w"]})


@query("id15_deep_value", f"""WITH m AS (SELECT symbol, arg_max_null(ratio, trade_date) AS ratio FROM ({_MA}) GROUP BY 1), b AS (SELECT symbol, arg_max_null(pe_ttm, trade_date) * 300 AS pe FROM basic GROUP BY 1),
 d AS (SELECT symbol, 1 + symbol % 9 AS dividend_yield FROM dim_l) SELECT m.symbol, ratio, pe, dividend_yield, least((1 - ratio) / 0.5, 1) * 50 + least(dividend_yield / 15.0, 1) * 50 AS score FROM m JOIN b USING (symbol) JOIN d USING (symbol)
 WHERE ratio < 1.5 AND pe > 0 AND pe < 1e9 AND dividend_yield > 3.5 ORDER BY round(score, 4) DESC, symbol LIMIT 10""", ratio=6, pe=3, score=3)
def _(t):
    bars = with_factors(t.panel_l, {"ratio": ind.BAR_INDICATORS["price_to_ma250w"]}, section_rows=1).withColumn("ratio", F.round(F.col("ratio") + 1e-9, 6))
    m = bars.groupBy("symbol").agg(F.max_by("ratio", "trade_date").alias("ratio"))
    b = t.basic.groupBy("symbol").agg((F.max_by("pe_ttm", "trade_date") * 300).alias("pe"))
    d = t.dim_l.select("symbol", (F.col("symbol") % 9 + 1).alias("dividend_yield"))
    return ind.deep_value(m.join(b, "symbol").join(d, "symbol"), 10, 1.5, 1e9)


@query("id16_rebalance_dates", "SELECT CAST(year(trade_date) AS INTEGER) AS year, min(trade_date) AS trade_date FROM panel_l WHERE month(trade_date) = 5 GROUP BY 1")
def _(t):
    return ind.annual_rebalance_dates(t.panel_l)


@query("id17_basket_returns", """WITH y AS (SELECT min(trade_date) AS entry_date FROM panel_l WHERE month(trade_date) = 5 GROUP BY year(trade_date)), p AS (SELECT entry_date, lead(entry_date) OVER (ORDER BY entry_date) AS exit_date FROM y),
 k AS (SELECT symbol, entry_date, exit_date FROM dim_l CROSS JOIN p WHERE exit_date IS NOT NULL), d AS (SELECT symbol, report_date AS ex_date, total_assets / 1e7 AS dividend FROM fin),
 e AS (SELECT k.*, q.close AS ep FROM k ASOF LEFT JOIN panel_l q ON k.symbol = q.symbol AND k.entry_date >= q.trade_date), x AS (SELECT e.*, q.close AS xp FROM e ASOF LEFT JOIN panel_l q ON e.symbol = q.symbol AND e.exit_date >= q.trade_date),
 g AS (SELECT x.*, (SELECT coalesce(sum(dividend), 0) FROM d WHERE d.symbol = x.symbol AND d.ex_date > x.entry_date AND d.ex_date <= x.exit_date) AS paid FROM x WHERE ep > 0 AND xp IS NOT NULL),
 r AS (SELECT entry_date, exit_date, count(*) AS names, avg((xp + paid) / ep - 1) AS ret FROM g GROUP BY 1, 2) SELECT *, product(1 + ret) OVER (ORDER BY entry_date) AS nav FROM r""", ret=6, nav=4)
def _(t):
    w = Window.partitionBy(F.lit(0)).orderBy("entry_date")  # one row per year
    spans = ind.annual_rebalance_dates(t.panel_l).select(F.col("trade_date").alias("entry_date")).withColumn("exit_date", F.lead("entry_date").over(w)).where("exit_date is not null")
    baskets = ind.whole_market_baskets(t.panel_l, spans)
    div = t.fin.select("symbol", F.col("report_date").alias("ex_date"), (F.col("total_assets") / 1e7).alias("dividend"))
    return ind.basket_returns(baskets, t.panel_l, div)


# --- vendor -----------------------------------------------------------------------

MONEY = """(SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date, sum(value) FILTER (event_type = 'click') AS buy_sm_amount, sum(value) FILTER (event_type = 'view') AS buy_lg_amount,
 sum(value) FILTER (event_type = 'error') AS sell_sm_amount, sum(value) FILTER (event_type = 'signup') AS sell_lg_amount, max(event_id) AS ingested FROM events GROUP BY 1, 2)"""


def money(t):
    s = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    return t.raw("events").groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date")).agg(
        s("click").alias("buy_sm_amount"), s("view").alias("buy_lg_amount"), s("error").alias("sell_sm_amount"), s("signup").alias("sell_lg_amount"), F.max("event_id").alias("ingested"))


NET = "coalesce(buy_sm_amount, 0) + coalesce(buy_lg_amount, 0) - coalesce(sell_sm_amount, 0) - coalesce(sell_lg_amount, 0)"


@query("vn01_normal_common", """SELECT event_id, CAST(user_id AS VARCHAR) AS symbol, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS trade_date, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS price, props, 'vendor' AS source, 'ticks' AS source_api FROM events""", price=6)
def _(t):
    raw = t.raw("events").select(
        "event_id", F.col("user_id").cast("string").alias("code"), F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.date_format("ts", "yyyyMMdd")).alias("trade_date"),
        F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("price"), "props")
    return vn.normal_common(raw, ["trade_date"], "code", "ticks").select("event_id", "symbol", "trade_date", "price", "props", "source", "source_api")


@query("vn02_moneyflow", f"SELECT symbol, trade_date, {NET} AS net_mf_amount FROM {MONEY}", net_mf_amount=4)
def _(t):
    return vn.derive_moneyflow(money(t)).select("symbol", "trade_date", "net_mf_amount")


@query("vn03_north_south", """SELECT trade_date, sum(amount) AS north_money_million, sum(volume) AS south_money_million FROM panel_d GROUP BY 1""", north_money_million=2)
def _(t):
    raw = t.panel_d.groupBy(F.date_format("trade_date", "yyyyMMdd").alias("trade_date")).agg(F.sum("amount").alias("north_money"), F.sum("volume").alias("south_money"))
    return vn.normal_north_south(raw).select("trade_date", "north_money_million", "south_money_million")


_CODE = "CASE WHEN c_custkey % 3 = 0 THEN '6' WHEN c_custkey % 3 = 1 THEN '0' ELSE '8' END || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')"
_SUF = "CASE WHEN c_custkey % 3 = 0 THEN '.SH' WHEN c_custkey % 3 = 1 THEN '.SZ' ELSE '.BJ' END"


def codes(t):
    lead = F.when(F.col("c_custkey") % 3 == 0, "6").when(F.col("c_custkey") % 3 == 1, "0").otherwise("8")
    return t.raw("customer").withColumn("ts_code", F.concat(lead, F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")))


@query("vn03_holdings", f"""SELECT {_CODE} || {_SUF} AS symbol, DATE '2024-01-02' AS trade_date, c_acctbal AS holding_volume, c_acctbal / 100 AS holding_ratio, 'SH' AS exchange FROM customer""", holding_volume=3, holding_ratio=6)
def _(t):
    raw = codes(t).select("ts_code", F.lit("20240102").alias("trade_date"), F.col("c_acctbal").cast("string").alias("vol"), (F.col("c_acctbal") / 100).alias("ratio"), F.lit("sh").alias("exchange"))
    return vn.normal_holdings(raw)


@query("vn03_fund_portfolio", f"""SELECT c_name AS fund_code, {_CODE} || {_SUF} AS symbol, DATE '2023-12-31' AS end_date, CAST(NULL AS DATE) AS ann_date, c_acctbal AS mkv FROM customer""", mkv=3)
def _(t):
    raw = codes(t).select(F.col("c_name").alias("fund_code"), F.col("ts_code").alias("symbol"), F.lit("20231231").alias("period"), F.col("c_acctbal").alias("mkv"))
    return vn.normalise("fund_portfolio", raw)


@query("vn04_statement", "SELECT symbol, report_date AS end_date, coalesce(ann_date, report_date) AS f_ann_date, revenue AS total_revenue, net_profit AS net_income, total_assets AS assets, total_liability AS liabilities FROM fin", total_revenue=1, net_income=1, assets=1, liabilities=1)
def _(t):
    return vn.normal_statement(t.fin)


@query("vn05_analyst_report", "SELECT s_name AS org, CAST(s_suppkey AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS rating FROM supplier")
def _(t):
    return vn.normal_analyst(t.raw("supplier").select(F.col("s_name").alias("org_name"), F.col("s_suppkey").cast("string").alias("author")), "report")


@query("vn05_analyst_rank", "SELECT s_suppkey AS analyst_id, s_acctbal AS score FROM supplier", score=3)
def _(t):
    return vn.normal_analyst(t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("index")), "rank")


@query("vn06_auction", "SELECT symbol, datetime, price, volume, price * volume / nullif(volume, 0) AS vwap FROM ticks WHERE price > 0", price=4, vwap=4)
def _(t):
    raw = t.ticks.select("symbol", "datetime", "price", "volume", (F.col("price") * F.col("volume")).alias("amount"))
    return vn.normal_auction(raw).select("symbol", "datetime", "price", "volume", "vwap")


@query("vn06_block_members", "SELECT DISTINCT industry AS block_code, CAST(symbol AS VARCHAR) AS symbol FROM idx JOIN dim_l USING (symbol)")
def _(t):
    raw = t.idx.join(t.dim_l, "symbol").select(F.col("industry").alias("ths_code"), F.col("symbol").cast("string").alias("con_code"))
    return vn.normalise("block_member", raw)


@query("vn07_text", """SELECT title, '' AS source_url, published, CASE WHEN length(title) < 8 THEN 'short_title,no_url' ELSE 'no_url' END AS quality_flags, substr(sha1(title), 1, 16) AS title_hash, 'news' AS source_api
 FROM (SELECT trim(split_part(text, '.', 1), ' ') AS title, published_at AS published FROM posts) WHERE title <> ''""")
def _(t):
    raw = t.posts.select(F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("published_at").alias("date"))
    return vn.normal_text(raw, ["publish_time", "date"], "news")


@query("vn08_concepts", "SELECT symbol, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS concepts FROM (SELECT user_id AS symbol, event_type FROM events) GROUP BY 1")
def _(t):
    e = t.raw("events")
    index = e.select(F.sha1("event_type").alias("code"), F.col("event_type").alias("name")).distinct()
    return vn.concept_names(index, e.select(F.sha1("event_type").alias("code"), F.col("user_id").alias("symbol")))


@query("vn09_direct_factor", f"SELECT symbol, trade_date, 'moneyflow_net_mf_amount' AS factor_name, {NET} AS value FROM {MONEY}", value=4)
def _(t):
    return vn.direct_factor(vn.derive_moneyflow(money(t)), "moneyflow_net_mf_amount")


@query("vn10_auction_gap", "SELECT symbol, trade_date, (close - open) / nullif(open, 0) AS value FROM panel_d", value=6)
def _(t):
    return vn.auction_gap(t.panel_d.withColumn("price", F.col("close")))


@query("vn11_batch_vendor_factors", f"""SELECT symbol, trade_date, 'moneyflow_net_mf_amount' AS factor_name, {NET} AS value FROM {MONEY} UNION ALL
 SELECT symbol, trade_date, 'auction_amount', arg_max(price * volume, (datetime, event_id)) FROM (SELECT CAST(hash_ AS BIGINT) AS symbol, * EXCLUDE (symbol) FROM (SELECT *, length(symbol) AS hash_ FROM ticks)) GROUP BY 1, 2""", value=4)
def _(t):
    a = vn.direct_factor(vn.derive_moneyflow(money(t)), "moneyflow_net_mf_amount")
    raw = t.ticks.select(F.length("symbol").cast("long").alias("symbol"), "datetime", (F.col("price") * F.col("volume")).alias("amount"), F.struct("datetime", "event_id").alias("ingested"))
    return a.unionByName(vn.direct_factor(raw, "auction_amount"))


@query("vn12_union_index", "SELECT DISTINCT 'UNION' AS index_symbol, trade_date, symbol FROM idx")
def _(t):
    return vn.union_index(t.idx, ["IDX", "OTHER"], "UNION")


@query("vn14_merge_history", """WITH m AS (SELECT symbol, trade_date, CASE WHEN day(trade_date) > 20 THEN high ELSE close END AS close FROM panel_d) SELECT symbol, trade_date, close, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS ret_1d FROM m""", close=6, ret_1d=6)
def _(t):
    new = t.panel_d.where("dayofmonth(trade_date) > 20").select("symbol", "trade_date", F.col("high").alias("close"))
    return vn.merge_history(t.panel_d.select("symbol", "trade_date", "close"), new)


@query("vn15_symbols", f"""SELECT c_custkey, {_CODE} || {_SUF} AS listed, 'SH' || {_CODE} AS raw, {_CODE} || '.SH' AS normal, {_CODE} || '.XSHG' AS vendor, CASE WHEN c_custkey % 3 = 0 THEN 'SH' WHEN c_custkey % 3 = 1 THEN 'SZ' ELSE 'BJ' END AS market FROM customer""")
def _(t):
    c = codes(t).withColumn("raw", F.concat(F.lit("SH"), "ts_code"))
    return c.select("c_custkey", sy.listed_symbol(F.col("ts_code")).alias("listed"), "raw", sy.normal_symbol(F.concat(F.lit(" sh"), "ts_code")).alias("normal"),
                    sy.vendor_symbol(F.col("raw")).alias("vendor"), sy.market_of(F.col("ts_code")).alias("market"))


# --- text -------------------------------------------------------------------------

UP, DOWN = ["the", "tion", "en"], ["er", "ou"]
_cnt = lambda term: f"(length(text) - length(replace(text, '{term}', ''))) / {float(len(term))}"
_up, _down = " + ".join(map(_cnt, UP)), " + ".join(map(_cnt, DOWN))


@query("tx01_lexicon", f"""SELECT doc_id, s AS score, CASE WHEN s >= 0.6 THEN 'bullish' WHEN s <= 0.4 THEN 'bearish' WHEN s IS NOT NULL THEN 'neutral' END AS label FROM (SELECT doc_id, ({_up}) / nullif(({_up}) + ({_down}), 0) AS s FROM posts)""", score=6)
def _(t):
    s = tx.lexicon_score(F.col("text"), UP, DOWN)
    return t.posts.select("doc_id", s.alias("score"), tx.label_of(s).alias("label"))


_CAND = ["over", "ation", "zzzz", "eau", "und"]


@query("tx02_keywords", f"""SELECT doc_id, array_to_string(list_concat(list_filter({_CAND!r}, lambda k: contains(text, k)), list_distinct(CASE WHEN list_contains({_CAND!r}, lang) AND contains(text, lang) THEN [] ELSE [lang] END))[1:12], ',') AS keywords FROM posts""")
def _(t):
    return t.posts.select("doc_id", F.array_join(tx.keywords(F.col("text"), F.array("lang"), _CAND, 12), ",").alias("keywords"))


@query("tx03_assembled_text", """SELECT conv_id, turn, concat_ws(' ', nullif(role, ''), nullif(text, ''), nullif(replace(text, ' ', '_'), ''), CAST(turn AS VARCHAR)) AS body FROM conversations""")
def _(t):
    comment = lambda c: F.struct(c.alias("content"))
    c = t.raw("conversations").withColumn("c", F.to_json(F.array(comment(F.replace("text", F.lit(" "), F.lit("_"))), comment(F.col("turn").cast("string")))))
    return c.select("conv_id", "turn", tx.assembled_text(F.col("role"), F.col("text"), F.col("c")).alias("body"))


_STRIP = "regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
for _k, _v in tx.ENTITIES.items():
    _STRIP = f"replace({_STRIP}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query("tx04_strip_html", f"SELECT page_id, trim(regexp_replace({_STRIP}, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS body FROM pages")
def _(t):
    return t.raw("pages").select("page_id", tx.strip_html(F.col("html")).alias("body"))


@query("tx05_merge_posts", """SELECT 'tid:' || CAST(doc_id AS VARCHAR) AS key, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END AS source, 0 AS first_seen FROM posts""")
def _(t):
    key = tx.post_key(F.col("doc_id"), F.col("text"), F.col("published_at")).alias("key")
    old = t.posts.select(key, "source")
    new = t.posts.where("doc_id % 3 = 0").select(key, F.upper("source").alias("source"))
    return tx.merge_posts([old, new])


@query("tx06_activity_day", """SELECT coalesce(CASE WHEN doc_id % 4 = 0 THEN published_at + 2 END, published_at) AS day, count(*) AS posts FROM posts GROUP BY 1""")
def _(t):
    reply = F.when(F.col("doc_id") % 4 == 0, F.date_add("published_at", 2))
    return t.posts.groupBy(tx.activity_day(reply, F.col("published_at")).alias("day")).agg(F.count(F.lit(1)).alias("posts"))


_SRC = {"web": ["web_old", "crawl"], "forum": ["board"]}


@query("tx07_sources", """SELECT doc_id, CASE WHEN lower(trim(s)) IN ('web', 'web_old', 'crawl') THEN 'web' WHEN lower(trim(s)) IN ('forum', 'board') THEN 'forum' ELSE lower(trim(s)) END AS source FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' Web_Old ' WHEN doc_id % 3 = 1 THEN 'Board' ELSE source END AS s FROM posts)""")
def _(t):
    s = F.when(F.col("doc_id") % 3 == 0, " Web_Old ").when(F.col("doc_id") % 3 == 1, "Board").otherwise(F.col("source"))
    return t.posts.select("doc_id", tx.canonical_source(s, _SRC).alias("source"))


@query("tx08_upsert_posts", """SELECT lower(source) AS source, doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE reply_count END AS reply_count, like_count FROM posts""")
def _(t):
    old = t.posts.select("source", "doc_id", "reply_count", "like_count")
    new = old.where("doc_id % 5 = 0").withColumn("reply_count", F.lit(-1).cast("long"))
    return tx.upsert_posts(old, new, _SRC)


@query("tx09_ranked_posts", "SELECT doc_id, reply_count, like_count, published_at FROM posts WHERE lang = 'en' ORDER BY reply_count DESC, like_count DESC, published_at DESC, doc_id LIMIT 50")
def _(t):
    rows = t.posts.withColumn("symbols_json", F.to_json(F.array("lang", "source")))
    return tx.ranked_posts(rows, "en", 50).select("doc_id", "reply_count", "like_count", "published_at")


@query("tx10_aliases", f"""SELECT symbol, unnest(list_distinct(list_filter([symbol, code, 'SH' || code, name, name || ' 集团', trim(name || ' ')], lambda a: a IS NOT NULL AND a <> ''))) AS alias FROM (SELECT {_CODE} || '.SH' AS symbol, {_CODE} AS code, c_name AS name FROM customer)""")
def _(t):
    c = codes(t).select(F.concat("ts_code", F.lit(".SH")).alias("symbol"), F.col("c_name").alias("name"), F.concat("c_name", F.lit(" 集团")).alias("company_name"))
    return tx.aliases(c)


@query("tx11_normal_posts", """SELECT CAST(doc_id AS VARCHAR) AS post_id, 'forum' AS source, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\$([^$]+)\\$', '\\1', 'g'), ' ') AS text, lang AS author, published_at, reply_count, CAST(0 AS BIGINT) AS like_count
 FROM posts WHERE trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\\$([^$]+)\\$', '\\1', 'g'), ' ') <> ''""")
def _(t):
    m = {"id": ["tid", "doc_id"], "text": ["content", "text"], "author": ["lang"], "time": ["published_at"], "replies": ["reply_count"], "likes": ["absent"]}
    return tx.normal_posts(t.posts, m, "forum")
