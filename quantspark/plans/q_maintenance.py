"""Sinks, quality, set operations and scalar function families."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.alpha101 import ALPHAS
from quantspark.factors.paper import PAPER_FACTORS
from quantspark.factors.research import RESEARCH_FACTORS
from quantspark.factors import smallcap as sc
from quantspark.functions.expr import field, mean
from quantspark.operators import aggregates as ag
from quantspark.operators import quality as dq
from quantspark.operators.batch import run_factors
from quantspark.operators.joins import newest
from quantspark.plans.q_evaluate import long_sql
from quantspark.plans.registry import HALF_NUDGE, query
from quantspark.sources import scan
from quantspark.sources import sinks as sk
from quantspark.sources import store as fs
from quantspark.sources.versioned import Dataset
from quantspark.streaming.jobs import work_folder


@query("sk01_upsert", """SELECT symbol, trade_date, CASE WHEN day(trade_date) >= 15 THEN close + 1 ELSE close END AS close FROM panel_d""", close=6)
def _(t):
    bars = Dataset(t.spark, work_folder(t.spark) + "/bars", ["symbol", "trade_date"])
    first = t.panel_d.select("symbol", "trade_date", "close")
    bars.upsert(first)
    bars.upsert(first.where("dayofmonth(trade_date) >= 15").withColumn("close", F.col("close") + 1))
    return bars.rows().select("symbol", "trade_date", "close")


@query("sk01_upsert_long", """SELECT symbol, trade_date, CASE WHEN year(trade_date) = 1997 AND symbol % 3 = 0 THEN close * 2 ELSE close END AS close,
 CASE WHEN year(trade_date) = 1997 AND symbol % 3 = 0 THEN 'late' END AS note FROM panel_l WHERE trade_date BETWEEN DATE '1996-11-15' AND DATE '1998-02-10'""", close=6)
def _(t):
    bars = Dataset(t.spark, work_folder(t.spark) + "/bars", ["symbol", "trade_date"])
    first = t.panel_l.select("symbol", "trade_date", "close")
    bars.upsert(first)
    late = first.where("year(trade_date) = 1997 and symbol % 3 = 0")
    bars.upsert(late.withColumns({"close": F.col("close") * 2, "note": F.lit("late")}))
    return bars.between(date(1996, 11, 15), date(1998, 2, 10)).select("symbol", "trade_date", "close", "note")


@query("sk04_migrate", """SELECT symbol, trade_date, CASE factor_name WHEN 'close_level' THEN 'price_level' ELSE factor_name END AS factor_name, version, value FROM store""", value=6)
def _(t):
    legacy = t.store.select("symbol", "trade_date", F.col("factor_name").alias("feature_name"), "version", "value")
    return sk.migrated(legacy, {"close_level": "price_level"})


@query("sk05_null_safe_patch", """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.industry, a.industry) AS industry, coalesce(b.shares, a.shares) AS shares FROM dim_d a
 FULL JOIN (SELECT symbol, CASE WHEN symbol % 2 = 0 THEN upper(industry) END AS industry, CASE WHEN symbol % 3 = 0 THEN shares + 1 END AS shares FROM dim_d WHERE symbol % 5 <> 0) b ON a.symbol = b.symbol""", shares=3)
def _(t):
    old = t.dim_d.select("symbol", "industry", "shares")
    new = t.dim_d.where("symbol % 5 <> 0").select(
        "symbol", F.when(F.col("symbol") % 2 == 0, F.upper("industry")).alias("industry"), F.when(F.col("symbol") % 3 == 0, F.col("shares") + 1).alias("shares"))
    return sk.patched(old, new, ["symbol"])


@query("sk05_master_refresh", """SELECT m.symbol, m.total_mv, f.report_date, total_mv / nullif(net_profit, 0) AS pe, total_mv / nullif(total_equity, 0) AS pb FROM (SELECT symbol, max_by(total_mv, trade_date) AS total_mv FROM basic GROUP BY 1) m
 LEFT JOIN (SELECT * FROM fin_full QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) = 1) f USING (symbol)""", total_mv=2, pe=5, pb=5)
def _(t):
    master = t.basic.groupBy("symbol").agg(F.max_by("total_mv", "trade_date").alias("total_mv"))
    return sk.refreshed_master(master, t.fin_full)


@query("vn13_index_upsert", """SELECT 'IDX' AS index_symbol, trade_date, symbol, CASE WHEN year(trade_date) = 2000 THEN weight * 2 ELSE weight END AS weight FROM idx""", weight=8)
def _(t):
    batch = t.idx.where("year(trade_date) = 2000").withColumn("weight", F.col("weight") * 2)
    return sk.upserted(t.idx, batch, ["index_symbol", "trade_date", "symbol"])


@query("dq02_compact_minutes", "SELECT symbol, minute_of_day, trade_date, arg_max(price, (datetime, event_id)) AS price FROM ticks GROUP BY 1, 2, 3", price=6)
def _(t):
    return dq.compact_minutes(t.ticks, ["symbol", "trade_date", "minute_of_day"], F.struct("datetime", "event_id")).select("symbol", "minute_of_day", "trade_date", "price")


@query("dq02_duplicate_report", "SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after FROM (SELECT count(*) AS n FROM ticks GROUP BY symbol, trade_date, minute_of_day)")
def _(t):
    return dq.duplicate_report(t.ticks, ["symbol", "trade_date", "minute_of_day"])


@query("dq03_without_bad_days", """WITH days AS (SELECT trade_date, count(*) AS row_count, count(DISTINCT symbol) AS symbols, count(*) FILTER (volume > 0) AS positive_rows, sum(volume) AS volume FROM ticks GROUP BY 1)
 SELECT event_id, symbol, trade_date FROM ticks WHERE trade_date NOT IN (SELECT trade_date FROM days WHERE row_count < 0.98 * (SELECT median(row_count) FROM days) OR symbols < 0.98 * (SELECT median(symbols) FROM days) OR positive_rows < 0.9 * row_count)""")
def _(t):
    return dq.without_days(t.ticks, ag.untypical_days(t.ticks, 0.98, 0.9)).select("event_id", "symbol", "trade_date")


@query("dq04_json_checks", """SELECT 'events' AS table_name, 'props' AS column_name, count(*) AS row_count, count(*) FILTER (NOT json_valid(props)) AS invalid, min(props) FILTER (NOT json_valid(props)) AS example FROM events
 UNION ALL SELECT 'customer', 'c_name', count(*), count(*) FILTER (NOT json_valid(c_name)), min(c_name) FILTER (NOT json_valid(c_name)) FROM customer""")
def _(t):
    return dq.json_report(t.raw("events"), "props", "events").unionByName(dq.json_report(t.raw("customer"), "c_name", "customer"))


@query("dq05_ranges", """SELECT 'lineitem' AS table_name, count(*) AS row_count, CAST(min(l_shipdate) AS DATE) AS min_date, CAST(max(l_shipdate) AS DATE) AS max_date FROM lineitem
 UNION ALL SELECT 'orders', count(*), CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE) FROM orders UNION ALL SELECT 'events', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""")
def _(t):
    return dq.range_report({"lineitem": (t.raw("lineitem"), "l_shipdate"), "orders": (t.raw("orders"), "o_orderdate"), "events": (t.raw("events"), "ts")})


_PAT = {"home_path": "/(home|root|Users)/", "url": "https?://", "mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}


@query("dq06_pattern_audit", " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) FILTER (regexp_matches(concat_ws(chr(10), text, source), '{p}')) AS hits FROM posts" for n, p in _PAT.items()))
def _(t):
    return dq.pattern_report(t.posts, ["text", "source"], _PAT)


@query("dq07_sample", """SELECT symbol, trade_date, close FROM panel_l WHERE symbol IN (SELECT symbol FROM idx WHERE trade_date = (SELECT max(trade_date) FROM idx) ORDER BY weight DESC, symbol LIMIT 12) AND trade_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'""", close=6)
def _(t):
    picked = dq.pick_symbols(t.idx, 12)
    return dq.consistent_sample({"bars": t.panel_l}, picked, date(1998, 1, 1), date(2000, 12, 31))["bars"].select("symbol", "trade_date", "close")


@query("dq08_orphans", """SELECT 'orders.customer' AS relation, count(*) AS orphan_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
 SELECT 'labels.documents', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    from quantspark.operators.joins import orphans

    return orphans(t.raw("orders"), t.raw("customer"), "o_custkey", "c_custkey", "orders.customer").unionByName(
        orphans(t.raw("labels"), t.raw("documents"), "doc_id", "doc_id", "labels.documents"))


# --- set operations -----------------------------------------------------------------


@query("so01_union", "SELECT symbol, trade_date, close, industry FROM (SELECT symbol, trade_date, close, NULL AS industry FROM panel_d UNION ALL SELECT symbol, NULL, NULL, industry FROM dim_d)", close=6)
def _(t):
    return t.panel_d.select("symbol", "trade_date", "close").unionByName(t.dim_d.select("symbol", "industry"), allowMissingColumns=True)


@query("so02_dedupe_keep_last", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1", value=6)
def _(t):
    return newest(t.raw("events").select("user_id", "ts", "event_id", "value", "event_type"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "value", "event_type")


@query("so02_dedupe_keep_first", "SELECT user_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY 1", value=6)
def _(t):
    return t.raw("events").groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"))


@query("so03_common_and_missing", """SELECT symbol, 'common' AS side FROM (SELECT symbol FROM panel_d INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT symbol, 'missing' FROM (SELECT c_custkey AS symbol FROM customer EXCEPT SELECT symbol FROM panel_d)""")
def _(t):
    a, b = t.panel_d.select("symbol"), t.raw("customer").select(F.col("c_custkey").alias("symbol"))
    common = a.intersect(b).withColumn("side", F.lit("common"))
    return common.unionByName(b.distinct().join(a.distinct(), "symbol", "left_anti").withColumn("side", F.lit("missing")))


@query("sf01_strings", """SELECT p_partkey, upper(p_name) AS up, trim(split_part(p_type, ' ', 1), ' ') AS head, replace(p_brand, '#', '-') AS swapped, p_brand LIKE 'Brand#1%' AS is_like, starts_with(p_type, 'S') AS starts, contains(p_name, 'e') AS has_e,
 regexp_extract(p_brand, '([0-9]+)', 1) AS digits, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS INTEGER) AS n_a FROM part""")
def _(t):
    return t.raw("part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.trim(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("head"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("swapped"),
        F.col("p_brand").like("Brand#1%").alias("is_like"), F.col("p_type").startswith("S").alias("starts"), F.col("p_name").contains("e").alias("has_e"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), (F.length("p_name") - F.length(F.replace("p_name", F.lit("a"), F.lit("")))).alias("n_a"))


@query("sf02_hashes", "SELECT doc_id, substr(sha1(text), 1, 16) AS s1, substr(sha256(text), 1, 16) AS s2 FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", F.substring(F.sha1("text"), 1, 16).alias("s1"), F.substring(F.sha2("text", 256), 1, 16).alias("s2"))


@query("sf03_dates", """SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, lpad(CAST(month(d) AS VARCHAR), 2, '0') AS m, CAST(quarter(d) AS INTEGER) AS q, CAST(dayofweek(d) + 1 AS INTEGER) AS dow, CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(DATE '2002-01-01' - d AS INTEGER) AS age,
 strftime(o_orderdate, '%H:%M') AS hhmm, CAST(d - INTERVAL 3 MONTH AS DATE) AS three_months, d + 10 AS later FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def _(t):
    d = F.to_date("o_orderdate")
    return t.raw("orders").select(
        "o_orderkey", F.year(d).alias("y"), F.date_format(d, "MM").alias("m"), F.quarter(d).alias("q"), F.dayofweek(d).alias("dow"), F.trunc(d, "month").alias("month_start"),
        F.datediff(F.lit(date(2002, 1, 1)), d).alias("age"), F.date_format("o_orderdate", "HH:mm").alias("hhmm"), F.add_months(d, -3).alias("three_months"), F.date_add(d, 10).alias("later"))


@query("sf04_math", """SELECT p_partkey, ln(p_retailprice) AS l, sqrt(p_retailprice) AS s, abs(p_size - 25) AS a, CAST(sign(p_size - 25) AS DOUBLE) AS g, pow(p_size, 1.5) AS w, least(greatest(p_size, 10), 40) AS c, floor(p_retailprice / 100) * 100 AS lots FROM part""", l=6, s=6, w=5, lots=1)
def _(t):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return t.raw("part").select("p_partkey", F.ln(p).alias("l"), F.sqrt(p).alias("s"), F.abs(s - 25).alias("a"), F.signum((s - 25).cast("double")).alias("g"), F.pow(s, F.lit(1.5)).alias("w"),
                                F.least(F.greatest(s, F.lit(10)), F.lit(40)).alias("c"), (F.floor(p / 100) * 100).cast("double").alias("lots"))


@query("sf05_nulls", """SELECT symbol, trade_date, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING), first_value(x IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value
 FROM (SELECT symbol, trade_date, CASE WHEN day(trade_date) % 3 = 0 THEN close END AS x FROM panel_l)""", value=6)
def _(t):
    from quantspark.functions.expr import field
    from quantspark.operators.panel import with_factors

    sparse = t.panel_l.select("symbol", "trade_date", F.when(F.dayofmonth("trade_date") % 3 == 0, F.col("close")).alias("x"))
    return with_factors(sparse, {"value": sc.filled(field("x"))}, section_rows=1).select("symbol", "trade_date", "value")


@query("sf06_arrays_json", """SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, count(*) AS n FROM events GROUP BY 1""")
def _(t):
    k = F.from_json("props", "struct<k:bigint>")["k"] % 10
    return t.raw("events").groupBy(k.alias("k")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.count(F.lit(1)).alias("n"))


@query("sf07_safe_casts", """SELECT doc_id, TRY_CAST(x AS DOUBLE) AS num, greatest(coalesce(TRY_CAST(x AS BIGINT), 0), 0) AS n, TRY_CAST(d AS DATE) AS day, CASE WHEN lower(b) IN ('true', 'yes', '1') THEN true WHEN lower(b) IN ('false', 'no', '0') THEN false END AS flag
 FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE CAST(n_chars - 500 AS VARCHAR) END AS x, CASE WHEN doc_id % 5 = 0 THEN 'soon' ELSE '2024-01-0' || CAST(doc_id % 9 + 1 AS VARCHAR) END AS d, CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE '?' END AS b FROM documents)""", num=3)
def _(t):
    i = F.col("doc_id")
    x = F.when(i % 4 == 0, "x").otherwise((F.col("n_chars") - 500).cast("string"))
    d = F.when(i % 5 == 0, "soon").otherwise(F.concat(F.lit("2024-01-0"), (i % 9 + 1).cast("string")))
    b = F.lower(F.when(i % 3 == 0, "Yes").when(i % 3 == 1, "no").otherwise("?"))
    return t.raw("documents").select("doc_id", x.try_cast("double").alias("num"), F.greatest(F.coalesce(x.try_cast("bigint"), F.lit(0)), F.lit(0)).alias("n"), d.try_cast("date").alias("day"),
                                     F.when(b.isin("true", "yes", "1"), True).when(b.isin("false", "no", "0"), False).alias("flag"))


@query("sl01_top_per_group", """SELECT symbol, trade_date, close FROM panel_d QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY close DESC NULLS LAST, symbol) <= 5""", close=6)
def _(t):
    w = Window.partitionBy("trade_date").orderBy(F.desc_nulls_last("close"), "symbol")
    return t.panel_d.withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("symbol", "trade_date", "close")


@query("sl01_sorted_page", "SELECT symbol, trade_date, close FROM panel_d ORDER BY close DESC NULLS LAST, symbol, trade_date LIMIT 40 OFFSET 80", close=6)
def _(t):
    return t.panel_d.orderBy(F.desc_nulls_last("close"), "symbol", "trade_date").offset(80).limit(40).select("symbol", "trade_date", "close")


# --- batch family jobs ----------------------------------------------------------------


@query("ap14_alpha_input", "SELECT symbol, trade_date, vwap, ret, market_value, industry FROM alpha_d", vwap=5, ret=6, market_value=3)
def _(t):
    return t.alpha_d.select("symbol", "trade_date", "vwap", "ret", "market_value", "industry")


#: factors that are compared at fewer than six digits: close to a zero denominator, or over long windows
_DIGITS = {
    "alpha101_053": 2, "elasticity_amount_resilience_20d": 3, "research_turnover_liquidity": 4,
    "research_low_beta": 4, "research_idiosyncratic_volatility": 4, "research_residual_momentum": 4,
}


def _rounded(values, digits=_DIGITS):
    """Values rounded as their factor's digits say."""
    value = F.round(F.col("value") + HALF_NUDGE, 6)
    for factor, n in digits.items():
        value = F.when(F.col("factor_name") == factor, F.round(F.col("value") + HALF_NUDGE, n)).otherwise(value)
    value = F.when(F.rint("value") == F.col("value"), F.col("value")).otherwise(value)  # flags and ranks are round
    return values.withColumn("value", value + F.lit(0.0))


#: factors of one piece of oracle text; DuckDB takes long over many more windows at once
_PIECE = 14


def _family_sql(factors, source):
    """The long values of a family, by pieces."""
    names = list(factors)
    pieces = [{n: factors[n] for n in names[i : i + _PIECE]} for i in range(0, len(names), _PIECE)]
    return " UNION ALL ".join(f"SELECT * FROM ({long_sql(p, source, _DIGITS)}) f{i}_" for i, p in enumerate(pieces))


def _whole_family(name, factors, source, sizes):
    """Registers the batch job of every factor of a family."""

    @query(name, _family_sql(factors, source))
    def _(t):
        rows, section_rows = getattr(t, sizes)
        return _rounded(run_factors(getattr(t, source), factors, section_rows=section_rows, rows=rows).whole())


_whole_family("ap15_batch_alphas", ALPHAS, "alpha_d", "sizes_d")
_whole_family("rf09_batch_research", RESEARCH_FACTORS, "research_l", "sizes_l")
_whole_family("pff36_batch_paper", PAPER_FACTORS, "paper_l", "sizes_l")


#: two formulas that cannot run stand among those that can
_MIXED = {n: RESEARCH_FACTORS[n] for n in list(RESEARCH_FACTORS)[:3]}


def _unbuildable():
    raise ZeroDivisionError("window of no bars")


@query("ap15_isolation", f"""SELECT factor_name, count(*) AS row_count, min(trade_date) AS min_date, max(trade_date) AS max_date, false AS failed FROM ({_family_sql(_MIXED, 'research_l')}) v GROUP BY 1
 UNION ALL SELECT n, 0, NULL, NULL, true FROM (VALUES ('no_column'), ('no_formula')) b(n)""")
def _(t):
    broken = {"no_column": mean(field("close") / field("missing"), 5), "no_formula": _unbuildable}
    status = run_factors(t.research_l, {**broken, **_MIXED}, section_rows=t.section_rows_l).status()
    return status.withColumn("failed", F.col("error").isNotNull()).drop("error")


_HV = sc.high_volume(20, 0.9, 1.0)
_LATE_VOLUME = "(SELECT *, volume * (0.5 + (symbol % 10) / 10.0) AS cum_volume FROM panel_l)"
#: names of the long panel: every fifth is special from a date on
_NAMES = """SELECT symbol, name, CASE WHEN symbol % 5 = 0 THEN 1 ELSE 0 END AS is_st, CAST(CASE WHEN symbol % 11 = 0 THEN DATE '2000-01-01' END AS DATE) AS delist_date FROM dim_l"""
_RENAMED = """SELECT symbol, 'ST ' || name AS name, DATE '1996-01-01' AS start_date, CAST(DATE '1997-06-30' AS DATE) AS end_date FROM dim_l WHERE symbol % 7 = 3"""


def _marked(name, value, source):
    return f"SELECT symbol, trade_date, '{name}' AS factor_name, CAST({value} AS DOUBLE) AS value FROM {source}"


_GRID = "(SELECT s.symbol, d.trade_date FROM (SELECT DISTINCT symbol FROM panel_l) s CROSS JOIN (SELECT DISTINCT trade_date FROM panel_l) d) g"
_LIMITED = "(SELECT p.*, up_limit, down_limit FROM panel_l p LEFT JOIN limits_l USING (symbol, trade_date)) x"
_TIMER = [
    _marked("is_paused", "CASE WHEN EXISTS (SELECT 1 FROM panel_l p WHERE p.symbol = g.symbol AND p.trade_date = g.trade_date AND (p.symbol + day(p.trade_date)) % 4 <> 0) THEN 0 ELSE 1 END", _GRID),
    _marked("is_limit_up", "CASE WHEN up_limit > 0 AND close >= up_limit - 0.0001 THEN 1 ELSE 0 END", _LIMITED),
    _marked("is_limit_down", "CASE WHEN down_limit > 0 AND close <= down_limit + 0.0001 THEN 1 ELSE 0 END", _LIMITED),
]
_CORE = [
    _marked("market_cap", "coalesce(circ_mv, total_mv)", "basic"),
    _marked("market_cap_rank", "row_number() OVER (PARTITION BY trade_date ORDER BY coalesce(circ_mv, total_mv), symbol)", "basic"),
    _marked("is_st", f"""CASE WHEN EXISTS (SELECT 1 FROM ({_RENAMED}) c WHERE c.symbol = g.symbol AND g.trade_date BETWEEN start_date AND end_date) OR EXISTS (SELECT 1 FROM ({_NAMES}) n
 WHERE n.symbol = g.symbol AND (is_st > 0 OR contains(name, 'ST') OR delist_date <= g.trade_date)) THEN 1 ELSE 0 END""", "(SELECT s.symbol, d.trade_date FROM dim_l s CROSS JOIN (SELECT DISTINCT trade_date FROM panel_l) d) g"),
    *_TIMER,
    _marked("yesterday_limit_up", "CASE WHEN EXISTS (SELECT 1 FROM panel_l q JOIN limits_l l USING (symbol, trade_date) WHERE q.symbol = p.symbol AND q.trade_date = c.prev AND l.up_limit > 0 AND q.close >= l.up_limit - 0.0001) THEN 1 ELSE 0 END",
            "panel_l p JOIN (SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS prev FROM (SELECT DISTINCT trade_date FROM panel_l)) c USING (trade_date)"),
    f"SELECT * FROM ({_family_sql({**sc.BAR_FACTORS, **_HV}, _LATE_VOLUME)}) b",
]
_STAMPS = sc.stamps(window=20, lots=1.0)


def _stamped_sql(parts):
    """Long values with the as-of time and hash of each factor, written out as the store has them."""
    def text(params):
        return "{" + ",".join(f'"{k}":{v!r}' if not isinstance(v, str) else f'"{k}":"{v}"' for k, v in sorted(params.items())) + "}"

    marks = ", ".join(f"('{n}', '{time}', substr(sha1('{text(params)}'), 1, 16))" for n, (time, params) in _STAMPS.items())
    return f"""SELECT symbol, trade_date, as_of_time, factor_name, params_hash, round(value + {HALF_NUDGE}, CASE factor_name WHEN 'market_cap' THEN 2 ELSE 6 END) + 0.0 AS value FROM ({' UNION ALL '.join(parts)}) v
 JOIN (VALUES {marks}) m(factor_name, as_of_time, params_hash) USING (factor_name) WHERE value IS NOT NULL"""


def _small_caps(t):
    bars = t.panel_l.withColumn("cum_volume", F.col("volume") * (0.5 + (F.col("symbol") % 10) / 10.0))
    minutes = t.panel_l.where("(symbol + dayofmonth(trade_date)) % 4 <> 0").select("symbol", "trade_date", F.lit(630).alias("minute_of_day"))
    return bars, minutes


@query("scf11_core_batch", _stamped_sql(_CORE))
def _(t):
    rows = t.sizes_l[0]
    t = t.with_written("panel_l")
    bars, minutes = _small_caps(t)
    name = F.col("name")
    stocks = t.dim_l.select("symbol", "name", F.when(F.col("symbol") % 5 == 0, 1).otherwise(0).alias("is_st"),
                            F.when(F.col("symbol") % 11 == 0, F.lit(date(2000, 1, 1))).alias("delist_date"))
    changes = t.dim_l.where("symbol % 7 = 3").select("symbol", F.concat(F.lit("ST "), name).alias("name"),
                                                     F.lit(date(1996, 1, 1)).alias("start_date"), F.lit(date(1997, 6, 30)).alias("end_date"))
    done = sc.core_batch(bars, t.basic, t.limits_l, stocks, changes, minutes, window=20, lots=1.0, rows=rows)
    return sc.stamped(_rounded(done[0].whole().unionByName(done[1].whole()), {"market_cap": 2}), _STAMPS)


@query("scf11_timer_batch", _stamped_sql(_TIMER))
def _(t):
    t = t.with_written("panel_l")
    bars, minutes = _small_caps(t)
    return sc.stamped(_rounded(sc.timer_batch(bars, t.limits_l, minutes).whole()), _STAMPS)


# --- written tables ---------------------------------------------------------------------


@query("sk02_append_partitioned", "SELECT symbol, datetime, trade_date, price, 'batch' AS source, CAST(year(trade_date) AS INTEGER) AS year FROM ticks", price=6)
def _(t):
    path = work_folder(t.spark) + "/ticks"
    sk.append_rows(t.ticks.select("symbol", "datetime", "trade_date", "price"), path, "trade_date")
    return t.spark.read.parquet(path).select("symbol", "datetime", "trade_date", "price", "source", "year")


@query("sk03_indicator_sink", "SELECT factor_name AS indicator_name, symbol, trade_date, value FROM latest", value=6)
def _(t):
    path = work_folder(t.spark) + "/indicators"
    rows = fs.latest(t.store).select(F.col("factor_name").alias("indicator_name"), "symbol", "trade_date", "value")
    sk.append_indicators(rows, path)
    return t.spark.read.parquet(path).select("indicator_name", "symbol", "trade_date", "value")


@query("dq01_compaction", "SELECT symbol, trade_date, factor_name, version, value FROM latest", value=6)
def _(t):
    path = work_folder(t.spark) + "/store"
    for version in (1, 2):  # one append per version leaves several files per month
        sk.append_rows(t.store.where(F.col("version") == version), path, "trade_date", sort=("factor_name", "symbol"))
    sk.compact(t.spark, path, fs.KEY, F.col("version"))
    return t.spark.read.parquet(path).select("symbol", "trade_date", "factor_name", "version", "value")


@query("sc17_symbol_csvs", """SELECT symbol, datetime, price AS open, price + 1 AS high, price / 2 AS low, price AS close, volume FROM ticks WHERE price > 0""", open=4, high=4, low=4, close=4)
def _(t):
    folder = work_folder(t.spark)
    rows = t.ticks.where("price > 0").select("symbol", F.col("datetime").cast("string").alias("DateTime"), F.col("price").alias("Open"),
                                             (F.col("price") + 1).alias("High"), (F.col("price") / 2).alias("Low"), F.col("price").alias("Close"), F.col("volume").alias("Volume"))
    rows.write.option("header", True).partitionBy("symbol").csv(folder)
    # Spark names its files itself, so here the folder stands for the file name
    return scan.read_symbol_csvs(t.spark, folder, by_folder=True)


@query("fs09_definitions", """SELECT factor_name, count(*) AS row_count FROM latest GROUP BY 1""")
def _(t):
    from quantspark.factors.catalog import definitions

    rows = fs.latest(t.store).groupBy("factor_name").agg(F.count(F.lit(1)).alias("row_count"))
    known = definitions(t.spark, [("close_level", "custom", "stored level"), ("volume_level", "custom", "stored level")])
    return known.join(rows, "factor_name").select("factor_name", "row_count")


@query("ev17_user_factor_analysis", """WITH f AS (SELECT symbol, trade_date, close / nullif(lag(close, 3) OVER (PARTITION BY symbol ORDER BY trade_date), 0) - 1 AS x, lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) / nullif(close, 0) - 1 AS r FROM panel_d)
 SELECT trade_date, count(*) AS names, corr(rx, rr) AS ic FROM (SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY round(x, 10)) + (count(*) OVER (PARTITION BY trade_date, round(x, 10)) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY trade_date ORDER BY round(r, 10)) + (count(*) OVER (PARTITION BY trade_date, round(r, 10)) - 1) / 2.0 AS rr FROM f WHERE x IS NOT NULL AND r IS NOT NULL) GROUP BY 1 HAVING count(*) >= 10""", ic=6)
def _(t):
    from quantspark.functions import udf
    from quantspark.operators import evaluate as ev
    from quantspark.operators.panel import with_factors
    from quantspark.plans.q_streaming_udf import momentum

    start, end = date(1990, 1, 1), date(2100, 1, 1)
    mine = udf.run_python_factor(t.panel_d, momentum, start, end, {"n": 3}).withColumnRenamed("value", "x")
    r = with_factors(t.panel_d, {"r": ev.FORWARD_RETURN}, section_rows=1).select("symbol", "trade_date", "r")
    return ev.report(mine, r, section_rows=t.section_rows_d)["ic"]
