"""Evaluation, factor-store, multi-factor and portfolio queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.bars import CLOSE, RET, VOLUME
from quantspark.factors.technical import TA_FACTORS
from quantspark.functions import expr as x
from quantspark.operators import evaluate as ev
from quantspark.operators import multifactor as mp
from quantspark.operators import portfolio as pm
from quantspark.operators.joins import membership
from quantspark.operators.panel import with_factors
from quantspark.plans.oracle import factor_sql
from quantspark.plans.registry import factor, query
from quantspark.sources import store as fs

W = "(PARTITION BY symbol ORDER BY trade_date)"
#: factor x = -pct_change(5), forward return r, on the dense panel
XR = f"""xr AS (SELECT symbol, trade_date, -(close / nullif(lag(close, 5) OVER {W}, 0) - 1) AS x, lead(close) OVER {W} / nullif(close, 0) - 1 AS r FROM panel_d)"""


def pr(v, part):
    """Average-tie percent rank text."""
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {part}, {v}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part})"


def ic_sql(src, part, extra=""):
    return f"""(SELECT {part}, count(*) AS names, CASE WHEN isnan(corr(rx, rr)) THEN NULL ELSE corr(rx, rr) END AS ic FROM
 (SELECT {part}, {pr('round(x, 10)', part)} AS rx, {pr('round(r, 10)', part)} AS rr FROM {src} WHERE x IS NOT NULL AND r IS NOT NULL {extra}) GROUP BY {part} HAVING count(*) >= 10 AND NOT isnan(corr(rx, rr)))"""


def xr(t):
    out = with_factors(t.panel_d, {"x": -x.pct(CLOSE, 5), "r": ev.FORWARD_RETURN}, section_rows=t.section_rows_d)
    return out.select("symbol", "trade_date", "x", "r")


def small_returns(t):
    """The panel's price jumps are extreme; scaled returns keep products in range."""
    return xr(t).withColumn("r", F.col("r") * 0.002)


factor("ev01_forward_return", ev.FORWARD_RETURN)


@query("ev02_rank_ic", f"WITH {XR} SELECT * FROM {ic_sql('xr', 'trade_date')}", ic=6)
def _(t):
    return ev.rank_ic(xr(t), section_rows=t.section_rows_d)


_STATS = """SELECT count(ic) AS days, avg(ic) AS ic_mean, {s}(ic) AS ic_std, avg(ic) / nullif({s}(ic), 0) AS icir, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate,
 avg(CASE WHEN abs(ic) > 0.02 THEN 1.0 ELSE 0.0 END) AS strong_rate FROM """
_D6 = dict(ic_mean=6, ic_std=6, icir=6, positive_rate=6, strong_rate=6)


@query("ev03_ic_stats", f"WITH {XR} " + _STATS.format(s="stddev_samp") + ic_sql("xr", "trade_date"), **_D6)
def _(t):
    return ev.ic_stats(ev.rank_ic(xr(t), section_rows=t.section_rows_d))


@query("ev04_ic_stats_pop", f"WITH {XR} " + _STATS.format(s="stddev_pop") + ic_sql("xr", "trade_date"), **_D6)
def _(t):
    return ev.ic_stats(ev.rank_ic(xr(t), section_rows=t.section_rows_d), ddof=0)


LAGGED = f"""{XR}, dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS dn FROM (SELECT DISTINCT trade_date FROM xr)),
 lg AS (SELECT a.symbol, a.trade_date, l.lag, a.x, b.r FROM xr a JOIN dd USING (trade_date) JOIN (SELECT unnest([1, 3, 5, 10, 20]) AS lag) l ON true
 JOIN dd d2 ON d2.dn = dd.dn + l.lag JOIN xr b ON b.symbol = a.symbol AND b.trade_date = d2.trade_date)"""


@query("ev05_ic_decay", f"WITH {LAGGED} SELECT lag, avg(ic) AS ic_mean, count(ic) AS days FROM {ic_sql('lg', 'trade_date, lag')} GROUP BY lag", ic_mean=6)
def _(t):
    f = xr(t)
    return ev.ic_decay(f.select("symbol", "trade_date", "x"), f.select("symbol", "trade_date", "r"), section_rows=t.section_rows_d * 5)


def qcut_sql(src, part, n, need):
    cuts = " + ".join(f"CAST(x > quantile_cont(x, {i / n!r}) OVER (PARTITION BY {part}) AS INT)" for i in range(1, n))
    return f"(SELECT *, CASE WHEN x IS NOT NULL AND count(x) OVER (PARTITION BY {part}) >= {need} THEN {cuts} END AS g FROM {src})"


@query("ev06_signal_decay", f"""WITH {LAGGED}, k AS (SELECT * FROM lg WHERE x IS NOT NULL AND r IS NOT NULL), q AS {qcut_sql('k', 'trade_date, lag', 5, 10)},
 d AS (SELECT lag, trade_date, avg(r) FILTER (g = 4) AS top, avg(r) FILTER (g = 0) AS bottom FROM q WHERE g IS NOT NULL GROUP BY 1, 2) SELECT lag, avg(bottom) AS bottom, avg(top) AS top FROM d GROUP BY 1""", bottom=6, top=6)
def _(t):
    f = xr(t)
    return ev.signal_decay(f.select("symbol", "trade_date", "x"), f.select("symbol", "trade_date", "r"), section_rows=t.section_rows_d * 5)


@query("ev07_industry_ic", f"""WITH {XR}, xi AS (SELECT xr.*, d.industry FROM xr JOIN dim_d d USING (symbol)) SELECT industry, avg(ic) AS ic_mean, count(ic) AS days,
 (SELECT count(DISTINCT symbol) FROM xi z WHERE z.industry = q.industry) AS symbols FROM {ic_sql('xi', 'trade_date, industry')} q GROUP BY industry HAVING symbols >= 5""", ic_mean=6)
def _(t):
    return ev.industry_ic(xr(t).join(t.dim_d.select("symbol", "industry"), "symbol"), section_rows=t.section_rows_d)


@query("ev08_quantile_turnover", f"""WITH {XR}, q AS (SELECT * FROM {qcut_sql('xr', 'trade_date', 5, 10)} WHERE g IS NOT NULL), dd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS dn FROM (SELECT DISTINCT trade_date FROM xr)),
 n AS (SELECT q.symbol, q.trade_date, q.g, dn FROM q JOIN dd USING (trade_date)) SELECT a.trade_date, 1 - count(*) FILTER (b.g = 0 AND a.g = 0) / greatest(count(*) FILTER (b.g = 0), 1.0) AS bottom,
 1 - count(*) FILTER (b.g = 4 AND a.g = 4) / greatest(count(*) FILTER (b.g = 4), 1.0) AS top FROM n a JOIN n b ON a.symbol = b.symbol AND a.dn = b.dn + 1 GROUP BY 1 HAVING count(*) >= 10""", bottom=6, top=6)
def _(t):
    return ev.quantile_turnover(xr(t), section_rows=t.section_rows_d)


@query("ev09_top_n_turnover", f"""WITH {XR}, dd AS (SELECT trade_date, (row_number() OVER (ORDER BY trade_date) - 1) AS dn FROM (SELECT DISTINCT trade_date FROM xr)),
 tp AS (SELECT symbol, trade_date, dn // 5 AS no FROM xr JOIN dd USING (trade_date) WHERE dn % 5 = 0 AND x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY x DESC, symbol) <= 10)
 SELECT a.trade_date, 1 - count(b.symbol) / 10.0 AS turnover FROM tp a LEFT JOIN tp b ON a.symbol = b.symbol AND a.no = b.no + 1 WHERE a.no > 0 GROUP BY 1""", turnover=6)
def _(t):
    return ev.top_n_turnover(xr(t))


NAV = f"""{XR}, k AS (SELECT symbol, trade_date, x, r * 0.002 AS r FROM xr WHERE x IS NOT NULL AND r IS NOT NULL), q AS (SELECT * FROM {qcut_sql('k', 'trade_date', 5, 10)} WHERE g IS NOT NULL),
 m AS (SELECT d.trade_date, s.g, coalesce(avg(q.r), 0) - 0.003 / 252 AS ret FROM (SELECT DISTINCT trade_date FROM q) d CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS g) s LEFT JOIN q ON q.trade_date = d.trade_date AND q.g = s.g GROUP BY 1, 2),
 u AS (SELECT trade_date, 'q' || CAST(g + 1 AS VARCHAR) AS series, ret FROM m UNION ALL SELECT trade_date, 'long_short', max(ret) FILTER (g = 4) - max(ret) FILTER (g = 0) - 0.003 / 126 FROM m GROUP BY 1),
 nv AS (SELECT *, product(1 + ret) OVER (PARTITION BY series ORDER BY trade_date) AS nav FROM u)"""


@query("ev10_quantile_nav", f"WITH {NAV} SELECT * FROM nv", ret=6, nav=6)
def _(t):
    return ev.quantile_nav(small_returns(t), 5, 0.003, section_rows=t.section_rows_d)


@query("ev11_nav_with_benchmark", f"""WITH {NAV}, b AS (SELECT trade_date, avg(close) AS bv FROM panel_d GROUP BY 1), j AS (SELECT nv.trade_date, nav, bv FROM nv JOIN b USING (trade_date) WHERE series = 'q5' AND nav > 0 AND bv > 0)
 SELECT trade_date, nav / first_value(nav) OVER (ORDER BY trade_date) AS strategy, bv / first_value(bv) OVER (ORDER BY trade_date) AS benchmark,
 (nav / first_value(nav) OVER (ORDER BY trade_date)) / (bv / first_value(bv) OVER (ORDER BY trade_date)) AS excess FROM j""", strategy=6, benchmark=6, excess=6)
def _(t):
    nav = ev.quantile_nav(small_returns(t), 5, 0.003, section_rows=t.section_rows_d).where("series = 'q5'")
    bench = t.panel_d.groupBy("trade_date").agg(F.avg("close").alias("nav"))
    return pm.excess_points(nav, bench)


@query("ev12_coverage", f"WITH {XR} SELECT count(x) * 1.0 / count(*) AS coverage, count(DISTINCT symbol) FILTER (x IS NOT NULL) AS active_symbols FROM xr", coverage=6)
def _(t):
    return ev.coverage_summary(xr(t))


_MULTI = """WITH v AS (SELECT symbol, trade_date, factor_name, value AS x FROM latest), rr AS (SELECT symbol, trade_date, lead(close) OVER (PARTITION BY symbol ORDER BY trade_date) / nullif(close, 0) - 1 AS r FROM panel_d),
 xr AS (SELECT v.*, rr.r FROM v JOIN rr USING (symbol, trade_date)) SELECT factor_name, """ + _STATS[7:].format(s="stddev_samp") + ic_sql("xr", "trade_date, factor_name") + " GROUP BY factor_name"


def _multi(t):
    r = with_factors(t.panel_d, {"r": ev.FORWARD_RETURN}, section_rows=1).select("symbol", "trade_date", "r")
    v = fs.latest(t.store).select("symbol", "trade_date", "factor_name", F.col("value").alias("x"))
    return ev.ic_stats(ev.rank_ic(v.join(r, ["symbol", "trade_date"]), by=["factor_name"], section_rows=t.section_rows_d * 2), by=["factor_name"])


@query("ev13_report_ic_by_factor", _MULTI, **_D6)
def _(t):
    return _multi(t)


@query("ev14_research_runs_pool", f"""WITH {XR}, a AS (SELECT d.trade_date, s.trade_date AS snapshot FROM (SELECT DISTINCT trade_date FROM xr) d ASOF JOIN (SELECT DISTINCT CAST(trade_date + INTERVAL 29 YEAR AS DATE) AS trade_date FROM idx) s ON d.trade_date >= s.trade_date),
 i AS (SELECT CAST(trade_date + INTERVAL 29 YEAR AS DATE) AS snapshot, symbol FROM idx), xp AS (SELECT xr.* FROM xr JOIN a USING (trade_date) JOIN i ON i.snapshot = a.snapshot AND i.symbol = xr.symbol)
 SELECT * FROM {ic_sql('xp', 'trade_date')}""", ic=6)
def _(t):
    moved = t.idx.select("index_symbol", F.add_months("trade_date", 29 * 12).alias("trade_date"), "symbol")
    return ev.rank_ic(membership(xr(t), moved), section_rows=t.section_rows_d)


@query("ev15_best_run", """WITH r AS (SELECT o_orderpriority AS params_hash, o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_custkey % 400 AS INT) AS end_date, CAST(o_orderkey AS BIGINT) AS created FROM orders),
 s AS (SELECT *, start_date <= DATE '1997-01-01' AND end_date >= DATE '1997-06-30' AS full_cover, greatest(least(end_date, DATE '1997-06-30') - greatest(start_date, DATE '1997-01-01') + 1, 0) AS overlap FROM r)
 SELECT params_hash, run_id, full_cover, overlap, 181 - overlap AS clipped FROM s WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY params_hash ORDER BY full_cover DESC, overlap DESC, created DESC, run_id) = 1""")
def _(t):
    runs = t.raw("orders").select(F.col("o_orderpriority").alias("params_hash"), F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("start_date"),
                                  F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 400).cast("int")).alias("end_date"), F.col("o_orderkey").alias("created"))
    best = ev.best_run(runs, date(1997, 1, 1), date(1997, 6, 30))
    return best.select("params_hash", "run_id", "full_cover", F.col("overlap").cast("long"), F.col("clipped").cast("long"))


@query("ev16_board_rows", """WITH a AS (SELECT factor_name, version, count(*) AS n, avg(value) AS score FROM store GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY factor_name ORDER BY version DESC) = 1),
 c AS (SELECT DISTINCT factor_name FROM store UNION SELECT n_name FROM nation) SELECT c.factor_name, a.version, a.n, a.score, a.factor_name IS NOT NULL AS analysed FROM c LEFT JOIN a USING (factor_name)""", score=6)
def _(t):
    runs = t.store.groupBy("factor_name", "version").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("score"))
    newest = runs.groupBy("factor_name").agg(F.max_by(F.struct("version", "n", "score"), "version").alias("s")).select("factor_name", "s.*")
    names = t.store.select("factor_name").union(t.raw("nation").select("n_name")).distinct()
    return names.join(newest, "factor_name", "left").withColumn("analysed", F.col("version").isNotNull())


# --- factor store -----------------------------------------------------------------


@query("fs01_append_normalise", """WITH b AS (SELECT symbol, trade_date, factor_name, CASE WHEN symbol % 10 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS value, version FROM store)
 SELECT symbol, trade_date, '' AS as_of_time, factor_name, 'bf21a9e8fbc5a384' AS params_hash, max_by(TRY_CAST(value AS DOUBLE), version) AS value, 'unit' AS source, max(version) AS version FROM b WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL GROUP BY 1, 2, 4""", value=6)
def _(t):
    raw = t.store.select("symbol", "trade_date", F.col("factor_name").alias("feature_name"),
                         F.when(F.col("symbol") % 10 == 0, "bad").otherwise(F.col("value").cast("string")).alias("value"), "version")
    return fs.normalise(raw, "unit")


@query("fs02_latest", "SELECT symbol, trade_date, factor_name, version, value FROM latest WHERE trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'", value=6)
def _(t):
    return fs.load(t.store, None, date(2024, 1, 5), date(2024, 1, 20)).select("symbol", "trade_date", "factor_name", "version", "value")


@query("fs03_cross_section", "SELECT symbol, value FROM latest WHERE factor_name = 'close_level' AND trade_date = DATE '2024-01-10'", value=6)
def _(t):
    return fs.cross_section(t.store, "close_level", date(2024, 1, 10))


@query("fs04_preview", "SELECT symbol, value FROM latest WHERE factor_name = 'close_level' AND trade_date = DATE '2024-01-10' ORDER BY value, symbol LIMIT 20", value=6)
def _(t):
    return fs.preview(t.store, "close_level", date(2024, 1, 10))


@query("fs05_params_hash", """SELECT DISTINCT event_type, substr(sha1('{"time":"' || event_type || '","window":"20"}'), 1, 16) AS params_hash FROM events""")
def _(t):
    m = F.create_map(F.lit("window"), F.lit("20"), F.lit("time"), F.col("event_type"))
    return t.raw("events").select("event_type").distinct().select("event_type", fs.params_hash_column(m).alias("params_hash"))


@query("fs06_matrix", "SELECT symbol, trade_date, value FROM latest WHERE factor_name = 'volume_level'", value=6)
def _(t):
    return fs.load(t.store, ["volume_level"]).select("symbol", "trade_date", "value")


@query("fs07_common_date", "SELECT min(m) AS trade_date FROM (SELECT factor_name, max(trade_date) AS m FROM store WHERE trade_date < DATE '2024-01-15' GROUP BY 1)")
def _(t):
    return fs.common_date_before(t.store, ["close_level", "volume_level"], date(2024, 1, 15))


@query("fs08_mixed_dates", """SELECT symbol, max(value) FILTER (factor_name = 'close_level') AS close_level, max(value) FILTER (factor_name = 'volume_level') AS volume_level FROM latest
 WHERE (factor_name = 'close_level' AND trade_date = DATE '2024-01-10') OR (factor_name = 'volume_level' AND trade_date = DATE '2024-01-08') GROUP BY 1""", close_level=6, volume_level=6)
def _(t):
    return fs.mixed_dates(t.store, {"close_level": date(2024, 1, 10), "volume_level": date(2024, 1, 8)})


def long_sql(factors, source, digits=6):
    wide = factor_sql(source, factors, digits=digits)
    parts = " UNION ALL ".join(f"SELECT symbol, trade_date, '{n}' AS factor_name, {n} AS value FROM w WHERE {n} IS NOT NULL" for n in factors)
    return f"WITH w AS ({wide}) {parts}"


@query("ta23_batch_ta", long_sql(TA_FACTORS, "panel_d"), value=6)
def _(t):
    return fs.batch_values(t.panel_d, TA_FACTORS, section_rows=1)


@query("fs10_bundle_counts", f"SELECT factor_name, count(*) AS n FROM ({long_sql(TA_FACTORS, 'panel_d')}) GROUP BY 1 UNION ALL SELECT factor_name, count(*) FROM latest GROUP BY 1")
def _(t):
    rows = fs.batch_values(t.panel_d, TA_FACTORS, section_rows=1).select("factor_name").unionByName(fs.latest(t.store).select("factor_name"))
    return rows.groupBy("factor_name").agg(F.count(F.lit(1)).alias("n"))


_RANKM = lambda c: f"(rank() OVER (PARTITION BY trade_date ORDER BY round({c}, 10)) + (count(*) OVER (PARTITION BY trade_date, round({c}, 10)) - 1) / 2.0) / count({c}) OVER (PARTITION BY trade_date)"


@query("fs11_ml_blend", f"""WITH b AS (SELECT symbol, trade_date, least(greatest(({_RANKM('close')} * 0.6 + {_RANKM('volume')} * 0.4) / 1.0, 0), 1) AS score FROM panel_m),
 s AS (SELECT symbol, trade_date AS f, lead(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS u, score FROM b)
 SELECT s.symbol, d.trade_date, s.score FROM s JOIN (SELECT DISTINCT trade_date FROM panel_l) d ON d.trade_date >= s.f AND (s.u IS NULL OR d.trade_date < s.u)""", score=6)
def _(t):
    from quantspark.operators.joins import expand_signal

    blend = x.clip((x.rank(CLOSE) * 0.6 + x.rank(VOLUME) * 0.4) / 1.0, 0.0, 1.0)
    scored = with_factors(t.panel_m, {"score": blend}, section_rows=t.section_rows_l)
    return expand_signal(scored, t.panel_l.select("trade_date").distinct(), ["score"]).select("symbol", "trade_date", "score")


@query("ts21_many_factors", long_sql({"mean5": x.mean(CLOSE, 5), "rank": x.rank(CLOSE), "ret": RET}, "panel_d"), value=6)
def _(t):
    return fs.batch_values(t.panel_d, {"mean5": x.mean(CLOSE, 5), "rank": x.rank(CLOSE), "ret": RET}, section_rows=t.section_rows_d)


_EXPR = "Mean($close, 5)"


@query("ts22_persisted_expression", f"""SELECT symbol, trade_date, substr(sha256('mean($close,5)'), 1, 16) AS factor_name, value FROM ({factor_sql('panel_d', {'value': x.mean(CLOSE, 5)})}) WHERE value IS NOT NULL""", value=6)
def _(t):
    rows = fs.batch_values(t.panel_d, {"value": x.mean(CLOSE, 5)}, section_rows=1)
    return fs.normalise(rows.withColumn("factor_name", F.lit(fs.expression_hash(_EXPR)))).select("symbol", "trade_date", "factor_name", "value")


@query("ts23_cached_lookup", "SELECT symbol, value FROM latest WHERE factor_name = 'close_level' AND params_hash = 'h0' AND trade_date = DATE '2024-01-12'", value=6)
def _(t):
    return fs.load(t.store, ["close_level"], date(2024, 1, 12), date(2024, 1, 12), hash_="h0").select("symbol", "value")


@query("ts24_indicator_lookup", """SELECT p.symbol, p.trade_date, p.close - coalesce(l.value, 0) AS value FROM panel_d p LEFT JOIN (SELECT * FROM latest WHERE factor_name = 'close_level') l USING (symbol, trade_date)""", value=6)
def _(t):
    ind = fs.load(t.store, ["close_level"]).select("symbol", "trade_date", F.col("value").alias("indicator"))
    return t.panel_d.join(ind, ["symbol", "trade_date"], "left").select("symbol", "trade_date", (F.col("close") - F.coalesce("indicator", F.lit(0.0))).alias("value"))


@query("ts25_views", """SELECT p.symbol, p.close, d.industry, d.shares FROM panel_d p LEFT JOIN dim_d d USING (symbol) WHERE p.trade_date = DATE '2024-01-10'""", close=6, shares=3)
def _(t):
    return t.panel_d.where(F.col("trade_date") == date(2024, 1, 10)).select("symbol", "close").join(t.dim_d.select("symbol", "industry", "shares"), "symbol", "left")


# --- multi-factor -------------------------------------------------------------------

WIDE_SQL = """(SELECT l.*, d.industry, ln(c.close * d.shares) AS log_cap FROM (SELECT symbol, trade_date, max(value) FILTER (factor_name = 'close_level') AS close_level,
 max(value) FILTER (factor_name = 'volume_level') AS volume_level FROM latest GROUP BY 1, 2) l LEFT JOIN dim_d d USING (symbol) JOIN panel_d c USING (symbol, trade_date))"""
SPECS = [mp.FactorSpec("close_level", 0.7, True, "rank_pct", size=True), mp.FactorSpec("volume_level", 0.3, False, "zscore", industry=True)]
PARTS = {s.name: mp.prepared(s) for s in SPECS}
SCORE = mp.score_of(PARTS, SPECS, 0.6)


def wide(t):
    cap = F.ln(F.col("close") * F.col("shares"))
    base = t.panel_d.join(t.dim_d.select("symbol", "industry", "shares"), "symbol", "left").select(
        "symbol", "trade_date", "industry", F.when(F.col("close") > 0, cap).alias("log_cap"))
    values = fs.latest(t.store).groupBy("symbol", "trade_date").pivot("factor_name", ["close_level", "volume_level"]).agg(F.max("value"))
    return values.join(base, ["symbol", "trade_date"])


def scored(t):
    return mp.score_sections(wide(t), SPECS, 0.6, t.section_rows_d)


_OUT = {"p_close_level": PARTS["close_level"], "p_volume_level": PARTS["volume_level"], "score": SCORE}


@query("mp01_preprocess", factor_sql(WIDE_SQL, {k: v for k, v in _OUT.items() if k != "score"}), p_close_level=6, p_volume_level=6)
def _(t):
    return scored(t).select("symbol", "trade_date", "p_close_level", "p_volume_level")


factor("mp02_transform_zscore", x.zscore_pop(x.field("close_level")), bars=wide, source=WIDE_SQL)


@query("mp03_linear_score", factor_sql(WIDE_SQL, {"score": SCORE}), score=6)
def _(t):
    return scored(t).select("symbol", "trade_date", "score")


SCORED = f"sco AS ({factor_sql(WIDE_SQL, {'score': SCORE})})"


@query("mp04_cross_section", f"""WITH {SCORED} SELECT s.symbol, s.trade_date, score FROM sco s WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.symbol = s.symbol AND l.trade_date = s.trade_date AND l.factor_name = 'volume_level' AND l.value < 30)""", score=6)
def _(t):
    from quantspark.operators.filters import exclude_by_factor

    kept = exclude_by_factor(scored(t).select("symbol", "trade_date", "score"), fs.latest(t.store), [{"name": "volume_level", "op": "<", "value": 30}])
    return kept.select("symbol", "trade_date", "score")


_ID = dict(bars=lambda t: t.panel_d.join(t.dim_d.select("symbol", "industry"), "symbol", "left"), source="(SELECT p.*, d.industry FROM panel_d p LEFT JOIN dim_d d USING (symbol))")
factor("mp05_research_prepare", mp.research_prepare(CLOSE, 0.05, True, True), **_ID)
factor("mp05_research_standardise", mp.research_prepare(VOLUME, 0.025), **_ID)

TARGETS = f"""{SCORED}, hold AS (SELECT DISTINCT symbol FROM ledger), rk AS (SELECT s.*, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, symbol) AS rank, h.symbol IS NOT NULL AS held FROM sco s LEFT JOIN hold h USING (symbol) WHERE score IS NOT NULL),
 tg AS (SELECT symbol, trade_date, score, CAST(rank AS INTEGER) AS rank, CAST(held AS INTEGER) AS held FROM rk WHERE rank <= 30 QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY held DESC, rank) <= 20)"""


def targets(t):
    return mp.buffered_targets(scored(t), t.ledger, 20, 10)


@query("mp06_rank_buffer", f"WITH {TARGETS} SELECT * FROM tg", score=6)
def _(t):
    return targets(t)


@query("mp07_target_weight", f"WITH {TARGETS} SELECT symbol, trade_date, least(0.045, 0.98 / count(*) OVER (PARTITION BY trade_date)) AS weight FROM tg", weight=6)
def _(t):
    return mp.target_weights(targets(t), 0.045, 0.02).select("symbol", "trade_date", "weight")


@query("mp08_overnight_exposure", """WITH e AS (SELECT trade_date, avg(price) AS lv FROM ticks GROUP BY 1), r AS (SELECT trade_date, lv / lag(lv) OVER (ORDER BY trade_date) - 1 AS ret FROM e)
 SELECT trade_date, ret, CASE WHEN ret IS NULL THEN 1.0 WHEN ret <= -0.08 THEN 0.3 WHEN ret <= -0.03 THEN 0.7 ELSE 1.0 END AS exposure FROM r""", ret=6, exposure=3)
def _(t):
    level = t.ticks.groupBy("trade_date").agg(F.avg("price").alias("lv")).withColumn("k", F.lit(0))
    ret = F.col("lv") / F.lag("lv").over(Window.partitionBy("k").orderBy("trade_date")) - 1.0
    return level.withColumn("ret", ret).select("trade_date", "ret", mp.overnight_exposure(F.col("ret"), -0.03, -0.08).alias("exposure"))


HOLD = "hw AS (SELECT symbol, sum(quantity) / (SELECT sum(quantity) FROM ledger) AS current_weight FROM ledger GROUP BY 1)"


def holdings(t):
    total = t.ledger.agg(F.sum("quantity")).scalar()
    return t.ledger.groupBy("symbol").agg(F.sum("quantity").alias("q")).select("symbol", (F.col("q") / total).alias("current_weight"))


@query("mp09_entry_filter", f"""WITH {TARGETS}, {HOLD}, w AS (SELECT symbol, trade_date, least(0.045, 0.98 / count(*) OVER (PARTITION BY trade_date)) AS weight FROM tg)
 SELECT w.symbol, w.trade_date, CASE WHEN day(trade_date) % 2 = 0 AND coalesce(current_weight, 0) <= 0 THEN 0 WHEN day(trade_date) % 2 = 0 THEN least(weight, coalesce(current_weight, 0)) ELSE weight END AS weight_after,
 CAST(day(trade_date) % 2 = 0 AND coalesce(current_weight, 0) <= 0 AS INTEGER) AS dropped, CAST(day(trade_date) % 2 = 0 AND coalesce(current_weight, 0) > 0 AND weight > coalesce(current_weight, 0) AS INTEGER) AS capped FROM w LEFT JOIN hw USING (symbol)""", weight_after=6)
def _(t):
    w = mp.target_weights(targets(t), 0.045, 0.02)
    out = mp.entry_filter(w, holdings(t), F.dayofmonth("trade_date") % 2 == 0)
    return out.select("symbol", "trade_date", "weight_after", "dropped", "capped")


_LAST = "lastday AS (SELECT max(trade_date) AS d FROM sco)"


@query("mp10_order_deltas", f"""WITH {TARGETS}, {_LAST}, w AS (SELECT symbol, least(0.045, 0.98 / count(*) OVER ()) AS weight FROM tg WHERE trade_date = (SELECT d FROM lastday)),
 p AS (SELECT symbol, floor(sum(quantity) / 1000) * 10 AS quantity FROM ledger GROUP BY 1), c AS (SELECT symbol, max_by(close, trade_date) AS price FROM panel_d GROUP BY 1),
 j AS (SELECT coalesce(w.symbol, p.symbol) AS symbol, weight, quantity FROM w FULL JOIN p ON w.symbol = p.symbol), o AS (SELECT symbol, price, floor(coalesce(weight, 0) * 1000000 / price / 10) * 10 AS target_quantity,
 floor(coalesce(weight, 0) * 1000000 / price / 10) * 10 - coalesce(quantity, 0) AS delta FROM j JOIN c USING (symbol) WHERE price > 0)
 SELECT *, CASE WHEN delta < 0 THEN 'SELL' ELSE 'BUY' END AS side FROM o WHERE delta <> 0 AND abs(delta) * price >= 0.002 * 1000000""", price=4)
def _(t):
    last = t.panel_d.agg(F.max("trade_date")).scalar()
    w = mp.target_weights(targets(t).where(F.col("trade_date") == last), 0.045, 0.02)
    pos = t.ledger.groupBy("symbol").agg((F.floor(F.sum("quantity") / 1000) * 10).cast("double").alias("quantity"))
    px = t.panel_d.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("price"))
    return mp.order_deltas(w, pos, px, 1000000.0, 10, 0.002)


@query("mp11_cash_admission", f"""WITH RECURSIVE {TARGETS}, o AS (SELECT t.symbol, t.trade_date, t.rank, p.close * 100 AS cost, row_number() OVER (PARTITION BY t.trade_date ORDER BY rank, t.symbol) AS rn FROM tg t JOIN panel_d p USING (symbol, trade_date)),
 f AS (SELECT symbol, trade_date, rank, cost, rn, cost <= 29400 AS accepted, CASE WHEN cost <= 29400 THEN 29400 - cost ELSE 29400 END AS left_ FROM o WHERE rn = 1
 UNION ALL SELECT o.symbol, o.trade_date, o.rank, o.cost, o.rn, o.cost <= f.left_, CASE WHEN o.cost <= f.left_ THEN f.left_ - o.cost ELSE f.left_ END FROM f JOIN o ON o.trade_date = f.trade_date AND o.rn = f.rn + 1)
 SELECT trade_date, symbol, rank, cost, accepted FROM f""", cost=4)
def _(t):
    o = targets(t).join(t.panel_d.select("symbol", "trade_date", (F.col("close") * 100).alias("cost")), ["symbol", "trade_date"])
    return mp.admit_buys(o, 30000.0, 0.02, 20)


# --- portfolio ----------------------------------------------------------------------

DAYRET = """dr AS (SELECT trade_date, avg(ret) AS ret, avg(vr) AS bench FROM (SELECT symbol, trade_date, 0.01 * (close / nullif(lag(close) OVER w, 0) - 1) - 0.06 AS ret, 0.01 * (high / nullif(lag(high) OVER w, 0) - 1) - 0.05 AS vr FROM panel_d WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) WHERE ret IS NOT NULL GROUP BY 1)"""


def day_returns(t):
    out = with_factors(t.panel_d, {"ret": RET * 0.01 - 0.06, "bench": x.pct(x.field("high"), 1) * 0.01 - 0.05}, section_rows=1)
    return out.where("ret is not null").groupBy("trade_date").agg(F.avg("ret").alias("ret"), F.avg("bench").alias("bench"))


GB = """{xr}, xs AS (SELECT symbol, trade_date, r * 0.002 AS r FROM xr), cd AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM xr)),
 rb AS (SELECT trade_date, i // {k} AS period FROM cd WHERE i % {k} = 0), reb AS (SELECT symbol, xr.trade_date, period, x FROM xr JOIN rb USING (trade_date)),
 lb AS (SELECT * FROM {q} WHERE g IS NOT NULL), hd AS (SELECT symbol, xs.trade_date, CAST(floor((i - 1) / {k}.0) AS BIGINT) AS period, r FROM xs JOIN cd USING (trade_date) WHERE i >= 1),
 dy AS (SELECT hd.period, hd.trade_date, lb.g, avg(hd.r) AS r FROM hd JOIN lb ON lb.period = hd.period AND lb.symbol = hd.symbol GROUP BY 1, 2, 3), pd AS (SELECT period, g, coalesce(avg(r), 0) AS r FROM dy GROUP BY 1, 2),
 sr AS (SELECT period, CAST(g AS VARCHAR) AS series, r - 0.001 * 2 * {s} AS ret FROM pd UNION ALL SELECT period, 'long_short', max(r) FILTER (g = 4) - max(r) FILTER (g = 0) - 0.004 FROM pd GROUP BY 1)
 SELECT period, series, ret, product(1 + ret) OVER (PARTITION BY series ORDER BY period) AS nav FROM sr"""


@query("pm01_grouped_backtest", "WITH " + GB.format(xr=XR, k=5, q=qcut_sql("reb", "trade_date", 5, 10), s=repr(1 / 52)), ret=6, nav=6)
def _(t):
    f = small_returns(t)
    return pm.grouped_backtest(f.select("symbol", "trade_date", F.col("x").alias("factor")), f.select("symbol", "trade_date", F.col("r").alias("ret")), every=5, cost=0.001)


@query("pm02_nav_drawdown", f"WITH {DAYRET}, n AS (SELECT trade_date, ret, product(1 + ret) OVER (ORDER BY trade_date) AS nav FROM dr) SELECT trade_date, nav, nav / max(nav) OVER (ORDER BY trade_date) - 1 AS drawdown FROM n", nav=6, drawdown=6)
def _(t):
    return pm.nav_and_drawdown(day_returns(t)).select("trade_date", "nav", "drawdown")


@query("pm03_simple_metrics", f"""WITH {DAYRET} SELECT product(1 + ret) - 1 AS total_return, pow(product(1 + ret), 252.0 / count(ret)) - 1 AS annual_return, pow(product(1 + ret), 365.25 / (max(trade_date) - min(trade_date))) - 1 AS calendar_return,
 avg(ret) * sqrt(252) / stddev_samp(ret) AS sharpe, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate FROM dr""", total_return=6, annual_return=4, calendar_return=4, sharpe=6, win_rate=6)
def _(t):
    return pm.simple_metrics(day_returns(t))


@query("pm04_full_metrics", f"""WITH {DAYRET}, n AS (SELECT *, product(1 + ret) OVER (ORDER BY trade_date) AS nav FROM dr), d AS (SELECT *, nav / max(nav) OVER (ORDER BY trade_date) - 1 AS dd FROM n),
 a AS (SELECT pow(product(1 + ret), 252.0 / count(ret)) - 1 AS ar, stddev_pop(ret) * sqrt(252) AS vol, stddev_pop(ret) FILTER (ret < 0) * sqrt(252) AS dn, min(dd) AS mdd, covar_samp(ret, bench) / var_samp(bench) AS beta,
 (avg(ret - bench) - 0.02 / 252) * 252 AS alpha, (avg(ret) - avg(bench)) * 252 / (stddev_pop(ret - bench) * sqrt(252)) AS ir FROM d)
 SELECT ar AS annual_return, vol AS volatility, (ar - 0.02) / vol AS sharpe, (ar - 0.02) / nullif(dn, 0) AS sortino, mdd AS max_drawdown, CASE WHEN abs(mdd) > 1e-8 THEN ar / abs(mdd) END AS calmar, beta, alpha, ir AS information_ratio FROM a""",
       annual_return=4, volatility=6, sharpe=3, sortino=3, max_drawdown=6, calmar=2, beta=6, alpha=6, information_ratio=6)
def _(t):
    return pm.full_metrics(day_returns(t))


@query("pm05_excess_points", """WITH s AS (SELECT trade_date, avg(close) AS v FROM panel_d GROUP BY 1), b AS (SELECT trade_date, avg(high) AS v FROM panel_d GROUP BY 1), j AS (SELECT trade_date, s.v AS sv, b.v AS bv FROM s JOIN b USING (trade_date)),
 k AS (SELECT trade_date, sv / first_value(sv) OVER w AS strategy, bv / first_value(bv) OVER w AS benchmark FROM j WINDOW w AS (ORDER BY trade_date)) SELECT *, strategy / benchmark AS excess FROM k""", strategy=6, benchmark=6, excess=6)
def _(t):
    s = t.panel_d.groupBy("trade_date").agg(F.avg("close").alias("nav"))
    return pm.excess_points(s, t.panel_d.groupBy("trade_date").agg(F.avg("high").alias("nav")))


@query("pm06_equity_curve", """WITH e AS (SELECT side || status AS account, trade_date, sum(order_value) AS equity FROM ledger GROUP BY 1, 2), u AS (SELECT * FROM (SELECT *, avg(CASE WHEN equity > 0 THEN equity END) OVER (PARTITION BY account) AS m FROM e) WHERE equity > 0 AND equity <= 5 * m)
 SELECT account, trade_date, equity, max(equity) OVER w AS peak, equity - 100000 AS pnl, equity / 100000 - 1 AS total_return, equity / max(equity) OVER w - 1 AS drawdown FROM u WINDOW w AS (PARTITION BY account ORDER BY trade_date)""", equity=2, peak=2, pnl=2, total_return=6, drawdown=6)
def _(t):
    e = t.ledger.groupBy(F.concat("side", "status").alias("account"), "trade_date").agg(F.sum("order_value").alias("equity"))
    return pm.equity_curve(e, 100000.0)


@query("pm07_position_table", """WITH p AS (SELECT symbol, sum(quantity) AS quantity, sum(order_value) / sum(quantity) AS avg_cost FROM ledger WHERE side = 'BUY' GROUP BY 1), c AS (SELECT symbol, max_by(close, trade_date) AS price FROM panel_d GROUP BY 1),
 j AS (SELECT symbol, quantity * price AS mv, quantity * avg_cost AS cb FROM p LEFT JOIN c USING (symbol)) SELECT symbol, mv AS market_value, cb AS cost_basis, (mv - cb) / nullif(cb, 0) AS pnl_pct, mv / sum(mv) OVER () AS weight FROM j""", market_value=1, cost_basis=1, pnl_pct=6, weight=6)
def _(t):
    pos = t.ledger.where("side = 'BUY'").groupBy("symbol").agg(F.sum("quantity").alias("quantity"), (F.sum("order_value") / F.sum("quantity")).alias("avg_cost"))
    return pm.position_table(pos, t.panel_d.groupBy("symbol").agg(F.max_by("close", "trade_date").alias("price")))


@query("pm08_walk_forward", "SELECT CAST(w AS INTEGER) AS window, CAST(w * 60 AS INTEGER) AS train_start, CAST(w * 60 + 249 AS INTEGER) AS train_end, CAST(w * 60 + 309 AS INTEGER) AS test_end FROM (SELECT unnest(range(0, ((SELECT count(DISTINCT trade_date) FROM panel_l) - 310) // 60 + 1)) AS w)")
def _(t):
    out = pm.walk_forward(250, 60, t.panel_l.select("trade_date").distinct())
    return out.select("window", F.col("train_start").cast("int"), F.col("train_end").cast("int"), F.col("test_end").cast("int"))
