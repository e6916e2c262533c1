"""Time-series, cross-section, technical and alpha expressions over the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.factors import technical as ta
from quantspark.factors.alpha101 import ALPHAS
from quantspark.factors.bars import AMOUNT, CLOSE, HIGH, LOW, OPEN, RET, VOLUME
from quantspark.factors.paper import leg_spread
from quantspark.functions import expr as x
from quantspark.plans.registry import factor

_RAW = {"ts01": ("open", OPEN), "ts02": ("high", HIGH), "ts03": ("low", LOW), "ts04": ("close", CLOSE),
        "ts05": ("volume", VOLUME), "ts06": ("amount", AMOUNT)}
for _id, (_name, _node) in _RAW.items():
    factor(f"{_id}_field_{_name}", _node)
factor(
    "ts07_field_turnover", x.field("turnover"),
    bars=lambda t: t.panel_d.withColumn("turnover_rate", F.col("volume") / 1000.0),
    source="(SELECT *, volume / 1000.0 AS turnover_rate FROM panel_d)",
)

half = lambda n: max(1, n // 2)
factor("ts08_delay", x.delay(CLOSE, 3))
factor("ts09_delta", x.delta(CLOSE, 2))
factor("ts10_mean", x.mean(CLOSE, 5, half(5)))
factor("ts10_mean_long", x.mean(VOLUME, 60, half(60)), "panel_l")
factor("ts11_std", x.stdev(CLOSE, 5, half(5)))
factor("ts11_std_long", x.stdev(CLOSE, 60, half(60)), "panel_l")
factor("ts12_max", x.rmax(HIGH, 5, half(5)))
factor("ts13_min", x.rmin(LOW, 5, half(5)))
factor("ts14_sum", x.total(VOLUME, 5, half(5)))
factor("ts15_corr", x.corr(CLOSE, VOLUME, 20, half(20)))
factor("ts15_corr_long", x.corr(RET, VOLUME, 60, half(60)), "panel_l")
factor("ts16_cov", x.cov(CLOSE, VOLUME, 20, half(20)), digits=4)
factor("ts17_slope", x.slope(CLOSE, 10, 2))
factor("ts18_ts_rank", x.ts_rank(CLOSE, 10, half(10)))
factor("ts19_ts_argmax", x.argmax(HIGH, 10, half(10)))
factor("ts20_operators", -CLOSE + 2.0 * OPEN / (HIGH - LOW) * x.flag((CLOSE > OPEN) | (VOLUME >= 50.0)))

factor("cs01_rank", x.rank(CLOSE))
factor("cs01_rank_desc", x.rank(VOLUME, ascending=False))
factor("cs02_zscore", x.zscore(CLOSE))
factor("cs03_zscore_pop", x.zscore_pop(CLOSE))
factor("cs04_zscore_pop_zero", x.where(x.xstdp(CLOSE).eq(0.0), 0.0, x.zscore_pop(CLOSE)))
factor("cs05_winsorize", x.winsorize(CLOSE, 0.025))
factor(
    "cs06_winsorize_guarded",
    x.where(x.xcount(VOLUME) >= 3.0, x.winsorize(VOLUME, 0.05), VOLUME),
)

_dim = dict(
    bars=lambda t: t.panel_d.join(t.dim_d.select("symbol", "industry", "shares"), "symbol", "left"),
    source="(SELECT p.*, d.industry, d.shares FROM panel_d p LEFT JOIN dim_d d USING (symbol))",
)
IND = ("industry",)
LOG_CAP = x.log(CLOSE * x.field("shares"))
factor("cs07_industry_zscore", x.zscore_pop(CLOSE, by=IND), **_dim)
_gap = x.demean(CLOSE, by=IND)
factor(
    "cs08_industry_standardise",
    x.where(x.isnull(x.field("industry")), None,
            x.where(x.xstdp(CLOSE, by=IND).eq(0.0), 0.0, _gap / x.xstdp(CLOSE, by=IND))),
    **_dim,
)
factor("cs09_industry_neutralise", _gap, **_dim)
_ok = x.notnull(VOLUME) & x.notnull(LOG_CAP)
_y, _z = x.where(_ok, VOLUME, None), x.where(_ok, LOG_CAP, None)
factor(
    "cs10_size_neutralise",
    x.where((x.xcount(_y) >= 3.0) & (x.xmin(_z) < x.xmax(_z)),
            VOLUME - x.xintercept(_y, _z) - x.xslope(_y, _z) * LOG_CAP, None),
    **_dim,
)
factor("cs11_residual", x.residual(AMOUNT, CLOSE), digits=4)
factor("cs12_scale", x.scale(CLOSE - OPEN))


factor("cs13_style_leg_spread", leg_spread(VOLUME, AMOUNT, RET), "panel_l")
factor("cs14_market_return", x.xmean(RET))
factor("cs15_qcut", x.bucket(CLOSE, 5))

DIF, DEA, HIST = ta.macd(CLOSE)
UP, MID, DOWN = ta.bbands(CLOSE)
factor("ta01_sma", ta.sma(CLOSE, 20), "panel_l")
factor("ta02_ema", x.ema(CLOSE, 20))
factor("ta03_rsi", ta.rsi(CLOSE, 14))
factor("ta04_macd_hist", HIST)
factor("ta05_macd_dif", DIF)
factor("ta06_macd_dea", DEA)
factor("ta07_bbands_upper", UP, "panel_l")
factor("ta07_bbands_middle", MID)
factor("ta07_bbands_lower", DOWN, "panel_l")
factor("ta08_atr", ta.atr(n=14), "panel_l")
factor("ta09_natr", ta.natr(14))
factor("ta10_stoch_k", ta.stoch_k())
factor("ta11_stoch_d", ta.stoch_d())
factor("ta12_cci", ta.cci(14))
factor("ta13_willr", ta.willr(14))
factor("ta14_obv", ta.obv(), "panel_l")
factor("ta15_mom", x.delta(CLOSE, 10))
factor("ta16_min", x.rmin(CLOSE, 10))
factor("ta16_max", x.rmax(CLOSE, 10))
factor("ta17_ad", ta.ad_line(), "panel_l", digits=4)
factor("ta18_mfi", ta.mfi(14))
factor("ta19_roc", ta.roc(10))
factor("ta20_adx", ta.adx(14), "panel_l")
factor("ta21_aroonosc", ta.aroon_osc(14))
factor("ta22_typprice", ta.typical_price())

_alpha = dict(bars=lambda t: t.alpha_d, source="alpha_d")
_alpha_long = dict(bars=lambda t: t.alpha_l, source="alpha_l", panel="panel_l")
VW = x.field("vwap")
factor("ap01_rank", x.rank(VW), **_alpha)
factor("ap02_delay", x.delay(VW, 2), **_alpha)
factor("ap03_delta", x.delta(VW, 2), **_alpha)
factor("ap04_correlation", x.corr(VW, VOLUME, 6), **_alpha)
factor("ap05_covariance", x.cov(VW, VOLUME, 6), digits=4, **_alpha)
factor("ap06_scale", x.scale(VW - CLOSE), **_alpha)
factor("ap07_ts_rank", x.ts_rank(VW, 9), **_alpha)
factor("ap08_ts_min_max", x.rmax(VW, 7) - x.rmin(VW, 7), **_alpha)
factor("ap09_ts_argmin_argmax", (x.argmax(VW, 8) - 1.0) * 100.0 + x.argmin(VW, 8) - 1.0, **_alpha)
factor("ap10_sum_product_stddev", x.total(VW, 5) + x.product(x.rank(VW), 5) + x.stdev(VW, 5), **_alpha)
factor("ap11_decay_linear", x.decay_linear(VW, 8), **_alpha)
factor("ap12_adv", x.mean(VOLUME, 10), **_alpha)
factor("ap13_pair_max_min", x.greatest(x.delay(VW, 3), CLOSE) - x.least(x.delay(VW, 3), CLOSE), **_alpha)

#: alphas whose chained windows need a long history
LONG = {7, 19, 24, 31, 32, 35, 36, 37, 39, 43, 48, 52, 57, 61, 62, 63, 64, 65, 68, 69, 70, 71, 72,
        74, 75, 76, 78, 79, 81, 82, 84, 85, 86, 87, 88, 89, 90, 91, 92, 93, 94, 95, 96, 97, 98, 99}
#: alpha 84 raises a rank to a price change; prices in a large unit keep it in range
_alpha_small = dict(
    panel="panel_l",
    bars=lambda t: t.alpha_l.withColumns({c: F.col(c) * 0.00001 for c in ("close", "vwap")}),
    source="(SELECT * REPLACE (close * 0.00001 AS close, vwap * 0.00001 AS vwap) FROM alpha_l)",
)
for _name, _node in ALPHAS.items():
    _n = int(_name[-3:])
    if _n == 84:
        factor("al_084", _node, **_alpha_small)
        continue
    _digits = 2 if _n == 53 else 6  # divides by EPS on days that close at the low
    factor(f"al_{_n:03d}", _node, digits=_digits, **(_alpha_long if _n in LONG else _alpha))
