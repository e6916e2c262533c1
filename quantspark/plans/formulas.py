"""Factor formulas written by hand in SQL, as oracles that share nothing with the expressions.

A formula is a view and steps; each step names new columns over the step before, and the last one
names ``value``. ``full`` is the rule that a window of n bars counts only when all n are present.
"""

from __future__ import annotations

from quantspark.plans.registry import ORACLES, QUERIES, tidy_sql

BY = "PARTITION BY symbol ORDER BY trade_date"
EVER = f"({BY} ROWS UNBOUNDED PRECEDING)"


def back(n: int) -> str:
    return f"({BY} ROWS {n - 1} PRECEDING)"


def prev(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({BY})"


def full(fn: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {back(n)} = {n} THEN {fn}({x}) OVER {back(n)} END"


def full2(fn: str, x: str, y: str, n: int) -> str:
    """A statistic of pairs; a correlation with a constant side has no value."""
    pairs = f"count(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END) OVER {back(n)} = {n}"
    varied = "" if fn != "corr" else "".join(f" AND min({v}) OVER {back(n)} < max({v}) OVER {back(n)}" for v in (x, y))
    return f"CASE WHEN {pairs}{varied} THEN round({fn}({x}, {y}) OVER {back(n)}, 10) END"


def ranked(x: str) -> str:
    """Share of the date's values up to this one; values equal in ten decimals share their mean place."""
    x = f"round({x}, 10)"
    place = f"rank() OVER (PARTITION BY trade_date, ({x}) IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY trade_date, {x}) - 1) / 2.0"
    return f"CASE WHEN ({x}) IS NOT NULL THEN ({place}) / count({x}) OVER (PARTITION BY trade_date) END"


def ranked_in_time(x: str, n: int) -> str:
    held = f"list({x}) OVER {back(n)}"
    less, same = (f"len(list_filter({held}, lambda v: v {op} {x}))" for op in ("<", "="))
    return f"CASE WHEN count({x}) OVER {back(n)} = {n} THEN ({less} + ({same} + 1) / 2.0) / {n} END"


def folded(x: str, span: int) -> str:
    """The exponential mean as the recurrence says it."""
    a = 2.0 / (span + 1)
    return f"list_reduce(list({x}) OVER {EVER}, lambda e, v: e * (1 - {a}) + v * {a})"


def place_of(fn: str, x: str, n: int) -> str:
    """The place, from 1, of the first greatest or least value of the last n."""
    return f"CASE WHEN count({x}) OVER {back(n)} = {n} THEN list_position(list({x}) OVER {back(n)}, {fn}({x}) OVER {back(n)}) END"


def text(view: str, *steps: dict[str, str]) -> str:
    """The steps over one another; a step may give a column of an earlier one a new value."""
    known: set[str] = set()
    sql = view
    for step in steps:
        new = ", ".join(f"{e} AS {n}" for n, e in step.items() if n not in known)
        old = ", ".join(f"{e} AS {n}" for n, e in step.items() if n in known)
        star = f"* REPLACE ({old})" if old else "*"
        sql = f"(SELECT {star}{', ' + new if new else ''} FROM {sql})"
        known |= set(step)
    return f"SELECT symbol, trade_date, value FROM {sql}"


TRUE_RANGE = {"pc": prev("close")}, {"tr": "greatest(high - low, abs(high - pc), abs(low - pc))"}
TYPICAL = {"tp": "(high + low + close) / 3"}
STOCH = {"lo": full("min", "low", 9), "hi": full("max", "high", 9)}, {"raw": "100 * (close - lo) / nullif(hi - lo, 0)"}
MACD = {"fast": folded("close", 12), "slow": folded("close", 26)}, {"dif": "fast - slow"}, {"dea": folded("dif", 9)}
BANDS = {"middle": full("avg", "close", 20), "dev": full("stddev_samp", "close", 20)}
RETURNS = {"r": f"close / nullif({prev('close')}, 0) - 1"}, {"m": "avg(r) OVER (PARTITION BY trade_date)"}
BETA60 = {"b": f"({full2('covar_samp', 'r', 'm', 60)}) / nullif({full('var_samp', 'm', 60)}, 0)"}, {"e": "r - b * m"}

TECHNICAL = {
    "ta01_sma": ("panel_l", {"value": full("avg", "close", 20)}),
    "ta02_ema": ("panel_d", {"value": folded("close", 20)}),
    "ta03_rsi": (
        "panel_d", {"c": f"close - {prev('close')}"},
        {"up": "CASE WHEN c > 0 THEN c WHEN c <= 0 THEN 0 END", "down": "CASE WHEN c < 0 THEN -c WHEN c >= 0 THEN 0 END"},
        {"up": full("avg", "up", 14), "down": full("avg", "down", 14)},
        {"value": "CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END"}),
    "ta04_macd_hist": ("panel_d", *MACD, {"value": "dif - dea"}),
    "ta05_macd_dif": ("panel_d", *MACD, {"value": "dif"}),
    "ta06_macd_dea": ("panel_d", *MACD, {"value": "dea"}),
    "ta07_bbands_upper": ("panel_l", BANDS, {"value": "middle + 2 * dev"}),
    "ta07_bbands_middle": ("panel_d", BANDS, {"value": "middle"}),
    "ta07_bbands_lower": ("panel_l", BANDS, {"value": "middle - 2 * dev"}),
    "ta08_atr": ("panel_l", *TRUE_RANGE, {"value": full("avg", "tr", 14)}),
    "ta09_natr": ("panel_d", *TRUE_RANGE, {"atr": full("avg", "tr", 14)}, {"value": "atr / CASE WHEN abs(close) > 1e-8 THEN close END * 100"}),
    "ta10_stoch_k": ("panel_d", *STOCH, {"value": full("avg", "raw", 3)}),
    "ta11_stoch_d": ("panel_d", *STOCH, {"k": full("avg", "raw", 3)}, {"value": full("avg", "k", 3)}),
    "ta12_cci": (
        "panel_d", TYPICAL, {"mean_": full("avg", "tp", 14), "held": f"list(tp) OVER {back(14)}"},
        {"value": "(tp - mean_) / nullif(0.015 * list_avg(list_transform(held, lambda v: abs(v - mean_))), 0)"}),
    "ta13_willr": ("panel_d", {"hi": full("max", "high", 14), "lo": full("min", "low", 14)}, {"value": "-100 * (hi - close) / nullif(hi - lo, 0)"}),
    "ta14_obv": ("panel_l", {"c": f"coalesce(close - {prev('close')}, 0)"}, {"value": f"sum(sign(c) * volume) OVER {EVER}"}),
    "ta15_mom": ("panel_d", {"value": f"close - {prev('close', 10)}"}),
    "ta16_min": ("panel_d", {"value": full("min", "close", 10)}),
    "ta16_max": ("panel_d", {"value": full("max", "close", 10)}),
    "ta18_mfi": (
        "panel_d", TYPICAL, {"move": f"tp - {prev('tp')}", "flow": "tp * volume"},
        {"plus": "CASE WHEN move > 0 THEN flow ELSE 0 END", "minus": "CASE WHEN move < 0 THEN flow ELSE 0 END"},
        {"plus": full("sum", "plus", 14), "minus": full("sum", "minus", 14)}, {"value": "100 - 100 / (1 + plus / nullif(minus, 0))"}),
    "ta19_roc": ("panel_d", {"value": f"(close / nullif({prev('close', 10)}, 0) - 1) * 100"}),
    "ta20_adx": (
        "panel_l", *TRUE_RANGE, {"up": f"high - {prev('high')}", "down": f"{prev('low')} - low"},
        {"plus": "CASE WHEN up > down AND up > 0 THEN up ELSE 0 END", "minus": "CASE WHEN down > up AND down > 0 THEN down ELSE 0 END"},
        {"width": full("avg", "tr", 14), "plus": full("avg", "plus", 14), "minus": full("avg", "minus", 14)},
        {"plus": "100 * plus / nullif(width, 0)", "minus": "100 * minus / nullif(width, 0)"},
        {"dx": "abs(plus - minus) / nullif(plus + minus, 0) * 100"}, {"value": full("avg", "dx", 14)}),
    "ta21_aroonosc": (
        "panel_d", {"top": place_of("max", "high", 14), "bottom": place_of("min", "low", 14)},
        {"value": "(14 - bottom) / 14 * 100 - (14 - top) / 14 * 100"}),
    "ta22_typprice": ("panel_d", TYPICAL, {"value": "tp"}),
}

RESEARCH = {
    "rf01_research_short_reversal": ("panel_d", {"value": f"-(close / nullif({prev('close', 5)}, 0) - 1)"}),
    "rf02_research_turnover_liquidity": ("panel_d", {"a": full("avg", "amount", 20), "v": full("avg", "volume", 20)}, {"value": "a / nullif(v, 0)"}),
    "rf03_research_low_beta": ("panel_l", *RETURNS, {"c": full2("covar_samp", "r", "m", 252), "v": full("var_samp", "m", 252)}, {"value": "-(c / nullif(v, 0))"}),
    "rf04_research_idiosyncratic_volatility": ("panel_l", *RETURNS, *BETA60, {"s": full("stddev_samp", "e", 60)}, {"value": "-s"}),
    "rf05_research_residual_momentum": ("panel_l", *RETURNS, *BETA60, {"long_": full("sum", "e", 252), "short_": full("sum", "e", 21)}, {"value": "long_ - short_"}),
    "rf06_research_gross_profitability": ("research_l", {"value": "revenue * (gross_margin / 100) / nullif(total_assets, 0)"}),
    "rf07_research_asset_growth": ("research_l", {"value": f"total_assets / nullif({prev('total_assets', 4)}, 0) - 1"}),
    "rf08_research_accruals": (
        "research_l", {"a": f"total_assets - {prev('total_assets', 4)}", "d": f"total_liability - {prev('total_liability', 4)}"},
        {"value": "(a - d - net_profit) / nullif(total_assets, 0)"}),
}

#: the published formulas; denominators carry the library's 1e-8
ALPHA = {
    "al_003": ("alpha_d", {"a": ranked("open"), "b": ranked("volume")}, {"x": full2("corr", "a", "b", 10)}, {"value": "-x"}),
    "al_004": ("alpha_d", {"a": ranked("low")}, {"x": ranked_in_time("a", 9)}, {"value": "-x"}),
    "al_005": ("alpha_d", {"s": full("sum", "vwap", 10)}, {"a": "open - s / 10", "b": "close - vwap"}, {"a": ranked("a"), "b": ranked("b")}, {"value": "a * -abs(b)"}),
    "al_006": ("alpha_d", {"x": full2("corr", "open", "volume", 10)}, {"value": "-x"}),
    "al_009": (
        "alpha_d", {"d": f"close - {prev('close')}"}, {"lo": full("min", "d", 5), "hi": full("max", "d", 5)},
        {"value": "CASE WHEN lo IS NULL THEN NULL WHEN lo > 0 OR hi < 0 THEN d ELSE -d END"}),
    "al_012": ("alpha_d", {"value": f"sign(volume - {prev('volume')}) * -(close - {prev('close')})"}),
    "al_013": ("alpha_d", {"a": ranked("close"), "b": ranked("volume")}, {"x": full2("covar_samp", "a", "b", 5)}, {"x": ranked("x")}, {"value": "-x"}),
    "al_016": ("alpha_d", {"a": ranked("high"), "b": ranked("volume")}, {"x": full2("covar_samp", "a", "b", 5)}, {"x": ranked("x")}, {"value": "-x"}),
    "al_020": (
        "alpha_d", {"a": f"open - {prev('high')}", "b": f"open - {prev('close')}", "c": f"open - {prev('low')}"},
        {"a": ranked("a"), "b": ranked("b"), "c": ranked("c")}, {"value": "-a * b * c"}),
    "al_023": (
        "alpha_d", {"s": full("sum", "high", 20), "d": f"high - {prev('high', 2)}"},
        {"value": "CASE WHEN s IS NULL THEN NULL WHEN s / 20 < high THEN -d ELSE 0 END"}),
    "al_025": ("alpha_d", {"v": full("avg", "volume", 20)}, {"x": "-ret * v * vwap * (high - close)"}, {"value": ranked("x")}),
    "al_033": ("alpha_d", {"x": "-(1 - open / (close + 1e-8))"}, {"value": ranked("x")}),
    "al_041": ("alpha_d", {"value": "sqrt(high * low) - vwap"}),
    "al_042": ("alpha_d", {"a": "vwap - close", "b": "vwap + close"}, {"a": ranked("a"), "b": ranked("b")}, {"value": "a / (b + 1e-8)"}),
    "al_044": ("alpha_d", {"a": ranked("volume")}, {"x": full2("corr", "high", "a", 5)}, {"value": "-x"}),
    "al_054": ("alpha_d", {"value": "-((low - close) * open ** 5) / ((low - high) * close ** 5 + 1e-8)"}),
    "al_101": ("alpha_d", {"value": "(close - open) / (high - low + 0.001)"}),
}


def register() -> None:
    """Puts the formulas in the place of the generated oracles."""
    for name, (view, *steps) in {**TECHNICAL, **RESEARCH, **ALPHA}.items():
        if name not in QUERIES:
            raise ValueError(f"no query {name}")
        ORACLES[name] = tidy_sql(text(view, *steps), {"value": 6})
