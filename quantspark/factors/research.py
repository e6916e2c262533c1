"""Research factors: reversal, liquidity, beta, residual momentum, profitability."""

from __future__ import annotations

from quantspark.factors.bars import AMOUNT, CLOSE, RET, VOLUME
from quantspark.functions.expr import (
    Node, cov, delay, delta, field, mean, pct, stdev, total, variance, xmean,
)

MARKET = xmean(RET)


def beta(n: int) -> Node:
    return cov(RET, MARKET, n) / variance(MARKET, n)


_resid = RET - beta(60) * MARKET
_assets, _debt = field("total_assets"), field("total_liability")

RESEARCH_FACTORS: dict[str, Node] = {
    "research_short_reversal": -pct(CLOSE, 5),
    "research_turnover_liquidity": mean(AMOUNT, 20) / mean(VOLUME, 20),
    "research_low_beta": -beta(252),
    "research_idiosyncratic_volatility": -stdev(_resid, 60),
    "research_residual_momentum": total(_resid, 252) - total(_resid, 21),
    "research_gross_profitability": field("revenue") * (field("gross_margin") / 100.0) / _assets,
    "research_asset_growth": _assets / delay(_assets, 4) - 1.0,
    "research_accruals": (delta(_assets, 4) - delta(_debt, 4) - field("net_profit")) / _assets,
}
