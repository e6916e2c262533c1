"""Named daily factors built on bars, fundamentals, statements and industry."""

from __future__ import annotations

from quantspark.factors.bars import AMOUNT, CLOSE, HIGH, LOW, OPEN, RET, TURNOVER, VOLUME
from quantspark.functions.expr import (
    Node, clip, coalesce, corr, delay, delta, field, flag, greatest, isnull, mean, mean_of,
    notnull, pct, rank, residual, rmax, rmin, sqrt, stdev, sum_of, total, where,
    xcount, xmean, xquantile, zscore_pop,
)

pb, pe = field("pb"), field("pe_ttm")
roe, margin = field("roe"), field("gross_margin")
assets, debt, equity = field("total_assets"), field("total_liability"), field("total_equity")
revenue, profit = field("revenue"), field("net_profit")
prev = delay(CLOSE, 1)


def positive(x) -> Node:
    return where(x > 0.0, x, None)


value_score = mean_of(rank(positive(1.0 / pb)), rank(positive(1.0 / pe)))
growth_score = mean_of(
    zscore_pop(field("revenue_yoy")), zscore_pop(field("profit_yoy")), zscore_pop(roe),
    zscore_pop(margin),
)
health_score = mean_of(
    zscore_pop(profit / assets), zscore_pop(margin), -zscore_pop(debt / assets),
    -zscore_pop(pct(assets, 252)),
)

_equity_share = coalesce(field("equity_to_assets"), equity / assets)
_debt_share = coalesce(field("debt_ratio"), debt / assets)
_net_margin = coalesce(field("net_margin"), profit / revenue)
_rev_growth = coalesce(field("quarter_revenue_yoy"), field("revenue_yoy"))
_profit_growth = coalesce(field("quarter_profit_yoy"), field("profit_yoy"))
_growth_rank = mean_of(rank(_rev_growth), rank(_profit_growth), rank(roe))


def _rsi14() -> Node:
    move = delta(CLOSE, 1)
    up = mean(where(isnull(move), None, greatest(move, 0.0)), 14, 7)
    down = mean(where(isnull(move), None, greatest(-move, 0.0)), 14, 7)
    return 100.0 - 100.0 / (1.0 + up / down)


def _high_low_volume() -> Node:
    top, bottom, peak = rmax(CLOSE, 120, 60), rmin(CLOSE, 120, 60), rmax(VOLUME, 120, 60)
    where_in_range = clip((CLOSE - bottom) / (top - bottom), 0.0, 1.0)
    share = VOLUME / peak
    return where(share >= 0.9, (1.0 - 2.0 * where_in_range) * share, 0.0)


MARKET = xmean(RET)
_beta = total(RET * MARKET, 252, 126) / total(MARKET * MARKET, 252, 126)
_resid = RET - _beta * MARKET


def _semibeta(side) -> Node:
    """Beta over the market days on one side, given at least 40 of them."""
    hit = flag(side)
    top = total(where(side, RET * MARKET, 0.0), 252, 126)
    bottom = total(where(side, MARKET * MARKET, 0.0), 252, 126)
    return where(total(hit, 252, 126) >= 40.0, top / bottom, None)


_up_beta, _down_beta = _semibeta(MARKET > 0.0), _semibeta(MARKET < 0.0)


def _limit_quality() -> Node:
    """Six ranks around limit-up days over the last 20 bars (fallback limits +-9.5 %)."""
    up = where(field("up_limit") > 0.0, field("up_limit"), prev * 1.095)
    down = where(field("down_limit") > 0.0, field("down_limit"), prev * 0.905)
    sealed = flag((up > 0.0) & (CLOSE >= up - 1e-4))
    floored = flag((down > 0.0) & (CLOSE <= down + 1e-4))
    touched = flag((up > 0.0) & (HIGH >= up - 1e-4))
    opened = flag((touched > 0.0) & (sealed < 0.5))
    after = coalesce(delay(sealed, 1), 0.0) > 0.5
    location = clip((CLOSE - LOW) / (HIGH - LOW), 0.0, 1.0)
    touch_20, open_20 = total(touched, 20, 10), total(opened, 20, 10)
    return mean_of(
        rank(coalesce((total(sealed, 20, 10) - open_20) / touch_20, 0.0)),
        rank(coalesce(mean(where(after, RET, None), 20, 3), 0.0)),
        rank(coalesce(mean(where(after, flag(RET > 0.0), None), 20, 3), 0.5)),
        rank(coalesce(-(open_20 / touch_20), 0.0)),
        rank(-total(floored, 20, 10)),
        rank(coalesce(mean(where(after, location, None), 20, 3), 0.5)),
    )


def _size_rotation() -> Node:
    size = rank(coalesce(field("circ_mv"), field("total_mv")))
    ret20 = pct(CLOSE, 20)
    ok = notnull(size) & notnull(ret20)
    small = xmean(where(ok & (size <= 0.33), ret20, None))
    large = xmean(where(ok & (size >= 0.67), ret20, None))
    spread = where(xcount(where(ok, ret20, None)) >= 6.0, small - large, None)
    return where(isnull(spread) | isnull(size), None, where(spread >= 0.0, 1.0 - size, size))


def leg_spread(a, b, r, q=0.8) -> Node:
    """Mean return of the top fifth by a minus that by b (at least three names each)."""
    in_a, in_b = where(isnull(r), None, a), where(isnull(r), None, b)
    top_a = xmean(where(in_a >= xquantile(in_a, q), r, None))
    top_b = xmean(where(in_b >= xquantile(in_b, q), r, None))
    return where((xcount(in_a) >= 3.0) & (xcount(in_b) >= 3.0), top_a - top_b, None)


def _style_rotation() -> Node:
    spread = leg_spread(growth_score, value_score, pct(CLOSE, 20))
    return where(isnull(spread), None, where(spread >= 0.0, growth_score, value_score))


def _industry_momentum() -> Node:
    average = xmean(pct(CLOSE, 20), by=("industry",))
    return rank(where(field("has_industry") > 0.0, average, None))


_vol60 = stdev(RET, 60, 20)
_drawdown = CLOSE / rmax(CLOSE, 60, 20) - 1.0
_overnight = OPEN / prev - 1.0
_range = HIGH / LOW - 1.0

PAPER_FACTORS: dict[str, Node] = {
    "paper_pb_roe_residual": residual(1.0 / pb, roe),
    "paper_composite_value": value_score,
    "paper_growth_quality_score": growth_score,
    "paper_financial_health_score": health_score,
    "tsmf_recent_effective_score": sum_of(
        rank(growth_score) * 0.40, rank(value_score) * 0.35, rank(health_score) * 0.25, at_least=2
    ),
    "asset_backed_value_proxy_pit": mean_of(
        1.0 - rank(pb), rank(_equity_share), 1.0 - rank(_debt_share), rank(roe)
    ),
    "balance_sheet_quality_value_pit": mean_of(
        1.0 - rank(pb), rank(_equity_share), 1.0 - rank(_debt_share), rank(_net_margin)
    ),
    "growth_duration_proxy_pit": mean_of(rank(_rev_growth), rank(_profit_growth), rank(pb)),
    "garp_duration_proxy_pit": _growth_rank - rank(pb),
    "earnings_revenue_accel_pit": field("revenue_accel"),
    "earnings_surprise_combo_pit": mean_of(
        rank(field("revenue_accel")), rank(field("profit_accel")), rank(field("roe_yoy_change"))
    ),
    "paper_overnight_turnover_corr": corr(abs(_overnight), TURNOVER, 20, 10),
    "paper_rsi_reversal_score": -_rsi14() * clip(VOLUME / mean(VOLUME, 20, 5), 0.25, 4.0),
    "paper_new_high_anchor": where(
        isnull(rmax(CLOSE, 240, 120)), None, flag(CLOSE >= rmax(CLOSE, 240, 120) * 0.999)
    ),
    "paper_high_low_volume_event": _high_low_volume(),
    "paper_reversal_20d": -pct(CLOSE, 20),
    "low_beta_252": -_beta,
    "low_idio_vol_60": -stdev(_resid, 60, 30),
    "semibeta_upside_capture_252": _up_beta,
    "semibeta_downside_avoid_252": -_down_beta,
    "semibeta_asymmetry_252": _up_beta - _down_beta,
    "jump_intraday_tail_20d": -mean(where(_range > 0.06, _range, 0.0), 20, 10),
    "elasticity_amount_resilience_20d": mean(AMOUNT, 20, 10) / stdev(RET, 20, 10),
    "overnight_momentum_20": mean(_overnight, 20, 10),
    "amihud_low_impact_20": -mean(abs(RET) / AMOUNT, 20, 10),
    "low_max_return_20": -rmax(RET, 20, 10),
    "low_downside_vol_60": -sqrt(mean(where(RET < 0.0, RET * RET, None), 60, 15)),
    "return_autocorr_20": corr(RET, delay(RET, 1), 20, 10),
    "momentum_120_skip20": pct(CLOSE, 120) - pct(CLOSE, 20),
    "limit_ecology_quality_combo": _limit_quality(),
    "paper_size_rotation_score": _size_rotation(),
    "paper_value_growth_rotation_score": _style_rotation(),
    "paper_industry_momentum_20d": _industry_momentum(),
    "paper_defensive_quality_lowvol": mean_of(zscore_pop(health_score), -zscore_pop(_vol60)),
    "paper_asset_allocation_proxy": mean_of(
        zscore_pop(pct(CLOSE, 60)), -zscore_pop(_vol60), zscore_pop(_drawdown)
    ),
}
