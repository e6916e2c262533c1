"""The 101 formulaic alphas (Kakushadze 2015) as factor expressions.

Fractional windows of the published text are rounded to whole bars and ``EPS`` is added
to most denominators. Where a published outer rank or factor order differs in practice
(10, 11, 18, 48, 52 among others) the computed variant is the one given here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.bars import CLOSE as c
from quantspark.factors.bars import HIGH as h
from quantspark.factors.bars import LOW as l
from quantspark.factors.bars import OPEN as o
from quantspark.factors.bars import VOLUME as v
from quantspark.functions.expr import (
    Node, argmax, argmin, corr, cov, decay_linear, delay, delta, demean, field, flag, greatest,
    isnull, least, log, mean, product, rank, rmax, rmin, scale, sign, stdev, total, ts_rank,
    where,
)

EPS = 1e-8
vwap, ret, cap = field("vwap"), field("ret"), field("market_value")
mid = (h + l) / 2.0


def adv(n: int) -> Node:
    """Average traded volume in shares."""
    return mean(v, n)


def ind(x) -> Node:
    return demean(x, by=("industry",))


def blend(a, b, weight) -> Node:
    return a * weight + b * (1 - weight)


def lower(a, b, signed=-1.0) -> Node:
    """1 where a < b, scaled by ``signed``; NULL when either side is."""
    return where(isnull(a) | isnull(b), None, flag(a < b) * signed)


def unless_null(x, value) -> Node:
    return where(isnull(x), None, value)


def turn(n: int) -> Node:
    return v / (adv(n) + EPS)


def swing(n: int) -> Node:
    """Daily change kept when the last n changes agree in sign, reversed otherwise."""
    move = delta(c, 1)
    low_, high_ = rmin(move, n), rmax(move, n)
    return unless_null(low_, where(low_ > 0.0, move, where(high_ < 0.0, move, -move)))


def bend() -> Node:
    """Change of the 10-bar slope of close."""
    return (delay(c, 20) - delay(c, 10)) / 10.0 - (delay(c, 10) - c) / 10.0


def bent(limit: float) -> Node:
    b = bend()
    return unless_null(b, where(b < limit, 1.0, -delta(c, 1)))


def close_location() -> Node:
    return ((c - l) - (h - c)) / (h - l + EPS)


def _formulas() -> dict[int, Node]:
    a: dict[int, Node] = {}
    a[1] = rank(argmax(where(ret < 0.0, stdev(ret, 20), c) ** 2.0, 5)) - 0.5
    a[2] = -corr(rank(delta(log(v), 2)), rank((c - o) / (o + EPS)), 6)
    a[3] = -corr(rank(o), rank(v), 10)
    a[4] = -ts_rank(rank(l), 9)
    a[5] = rank(o - total(vwap, 10) / 10.0) * -abs(rank(c - vwap))
    a[6] = -corr(o, v, 10)
    d7 = delta(c, 7)
    a[7] = unless_null(adv(20), where(adv(20) < v, ts_rank(abs(d7), 60) * sign(d7), -1.0))
    s8 = total(o, 5) * total(ret, 5)
    a[8] = -rank(s8 - delay(s8, 10))
    a[9], a[10] = swing(5), swing(4)
    gap = vwap - c
    a[11] = rank(rmax(gap, 3)) + rank(rmin(gap, 3)) * rank(delta(v, 3))
    a[12] = sign(delta(v, 1)) * -delta(c, 1)
    a[13] = -rank(cov(rank(c), rank(v), 5))
    a[14] = -rank(delta(ret, 3)) * corr(o, v, 10)
    a[15] = -total(rank(corr(rank(h), rank(v), 3)), 3)
    a[16] = -rank(cov(rank(h), rank(v), 5))
    a[17] = -rank(ts_rank(c, 10)) * rank(delta(delta(c, 1), 1)) * rank(ts_rank(turn(20), 5))
    a[18] = corr(c, o, 10) - rank(stdev(abs(c - o), 5) + (c - o))
    a[19] = -sign(c - delay(c, 7) + delta(c, 7)) * (1.0 + rank(1.0 + total(ret, 250)))
    a[20] = -rank(o - delay(h, 1)) * rank(o - delay(c, 1)) * rank(o - delay(l, 1))
    m8, d8, m2 = total(c, 8) / 8.0, stdev(c, 8), total(c, 2) / 2.0
    side = where(m2 < m8 - d8, 1.0, where(turn(20) >= 1.0, 1.0, -1.0))
    a[21] = unless_null(m8 + d8 + m2, where(m8 + d8 < m2, -1.0, side))
    a[22] = -delta(corr(h, v, 5), 5) * rank(stdev(c, 20))
    h20 = total(h, 20)
    a[23] = unless_null(h20, where(h20 / 20.0 < h, -delta(h, 2), 0.0))
    drift = delta(total(c, 100) / 100.0, 100) / (delay(c, 100) + EPS)
    a[24] = unless_null(drift, where(drift <= 0.05, rmin(c, 100) - c, -delta(c, 3)))
    a[25] = rank(-ret * adv(20) * vwap * (h - c))
    a[26] = -rmax(corr(ts_rank(v, 5), ts_rank(h, 5), 5), 3)
    r27 = rank(total(corr(rank(v), rank(vwap), 6), 2) / 2.0)
    a[27] = unless_null(r27, where(r27 > 0.5, -1.0, 1.0))
    a[28] = scale(corr(adv(20), l, 5) + mid - c)
    core = rmin(rank(rank(-rank(delta(c - 1.0, 5)))), 2)
    a[29] = rmin(rank(rank(scale(log(total(core, 1))))), 5) + ts_rank(delay(-ret, 6), 5)
    steps = sign(delta(c, 1)) + sign(delay(c, 1) - delay(c, 2)) + sign(delay(c, 2) - delay(c, 3))
    a[30] = (1.0 - rank(steps)) * total(v, 5) / (total(v, 20) + EPS)
    slow = rank(rank(rank(decay_linear(-rank(rank(delta(c, 10))), 10))))
    a[31] = slow + rank(-delta(c, 3)) + sign(scale(corr(adv(20), l, 12)))
    a[32] = scale(total(c, 7) / 7.0 - c) + 20.0 * scale(corr(vwap, delay(c, 5), 230))
    a[33] = rank(-(1.0 - o / (c + EPS)))
    a[34] = rank(
        (1.0 - rank(stdev(ret, 2) / (stdev(ret, 5) + EPS))) + (1.0 - rank(delta(c, 1)))
    )
    a[35] = ts_rank(v, 32) * (1.0 - ts_rank(c + h - l, 16)) * (1.0 - ts_rank(ret, 32))
    a[36] = (
        2.21 * rank(corr(c - o, delay(v, 1), 15))
        + 0.7 * rank(o - c)
        + 0.73 * rank(ts_rank(delay(-ret, 6), 5))
        + rank(abs(corr(vwap, adv(20), 6)))
        + 0.6 * rank((total(c, 200) / 200.0 - o) * (c - o))
    )
    a[37] = rank(corr(delay(o - c, 1), c, 200)) + rank(o - c)
    a[38] = -rank(ts_rank(c, 10)) * rank(c / (o + EPS))
    fade = 1.0 - rank(decay_linear(turn(20), 9))
    a[39] = -rank(delta(c, 7) * fade) * (1.0 + rank(total(ret, 250)))
    a[40] = -rank(stdev(h, 10)) * corr(h, v, 10)
    a[41] = (h * l) ** 0.5 - vwap
    a[42] = rank(vwap - c) / (rank(vwap + c) + EPS)
    a[43] = ts_rank(turn(20), 20) * ts_rank(-delta(c, 7), 8)
    a[44] = -corr(h, rank(v), 5)
    a[45] = (
        -rank(total(delay(c, 5), 20) / 20.0)
        * corr(c, v, 2)
        * rank(corr(total(c, 5), total(c, 20), 2))
    )
    b46 = bend()
    a[46] = unless_null(b46, where(b46 > 0.25, -1.0, where(b46 < 0.0, 1.0, -delta(c, 1))))
    a[47] = rank(1.0 / (c + EPS)) * v / (adv(20) + EPS) * (
        h * rank(h - c) / (total(h, 5) / 5.0)
    ) - rank(vwap - delay(vwap, 5))
    prev = delay(c, 1)
    echo = corr(delta(c, 1), delta(prev, 1), 250) * delta(c, 1) / (c + EPS)
    a[48] = ind(echo) / (total(delta(c, 1) / (prev ** 2.0 + EPS), 250) + EPS)
    a[49], a[51] = bent(-0.1), bent(-0.05)
    a[50] = -rmax(rank(corr(rank(v), rank(vwap), 5)), 5)
    a[52] = -rmin(l, 5) + (
        delay(rmin(l, 5), 5) * rank((total(ret, 240) - total(ret, 20)) / 220.0) * ts_rank(v, 5)
    )
    a[53] = -delta(((c - l) - (h - c)) / (c - l + EPS), 9)
    a[54] = -((l - c) * o ** 5.0) / ((l - h) * c ** 5.0 + EPS)
    inside = (c - rmin(l, 12)) / (rmax(h, 12) - rmin(l, 12) + EPS)
    a[55] = -corr(rank(inside), rank(v), 6)
    a[56] = -rank(total(ret, 10) / total(total(ret, 2), 3)) * rank(ret * cap)
    a[57] = -(c - vwap) / (decay_linear(rank(argmax(c, 30)), 2) + EPS)
    a[58] = -ts_rank(decay_linear(corr(ind(vwap), v, 4), 8), 6)
    a[59] = -ts_rank(decay_linear(corr(ind(vwap), v, 4), 16), 8)
    a[60] = -(2.0 * scale(rank(close_location() * v)) - scale(rank(argmax(c, 10))))
    a[61] = lower(rank(vwap - rmin(vwap, 16)), rank(corr(vwap, adv(180), 18)), 1.0)
    twice = flag(rank(o) + rank(o) < rank(mid) + rank(h))
    a[62] = lower(rank(corr(vwap, total(adv(20), 22), 10)), rank(twice))
    a[63] = -(
        rank(decay_linear(delta(ind(c), 2), 8))
        - rank(decay_linear(corr(blend(vwap, o, 0.318108), total(adv(180), 37), 14), 12))
    )
    a[64] = lower(
        rank(corr(total(blend(o, l, 0.178404), 13), total(adv(120), 13), 17)),
        rank(delta(blend(mid, vwap, 0.178404), 4)),
    )
    a[65] = lower(
        rank(corr(blend(o, vwap, 0.00817205), total(adv(60), 9), 6)), rank(o - rmin(o, 14))
    )
    a[66] = -(
        rank(decay_linear(delta(vwap, 4), 7))
        + ts_rank(decay_linear((l - vwap) / (o - mid + EPS), 11), 7)
    )
    a[67] = -(rank(h - rmin(h, 2)) ** rank(corr(ind(vwap), ind(adv(20)), 6)))
    a[68] = lower(
        ts_rank(corr(rank(h), rank(adv(15)), 9), 14), rank(delta(blend(c, l, 0.518371), 1))
    )
    a[69] = -(
        rank(rmax(delta(ind(vwap), 3), 5)) ** ts_rank(corr(blend(c, vwap, 0.490655), adv(20), 5), 9)
    )
    a[70] = -(rank(delta(vwap, 1)) ** ts_rank(corr(ind(c), adv(50), 18), 18))
    a[71] = greatest(
        ts_rank(decay_linear(corr(ts_rank(c, 3), ts_rank(adv(180), 12), 18), 4), 16),
        ts_rank(decay_linear(rank((l + o) - 2.0 * vwap) ** 2.0, 16), 4),
    )
    a[72] = rank(decay_linear(corr(mid, adv(40), 9), 10)) / (
        rank(decay_linear(corr(ts_rank(vwap, 4), ts_rank(v, 19), 7), 3)) + EPS
    )
    base = blend(o, l, 0.147155)
    a[73] = -greatest(
        rank(decay_linear(delta(vwap, 5), 3)),
        ts_rank(decay_linear(-delta(base, 2) / (base + EPS), 3), 17),
    )
    a[74] = lower(
        rank(corr(c, total(adv(30), 37), 15)),
        rank(corr(rank(blend(h, vwap, 0.0261661)), rank(v), 11)),
    )
    a[75] = lower(rank(corr(vwap, v, 4)), rank(corr(rank(l), rank(adv(50)), 12)), 1.0)
    a[76] = -greatest(
        rank(decay_linear(delta(vwap, 1), 12)),
        ts_rank(decay_linear(ts_rank(corr(ind(l), adv(81), 8), 20), 17), 19),
    )
    a[77] = least(
        rank(decay_linear(mid - vwap, 20)), rank(decay_linear(corr(mid, adv(40), 3), 6))
    )
    a[78] = rank(corr(total(blend(l, vwap, 0.352233), 20), total(adv(40), 20), 7)) ** rank(
        corr(rank(vwap), rank(v), 6)
    )
    a[79] = lower(
        rank(delta(ind(blend(c, o, 0.60733)), 1)),
        rank(corr(ts_rank(vwap, 4), ts_rank(adv(150), 9), 15)),
        1.0,
    )
    a[80] = -(
        rank(sign(delta(ind(blend(o, h, 0.868128)), 4))) ** ts_rank(corr(h, adv(10), 5), 6)
    )
    chain = product(rank(rank(corr(vwap, total(adv(10), 50), 8)) ** 4.0), 15)
    a[81] = lower(
        rank(log(unless_null(chain, greatest(chain, EPS)))), rank(corr(rank(vwap), rank(v), 5))
    )
    a[82] = -least(
        rank(decay_linear(delta(o, 1), 15)), ts_rank(decay_linear(corr(ind(v), o, 17), 7), 13)
    )
    spread = (h - l) / (total(c, 5) / 5.0 + EPS)
    a[83] = rank(delay(spread, 2)) * rank(rank(v)) / (spread / (vwap - c + EPS) + EPS)
    a[84] = ts_rank(vwap - rmax(vwap, 15), 21) ** delta(c, 5)
    a[85] = rank(corr(blend(h, c, 0.876703), adv(30), 10)) ** rank(
        corr(ts_rank(mid, 4), ts_rank(v, 10), 7)
    )
    a[86] = lower(ts_rank(corr(c, total(adv(20), 15), 6), 20), rank((o + c) - (vwap + o)))
    a[87] = -greatest(
        rank(decay_linear(delta(blend(c, vwap, 0.369701), 2), 3)),
        ts_rank(decay_linear(abs(corr(ind(adv(81)), c, 13)), 5), 14),
    )
    a[88] = least(
        rank(decay_linear((rank(o) + rank(l)) - (rank(h) + rank(c)), 8)),
        ts_rank(decay_linear(corr(ts_rank(c, 8), ts_rank(adv(60), 21), 8), 7), 3),
    )
    a[89] = ts_rank(decay_linear(corr(l, adv(10), 7), 6), 4) - ts_rank(
        decay_linear(delta(ind(vwap), 3), 10), 15
    )
    a[90] = -(rank(c - rmax(c, 5)) ** ts_rank(corr(ind(adv(40)), l, 5), 3))
    a[91] = -(
        ts_rank(decay_linear(decay_linear(corr(ind(c), v, 10), 16), 4), 5)
        - rank(decay_linear(corr(vwap, adv(30), 4), 3))
    )
    a[92] = least(
        ts_rank(decay_linear(flag(mid + c < l + o), 15), 19),
        ts_rank(decay_linear(corr(rank(l), rank(adv(30)), 8), 7), 7),
    )
    a[93] = ts_rank(decay_linear(corr(ind(vwap), adv(81), 17), 20), 8) / (
        rank(decay_linear(delta(blend(c, vwap, 0.524434), 3), 16)) + EPS
    )
    a[94] = -(
        rank(vwap - rmin(vwap, 12)) ** ts_rank(corr(ts_rank(vwap, 20), ts_rank(adv(60), 4), 18), 3)
    )
    a[95] = lower(
        rank(o - rmin(o, 12)),
        ts_rank(rank(corr(total(mid, 19), total(adv(40), 19), 13)) ** 5.0, 12),
        1.0,
    )
    a[96] = -greatest(
        ts_rank(decay_linear(corr(rank(vwap), rank(v), 4), 4), 8),
        ts_rank(decay_linear(argmax(corr(ts_rank(c, 7), ts_rank(adv(60), 4), 4), 13), 14), 13),
    )
    a[97] = -(
        rank(decay_linear(delta(ind(blend(l, vwap, 0.721001)), 3), 20))
        - ts_rank(
            decay_linear(ts_rank(corr(ts_rank(l, 8), ts_rank(adv(60), 17), 5), 19), 16), 7
        )
    )
    a[98] = rank(decay_linear(corr(vwap, total(adv(5), 26), 5), 7)) - rank(
        decay_linear(ts_rank(argmin(corr(rank(o), rank(adv(15)), 21), 9), 7), 8)
    )
    a[99] = lower(rank(corr(total(mid, 20), total(adv(60), 20), 9)), rank(corr(l, v, 6)))
    a[100] = -(
        1.5 * scale(ind(ind(rank(close_location() * v))))
        - scale(ind(corr(c, rank(adv(20)), 5) - rank(argmin(c, 30))))
    ) * turn(20)
    a[101] = (c - o) / (h - l + 0.001)
    return a


ALPHAS: dict[str, Node] = {f"alpha101_{i:03d}": n for i, n in sorted(_formulas().items())}


def lot_multiplier(bars: DataFrame) -> DataFrame:
    """One row: 100 when the median of amount/volume/close exceeds 20, else 1.

    Comparing an exact median with a bound needs only counts and the two values next to
    the bound, so this is one partial aggregate rather than a global sort.
    """
    ratio = F.when(
        (F.col("volume") > 0) & (F.col("close") != 0),
        F.col("amount") / F.col("volume") / F.col("close"),
    )
    s = bars.select(ratio.alias("r")).agg(
        F.count("r").alias("n"),
        F.count_if(F.col("r") > 20.0).alias("above"),
        F.max(F.when(F.col("r") <= 20.0, F.col("r"))).alias("below_edge"),
        F.min(F.when(F.col("r") > 20.0, F.col("r"))).alias("above_edge"),
    )
    middle = (F.col("above") * 2 == F.col("n")) & (
        (F.col("below_edge") + F.col("above_edge")) / 2.0 > 20.0
    )
    lots = (F.col("above") * 2 > F.col("n")) | middle
    return s.select(F.when(lots, 100.0).otherwise(1.0).alias("lot"))


def alpha_input(bars: DataFrame, basic: DataFrame, industry: DataFrame) -> DataFrame:
    """Input panel: vwap, return, market value (forward- then back-filled) and industry."""
    bars = bars.dropna(subset=["symbol", "trade_date", "open", "high", "low", "close"])
    lot = lot_multiplier(bars).scalar()
    w = Window.partitionBy("symbol").orderBy("trade_date")
    prev = F.lag("close").over(w)
    known = F.coalesce("circ_mv", "total_mv")
    mv = basic.select("symbol", "trade_date", known.alias("mv"))
    # before its first value, a symbol takes that one
    filled = F.coalesce(
        F.last("mv", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.first("mv", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    traded = F.when(F.col("volume") > 0, F.col("amount") / (F.col("volume") * lot))
    return (
        bars.join(mv, ["symbol", "trade_date"], "left")
        .withColumns(
            {
                "vwap": F.coalesce(traded, "close"),
                "ret": F.try_divide(F.col("close"), F.nullif(prev, F.lit(0.0))) - 1.0,
                "market_value": filled,
            }
        )
        .drop("mv")
        .join(industry.select("symbol", "industry"), "symbol", "left")
        .withColumn("industry", F.coalesce("industry", F.lit("UNKNOWN")))
    )
