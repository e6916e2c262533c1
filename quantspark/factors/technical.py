"""Technical-analysis operators and the named TA factor set."""

from __future__ import annotations

from quantspark.factors.bars import CLOSE, HIGH, LOW, VOLUME
from quantspark.functions.expr import (
    Node, argmax, argmin, coalesce, cumulative, delay, delta, ema, greatest, isnull, mean,
    mean_abs_dev, pct, rmax, rmin, sign, stdev, total, where,
)


def sma(x, n=20):
    return mean(x, n)


def rsi(x, n=14):
    """Simple-average RSI; no losses at all gives 100."""
    change = delta(x, 1)
    gain = mean(where(isnull(change), None, greatest(change, 0.0)), n)
    loss = mean(where(isnull(change), None, greatest(-change, 0.0)), n)
    strength = 100.0 - 100.0 / (1.0 + gain / loss)
    return where(loss.eq(0.0), 100.0, strength)


def macd(x, fast=12, slow=26, signal=9) -> tuple[Node, Node, Node]:
    dif = ema(x, fast) - ema(x, slow)
    dea = ema(dif, signal)
    return dif, dea, dif - dea


def bbands(x, n=20, k=2.0) -> tuple[Node, Node, Node]:
    mid, dev = mean(x, n), stdev(x, n)
    return mid + k * dev, mid, mid - k * dev


def true_range(high=HIGH, low=LOW, close=CLOSE):
    prev = delay(close, 1)
    return greatest(high - low, abs(high - prev), abs(low - prev))


def atr(high=HIGH, low=LOW, close=CLOSE, n=14):
    return mean(true_range(high, low, close), n)


def natr(n=14):
    return atr(n=n) / where(abs(CLOSE) > 1e-8, CLOSE, None) * 100.0


def stoch_k(high=HIGH, low=LOW, close=CLOSE, n=9, smooth=3):
    lowest, highest = rmin(low, n), rmax(high, n)
    return mean(100.0 * (close - lowest) / (highest - lowest), smooth)


def stoch_d(high=HIGH, low=LOW, close=CLOSE, n=9, smooth=3):
    return mean(stoch_k(high, low, close, n, smooth), smooth)


def typical_price():
    return (HIGH + LOW + CLOSE) / 3.0


def cci(n=14):
    tp = typical_price()
    return (tp - mean(tp, n)) / (0.015 * mean_abs_dev(tp, n))


def willr(n=14):
    top, bottom = rmax(HIGH, n), rmin(LOW, n)
    return -100.0 * (top - CLOSE) / (top - bottom)


def obv(close=CLOSE, volume=VOLUME):
    return cumulative(sign(coalesce(delta(close, 1), 0.0)) * volume)


def ad_line():
    span = where(abs(HIGH - LOW) > 1e-8, HIGH - LOW, None)
    location = ((CLOSE - LOW) - (HIGH - CLOSE)) / span
    return cumulative(coalesce(location, 0.0) * VOLUME)


def mfi(n=14):
    tp = typical_price()
    flow, move = tp * VOLUME, delta(tp, 1)
    inflow = total(where(move > 0.0, flow, 0.0), n)
    outflow = total(where(move < 0.0, flow, 0.0), n)
    return 100.0 - 100.0 / (1.0 + inflow / outflow)


def roc(n=10):
    return pct(CLOSE, n) * 100.0


def adx(n=14):
    """Simple-average ADX; the first true range is high - low."""
    up, down = delta(HIGH, 1), -delta(LOW, 1)
    plus = where((up > down) & (up > 0.0), up, 0.0)
    minus = where((down > up) & (down > 0.0), down, 0.0)
    width = mean(true_range(), n)
    plus_di, minus_di = 100.0 * mean(plus, n) / width, 100.0 * mean(minus, n) / width
    return mean(abs(plus_di - minus_di) / (plus_di + minus_di) * 100.0, n)


def aroon_osc(n=14):
    up = (float(n) - argmax(HIGH, n)) / float(n) * 100.0
    down = (float(n) - argmin(LOW, n)) / float(n) * 100.0
    return down - up


_DIF, _DEA, _HIST = macd(CLOSE)
_UPPER, _MIDDLE, _LOWER = bbands(CLOSE)

#: named factors of the batch TA job
TA_FACTORS: dict[str, Node] = {
    "ta_sma_20": sma(CLOSE, 20),
    "ta_ema_20": ema(CLOSE, 20),
    "ta_rsi_14": rsi(CLOSE, 14),
    "ta_macd_dif_12_26_9": _DIF,
    "ta_macd_dea_12_26_9": _DEA,
    "ta_macd_hist_12_26_9": _HIST,
    "ta_bbands_upper_20": _UPPER,
    "ta_bbands_middle_20": _MIDDLE,
    "ta_bbands_lower_20": _LOWER,
    "ta_atr_14": atr(n=14),
    "ta_natr_14": natr(14),
    "ta_obv": obv(),
    "ta_ad": ad_line(),
    "ta_mfi_14": mfi(14),
    "ta_cci_14": cci(14),
    "ta_willr_14": willr(14),
    "ta_roc_10": roc(10),
    "ta_adx_14": adx(14),
    "ta_aroonosc_14": aroon_osc(14),
    "ta_typprice": typical_price(),
}
