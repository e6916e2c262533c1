"""The first exit by the tree of blocks against a walk over the bars."""

import datetime as dt

import numpy as np
import pytest

from quantspark.operators import ledger as ld

DAY = dt.date(1700, 1, 1)
BARS = "symbol long, trade_date date, close double, hot boolean"


def walk(closes, hot, start, price, stop, trail, take):
    peak = price
    for i in range(start, len(closes)):
        c = closes[i]
        if c is None:
            continue
        peak = max(peak, c)
        for met, rule in ((c / price - 1 <= -stop, "stop_loss"), (c / peak - 1 <= -trail, "trailing_stop"), (c / price - 1 >= take, "take_profit"), (hot[i], "risk")):
            if met:
                return i, rule, c
    return None


def compared(spark, series, hot, every, rules):
    """Entries at every so many bars of each series; the exits must be those of the walk."""
    days = [DAY + dt.timedelta(i) for i in range(max(map(len, series.values())))]
    bars = [(s, days[i], c, hot[s][i]) for s, cs in series.items() for i, c in enumerate(cs)]
    entries, due = [], {}
    for s, cs in series.items():
        for i in range(0, len(cs), every):
            if cs[i] is not None:
                entries.append((s, days[i], cs[i]))
                due[s, days[i]] = walk(cs, hot[s], i + 1, cs[i], *rules)
    out = ld.first_exit(spark.createDataFrame(entries, "symbol long, entry_date date, entry_price double"), spark.createDataFrame(bars, BARS), *rules, risk="hot")
    found = {(r.symbol, r.entry_date): None if r.exit_date is None else ((r.exit_date - DAY).days, r.rule, r.exit_price) for r in out.collect()}
    assert found == due
    return due


@pytest.mark.parametrize("fan", [3, 64])
def test_small_fans(spark, monkeypatch, fan):
    monkeypatch.setattr(ld, "FAN", fan)
    rng = np.random.default_rng(fan)
    series = {s: [None if rng.random() < 0.05 else float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.04, 90)))] for s in range(4)}
    hot = {s: [bool(rng.random() < 0.01) for _ in cs] for s, cs in series.items()}
    due = compared(spark, series, hot, 3, (0.25, 0.3, 0.3))
    assert {r[1] for r in due.values() if r} == {"stop_loss", "trailing_stop", "take_profit", "risk"}


def test_a_hundred_thousand_bars(spark):
    """One symbol; exits far away, so that three levels are climbed."""
    rng = np.random.default_rng(1)
    closes = [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.002, 100_000)))]
    due = compared(spark, {1: closes}, {1: [False] * len(closes)}, 997, (0.3, 0.4, 0.8))
    far = [r[0] - (d - DAY).days for (_, d), r in due.items() if r]
    assert len(far) > 30 and max(far) > 64 * 64
    assert any(r is None for r in due.values())


def test_odd_entries(spark):
    bars = spark.createDataFrame([(1, DAY + dt.timedelta(i), c, False) for i, c in enumerate([10.0, 0.0, None, 12.0, 20.0])], BARS)
    day = [DAY + dt.timedelta(i) for i in range(-1, 9)]
    rows = [(1, day[0], 10.0), (1, day[1], 10.0), (1, day[1], 10.0), (1, day[1], None), (1, day[4], 0.0), (1, day[9], 5.0), (2, day[1], 5.0), (1, day[3], 12.0)]
    out = ld.first_exit(spark.createDataFrame(rows, "symbol long, entry_date date, entry_price double"), bars).collect()
    got = sorted((r.symbol, r.entry_date, r.entry_price or 0.0, r.rule or "") for r in out)
    assert got == sorted([
        (1, day[0], 10.0, "stop_loss"), (1, day[1], 10.0, "stop_loss"), (1, day[1], 10.0, "stop_loss"), (1, day[1], 0.0, ""),
        (1, day[4], 0.0, ""), (1, day[9], 5.0, ""), (2, day[1], 5.0, ""), (1, day[3], 12.0, "take_profit"),
    ])
    empty = spark.createDataFrame([], BARS)
    assert ld.first_exit(spark.createDataFrame(rows, "symbol long, entry_date date, entry_price double"), empty).count() == len(rows)


def test_entries_never_meet_their_bars(spark):
    """No join gives more rows than there are entries."""
    closes = [100.0 + (i * 37 % 23) for i in range(5000)]
    bars = spark.createDataFrame([(1, DAY + dt.timedelta(i), c, False) for i, c in enumerate(closes)], BARS)
    entries = bars.selectExpr("symbol", "trade_date as entry_date", "close as entry_price")
    out = ld.first_exit(entries, bars, 0.5, 0.5, 0.9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "trade_date" not in "".join(line for line in plan.splitlines() if "Join" in line)
    assert out.count() == 5000
