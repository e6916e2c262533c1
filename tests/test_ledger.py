"""Ledger operators against plain loops on random trades."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantspark.operators import ledger as ld


def trades(seed, n=300):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        price = round(rnd.uniform(5, 20), 2)
        qty = float(rnd.randint(1, 90))
        day = dt.date(2024, 1, 1) + dt.timedelta(days=i // 20)
        side = "SELL" if rnd.random() < 0.45 else "BUY"
        rows.append((rnd.choice("AB"), i, day, side, qty, price, round(qty * price, 2)))
    return rows


SCHEMA = "symbol string, seq long, trade_date date, side string, quantity double, price double, order_value double"


def parts():
    return [None, F.floor(F.col("seq") / 7)]


@pytest.mark.parametrize("part", [0, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_average_cost(spark, seed, part):
    rows = trades(seed)
    want = {}
    for symbol in "AB":
        held = cost = gain = cash = 0.0
        for s, _, _, side, qty, price, value in rows:
            if s != symbol:
                continue
            if side == "BUY":
                cost = (cost * held + value) / (held + qty)
                held += qty
                cash -= value
            else:
                sold = min(held, qty)
                gain += (price - cost) * sold
                held -= sold
                cash += round(sold * price, 2)
        want[symbol] = (held, cost if held > 1e-6 else None, gain, cash)
    for r in ld.average_cost(spark.createDataFrame(rows, SCHEMA), parts()[part]).collect():
        held, cost, gain, cash = want[r.symbol]
        assert r.quantity == pytest.approx(held)
        assert r.avg_cost == (pytest.approx(cost) if cost is not None else None)
        assert r.realised == pytest.approx(gain, abs=1e-6)
        assert r.cash_flow == pytest.approx(cash, abs=0.05)


def test_one_symbol_day_with_most_fills(spark):
    """A hot symbol-day, split by ranges of seq, gives what one chunk gives."""
    day = dt.date(2024, 3, 1)
    rows = [("A", i, day, side, qty, price, value) for i, (_, _, _, side, qty, price, value) in enumerate(trades(7, 2000))]
    rows += [("A", 5000 + i, dt.date(2024, 4, 1 + i), "BUY", 3.0, 7.0, 21.0) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole, split = ld.average_cost(df).first(), ld.average_cost(df, F.floor(F.col("seq") / 50)).first()
    for c in ("quantity", "avg_cost", "realised", "cash_flow"):
        assert split[c] == pytest.approx(whole[c], rel=1e-9)
    lots = [{(r.symbol, r.seq): (round(r.matched, 6), round(r.realised, 6)) for r in ld.fifo_realised(df, p).collect()} for p in (None, F.floor(F.col("seq") / 50))]
    assert lots[0] == lots[1] and lots[0]


@pytest.mark.parametrize("seed", [3, 4])
def test_fifo(spark, seed, monkeypatch):
    monkeypatch.setattr(ld, "SHARE_BUCKET", 64.0)  # many bucket borders
    rows = trades(seed)
    want = {}
    for symbol in "AB":
        lots = [[qty, price] for s, _, _, side, qty, price, _ in rows if s == symbol and side == "BUY"]
        for s, seq, _, side, qty, price, _ in rows:
            if s != symbol or side == "BUY":
                continue
            matched = gain = 0.0
            while qty > 0 and lots:
                take = min(qty, lots[0][0])
                gain += take * (price - lots[0][1])
                matched += take
                qty -= take
                lots[0][0] -= take
                if lots[0][0] <= 0:
                    lots.pop(0)
            if matched:
                want[(symbol, seq)] = (matched, gain)
    got = {(r.symbol, r.seq): (r.matched, r.realised) for r in ld.fifo_realised(spark.createDataFrame(rows, SCHEMA), parts()[seed % 2]).collect()}
    assert got.keys() == want.keys()
    for k, (matched, gain) in want.items():
        assert got[k][0] == pytest.approx(matched)
        assert got[k][1] == pytest.approx(gain, abs=1e-6)
