"""Cash admission in rounds against the fold over single orders."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.operators import multifactor as mp

DAY = dt.date(2024, 1, 1)
SCHEMA = "trade_date date, symbol long, rank int, cost double"


def fold(rows, cash, limit=None):
    out = set()
    for day in {r[0] for r in rows}:
        left = cash
        for i, (_, symbol, _, cost) in enumerate(sorted((r for r in rows if r[0] == day), key=lambda r: (r[2], r[1]))):
            if cost is not None and cost >= 0 and cost <= left and (limit is None or i < limit):
                left -= cost
                out.add((day, symbol))
    return out


@pytest.mark.parametrize("limit", [None, 7])
def test_rounds_are_the_fold(spark, monkeypatch, limit):
    monkeypatch.setattr(mp, "RANKS", 3)
    rng = np.random.default_rng(2)
    rows = []
    for d in range(12):
        n = int(rng.integers(1, 40))
        costs = [float(c) for c in np.floor(2.0 ** rng.uniform(0, 11, n))]
        rows += [(DAY + dt.timedelta(d), s, int(rng.integers(1, n + 1)), costs[s]) for s in range(n)]
    # large and small in turn, falling: many rounds in a row end at a large one
    rows += [(DAY + dt.timedelta(50), i, i, 1.0 if i % 2 else 1000.0 - i) for i in range(60)]
    rows += [(DAY + dt.timedelta(51), i, i, c) for i, c in enumerate([None, 0.0, -5.0, 2000.0, 1000.0, 1.0])]
    got = {(r.trade_date, r.symbol) for r in mp.admit_buys(spark.createDataFrame(rows, SCHEMA), 1000.0, 0.0, limit).where("accepted").collect()}
    assert got == fold(rows, 1000.0, limit)


def test_a_million_orders_of_one_date(spark):
    n, cash = 1_000_000, 5_000_000.0
    orders = spark.range(n).select(
        F.lit(DAY).alias("trade_date"), F.col("id").alias("symbol"), (F.col("id") + 1).cast("int").alias("rank"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).cast("double").alias("cost"),
    )
    out = mp.admit_buys(orders, cash, 0.0)
    costs = np.array([r.cost for r in orders.select("cost").toLocalIterator()])
    left, due = cash, 0
    for c in costs:
        if c <= left:
            left -= c
            due += 1
    one = out.agg(F.count_if("accepted").alias("n"), F.sum(F.when(F.col("accepted"), F.col("cost"))).alias("spent"), F.count("*").alias("rows")).first()
    assert (one.n, one.spent, one["rows"]) == (due, cash - left, n)


def test_no_orders(spark):
    assert mp.admit_buys(spark.createDataFrame([], SCHEMA), 100.0).count() == 0
