"""Averages and wide windows in few orders of the rows, and sizes that take no panel."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quantspark.functions.expr import count_of, ema, field, mean, rmax, rmin, total
from quantspark.operators.panel import bounds, sizes, with_factors

X = field("x")


def bars(spark, days=130):
    rng = random.Random(5)
    first = datetime.date(2024, 1, 1)
    rows = [(s, first + datetime.timedelta(d), None if rng.random() < 0.2 or s == 4 or (s == 2 and d < 50) else rng.gauss(0, 1)) for s in (1, 2, 3, 4) for d in range(days)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, x double").repartition(3)


def by_symbol(out):
    of = {}
    for r in out.orderBy("symbol", "trade_date").collect():
        of.setdefault(r["symbol"], []).append(r)
    return of.values()


def sorts(out):
    return out._jdf.queryExecution().executedPlan().toString().count("- Sort [")


def test_an_average_takes_one_order_for_its_blocks(spark):
    one = sorts(with_factors(bars(spark), {"a": ema(X, 3)}, section_rows=1))
    two = sorts(with_factors(bars(spark), {"a": ema(X, 3), "b": ema(X, 5)}, section_rows=1))
    assert (one, two) == (2, 3)  # the bars in their order, and each average in that of its blocks


def test_wide_extremes_keep_the_order_of_the_bars(spark):
    extremes = {"hi": rmax(X, 55), "lo": rmin(X, 43, 20)}
    assert sorts(with_factors(bars(spark), extremes, section_rows=1)) == 1
    outputs = {**extremes, "sq": rmax(X, 49, 40), "m": mean(X, 41, 10), "t": total(X, 50, 30), "n": count_of(X, 47)}
    for rows in by_symbol(with_factors(bars(spark), outputs, section_rows=1)):
        xs = [r["x"] for r in rows]
        for i, r in enumerate(rows):
            def of(n):
                return [x for x in xs[max(0, i - n + 1) : i + 1] if x is not None]

            assert r["hi"] == (max(of(55)) if len(of(55)) >= 55 else None)
            assert r["sq"] == (max(of(49)) if len(of(49)) >= 40 else None)
            assert r["lo"] == (min(of(43)) if len(of(43)) >= 20 else None)
            assert r["n"] == len(of(47))
            for name, n, need in (("m", 41, 10), ("t", 50, 30)):
                want = None if len(of(n)) < need else sum(of(n)) / (len(of(n)) if name == "m" else 1)
                assert r[name] is None if want is None else r[name] == pytest.approx(want, abs=1e-12)


def test_averages_over_several_blocks_with_gaps(spark):
    df = bars(spark, days=1300)  # blocks of a span-3 average hold 498 present values
    for rows in by_symbol(with_factors(df, {"a": ema(X, 3), "b": ema(X, 9)}, section_rows=1)):
        for name, alpha in (("a", 0.5), ("b", 0.2)):
            value = None
            for r in rows:
                if r["x"] is not None:
                    value = r["x"] if value is None else alpha * r["x"] + (1 - alpha) * value
                assert r[name] is None if value is None else r[name] == pytest.approx(value, abs=1e-9)


def test_bounds_hold_the_sizes(spark):
    df = bars(spark).unionByName(bars(spark)).withColumn("symbol", F.when(F.col("symbol") != 3, F.col("symbol"))).where("symbol is null or symbol < 4 or day(trade_date) = 1")
    panel = df.groupBy("symbol", "trade_date").agg(F.max("x").alias("x"))
    got, want = bounds(df, "symbol", "trade_date"), sizes(panel, "trade_date")
    assert all(g >= w for g, w in zip(got, want)) and got[1] == 4
    assert got[0] <= 4 * 130
    assert bounds(df.where("false"), "symbol", "trade_date") == (0, 0)
