"""Window passes in tasks of bounded size, fills and ranks in time that is linear in the bars."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from quantspark.functions.expr import bfill, coalesce, ema, ffill, field, rank, ts_rank, unfolded, windows_in
from quantspark.operators.panel import with_factors
from quantspark.session import TASK_ROWS

X = field("x")


def bars(spark, symbols=12, days=40):
    rng = random.Random(7)
    first = datetime.date(2024, 1, 1)
    values = [None, -0.0, 0.0, 1.0, 2.5, 2.5]
    rows = [(s, first + datetime.timedelta(d), rng.choice(values)) for s in range(symbols) for d in range(days)]
    rows = [(s, d, None if s == 3 or (s % 2 and d.day < 9 and d.month == 1) else x) for s, d, x in rows]
    return spark.createDataFrame(rows, "symbol long, trade_date date, x double").repartition(3)


def test_passes_are_dealt_by_rows(spark):
    df = bars(spark)
    outputs = {"a": ema(ts_rank(X, 5, 2), 3), "b": rank(X), "c": ts_rank(rank(X), 4, 1)}
    want = sorted(map(str, with_factors(df, outputs, section_rows=20).collect()))
    spark.conf.set(TASK_ROWS, "60")
    try:
        out = with_factors(df, outputs, section_rows=20, rows=df.count())
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, out.collect())) == want
    finally:
        spark.conf.unset(TASK_ROWS)
    assert plan.count("RepartitionByExpression") == 3  # symbols, dates, symbols
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < df.count() / 2


def test_fills_are_exact_and_linear(spark):
    filled = coalesce(ffill(X), bfill(X), -1.0)
    found = {}
    for node in unfolded({"f": filled}).values():
        windows_in(node, found, set())
    assert {n.op for n in found.values()} == {"ffill", "first_of_all"}
    out = with_factors(bars(spark), {"f": filled, "b": bfill(X), "other": coalesce(ffill(X * 2.0), bfill(X))}, section_rows=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan  # such a frame reads the rest of the symbol for every bar
    of = {}
    for r in out.orderBy("symbol", "trade_date").collect():
        of.setdefault(r["symbol"], []).append(r)
    for rows in of.values():
        for i, r in enumerate(rows):
            after = [q["x"] for q in rows[i:] if q["x"] is not None]
            before = [q["x"] for q in rows[: i + 1] if q["x"] is not None]
            assert r["b"] == (after[0] if after else None)
            assert r["f"] == (before[-1] if before else after[0] if after else -1.0)
            assert r["other"] == (before[-1] * 2.0 if before else r["b"])


def test_time_rank_reads_the_list_once(spark):
    out = with_factors(bars(spark), {"r": ts_rank(X, 6, 2)}, section_rows=1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1 and "x_1 < round" not in plan
    of = {}
    for r in out.orderBy("symbol", "trade_date").collect():
        of.setdefault(r["symbol"], []).append(r)
    for rows in of.values():
        for i, r in enumerate(rows):
            window = [q["x"] for q in rows[max(0, i - 5) : i + 1] if q["x"] is not None]
            want = None
            if r["x"] is not None and len(window) >= 2:
                want = (sum(v < r["x"] for v in window) + (window.count(r["x"]) + 1) / 2.0) / len(window)
            assert r["r"] == want
