"""Row nodes that are read more than once are computed once: the row code grows with the graph, not with its paths."""

from __future__ import annotations

import datetime
import random

from quantspark.functions.expr import corr, delay, field, rank, where
from quantspark.operators.panel import shared_rows, with_factors

X, Y = field("x"), field("y")


def bars(spark):
    rng = random.Random(11)
    first = datetime.date(2024, 1, 1)
    rows = [(s, first + datetime.timedelta(d), rng.choice([None, -1.5, 0.0, 1.0, 2.5]), rng.gauss(0, 1)) for s in (1, 2, None) for d in range(60)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, x double, y double")


def twice(node, times):
    for _ in range(times):
        node = where(node > 1.0, node * 0.5, node + 0.75)
    return node


def python_twice(x, times):
    for _ in range(times):
        x = None if x is None else x * 0.5 if x > 1.0 else x + 0.75
    return x


def cases(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN")


def test_repeated_rows_are_written_once(spark):
    df = bars(spark)
    out = with_factors(df, {"v": twice(X, 9)})
    assert cases(out) <= 3 * 9  # each copy of the tree would double it: more than 500
    assert all(r["v"] == python_twice(r["x"], 9) for r in out.collect())


def test_repeated_rows_below_windows(spark):
    out = with_factors(bars(spark), {"v": delay(twice(X, 9), 1), "r": rank(twice(delay(X, 1), 9))}, section_rows=3)
    assert out.columns == ["symbol", "trade_date", "x", "y", "v", "r"]
    assert cases(out) <= 4 * 3 * 9
    before = {}
    for r in out.where("symbol is not null").orderBy("symbol", "trade_date").collect():
        assert r["v"] == python_twice(before.get(r["symbol"]), 9)
        before[r["symbol"]] = r["x"]


def test_wide_windows_share_their_parts(spark):
    wide = with_factors(bars(spark), {"v": corr(X, Y, 40, 5)}, section_rows=1)
    last = max(wide._jdf.queryExecution().optimizedPlan().toString().splitlines(), key=len)
    assert len(last) < 7000  # 14,059 when every part is written out where it is read


def test_layers_read_only_earlier_ones():
    a = X + 1.0
    b = a * a
    layers = shared_rows([b + b, a], {})
    assert [[n.key for n in layer] for layer in layers] == [[a.key], [b.key]]
    assert shared_rows([b], {a.key: "a"}) == []
