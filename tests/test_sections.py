"""The bucketed form of cross-sections gives the same values as the window form."""

import datetime as dt
import random

import pytest

from quantspark.functions import expr as x
from quantspark.functions.expr import field
from quantspark.operators.panel import with_factors
from quantspark.session import MAX_GROUP_ROWS

X, Y = field("x"), field("y")
NODES = {
    "rank": x.rank(X),
    "rank_desc": x.rank(Y, ascending=False),
    "rank_by": x.rank(Y, by=("industry",)),
    "z": x.zscore(X),
    "zp": x.zscore_pop(Y, by=("industry",)),
    "wins": x.winsorize(Y, 0.1),
    "resid": x.residual(Y, X),
    "bucket": x.bucket(Y, 5),
    "scale": x.scale(Y),
    "nested": x.rank(x.mean(x.rank(Y), 2)),
}


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(3)
    rows = []
    for day in range(3):
        for s in range(400):
            hot = rnd.random() < 0.4  # one value held by a large part of the section
            value = 1.0 if hot else round(rnd.uniform(-5, 5), 2)
            rows.append((s, dt.date(2024, 1, 1 + day), value if rnd.random() > 0.05 else None,
                         rnd.gauss(0, 1), "abc"[s % 3]))
    return spark.createDataFrame(rows, "symbol int, trade_date date, x double, y double, industry string")


def values(df):
    return {(r.symbol, r.trade_date): [None if r[n] is None else round(r[n], 8) for n in NODES] for r in df.collect()}


def test_bucketed_equals_window(spark, panel):
    narrow = values(with_factors(panel, NODES))
    spark.conf.set(MAX_GROUP_ROWS, "50")
    try:
        df = with_factors(panel, NODES)
        wide = values(df)
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    assert wide == narrow
    assert any(v[0] is not None for v in narrow.values())


def test_rank_properties(panel):
    got = [r for r in with_factors(panel, {"r": x.rank(X), "s": x.scale(Y)}).collect()]
    ranks = [r.r for r in got if r.r is not None]
    assert all(0 < v <= 1 for v in ranks)
    for day in {r.trade_date for r in got}:
        assert abs(sum(abs(r.s) for r in got if r.trade_date == day) - 1) < 1e-6


def test_residual_is_orthogonal(panel):
    got = with_factors(panel.where("x is not null"), {"e": x.residual(Y, X)}).collect()
    for day in {r.trade_date for r in got}:
        rows = [r for r in got if r.trade_date == day]
        assert abs(sum(r.e for r in rows)) < 1e-6
        assert abs(sum(r.e * r.x for r in rows)) < 1e-6
