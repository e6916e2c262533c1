"""Window operators against pandas, point-in-time joins, statements."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from quantspark.functions import expr as x
from quantspark.functions.expr import field
from quantspark.operators import joins as jn
from quantspark.operators.panel import with_factors
from quantspark.operators.statements import align_statements, quarterly

C, V = field("close"), field("volume")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(42)
    days = pd.bdate_range("2024-01-01", periods=120).date
    parts = []
    for s in ("A", "B", "C"):
        close = 50 + rng.normal(0, 1, len(days)).cumsum()
        parts.append(pd.DataFrame({"symbol": s, "trade_date": days, "close": close,
                                   "volume": rng.integers(1, 9, len(days)).astype(float)}))
    return pd.concat(parts, ignore_index=True)


def by_symbol(frame, fn):
    return pd.concat([fn(g) for _, g in frame.groupby("symbol")]).sort_index()


def decay(n):
    w = np.arange(1, n + 1)
    return lambda v: np.average(v, weights=w)


CASES = {
    "mean": (x.mean(C, 5, 2), lambda g: g.close.rolling(5, min_periods=2).mean()),
    "std": (x.stdev(C, 5, 2), lambda g: g.close.rolling(5, min_periods=2).std()),
    "corr": (x.corr(C, V, 10, 5), lambda g: g.close.rolling(10, min_periods=5).corr(g.volume)),
    "ts_rank": (x.ts_rank(V, 7), lambda g: g.volume.rolling(7).rank(pct=True)),
    "argmax": (x.argmax(V, 6), lambda g: g.volume.rolling(6).apply(np.argmax, raw=True) + 1),
    "ema": (x.ema(C, 12), lambda g: g.close.ewm(span=12, adjust=False).mean()),
    "ema_slow": (x.ema(C, 3), lambda g: g.close.ewm(span=3, adjust=False).mean()),
    "decay": (x.decay_linear(C, 6), lambda g: g.close.rolling(6).apply(decay(6), raw=True)),
    "slope": (x.slope(C, 8, 2), lambda g: g.close.rolling(8, min_periods=2).apply(lambda v: np.polyfit(range(len(v)), v, 1)[0])),
    "pct": (x.pct(C, 3), lambda g: g.close.pct_change(3)),
    "cumsum": (x.cumulative(V), lambda g: g.volume.cumsum()),
}


def test_against_pandas(spark, frame):
    df = spark.createDataFrame(frame)
    got = with_factors(df, {n: node for n, (node, _) in CASES.items()}).toPandas()
    got = got.sort_values(["symbol", "trade_date"]).reset_index(drop=True)
    for name, (_, fn) in CASES.items():
        want = by_symbol(frame, fn)
        assert np.allclose(got[name].to_numpy(float), want.to_numpy(float), atol=1e-8, equal_nan=True), name


def test_ema_restarts_blocks(spark, monkeypatch):
    monkeypatch.setattr(x, "BLOCK_RANGE", 1e20)  # blocks of 66 bars at span 3
    n = 400
    vals = [math.sin(i) + 2 if i % 7 else None for i in range(n)]
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double")
    got = with_factors(df, {"e": x.ema(C, 3)}).orderBy("trade_date").toPandas()["e"]
    want = pd.Series(vals, dtype=float).dropna().ewm(span=3, adjust=False).mean().reindex(range(n)).ffill()
    assert np.allclose(got.to_numpy(float)[1:], want.to_numpy(float)[1:], atol=1e-9)


def test_missing_rules(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), 1.0, 0.0), ("A", dt.date(2024, 1, 2), -1.0, 2.0)],
                               "symbol string, trade_date date, close double, volume double")
    out = with_factors(df, {"d": C / V, "l": x.log(C), "p": C ** 0.5, "f": x.flag(C > x.delay(C, 1))}).orderBy("trade_date").collect()
    assert out[0].d is None and out[1].l is None and out[1].p is None and out[0].f == 0.0


def asof_frames(spark):
    left = spark.createDataFrame([("A", dt.date(2024, 1, d), d) for d in range(1, 30)], "symbol string, trade_date date, n int")
    right = spark.createDataFrame([("A", dt.date(2024, 1, d), float(d)) for d in (3, 10, 11, 25)], "symbol string, known date, v double")
    return left, right


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("chunked", [False, True])
def test_asof(spark, strict, chunked):
    from pyspark.sql import functions as F

    left, right = asof_frames(spark)
    chunk = F.floor(F.dayofmonth("t_") / 7) if chunked else None
    got = {r.n: r.v for r in jn.asof_join(left, right, "trade_date", "known", ["v"], strict=strict, chunk=chunk).collect()}
    for n in range(1, 30):
        hits = [d for d in (3, 10, 11, 25) if (d < n if strict else d <= n)]
        assert got[n] == (float(max(hits)) if hits else None)


def statements(spark):
    rows = []
    for y in (2020, 2021, 2022):
        for q, end in enumerate(((3, 31), (6, 30), (9, 30), (12, 31)), start=1):
            d = dt.date(y, *end)
            ann = None if q == 2 else d + dt.timedelta(days=20)
            rows.append(("A", d, ann, 100.0 * q * (y - 2019), 10.0 * q, 0.1, 1000.0, 400.0, 600.0))
    return spark.createDataFrame(rows, "symbol string, report_date date, ann_date date, revenue double, net_profit double, roe double, total_assets double, total_liability double, total_equity double")


def test_quarterly(spark):
    rows = {r.report_date: r for r in quarterly(statements(spark), clip=False).collect()}
    assert rows[dt.date(2021, 9, 30)].quarter_revenue == pytest.approx(200.0)
    assert rows[dt.date(2021, 9, 30)].quarter_revenue_yoy == pytest.approx(1.0)
    assert rows[dt.date(2021, 6, 30)].available_date == dt.date(2021, 8, 29)


def test_no_look_ahead(spark):
    q = quarterly(statements(spark), clip=False)
    bars = spark.createDataFrame([("A", dt.date(2021, 1, 1) + dt.timedelta(days=15 * i)) for i in range(30)], "symbol string, trade_date date")
    full = {r.trade_date: r.report_date for r in align_statements(bars, q, ["revenue"]).collect()}
    cut = dt.date(2021, 9, 1)
    early = q.where(q.available_date <= cut)
    part = {r.trade_date: r.report_date for r in align_statements(bars, early, ["revenue"]).collect()}
    assert all(full[d] == part[d] for d in full if d <= cut)


def test_membership_is_point_in_time(spark):
    index = spark.createDataFrame([("I", dt.date(2024, 1, 1), "A", 1.0), ("I", dt.date(2024, 2, 1), "B", 1.0)], "index_symbol string, trade_date date, symbol string, weight double")
    panel = spark.createDataFrame([(s, d) for s in "AB" for d in (dt.date(2023, 12, 1), dt.date(2024, 1, 15), dt.date(2024, 2, 15))], "symbol string, trade_date date")
    got = {(r.symbol, r.trade_date) for r in jn.membership(panel, index).collect()}
    assert got == {("A", dt.date(2024, 1, 15)), ("B", dt.date(2024, 2, 15))}


def test_mentions_with_blanks(spark):
    posts = spark.createDataFrame([(1, "buy Acme Corp now"), (2, "acme only"), (3, "sz000001 rises"), (4, "nothing")], "doc_id int, text string")
    aliases = spark.createDataFrame([("A", "Acme Corp"), ("A2", "acme"), ("Z", "000001"), ("S", "ab")], "symbol string, alias string")
    got = {(r.doc_id, r.symbol) for r in jn.mentions(posts, aliases).collect()}
    assert got == {(1, "A"), (1, "A2"), (2, "A2"), (3, "Z")}


def test_mentions_find_every_alias(spark):
    """Aliases inside words, with blanks, with a piece in no word, and frequent pieces."""
    from quantspark.operators import joins as jn

    posts = spark.createDataFrame([(1, "the alphabet soup"), (2, "Big Corp rose, big corp fell"), (3, "bigcorp"), (4, None), (5, "a b c done")], "doc_id long, text string")
    aliases = spark.createDataFrame([(10, "alpha"), (11, "big corp"), (12, "BIGCORP"), (13, "zzzz"), (14, "a b c"), (15, "ab")], "symbol long, alias string")
    found = {tuple(r) for r in jn.mentions(posts, aliases).select("doc_id", "symbol").collect()}
    assert found == {(1, 10), (2, 11), (3, 12), (5, 14)}
    codes = spark.createDataFrame([(1, "buy sh600000 and SZ000001, sh600000"), (2, "XSH600000 SH6000001"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in jn.code_mentions(codes).collect()} == {(1, "SH600000"), (1, "SZ000001")}


def test_spans_open_to_calendar_days(spark):
    """Days outside the calendar, null ends, null starts, reversed spans and an empty calendar."""
    import datetime as dt

    from quantspark.operators.joins import each_day

    d = lambda n: dt.date(2024, 1, n)
    days = spark.createDataFrame([(d(n),) for n in (2, 3, 5, 8)], "trade_date date")
    spans = spark.createDataFrame([("a", d(1), d(3)), ("b", d(4), None), ("c", None, d(5)), ("e", d(6), d(4)), ("f", d(9), None)], "symbol string, s date, e date")
    out = each_day(spans, days, F.col("s"), F.col("e"))
    assert sorted((r.symbol, r.trade_date.day) for r in out.collect()) == [("a", 2), ("a", 3), ("b", 5), ("b", 8)]
    assert each_day(spans, days).count() == 20 and each_day(spans, days.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
