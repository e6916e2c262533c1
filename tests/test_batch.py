"""The batch planner: jobs, shared windows, and failures one by one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantspark.factors.alpha101 import ALPHAS
from quantspark.functions.expr import Node, corr, delta, field, mean, rank, total, unfolded
from quantspark.operators import batch
from quantspark.operators.panel import with_factors
from quantspark.sources import store as fs

c, v = field("close"), field("volume")
SLOW = mean(c, 20)
GOOD = {
    "gap": c / SLOW - 1.0, "gap_rank": rank(c / SLOW), "drift": delta(SLOW, 5), "turn": total(v, 3) / total(v, 10),
    "pair": corr(rank(c), rank(v), 10), "pair_rank": rank(corr(rank(c), rank(v), 10)),
}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(d), 10.0 + (s * 7 + d * 3) % 11, float(100 + (s * d) % 13), "n/a") for s in range(6) for d in range(40)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, close double, volume double, note string")


def long(df):
    return {(r.symbol, r.trade_date, r.factor_name): pytest.approx(r.value) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 3, 48])
def test_values_do_not_depend_on_the_jobs(bars, width):
    done = batch.run_factors(bars, GOOD, section_rows=6, width=width)
    due = fs.to_long(with_factors(bars, GOOD, section_rows=6), list(GOOD))
    assert done.errors == {} and long(done.values) == long(due)


def test_every_failure_stands_alone(bars):
    def unbuildable():
        raise KeyError("no such parameter")

    broken = {
        "no_column": mean(field("missing"), 3), "no_operator": Node("median_of_medians", "ts", (c,), (3, 3)), "no_formula": unbuildable,
        "at_run_time": mean(field("note") * 1.0, 3), "at_run_time_shared": rank(mean(field("note") * 1.0, 3)),
    }
    for width in (1, 48):
        done = batch.run_factors(bars, {**broken, **GOOD}, section_rows=6, width=width)
        assert set(done.errors) == set(broken) and "missing" in done.errors["no_column"]
        assert long(done.values) == long(fs.to_long(with_factors(bars, GOOD, section_rows=6), list(GOOD)))
        status = {r.factor_name: r for r in done.status().collect()}
        assert set(status) == set(broken) | set(GOOD)
        assert all(status[n].row_count == 0 and status[n].error for n in broken)
        assert all(status[n].row_count > 0 and status[n].error is None for n in GOOD)


def test_dates_and_nothing_at_all(bars):
    day = dt.date(2024, 2, 1)
    done = batch.run_factors(bars, {"gap": GOOD["gap"]}, section_rows=6, start=day, end=day)
    assert {r.trade_date for r in done.values.collect()} == {day}
    none = batch.run_factors(bars, {"no_column": field("missing")}, section_rows=6)
    assert none.values.count() == 0 and list(none.errors) == ["no_column"]
    assert batch.run_factors(bars.limit(0), GOOD, section_rows=6).values.count() == 0


def test_jobs_of_the_alphas_are_bounded_and_share():
    nodes = unfolded(ALPHAS)
    jobs = batch.packed(nodes, batch.WIDTH)
    assert sorted(n for j in jobs for n in j) == sorted(ALPHAS)
    for job in jobs:
        assert len(job) == 1 or len(frozenset().union(*map(batch.windows_of, job.values()))) <= batch.WIDTH
    shared = batch.shared_windows(jobs)
    assert shared
    # a shared window is no part of any job any more
    for job in jobs:
        done = {}
        assert not any(batch.windows_of(batch.reading(x, shared, done)) & set(shared) for x in job.values())
    # what factors have in common falls into one job more often than by their order
    in_order, names = 0, list(nodes)
    for i in range(0, len(names), 10):
        in_order += len(frozenset().union(*[batch.windows_of(nodes[n]) for n in names[i : i + 10]]))
    assert sum(len(frozenset().union(*map(batch.windows_of, j.values()))) for j in jobs) <= in_order


def test_frames(bars):
    def late():
        return bars.select("symbol", "trade_date", (F.col("note") * 1.0).alias("late"))

    def early():
        raise RuntimeError("not read")

    parts = {"caps": lambda: bars.select("symbol", "trade_date", (F.col("close") * 2).alias("double"), "volume"), "late": late, "early": early}
    done = batch.run_frames(bars, parts)
    assert set(done.errors) == {"late", "early"} and list(done.names) == ["double", "volume", "late", "early"]
    assert done.values.groupBy("factor_name").count().where("count = 240").count() == 2
