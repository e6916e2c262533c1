"""The dense grids of the small-cap core: same rows as a join with every day, without shuffling the days."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from quantspark.factors import smallcap as sc
from quantspark.operators import batch
from quantspark.operators.filters import special_days, special_treatment
from quantspark.operators.joins import each_day

DAY = datetime.date(2024, 1, 1)
KEYS = ["symbol", "trade_date"]


@pytest.fixture(scope="module")
def days(spark):
    return spark.createDataFrame([(DAY + datetime.timedelta(d + d // 5 * 2),) for d in range(150)] + [(None,)], "trade_date date")


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(s,) for s in (*range(9), 3, None)], "symbol long")  # one twice, one null


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(s, DAY + datetime.timedelta(d)) for s in range(12) for d in range(-3, 230) if (s * 7 + d) % (s + 2) == 0]
    return spark.createDataFrame([*rows, *rows[:20], (None, DAY), (1, None)], "symbol long, trade_date date")


def rows_of(df):
    return sorted(map(str, df.select(*KEYS, "value").collect()))


def test_a_grid_is_every_day_joined_with_its_hits(symbols, days, hits):
    marked = hits.distinct().withColumn("hit", F.lit(1.0))
    due = each_day(symbols, days).join(marked, KEYS, "left").withColumn("value", F.coalesce("hit", F.lit(0.0)))
    found = sc.day_grid(symbols, days, hits, 1.0, 0.0)
    assert rows_of(found) == rows_of(due) and found.count() == 11 * 150
    assert sc.day_grid(symbols, days.limit(0), hits, 1.0, 0.0).count() == 0


def test_no_day_of_a_grid_is_shuffled(symbols, days, hits):
    plan = sc.day_grid(symbols, days, hits, 1.0, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Generate")[0] and "Exchange" not in plan.split("Generate")[0]
    assert not re.search(r"Exchange hashpartitioning\([^)]*trade_date", plan.split("Generate")[1].split("bit_or")[0])


def test_special_days_may_repeat(spark, days):
    stocks = spark.createDataFrame([(1, "ST A", 1, DAY), (2, "B", 0, None)], "symbol long, name string, is_st int, delist_date date")
    changes = spark.createDataFrame([(1, "ST A", DAY, None), (2, "ST B", DAY, DAY)], "symbol long, name string, start_date date, end_date date")
    every = special_days(stocks, changes, days)
    assert every.count() == 3 * 150 + 1 and special_treatment(stocks, changes, days).count() == 150 + 1
    assert sc.st_flags(stocks, changes, days).agg(F.sum("value")).first()[0] == 151


def test_shared_parts_are_built_once_and_fail_alone(spark, days, monkeypatch):
    calls = []
    for name in ("limit_flags", "market_cap"):
        monkeypatch.setattr(sc, name, lambda *a, f=getattr(sc, name), n=name: calls.append(n) or f(*a))
    bars = spark.createDataFrame([(s, DAY + datetime.timedelta(d), 1.0 + (s * d) % 5, 5.0) for s in range(3) for d in range(70)], "symbol long, trade_date date, close double, volume double")
    bars = bars.withColumns({"high": F.col("close") + 1, "low": F.col("close") / 2, "cum_volume": F.col("volume")})
    limits = bars.select(*KEYS, (F.col("close") * 1.0).alias("up_limit"), F.lit(0.5).alias("down_limit"))
    basic = bars.select(*KEYS, F.col("close").alias("circ_mv"), F.col("close").alias("total_mv"))
    stocks = spark.createDataFrame([(s, "n", 0, None) for s in range(3)], "symbol long, name string, is_st int, delist_date date")
    changes = spark.createDataFrame([], "symbol long, name string, start_date date, end_date date")
    minutes = bars.select(*KEYS, F.lit(630).alias("minute_of_day"))
    whole = sc.core_batch(bars, basic, limits, stocks, changes, minutes, window=5, lots=1.0)
    assert sorted(calls) == ["limit_flags", "market_cap"] and not whole[0].errors and not whole[1].errors
    due = sc.yesterday_limit_up(bars, limits).select(*KEYS, F.col("yesterday_limit_up").alias("value"))
    assert rows_of(whole[1].whole().where("factor_name = 'yesterday_limit_up'")) == rows_of(due)
    broken = sc.core_batch(bars, basic, limits.drop("down_limit"), stocks, changes, minutes, window=5, lots=1.0)
    assert set(broken[1].errors) == {"is_limit_up, is_limit_down", "yesterday_limit_up"} and not broken[0].errors


def test_files_of_values_hold_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(batch, "FILE_ROWS", 10)
    bars = spark.createDataFrame([(s, DAY, 1.0) for s in range(95)], "symbol long, trade_date date, one double").coalesce(1)
    done = batch.run_frames(bars, {"one": lambda: bars})
    assert len(done.values.inputFiles()) == 10 and done.whole().count() == 95
