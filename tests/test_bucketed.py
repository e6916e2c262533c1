"""Bucketed bars: windows without a shuffle, scans of the wanted months alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantspark.functions import expr as x
from quantspark.operators.panel import with_factors
from quantspark.sources import bucketed


@pytest.fixture(scope="module")
def bars(spark):
    days = spark.range(400).select(F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    symbols = spark.range(23).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("symbol"))
    close = F.pmod(F.xxhash64("symbol", "trade_date"), F.lit(1000)) / 10.0
    return symbols.join(days).withColumn("close", close)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_symbol_windows_need_no_exchange(spark, bars):
    name = bucketed.write_bars(bars, buckets=8)
    rows = bucketed.bars_between(spark, name, dt.date(2023, 3, 5), dt.date(2023, 6, 20))
    wanted = {"m": x.mean(x.field("close"), 5), "p": x.pct(x.field("close"), 3)}
    out = with_factors(rows, wanted)
    text = plan(out)
    assert "Window" in text and "Exchange" not in text
    assert "PartitionFilters: [" in text and "PartitionFilters: []" not in text
    plain = with_factors(bars.where("trade_date between date'2023-03-05' and date'2023-06-20'"), wanted)
    assert "Exchange" in plan(plain)
    cols = ["symbol", "trade_date", "close", "m", "p"]
    assert sorted(map(str, out.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    files = {r[0].split("year=")[1].rsplit("/", 1)[0] for r in rows.select(F.input_file_name()).distinct().collect()}
    assert files == {f"2023/month=0{m}" for m in (3, 4, 5, 6)}


def test_joins_by_symbol_need_no_exchange(spark, bars):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        a, b = (bucketed.bars_between(spark, bucketed.write_bars(bars, buckets=8)) for _ in range(2))
        both = a.join(b.withColumnRenamed("close", "other"), ["symbol", "trade_date"])
        assert "Exchange" not in plan(both) and both.where("close = other").count() == 23 * 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_dates_of_a_calendar_prune_months(spark, bars):
    name = bucketed.write_bars(bars, buckets=4)
    ends = bars.where("day(trade_date) = 15 and month(trade_date) in (2, 5)").select("trade_date").distinct()
    out = bucketed.bars_on(spark, name, ends)
    assert "dynamicpruning" in plan(out).lower()
    found = {r.trade_date for r in out.select("trade_date").distinct().collect()}
    assert found == {dt.date(2023, 2, 15), dt.date(2023, 5, 15)}


def test_null_days_and_empty_frames(spark, bars):
    odd = bars.limit(3).union(spark.createDataFrame([("S1", None, 1.0)], bars.schema))
    assert spark.table(bucketed.write_bars(odd, buckets=2)).count() == 4
    assert bucketed.bars_between(spark, bucketed.write_bars(bars.limit(0), buckets=2), dt.date(2023, 1, 1)).count() == 0
