"""Store, sinks, scans, filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantspark.operators import filters as pf
from quantspark.sources import scan, sinks, store
from quantspark.sources.vendor import numeric_columns

D1, D2 = dt.date(2024, 1, 30), dt.date(2024, 2, 1)


def values(spark, rows):
    return spark.createDataFrame(rows, "symbol string, trade_date date, factor_name string, value double")


def test_append_is_latest_wins(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append(values(spark, [("A", D1, "f", 1.0), ("A", D1, "f", 2.0), ("B", D2, "f", 5.0), ("C", D2, "f", None)]), path, version=1)
    store.append(values(spark, [("A", D1, "f", 9.0)]), path, version=2)
    store.append(values(spark, [("A", D1, "f", 9.0)]), path, version=2)
    got = {(r.symbol, r.trade_date): r.value for r in store.latest(spark.read.parquet(path)).collect()}
    assert got == {("A", D1): 9.0, ("B", D2): 5.0}


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError):
        store.normalise(spark.createDataFrame([("A",)], "symbol string"))


def test_params_hash_matches_column(spark):
    df = spark.range(1).select(store.params_hash_column(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("h"))
    assert df.first().h == store.params_hash({"a": "1", "b": "2"})


def test_normal_time(spark):
    df = spark.createDataFrame([("9:5",), ("0905",), ("09:05:00",), (None,)], "t string")
    assert [r[0] for r in df.select(store.normal_time(F.col("t"))).collect()] == ["09:05", "09:05", "09:05", ""]


def test_write_upsert_touches_only_its_months(spark, tmp_path):
    path = str(tmp_path / "bars")
    schema = "symbol string, trade_date date, close double"
    sinks.write_upsert(spark, path, spark.createDataFrame([("A", D1, 1.0), ("B", D1, 2.0), ("A", D2, 3.0)], schema), ["symbol", "trade_date"], "trade_date")
    january = {r.f for r in spark.read.parquet(path).where("month = 1").select(F.col("_metadata.file_name").alias("f")).distinct().collect()}
    sinks.write_upsert(spark, path, spark.createDataFrame([("A", D2, 30.0), ("C", D2, 4.0)], schema), ["symbol", "trade_date"], "trade_date")
    after = spark.read.parquet(path)
    assert {(r.symbol, r.trade_date): r.close for r in after.collect()} == {("A", D1): 1.0, ("B", D1): 2.0, ("A", D2): 30.0, ("C", D2): 4.0}
    assert january == {r.f for r in after.where("month = 1").select(F.col("_metadata.file_name").alias("f")).distinct().collect()}


def test_compact(spark, tmp_path):
    path = str(tmp_path / "store")
    for v in (1, 2):
        sinks.append_rows(values(spark, [("A", D1, "f", float(v))]).withColumn("version", F.lit(v)), path, "trade_date")
    assert sinks.crowded_partitions(spark, path, 1).count() == 1
    dry = sinks.compact(spark, path, ["symbol", "trade_date", "factor_name"], F.col("version"), dry_run=True)
    assert [r.files for r in dry.collect()] == [2] and spark.read.parquet(path).count() == 2
    sinks.compact(spark, path, ["symbol", "trade_date", "factor_name"], F.col("version"))
    assert [r.value for r in spark.read.parquet(path).collect()] == [2.0]
    assert sinks.crowded_partitions(spark, path, 1).count() == 0
    assert [p.name for p in tmp_path.iterdir()] == ["store"]  # no staging folder stays


def test_a_big_month_is_several_files(spark, tmp_path):
    path = str(tmp_path / "big")
    df = spark.range(400_000).select(F.concat(F.lit("S"), F.col("id") % 500).alias("symbol"), F.lit(D1).alias("trade_date"), F.rand(1).alias("value"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sinks.append_rows(df.repartition(16), path, "trade_date")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    report = sinks.crowded_partitions(spark, path, 1).collect()
    assert report and report[0].files > 1 and report[0].row_count == 400_000


def test_symbol_csvs(spark, tmp_path):
    (tmp_path / "000001.SZ.csv").write_text("DateTime,Open,High,Low,Close,Volume\n2024-01-02 09:31:00,1,2,1,1.5,10\n2024-01-02 09:32:00,9,2,1,1.5,10\n")
    rows = scan.read_symbol_csvs(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.close) for r in rows] == [("000001.SZ", 1.5)]


def test_minute_fallback(spark):
    schema = "symbol string, trade_date date, minute_of_day int, close double"
    full = spark.createDataFrame([("A", D1, 570, 1.0), ("A", D1, 571, 2.0)], schema)
    sparse = spark.createDataFrame([("A", D1, 570, 7.0)], schema)
    read = lambda s: [r.close for r in scan.load_minute(full, ["A"], D1, D2, ["09:30"], s).collect()]
    assert read(sparse) == [7.0] and read(sparse.limit(0)) == [1.0]
    more = full.union(spark.createDataFrame([("A", dt.date(2024, 1, 1), 570, 3.0)], schema)) if D1 != dt.date(2024, 1, 1) else full.union(spark.createDataFrame([("B", D1, 570, 3.0)], schema))
    found = scan.load_minute(more, ["A", "B"], dt.date(2023, 12, 1), D2, ["09:30"], sparse).collect()
    assert sorted(r.close for r in found) == [3.0, 7.0]  # what the sparse table lacks comes from the full one


def test_filter_rules(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "n int, s string")
    with pytest.raises(ValueError):
        pf.build_filter({"column": "nope", "op": "=", "value": 1}, df.columns)
    assert pf.build_filter({"column": "n", "op": "=", "value": ""}, df.columns) is None
    assert pf.apply_filters(df, [{"column": "s", "op": "is null"}]).count() == 1
    with pytest.raises(ValueError):
        pf.read_only_sql(spark, "drop table x")


def test_preview_estimates_without_counting(spark):
    rows, total = pf.preview(spark.range(100), 1, 10)
    assert rows.count() == 10 and total.first().total == 11
    assert pf.preview(spark.range(100), 1, 10, include_total=True)[1].first().total == 100
    assert pf.preview(spark.range(100), 11, 10)[1].first().total == 100


def test_numeric_probe(spark):
    df = spark.createDataFrame([("1", "x", "5")] * 8 + [("a", "y", "")] * 2, "p string, q string, r string")
    assert numeric_columns(df) == ["p", "r"]


def test_partition_predicate_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = [("A", dt.date(2024, m, 5), 1.0, 2.0) for m in range(1, 7)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume double")
    sinks.append_rows(df, path, "trade_date")
    plan = scan.load_daily(spark.read.parquet(path), ["A"], dt.date(2024, 2, 1), dt.date(2024, 3, 1), ["close"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in text or "PartitionFilters: [((" in text
    assert "PushedFilters" in text and "volume" not in text.split("ReadSchema")[1]
    assert plan.count() == 1
