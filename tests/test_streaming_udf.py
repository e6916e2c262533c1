"""Streams equal their batch twins; user-code surfaces validate."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantspark.functions import udf
from quantspark.sources.store import latest
from quantspark.streaming import jobs

SCHEMA = "symbol string, start timestamp_ntz, close double, volume double, anchor double"


def bars(spark):
    rows = []
    for s, base in (("A", 10.0), ("B", 20.0)):
        for i in range(60):
            close = base * (1 + 0.3 * ((i * 7 % 11) - 5) / 5)
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), close, 1.0 + i % 3, base * (1 + i / 200)))
    return spark.createDataFrame(rows, SCHEMA)


def folded(rows, step, reset):
    """The signals of bars by a plain fold in the order of time."""
    want, ref = {}, {}
    for r in sorted(rows, key=lambda r: r.start):
        if r.symbol not in ref or abs(r.close / r.anchor - 1) > reset:
            ref[r.symbol] = r.anchor
        level = ref[r.symbol]
        action = "BUY" if r.close <= level * (1 - step) else "SELL" if r.close >= level * (1 + step) else "HOLD"
        want[(r.symbol, r.start)] = (round(level, 9), action)
    return want


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_grid_stream_takes_files_out_of_order(spark, tmp_path, files_per_batch):
    """Six files of shuffled bars, the last ten minutes first, one file a batch: the same rows as the fold."""
    rows = bars(spark).select("symbol", "start", "close", "anchor").collect()
    rnd = random.Random(3)
    slots = [[r for r in rows if r.start.minute // 10 == k] for k in (5, 2, 0, 4, 1, 3)]
    schema = "symbol string, start timestamp_ntz, close double, anchor double"
    for k, part in enumerate(slots):
        rnd.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    out = jobs.replay_grid_signals(spark, str(tmp_path / "in"), schema, 0.1, 0.25, "1 hour", files_per_batch)
    got = [(r.symbol, r.start, round(r.reference, 9), r.action) for r in out.collect()]
    assert len(got) == len(rows) and {g[:2]: g[2:] for g in got} == folded(rows, 0.1, 0.25)


def test_grid_stream_gives_bars_once_the_watermark_passes(spark, tmp_path):
    """In order and one file a batch, early bars come out before the stream ends; late ones are dropped."""
    rows = bars(spark).select("symbol", "start", "close", "anchor").collect()
    schema = "symbol string, start timestamp_ntz, close double, anchor double"
    for k in (0, 1, 2, 3, 4, 5):
        part = [r for r in rows if r.start.minute // 10 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    late = spark.createDataFrame([("A", dt.datetime(2023, 12, 31), 1.0, 1.0)], schema)
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "p6"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/*")
        out = jobs.run_available(jobs.stream_grid_signals(stream, 0.1, 0.25, "5 minutes")).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    passed = [r for r in rows if r.start <= dt.datetime(2024, 1, 1, 0, 54)]
    assert {(r.symbol, r.start): (round(r.reference, 9), r.action) for r in out} == folded(passed, 0.1, 0.25)


def test_alert_stream_joins_static_reference(spark, tmp_path):
    bars(spark).write.parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([("A", 3.0, 12.0, 7.5)], "symbol string, max_volume double, up_limit double, down_limit double")
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = sorted(map(str, jobs.run_available(jobs.alerts(stream, ref)).collect()))
    assert got == sorted(map(str, jobs.alerts(bars(spark), ref).collect())) and got


def ticks(spark, folder, files):
    """Random ticks in several files, in the order of time."""
    rnd = random.Random(5)
    start = dt.datetime(2024, 1, 1, 9)
    rows = [(i, start + dt.timedelta(seconds=20 * i), i % 3, "AB"[i % 2], float(rnd.randint(1, 50)), '{"k": %d}' % (i % 7)) for i in range(600)]
    size = len(rows) // files
    for k in range(files):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], jobs.EVENTS)
        part.coalesce(1).write.mode("append").parquet(folder)


def test_any_split_into_batches_gives_the_same_rows(spark, tmp_path):
    """One batch and five batches agree with each other and hold the last, open windows."""
    ticks(spark, str(tmp_path / "in"), 5)
    for make, keys in (
        (jobs.stream_bars, ["symbol", "start"]), (jobs.stream_vwap, ["symbol", "start"]),
        (lambda t: jobs.stream_cum_volume(t, ["10:30", "14:00"]), ["symbol", "trade_date"]),
    ):
        found = [sorted(map(str, jobs.run_upserts(make(jobs.tick_stream(spark, str(tmp_path / "in"), files_per_batch=k)), keys).collect())) for k in (None, 1)]
        assert found[0] == found[1] and found[0]
    bars_ = jobs.run_upserts(jobs.stream_bars(jobs.tick_stream(spark, str(tmp_path / "in"), files_per_batch=1)), ["symbol", "start"])
    assert bars_.agg(F.max("start")).first()[0] == dt.datetime(2024, 1, 1, 9) + dt.timedelta(minutes=599 * 20 // 60)


def test_store_stream_does_not_depend_on_batches(spark, tmp_path):
    ticks(spark, str(tmp_path / "in"), 4)
    found = []
    for k in (None, 1):
        values = jobs.tick_stream(spark, str(tmp_path / "in"), files_per_batch=k).select(
            "symbol", F.to_date("datetime").alias("trade_date"), F.lit("p").alias("factor_name"), F.col("price").alias("value"), F.unix_micros("datetime").alias("version"))
        for again in ("a", "b"):  # the second run repeats every batch
            jobs.stream_append(values, str(tmp_path / f"store{k}"), str(tmp_path / f"state{k}{again}")).start().awaitTermination()
        found.append(sorted((r.symbol, r.value) for r in latest(spark.read.parquet(str(tmp_path / f"store{k}"))).collect()))
    assert found[0] == found[1] and len(found[0]) == 2


def panel(spark):
    rows = [(s, dt.date(2024, 1, d), float(d)) for s in ("A.X", "B.X") for d in range(1, 11)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, close double")


def test_python_factor_drops_bad_rows(spark):
    def factor(bars, context):
        out = bars[["symbol", "trade_date"]].copy()
        out["value"] = [float("inf"), float("nan")] + [context["k"]] * (len(bars) - 2)
        return out

    rows = udf.run_python_factor(panel(spark), factor, dt.date(2024, 1, 1), dt.date(2024, 1, 5), {"k": 2.0}).collect()
    assert len(rows) == 6 and {r.value for r in rows} == {2.0}


def test_python_factor_must_return_its_columns(spark):
    with pytest.raises(Exception, match="missing"):
        udf.run_python_factor(panel(spark), lambda b, c: pd.DataFrame({"x": [1]}), dt.date(2024, 1, 1), dt.date(2024, 1, 5)).collect()


def test_section_scorer_takes_dates_of_any_size(spark):
    spark.conf.set("quantspark.maxGroupRows", "1")
    try:
        rows = udf.score_sections(panel(spark), lambda s: s["close"] - s["top"], {"top": F.max("close")}).collect()
    finally:
        spark.conf.unset("quantspark.maxGroupRows")
    assert rows and max(r.score for r in rows) == 0.0


def test_registry(spark):
    reg = udf.default_registry()
    assert "rank" in reg.by_category("cross_section") and "rsi" in reg.by_level("L3")
    with pytest.raises(ValueError):
        reg.register("rank", None, "L2", "cross_section")
    assert reg.catalogue(spark).where(F.col("name") == "ema").first().level == "L1"
