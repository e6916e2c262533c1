"""Structured Streaming twins of the intraday jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quantspark.operators.joins import newest
from quantspark.operators.rowwise import sdiv
from quantspark.session import shared_root
from quantspark.sources.panels import digits_plus_one
from quantspark.sources.scan import minute_of
from quantspark.sources.store import append

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def tick_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Tick files of a folder as a stream; the event time is a UTC timestamp because
    watermarks need one."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(folder)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("datetime"), "event_id",
        F.col("value").alias("price"), digits_plus_one().alias("volume"),
    )


def stream_bars(ticks: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars; rows later than ``delay`` are dropped."""
    at = F.struct("datetime", "event_id")
    bars = ticks.withWatermark("datetime", delay).groupBy(F.window("datetime", width), "symbol").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "volume")


def stream_dedupe(rows: DataFrame, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    return rows.withWatermark("datetime", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_cum_volume(ticks: DataFrame, times: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """Volume up to each listed time, one row per symbol-day: conditional sums of one aggregate."""
    minute = F.hour("datetime") * 60 + F.minute("datetime")
    sums = [F.sum(F.when(minute <= minute_of(t), F.col("volume"))).alias("v_" + t.replace(":", "")) for t in times]
    days = ticks.withWatermark("datetime", delay).groupBy(F.window("datetime", "1 day"), "symbol").agg(*sums)
    return days.select("symbol", F.to_date("window.start").alias("trade_date"), *["v_" + t.replace(":", "") for t in times])


ALERT = "high_volume or touch_up or touch_down"


def alerts(bars: DataFrame, reference: DataFrame, ratio: float = 0.9) -> DataFrame:
    """The bars with a high-volume or band-touch flag; works on batch and stream."""
    return alert_flags(bars, reference, ratio).where(ALERT)


def alert_flags(bars: DataFrame, reference: DataFrame, ratio: float = 0.9) -> DataFrame:
    """High-volume and band-touch flags of every bar against a static table.

    An update-mode stream keeps the unflagged bars too, since a later tick can lift a flag.
    """
    j = bars.join(reference, "symbol")
    share = sdiv(F.col("volume"), F.col("max_volume"))
    return j.select(
        *[c for c in ("symbol", "start", "trade_date", "minute_of_day") if c in bars.columns],
        share.alias("share"), (share > ratio).alias("high_volume"),
        (F.col("close") >= F.col("up_limit")).alias("touch_up"), (F.col("close") <= F.col("down_limit")).alias("touch_down"),
    )


def stream_vwap(ticks: DataFrame, width: str = "30 minutes", slide: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    out = ticks.withWatermark("datetime", delay).groupBy(F.window("datetime", width, slide), "symbol").agg(
        sdiv(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap")
    )
    return out.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("start"), "vwap")


GRID_OUT = "symbol string, start timestamp, close double, reference double, action string"
WAITING = "start timestamp, close double, anchor double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GridSignals(StatefulProcessor):
    """Band crossings of one symbol in the order of event time.

    Bars wait in the state until the watermark has passed them; a timer at the earliest one then
    hands out all that are due, sorted. The state is one reference and the bars of one delay. A
    reset depends on its bar alone, so the reference is the last reset anchor, or the carried one.
    """

    def __init__(self, step: float, reset: float):
        self.step, self.reset = step, reset

    def init(self, handle) -> None:
        self.handle = handle
        self.reference = handle.getValueState("reference", "reference double")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            bars = frame[["start", "close", "anchor"]]
            self.waiting.appendList(list(bars.itertuples(index=False, name=None)))
            self.handle.registerTimer(_millis(bars["start"]).min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bars = pd.DataFrame(list(self.waiting.get()), columns=["start", "close", "anchor"])
        if bars.empty:
            return
        bars["start"] = pd.to_datetime(bars["start"])
        due = _millis(bars["start"]) <= timerValues.getCurrentWatermarkInMs()
        rest = bars[~due]
        if due.any():
            yield self.signals(key[0], bars[due].sort_values("start", kind="stable"))
        if rest.empty:
            self.waiting.clear()
            return
        self.waiting.put(list(rest.itertuples(index=False, name=None)))
        self.handle.registerTimer(_millis(rest["start"]).min())

    def signals(self, symbol, rows: pd.DataFrame) -> pd.DataFrame:
        resets = (rows["close"] / rows["anchor"] - 1.0).abs() > self.reset
        known = self.reference.exists()
        if not known:
            resets.iloc[0] = True
        reference = rows["anchor"].where(resets).ffill()
        if known:
            reference = reference.fillna(self.reference.get()[0])
        self.reference.update((float(reference.iloc[-1]),))
        low, high = rows["close"] <= reference * (1.0 - self.step), rows["close"] >= reference * (1.0 + self.step)
        return pd.DataFrame({
            "symbol": symbol, "start": rows["start"], "close": rows["close"], "reference": reference,
            "action": np.select([low, high], ["BUY", "SELL"], "HOLD"),
        })

    def close(self) -> None:
        pass


def _millis(starts: pd.Series) -> pd.Series:
    return (starts - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)


def stream_grid_signals(bars: DataFrame, step: float, reset: float, delay: str = "10 minutes") -> DataFrame:
    """Band crossings against a per-symbol reference that resets to the anchor.

    ``bars`` carries symbol, start, close, anchor, in any order of arrival within ``delay``; later
    ones are dropped. A signal comes out once the watermark has passed its bar. Needs the RocksDB
    state store (``ROCKSDB``).
    """
    timed = bars.select("symbol", F.col("start").cast("timestamp").alias("start"), "close", "anchor").withWatermark("start", delay)
    out = timed.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=GridSignals(step, reset), outputStructType=GRID_OUT, outputMode="Append", timeMode="EventTime"
    )
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def replay_grid_signals(spark: SparkSession, folder: str, schema: str, step: float, reset: float, delay: str,
                        files_per_batch: int) -> DataFrame:
    """All signals of a folder of bars whose files are out of order by ``delay`` at most.

    The stream runs through what is there. Then a closing row without a symbol, later than every
    bar by more than ``delay``, moves the watermark past the bars that still wait, and the same
    query runs on from its checkpoint.
    """
    work = work_folder(spark)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/*")
        signals = stream_grid_signals(stream, step, reset, delay)
        _run_on(signals, work)
        rows = spark.read.schema(schema).parquet(f"{folder}/*")
        end = F.expr(f"max(start) + 2 * interval {delay} + interval 1 day")
        rows.agg(F.lit(None).cast("string").alias("symbol"), end.alias("start"), F.lit(1.0).alias("close"), F.lit(1.0).alias("anchor")) \
            .where("start is not null").write.parquet(f"{folder}/closing")
        _run_on(signals, work)
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return spark.read.schema(signals.schema).parquet(work + "/out").where("symbol is not null")


def stream_append(values: DataFrame, path: str, checkpoint: str):
    """Append every micro-batch to the factor store.

    ``values`` carries the version, which comes from the data (such as the event time), so the
    newest value does not depend on how files fall into batches. A retried batch adds rows equal
    to those it added before, which the store's latest-wins reading folds together.
    """

    def write(batch: DataFrame, number: int) -> None:
        append(batch, path, source="stream")

    return values.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def work_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{shared_root(spark).rstrip('/')}/{uuid.uuid4().hex}"


def _run_on(stream: DataFrame, folder: str) -> None:
    """Process what is there since the last run on ``folder``."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", folder + "/out")
        .option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_available(stream: DataFrame) -> DataFrame:
    """Process what is there, then read the result from the file sink."""
    folder = work_folder(stream.sparkSession)
    _run_on(stream, folder)
    return stream.sparkSession.read.schema(stream.schema).parquet(folder + "/out")


def run_upserts(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Process what is there in update mode; the newest row of every key, open windows included.

    Each micro-batch writes its changed rows to a folder of its own and overwrites that folder
    when it is retried, so no row is lost or doubled. Without any file the result is empty.
    """
    spark = stream.sparkSession
    folder = work_folder(spark)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], stream.schema).write.parquet(folder + "/out/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(schema).parquet(folder + "/out")
    return newest(rows, list(keys), F.col("batch"), stream.columns)
