"""Bars bucketed by symbol and partitioned by month, as tables of the session's catalogue.

Rows of a symbol lie in one bucket, sorted by day, so symbol windows and joins on the symbol need
no shuffle (joins on symbol and day too, where ``spark.sql.requireAllClusterKeysForCoPartition``
is off); months that a scan does not want are never listed. Each task writes one bucket, hence
one file per bucket and month.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.session import int_conf, new_folder
from quantspark.sources.sinks import with_month

def write_bars(df: DataFrame, name: str | None = None, path: str | None = None, *, buckets: int | None = None,
               key: str = "symbol", day: str = "trade_date") -> str:
    """Writes ``df`` as a bucketed table and returns its name.

    Without a ``path`` the files go to the shared folder. A table of that name is replaced. There
    are as many buckets as the session has shuffle partitions, unless told otherwise. Rows with a
    null day lie in a month of their own; an empty frame gives an empty table.
    """
    n = buckets or int_conf(df.sparkSession, "spark.sql.shuffle.partitions", 200)
    name = name or f"bars_{uuid.uuid4().hex}"
    rows = with_month(df, day).repartition(n, key)  # the same hash as that of the buckets
    writer = rows.write.mode("overwrite").format("parquet").option("path", path or new_folder(df.sparkSession))
    writer.partitionBy("year", "month").bucketBy(n, key).sortBy(key, day).saveAsTable(name)
    return name


def months_between(start: date | None, end: date | None) -> Column:
    """The condition on the folders of a date range."""
    at = F.col("year") * 12 + F.col("month").cast("int")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (at >= start.year * 12 + start.month)
    if end is not None:
        inside = inside & (at <= end.year * 12 + end.month)
    return inside


def bars_between(spark: SparkSession, name: str, start: date | None = None, end: date | None = None, day: str = "trade_date") -> DataFrame:
    """Bars of a date range, both ends included; only the folders of its months are read."""
    rows = spark.table(name).where(months_between(start, end))
    if start is not None:
        rows = rows.where(F.col(day) >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col(day) <= F.lit(end))
    return rows.drop("year", "month")


def bars_on(spark: SparkSession, name: str, days: DataFrame, day: str = "trade_date") -> DataFrame:
    """Bars on the dates of ``days`` (one row per date, calendar-sized).

    The join names the month folders too, so Spark prunes them once it knows the dates.
    """
    wanted = with_month(days.select(day).distinct(), day)
    return spark.table(name).join(F.broadcast(wanted), ["year", "month", day]).drop("year", "month")
