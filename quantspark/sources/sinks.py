"""Partitioned writers, upserts, migration and compaction."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.operators.joins import newest

def with_month(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns({"year": F.year(day), "month": F.date_format(day, "MM")})


def upserted(old: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old and new rows, the newest batch winning per key."""
    both = old.withColumn("batch_", F.lit(0)).unionByName(batch.withColumn("batch_", F.lit(1)), allowMissingColumns=True)
    return newest(both, list(keys), F.col("batch_")).drop("batch_")


def write_upsert(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], day: str) -> None:
    """Replace only the months the batch touches."""
    batch = with_month(batch, day)
    months = [(r["year"], r["month"]) for r in batch.select("year", "month").distinct().collect()]  # months only
    touched = F.lit(False)
    for year, month in months:
        touched = touched | ((F.col("year") == year) & (F.col("month") == month))
    try:
        old = spark.read.parquet(path).withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    except Exception as error:  # first write: the folder does not exist
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = batch.limit(0)
    replace_months(spark, upserted(old.where(touched), batch, keys), path)


def replace_months(spark: SparkSession, rows: DataFrame, path: str, sort: Sequence[str] = ()) -> None:
    """Overwrite the months that ``rows`` has.

    The rows go to a staging folder of this run first, because a partition cannot be overwritten
    while it is being read. The folder goes after the swap; a swap that fails leaves it, so that
    nothing is lost.
    """
    staged = f"{path.rstrip('/')}__staged_{uuid.uuid4().hex}"
    write_partitioned(rows, staged, "overwrite", sort=sort)
    fresh = spark.read.parquet(staged).withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_partitioned(df: DataFrame, path: str, mode: str = "append", parts: Sequence[str] = ("year", "month"),
                      sort: Sequence[str] = ()) -> None:
    """Rows of one partition folder go together; AQE splits a folder that outgrows a task over several files."""
    df = df.hint("rebalance", *[F.col(p) for p in parts])
    if sort:
        df = df.sortWithinPartitions(*parts, *sort)
    df.write.mode(mode).partitionBy(*parts).parquet(path)


def append_rows(df: DataFrame, path: str, day: str, source: str = "batch", sort=("symbol",)) -> None:
    if "source" not in df.columns:
        df = df.withColumn("source", F.lit(source))
    write_partitioned(with_month(df, day), path, "append", sort=[*sort, day])


def append_indicators(df: DataFrame, path: str, day: str = "trade_date") -> None:
    write_partitioned(with_month(df, day), path, "append", ("indicator_name", "year", "month"), sort=("symbol", day))


def migrated(df: DataFrame, names: Mapping[str, str], old: str = "feature_name", new: str = "factor_name") -> DataFrame:
    """Legacy rows under the new column, with names mapped where a new name exists."""
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return df.withColumn(new, F.coalesce(F.try_element_at(lookup, F.col(old)), F.col(old))).drop(old)


def patched(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key upsert in which NULL incoming fields do not overwrite."""
    fields = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in fields if c in new.columns])
    j = old.join(renamed, list(keys), "full")
    return j.select(*keys, *[
        (F.coalesce(f"new_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in fields
    ])


def refreshed_master(master: DataFrame, statements: DataFrame) -> DataFrame:
    """Master with the newest quarter's figures: pe = mv / net income, pb = mv / equity."""
    last = newest(statements, ["symbol"], F.col("report_date"), ["report_date", "net_profit", "total_equity"])
    mv = F.col("total_mv")
    return master.join(last, "symbol", "left").select(
        "symbol", "total_mv", "report_date",
        F.try_divide(mv, F.nullif("net_profit", F.lit(0.0))).alias("pe"),
        F.try_divide(mv, F.nullif("total_equity", F.lit(0.0))).alias("pb"),
    )


def crowded_partitions(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """Partitions with more than ``max_files`` files, from the scanned file names."""
    files = spark.read.parquet(path).select("year", "month", F.col("_metadata.file_name").alias("f"))
    per_file = files.groupBy("year", "month", "f").agg(F.count(F.lit(1)).alias("n"))
    out = per_file.groupBy("year", "month").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("row_count"))
    return out.where(F.col("files") > max_files)


def compact(spark: SparkSession, path: str, keys: Sequence[str], order: Column, max_files: int = 1,
            dry_run: bool = False) -> DataFrame:
    """Rewrite crowded partitions with one row per key; returns the report of what was crowded.

    A dry run only reports.
    """
    report = crowded_partitions(spark, path, max_files).cache()
    rows = report.collect()  # one row per crowded month
    if not rows or dry_run:
        return report
    # months come back from the folder names as integers
    hit = F.lit(False)
    for r in rows:
        hit = hit | ((F.col("year") == r["year"]) & (F.col("month") == r["month"]))
    kept = newest(spark.read.parquet(path).where(hit), list(keys), order)
    kept = kept.withColumn("month", F.lpad(F.col("month").cast("string"), 2, "0"))
    replace_months(spark, kept, path, sort=keys)
    return report
