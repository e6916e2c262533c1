"""Tasks bounded by cells: wide window passes get fewer rows, and ranks of a few large sections are dealt by bucket."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quantspark.functions.expr import delay, field, mean, rank
from quantspark.operators.cross_section import quantile_table, value_counts
from quantspark.operators.panel import TASK_COLUMNS, with_factors
from quantspark.session import TASK_ROWS

X = field("x")


def test_wide_passes_get_fewer_rows(spark):
    df = spark.range(0, 4000).select((F.col("id") % 400).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 400).cast("int")).alias("trade_date"), F.col("id").cast("double").alias("x"))
    wide = {f"m{n}": mean(delay(X, n), 2, 1) for n in range(1, 2 * TASK_COLUMNS)}
    one = {"m1": mean(delay(X, 1), 2, 1)}
    spark.conf.set(TASK_ROWS, "200")
    try:
        parts = []
        for outputs in (one, wide):
            out = with_factors(df, outputs, section_rows=1, rows=4000)
            parts.append(out.groupBy(F.spark_partition_id()).count().count())
            assert out.count() == 4000 and out.agg(F.sum("m1")).first()[0] == out.where("m1 is not null").agg(F.sum("m1")).first()[0]
        values = with_factors(df, wide, section_rows=1, rows=4000).select("symbol", "trade_date", "m1", "m9").orderBy("symbol", "trade_date").collect()
        both = with_factors(df, {"r": rank(mean(X, 2, 1))}, section_rows=400, rows=4000)
        assert both.count() == 4000
    finally:
        spark.conf.unset(TASK_ROWS)
    assert 10 <= parts[0] <= 20 and parts[1] > 2 * parts[0]
    assert values == with_factors(df, wide, section_rows=1).select("symbol", "trade_date", "m1", "m9").orderBy("symbol", "trade_date").collect()


def test_ranks_of_few_sections_are_dealt_by_bucket(spark):
    rng = random.Random(3)
    rows = [(s, rng.choice([None, 0.0, round(rng.gauss(0, 1), 3)])) for s in "ab" for _ in range(4000)]
    df = spark.createDataFrame(rows, "s string, v double")
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = value_counts(df, ["s"], F.col("v"))
        assert "cuts_" not in counts.columns
        tasks = counts.groupBy(F.spark_partition_id()).count().count()
        got = {(r["s"], r["v_"]): (r["ties_"], r["n_"], r["first_"]) for r in counts.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    assert tasks > 2  # more than the two sections
    for s in "ab":
        present = sorted(v for k, v in rows if k == s and v is not None)
        assert {k[1] for k in got if k[0] == s} == set(present)
        for v in set(present):
            assert got[s, v] == (present.count(v), len(present), present.index(v) + 1)
    table = {r["s"]: (r["lo"], r["hi"]) for r in quantile_table(df, ["s"], F.col("v"), {"lo": 0.0, "hi": 1.0}).collect()}
    assert table == {s: (min(v for k, v in rows if k == s and v is not None), max(v for k, v in rows if k == s and v is not None)) for s in "ab"}
