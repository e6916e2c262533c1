"""Shuffle files of a batch go with the job that wrote them."""

from __future__ import annotations

import datetime

from quantspark.functions.expr import field, mean, rank
from quantspark.operators import batch

X = field("close")


def test_shuffle_files_go_with_their_job(spark):
    setting = spark.conf.get(batch.SHUFFLES_GO)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        return {n for n in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}

    rows = [(s, datetime.date(2024, 1, 1 + d), float(s * d % 7)) for s in range(6) for d in range(20)]
    df = spark.createDataFrame(rows, "symbol long, trade_date date, close double").repartition(3)
    before = shuffle_files()
    done = batch.run_factors(df, {"a": rank(mean(X, 3)), "b": mean(rank(X), 4), "c": mean(X, 5)}, section_rows=6, rows=120, width=2)
    assert not shuffle_files() - before
    assert spark.conf.get(batch.SHUFFLES_GO) == setting
    assert not done.errors and done.values.count() == 6 * (18 + 17 + 16)
