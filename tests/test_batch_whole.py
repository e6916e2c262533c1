"""A batch never passes off a failure of its machines as a result."""

from __future__ import annotations

import datetime
import errno

import pytest
from pyspark.sql import functions as F

from quantspark.functions.expr import field, mean, rank
from quantspark.operators import batch
from quantspark.plans import load_all, q_maintenance
from quantspark.plans.registry import QUERIES

load_all()
X = field("close")
FACTORS = {"a": rank(mean(X, 3)), "b": mean(rank(X), 4), "c": mean(X, 5)}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(s, datetime.date(2024, 1, 1 + d), float(s * d % 7), "n/a") for s in range(6) for d in range(20)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, close double, note string")


def on_the_driver(wide):
    raise OSError(errno.ENOSPC, "No space left on device")


def in_a_task(wide):
    def full(frames):
        raise OSError(28, "No space left on device")

    return wide.mapInPandas(full, wide.schema)


@pytest.mark.parametrize("breaks", [on_the_driver, in_a_task])
def test_a_full_disk_is_no_failed_factor(bars, monkeypatch, breaks):
    long_values = batch.long_values
    monkeypatch.setattr(batch, "long_values", lambda wide, names: long_values(breaks(wide) if "b" in names else wide, names))
    with pytest.raises(Exception, match="No space left"):
        batch.run_factors(bars, FACTORS, section_rows=6, rows=120, width=2)
    with pytest.raises(Exception, match="No space left"):
        batch.run_frames(bars, {"b": lambda: bars.select("symbol", "trade_date", F.col("close").alias("b"))})


def test_values_that_went_missing_are_no_result(spark, bars):
    done = batch.run_factors(bars, {"a": FACTORS["a"]}, section_rows=6, rows=120)
    folder = done.values.inputFiles()[0].rpartition("/")[0]
    batch.drop_folder(spark, folder)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        batch.written(bars, [folder]).count()


def test_a_family_is_whole_or_fails(spark, bars, monkeypatch):
    good = batch.run_factors(bars, FACTORS, section_rows=6, rows=120)
    assert good.whole().count() == good.values.count() > 0
    bad = batch.run_factors(bars, {**FACTORS, "at_run_time": mean(field("note") * 1.0, 3)}, section_rows=6, rows=120)
    assert list(bad.errors) == ["at_run_time"] and bad.values.count() == good.values.count()
    with pytest.raises(batch.Incomplete, match="at_run_time"):
        bad.whole()
    monkeypatch.setattr(q_maintenance, "run_factors", lambda *_, **__: bad)
    for name in ("pff36_batch_paper", "ap15_batch_alphas", "rf09_batch_research"):
        with pytest.raises(batch.Incomplete):
            QUERIES[name](spark, "/root/testdata/sf0.001")
