"""What a batch keeps on disk at a time: one query's shuffle files, narrow rows, averages by date as a calendar."""

from __future__ import annotations

import datetime
import re
import time

import pytest

from quantspark.functions.expr import delay, field, mean, rank, xmean, zscore_pop
from quantspark.operators import batch
from quantspark.operators.panel import with_factors
from quantspark.sources import store as fs

X, Y, U, V = map(field, "xyuv")
MARKET = xmean(X / delay(X, 1) - 1.0)
FACTORS = {
    "excess": X / delay(X, 1) - 1.0 - MARKET, "slow": mean(MARKET, 3), "score": zscore_pop(X) + zscore_pop(zscore_pop(X) * Y),
    "ranked": rank(zscore_pop(zscore_pop(X) * Y) - MARKET), "ratio": rank(X / Y) + rank(U / V) * delay(Y, 2),
}


@pytest.fixture(scope="module")
def bars(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(s, day + datetime.timedelta(d) if (s, d) != (2, 0) else None, 1.0 + s * d % 7, float(s * 3 + d) if d % 5 else None, 2.0 + d, 1.0 + s) for s in range(7) for d in range(15)]
    return spark.createDataFrame(rows, "symbol long, trade_date date, x double, y double, u double, v double")


def long(df):
    return {(r.symbol, r.trade_date, r.factor_name): pytest.approx(r.value) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 4, 48])
def test_averages_by_date_are_a_calendar(bars, width):
    done = batch.run_factors(bars, FACTORS, section_rows=7, rows=105, width=width)
    due = fs.to_long(with_factors(bars, FACTORS, section_rows=7), list(FACTORS))
    assert not done.errors and long(done.values) == long(due)


def test_windows_by_date_take_no_table_of_the_bars(spark, bars):
    nodes, _ = batch.formulas(FACTORS, bars.columns)
    shared = batch.shared_windows(batch.packed(nodes, 1))
    folder = batch.new_folder(spark)
    table, known = batch.with_windows(bars, folder, nodes, shared, 7, 105)
    assert known and all(map(batch.of_date, known.values())) and table.count() == bars.count()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bars")
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_large_jobs_find_no_shuffle_files_of_others(spark, bars, monkeypatch):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        return {n for n in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}

    monkeypatch.setattr(batch, "ALONE_ROWS", 10)
    before, found, in_range = shuffle_files(), [], batch.in_range

    def looks(*args):
        for _ in range(50):  # they go in the background
            if not shuffle_files() - before:
                break
            time.sleep(0.1)
        found.append(len(shuffle_files() - before))
        return in_range(*args)

    monkeypatch.setattr(batch, "in_range", looks)
    assert not batch.run_factors(bars.repartition(3), FACTORS, section_rows=7, rows=105, width=1).errors
    assert found == [0] * len(FACTORS)


def test_rows_are_shuffled_with_results_and_not_with_what_they_come_from(bars):
    out = with_factors(bars, {"value": rank(delay(X, 1) / delay(Y, 1)) + rank(delay(U, 1) / delay(V, 1))}, section_rows=7, rows=10**7).select(*batch.KEYS, "value")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    carried = re.search(r"RepartitionByExpression \[trade_date[^\n]*\n\s*\+- Project \[(.*)\]\n", plan)[1]
    assert len(re.findall(r"r_\w+#\d+", carried)) == 2 and len(carried.split(", ")) == 4  # keys and two quotients, not four windows
