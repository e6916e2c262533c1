"""Writes that become visible at once, or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantspark.sources.versioned import Conflict, Dataset, Manifest

KEYS = ["symbol", "trade_date"]


def bars(spark, rows):
    return spark.createDataFrame([(s, dt.date(2024, m, d), x) for s, m, d, x in rows], "symbol string, trade_date date, close double")


def content(data, **kw):
    return sorted((r.symbol, r.trade_date.month, r.trade_date.day, r.close) for r in data.rows(**kw).collect())


@pytest.fixture
def data(spark, tmp_path):
    d = Dataset(spark, f"{tmp_path}/bars", KEYS)
    d.upsert(bars(spark, [("a", 1, 5, 1.0), ("b", 1, 6, 2.0), ("a", 2, 5, 3.0), ("a", 3, 5, 4.0)]))
    return d


def test_upsert_reads_and_writes_touched_months_only(spark, data):
    before = data.manifest()
    data.upsert(bars(spark, [("a", 2, 5, 30.0), ("c", 2, 9, 31.0)]))
    after = data.manifest()
    assert content(data) == [("a", 1, 5, 1.0), ("a", 2, 5, 30.0), ("a", 3, 5, 4.0), ("b", 1, 6, 2.0), ("c", 2, 9, 31.0)]
    assert {m for m in after.months if after.months[m] != before.months.get(m)} == {(2024, "02")}
    assert content(data, manifest=before) == [("a", 1, 5, 1.0), ("a", 2, 5, 3.0), ("a", 3, 5, 4.0), ("b", 1, 6, 2.0)]  # older readers keep theirs


def test_a_run_killed_before_the_swap_changes_nothing(spark, data, monkeypatch):
    before, due = data.manifest(), content(data)

    class Killed(BaseException):
        pass

    def die(self, new):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(Dataset, "commit", die)
        with pytest.raises(Killed):
            data.upsert(bars(spark, [("a", 1, 5, 100.0)]))
    assert data.manifest() == before and content(data) == due
    data.upsert(bars(spark, [("z", 1, 7, 7.0)]))
    assert content(data) == sorted([*due, ("z", 1, 7, 7.0)])
    assert len(data.vacuum()) == 1 + 0  # what the killed run wrote; the first folder still holds other months
    assert content(data) == sorted([*due, ("z", 1, 7, 7.0)])


def test_a_killed_write_is_no_part_of_a_plan(spark, data, monkeypatch):
    """Rows read before another write stay readable after it."""
    old = data.rows()
    data.upsert(bars(spark, [("a", 1, 5, 9.0)]))
    assert old.where("close = 1.0").count() == 1


@pytest.mark.parametrize("other", [[("b", 1, 6, 20.0)], [("a", 3, 8, 8.0)]])
def test_two_writers(spark, data, monkeypatch, other):
    """Another writer commits between the write and the swap: both writes are in the result."""
    swap, others = Dataset.commit, []

    def late(self, new):
        if not others:
            others.append(1)
            rival = Dataset(spark, self.path, KEYS)
            rival.upsert(bars(spark, other))
        swap(self, new)

    monkeypatch.setattr(Dataset, "commit", late)
    data.upsert(bars(spark, [("a", 1, 5, 10.0)]))
    due = {("a", 1, 5): 10.0, ("b", 1, 6): 2.0, ("a", 2, 5): 3.0, ("a", 3, 5): 4.0, **{r[:3]: r[3] for r in other}}
    assert {r[:3]: r[3] for r in content(data)} == due and data.manifest().version == 3


def test_a_version_is_committed_once(data):
    with pytest.raises(Conflict):
        data.commit(Manifest(1, {}, None))


def test_columns_and_ranges(spark, data):
    data.upsert(bars(spark, [("n", 2, 6, 5.0)]).withColumn("note", F.lit("new")))
    rows = {(r.symbol, r.trade_date.month): r.note for r in data.rows().collect()}
    assert rows["n", 2] == "new" and rows["a", 1] is None
    some = data.between(dt.date(2024, 1, 6), dt.date(2024, 2, 5))
    assert sorted((r.symbol, r.close) for r in some.collect()) == [("a", 3.0), ("b", 2.0)]
    assert not any("month=03" in f for f in some.inputFiles())
    assert data.between(dt.date(2030, 1, 1), dt.date(2030, 2, 1)).count() == 0
    data.drop_months([(2024, "02")])
    assert {r.trade_date.month for r in data.rows().collect()} == {1, 3}


def test_empty(spark, tmp_path):
    d = Dataset(spark, f"{tmp_path}/none", KEYS)
    assert d.rows() is None and d.vacuum() == []
    assert d.upsert(bars(spark, [])).version == 0
