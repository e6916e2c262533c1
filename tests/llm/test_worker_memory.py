"""Python workers, which Spark keeps between stages, do not keep what a stage has used."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantspark.llm import bpe, common
from quantspark.llm.queries import vocabulary_path


def test_words_stay_until_the_worker_turns_to_another_operator(spark):
    path = vocabulary_path()
    texts = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.md5((F.col("id") * 300 + i).cast("string"))))
    docs = spark.range(0, 40, 1, 8).select(F.col("id").alias("doc_id"), texts.alias("text"))
    ids = [bpe.encode(docs, path).orderBy("doc_id").collect() for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 40 and all(r["ids"] for r in ids[0])

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([bpe.loaded.cache_info().currsize] * batch.num_rows, pa.int64())], names=["kept"])

    rows = spark.range(0, 40, 1, 8)
    seen = [{r["kept"] for r in rows.mapInArrow(run, "kept long").collect()} for run in (common.released(left, bpe.__name__), common.released(left))]
    assert 1 in seen[0] and seen[1] == {0}


def test_memory_is_given_back_after_the_last_batch_and_after_an_error(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))

    @common.released
    def run(batches):
        for b in batches:
            yield 10 // b

    out = run(iter([1, 2, 5]))
    assert next(out) == 10 and not calls
    assert list(out) == [5, 2] and calls == [1]
    with pytest.raises(ZeroDivisionError):
        list(run(iter([0])))
    assert calls == [1, 1]


def test_give_back_leaves_live_memory_alone():
    kept = pa.array(np.arange(100_000))
    common.give_back()
    assert kept[99_999].as_py() == 99_999
