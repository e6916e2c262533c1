"""Hard negatives against brute force in Python's integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows):
    valid = set()
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        valid.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in sorted({i for i, _, _ in valid if i % 100 == 0}):
        label, v = min((label, v) for i, label, v in valid if i == a)
        scored = [(sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in valid if j != a and len(w) == len(v)]
        for score, j, _ in sorted((s for s in scored if s[2] == label), key=lambda s: (-s[0], s[1]))[:5]:
            fit = sorted((s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score), key=lambda s: (-s[0], s[1]))
            out += [(a, j, r + 1, s[1], score, s[0]) for r, s in enumerate(fit[:10])]
    return sorted(out)


def mined(df):
    out = negatives.negatives_of_embeddings(df)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


@pytest.mark.parametrize("m,k,n", [(1, 1, 1), (3, 5, 7), (33, 64, 65), (65, 67, 101), (40, 17, 90)])
def test_strassen(m, k, n):
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
    assert (negatives.strassen(a, b) == a @ b).all()
    wide = rng.integers(-(2**40), 2**40, (m, k))
    exact = wide.astype(object) @ wide.T.astype(object)
    assert (negatives.products(wide, wide) == np.clip(exact, int(negatives.LEAST), int(negatives.MOST)).astype(np.int64)).all()


def test_heaps_merge():
    rng = np.random.default_rng(5)
    slot, ids, score = rng.integers(0, 6, 400), rng.permutation(400), rng.integers(-5, 6, 400)
    heaps = negatives.Heaps(6, 7)
    for part in np.array_split(np.arange(400), 9):
        heaps.push(slot[part], ids[part], score[part])
    due = [e for s in range(6) for e in sorted((s, -v, i) for s_, v, i in zip(slot, score, ids) if s_ == s)[:7]]
    assert [(s, -v, i) for s, v, i in zip(heaps.slot, heaps.score, heaps.id)] == due


def random_rows(n, dims=(6, 9), seed=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.integers(-2, 4, dims[int(i % 41 == 0)]) / 8], int(rng.integers(0, 3))) for i in range(n)]


def test_brute_force_over_many_cells(spark, monkeypatch):
    rows = random_rows(900)
    df = spark.createDataFrame(rows, SCHEMA)
    due = by_hand(rows)
    assert len(due) > 100 and mined(df) == due
    for name, value in (("CELL_ANCHORS", 4), ("CELL_ROWS", 150), ("TILE_ANCHORS", 2), ("TILE_ROWS", 37), ("LEAF", 2)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(df) == due


def test_odd_rows(spark):
    rows = random_rows(320, seed=2) + random_rows(40, seed=2)  # repeated rows
    rows += [(100, [0.5] * 6, 1), (100, [0.25] * 6, 2), (200, None, 1), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 6, 1)]
    rows += [(7, [float("nan")] * 6, 1), (14, [float("inf")] * 6, 2), (21, [], 0), (400, [1.0] * 6, None), (401, [3.0e38] * 3, 1), (500, [0.0] * 6, 1)]
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "vector", "asks", "dim", "ga", "score", "rank", "positives"):
        df = df.withColumn(name, F.lit("own"))
    assert mined(df) == by_hand(rows)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []
