"""Hard negatives by exact integer products of anchor and candidate tiles.

Scores of a tile are one int64 matrix product, by Strassen's recursion with zero rows and columns
where a side is odd. Additions and products of 64-bit integers are exact modulo 2**64, so the
result is exact whenever a score fits 64 bits. A first pass keeps each anchor's best rows of its
own label; their scores open the windows of a second pass, which keeps each window's best rows of
other labels. Both keep heaps of bounded size that merge: over the tiles of a cell inside a task,
over cells in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import staged
from quantspark.llm.vectors import whole

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: a negative's score lies between these hundredths of its positive's
LOW, HIGH = 30, 90
#: anchors and candidates of one cell, on average, and of one tile
CELL_ANCHORS, CELL_ROWS = 4_096, 8_192
TILE_ANCHORS, TILE_ROWS = 256, 1_024
#: sides up to this length are multiplied directly
LEAF = 16
LEAST = np.iinfo(np.int64).min + 1
MOST = np.iinfo(np.int64).max


def even(x: np.ndarray) -> np.ndarray:
    """``x`` with a row or column of zeros where a side is odd."""
    return np.pad(x, ((0, x.shape[0] & 1), (0, x.shape[1] & 1))) if (x.shape[0] | x.shape[1]) & 1 else x


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two integer matrices with seven products of their quarters."""
    if min(*a.shape, b.shape[1]) <= LEAF:
        return a @ b
    rows, columns = len(a), b.shape[1]
    a, b = even(a), even(b)
    i, k, j = len(a) // 2, len(b) // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    m1 = strassen(a11 + a22, b11 + b22)
    m2 = strassen(a21 + a22, b11)
    m3 = strassen(a11, b12 - b22)
    m4 = strassen(a22, b21 - b11)
    m5 = strassen(a11 + a12, b22)
    m6 = strassen(a21 - a11, b11 + b12)
    m7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * j), m1.dtype)
    out[:i, :j] = m1 + m4 - m5 + m7
    out[:i, j:] = m3 + m5
    out[i:, :j] = m2 + m4
    out[i:, j:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


def products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows; beyond 64 bits they come from Python's integers and end at the limit."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(v).max(initial=0))
    if bound < 2.0**62:
        return strassen(a, v.T)
    exact = a.astype(object) @ v.T.astype(object)
    return np.clip(exact, int(LEAST), int(MOST)).astype(np.int64)


class Heaps:
    """For each slot the k best entries: greater scores first, ties to smaller ids. Any two merge."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.slot = self.id = self.score = np.zeros(0, np.int64)
        #: the least score that can still enter a slot
        self.floor = np.full(slots, LEAST)

    def push(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        slot, ids, score = np.concatenate([self.slot, slot]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])[: len(slot)])
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = place < self.k
        self.slot, self.id, self.score = slot[keep], ids[order][keep], score[order][keep]
        full = place[keep] == self.k - 1
        self.floor[self.slot[full]] = self.score[full]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """One row per vector of a cell, all of one length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(len(column), -1))


def bounds(positive: int) -> tuple[int, int]:
    """The least and greatest score s with LOW * positive <= 100 * s <= HIGH * positive."""
    return max(-(-LOW * positive // 100), int(LEAST)), min(HIGH * positive // 100, int(MOST))


def best_in_cell(anchors: pa.Table, rows: pa.Table, opposed: bool) -> pa.Table:
    """Each slot's best rows of one cell: a slot is an anchor, or with ``opposed`` one of its windows."""
    kind = [("anchor_id", pa.int64()), *([("positive_id", pa.int64())] if opposed else []), ("id", pa.int64()), ("score", pa.int64())]
    if not len(anchors) or not len(rows):
        return pa.schema(kind).empty_table()
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    ids, labels, vectors = rows["id"].to_numpy()[order], rows["label"].to_numpy()[order], matrix(rows["vector"])[order]
    own, own_label, asked = anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vector"])
    if opposed:
        windows = anchors["positives"].to_pylist()  # at most POSITIVES an anchor
        owner = np.repeat(np.arange(len(own)), [len(w) for w in windows])
        names = np.array([w["id"] for ws in windows for w in ws], np.int64)
        least, most = np.array([bounds(w["score"]) for ws in windows for w in ws], np.int64).reshape(-1, 2).T
        heaps = Heaps(len(owner), NEGATIVES)
    else:
        owner = np.arange(len(own))
        heaps = Heaps(len(own), POSITIVES)
    for a in range(0, len(own), TILE_ANCHORS):
        lo, hi = np.searchsorted(owner, [a, a + TILE_ANCHORS])
        slots = np.arange(lo, hi)
        for r in range(0, len(ids), TILE_ROWS):
            at, near = slice(a, a + TILE_ANCHORS), slice(r, r + TILE_ROWS)
            scores = products(asked[at], vectors[near])
            same = own_label[at][:, None] == labels[near]
            usable = (same != opposed) & (own[at][:, None] != ids[near])
            by_slot = scores[owner[slots] - a]
            good = usable[owner[slots] - a] & (by_slot >= heaps.floor[slots][:, None])
            if opposed:
                good &= (by_slot >= least[slots][:, None]) & (by_slot <= most[slots][:, None])
            i, j = np.nonzero(good)
            if len(i):
                heaps.push(slots[i], ids[near][j], by_slot[i, j])
    columns = [own[owner[heaps.slot]], *([names[heaps.slot]] if opposed else []), heaps.id, heaps.score]
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=pa.schema(kind))


def dealt(anchors: DataFrame, rows: DataFrame, deal: list[str], groups: tuple[int, int], opposed: bool) -> DataFrame:
    """The heaps of all cells: rows go to one cell of each anchor group, by their id."""
    ga, gv = groups
    left = anchors.withColumn("ga", F.pmod(F.xxhash64("id"), F.lit(ga)).cast("int")).withColumn("gv", F.explode(F.sequence(F.lit(0), F.lit(gv - 1))))
    right = rows.withColumn("gv", F.pmod(F.xxhash64("id", "vector"), F.lit(gv)).cast("int")).withColumn("ga", F.explode(F.sequence(F.lit(0), F.lit(ga - 1))))
    keys = [*deal, "ga", "gv"]

    def run(a: pa.Table, v: pa.Table) -> pa.Table:
        return best_in_cell(a, v, opposed)

    schema = "anchor_id long, " + ("positive_id long, " if opposed else "") + "id long, score long"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def leading(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The heaps of all cells merged; Spark keeps k entries a slot in every task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows where ``anchor`` holds. Components become floor(256 x); a score is their
    integer inner product. An anchor's positives are its 5 best other rows of the same label; each
    positive's negatives are the 10 best rows of another label whose score lies between 30 and 90
    hundredths of the positive's. Fewer candidates: all; no positive or no negative: no row; a
    negative positive score opens no window. Rows with a null id or label, and vectors that are
    null, empty or hold null or non-finite components, take no part. Repeated rows count once; a
    row with the anchor's id is neither its positive nor its negative; an anchor id with several
    vectors or labels stands for its least one. Vectors of different lengths do not score. A scaled
    component or a score beyond 64 bits counts as the nearest 64-bit number. Other columns are not
    read; an empty table gives an empty result.
    """
    vector = F.col(vector_col)
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    valid = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & whole(vector))
    valid = valid.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled.alias("vector"), anchor.alias("asks"))
    valid = staged(valid.distinct().withColumn("dim", F.size("vector")))
    anchors = staged(
        valid.where("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own")).select("id", "own.label", "own.vector", F.size("own.vector").alias("dim"))
    )
    valid = valid.drop("asks")
    groups = max(1, round(anchors.count() / CELL_ANCHORS)), max(1, round(valid.count() / CELL_ROWS))
    near = leading(dealt(anchors, valid, ["dim", "label"], groups, opposed=False), ["anchor_id"], POSITIVES)
    positives = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
    opened = staged(anchors.join(positives.withColumnRenamed("anchor_id", "id"), "id"))
    found = leading(dealt(opened, valid, ["dim"], groups, opposed=True), ["anchor_id", "positive_id"], NEGATIVES)
    scores = opened.select(F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return found.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def relabelled(df: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """``df`` with the label of every seventh id moved on by one, modulo ten."""
    label = F.col(label_col).cast("long")
    return df.withColumn(label_col, F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label))


def negatives_of_embeddings(df: DataFrame, every: int = 100) -> DataFrame:
    return hard_negatives(relabelled(df), F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))


SQL = """
WITH valid AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scaled AS (
  SELECT id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM valid
), scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM scaled a JOIN scaled b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 10
"""
