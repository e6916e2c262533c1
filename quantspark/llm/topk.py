"""Exact top-k inner-product search by block-at-a-time pruning.

Each component is a term with a positive and a negative side. Candidates stand in blocks of a
document range; a block keeps every term's greatest and least value and, as its forward index,
the components of its documents. For a query, the sum over its terms of weight times the block's
maximum (minimum for negative weights) bounds all scores in the block. Blocks are visited in the
order of that bound until it falls below the k-th score found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.vectors import LEAST, best_of, cells, integer_products, only_ids, prepared, ranked, whole

#: documents of one block
BLOCK_ROWS = 128
SCALE = 1024


def near_order(x: np.ndarray) -> np.ndarray:
    """An order of documents in which blocks are tight: halves at the median of the widest term, again and again."""
    todo, out = [np.arange(len(x))], []
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK_ROWS:
            out.append(part)
            continue
        values = x[part, int(np.argmax(x[part].std(axis=0)))]
        half = -(-(len(part) // 2) // BLOCK_ROWS) * BLOCK_ROWS
        order = np.argsort(values, kind="stable")
        todo += [part[order[half:]], part[order[:half]]]
    return np.concatenate(out)


class Blocks:
    """Document-range blocks of one group with term maxima, minima and forward indexes."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray]):
        self.order = near_order(x)
        self.x = x[self.order]
        self.first_id, self.alone = (a[self.order] for a in only_ids(ids))
        self.starts = np.arange(0, len(x), BLOCK_ROWS)
        self.most = np.maximum.reduceat(self.x, self.starts).astype(float)
        self.least = np.minimum.reduceat(self.x, self.starts).astype(float)
        self.visited = 0

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No score in a block is greater; what floats may round off is added."""
        q = q.astype(float)
        slack = np.abs(q) @ np.maximum(np.abs(self.most), np.abs(self.least)).T * 1e-12
        return np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T + slack

    def search(self, q: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the visited candidates that can be among the k best: places and scores.

        Vectors that stand for the query's own id alone are no candidates.
        """
        bounds = self.bounds(q)
        order = np.argsort(-bounds, axis=1, kind="stable")
        kth = np.full(len(q), LEAST)
        best = np.full((len(q), k), LEAST)
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in q]
        active = np.arange(len(q))
        for turn in range(len(self.starts)):
            block = order[active, turn]
            going = bounds[active, block] >= kth[active]  # equal bounds may hide ties
            active, block = active[going], block[going]
            if not len(active):
                break
            self.visited += len(active)
            by_block = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[by_block])) + 1
            for asked in np.split(by_block, cut):
                start = self.starts[block[asked[0]]]
                who, near = active[asked], slice(start, start + BLOCK_ROWS)
                scores = integer_products(q[who], self.x[near].T)
                own = (self.first_id[near] == names[who][:, None]) & self.alone[near]
                both = np.concatenate([best[who], np.where(own, LEAST, scores)], axis=1)
                best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                kth[who] = best[who].min(axis=1)
                for i, row, mine in zip(who, scores, own):
                    good = np.flatnonzero((row >= kth[i]) & ~mine)
                    if len(good):
                        seen[i].append((self.order[start + good], row[good]))
        for i, parts in enumerate(seen):
            if parts:
                yield i, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def exact_top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest integer inner products of each query.

    Components become floor(1024 x). Queries: rows whose id is divisible by ``every``; candidates:
    every row but those of the query's own id. Fewer than k candidates: all. Ties go to the
    smaller id. Rows with a null id, and vectors that are null, empty or hold null or non-finite
    components, take no part; vectors of different lengths do not score. A component or score beyond
    64 bits counts as the nearest 64-bit number; all others are exact. Vectors that many rows
    share are scored once. Repeated rows count once; an empty table gives an empty result; other
    columns are not read.
    """
    vector = F.col(vector_col)
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = df.where(F.col(id_col).isNotNull() & whole(vector)).select(F.col(id_col).cast("long").alias("id"), scaled.alias("vector")).distinct()
    vectors, queries = prepared(rows, k, every)

    def search(names: np.ndarray, q: np.ndarray, v: np.ndarray, ids: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, at, scores in Blocks(v, ids).search(q, names, k):
            yield i, *best_of(ids, at, scores, names[i], k)

    return ranked(cells(vectors, queries, search, "long"), k)


SQL = """
WITH valid AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (
  SELECT id, min(v) AS v FROM valid WHERE id % 100 = 0 GROUP BY id
), scored AS (
  SELECT DISTINCT q.id AS query_id, c.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM asked q JOIN valid c ON q.id <> c.id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
