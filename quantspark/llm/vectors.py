"""What both vector searches share: valid rows, one row per distinct vector, cells, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import staged

#: distinct vectors and queries of one cell, on average
GROUP_VECTORS = 8_192
GROUP_QUERIES = 4_096


def whole(vector: Column) -> Column:
    """No null and no non-finite component, and at least one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """``vector, ids``: each distinct vector once, with its ``keep`` smallest ids in order.

    A search for ``keep`` - 1 neighbours never needs more ids of one vector, since all score the
    same and ties go to the smaller id. Ids are cut to ``keep`` in every task before the shuffle.
    """
    least = F.row_number().over(Window.partitionBy("vector", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("k", least).where(F.col("k") <= keep).withColumn("k", first).where(F.col("k") <= keep)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def cells(
    vectors: DataFrame,
    queries: DataFrame,
    search: Callable[[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], Iterator[tuple[int, np.ndarray, np.ndarray]]],
    score_type: str,
) -> DataFrame:
    """``query_id, vec_id, score`` of each query's best in every group of vectors.

    Vectors and queries are dealt to groups by hash; a cell holds one group of each, so tasks
    stay bounded and queries meet all vectors in blocks. ``search`` gets query ids, query matrix,
    vector matrix and the vectors' ids, and gives query place, vector ids and scores.
    """
    nv, nq = vectors.count(), queries.count()
    gv, gq = max(1, round(nv / GROUP_VECTORS)), max(1, round(nq / GROUP_QUERIES))
    own_v = vectors.withColumn("gv", F.pmod(F.xxhash64("vector"), F.lit(gv)).cast("int")).withColumn("gq", F.explode(F.sequence(F.lit(0), F.lit(gq - 1))))
    own_q = queries.withColumn("gq", F.pmod(F.xxhash64("id"), F.lit(gq)).cast("int")).withColumn("gv", F.explode(F.sequence(F.lit(0), F.lit(gv - 1))))
    kind = np.int64 if score_type == "long" else np.float64

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(q) and len(v):
            # vectors of another length score against none of the queries
            for size in sorted(set(map(len, v["vector"]))):
                vs, qs = v[v["vector"].map(len) == size], q[q["vector"].map(len) == size]
                if len(qs):
                    names = qs["id"].to_numpy()
                    args = (np.stack(qs["vector"]), np.stack(vs["vector"]), [np.asarray(x) for x in vs["ids"]])
                    found += [(names[i], ids, s) for i, ids, s in search(names, *args)]
        if not found:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, kind)})
        return pd.DataFrame({
            "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]),
            "vec_id": np.concatenate([f[1] for f in found]),
            "score": np.concatenate([f[2] for f in found]).astype(kind),
        })

    return own_q.groupBy("gq", "gv").cogroup(own_v.groupBy("gq", "gv")).applyInPandas(run, f"query_id long, vec_id long, score {score_type}")


def only_ids(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the id it stands for and whether it stands for that one alone."""
    return np.array([x[0] for x in ids], np.int64), np.array([len(x) == 1 for x in ids], bool)


def best_of(ids: list[np.ndarray], at: np.ndarray, scores: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) among vectors ``at``, each standing for all its ids but ``own``; ties to smaller ids.

    None of ``at`` may stand for ``own`` alone, so that each gives an id.
    """
    if len(at) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at, scores = at[scores >= least], scores[scores >= least]
    names = np.concatenate([ids[i] for i in at]) if len(at) else np.zeros(0, np.int64)
    values = np.repeat(scores, [len(ids[i]) for i in at])
    keep = names != own
    names, values = names[keep], values[keep]
    order = np.lexsort((names, -values))[:k]
    return names[order], values[order]


LEAST = np.iinfo(np.int64).min + 1
MOST = np.iinfo(np.int64).max


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of 64-bit integers, exact: by floats while they hold every sum, beyond 64 bits the limit."""
    bound = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if bound < 2.0**53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    if bound < 2.0**62:
        return a @ b
    return np.clip(a.astype(object) @ b.astype(object), int(LEAST), int(MOST)).astype(np.int64)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all groups."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def prepared(rows: DataFrame, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Staged distinct vectors, and the queries: rows whose id is divisible by ``every``.

    A repeated id is one row per distinct vector as a candidate; as a query, it is asked once,
    with its least vector.
    """
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    return staged(distinct_vectors(rows, k + 1)), staged(queries)
