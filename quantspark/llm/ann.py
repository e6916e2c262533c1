"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector to the whole parts of a few random projections over a width. Around a
query, buckets are visited in the order of estimated success: a step across the nearer boundary
of a projection costs the square of the query's distance from it, and the sets of steps with the
least sums come first. The candidates of all tables are merged, then ranked by their exact inner
product. For inner products a vector gets one more coordinate that makes all of a band equally
long; bands hold vectors of similar length, each with its own tables, and are visited from the
longest on until no vector of a band can reach the k-th score found. A query that meets too few
candidates is scored against the whole cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.vectors import best_of, cells, only_ids, prepared, ranked, whole

TABLES = 5
PROJECTIONS = 8
#: bucket width in standard deviations of a unit vector's projection
WIDTH = 2.5
#: buckets visited in each table for a query, of 2 ** PROJECTIONS sets of steps
PROBES = 160
#: bands of lengths for each doubling
BANDS = 2
SEED = 20


class Table:
    """One hash table over a group of unit vectors."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator):
        self.a = rng.standard_normal((x.shape[1], PROJECTIONS))
        self.b = rng.uniform(0, WIDTH, PROJECTIONS)
        self.weights = rng.integers(1, 1 << 62, PROJECTIONS) | 1
        key = self.keys(np.floor(self.place(x)).astype(np.int64))
        self.order = np.argsort(key, kind="stable")
        self.sorted = key[self.order]
        self.steps = (np.arange(2**PROJECTIONS)[:, None] >> np.arange(PROJECTIONS)) & 1

    def place(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.a + self.b) / WIDTH

    def keys(self, buckets: np.ndarray) -> np.ndarray:
        """One number per bucket; collisions only add candidates."""
        return (buckets * self.weights).sum(axis=-1)

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end in ``order`` of the buckets visited for each query, in success order."""
        at = self.place(q)
        bucket = np.floor(at).astype(np.int64)
        inside = at - bucket
        side = np.where(inside < 0.5, -1, 1)
        cost = np.minimum(inside, 1 - inside) ** 2 @ self.steps.T.astype(float)
        chosen = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        keys = self.keys(bucket[:, None, :] + self.steps[chosen] * side[:, None, :])
        return np.searchsorted(self.sorted, keys, "left"), np.searchsorted(self.sorted, keys, "right")


class Index:
    """The tables of all bands over one group of vectors."""

    def __init__(self, x: np.ndarray, ids: list[np.ndarray], seed: int = SEED):
        self.x = x
        self.first_id, self.alone = only_ids(ids)
        norm = np.linalg.norm(x, axis=1)
        band = np.floor(BANDS * np.log2(norm / norm.max()) + 1e-9).astype(np.int64)
        self.bands = []
        for number in np.unique(band)[::-1]:
            at = np.flatnonzero(band == number)
            most = norm[at].max()
            rest = np.sqrt(np.maximum(0, 1 - (norm[at] / most) ** 2))
            rng = np.random.default_rng(seed)
            level = np.concatenate([x[at] / most, rest[:, None]], axis=1)
            self.bands.append((at, most, [Table(level, rng) for _ in range(TABLES)]))

    def search(self, q: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the candidates of the visited buckets: places and scores, its own vectors left out."""
        norm = np.linalg.norm(q, axis=1)
        level = np.concatenate([q / norm[:, None], np.zeros((len(q), 1))], axis=1)
        for begin in range(0, len(q), 256):
            part = range(begin, min(begin + 256, len(q)))
            at: dict[int, list] = {i: [] for i in part}
            scores: dict[int, list] = {i: [] for i in part}
            kth = np.full(len(q), -np.inf)
            for members, most, tables in self.bands:
                # a vector as long as the bound allows; what floats may round off is added
                going = [i for i in part if kth[i] <= norm[i] * most * (1 + 1e-9)]
                if not going:
                    break
                spans = [t.probes(level[going]) for t in tables]
                for place, i in enumerate(going):
                    hit = np.zeros(len(members), bool)
                    for table, (lo, hi) in zip(tables, spans):
                        size = hi[place] - lo[place]
                        filled = size > 0
                        ends = np.cumsum(size[filled])
                        if len(ends):
                            jump = np.repeat(lo[place][filled] - (ends - size[filled]), size[filled])
                            hit[table.order[np.arange(ends[-1]) + jump]] = True
                    near = self.others(members[hit], names[i])
                    at[i].append(near)
                    scores[i].append(self.x[near] @ q[i])
                    found = np.concatenate(scores[i])
                    if len(found) >= k:
                        kth[i] = np.partition(found, len(found) - k)[len(found) - k]
            for i in part:
                if sum(map(len, at[i])) < k:
                    near = self.others(np.arange(len(self.x)), names[i])
                    yield i, near, self.x[near] @ q[i]
                else:
                    yield i, np.concatenate(at[i]), np.concatenate(scores[i])

    def others(self, at: np.ndarray, own: int) -> np.ndarray:
        """The places of vectors that stand for another id than ``own``."""
        return at[(self.first_id[at] != own) | ~self.alone[at]]


def nearest(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found by inner product.

    Queries: rows whose id is divisible by ``every``; candidates: every row but those of the
    query's own id; fewer than k candidates: all. A query for which the visited buckets of a cell
    hold fewer than k is scored against all of the cell. Scores come from the original vectors in
    double precision; ties go to the smaller id. Rows with a null id, and
    vectors that are null, empty, zero or hold null or non-finite components, take no part.
    Vectors that many rows share are hashed once. Repeated rows count once; an empty table gives
    an empty result; other columns are not read. Every row is indexed; buckets have no cap.
    """
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    nonzero = F.exists(F.col(vector_col), lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull() & whole(F.col(vector_col)) & nonzero).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).distinct()
    vectors, queries = prepared(rows, k, every)

    def search(names: np.ndarray, q: np.ndarray, v: np.ndarray, ids: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, at, scores in Index(v, ids).search(q, names, k):
            yield i, *best_of(ids, at, scores, names[i], k)

    return ranked(cells(vectors, queries, search, "double"), k)
