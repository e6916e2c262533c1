"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins. Cyclic boosting visits the features in turn and
adds a shallow tree, fitted to the gradient of the log loss over the bins, to the feature's
table; then the strongest pairs of features get two-way tables in the same way. A text's score
is the sum of the table entries of its bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.llm.common import held_out, lists, own_columns, pieces, released, texts_of

#: labelled rows that the model is fitted on at most, taken in the order of a hash of their id
SAMPLE_ROWS = 20_000
#: documents with this score or more are kept
KEEP_FROM = 0.3
BINS, PAIR_BINS, PAIRS = 64, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_HESSIAN = 150, 60, 0.1, 4, 2.0

FEATURES = (
    "log_bytes", "upper", "digits", "blanks", "line_ends", "beyond_ascii", "stops", "commas", "exclamations", "questions",
    "symbols", "brackets", "quotes", "entropy", "log_words", "word_length", "distinct_words", "top_word", "upper_words",
    "marked_words", "distinct_lines", "line_length", "ended_lines", "word_deviation", "packed",
)

_SYMBOLS = b"#$%&*@^~|\\/_=+<>"


def features(text: str) -> np.ndarray:
    """One number per feature of a whole text; zeros for an empty one."""
    out = np.zeros(len(FEATURES))
    raw = text.encode("utf-8")
    if not raw:
        return out
    n = len(raw)
    c = np.zeros(256, dtype=np.int64)
    for start in range(0, n, 1 << 22):
        c += np.bincount(np.frombuffer(raw, np.uint8, min(1 << 22, n - start), start), minlength=256)
    p = c[c > 0] / n
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    out[0] = np.log1p(n)
    out[1] = c[65:91].sum() / max(1, c[65:91].sum() + c[97:123].sum())
    out[2:13] = np.array([
        c[48:58].sum(), c[32], c[10], c[128:].sum(), c[46], c[44], c[33], c[63],
        sum(c[b] for b in _SYMBOLS), sum(c[b] for b in b"()[]{}"), c[34] + c[39],
    ]) / n
    out[13] = -(p * np.log2(p)).sum()
    if words:
        w = len(words)
        size = np.fromiter(map(len, words), np.int64, w)
        counts: dict[str, int] = {}
        for x in words:
            counts[x] = counts.get(x, 0) + 1
        out[14] = np.log1p(w)
        out[15] = size.mean()
        out[16] = len(counts) / w
        out[17] = max(counts.values()) / w
        out[18] = sum(k for x, k in counts.items() if x.isupper() and len(x) > 1) / w
        out[19] = sum(k for x, k in counts.items() if not x[-1].isalnum()) / w
        out[23] = size.std()
    if lines:
        out[20] = len(set(lines)) / len(lines)
        out[21] = np.log1p(n / len(lines))
        out[22] = sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines)
    packer = zlib.compressobj(1)
    out[24] = (len(packer.compress(raw)) + len(packer.flush())) / n
    return out


@dataclass
class Model:
    """Bin edges and tables; ``pairs`` has (feature, feature) with edges and a two-way table."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of a feature matrix: bins, table entries, their sum."""
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            a = np.searchsorted(self.pair_edges[i], x[:, i], side="right")
            total += t[a, np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Bin edges at quantiles; equal ones fall together."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton step per bin from a tree of at most LEAVES leaves over gradient and hessian sums."""
    gs, hs = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    worth = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1.0)
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for a, b in leaves:
            at = np.arange(a + 1, b)
            at = at[(hs[at] - hs[a] >= LEAST_HESSIAN) & (hs[b] - hs[at] >= LEAST_HESSIAN)]
            if len(at):
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), (a, b), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0)
    return step


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of each of two features at once: gain and step over the two-way bins."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gs, hs = pad(g), pad(h)
    n, m = g.shape
    best, step = 0.0, np.zeros_like(g)
    for a in range(1, n):
        for b in range(1, m):
            parts = [(0, a, 0, b), (0, a, b, m), (a, n, 0, b), (a, n, b, m)]
            sums = [tuple(s[r1, c1] - s[r0, c1] - s[r1, c0] + s[r0, c0] for s in (gs, hs)) for r0, r1, c0, c1 in parts]
            gain = sum(x * x / (y + 1.0) for x, y in sums)
            if gain > best:
                best, step = gain, np.zeros_like(g)
                for (r0, r1, c0, c1), (x, y) in zip(parts, sums):
                    step[r0:r1, c0:c1] = x / (y + 1.0)
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fits a model to features and labels 0 or 1; with one label only, a constant near it."""
    rate = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Model(float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [cuts(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.base)

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for j, at in enumerate(bins):
            step = RATE * shallow_tree(*sums(at, len(model.tables[j])))
            model.tables[j] += step
            total += step[at]
    model.pair_edges = [cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    shape = lambda i, j: (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)

    def two_way(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = shape(i, j)
        at = small[i] * s[1] + small[j]
        g, h = sums(at, s[0] * s[1])
        return at, g.reshape(s), h.reshape(s)

    gains = sorted(((quadrants(*two_way(i, j)[1:])[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), key=lambda t: (-t[0], t[1:]))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros(shape(i, j)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            at, g, h = two_way(i, j)
            step = RATE * quadrants(g, h)[1]
            model.pair_tables[k] += step
            total += step.ravel()[at]
    return model


def with_features(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            x = np.array([features(t) for t in texts_of(batch, text_col)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.ravel(), [x.shape[1]] * len(x))], names=[id_col, "features"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, features array<double>")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits the model on labelled documents that are not held out, SAMPLE_ROWS of them at most.

    Labels other than 0 and 1, null ids and labels without a document are passed over. An id labelled twice counts with
    its lower label, and of documents that share an id the one with the least features counts,
    so that reruns agree. Without any usable row the model is a constant of one half.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .join(docs.select(id_col), id_col, "left_semi")
        .groupBy(F.col(id_col).alias("labelled"))
        .agg(F.min(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(SAMPLE_ROWS)
    )
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen.select("labelled")), F.col(id_col) == F.col("labelled"), "left_semi")
    found = with_features(rows, id_col, text_col).groupBy(id_col).agg(F.min("features").alias("x"))
    pairs = found.join(F.broadcast(chosen), F.col(id_col) == F.col("labelled")).orderBy(id_col).select("x", "y").toArrow()
    x = np.array(pairs.column("x").to_pylist(), dtype=float).reshape(len(pairs), len(FEATURES))
    return fit(x, np.array(pairs.column("y").to_pylist(), dtype=float))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` of every row's whole text; no shuffle.

    Null texts are scored as empty ones; repeated rows are scored each; an empty table gives an
    empty result; other columns are neither read nor returned.
    """
    return scored(df, model, text_col, [id_col])


def scored(df: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted``."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            p = model.score(np.array([features(t) for t in texts_of(batch, text_col)]))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p), pa.array((p >= KEEP_FROM).astype(np.int32))], names=[*keep, "score", "predicted"])

    return df.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows that are not held out, then scores every row."""
    return score(docs, learn(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@own_columns
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; the same columns, whatever their names.

    Null texts are judged as empty ones, repeated rows each; an empty table gives an empty result.
    """
    out = scored(docs, learn(docs, labels), "text", docs.columns)
    return out.where(F.col("predicted") == 1).select(*docs.columns)
