"""Quality rules and robust multivariate outliers.

Simple counts of a text give fixed rules and a vector of transformed statistics. Texts that pass
the rules are grouped by language and source; for each group the minimum covariance determinant
estimate finds the centre and covariance of the three quarters of its distinct vectors that lie
closest together, and vectors far from it by Mahalanobis distance are rejected. The estimate is
computed for all groups at once: a concentration step is one pass over the vectors that counts
distances by fine bins, finds each group's bin that completes the share, and adds up the moments of
all vectors up to it. Steps go on until no group's determinant falls.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import pieces, staged
from quantspark.session import fits

SYMBOLS = "#*$%&|<>"
#: fixed rules: fewer words fail, and more words than this share in repeated windows
LEAST_WORDS = 50
MOST_REPEATED = 50  # in a hundred
WINDOW = 3
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: transformed statistics, and the deviation in each that is never evidence by itself
FEATURES = ("log_words", "log_word_chars", "root_symbols", "root_dup_lines", "arc_repeats")
TOLERANCES = (0.3, 0.08, 0.05, 0.08, 0.15)
P = len(FEATURES)
#: share of a group's distinct vectors that the determinant is least for
SHARE = 0.75
#: vectors below this chance under the estimate are rejected; and left out of the last estimate
CHANCE, REWEIGHT = 1e-6, 0.025
#: distinct vectors that an estimate needs; smaller groups are pooled by language, then altogether
LEAST_GROUP = 60
#: bins of the squared distance for each doubling
BINS = 64
#: a step counts where the log determinant falls by this
GAIN = 1e-3
#: pairs of language and source up to which estimates are broadcast; with more they meet their vectors in a join split by salt
BROADCAST_GROUPS = 20_000
SALTS = 64


# --- counts ------------------------------------------------------------------


def repeated_words(doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each word whether it lies in a window of three words that its text holds twice or more."""
    out = np.zeros(len(code), bool)
    if len(code) < WINDOW:
        return out
    size = int(code.max()) + 1
    _, pair = np.unique((doc[:-1] * size + code[:-1]) * size + code[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * size + code[2:], return_inverse=True, return_counts=True)
    again = (times[window] > 1) & (doc[:-2] == doc[2:])
    for i in range(WINDOW):
        out[i : len(out) - WINDOW + 1 + i] |= again
    return out


def split(parts: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All parts end to end, and the row each comes from."""
    return parts.flatten(), np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))


def counts_of(texts: pa.Array) -> list[np.ndarray]:
    """The counts of a batch of texts without nulls, one array for each of ``COUNTS``."""
    n = len(texts)
    words, doc = split(pc.ascii_split_whitespace(texts))
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    words, doc, chars = words.filter(pa.array(chars > 0)), doc[chars > 0], chars[chars > 0]
    lines, at = split(pc.split_pattern(texts, "\n"))
    some = pc.utf8_length(pc.ascii_trim_whitespace(lines)).to_numpy(zero_copy_only=False) > 0
    code, at = lines.filter(pa.array(some)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), at[some]
    size = int(code.max(initial=0)) + 1
    again = repeated_words(doc, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return [
        np.bincount(doc, minlength=n),
        np.bincount(doc, chars, minlength=n).astype(np.int64),
        reduce(np.add, [pc.count_substring(texts, s).to_numpy(zero_copy_only=False).astype(np.int64) for s in SYMBOLS]),
        np.bincount(at, minlength=n) - np.bincount(np.unique(at * size + code) // size, minlength=n),
        np.bincount(doc[again], minlength=n),
    ]


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id, lang, source``, the counts and ``base_failed`` of every row; no other column is read."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [pa.array(c, pa.int64()) for c in counts_of(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], names=["id", "lang", "source", *COUNTS])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    out = rows.mapInArrow(run, names + "".join(f", {c} long" for c in COUNTS))
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def transformed() -> list[Column]:
    """The statistic vector of a row with words: logs of sizes, variance-stabilised shares."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log(words), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / words),
        F.asin(F.sqrt(F.col("n_repeat_words") / words)),
    ]


# --- distribution of squared distances ---------------------------------------


def chi2_below(x: float, k: int) -> float:
    """The chance that a sum of k squared normal values lies below x (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    while term > 1e-17 * total:
        a += 1
        term *= half / a
        total += term
    return min(1.0, total * math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2)))


def chi2_quantile(chance: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, k) < chance else (lo, mid)
    return hi


def consistency(share: float, k: int) -> float:
    """What the covariance of the innermost share of normal vectors is multiplied by."""
    return share / chi2_below(chi2_quantile(share, k), k + 2)


# --- minimum covariance determinant ------------------------------------------

XS = [f"x{i}" for i in range(P)]
MEANS = [f"m{i}" for i in range(P)]
#: rows of the inverse Cholesky factor, so that the squared distance is a sum of squares
WEIGHTS = [f"w{i}_{j}" for i in range(P) for j in range(i + 1)]
PRODUCTS = [f"s{i}_{j}" for i in range(P) for j in range(i + 1)]
ESTIMATE = "grp string, start int, logdet double, " + ", ".join(f"{c} double" for c in MEANS + WEIGHTS)


def with_estimates(points: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Each vector beside its group's estimates: by broadcast where groups are few, else split by salt."""
    if few:
        return points.join(F.broadcast(estimates), "grp")
    salted = estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return points.withColumn("salt", F.pmod(F.xxhash64(*XS), F.lit(SALTS)).cast("int")).join(salted, ["grp", "salt"]).drop("salt")


def squared_distance() -> Column:
    parts = []
    for i in range(P):
        part = reduce(Column.__add__, [F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)])
        parts.append(part * part)
    return reduce(Column.__add__, parts)


def bin_of(d2: Column) -> Column:
    """Whole steps of the logarithm; vectors on the centre itself share the lowest bin."""
    return F.greatest(F.floor(F.log2(F.greatest(d2, F.lit(2.0**-40))) * BINS), F.lit(-40 * BINS)).cast("int")


def up_to_share(keys: list[str], value: str, share: float) -> tuple[Window, Column]:
    """Over counted values: whether the values below complete less than the share of a key's rows."""
    by = Window.partitionBy(*keys)
    below = F.sum("n").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(below, F.lit(0)) < F.lit(share) * F.sum("n").over(by)


def moments(rows: DataFrame) -> DataFrame:
    """Count, sums and products of each (grp, start), about the group's middle so that nothing cancels."""
    xs = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(P)]
    return rows.groupBy("grp", "start", *[f"c{i}" for i in range(P)]).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(xs[i]).alias(f"t{i}") for i in range(P)],
        *[F.sum(xs[i] * xs[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)],
    )


def fitted(share: float):
    """Estimates out of moments; the tolerances keep a covariance regular where a statistic is constant."""
    factor = consistency(share, P)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["n"].to_numpy(float)
            mean = b[[f"t{i}" for i in range(P)]].to_numpy(float) / n[:, None]
            cov = np.zeros((len(b), P, P))
            for i in range(P):
                for j in range(i + 1):
                    cov[:, i, j] = cov[:, j, i] = b[f"s{i}_{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
            cov = cov * factor + np.diag(np.square(TOLERANCES))
            lower = np.linalg.cholesky(cov)
            inverse = np.linalg.inv(lower)
            out = {"grp": b["grp"], "start": b["start"], "logdet": 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(axis=1)}
            out |= {f"m{i}": mean[:, i] + b[f"c{i}"].to_numpy(float) for i in range(P)}
            out |= {f"w{i}_{j}": inverse[:, i, j] for i in range(P) for j in range(i + 1)}
            yield pd.DataFrame(out)

    return run


def concentrated(points: DataFrame, estimates: DataFrame, share: float, few: bool) -> DataFrame:
    """One concentration step: estimates from the share of each group's vectors nearest to the given ones."""
    rows = with_estimates(points, estimates, few).withColumn("bin", bin_of(squared_distance()))
    counted = rows.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n"))
    last = counted.withColumn("in", up_to_share(["grp", "start"], "bin", share)).where("in").groupBy("grp", "start").agg(F.max("bin").alias("last"))
    ranged = estimates.join(last, ["grp", "start"])
    near = with_estimates(points, ranged, few).where(bin_of(squared_distance()) <= F.col("last"))
    return moments(near).mapInPandas(fitted(share), ESTIMATE)


def medians(points: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """``grp`` and the median of each value, counted by thousandths of its tolerance."""
    steps = [F.round(v * (1000 / t)).cast("long") for v, t in zip(values, TOLERANCES)]
    long = points.select("grp", F.posexplode(F.array(*steps)).alias("at", "step"))
    counted = long.groupBy("grp", "at", "step").agg(F.count(F.lit(1)).alias("n"))
    middle = counted.withColumn("in", up_to_share(["grp", "at"], "step", 0.5)).where("in").groupBy("grp", "at").agg(F.max("step").alias("step"))
    return middle.groupBy("grp").agg(*[(F.max(F.when(F.col("at") == i, F.col("step"))) * (t / 1000)).alias(c) for i, (c, t) in enumerate(zip(names, TOLERANCES))])


def first_estimates(points: DataFrame, centres: DataFrame, few: bool) -> DataFrame:
    """Two starts for each group: median deviations of the statistics, and their spatial signs.

    The first takes the statistics one by one. The second gives each vector, seen from the middle
    and in units of the deviations, the length one, so that far vectors weigh no more than near ones.
    """
    spread = medians(points, [F.abs(F.col(f"x{i}") - F.col(f"c{i}")) for i in range(P)], [f"d{i}" for i in range(P)])
    scales = staged(centres.join(spread, "grp").select("grp", *[F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + t * t).alias(f"d{i}") for i, t in enumerate(TOLERANCES)]))
    zs = [(F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}") for i in range(P)]
    length = F.sqrt(F.greatest(reduce(Column.__add__, [z * z for z in zs]), F.lit(1e-12)))
    signs = with_estimates(points, scales, few).select("grp", *[f"d{i}" for i in range(P)], *[f"c{i}" for i in range(P)], *[(z / length).alias(f"z{i}") for i, z in enumerate(zs)])
    summed = signs.groupBy("grp", *[f"c{i}" for i in range(P)], *[f"d{i}" for i in range(P)]).agg(
        *[(F.avg(F.col(f"z{i}") * F.col(f"z{j}")) * P).alias(f"s{i}_{j}") for i in range(P) for j in range(i + 1)]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scale = b[[f"d{i}" for i in range(P)]].to_numpy(float)
            for start in (0, 1):
                cov = np.tile(np.eye(P), (len(b), 1, 1))
                if start:
                    for i in range(P):
                        for j in range(i + 1):
                            cov[:, i, j] = cov[:, j, i] = b[f"s{i}_{j}"].to_numpy(float)
                cov = cov * scale[:, :, None] * scale[:, None, :] + np.diag(np.square(TOLERANCES))
                inverse = np.linalg.inv(np.linalg.cholesky(cov))
                out = {"grp": b["grp"], "start": np.full(len(b), start, np.int32), "logdet": np.full(len(b), np.inf)}
                out |= {f"m{i}": b[f"c{i}"] for i in range(P)}
                out |= {f"w{i}_{j}": inverse[:, i, j] for i in range(P) for j in range(i + 1)}
                yield pd.DataFrame(out)

    return summed.mapInPandas(run, ESTIMATE)


def least_determinants(points: DataFrame, few: bool) -> DataFrame:
    """The reweighted estimate of each group of ``points`` (``grp`` and the statistics, distinct).

    A group keeps the better of two estimates after each step, so determinants only fall, and the
    rounds end because every round that counts lowers one by ``GAIN`` and tolerances bound them
    from below. Nothing but two numbers a round reaches the driver.
    """
    centres = staged(medians(points, [F.col(x) for x in XS], [f"c{i}" for i in range(P)]))
    points = staged(with_estimates(points, centres, few))
    best = staged(first_estimates(points, centres, few))
    while True:
        now = concentrated(points, best, SHARE, few)
        fall = F.col("old.logdet") - F.col("new.logdet")
        both = best.alias("old").join(now.alias("new"), ["grp", "start"])
        better = staged(both.select("grp", "start", (fall > GAIN).alias("fell"), *[F.when(fall > 0, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in ["logdet", *MEANS, *WEIGHTS]]))
        best = better.drop("fell")
        if better.where("fell").isEmpty():
            break
    chosen = staged(best.groupBy("grp").agg(F.min(F.struct("logdet", "start", *MEANS, *WEIGHTS)).alias("e")).select("grp", "e.*"))
    inner = with_estimates(points, chosen, few).where(squared_distance() <= chi2_quantile(1 - REWEIGHT, P))
    return staged(moments(inner).mapInPandas(fitted(1 - REWEIGHT), ESTIMATE))


def pooled(distinct: DataFrame) -> DataFrame:
    """``lang, source, grp``: the group whose estimate judges each language and source.

    Its own where it has ``LEAST_GROUP`` distinct vectors, else all small ones of its language
    together, else all that are left, else none (null).
    """
    sizes = distinct.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= LEAST_GROUP
    sizes = sizes.withColumn("small", F.when(own, 0).otherwise(F.col("n")))
    sizes = sizes.withColumn("n_lang", F.sum("small").over(Window.partitionBy("lang")))
    by_lang = F.col("n_lang") >= LEAST_GROUP
    left = F.when(own | by_lang, 0).otherwise(F.col("n"))
    rest = sizes.agg(F.coalesce(F.sum(left), F.lit(0)).alias("n_rest"))
    name = (
        F.when(own, F.to_json(F.struct("lang", "source")))
        .when(by_lang, F.to_json(F.struct(F.lit("all").alias("sources"), "lang")))
        .when(F.col("n_rest") >= LEAST_GROUP, F.lit("all"))
    )
    return sizes.crossJoin(F.broadcast(rest)).select("lang", "source", name.alias("grp"))  # one row


def grouped(rows: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the name of the group that judges them."""
    groups = F.broadcast(groups) if few else groups
    named = groups.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "grp")
    return rows.join(named, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left").drop("lang_", "source_")


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id``, the counts, ``base_failed``, ``kept`` and ``distance`` of every row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A row fails the fixed rules with fewer than 50 words or
    more than half of them in repeated windows; null and empty texts have none and fail. A row that
    passes is kept where its squared Mahalanobis distance (``distance``, null where none is taken)
    has a chance of at least ``CHANCE`` under the estimate of its language and source, pooled
    where these have few distinct vectors; with too few altogether, it is kept. Null languages and
    sources are values of their own. Equal vectors of a group count once in the estimate, so
    copies do not shape it. Repeated rows give repeated rows; an empty table gives an empty
    result; of ``df`` only the four named columns are read.
    """
    counts = staged(statistics(df, id_col, text_col, lang_col, source_col))
    rows = counts.select("*", *[F.when(~F.col("base_failed"), x).alias(f"x{i}") for i, x in enumerate(transformed())])
    distinct = staged(rows.where(~F.col("base_failed")).select("lang", "source", *XS).distinct())
    groups = staged(pooled(distinct))
    few = fits(groups, BROADCAST_GROUPS)
    points = staged(grouped(distinct, groups, few).where(F.col("grp").isNotNull()).select("grp", *XS).distinct())
    estimates = least_determinants(points, few).drop("start", "logdet")
    both = judged(grouped(rows, groups, few), estimates.withColumnRenamed("grp", "grp_"), few)
    both = both.withColumn("distance", F.when(~F.col("base_failed"), squared_distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - CHANCE, P), F.lit(True))
    return both.select(F.col("id").alias(id_col), *COUNTS, "base_failed", kept.alias("kept"), "distance")


def judged(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Every row beside the estimate of its group, null where it has none."""
    if few:
        return rows.join(F.broadcast(estimates), F.col("grp") == F.col("grp_"), "left")
    salted = estimates.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = rows.withColumn("salt", F.pmod(F.xxhash64("id", *XS), F.lit(SALTS)).cast("int"))
    return own.join(salted, (F.col("grp") == F.col("grp_")) & (F.col("salt") == F.col("salt_")), "left")
