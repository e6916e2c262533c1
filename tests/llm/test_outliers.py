"""Counts against plain Python, estimates against an independent search in numpy."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import outliers

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + j for at in places.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def check_counts(df):
    rows = outliers.quality_rules(df).collect()
    mine = sorted((str(r.doc_id), *(r[c] for c in outliers.COUNTS), r.base_failed) for r in rows)
    theirs = []
    for r in df.select("doc_id", "text").collect():
        c = counts_by_hand(r.text)
        theirs.append((str(r.doc_id), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert mine == sorted(theirs)
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_counts_of_odd_rows(spark):
    draw = random.Random(1)
    rows = [(None, "no id", "en", "a"), (1, None, None, None), (2, "", "en", ""), (3, "a a a a a", "en", "a"), (4, "x\n\nx\n \n \nx y", None, "b"), (5, "w " * 400_000, "en", "a")]
    rows += [(5, "same row twice", "de", "a")] * 2 + [(6, "\x85\xa0  wide\x0b\x0c\r\n\x1f", "en", "a")]
    rows += [(10 + i, "".join(draw.choice("ab é\n\t#<$日 ") for _ in range(200)), draw.choice(["en", None]), draw.choice(["a", "", None])) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "n_words", "grp", "x0", "m0", "kept", "distance", "salt"):
        df = df.withColumn(name, F.lit("own"))
    check_counts(df)


def test_empty_table(spark):
    assert outliers.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chi2():
    # one and two degrees have closed forms
    for x in (0.1, 1.0, 4.0, 20.0):
        assert outliers.chi2_below(x, 1) == pytest.approx(math.erf(math.sqrt(x / 2)))
        assert outliers.chi2_below(x, 2) == pytest.approx(1 - math.exp(-x / 2))
    assert outliers.chi2_quantile(1 - math.exp(-3), 2) == pytest.approx(6)


def best_subset(x, share, rng, starts=60):
    """The least determinant over concentration steps from random small subsets, with exact subsets."""
    h = math.ceil(share * len(x))
    factor, extra = outliers.consistency(share, x.shape[1]), np.diag(np.square(outliers.TOLERANCES))
    best = (np.inf, None, None)
    for _ in range(starts):
        inner, last = rng.choice(len(x), x.shape[1] + 3, replace=False), np.inf
        while True:
            mean, cov = x[inner].mean(axis=0), np.cov(x[inner].T, bias=True) * factor + extra
            det = np.linalg.slogdet(cov)[1]
            if det > last - 1e-9:
                break
            last = det if len(inner) == h else np.inf
            if len(inner) == h and det < best[0]:
                best = (det, mean, cov)
            inner = np.argsort(np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean), kind="stable")[:h]
    return best


def test_estimates_against_random_starts(spark):
    """Three groups with a fifth of far vectors; one has a constant statistic."""
    rng = np.random.default_rng(4)
    rows, due = [], {}
    for g in range(3):
        mix = rng.normal(0, 0.5, (outliers.P, outliers.P))
        x = rng.normal(0, 1, (400, outliers.P)) @ mix + rng.normal(0, 3, outliers.P)
        if g == 2:
            x[:, 3] = 0.25
        x[:80] += rng.normal(0, 1, (80, outliers.P)) + 6
        rows += [(f"g{g}", *map(float, r)) for r in x]
        due[f"g{g}"] = x
    points = spark.createDataFrame(rows, "grp string, " + ", ".join(f"{c} double" for c in outliers.XS))
    for few in (True, False):
        found = {r.grp: r for r in outliers.least_determinants(points, few).collect()}
        for g, x in due.items():
            _, mean, cov = best_subset(x, outliers.SHARE, rng)
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            inner = x[d2 <= outliers.chi2_quantile(1 - outliers.REWEIGHT, outliers.P)]
            factor = outliers.consistency(1 - outliers.REWEIGHT, outliers.P)
            cov = np.cov(inner.T, bias=True) * factor + np.diag(np.square(outliers.TOLERANCES))
            far = np.einsum("ij,jk,ik->i", x - inner.mean(axis=0), np.linalg.inv(cov), x - inner.mean(axis=0))
            w = np.zeros((outliers.P, outliers.P))
            for i in range(outliers.P):
                for j in range(i + 1):
                    w[i, j] = found[g][f"w{i}_{j}"]
            mine = (((x - np.array([found[g][m] for m in outliers.MEANS])) @ w.T) ** 2).sum(axis=1)
            cut = outliers.chi2_quantile(1 - outliers.CHANCE, outliers.P)
            assert np.allclose(mine[80:], far[80:], rtol=0.15, atol=0.1)
            clear = np.abs(far - cut) > 0.1 * cut
            assert ((mine > cut) == (far > cut))[clear].all() and (mine[:80] > cut).all() and (mine[80:] <= cut).all()


def test_documents(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    rows = check_counts(docs)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    assert all(r.kept or r.base_failed for r in rows if quality.get(r.doc_id) == 1)
    assert not any(r.kept for r in rows if quality.get(r.doc_id) == 0)


def test_copies_do_not_shape_an_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").where("lang = 'en'").limit(300)
    one = docs.where("length(text) between 1000 and 2000").orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(3000)).select((F.col("id") + 1_000_000).alias("doc_id"), "text", "lang", "source")
    docs = spark.createDataFrame(docs.collect(), SCHEMA)
    before = {r.doc_id: (r.kept, round(r.distance or 0, 6)) for r in outliers.quality_rules(docs).collect()}
    after = {r.doc_id: (r.kept, round(r.distance or 0, 6)) for r in outliers.quality_rules(docs.union(copies)).collect()}
    own = before[one.first().doc_id]
    assert {k: after[k] for k in before} == before and all(after[1_000_000 + i] == own for i in range(3000))
