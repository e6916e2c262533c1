"""Per-date cross-section operators.

Two physical forms give the same values:

* ``CS`` - window columns partitioned by date; right while a date's section is known to
  fit one task (the caller checks the largest section first);
* ``attach_sections`` - for wider universes. Averages and regressions become one partially
  aggregated ``groupBy`` joined back; ranks and quantiles are computed by value buckets:
  count equal values, split each date at approximate cut points, rank inside a bucket and
  add the rows of the buckets below. No task ever holds a whole date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.operators.rowwise import sdiv
from quantspark.operators.timeseries import TIE_DIGITS, paired
from quantspark.session import cut_lineage

#: value buckets per date in the wide form
BUCKETS = 256


def percent_rank(x: Column, part: list[str], ascending: bool = True) -> Column:
    """pandas ``rank(pct=True)`` with average ties; NULL stays NULL."""
    x = F.round(x, TIE_DIGITS)
    order = F.asc_nulls_last(x) if ascending else F.desc_nulls_last(x)
    w = Window.partitionBy(*part).orderBy(order)
    # first and last position of the tie; one ordering serves all three windows
    first = F.rank().over(w)
    last = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    count = F.count(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.when(x.isNotNull(), (first + last) / 2.0 / count)


def _over(fn):
    return lambda part, *xs: fn(*xs).over(Window.partitionBy(*part))


def section_slope(y: Column, x: Column) -> Column:
    y, x = paired(y, x)
    return sdiv(F.covar_pop(y, x), F.var_pop(x))


def section_intercept(y: Column, x: Column) -> Column:
    ym, xm = paired(y, x)
    return F.avg(ym) - section_slope(y, x) * F.avg(xm)


def _slope_over(part, y, x):
    y, x = paired(y, x)
    w = Window.partitionBy(*part)
    return sdiv(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))


def _intercept_over(part, y, x):
    ym, xm = paired(y, x)
    w = Window.partitionBy(*part)
    return F.avg(ym).over(w) - _slope_over(part, y, x) * F.avg(xm).over(w)


#: aggregate-shaped section operators as plain aggregates
AGGREGATES = {
    "xmean": F.avg,
    "xsum": F.sum,
    "xcount": lambda x: F.count(x).cast("double"),
    "xstd": F.stddev_samp,
    "xstdp": F.stddev_pop,
    "xmin": F.min,
    "xmax": F.max,
    "xslope": section_slope,
    "xintercept": section_intercept,
}

CS = {
    "rank": lambda part, x, ascending: percent_rank(x, part, ascending),
    "xquantile": lambda part, x, q: F.percentile(x, F.lit(q)).over(Window.partitionBy(*part)),
    "xcount": lambda part, x: F.count(x).over(Window.partitionBy(*part)).cast("double"),
    "xslope": _slope_over,
    "xintercept": _intercept_over,
    **{k: _over(AGGREGATES[k]) for k in ("xmean", "xsum", "xstd", "xstdp", "xmin", "xmax")},
}


def value_counts(df: DataFrame, part: list[str], value: Column) -> DataFrame:
    """(part, v_, first_, ties_, n_): rank of each distinct value inside its section.

    Equal values are counted before anything is shuffled by value, so one value held
    by a third of the rows costs one row per map task.
    """
    counts = (
        df.select(*part, value.cast("double").alias("v_"))
        .where("v_ is not null")
        .groupBy(*part, "v_")
        .agg(F.count(F.lit(1)).alias("ties_"))
    )
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = counts.groupBy(*part).agg(
        F.percentile_approx("v_", F.array(*map(F.lit, probs)), F.lit(10_000)).alias("cuts_")
    )
    placed = counts.join(cuts, part).withColumn(
        "bucket_", F.size(F.filter("cuts_", lambda c: c < F.col("v_")))
    ).drop("cuts_")
    # dealt by bucket: the join has left whole sections together, which the windows below would take as they are
    placed = placed.repartition(*part, "bucket_")
    sizes = placed.groupBy(*part, "bucket_").agg(F.sum("ties_").alias("in_bucket_"))
    ordered = Window.partitionBy(*part).orderBy("bucket_")
    offsets = sizes.select(
        *part,
        "bucket_",
        (F.sum("in_bucket_").over(ordered) - F.col("in_bucket_")).alias("below_"),
        F.sum("in_bucket_").over(Window.partitionBy(*part)).alias("n_"),
    )
    inside = Window.partitionBy(*part, "bucket_").orderBy("v_")
    return (
        placed.withColumn("run_", F.sum("ties_").over(inside) - F.col("ties_"))
        .join(offsets, [*part, "bucket_"])
        .select(*part, "v_", "ties_", "n_", (F.col("below_") + F.col("run_") + 1).alias("first_"))
    )


def quantile_table(df: DataFrame, part: list[str], value: Column, wanted: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per section: one row per section, one column per name."""
    ranks = value_counts(df, part, value)
    last = F.col("first_") + F.col("ties_") - 1
    picks, outs = [], []
    for name, q in wanted.items():
        at = (F.col("n_") - 1) * q + 1  # 1-based fractional position
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when(low.between(F.col("first_"), last), F.col("v_"))).alias(f"{name}_lo"),
            F.max(F.when(high.between(F.col("first_"), last), F.col("v_"))).alias(f"{name}_hi"),
            F.max(at - low).alias(f"{name}_at"),
        ]
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        outs.append((lo + (hi - lo) * F.col(f"{name}_at")).alias(name))
    return ranks.groupBy(*part).agg(*picks).select(*part, *outs)


def attach_sections(df: DataFrame, requests) -> DataFrame:
    """Wide form of one cross-section pass.

    ``requests`` holds (out, op, part, columns, params, value_key). Every side table reads
    the checkpointed input, so the plan grows with the number of requests, not with its
    powers; ranks come back on (section, value), the rest on the section alone.
    """
    base = cut_lineage(df)
    out = base
    grouped: dict[tuple, list] = {}
    quantiles: dict[tuple, tuple[Column, dict[str, float]]] = {}
    for name, op, part, cols, params, key in requests:
        if op in AGGREGATES:
            grouped.setdefault(tuple(part), []).append(AGGREGATES[op](*cols).alias(name))
        elif op == "xquantile":
            quantiles.setdefault((tuple(part), key), (cols[0], {}))[1][name] = params[0]
    for part, aggs in grouped.items():
        out = out.join(base.groupBy(*part).agg(*aggs), list(part), "left")
    for (part, _), (value, wanted) in quantiles.items():
        out = out.join(quantile_table(base, list(part), value, wanted), list(part), "left")
    for name, op, part, cols, params, _ in requests:
        if op != "rank":
            continue
        value = F.round(cols[0], TIE_DIGITS).cast("double")
        value = value if params[0] else -value
        pct = (F.col("first_") + (F.col("ties_") - 1) / 2.0) / F.col("n_")
        ranks = value_counts(base, part, value).select(*part, "v_", pct.alias(name))
        out = out.withColumn("v_", value).join(ranks, [*part, "v_"], "left").drop("v_")
    return out


def section_position(df: DataFrame, part: list[str], value: str, tie: str, out: str, *,
                     descending: bool = False, wide: bool = False) -> DataFrame:
    """1-based position of each row in its section by (value, tie).

    The wide form takes the rank of the value from ``value_counts`` and orders only rows
    that share a value.
    """
    if not wide:
        order = F.desc(value) if descending else F.asc(value)
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(order, tie)))
    base = cut_lineage(df)
    key = F.col(value).cast("double")
    key = -key if descending else key
    first = value_counts(base, part, key).select(*part, "v_", "first_")
    among = Window.partitionBy(*part, "v_").orderBy(tie)
    ranked = base.withColumn("v_", key).join(first, [*part, "v_"])
    at = (F.col("first_") + F.row_number().over(among) - 1).cast("int")
    return ranked.withColumn(out, at).drop("v_", "first_")
