"""Factor evaluation: rank IC, decay, turnover, quantile NAV.

Frames are long: (factor_name, trade_date, symbol, x, r). ``by`` lists the columns that
identify one evaluated series, so many factors run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.functions.expr import Node, bucket, field, lead, rank, where, xcount
from quantspark.operators.panel import with_factors
from quantspark.operators.rowwise import sdiv

LAGS = (1, 3, 5, 10, 20)
MIN_NAMES = 10

FORWARD_RETURN: Node = lead(field("close"), 1) / field("close") - 1.0


def joint(df: DataFrame) -> DataFrame:
    return df.where(F.col("x").isNotNull() & F.col("r").isNotNull())


def rank_ic(df: DataFrame, by: Sequence[str] = (), min_names: int = MIN_NAMES, section_rows=None) -> DataFrame:
    """Daily Spearman IC: Pearson correlation of average ranks of the jointly present rows."""
    x, r = field("x"), field("r")
    ranked = with_factors(
        joint(df), {"rx": rank(x, by=by), "rr": rank(r, by=by)}, section_rows=section_rows
    )
    spread = F.stddev_pop("rx") * F.stddev_pop("rr")
    daily = ranked.groupBy(*by, "trade_date").agg(
        F.count(F.lit(1)).alias("names"), sdiv(F.covar_pop("rx", "rr"), spread).alias("ic")
    )
    return daily.where((F.col("names") >= min_names) & F.col("ic").isNotNull())


def ic_stats(ic: DataFrame, by: Sequence[str] = (), ddof: int = 1) -> DataFrame:
    """Mean, deviation, ICIR, positive share and share of |IC| > 0.02."""
    std = F.stddev_samp("ic") if ddof else F.stddev_pop("ic")
    return ic.groupBy(*by).agg(
        F.count("ic").alias("days"),
        F.avg("ic").alias("ic_mean"),
        std.alias("ic_std"),
        sdiv(F.avg("ic"), std).alias("icir"),
        F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)).alias("positive_rate"),
        F.avg(F.when(F.abs("ic") > 0.02, 1.0).otherwise(0.0)).alias("strong_rate"),
    )


def date_index(df: DataFrame) -> DataFrame:
    """Dense number per date; the window only sees one row per date."""
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    return df.select("trade_date").distinct().withColumn("day_no", F.row_number().over(w))


def lagged(factor: DataFrame, returns: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Factor rows against the return ``lag`` dates later on the shared date axis."""
    days = F.broadcast(date_index(returns))  # one row per date
    ahead = returns.join(days, "trade_date").select("symbol", "r", "day_no")
    moved = ahead.select(
        "symbol", "r", F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col("day_no").alias("to_")
    ).select("symbol", "r", "lag", (F.col("to_") - F.col("lag")).alias("day_no"))
    base = factor.join(days, "trade_date")
    return base.join(moved, ["symbol", "day_no"]).drop("day_no")


def ic_decay(factor, returns, lags=LAGS, section_rows=None) -> DataFrame:
    ic = rank_ic(lagged(factor, returns, lags), by=["lag"], section_rows=section_rows)
    return ic.groupBy("lag").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("days"))


def labelled(df: DataFrame, groups: int, by=(), min_names=None, section_rows=None) -> DataFrame:
    """Quantile label 0..groups-1 per date section; NULL where the section is too small."""
    x = field("x")
    need = float(min_names if min_names is not None else groups * 2)
    label = where(xcount(x, by=by) >= need, bucket(x, groups, by), None)
    return with_factors(df, {"g": label}, section_rows=section_rows)


def signal_decay(factor, returns, lags=LAGS, section_rows=None) -> DataFrame:
    """Mean return of the bottom and top fifth per lag."""
    rows = labelled(joint(lagged(factor, returns, lags)), 5, by=["lag"], min_names=MIN_NAMES, section_rows=section_rows)
    daily = rows.where("g is not null").groupBy("lag", "trade_date").agg(
        F.avg(F.when(F.col("g") == 4, F.col("r"))).alias("top"),
        F.avg(F.when(F.col("g") == 0, F.col("r"))).alias("bottom"),
    )
    return daily.groupBy("lag").agg(F.avg("bottom").alias("bottom"), F.avg("top").alias("top"))


def industry_ic(df: DataFrame, min_symbols: int = 5, section_rows=None) -> DataFrame:
    """Mean IC per industry with enough symbols, strongest first."""
    sizes = df.select("industry", "symbol").distinct().groupBy("industry").agg(F.count(F.lit(1)).alias("symbols"))
    ic = rank_ic(df, by=["industry"], section_rows=section_rows)
    mean = ic.groupBy("industry").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("days"))
    return mean.join(sizes.where(F.col("symbols") >= min_symbols), "industry").orderBy(F.desc(F.abs("ic_mean")), "industry")


def quantile_turnover(df: DataFrame, groups: int = 5, section_rows=None) -> DataFrame:
    """1 - stayers / previous members, for the bottom and the top group of each date pair."""
    labels = labelled(df, groups, section_rows=section_rows).where("g is not null")
    days = F.broadcast(date_index(df))
    now = labels.join(days, "trade_date").select("trade_date", "symbol", "day_no", F.col("g").alias("g_now"))
    prev = now.select("symbol", (F.col("day_no") + 1).alias("day_no"), F.col("g_now").alias("g_prev"))
    j = now.join(prev, ["symbol", "day_no"])

    def turn(label):
        was = F.sum(F.when(F.col("g_prev") == label, 1.0).otherwise(0.0))
        stay = F.sum(F.when((F.col("g_prev") == label) & (F.col("g_now") == label), 1.0).otherwise(0.0))
        return 1.0 - stay / F.greatest(was, F.lit(1.0))

    out = j.groupBy("trade_date").agg(
        F.count(F.lit(1)).alias("common"), turn(0).alias("bottom"), turn(groups - 1).alias("top")
    )
    return out.where(F.col("common") >= groups * 2).drop("common")


def top_n_turnover(df: DataFrame, n: int = 10, every: int = 5) -> DataFrame:
    """1 - |previous top N & current top N| / N at every ``every``-th date."""
    days = date_index(df).where((F.col("day_no") - 1) % every == 0).withColumn("no", F.floor((F.col("day_no") - 1) / every))
    w = Window.partitionBy("trade_date").orderBy(F.desc("x"), "symbol")
    top = df.where("x is not null").join(F.broadcast(days.select("trade_date", "no")), "trade_date").withColumn(
        "rn", F.row_number().over(w)).where(F.col("rn") <= n).select("trade_date", "symbol", "no")
    prev = top.select("symbol", (F.col("no") + 1).alias("no"), F.lit(1).alias("was"))
    j = top.join(prev, ["symbol", "no"], "left").groupBy("trade_date", "no").agg(F.count("was").alias("common"))
    return j.where("no > 0").select("trade_date", (1.0 - F.col("common") / float(n)).alias("turnover"))


def quantile_nav(df: DataFrame, groups: int = 5, fee: float = 0.0, descending=True, by=(), section_rows=None) -> DataFrame:
    """Daily group returns net of fee/252 and their NAV, plus the long-short series."""
    rows = labelled(joint(df), groups, by=by, section_rows=section_rows).where("g is not null")
    means = rows.groupBy(*by, "trade_date", "g").agg(F.avg("r").alias("m"))
    every = means.select(*by, "trade_date").distinct().withColumn(
        "g", F.explode(F.array(*[F.lit(float(i)) for i in range(groups)])))
    net = every.join(means, [*by, "trade_date", "g"], "left").withColumn("ret", F.coalesce("m", F.lit(0.0)) - fee / 252.0)
    best, worst = (groups - 1, 0) if descending else (0, groups - 1)
    spread = net.groupBy(*by, "trade_date").agg(
        (F.max(F.when(F.col("g") == best, F.col("ret"))) - F.max(F.when(F.col("g") == worst, F.col("ret"))) - fee / 126.0).alias("ret")
    ).select(*by, "trade_date", F.lit("long_short").alias("series"), "ret")
    named = net.select(*by, "trade_date", F.concat(F.lit("q"), (F.col("g") + 1).cast("int").cast("string")).alias("series"), "ret")
    run = Window.partitionBy(*by, "series").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return named.unionByName(spread).withColumn("nav", F.product(1.0 + F.col("ret")).over(run))


def coverage_summary(df: DataFrame, by=()) -> DataFrame:
    """Share of rows with a value and the number of symbols that ever have one."""
    per = df.groupBy(*by, "symbol").agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("t"))
    return per.groupBy(*by).agg(
        sdiv(F.sum("n").cast("double"), F.sum("t").cast("double")).alias("coverage"),
        F.count_if(F.col("n") > 0).alias("active_symbols"),
    )


def report(factor_panel: DataFrame, returns: DataFrame, section_rows=None) -> dict[str, DataFrame]:
    """The six report tables of one factor; each is its own lazily planned job."""
    both = factor_panel.join(returns, ["symbol", "trade_date"], "left")
    ic = rank_ic(both, section_rows=section_rows)
    return {
        "ic": ic,
        "ic_stats": ic_stats(ic),
        "decay": ic_decay(factor_panel, returns, section_rows=section_rows),
        "signal_decay": signal_decay(factor_panel, returns, section_rows=section_rows),
        "turnover": quantile_turnover(factor_panel, section_rows=section_rows),
        "quantile_nav": quantile_nav(both, section_rows=section_rows),
    }


def best_run(runs: DataFrame, want_start, want_end) -> DataFrame:
    """Stored run that serves a date range best: full cover, then overlap, then recency."""
    start, end = F.greatest("start_date", F.lit(want_start)), F.least("end_date", F.lit(want_end))
    overlap = F.greatest(F.datediff(end, start) + 1, F.lit(0))
    full = (F.col("start_date") <= F.lit(want_start)) & (F.col("end_date") >= F.lit(want_end))
    clipped = F.datediff(F.lit(want_end), F.lit(want_start)) + 1 - overlap
    rows = runs.withColumns({"full_cover": full, "overlap": overlap, "clipped": clipped}).where("overlap > 0")
    w = Window.partitionBy("params_hash").orderBy(F.desc("full_cover"), F.desc("overlap"), F.desc("created"), "run_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
