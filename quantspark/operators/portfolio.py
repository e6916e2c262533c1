"""Portfolio and performance arithmetic on return and value series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quantspark.operators.rowwise import finite, sdiv

PERIODS = {"daily": 252.0, "weekly": 52.0, "monthly": 12.0}


def path(by: Sequence[str] = (), day: str = "trade_date") -> WindowSpec:
    """Running window per series; a series has one row per calendar date."""
    keys = [F.col(c) for c in by] or [F.lit(0)]
    return Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)


def nav_and_drawdown(returns: DataFrame, by=(), ret: str = "ret") -> DataFrame:
    """NAV = product of (1 + r); drawdown against the running peak."""
    w = path(by)
    out = returns.withColumn("nav", F.product(1.0 + F.coalesce(F.col(ret), F.lit(0.0))).over(w))
    out = out.withColumn("peak", F.max("nav").over(w))
    return out.withColumn("drawdown", sdiv(F.col("nav") - F.col("peak"), F.col("peak"))).drop("peak")


def align_navs(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Common dates with both values positive, each rebased to its first common value."""
    b = benchmark.select("trade_date", F.col("nav").alias("b_"))
    j = strategy.select("trade_date", F.col("nav").alias("s_")).join(b, "trade_date").where("s_ > 0 and b_ > 0")
    w = path()
    return j.select(
        "trade_date",
        (F.col("s_") / F.first("s_").over(w)).alias("strategy"),
        (F.col("b_") / F.first("b_").over(w)).alias("benchmark"),
    )


def excess_points(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    j = align_navs(strategy, benchmark)
    return j.withColumn("excess", sdiv(F.col("strategy"), F.col("benchmark")))


def simple_metrics(returns: DataFrame, by=(), ret: str = "ret", rf: float = 0.0) -> DataFrame:
    """Annual return (bars and calendar days), Sharpe and win rate in one aggregate."""
    r = F.col(ret)
    growth = F.product(1.0 + r)
    days = F.datediff(F.max("trade_date"), F.min("trade_date"))
    mean, std = F.avg(r), F.stddev_samp(r)
    return returns.groupBy(*by).agg(
        (growth - 1.0).alias("total_return"),
        finite(F.pow(growth, 252.0 / F.count(r)) - 1.0).alias("annual_return"),
        finite(F.pow(growth, F.try_divide(F.lit(365.25), F.nullif(days, F.lit(0)))) - 1.0).alias("calendar_return"),
        sdiv((mean - rf / 252.0) * F.sqrt(F.lit(252.0)), std).alias("sharpe"),
        sdiv(F.sum(F.when(r > 0, 1.0).otherwise(0.0)), F.count(r).cast("double")).alias("win_rate"),
    )


def full_metrics(returns: DataFrame, by=(), rf: float = 0.02, freq: str = "daily") -> DataFrame:
    """Metric table per series; needs columns ret and bench."""
    ann = PERIODS.get(freq, 252.0)
    navs = nav_and_drawdown(returns, by)
    r, b = F.col("ret"), F.col("bench")
    growth = F.product(1.0 + r)
    annual = finite(F.pow(growth, ann / F.count(r)) - 1.0)
    vol = F.stddev_pop(r) * ann ** 0.5
    down = F.stddev_pop(F.when(r < 0, r)) * ann ** 0.5
    worst = F.min("drawdown")
    track = F.stddev_pop(r - b) * ann ** 0.5
    return navs.groupBy(*by).agg(
        annual.alias("annual_return"),
        vol.alias("volatility"),
        sdiv(annual - rf, vol).alias("sharpe"),
        sdiv(annual - rf, down).alias("sortino"),
        worst.alias("max_drawdown"),
        F.when(F.abs(worst) > 1e-8, sdiv(annual, F.abs(worst))).alias("calmar"),
        sdiv(F.covar_samp(r, b), F.var_samp(b)).alias("beta"),
        ((F.avg(r - b) - rf / ann) * ann).alias("alpha"),
        sdiv((F.avg(r) - F.avg(b)) * ann, track).alias("information_ratio"),
    )


def grouped_backtest(factor: DataFrame, returns: DataFrame, *, every: int = 5, groups: int = 5,
                     cost: float = 0.0, skip: int = 1) -> DataFrame:
    """Quantile groups set at every ``every``-th date, held over (rebalance, next].

    Group return of a period = mean over its days of the mean over its names; the long-short
    series is top minus bottom minus four one-way costs.
    """
    from quantspark.functions.expr import bucket, field, where, xcount
    from quantspark.operators.panel import with_factors

    scale = {21: 1 / 12, 5: 1 / 52}.get(every, 1.0)
    w = Window.partitionBy(F.lit(0)).orderBy("trade_date")  # calendar rows only
    days = factor.select("trade_date").distinct().join(
        returns.select("trade_date").distinct(), "trade_date", "left_semi"
    ).withColumn("i", F.row_number().over(w) - 1)
    days = days.withColumn("period", F.floor((F.col("i") - skip) / every))
    rebalance = days.where(F.col("i") % every == 0).select("trade_date", (F.col("i") / every).cast("long").alias("period"))
    at = factor.join(F.broadcast(rebalance), "trade_date")  # calendar-sized
    x = field("factor")
    label = where(xcount(x) >= float(groups * 2), bucket(x, groups), None)
    labels = with_factors(at, {"g": label}).where("g is not null").select("period", "symbol", "g")
    held = returns.join(F.broadcast(days), "trade_date").where("period >= 0")
    daily = held.join(labels, ["period", "symbol"]).groupBy("period", "trade_date", "g").agg(F.avg("ret").alias("r"))
    period = daily.groupBy("period", "g").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("r"))
    wide = period.groupBy("period").agg(
        F.max(F.when(F.col("g") == groups - 1, F.col("r"))).alias("top"),
        F.max(F.when(F.col("g") == 0, F.col("r"))).alias("bottom"),
    )
    net = period.select("period", F.col("g").cast("int").cast("string").alias("series"), (F.col("r") - cost * 2 * scale).alias("ret"))
    spread = wide.select("period", F.lit("long_short").alias("series"), (F.col("top") - F.col("bottom") - cost * 4).alias("ret"))
    out = net.unionByName(spread)
    run = Window.partitionBy("series").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("nav", F.product(1.0 + F.col("ret")).over(run))


def equity_curve(snapshots: DataFrame, capital: float, spike: float = 5.0) -> DataFrame:
    """Peak, profit, return and drawdown of usable equity snapshots per account.

    A snapshot is unusable when it is not positive or beyond ``spike`` times the mean.
    """
    mean = F.avg(F.when(F.col("equity") > 0, F.col("equity")))
    means = snapshots.groupBy("account").agg(mean.alias("mean_"))
    rows = snapshots.join(means, "account").where((F.col("equity") > 0) & (F.col("equity") <= spike * F.col("mean_")))
    w = path(["account"])
    rows = rows.withColumn("peak", F.max("equity").over(w))
    return rows.select(
        "account", "trade_date", "equity", "peak", (F.col("equity") - capital).alias("pnl"),
        (F.col("equity") / F.lit(capital) - 1.0).alias("total_return"),
        sdiv(F.col("equity") - F.col("peak"), F.col("peak")).alias("drawdown"),
    )


def position_table(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Market value, cost, unrealised profit and weight of each position."""
    j = positions.join(prices, "symbol", "left")
    value, cost = F.col("quantity") * F.col("price"), F.col("quantity") * F.col("avg_cost")
    rows = j.withColumns({"market_value": value, "cost_basis": cost})
    whole = rows.agg(F.sum("market_value")).scalar()
    return rows.select(
        "symbol", "market_value", "cost_basis",
        sdiv(F.col("market_value") - F.col("cost_basis"), F.col("cost_basis")).alias("pnl_pct"),
        sdiv(F.col("market_value"), whole).alias("weight"),
    )


def walk_forward(train: int, test: int, calendar: DataFrame) -> DataFrame:
    """(window, train_start, train_end, test_end) day numbers over the calendar."""
    n = calendar.agg(F.count(F.lit(1)).alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - (train + test), F.lit(0)), F.lit(test))
    return n.where(F.col("n") >= train + test).select(F.posexplode(starts).alias("window", "train_start")).select(
        "window", "train_start", (F.col("train_start") + train - 1).alias("train_end"),
        (F.col("train_start") + train + test - 1).alias("test_end"),
    )
