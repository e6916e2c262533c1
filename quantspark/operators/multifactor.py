"""Multi-factor scoring: neutralise, transform, orient, combine, select, size orders."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.functions.expr import (
    Node, coalesce, demean, field, isnull, notnull, rank, where, wrap, xcount,
    xintercept, xmax, xmin, xslope, xstdp, zscore_pop,
)
from quantspark.operators.panel import with_factors
from quantspark.session import cut_lineage


@dataclass(frozen=True)
class FactorSpec:
    """How one factor enters the score."""

    name: str
    weight: float = 1.0
    ascending: bool = False  # True: small values are good
    method: str = "rank_pct"  # raw | rank_pct | zscore
    industry: bool = False
    size: bool = False


def size_neutral(x: Node, log_cap: Node) -> Node:
    ok = notnull(x) & notnull(log_cap)
    y, z = where(ok, x, None), where(ok, log_cap, None)
    enough = (xcount(y) >= 3.0) & (xmin(z) < xmax(z))
    return where(enough, x - xintercept(y, z) - xslope(y, z) * log_cap, None)


def prepared(spec: FactorSpec) -> Node:
    """Neutralise, then industry z-score or transform, then orient so that high is good."""
    x: Node = field(spec.name)
    if spec.size:
        x = size_neutral(x, field("log_cap"))
    if spec.industry:
        x = zscore_pop(x, by=("industry",))
        x = rank(x) if spec.method == "rank_pct" else x
    elif spec.method == "rank_pct":
        x = rank(x)
    elif spec.method == "zscore":
        x = zscore_pop(x)
    if spec.ascending:
        x = 1.0 - x if spec.method == "rank_pct" else -x
    return x


def score_of(parts: Mapping[str, Node], specs: Sequence[FactorSpec], min_coverage: float) -> Node:
    """Weighted mean over the factors present; NULL below the required number of factors."""
    total, weight, count = wrap(0.0), wrap(0.0), wrap(0.0)
    for s in specs:
        x = parts[s.name]
        total = total + coalesce(x * s.weight, 0.0)
        weight = weight + where(isnull(x), 0.0, abs(s.weight))
        count = count + where(isnull(x), 0.0, 1.0)
    need = math.ceil(len(specs) * min_coverage)
    return where(count >= float(need), total / weight, None)


def score_sections(wide: DataFrame, specs: Sequence[FactorSpec], min_coverage=0.6, section_rows=None) -> DataFrame:
    """Prepared factors and score for every date at once."""
    parts = {s.name: prepared(s) for s in specs}
    out = {f"p_{n}": node for n, node in parts.items()}
    out["score"] = score_of(parts, specs, min_coverage)
    return with_factors(wide, out, section_rows=section_rows)


def research_prepare(x: Node, limit=0.025, by_industry=False, standardise=True) -> Node:
    """Winsorise (three values or more), then industry-adjust or standardise (0 when flat)."""
    from quantspark.functions.expr import winsorize

    x = where(xcount(x) >= 3.0, winsorize(x, limit), x)
    if by_industry:
        gap = demean(x, by=("industry",))
        spread = xstdp(x, by=("industry",))
        value = where(spread.eq(0.0), 0.0, gap / spread) if standardise else gap
        return where(isnull(field("industry")), None, value)
    if standardise:
        return where(xstdp(x).eq(0.0) & notnull(x), 0.0, zscore_pop(x))
    return x


def buffered_targets(scored: DataFrame, holdings: DataFrame, top_n: int, buffer: int) -> DataFrame:
    """Keep holdings ranked within top_n + buffer first, then fill with the best others."""
    w = Window.partitionBy("trade_date").orderBy(F.desc("score"), "symbol")
    ranked = scored.where("score is not null").withColumn("rank", F.row_number().over(w))
    near = ranked.where(F.col("rank") <= top_n + buffer)
    held = near.join(holdings.select("symbol").distinct().withColumn("held", F.lit(1)), "symbol", "left")
    order = Window.partitionBy("trade_date").orderBy(F.desc(F.coalesce("held", F.lit(0))), "rank")
    picked = held.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= top_n)
    return picked.select("trade_date", "symbol", "score", "rank", F.coalesce("held", F.lit(0)).alias("held"))


def target_weights(targets: DataFrame, max_pct: float, cash_buffer: float) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("trade_date"))
    return targets.withColumn("weight", F.least(F.lit(max_pct), (1.0 - cash_buffer) / n))


def overnight_exposure(ret: Column, caution: float, defensive: float, keep_caution=0.7, keep_defensive=0.3) -> Column:
    """Exposure after the overnight move of a foreign market."""
    return F.when(ret.isNull(), 1.0).when(ret <= defensive, keep_defensive).when(ret <= caution, keep_caution).otherwise(1.0)


def entry_filter(targets: DataFrame, current: DataFrame, blocked: Column) -> DataFrame:
    """While blocked, drop new names and cap increases at the current weight."""
    j = targets.join(current.select("symbol", "current_weight"), "symbol", "left")
    now = F.coalesce("current_weight", F.lit(0.0))
    weight = F.when(blocked & (now <= 0), 0.0).when(blocked, F.least("weight", now)).otherwise(F.col("weight"))
    return j.withColumns(
        {
            "weight_after": weight,
            "dropped": (blocked & (now <= 0)).cast("int"),
            "capped": (blocked & (now > 0) & (F.col("weight") > now)).cast("int"),
        }
    )


def order_deltas(targets: DataFrame, positions: DataFrame, prices: DataFrame, portfolio_value: float,
                 lot: int = 100, tolerance: float = 0.002) -> DataFrame:
    """Lot-rounded orders from target weights; sells come first."""
    j = targets.select("symbol", "weight").join(positions.select("symbol", "quantity"), "symbol", "full")
    j = j.join(prices.select("symbol", "price"), "symbol").where("price > 0")
    value = F.coalesce("weight", F.lit(0.0)) * portfolio_value
    want = F.floor(value / F.col("price") / lot) * lot
    delta = want - F.coalesce("quantity", F.lit(0.0))
    rows = j.select("symbol", "price", want.cast("double").alias("target_quantity"), delta.cast("double").alias("delta"))
    rows = rows.where((F.col("delta") != 0) & (F.abs("delta") * F.col("price") >= tolerance * portfolio_value))
    side = F.when(F.col("delta") < 0, "SELL").otherwise("BUY")
    return rows.withColumn("side", side).orderBy(F.when(F.col("delta") < 0, 0).otherwise(1), "symbol")


#: ranks of one chunk of a date's orders
RANKS = 4096


def _sum_before(orders: DataFrame, value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over the orders of the date that come first, chunk by chunk of ranks."""
    orders = orders.withColumns({"chunk_": F.floor(F.col("rank") / RANKS), "value_": value})
    chunks = orders.groupBy("trade_date", "chunk_").agg(F.sum("value_").alias("own_"))
    by_chunk = Window.partitionBy("trade_date").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("trade_date", "chunk_", F.coalesce(F.sum("own_").over(by_chunk), F.lit(0)).alias("start_"))
    inside = Window.partitionBy("trade_date", "chunk_").orderBy("rank", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    placed = orders.withColumn("in_", F.coalesce(F.sum("value_").over(inside), F.lit(0)))
    return placed.join(starts, ["trade_date", "chunk_"]).withColumn(out, F.col("start_") + F.col("in_")).drop("chunk_", "value_", "in_", "start_")


def admit_buys(orders: DataFrame, cash: float, buffer: float = 0.02, max_orders: int | None = None) -> DataFrame:
    """Greedy, rank-ordered admission of buys under a cash limit, per date.

    Every order comes back; with ``max_orders``, the strategy's position limit, orders ranked beyond
    it are not accepted. An order without a cost or with a negative one is not accepted, a free
    one is. ``rank`` is a number and, with the symbol, the order within a date.

    Greedy admission is sequential, but not order by order. While at least half of a date's cash is
    left, every order of at most that half fits, and what is left before each order is a prefix sum
    over these. So the first order is found at which a larger one fits or the cash falls below
    half: up to there all is decided, and the rest goes on with less than half the cash. Each
    round is one distributed pass over all dates; there are as many as the cash halves
    until nothing is left that it pays.
    """
    at = F.struct("rank", "symbol")
    base = orders
    if max_orders is not None:
        base = _sum_before(base, F.lit(1), "placed_").withColumn("placed_", F.col("placed_") < max_orders)
    else:
        base = base.withColumn("placed_", F.lit(True))
    base = cut_lineage(base.select("trade_date", "symbol", "rank", "cost", "placed_"))
    buys = base.where(F.col("placed_") & (F.col("cost") > 0)).select("trade_date", "symbol", "rank", "cost", at.alias("at_"))
    state = buys.groupBy("trade_date").agg(F.lit(float(cash * (1.0 - buffer))).alias("left_"), F.struct((F.min("rank") - 1).alias("rank"), F.min("symbol").alias("symbol")).alias("from_"))
    rounds = []
    while True:
        state = cut_lineage(state)  # one row per date that still has cash to give
        live = buys.join(F.broadcast(state), "trade_date").where((F.col("at_") > F.col("from_")) & (F.col("cost") <= F.col("left_")))
        half = F.col("left_") / 2.0
        small = F.col("cost") <= half
        seen = _sum_before(live, F.when(small, F.col("cost")).otherwise(0.0), "spent_").withColumn("room_", F.col("left_") - F.col("spent_"))
        turn = F.when(small, F.col("room_") - F.col("cost") < half).otherwise(F.col("cost") <= F.col("room_"))
        ends = seen.where(turn).groupBy("trade_date").agg(F.min("at_").alias("to_"), F.min_by(F.col("room_") - F.col("cost"), "at_").alias("rest_"))
        done = cut_lineage(state.join(ends, "trade_date", "left"))
        rounds.append(done.select("trade_date", "left_", "from_", "to_"))
        state = done.where("to_ is not null").select("trade_date", F.col("rest_").alias("left_"), F.col("to_").alias("from_"))
        if state.isEmpty():
            break
    decided = reduce(DataFrame.unionByName, rounds).groupBy("trade_date").agg(F.collect_list(F.struct("left_", "from_", "to_")).alias("rounds_"))

    def taken(r):
        inside = (at > r["from_"]) & F.coalesce(at <= r["to_"], F.lit(True))
        return inside & (F.col("cost") <= r["left_"]) & ((F.col("cost") <= r["left_"] / 2.0) | at.eqNullSafe(r["to_"]))

    accepted = F.col("placed_") & ((F.col("cost") == 0) | ((F.col("cost") > 0) & F.exists("rounds_", taken)))
    both = base.join(F.broadcast(decided), "trade_date", "left")  # one row per date
    return both.select("trade_date", "symbol", "rank", "cost", F.coalesce(accepted, F.lit(False)).alias("accepted"))
