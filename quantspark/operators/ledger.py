"""Ledger operators: lot matching, average-cost reconciliation, exits, order checks.

A symbol's trades can be a large part of the ledger, so nothing here needs all of one
symbol's trades in one task: running quantities are prefix sums in two levels (inside a
chunk, then over the chunks), and the average-cost recurrence is composed the same way.
A chunk is a symbol's day; ``part`` splits days further, so that no hot symbol-day is one task
(any expression that never decreases along the day's order, such as a range of ``seq``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.operators.rowwise import sdiv
from quantspark.session import cut_lineage

ORDER = ("seq", "quantity", "price")
#: width, in shares, of the buckets on which cumulative intervals meet
SHARE_BUCKET = 1000.0


CHUNK = "chunk_"


def chunked(fills: DataFrame, part: Column | None = None) -> DataFrame:
    return fills.withColumn(CHUNK, F.struct("trade_date", (F.lit(0) if part is None else part).alias("part")))


def prefix_sum(df: DataFrame, value: str, out: str, key: str = "symbol", chunk: str = CHUNK,
               order: Sequence[str] = ORDER) -> DataFrame:
    """Running sum of ``value`` per key in (chunk, order) order, in two levels."""
    totals = df.groupBy(key, chunk).agg(F.sum(value).alias("t_"))
    before = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(key, chunk, F.coalesce(F.sum("t_").over(before), F.lit(0.0)).alias("start_"))
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("run_", F.sum(value).over(inside))
    return local.join(starts, [key, chunk]).withColumn(out, F.col("start_") + F.col("run_")).drop("start_", "run_")


def fifo_realised(fills: DataFrame, part: Column | None = None) -> DataFrame:
    """Realised profit per sell: sells meet buys on the cumulative-share axis, first in first out.

    Each fill occupies the interval [cum - quantity, cum); intervals are joined on share
    buckets and a pair counts only in the bucket where its overlap starts.
    """

    def spans(side):
        rows = prefix_sum(chunked(fills.where(F.col("side") == side), part), "quantity", "end_")
        rows = rows.withColumn("begin_", F.col("end_") - F.col("quantity"))
        last = F.greatest(F.floor(F.col("begin_") / SHARE_BUCKET), F.ceil(F.col("end_") / SHARE_BUCKET) - 1)
        return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin_") / SHARE_BUCKET), last)))

    buys = spans("BUY").select(
        "symbol", "bucket", F.col("begin_").alias("b0"), F.col("end_").alias("b1"),
        F.col("price").alias("buy_price"), F.col("trade_date").alias("lot_date"),
    )
    sells = spans("SELL").select(
        "symbol", "bucket", "seq", "trade_date", "quantity", F.col("begin_").alias("s0"),
        F.col("end_").alias("s1"), F.col("price").alias("sell_price"),
    )
    start = F.greatest("b0", "s0")
    overlap = F.least("b1", "s1") - start
    pairs = sells.join(buys, ["symbol", "bucket"]).where(
        (overlap > 0) & (F.floor(start / SHARE_BUCKET) == F.col("bucket"))
    ).withColumn("m_", overlap)
    return pairs.groupBy("symbol", "seq", "s0").agg(
        F.first("trade_date").alias("trade_date"),
        F.first("quantity").alias("quantity"),
        F.sum("m_").alias("matched"),
        F.sum(F.col("m_") * (F.col("sell_price") - F.col("buy_price"))).alias("realised"),
        F.max("lot_date").alias("last_lot"),
    ).select(
        "symbol", "seq", "trade_date", "quantity", "matched", "realised",
        (F.col("last_lot") < F.col("trade_date")).alias("t_plus_1"),
    )


def held_before(fills: DataFrame, part: Column | None = None) -> DataFrame:
    """Quantity held before each fill when sells never go below zero.

    With S the running signed quantity, the clamped holding is S - min(0, min of S so far).
    """
    signed = chunked(fills, part).withColumn("d_", F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")))
    inside = Window.partitionBy("symbol", CHUNK).orderBy(*ORDER)
    rows = signed.withColumn("run_", F.sum("d_").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("low_", F.min("run_").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    days = rows.groupBy("symbol", CHUNK).agg(F.sum("d_").alias("t_"), F.min("run_").alias("m_"))
    before = Window.partitionBy("symbol").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("start_", F.coalesce(F.sum("t_").over(before), F.lit(0.0)))
    days = days.withColumn("floor_", F.least(F.lit(0.0), F.min(F.col("start_") + F.col("m_")).over(before)))
    j = rows.join(days.select("symbol", CHUNK, "start_", "floor_"), ["symbol", CHUNK])
    lowest = F.least(F.lit(0.0), "floor_", F.col("start_") + F.col("low_"))
    at = F.col("start_") + F.col("run_") - F.col("d_")
    return j.withColumn("held", at - lowest).drop("d_", "run_", "low_", "start_", "floor_")


def average_cost(fills: DataFrame, part: Column | None = None) -> DataFrame:
    """Position, average cost, realised profit and cash flow per symbol.

    A buy maps the average cost a to a*h/(h+q) + value/(h+q), a sell leaves it. Such maps
    compose, so each chunk is folded on its own to (alpha, beta) plus the terms of its
    realised profit that are linear in the opening cost. Chunks are composed to days, days to
    months and months to the symbol, so no array holds all chunks of a symbol.
    """
    rows = held_before(fills, part)
    buy = F.col("side") == "BUY"
    after = F.col("held") + F.col("quantity")
    sold = F.when(buy, 0.0).otherwise(F.least("held", "quantity"))
    rows = rows.select(
        "symbol", CHUNK,
        F.struct(
            *ORDER,
            F.when(buy, F.col("held") / after).otherwise(1.0).alias("a"),
            F.when(buy, F.col("order_value") / after).otherwise(0.0).alias("b"),
            sold.alias("sold"),
        ).alias("o"),
        F.when(buy, F.col("quantity")).otherwise(-sold).alias("dq"),
        F.when(buy, -F.col("order_value")).otherwise(F.round(sold * F.col("price"), 2)).alias("dc"),
    )
    zero = F.struct(
        F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("slope")
    )

    def day_step(s, o):
        a, b = s["a"] * o["a"], s["b"] * o["a"] + o["b"]
        return F.struct(
            a.alias("a"), b.alias("b"),
            (s["gain"] + o["sold"] * (o["price"] - s["b"])).alias("gain"),
            (s["slope"] + o["sold"] * s["a"]).alias("slope"),
        )

    chunks = rows.groupBy("symbol", CHUNK).agg(
        F.aggregate(F.array_sort(F.collect_list("o")), zero, day_step).alias("m"),
        F.sum("dq").alias("dq"), F.sum("dc").alias("dc"),
    ).select("symbol", F.col(f"{CHUNK}.trade_date").alias("day"), F.col(f"{CHUNK}.part").alias("part"), "m", "dq", "dc")

    def compose(s, d):
        return F.struct(
            (s["a"] * d["a"]).alias("a"), (s["b"] * d["a"] + d["b"]).alias("b"),
            (s["gain"] + d["gain"] - d["slope"] * s["b"]).alias("gain"),
            (s["slope"] + d["slope"] * s["a"]).alias("slope"),
        )

    def level(df, keys, order):
        parts = F.array_sort(F.collect_list(F.struct(order, "m")))
        return df.groupBy(*keys).agg(
            F.aggregate(parts, zero, lambda s, d: compose(s, d["m"])).alias("m"),
            F.sum("dq").alias("dq"), F.sum("dc").alias("dc"),
        )

    days = level(chunks, ["symbol", "day"], "part").withColumn("month", F.trunc("day", "month"))
    out = level(level(days, ["symbol", "month"], "day"), ["symbol"], "month")
    open_ = F.col("dq") > 1e-6
    return out.select(
        "symbol", F.col("dq").alias("quantity"), F.when(open_, F.col("m.b")).alias("avg_cost"),
        F.col("m.gain").alias("realised"), F.col("dc").alias("cash_flow"),
    )


def apply_pending(positions: DataFrame, pending: DataFrame) -> DataFrame:
    """Quantities after pending orders, never below zero."""
    j = positions.join(pending, "symbol", "full")
    after = F.coalesce("quantity", F.lit(0.0)) + F.coalesce("net_quantity", F.lit(0.0))
    return j.select(
        "symbol", F.greatest(F.lit(0.0), after).alias("quantity_after"),
        F.coalesce("reserved_cash", F.lit(0.0)).alias("reserved_cash"),
    )


#: bars of one block, and blocks of one block of the next level
FAN = 64


def _summary(children: Column) -> Column:
    """Least and greatest price of a node, its deepest fall below its own running peak, and its risk mark."""
    start = F.struct(
        F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("dd"), F.lit(False).alias("risk")
    )
    return F.aggregate(
        children, start,
        lambda s, c: F.struct(
            F.least(s["lo"], c["lo"]).alias("lo"), F.greatest(s["hi"], c["hi"]).alias("hi"),
            F.least(s["dd"], c["dd"], sdiv(c["lo"], s["hi"])).alias("dd"), (s["risk"] | c["risk"]).alias("risk"),
        ),
    )


def _levels(bars: DataFrame, risk: str | None) -> list[DataFrame]:
    """The bars of each symbol as a tree: ``symbol, node, children`` of every level.

    A child of the lowest level is a bar; above, the summary of a node. A node has ``FAN`` children.
    """
    w = Window.partitionBy("symbol").orderBy("trade_date")
    flag = F.coalesce(F.col(risk), F.lit(False)) if risk else F.lit(False)
    rows = bars.where("close is not null").select("symbol", "trade_date", F.col("close").cast("double").alias("close"), flag.alias("risk"))
    rows = rows.withColumn("no", F.row_number().over(w) - 1)
    child = F.struct(
        (F.col("no") % FAN).alias("i"), F.col("close").alias("lo"), F.col("close").alias("hi"), F.lit(1.0).alias("dd"), "risk",
        F.col("trade_date").alias("day"),
    )
    node = F.floor(F.col("no") / FAN).cast("int")
    levels = [cut_lineage(rows.groupBy("symbol", node.alias("node")).agg(F.array_sort(F.collect_list(child)).alias("children")))]
    nodes = (levels[0].agg(F.max("node")).first()[0] or 0) + 1  # one number
    while nodes > 1:
        child = F.struct((F.col("node") % FAN).alias("i"), "s.lo", "s.hi", "s.dd", "s.risk")
        below = levels[-1].select("symbol", "node", _summary(F.col("children")).alias("s"))
        levels.append(below.groupBy("symbol", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(F.array_sort(F.collect_list(child)).alias("children")))
        nodes = -(-nodes // FAN)
    return levels


def _first_child(start: Column, stop: float, trail: float, take: float) -> Column:
    """The first child from ``start`` on in which some rule is met, -1 if none, and the peak before it.

    A node's summary decides exactly: its least price meets the stop or the peak so far, its greatest
    the profit target, and its own deepest fall the trailing stop, or no bar in it does.
    """
    def step(s, c):
        hit = (
            (sdiv(c["lo"], F.col("entry_price")) - 1.0 <= -stop) | (sdiv(c["lo"], s["peak"]) - 1.0 <= -trail)
            | (c["dd"] - 1.0 <= -trail) | (sdiv(c["hi"], F.col("entry_price")) - 1.0 >= take) | c["risk"]
        )
        met = F.struct(s["peak"].alias("peak"), c["i"].cast("int").alias("at"))
        on = F.struct(F.greatest(s["peak"], c["hi"]).alias("peak"), s["at"].alias("at"))
        return F.when(s["at"] >= 0, s).when(F.coalesce(hit, F.lit(False)), met).otherwise(on)

    zero = F.struct(F.col("peak").alias("peak"), F.lit(-1).alias("at"))
    # a start behind the last child gives an empty slice
    return F.coalesce(F.aggregate(F.slice("children", start + 1, F.lit(FAN)), zero, step), zero)


def first_exit(entries: DataFrame, bars: DataFrame, stop=0.1, trail=0.15, take=0.3, risk: str | None = None) -> DataFrame:
    """Earliest later bar that meets a stop-loss, trailing-stop, take-profit or risk rule, in that order.

    ``risk`` names a boolean column of ``bars``. The peak runs from the entry price on. The search
    climbs a tree of blocks of bars until some block must hold the first hit, then goes down
    into it: an entry meets one node a level on the way up and on the way down, and never its
    symbol's bars. Bars without a price are skipped; an entry without a positive price can
    only leave by the trailing stop of the bars after it, or by risk.
    """
    levels = _levels(bars, risk)
    # the number of bars up to the entry is the place of the first later one
    marks = levels[0].select("symbol", F.explode("children.day").alias("day"), F.lit(1).alias("bar"))
    own = ["symbol", "entry_date", "entry_price"]
    asked = entries.select(*own).distinct()
    both = marks.unionByName(asked.withColumns({"day": F.col("entry_date"), "bar": F.lit(0)}), allowMissingColumns=True)
    upto = Window.partitionBy("symbol").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    at = both.withColumn("next", F.sum("bar").over(upto).cast("int")).where("bar = 0").select(*own, "next")
    # found: the level below which the hit lies; node: where to look next on the level at hand
    rows = at.withColumns({"peak": F.coalesce(F.col("entry_price").cast("double"), F.lit(0.0)), "found": F.lit(-1), "node": F.col("next")})
    spread = -1 - F.pmod(F.xxhash64("symbol", "entry_date"), F.lit(1 << 20)).cast("int")  # no node: meets nothing

    def visit(rows: DataFrame, level: int, wanted: Column, node: Column, start: Column) -> DataFrame:
        rows = rows.withColumn("at_node", F.when(wanted, node).otherwise(spread))
        tree = levels[level].withColumnRenamed("node", "at_node")
        return rows.join(tree, ["symbol", "at_node"], "left").withColumn("s", F.when(F.col("children").isNotNull(), _first_child(start, stop, trail, take)))

    for level in range(len(levels)):
        # ``node`` is the first place of this level that is still to be seen
        rows = visit(rows, level, F.col("found") < 0, F.floor(F.col("node") / FAN).cast("int"), F.col("node") % FAN)
        hit = F.coalesce(F.col("s.at") >= 0, F.lit(False))
        rows = rows.withColumns({
            "peak": F.coalesce("s.peak", "peak"),
            "node": F.when(F.col("found") >= 0, F.col("node")).when(hit, F.col("at_node") * FAN + F.col("s.at")).otherwise(F.floor(F.col("node") / FAN).cast("int") + 1),
            "found": F.when(F.col("found") >= 0, F.col("found")).when(hit, level).otherwise(-1),
        }).drop("children", "s", "at_node")
    for level in range(len(levels) - 2, -1, -1):
        rows = visit(rows, level, F.col("found") == level + 1, F.col("node"), F.lit(0))
        down = F.col("s.at").isNotNull()
        rows = rows.withColumns({
            "peak": F.coalesce("s.peak", "peak"),
            "node": F.when(down, F.col("at_node") * FAN + F.col("s.at")).otherwise(F.col("node")),
            "found": F.when(down, level).otherwise(F.col("found")),
        }).drop("children", "s", "at_node")
    rows = rows.withColumn("at_node", F.when(F.col("found") == 0, F.floor(F.col("node") / FAN).cast("int")).otherwise(spread))
    rows = rows.join(levels[0].withColumnRenamed("node", "at_node"), ["symbol", "at_node"], "left")
    bar = F.get("children", F.col("node") % FAN)
    gain = sdiv(bar["lo"], F.col("entry_price")) - 1.0
    rule = (
        F.when(gain <= -stop, "stop_loss").when(sdiv(bar["lo"], F.greatest("peak", bar["lo"])) - 1.0 <= -trail, "trailing_stop")
        .when(gain >= take, "take_profit").when(bar["risk"], "risk")
    )
    exits = rows.select(*[F.col(c).alias(f"{c}_") for c in own], bar["day"].alias("exit_date"), rule.alias("rule"), bar["lo"].alias("exit_price"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in own]
    return entries.join(exits, same[0] & same[1] & same[2], "left").drop(*[f"{c}_" for c in own])


def order_flags(orders: DataFrame, bars: DataFrame, band: float = 0.1, share: float = 0.25) -> DataFrame:
    """Is the price inside the day's band and the quantity inside the day's liquidity?"""
    j = orders.join(bars, ["symbol", "trade_date"], "left")
    inside = F.col("price").between(F.col("close") * (1 - band), F.col("close") * (1 + band))
    liquid = F.col("quantity") <= share * F.col("volume")
    return j.select(
        "symbol", "trade_date", "seq", "quantity",
        F.coalesce(inside, F.lit(False)).alias("price_ok"),
        F.coalesce(liquid, F.lit(False)).alias("liquid_ok"),
    )


def trade_rollup(realised: DataFrame) -> DataFrame:
    wins = F.count_if(F.col("realised") > 0)
    return realised.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"), wins.alias("wins"), F.avg("realised").alias("mean_pnl"),
        sdiv(wins.cast("double"), F.count(F.lit(1)).cast("double")).alias("win_rate"),
    )
