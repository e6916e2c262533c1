"""Per-symbol window operators.

A bar panel holds one row per (symbol, bar), so a symbol's window partition is bounded
by the trading calendar however large the universe or the raw tick table becomes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quantspark.operators.rowwise import sdiv

#: two values closer than this count as tied, so float noise never decides a rank
TIE_DIGITS = 10


def rolling(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def at_least(x: Column, spec: WindowSpec, need: int, value: Column) -> Column:
    """``value`` where the window holds at least ``need`` present values."""
    return F.when(F.count(x).over(spec) >= need, value)


def _agg(fn):
    def op(w, x, n, need):
        spec = rolling(w, n)
        return at_least(x, spec, need, fn(x).over(spec))

    return op


def paired(a: Column, b: Column) -> tuple[Column, Column]:
    """Both inputs NULL unless both are present."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def corr(w, a, b, n, need):
    """Pearson correlation that is NULL, not an ANSI error, on a constant window."""
    a, b = paired(a, b)
    spec = rolling(w, n)
    spread = F.stddev_pop(a).over(spec) * F.stddev_pop(b).over(spec)
    return at_least(a, spec, need, F.round(sdiv(F.covar_pop(a, b).over(spec), spread), 10))


def cov(w, a, b, n, need):
    a, b = paired(a, b)
    spec = rolling(w, n)
    return at_least(a, spec, need, F.round(F.covar_samp(a, b).over(spec), 10))


def slope(w, x, n, need):
    spec = rolling(w, n)
    return at_least(x, spec, need, F.regr_slope(x, F.col("bar_no_").cast("double")).over(spec))


def _values(x: Column, spec: WindowSpec) -> Column:
    """Window values as an array that keeps NULLs; bounded by the window length."""
    return F.transform(F.collect_list(F.struct(x.alias("v"))).over(spec), lambda s: s["v"])


def ts_rank(w, x, n, need):
    """Average-tie percentile rank of the latest value inside its window.

    The list leaves NULLs out, so a present latest value is its last element; inside the lambda an
    expression would be computed once for every element.
    """
    spec = rolling(w, n)
    x = F.round(x, TIE_DIGITS)

    def position(values: Column) -> Column:
        """Twice the values below the last one, plus its ties."""
        last = F.try_element_at(values, F.lit(-1))
        step = lambda acc, v: acc + F.when(v < last, 2).when(v == last, 1).otherwise(0)
        return F.aggregate(values, F.lit(0), step)

    at = F.transform(F.array(F.collect_list(x).over(spec)), position)[0]
    count = F.count(x).over(spec)
    return F.when(x.isNotNull() & (count >= need), (at + 1) / 2.0 / count)


def _arg(pick):
    def op(w, x, n, need):
        spec = rolling(w, n)
        x = F.round(x, TIE_DIGITS)
        at = F.array_position(_values(x, spec), pick(x).over(spec))
        return at_least(x, spec, need, at.cast("double"))

    return op


def mean_abs_dev(w, x, n, need):
    spec = rolling(w, n)
    center = F.avg(x).over(spec)
    total = F.aggregate(
        F.collect_list(x).over(spec), F.lit(0.0), lambda acc, v: acc + F.abs(v - center)
    )
    return at_least(x, spec, need, sdiv(total, F.count(x).over(spec)))


def decay_linear(w, x, n):
    """Weights 1..n, the newest heaviest; NULL unless the window is full."""
    total = F.lit(0.0)
    for i in range(n):
        total = total + F.lag(x, i).over(w) * float(n - i)
    return F.round(total / (n * (n + 1) / 2.0), TIE_DIGITS)


def block_running_sum(symbol: str, date: str, y: Column, block: Column) -> Column:
    w = Window.partitionBy(symbol, block).orderBy(date)
    return F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0))


def back_fill(symbol: str, date: str, x: Column) -> Column:
    """The next present value: the bars backwards, so that the frame only grows."""
    w = Window.partitionBy(symbol).orderBy(F.desc(date))
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def previous_block_sum(symbol: str, date: str, y: Column, block: Column, run: Column | None = None) -> Column:
    """``run``, the running sum of the same values, is present where they are; it only puts this window behind that one,
    whose order of the rows serves both."""
    y = y if run is None else F.when(run.isNotNull(), y)
    return F.sum(y).over(Window.partitionBy(symbol).orderBy(block).rangeBetween(-1, -1))


#: what the two parts of a wide window carry; the last two become sums about the means
PARTS = {"sum": F.sum, "count": F.count, "mean": F.avg, "min": F.min, "max": F.max, "square": F.var_pop, "cross": F.covar_pop}


def _part(name: str, from_start: bool):
    """Over the bars of a block up to the current one, or from it on; both frames only ever grow."""

    def op(symbol: str, date: str, *args: Column) -> Column:
        *xs, block = args
        w = Window.partitionBy(symbol, block).orderBy(F.asc(date) if from_start else F.desc(date))
        spec = w.rowsBetween(Window.unboundedPreceding, 0)
        value = PARTS[name](*xs).over(spec)
        if name in ("square", "cross"):
            value = value * F.count(xs[0]).over(spec)
        return value.cast("double")

    return op


#: window operators with a partitioning of their own
BLOCK = {
    "block_running_sum": block_running_sum, "previous_block_sum": previous_block_sum, "bfill": back_fill,
    **{f"block_start_{n}": _part(n, True) for n in PARTS}, **{f"block_end_{n}": _part(n, False) for n in PARTS},
}


def _running(fn):
    def op(w, x):
        return fn(x).over(w.rowsBetween(Window.unboundedPreceding, 0))

    return op


def prior_max(w, x, n, need):
    spec = w.rowsBetween(-n, -1)
    return at_least(x, spec, need, F.max(x).over(spec))


TS = {
    "delay": lambda w, x, n: F.lag(x, n).over(w),
    "lead": lambda w, x, n: F.lead(x, n).over(w),
    "mean": _agg(F.avg),
    "sum": _agg(F.sum),
    "std": _agg(F.stddev_samp),
    "stdp": _agg(F.stddev_pop),
    "var": _agg(F.var_samp),
    "max": _agg(F.max),
    "min": _agg(F.min),
    "product": _agg(F.product),
    "count": lambda w, x, n, need: F.count(x).over(rolling(w, n)).cast("double"),
    "corr": corr,
    "cov": cov,
    "slope": slope,
    "ts_rank": ts_rank,
    "argmax": _arg(F.max),
    "argmin": _arg(F.min),
    "mad": mean_abs_dev,
    "decay": decay_linear,
    "seen": lambda w, x: F.count(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"),
    "cumsum": _running(F.sum),
    "cummax": _running(F.max),
    "ffill": _running(lambda x: F.last(x, ignorenulls=True)),
    "first_of_all": lambda w, x: F.first(x, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ),
    "first": _running(lambda x: F.first(x, ignorenulls=True)),
    "bar_index": lambda w: F.row_number().over(w).cast("double"),
    "bars_total": lambda w: F.count(F.lit(1))
    .over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    .cast("double"),
    "prior_max": prior_max,
    "kept": lambda w, x: x,
}
