"""User code surfaces: a factor, a model scorer, a signal function, an operator registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions import expr
from quantspark.functions.expr import Node

REQUIRED = ("symbol", "trade_date", "value")


def run_python_factor(panel: DataFrame, compute: Callable[[pd.DataFrame, dict], pd.DataFrame], start, end,
                      context: dict | None = None) -> DataFrame:
    """``compute(bars, context)`` per symbol; a symbol has one bar per day, which bounds a group.

    Rows outside the date range or without a finite value are dropped.
    """
    context = dict(context or {})
    kind = panel.schema["symbol"].dataType.simpleString()

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        out = compute(bars.sort_values("trade_date").reset_index(drop=True), context)
        missing = [c for c in REQUIRED if c not in out.columns]
        if missing:
            raise ValueError(f"the factor must return {REQUIRED}, missing {missing}")
        return out[list(REQUIRED)].astype({"value": "float64"})

    rows = panel.groupBy("symbol").applyInPandas(run, f"symbol {kind}, trade_date date, value double")
    value = F.col("value")
    return rows.where(
        F.col("trade_date").between(start, end) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    )


def score_sections(frame: DataFrame, score: Callable[[pd.DataFrame], pd.Series], of_date: dict[str, Column] | None = None) -> DataFrame:
    """A scorer that needs figures of the whole date: ``of_date`` names aggregates over it.

    They are summed per date first and reach the scorer as columns, so it runs on Arrow batches
    and a date may have any number of rows.
    """
    if of_date:
        per_date = frame.groupBy("trade_date").agg(*[c.alias(n) for n, c in of_date.items()])
        frame = frame.join(F.broadcast(per_date), "trade_date")  # one row per trading day
    return score_rows(frame, score)


def score_rows(frame: DataFrame, score: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """A scorer that looks at single rows, run on Arrow batches without any shuffle."""
    kind = frame.schema["symbol"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = pd.Series(score(b), index=b.index, dtype="float64")
            yield pd.DataFrame({"symbol": b["symbol"], "trade_date": b["trade_date"], "score": values})

    return frame.mapInPandas(run, f"symbol {kind}, trade_date date, score double")


def run_signal(panel: DataFrame, signal: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """``signal(history)`` per symbol: -1, 0 or 1 for every bar."""
    kind = panel.schema["symbol"].dataType.simpleString()

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("trade_date").reset_index(drop=True)
        return pd.DataFrame({"symbol": bars["symbol"], "trade_date": bars["trade_date"],
                             "signal": pd.Series(signal(bars)).clip(-1, 1).astype("int32")})

    return panel.groupBy("symbol").applyInPandas(run, f"symbol {kind}, trade_date date, signal int")


class OperatorRegistry:
    """Named expression builders with a level and a category."""

    def __init__(self):
        self._ops: dict[str, tuple[Callable[..., Node], str, str]] = {}

    def register(self, name: str, build: Callable[..., Node], level: str, category: str) -> None:
        if name in self._ops:
            raise ValueError(f"operator {name} is already registered")
        self._ops[name] = (build, level, category)

    def get(self, name: str) -> Callable[..., Node]:
        return self._ops[name][0]

    def by_level(self, level: str) -> list[str]:
        return sorted(n for n, (_, lv, _) in self._ops.items() if lv == level)

    def by_category(self, category: str) -> list[str]:
        return sorted(n for n, (_, _, c) in self._ops.items() if c == category)

    def catalogue(self, spark) -> DataFrame:
        rows = [(n, lv, c) for n, (_, lv, c) in sorted(self._ops.items())]
        return spark.createDataFrame(rows, "name string, level string, category string")


def default_registry() -> OperatorRegistry:
    reg = OperatorRegistry()
    for name in ("delay", "delta", "mean", "stdev", "rmax", "rmin", "total", "corr", "cov", "slope", "ts_rank", "argmax", "ema"):
        reg.register(name, getattr(expr, name), "L1", "time_series")
    for name in ("rank", "zscore", "zscore_pop", "winsorize", "scale", "demean", "residual", "bucket"):
        reg.register(name, getattr(expr, name), "L2", "cross_section")
    from quantspark.factors import technical

    for name in ("sma", "rsi", "macd", "bbands", "atr", "stoch_k", "stoch_d", "cci", "willr", "obv", "mfi", "adx", "aroon_osc"):
        reg.register(name, getattr(technical, name), "L3", "technical")
    return reg
