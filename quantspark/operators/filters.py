"""Predicates, screening, search and top-k over tables."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.sources.scan import CATALOG

COMPARE = {
    "=": operator.eq, "==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge,
    "<": operator.lt, "<=": operator.le,
}


def build_filter(rule: Mapping, columns: Sequence[str]) -> Column | None:
    """Column condition of one rule; an empty value means no filter."""
    name, op, value = rule["column"], rule.get("op", "="), rule.get("value")
    if name not in columns:
        raise ValueError(f"unknown column {name}")
    col = F.col(name)
    if op == "is null":
        return col.isNull()
    if op == "not null":
        return col.isNotNull()
    if value is None or value == "" or value == []:
        return None
    if op == "contains":
        return col.cast("string").contains(str(value))
    if op == "in":
        return col.isin(list(value))
    if op == "between":
        low, high = value
        return col.between(low, high)
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op}")
    return COMPARE[op](col, value)


def apply_filters(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    for rule in rules:
        cond = build_filter(rule, df.columns)
        if cond is not None:
            df = df.where(cond)
    return df


#: quick-search keys that are matched by equality
EQUALITY_KEYS = ("factor_name", "indicator_name", "as_of_time", "source")


def quick_filters(dataset: str, search: Mapping, columns: Sequence[str]) -> list[dict]:
    """Rules for a quick search: symbols (comma list, full-width comma too), dates, names."""
    rules: list[dict] = []
    _, _, day, symbol = CATALOG[dataset]
    if search.get("symbols"):
        parts = str(search["symbols"]).replace("，", ",").split(",")
        wanted = [p.strip() for p in parts if p.strip()]
        if wanted:
            rules.append({"column": symbol, "op": "in", "value": wanted})
    if search.get("start"):
        rules.append({"column": day, "op": ">=", "value": search["start"]})
    if search.get("end"):
        rules.append({"column": day, "op": "<=", "value": search["end"]})
    rules += [
        {"column": k, "op": "=", "value": search[k]}
        for k in EQUALITY_KEYS if search.get(k) and k in columns
    ]
    return rules


def search_table(df, rules=(), columns=None, order=(), page=1, size=50) -> DataFrame:
    """Filtered, projected, ordered page of a table."""
    out = apply_filters(df, rules)
    if order:
        out = out.orderBy(*order)
    out = out.offset((page - 1) * size).limit(size)
    return out.select(*columns) if columns else out


def preview(df: DataFrame, page=1, size=50, order=(), rules=(), include_total=False) -> tuple[DataFrame, DataFrame]:
    """(rows, total): ``total`` is one row, estimated from the page unless asked for exactly."""
    rows = search_table(df, rules, None, order, page, size)
    shown = F.count(F.lit(1))
    if include_total:
        return rows, apply_filters(df, rules).agg(shown.alias("total"))
    more = F.when(shown == size, 1).otherwise(0)
    return rows, rows.agg((shown + more + (page - 1) * size).alias("total"))


def first(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows of an ordered result; all of them without a limit."""
    return df if limit is None else df.limit(limit)


def distinct_values(df, column: str, contains: str = "", limit: int | None = None) -> DataFrame:
    values = df.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    if contains:
        values = values.where(F.col("value").cast("string").contains(contains))
    return first(values.orderBy("value"), limit)


def read_only_sql(spark, sql: str, limit: int | None = None) -> DataFrame:
    """A single SELECT/WITH statement; ``limit`` is the explorer's page."""
    words = sql.strip().rstrip(";").strip()
    if words.split(None, 1)[0].lower() not in ("select", "with") or ";" in words:
        raise ValueError("only one SELECT statement is allowed")
    return first(spark.sql(words), limit)


def screen_fundamentals(df, *, industries=None, exclude_st=False, min_mv=None, max_mv=None,
                        min_pe=None, max_pe=None, min_roe=None, limit=None):
    """(top rows by market value, total); ``max_pe`` keeps rows without a PE."""
    if industries:
        df = df.where(F.col("industry").isin(list(industries)))
    if exclude_st:
        df = df.where(F.col("is_st") == 0)
    if min_mv is not None:
        df = df.where(F.col("total_mv") >= min_mv)
    if max_mv is not None:
        df = df.where(F.col("total_mv") <= max_mv)
    if min_pe is not None:
        df = df.where(F.col("pe_ttm") >= min_pe)
    if max_pe is not None:
        df = df.where(F.col("pe_ttm").isNull() | (F.col("pe_ttm") <= max_pe))
    if min_roe is not None:
        df = df.where(F.col("roe") >= min_roe)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return first(df.orderBy(F.desc_nulls_last("total_mv"), "symbol"), limit), total


def widen(store: DataFrame, names: Sequence[str], keys=("symbol", "trade_date")) -> DataFrame:
    """EAV rows to one column per name; ``names`` fixes the columns, so no extra pass."""
    return store.groupBy(*keys).pivot("factor_name", list(names)).agg(F.max("value"))


def screen_indicators(store, filters: Sequence[Mapping], day, sort_by, ascending=False, limit=None):
    names = sorted({f["name"] for f in filters} | {sort_by})
    wide = widen(store.where(F.col("trade_date") == day), names, ("symbol",))
    rules = [{"column": f["name"], "op": f["op"], "value": f["value"]} for f in filters]
    order = F.asc_nulls_last(sort_by) if ascending else F.desc_nulls_last(sort_by)
    return first(apply_filters(wide, rules).orderBy(order, "symbol"), limit)


def search_stocks(df, search=None, industry=None, is_st=None, watchlist=None, page=1, size=20):
    if search:
        text = f"%{search}%"
        df = df.where(F.col("symbol").cast("string").like(text) | F.col("name").like(text))
    if industry:
        df = df.where(F.col("industry") == industry)
    if is_st is not None:
        df = df.where(F.col("is_st") == is_st)
    if watchlist is not None:
        df = df.join(watchlist.select("symbol"), "symbol", "left_semi")
    return df.orderBy("symbol").offset((page - 1) * size).limit(size)


def theme_filter(df, include, exclude, minimum=10, strict=False, columns=("industry", "sector")):
    """Drop excluded themes; keep included ones when enough remain (always when strict)."""
    text = F.lower(F.concat_ws(" ", *columns))

    def any_of(terms):
        cond = F.lit(False)
        for term in terms:
            cond = cond | text.contains(term.lower())
        return cond

    kept = df.where(~any_of(exclude)) if exclude else df
    if not include:
        return kept
    matched = kept.where(any_of(include))
    if strict:
        return matched
    enough = matched.agg((F.count(F.lit(1)) >= minimum).alias("enough")).scalar()
    return kept.where(any_of(include) | ~enough)


def extreme_n(df, value: str, n=20, ascending=False) -> DataFrame:
    """Top (or bottom) N of the newest date that has any value."""
    present = df.where(F.col(value).isNotNull())
    last = present.agg(F.max("trade_date")).scalar()
    order = F.asc(value) if ascending else F.desc(value)
    return present.where(F.col("trade_date") == last).orderBy(order, "symbol").limit(n)


def smallest_caps(caps: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """(trade_date, symbol): the N smallest latest-known caps per calendar day."""
    from quantspark.operators.joins import asof_join, each_day

    known = caps.select("symbol", F.col("trade_date").alias("cap_date"), "total_mv")
    # before its first cap a symbol has none
    firsts = caps.groupBy("symbol").agg(F.min("trade_date").alias("first_"))
    grid = each_day(firsts, days, F.col("first_")).select("symbol", "trade_date")
    latest = asof_join(grid, known, "trade_date", "cap_date", ["total_mv"])
    # Spark keeps n rows per date in every task before it shuffles
    w = Window.partitionBy("trade_date").orderBy("total_mv", "symbol")
    ranked = latest.where("total_mv is not null").withColumn("rn", F.row_number().over(w))
    return ranked.where(F.col("rn") <= n).select("trade_date", "symbol")


def universe_as_of(stocks, as_of, start=None, exchanges=None, include_delisted=False) -> DataFrame:
    """Symbols listed by ``as_of``; delisted ones stay when they traded after ``start``."""
    df = stocks.where(F.col("list_date").isNull() | (F.col("list_date") <= as_of))
    alive = F.col("delist_date").isNull() | (F.col("delist_date") > as_of)
    if include_delisted:
        alive = alive | (F.col("delist_date") >= (start or as_of))
    df = df.where(alive)
    if exchanges:
        df = df.where(F.col("exchange").isin(list(exchanges)))
    return df.select("symbol")


def special_treatment(stocks, changes, days, marker="ST") -> DataFrame:
    """(trade_date, symbol) flagged on a date: a marked name in force, a static flag, the
    marker in the current name, or a delisting date already reached."""
    return special_days(stocks, changes, days, marker).distinct()


def special_days(stocks, changes, days, marker="ST") -> DataFrame:
    """The rows of ``special_treatment``, once for each reason."""
    from quantspark.operators.joins import each_day

    marked = changes.where(F.col("name").contains(marker))
    named = each_day(marked, days, F.col("start_date"), F.col("end_date")).select("trade_date", "symbol")
    static = stocks.where((F.col("is_st") > 0) | F.col("name").contains(marker))
    flagged = each_day(static.select("symbol"), days).select("trade_date", "symbol")
    gone = each_day(stocks, days, F.col("delist_date")).select("trade_date", "symbol")
    return named.unionByName(flagged).unionByName(gone)


def percent_to_ratio(x: Column) -> Column:
    """Percent figures (beyond 1.5 in size) become ratios."""
    return F.when(F.abs(x) > 1.5, x / 100.0).otherwise(x)


def matches(value: Column, op: str, threshold) -> Column:
    return COMPARE[op](value, F.lit(threshold))


def exclude_by_factor(universe: DataFrame, store: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Rows of ``universe`` (symbol, trade_date) that no exclusion rule hits."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | ((F.col("factor_name") == r["name"]) & matches(F.col("value"), r["op"], r["value"]))
    banned = store.where(hit).select("symbol", "trade_date")
    return universe.join(banned, ["symbol", "trade_date"], "left_anti")
