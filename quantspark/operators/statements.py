"""Financial statements: de-cumulation, year-on-year growth and availability dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.operators.cross_section import quantile_table
from quantspark.operators.joins import asof_join, newest
from quantspark.operators.rowwise import sdiv

#: days after the report date when a report without announcement date counts as known
FALLBACK_DAYS = {3: 30, 6: 60, 9: 30, 12: 120}
FALLBACK_DEFAULT = 120
DERIVED = [
    "quarter_revenue_yoy", "quarter_profit_yoy", "revenue_accel", "profit_accel", "roe_yoy_change",
    "equity_to_assets", "debt_ratio", "net_margin", "asset_turnover",
]
REPORTED = [
    "roe", "revenue", "net_profit", "revenue_yoy", "profit_yoy", "gross_margin",
    "total_assets", "total_liability", "total_equity",
]
#: present values that a column needs for its bounds
LEAST_VALUES = 10


def available_date(report: Column, announced: Column) -> Column:
    month = F.month(report)
    days = F.lit(FALLBACK_DEFAULT)
    for m, d in FALLBACK_DAYS.items():
        days = F.when(month == m, d).otherwise(days)
    return F.coalesce(announced, F.date_add(report, days))


def clip_bounds(df: DataFrame, columns, low=0.01, high=0.99) -> DataFrame:
    """One row with the lower and upper bound of every column (NULL below ten values).

    All columns are ranked at once, by counts of equal values, so no buffer holds a whole column.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_", "value_")
    long = long.where("value_ is not null")
    enough = long.groupBy("column_").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= LEAST_VALUES)
    bounds = quantile_table(long, ["column_"], F.col("value_"), {"lo": low, "hi": high}).join(F.broadcast(enough), "column_")  # a row for each column
    return bounds.agg(*[F.max(F.when(F.col("column_") == c, F.col(side))).alias(f"{c}_{side}") for c in columns for side in ("lo", "hi")])


def quarterly(statements: DataFrame, *, clip: bool = True) -> DataFrame:
    """Per-quarter growth and ratios from cumulative year-to-date statements."""
    f = statements.withColumn("fiscal_year", F.year("report_date")).withColumn(
        "period_id", F.year("report_date") * 4 + F.quarter("report_date")
    )
    year = Window.partitionBy("symbol", "fiscal_year").orderBy("period_id", "ann_date", "report_date")
    first = F.quarter("report_date") == 1
    for source, out in (("revenue", "quarter_revenue"), ("net_profit", "quarter_profit")):
        f = f.withColumn(
            out, F.when(first, F.col(source)).otherwise(F.col(source) - F.lag(source).over(year))
        )
    last_year = f.select(
        "symbol",
        (F.col("period_id") + 4).alias("period_id"),
        F.col("quarter_revenue").alias("quarter_revenue_lag4"),
        F.col("quarter_profit").alias("quarter_profit_lag4"),
        F.col("roe").alias("roe_lag4"),
    )
    f = f.join(last_year, ["symbol", "period_id"], "left")
    life = Window.partitionBy("symbol").orderBy("period_id", "ann_date", "report_date")

    def growth(now: str, before: str) -> Column:
        return sdiv(F.col(now) - F.col(before), F.abs(before))

    f = f.withColumns(
        {
            "quarter_revenue_yoy": growth("quarter_revenue", "quarter_revenue_lag4"),
            "quarter_profit_yoy": growth("quarter_profit", "quarter_profit_lag4"),
        }
    ).withColumns(
        {
            "revenue_accel": F.col("quarter_revenue_yoy") - F.lag("quarter_revenue_yoy").over(life),
            "profit_accel": F.col("quarter_profit_yoy") - F.lag("quarter_profit_yoy").over(life),
            "roe_yoy_change": F.col("roe") - F.col("roe_lag4"),
            "equity_to_assets": sdiv(F.col("total_equity"), F.col("total_assets")),
            "debt_ratio": sdiv(F.col("total_liability"), F.col("total_assets")),
            "net_margin": sdiv(F.col("net_profit"), F.col("revenue")),
            "asset_turnover": sdiv(F.col("revenue"), F.col("total_assets")),
            "available_date": available_date(F.col("report_date"), F.col("ann_date")),
        }
    )
    if clip:
        # whole-sample bounds are the definition; ``clip=False`` is the point-in-time form
        bounds = clip_bounds(f, DERIVED)
        f = f.join(F.broadcast(bounds))  # bounds is a single row by construction
        f = f.withColumns(
            {
                c: F.when(F.col(f"{c}_lo").isNull(), F.col(c)).otherwise(
                    F.when(F.col(c).isNotNull(),
                           F.least(F.greatest(c, f"{c}_lo"), F.col(f"{c}_hi")))
                )
                for c in DERIVED
            }
        ).drop(*[f"{c}_{s}" for c in DERIVED for s in ("lo", "hi")])
    return f


def align_statements(bars: DataFrame, quarters: DataFrame, columns=None) -> DataFrame:
    """Latest statement known on each bar's date (announcement date, else fallback lag)."""
    cols = list(columns or REPORTED + DERIVED)
    known = newest(
        quarters.select("symbol", "available_date", "report_date", *cols),
        ["symbol", "available_date"], F.col("report_date"),
    )
    return asof_join(bars, known, "trade_date", "available_date", ["report_date", *cols])


def align_by_report_date(bars: DataFrame, statements: DataFrame, columns) -> DataFrame:
    """As-of join on the report date itself: leaks unpublished figures, kept as a mode."""
    known = newest(
        statements.select("symbol", "report_date", "ann_date", *columns),
        ["symbol", "report_date"], F.coalesce("ann_date", F.lit("1900-01-01").cast("date")),
    ).drop("ann_date")
    return asof_join(bars, known, "trade_date", "report_date", list(columns))
