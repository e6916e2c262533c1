"""Bar panels and side tables derived from the given tables.

Every panel starts from a partially aggregated ``groupBy``; raw rows of one hot key are
combined map-side before they are shuffled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quantspark.factors.alpha101 import alpha_input
from quantspark.operators.cross_section import section_position
from quantspark.operators.joins import attach_filled, attach_metadata, attach_optional
from quantspark.operators.panel import bounds, sizes
from quantspark.operators.statements import align_by_report_date, align_statements, quarterly
from quantspark.session import DEFAULT_MAX_GROUP_ROWS, MAX_GROUP_ROWS, int_conf, written


def digits_plus_one(props: str = "props"):
    return F.regexp_extract(props, "([0-9]+)", 1).cast("double") + 1.0


class Tables:
    """Lazy DataFrames over one data folder; nothing is read until an action runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def with_written(self, name: str) -> Tables:
        """The same tables with ``name`` written once, for a query that reads it many times."""
        other = Tables(self.spark, self.root)
        other.__dict__[name] = written(getattr(self, name))
        return other

    # -- bars ------------------------------------------------------------------

    @cached_property
    def panel_d(self) -> DataFrame:
        """Daily bars per user: dense cross-section."""
        e = self.raw("events").select(
            F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"), "ts", "value",
            digits_plus_one().alias("q"),
        )
        return e.groupBy("symbol", "trade_date").agg(
            F.min_by("value", "ts").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "ts").alias("close"),
            F.sum("q").alias("volume"),
            F.sum(F.col("value") * F.col("q")).alias("amount"),
        )

    @cached_property
    def panel_l(self) -> DataFrame:
        """Daily bars per supplier: long history."""
        seq = F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey")
        li = self.raw("lineitem").select(
            F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), seq.alias("seq"),
            "l_quantity", "l_extendedprice",
        )
        return li.groupBy("symbol", "trade_date").agg(
            F.min_by("px", "seq").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "seq").alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )

    @cached_property
    def panel_m(self) -> DataFrame:
        """Monthly bars per supplier."""
        li = self.raw("lineitem").select(
            F.col("l_suppkey").alias("symbol"),
            F.trunc(F.to_date("l_shipdate"), "month").alias("trade_date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            "l_quantity", "l_extendedprice",
        )
        return li.groupBy("symbol", "trade_date").agg(
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_type").alias("symbol"),
            F.col("ts").alias("datetime"),
            F.to_date("ts").alias("trade_date"),
            "event_id",
            (F.hour("ts") * 60 + F.minute("ts")).alias("minute_of_day"),
            F.col("value").alias("price"),
            digits_plus_one().alias("volume"),
        )

    @cached_property
    def bars_m(self) -> DataFrame:
        """Minute bars: at most 1,440 rows per symbol-day whatever the tick count."""
        return self.ticks.groupBy("symbol", "trade_date", "minute_of_day").agg(
            F.min_by("price", F.struct("datetime", "event_id")).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", F.struct("datetime", "event_id")).alias("close"),
            F.sum("volume").alias("volume"),
            F.sum(F.col("price") * F.col("volume")).alias("amount"),
        )

    # -- side tables -----------------------------------------------------------

    @cached_property
    def dim_d(self) -> DataFrame:
        places = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return self.raw("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            (F.col("c_custkey") - 1).alias("symbol"),
            F.col("c_mktsegment").alias("industry"),
            F.col("n_name").alias("industry2"),
            F.col("r_name").alias("sector"),
            (F.abs("c_acctbal") + 1.0).alias("shares"),
            F.when(F.col("c_custkey") % 17 == 0, 1).otherwise(0).alias("is_st"),
        )

    @cached_property
    def dim_l(self) -> DataFrame:
        places = self.raw("nation").join(
            self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return self.raw("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("symbol"),
            F.col("n_name").alias("industry"),
            F.col("r_name").alias("sector"),
            F.col("s_name").alias("name"),
            (F.abs("s_acctbal") + 1.0).alias("shares"),
        )

    @cached_property
    def fin(self) -> DataFrame:
        """Cumulative year-to-date statements per supplier-quarter."""
        price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        quarter_end = F.date_sub(F.add_months(F.trunc(F.to_date("l_shipdate"), "quarter"), 3), 1)
        q = (
            self.raw("lineitem")
            .select(F.col("l_suppkey").alias("symbol"), quarter_end.alias("report_date"),
                    (price * (1 - disc)).alias("rev"),
                    (price * (0.3 - disc - tax)).alias("np"),
                    (price * tax).alias("tax"))
            .groupBy("symbol", "report_date")
            .agg(F.sum("rev").alias("rev"), F.sum("np").alias("np"), F.sum("tax").alias("tax"))
        )
        year = Window.partitionBy("symbol", F.year("report_date")).orderBy("report_date")
        life = Window.partitionBy("symbol").orderBy("report_date")
        skip = (F.col("symbol") + F.month("report_date") / 3) % 5 == 0
        return q.select(
            "symbol",
            "report_date",
            F.when(~skip, F.date_add("report_date", 25)).alias("ann_date"),
            F.sum("rev").over(year).alias("revenue"),
            F.sum("np").over(year).alias("net_profit"),
            (F.lit(1000000.0) + F.sum("rev").over(life)).alias("total_assets"),
            (F.lit(400000.0) + 0.5 * F.sum("tax").over(life)).alias("total_liability"),
        )

    @cached_property
    def fin_full(self) -> DataFrame:
        """Statements with the ratios the reports carry."""
        equity = F.col("total_assets") - F.col("total_liability")
        w = Window.partitionBy("symbol", F.quarter("report_date")).orderBy("report_date")
        return self.fin.select(
            "*",
            (F.col("revenue") / F.lag("revenue").over(w) - 1.0).alias("revenue_yoy"),
            ((F.col("net_profit") - F.lag("net_profit").over(w)) / F.abs(F.lag("net_profit").over(w))).alias("profit_yoy"),
            equity.alias("total_equity"),
            (F.col("net_profit") / equity).alias("roe"),
            (100.0 * F.col("net_profit") / F.col("revenue")).alias("gross_margin"),
        )

    @cached_property
    def basic(self) -> DataFrame:
        """Monthly fundamentals: capitalisation and price ratios."""
        mv = F.col("close") * F.col("shares")
        return self.panel_m.join(self.dim_l, "symbol").select(
            "symbol",
            "trade_date",
            mv.alias("total_mv"),
            F.when(F.month("trade_date") % 4 != 0, mv * 0.6).alias("circ_mv"),
            (F.col("volume") / F.col("shares")).alias("turnover_rate"),
            F.when(F.col("symbol") % 7 != 0, mv / F.col("amount")).alias("pe_ttm"),
            (F.col("close") / (100.0 + F.col("symbol") % 13)).alias("pb"),
        )

    @cached_property
    def basic_d(self) -> DataFrame:
        """Fundamentals for the dense panel, present on odd days only."""
        mv = F.col("close") * F.col("shares")
        return (
            self.panel_d.join(self.dim_d, "symbol")
            .where(F.dayofmonth("trade_date") % 2 == 1)
            .select(
                "symbol",
                "trade_date",
                mv.alias("total_mv"),
                F.when(F.dayofmonth("trade_date") % 3 != 0, mv * 0.6).alias("circ_mv"),
                (F.col("volume") / F.col("shares")).alias("turnover_rate"),
                F.when(F.col("symbol") % 7 != 0, F.try_divide(mv, F.nullif(F.col("amount"), F.lit(0.0)))).alias("pe_ttm"),
                (F.col("close") / (10.0 + F.col("symbol") % 13)).alias("pb"),
            )
        )

    @cached_property
    def limits_l(self) -> DataFrame:
        """Daily price limits; two thirds of the symbols have them."""
        w = Window.partitionBy("symbol").orderBy("trade_date")
        prev = F.lag("close").over(w)
        return self.panel_l.where("symbol % 3 <> 0").select(
            "symbol", "trade_date", (prev * 1.1).alias("up_limit"), (prev * 0.9).alias("down_limit")
        )

    @cached_property
    def alpha_d(self) -> DataFrame:
        return alpha_input(self.panel_d, self.basic_d, self.dim_d)

    @cached_property
    def alpha_l(self) -> DataFrame:
        return alpha_input(self.panel_l, self.basic, self.dim_l)

    @cached_property
    def fin_q(self) -> DataFrame:
        return quarterly(self.fin_full)

    @cached_property
    def paper_l(self) -> DataFrame:
        """Daily bars with fundamentals, limits, industry and the statements known that day."""
        bars = attach_filled(
            self.panel_l, self.basic, ["total_mv", "circ_mv", "pe_ttm", "pb", "turnover_rate"]
        )
        bars = attach_optional(bars, self.limits_l, ["up_limit", "down_limit"])
        bars = attach_metadata(bars, self.dim_l, ["industry"]).withColumn(
            "has_industry", F.when(F.col("industry") != "", 1.0).otherwise(0.0)
        )
        return align_statements(bars, self.fin_q)

    @cached_property
    def research_l(self) -> DataFrame:
        return align_by_report_date(
            self.panel_l, self.fin_full,
            ["revenue", "net_profit", "gross_margin", "total_assets", "total_liability"],
        )

    @cached_property
    def idx(self) -> DataFrame:
        """Monthly index membership: the top 60 % of symbols by volume."""
        bars = self.panel_m.select("symbol", "trade_date", "volume")
        wide = self.section_rows_l > int_conf(self.spark, MAX_GROUP_ROWS, DEFAULT_MAX_GROUP_ROWS)
        placed = section_position(bars, ["trade_date"], "volume", "symbol", "rn", descending=True, wide=wide)
        totals = bars.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.sum("volume").alias("all_"))
        # one row per month
        return (
            placed.join(F.broadcast(totals), "trade_date")
            .where(F.col("rn") <= 0.6 * F.col("n"))
            .select(F.lit("IDX").alias("index_symbol"), "trade_date", "symbol", (F.col("volume") / F.col("all_")).alias("weight"))
        )

    @cached_property
    def ledger(self) -> DataFrame:
        return self.raw("lineitem").select(
            (F.col("l_partkey") % 50).alias("symbol"),
            (F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"),
            F.to_date("l_shipdate").alias("trade_date"),
            F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.when(F.col("l_linestatus") == "O", "pending").otherwise("filled").alias("status"),
            F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_extendedprice").alias("order_value"),
        )

    @cached_property
    def posts(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id", "source", "lang", "text",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published_at"),
            (F.col("n_chars") % 50).alias("reply_count"),
            (F.col("n_chars") % 7).alias("like_count"),
        )

    @cached_property
    def store(self) -> DataFrame:
        """Factor values with superseded versions; the newest version wins."""
        d = self.panel_d

        def rows(df, name, value, version):
            return df.select(
                "symbol", "trade_date", F.lit("").alias("as_of_time"),
                F.lit(name).alias("factor_name"), F.lit("h0").alias("params_hash"),
                value.alias("value"), F.lit(version).alias("version"),
            )

        return (
            rows(d, "close_level", F.col("close"), 1)
            .unionAll(rows(d.where("symbol % 2 = 0"), "close_level", F.col("close") * 2, 2))
            .unionAll(rows(d, "volume_level", F.col("volume"), 1))
        )

    # -- measured sizes --------------------------------------------------------

    @cached_property
    def sizes_d(self) -> tuple[int, int]:
        """Rows of the dense panel and of its largest section, or more."""
        e = self.raw("events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("trade_date"))
        rows, section_rows = bounds(e, "symbol", "trade_date")
        if section_rows <= int_conf(self.spark, MAX_GROUP_ROWS, DEFAULT_MAX_GROUP_ROWS):
            return rows, section_rows
        return sizes(self.panel_d.select("trade_date"), "trade_date")

    @cached_property
    def sizes_l(self) -> tuple[int, int]:
        """Rows of the daily long panel, and the largest daily or monthly section of the long panels, or more."""
        li = self.raw("lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("trade_date"))
        rows, section_rows = bounds(li, "symbol", "trade_date")
        if section_rows <= int_conf(self.spark, MAX_GROUP_ROWS, DEFAULT_MAX_GROUP_ROWS):
            return rows, section_rows
        rows, day = sizes(self.panel_l.select("trade_date"), "trade_date")
        return rows, max(day, sizes(self.panel_m.select("trade_date"), "trade_date")[1])

    @property
    def section_rows_d(self) -> int:
        return self.sizes_d[1]

    @property
    def section_rows_l(self) -> int:
        return self.sizes_l[1]


#: the same inputs as SQL for the check tool
VIEW_SQL = {
    "panel_d": """SELECT user_id AS symbol, CAST(ts AS DATE) AS trade_date,
 min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close,
 sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) + 1.0) AS volume,
 sum(value * (CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) + 1.0)) AS amount
 FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "panel_l": """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
 min_by(l_extendedprice / l_quantity, l_orderkey * 1000000000 + l_linenumber * 1000000 + l_partkey) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
 max_by(l_extendedprice / l_quantity, l_orderkey * 1000000000 + l_linenumber * 1000000 + l_partkey) AS close,
 sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
 FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "panel_m": """SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
 sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
 FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE)""",
    "ticks": """SELECT event_type AS symbol, ts AS datetime, CAST(ts AS DATE) AS trade_date, event_id,
 CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, value AS price,
 CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) + 1.0 AS volume FROM events""",
    "bars_m": """SELECT symbol, trade_date, minute_of_day, arg_min(price, (datetime, event_id)) AS open,
 max(price) AS high, min(price) AS low, arg_max(price, (datetime, event_id)) AS close,
 sum(volume) AS volume, sum(price * volume) AS amount
 FROM ticks GROUP BY symbol, trade_date, minute_of_day""",
    "dim_d": """SELECT c_custkey - 1 AS symbol, c_mktsegment AS industry, n_name AS industry2, r_name AS sector,
 abs(c_acctbal) + 1.0 AS shares, CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS is_st
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "dim_l": """SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector, s_name AS name,
 abs(s_acctbal) + 1.0 AS shares
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fin": """SELECT symbol, report_date,
 CASE WHEN (symbol + month(report_date) / 3) % 5 = 0 THEN CAST(NULL AS DATE) ELSE CAST(report_date + INTERVAL 25 DAY AS DATE) END AS ann_date,
 sum(rev) OVER (PARTITION BY symbol, year(report_date) ORDER BY report_date) AS revenue,
 sum(np) OVER (PARTITION BY symbol, year(report_date) ORDER BY report_date) AS net_profit,
 1000000.0 + sum(rev) OVER (PARTITION BY symbol ORDER BY report_date) AS total_assets,
 400000.0 + 0.5 * sum(tax) OVER (PARTITION BY symbol ORDER BY report_date) AS total_liability
 FROM (SELECT l_suppkey AS symbol,
 CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date,
 sum(l_extendedprice * (1 - l_discount)) AS rev,
 sum(l_extendedprice * (0.3 - l_discount - l_tax)) AS np, sum(l_extendedprice * l_tax) AS tax
 FROM lineitem GROUP BY l_suppkey, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) q""",
    "fin_full": """SELECT *, revenue / lag(revenue) OVER (PARTITION BY symbol, quarter(report_date) ORDER BY report_date) - 1 AS revenue_yoy,
 (net_profit - lag(net_profit) OVER (PARTITION BY symbol, quarter(report_date) ORDER BY report_date)) / abs(lag(net_profit) OVER (PARTITION BY symbol, quarter(report_date) ORDER BY report_date)) AS profit_yoy,
 total_assets - total_liability AS total_equity,
 net_profit / (total_assets - total_liability) AS roe, 100.0 * net_profit / revenue AS gross_margin FROM fin""",
    "basic": """SELECT symbol, trade_date, close * shares AS total_mv,
 CASE WHEN month(trade_date) % 4 <> 0 THEN close * shares * 0.6 END AS circ_mv,
 volume / shares AS turnover_rate,
 CASE WHEN symbol % 7 <> 0 THEN close * shares / amount END AS pe_ttm,
 close / (100.0 + symbol % 13) AS pb FROM panel_m JOIN dim_l USING (symbol)""",
    "basic_d": """SELECT symbol, trade_date, close * shares AS total_mv,
 CASE WHEN day(trade_date) % 3 <> 0 THEN close * shares * 0.6 END AS circ_mv,
 volume / shares AS turnover_rate,
 CASE WHEN symbol % 7 <> 0 THEN close * shares / nullif(amount, 0) END AS pe_ttm,
 close / (10.0 + symbol % 13) AS pb FROM panel_d JOIN dim_d USING (symbol) WHERE day(trade_date) % 2 = 1""",
    "limits_l": """SELECT symbol, trade_date, 1.1 * lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS up_limit,
 0.9 * lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS down_limit
 FROM panel_l WHERE symbol % 3 <> 0""",
    "alpha_d": "@ALPHA panel_d basic_d dim_d",
    "alpha_l": "@ALPHA panel_l basic dim_l",
    "fin_q1": """SELECT *, year(report_date) * 4 + quarter(report_date) AS period_id,
 CASE WHEN quarter(report_date) = 1 THEN revenue ELSE revenue - lag(revenue) OVER (PARTITION BY symbol, year(report_date) ORDER BY report_date) END AS quarter_revenue,
 CASE WHEN quarter(report_date) = 1 THEN net_profit ELSE net_profit - lag(net_profit) OVER (PARTITION BY symbol, year(report_date) ORDER BY report_date) END AS quarter_profit
 FROM fin_full""",
    "fin_q2": """SELECT a.*, (a.quarter_revenue - b.quarter_revenue) / nullif(abs(b.quarter_revenue), 0) AS quarter_revenue_yoy,
 (a.quarter_profit - b.quarter_profit) / nullif(abs(b.quarter_profit), 0) AS quarter_profit_yoy, a.roe - b.roe AS roe_yoy_change
 FROM fin_q1 a LEFT JOIN fin_q1 b ON a.symbol = b.symbol AND a.period_id = b.period_id + 4""",
    "fin_q3": """SELECT *, quarter_revenue_yoy - lag(quarter_revenue_yoy) OVER (PARTITION BY symbol ORDER BY report_date) AS revenue_accel,
 quarter_profit_yoy - lag(quarter_profit_yoy) OVER (PARTITION BY symbol ORDER BY report_date) AS profit_accel,
 total_equity / nullif(total_assets, 0) AS equity_to_assets, total_liability / nullif(total_assets, 0) AS debt_ratio,
 net_profit / nullif(revenue, 0) AS net_margin, revenue / nullif(total_assets, 0) AS asset_turnover,
 coalesce(ann_date, CAST(report_date + to_days(CASE month(report_date) WHEN 3 THEN 30 WHEN 6 THEN 60 WHEN 9 THEN 30 ELSE 120 END) AS DATE)) AS available_date
 FROM fin_q2""",
    "fin_q": "@CLIP",
    "paper_l": """SELECT p.*, f.report_date, f.roe, f.revenue, f.net_profit, f.revenue_yoy, f.profit_yoy, f.gross_margin, f.total_assets, f.total_liability,
 f.total_equity, f.quarter_revenue_yoy, f.quarter_profit_yoy, f.revenue_accel, f.profit_accel, f.roe_yoy_change, f.equity_to_assets, f.debt_ratio, f.net_margin, f.asset_turnover
 FROM (SELECT b.symbol, b.trade_date, open, high, low, close, volume, amount, total_mv, circ_mv, pe_ttm, pb, turnover_rate, up_limit, down_limit,
 coalesce(d.industry, '') AS industry, CASE WHEN coalesce(d.industry, '') <> '' THEN 1.0 ELSE 0.0 END AS has_industry FROM (SELECT p.*,
 last_value(total_mv IGNORE NULLS) OVER w AS total_mv, last_value(circ_mv IGNORE NULLS) OVER w AS circ_mv, last_value(pe_ttm IGNORE NULLS) OVER w AS pe_ttm,
 last_value(pb IGNORE NULLS) OVER w AS pb, last_value(turnover_rate IGNORE NULLS) OVER w AS turnover_rate, up_limit, down_limit
 FROM panel_l p LEFT JOIN basic f ON p.symbol = f.symbol AND p.trade_date = f.trade_date LEFT JOIN limits_l l ON p.symbol = l.symbol AND p.trade_date = l.trade_date
 WINDOW w AS (PARTITION BY p.symbol ORDER BY p.trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) b LEFT JOIN dim_l d ON b.symbol = d.symbol) p
 ASOF LEFT JOIN (SELECT * FROM fin_q QUALIFY row_number() OVER (PARTITION BY symbol, available_date ORDER BY report_date DESC) = 1) f
 ON p.symbol = f.symbol AND p.trade_date >= f.available_date""",
    "research_l": """SELECT p.*, f.report_date, f.revenue, f.net_profit, f.gross_margin, f.total_assets, f.total_liability
 FROM panel_l p ASOF LEFT JOIN fin_full f ON p.symbol = f.symbol AND p.trade_date >= f.report_date""",
    "idx": """SELECT 'IDX' AS index_symbol, trade_date, symbol, weight
 FROM (SELECT symbol, trade_date, volume, volume / sum(volume) OVER (PARTITION BY trade_date) AS weight,
 row_number() OVER (PARTITION BY trade_date ORDER BY volume DESC, symbol) AS rn,
 count(*) OVER (PARTITION BY trade_date) AS n FROM panel_m) r WHERE rn <= 0.6 * n""",
    "ledger": """SELECT l_partkey % 50 AS symbol, l_orderkey * 1000000000 + l_linenumber * 1000000 + l_partkey AS seq,
 CAST(l_shipdate AS DATE) AS trade_date, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side,
 CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'filled' END AS status,
 l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_extendedprice AS order_value FROM lineitem""",
    "posts": """SELECT doc_id, source, lang, text, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS published_at,
 n_chars % 50 AS reply_count, n_chars % 7 AS like_count FROM documents""",
    "store": """SELECT symbol, trade_date, '' AS as_of_time, 'close_level' AS factor_name, 'h0' AS params_hash, close AS value, 1 AS version FROM panel_d
 UNION ALL SELECT symbol, trade_date, '', 'close_level', 'h0', close * 2, 2 FROM panel_d WHERE symbol % 2 = 0
 UNION ALL SELECT symbol, trade_date, '', 'volume_level', 'h0', volume, 1 FROM panel_d""",
    "latest": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, as_of_time, factor_name, params_hash
 ORDER BY version DESC) AS rn FROM store) WHERE rn = 1""",
}


def _alpha_sql(panel: str, basic: str, dim: str) -> str:
    w = "PARTITION BY symbol ORDER BY trade_date"
    return f"""SELECT b.symbol, b.trade_date, open, high, low, close, volume, amount,
 coalesce(CASE WHEN volume > 0 THEN amount / (volume * (SELECT CASE WHEN median(amount / volume / nullif(close, 0)) > 20 THEN 100.0 ELSE 1.0 END FROM {panel} WHERE volume > 0)) END, close) AS vwap,
 close / nullif(lag(close) OVER ({w}), 0) - 1 AS ret,
 coalesce(last_value(mv IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(mv IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS market_value,
 coalesce(industry, 'UNKNOWN') AS industry
 FROM (SELECT p.*, coalesce(f.circ_mv, f.total_mv) AS mv, d.industry FROM {panel} p
 LEFT JOIN {basic} f ON p.symbol = f.symbol AND p.trade_date = f.trade_date
 LEFT JOIN {dim} d ON p.symbol = d.symbol) b"""


def _clip_sql() -> str:
    cols = ["quarter_revenue_yoy", "quarter_profit_yoy", "revenue_accel", "profit_accel", "roe_yoy_change",
            "equity_to_assets", "debt_ratio", "net_margin", "asset_turnover"]
    parts = ", ".join(
        f"CASE WHEN (SELECT count({c}) FROM fin_q3) >= 10 THEN CASE WHEN {c} IS NOT NULL THEN "
        f"least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM fin_q3)), (SELECT quantile_cont({c}, 0.99) FROM fin_q3)) END ELSE {c} END AS {c}"
        for c in cols
    )
    return f"SELECT * REPLACE ({parts}) FROM fin_q3"


VIEW_SQL["fin_q"] = _clip_sql()
for _name, _text in list(VIEW_SQL.items()):
    if _text.startswith("@ALPHA"):
        VIEW_SQL[_name] = _alpha_sql(*_text.split()[1:])
