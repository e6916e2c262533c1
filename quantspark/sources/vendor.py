"""Vendor feeds: row normalisers and the factors read straight from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantspark.functions.symbols import listed_symbol
from quantspark.operators.joins import newest
from quantspark.operators.rowwise import sdiv

#: columns that stay text whatever they contain
TEXT_COLUMNS = {"symbol", "ts_code", "con_code", "ths_code", "block_code", "source", "source_api", "mode"}
#: share of non-empty values that must parse before a column becomes numeric
NUMERIC_SHARE = 0.8


def parse_date(col: Column) -> Column:
    """yyyymmdd or yyyy-mm-dd text; anything else is NULL."""
    text = F.trim(col.cast("string"))
    compact = F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
    return F.coalesce(compact, F.substring(text, 1, 10)).try_cast("date")


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Text columns of which at least 80 % of the non-empty values are numbers (one-row probe)."""
    names = [f.name for f in df.schema.fields
             if f.dataType.typeName() == "string" and f.name not in TEXT_COLUMNS and f.name not in skip]
    if not names:
        return []
    aggs = []
    for n in names:
        filled = F.col(n).isNotNull() & (F.trim(n) != "")
        aggs += [F.count_if(filled).alias(f"{n}__all"),
                 F.count_if(filled & F.trim(n).try_cast("double").isNotNull()).alias(f"{n}__num")]
    row = df.agg(*aggs).first()
    return [n for n in names if row[f"{n}__all"] and row[f"{n}__num"] >= NUMERIC_SHARE * row[f"{n}__all"]]


def normal_common(df: DataFrame, date_columns: Sequence[str] = (), symbol_from: str | None = None, api: str = "") -> DataFrame:
    if symbol_from in df.columns and "symbol" not in df.columns:
        df = df.withColumn("symbol", F.col(symbol_from).cast("string"))
    for c in date_columns:
        if c in df.columns:
            df = df.withColumn(c, parse_date(F.col(c)))
    casts = {n: F.trim(n).try_cast("double") for n in numeric_columns(df, date_columns)}
    return df.withColumns({**casts, "source": F.lit("vendor"), "source_api": F.lit(api)})


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of ``names`` that is a column; NULL when none is."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("string")


SIZES = ("sm", "md", "lg", "elg")


def derive_moneyflow(df: DataFrame) -> DataFrame:
    """Net flow = sum of buys - sum of sells over the size classes that are present."""
    for unit, out in (("amount", "net_mf_amount"), ("vol", "net_mf_vol")):
        buys = [f"buy_{s}_{unit}" for s in SIZES if f"buy_{s}_{unit}" in df.columns]
        sells = [f"sell_{s}_{unit}" for s in SIZES if f"sell_{s}_{unit}" in df.columns]
        if out not in df.columns and buys and sells:
            add = lambda cols: sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
            df = df.withColumn(out, add(buys) - add(sells))
    return df


def normal_north_south(df: DataFrame) -> DataFrame:
    df = df.withColumn("trade_date", parse_date(F.col("trade_date")))
    for side in ("north", "south"):
        if f"{side}_money" in df.columns:
            df = df.withColumn(f"{side}_money_million", F.col(f"{side}_money").try_cast("double"))
    return df.where("trade_date is not null")


def normal_holdings(df: DataFrame) -> DataFrame:
    return df.select(
        listed_symbol(F.col("ts_code")).alias("symbol"), parse_date(F.col("trade_date")).alias("trade_date"),
        F.col("vol").try_cast("double").alias("holding_volume"),
        F.col("ratio").try_cast("double").alias("holding_ratio"), F.upper("exchange").alias("exchange"),
    ).where("trade_date is not null")


def normal_fund_portfolio(df: DataFrame) -> DataFrame:
    return df.select(
        first_present(df, ["fund_code", "ts_code"]).alias("fund_code"), listed_symbol(F.col("symbol")).alias("symbol"),
        parse_date(first_present(df, ["end_date", "period"])).alias("end_date"),
        parse_date(first_present(df, ["ann_date"])).alias("ann_date"), F.col("mkv").try_cast("double").alias("mkv"),
    ).where("end_date is not null")


#: figure -> source columns, the first present one is used
STATEMENT_ALIASES = {
    "total_revenue": ["total_revenue", "revenue"],
    "net_income": ["n_income", "net_profit"],
    "assets": ["total_assets"],
    "liabilities": ["total_liab", "total_liability"],
}


def normal_statement(df: DataFrame) -> DataFrame:
    """Availability falls back from f_ann_date to ann_date to end_date."""
    end = first_present(df, ["end_date", "report_date"])
    dates = [F.col(c) for c in ("f_ann_date", "ann_date") if c in df.columns]
    known = F.coalesce(*[parse_date(c) for c in dates], parse_date(end))
    figures = [first_present(df, names).cast("double").alias(out) for out, names in STATEMENT_ALIASES.items()]
    return df.select("symbol", parse_date(end).alias("end_date"), known.alias("f_ann_date"), *figures)


#: analyst datasets: output column -> source aliases
ANALYST_ALIASES = {
    "report": {"org": ["org_name", "org"], "author": ["author_name", "author"], "rating": ["rating"]},
    "rank": {"analyst_id": ["analyst_id", "id"], "score": ["index", "score"]},
    "detail": {"analyst_id": ["analyst_id", "id"], "code": ["stock_code", "code"], "gain": ["gain", "return"]},
    "history": {"analyst_id": ["analyst_id", "id"], "value": ["value", "index"]},
}


def normal_analyst(df: DataFrame, kind: str) -> DataFrame:
    return df.select(*[first_present(df, names).alias(out) for out, names in ANALYST_ALIASES[kind].items()])


def normal_auction(df: DataFrame) -> DataFrame:
    vwap = F.coalesce(first_present(df, ["vwap"]).cast("double"), sdiv(F.col("amount"), F.col("volume")))
    return df.where("price > 0").withColumn("vwap", vwap)


def normal_block(df: DataFrame) -> DataFrame:
    return df.select(first_present(df, ["block_code", "ths_code", "ts_code"]).alias("block_code"),
                     F.trim(first_present(df, ["block_name", "name"])).alias("block_name")).where("block_name <> ''").distinct()


def normal_members(df: DataFrame) -> DataFrame:
    return df.select(first_present(df, ["block_code", "ths_code"]).alias("block_code"),
                     listed_symbol(first_present(df, ["con_code", "symbol"])).alias("symbol")).where("symbol <> ''").distinct()


#: dataset name -> normaliser
DATASET_NORMALISERS = {
    "hk_hold": normal_holdings, "moneyflow_hsgt": normal_north_south, "fund_portfolio": normal_fund_portfolio,
    "statement": normal_statement, "auction": normal_auction, "block": normal_block, "block_member": normal_members,
    "moneyflow": derive_moneyflow,
}


def normalise(dataset: str, df: DataFrame) -> DataFrame:
    return DATASET_NORMALISERS[dataset](df)


def normal_text(df: DataFrame, day_aliases: Sequence[str], api: str) -> DataFrame:
    """Titles, links and dates under one schema; untitled rows dropped, quality flagged."""
    title = F.trim(first_present(df, ["title", "report_title", "headline"]))
    url = F.trim(F.coalesce(first_present(df, ["url", "link"]).cast("string"), F.lit("")))
    day = first_present(df, day_aliases).cast("date")
    rows = df.withColumns({"title_": title, "url_": url, "day_": day}).where("title_ is not null and title_ <> ''")
    flags = F.concat_ws(
        ",",
        F.when(F.length("title_") < 8, "short_title"),
        F.when(F.col("url_") == "", "no_url"),
        F.when(F.col("day_").isNull(), "no_date"),
    )
    return rows.select(
        F.col("title_").alias("title"), F.col("url_").alias("source_url"), F.col("day_").alias("published"),
        flags.alias("quality_flags"), F.substring(F.sha1("title_"), 1, 16).alias("title_hash"),
        F.lit(api).alias("source_api"),
    )


def concept_names(index: DataFrame, members: DataFrame) -> DataFrame:
    """Sorted concept names per symbol from deduplicated (code, symbol) pairs."""
    pairs = members.select("code", "symbol").distinct()
    named = pairs.join(index.select("code", "name"), "code")
    return named.groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("concepts"))


#: factor -> (dataset, date column, value column); fixed names of the vendor feeds
DIRECT_FACTORS = {
    "moneyflow_net_mf_amount": ("moneyflow", "trade_date", "net_mf_amount"),
    "moneyflow_net_mf_vol": ("moneyflow", "trade_date", "net_mf_vol"),
    "jq_moneyflow_net_amount_main": ("jq_money_flow_daily", "trade_date_1", "net_amount_main"),
    "jq_moneyflow_net_pct_main": ("jq_money_flow_daily", "trade_date_1", "net_pct_main"),
    "jq_moneyflow_net_amount_xl": ("jq_money_flow_daily", "trade_date_1", "net_amount_xl"),
    "jq_moneyflow_net_pct_xl": ("jq_money_flow_daily", "trade_date_1", "net_pct_xl"),
    "jq_moneyflow_net_amount_l": ("jq_money_flow_daily", "trade_date_1", "net_amount_l"),
    "jq_moneyflow_net_pct_l": ("jq_money_flow_daily", "trade_date_1", "net_pct_l"),
    "jq_moneyflow_net_mf_amount": ("jq_money_flow_daily", "trade_date_1", "net_mf_amount"),
    "auction_amount": ("auction_replay", "datetime", "amount"),
    "auction_vwap": ("auction_replay", "datetime", "vwap"),
}


def direct_factor(df: DataFrame, name: str, start=None, end=None) -> DataFrame:
    """One value per (symbol, date): newest ingestion, then the larger value."""
    _, day, column = DIRECT_FACTORS[name]
    rows = df.select("symbol", F.to_date(day).alias("trade_date"), F.col(column).cast("double").alias("value"), "ingested")
    rows = rows.where("value is not null")
    if start is not None:
        rows = rows.where(F.col("trade_date").between(start, end))
    out = newest(rows, ["symbol", "trade_date"], F.struct("ingested", "value"))
    return out.select("symbol", "trade_date", F.lit(name).alias("factor_name"), "value")


def auction_gap(df: DataFrame) -> DataFrame:
    return df.select("symbol", "trade_date", sdiv(F.col("price") - F.col("open"), F.col("open")).alias("value"))


def union_index(index: DataFrame, sources: Sequence[str], name: str) -> DataFrame:
    """Derived index whose members on a date are those of any source index."""
    rows = index.where(F.col("index_symbol").isin(list(sources))).select("trade_date", "symbol").distinct()
    return rows.select(F.lit(name).alias("index_symbol"), "trade_date", "symbol")


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of histories, newest batch per (symbol, date), return recomputed."""
    from pyspark.sql.window import Window

    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    kept = newest(both, ["symbol", "trade_date"], F.col("batch"))
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))
    return kept.select("symbol", "trade_date", "close", (sdiv(F.col("close"), prev) - 1.0).alias("ret_1d"))
