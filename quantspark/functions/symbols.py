"""Security symbols: normal form, exchange inference, vendor forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: market names -> exchange suffix (fixed values)
MARKETS = {
    "SH": ("SH", "SSE", "XSHG", "1"),
    "SZ": ("SZ", "SZSE", "XSHE", "0"),
    "BJ": ("BJ", "BSE"),
}
#: first digit of a six-digit code -> exchange suffix (fixed values)
LEADING_DIGITS = {"SH": "69", "SZ": "023", "BJ": "48"}
#: exchange inferred for bare codes in text; funds starting with 5 count as SH
TEXT_LEADING = {"SH": "695", "SZ": "023", "BJ": "48"}


def normal_symbol(symbol: Column, market: Column | None = None) -> Column:
    """Upper-case CODE.SUFFIX; NULL for empty input, unchanged when no market is known."""
    text = F.upper(F.trim(symbol.cast("string")))
    out = F.when(text.rlike(r"^.+\.XSHG$"), F.regexp_replace(text, r"\.XSHG$", ".SH"))
    out = out.when(text.rlike(r"^.+\.XSHE$"), F.regexp_replace(text, r"\.XSHE$", ".SZ"))
    out = out.when(text.rlike("^(SH|SZ|BJ)[0-9]+$"), F.regexp_replace(text, "^(SH|SZ|BJ)([0-9]+)$", "$2.$1"))
    out = out.when(text.contains("."), text)
    if market is not None:
        where = F.upper(F.trim(F.coalesce(market, F.lit(""))))
        for suffix, names in MARKETS.items():
            out = out.when(where.isin(*names), F.concat(text, F.lit("." + suffix)))
    return F.when((text == "") | text.isNull(), None).otherwise(out.otherwise(text))


def listed_symbol(symbol: Column) -> Column:
    """Normal form with the exchange inferred from a bare six-digit code; '' for none."""
    s = normal_symbol(symbol)
    out = F.when(s.isNull(), "").when(s.contains("."), s)
    for suffix, digits in LEADING_DIGITS.items():
        out = out.when(s.rlike(f"^[{digits}][0-9]{{5}}$"), F.concat(s, F.lit("." + suffix)))
    return out.otherwise(s)


def vendor_symbol(symbol: Column) -> Column:
    s = normal_symbol(symbol)
    return F.regexp_replace(F.regexp_replace(s, r"\.SH$", ".XSHG"), r"\.SZ$", ".XSHE")


def market_of(code: Column) -> Column:
    """Exchange of a bare code; '' when prefixed or unknown."""
    text = F.upper(F.trim(F.coalesce(code.cast("string"), F.lit(""))))
    out = F.when(text.rlike("^(SH|SZ|BJ)"), "")
    for suffix, digits in TEXT_LEADING.items():
        out = out.when(text.rlike(f"^[{digits}]"), suffix)
    return out.otherwise("")
