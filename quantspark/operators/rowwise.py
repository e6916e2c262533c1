"""Row arithmetic with the library's missing-value rules.

Missing is always NULL (never NaN or infinity): division by zero, the log of a
non-positive number and a non-finite power are NULL, so ANSI mode never raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sdiv(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), x)


ROW = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": sdiv,
    "pow": lambda a, b: finite(F.pow(a, b)),
    "neg": lambda a: -a,
    "abs": F.abs,
    "sign": F.signum,
    "log": lambda a: F.when(a > 0, F.ln(a)),
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "exp": lambda a: finite(F.exp(a)),
    "floor": lambda a: F.floor(a).cast("double"),
    "block_no": F.floor,  # a whole number: windows partition and order by it as it is
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "eq": lambda a, b: a == b,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "coalesce": lambda *xs: F.coalesce(*xs),
    "isnull": lambda a: a.isNull(),
    "notnull": lambda a: a.isNotNull(),
    "greatest": lambda *xs: F.greatest(*xs),
    "least": lambda *xs: F.least(*xs),
    "nullif": F.nullif,
}
