"""Catalogue of the named factors of every family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quantspark.factors.alpha101 import ALPHAS
from quantspark.factors.indicators import BAR_INDICATORS
from quantspark.factors.paper import PAPER_FACTORS
from quantspark.factors.research import RESEARCH_FACTORS
from quantspark.factors.smallcap import BAR_FACTORS
from quantspark.factors.technical import TA_FACTORS
from quantspark.functions.expr import Node
from quantspark.sources.vendor import DIRECT_FACTORS

FAMILIES: dict[str, dict[str, Node]] = {
    "alpha101": ALPHAS,
    "technical": TA_FACTORS,
    "research": RESEARCH_FACTORS,
    "paper": PAPER_FACTORS,
    "small_cap": BAR_FACTORS,
    "indicator": BAR_INDICATORS,
}


def definitions(spark: SparkSession, custom: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    """(factor_name, family, note): built-in factors, then the caller's own."""
    rows = [(n, family, "expression") for family, f in FAMILIES.items() for n in f]
    rows += [(n, "vendor", "vendor feed") for n in DIRECT_FACTORS]
    return spark.createDataFrame([*rows, *custom], "factor_name string, family string, note string")


def family_of(name: str) -> str | None:
    """Family that computes ``name``; None for an unknown factor."""
    for family, factors in FAMILIES.items():
        if name in factors:
            return family
    return "vendor" if name in DIRECT_FACTORS else None
