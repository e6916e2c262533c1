"""Research and paper factors over the long daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantspark.factors.paper import PAPER_FACTORS
from quantspark.factors.research import RESEARCH_FACTORS
from quantspark.plans.registry import factor

_DENSE = ("research_short_reversal", "research_turnover_liquidity", "paper_reversal_20d")

for _i, (_name, _node) in enumerate(RESEARCH_FACTORS.items(), start=1):
    if _name in _DENSE:
        factor(f"rf{_i:02d}_{_name}", _node)
    elif _i <= 5:
        factor(f"rf{_i:02d}_{_name}", _node, "panel_l")
    else:
        factor(f"rf{_i:02d}_{_name}", _node, "panel_l", bars=lambda t: t.research_l, source="research_l")

for _i, (_name, _node) in enumerate(PAPER_FACTORS.items(), start=1):
    if _name in _DENSE:
        factor(f"pff{_i:02d}_{_name}", _node)
    else:
        _digits = 3 if _name == "elasticity_amount_resilience_20d" else 6
        factor(f"pff{_i:02d}_{_name}", _node, "panel_l", digits=_digits,
               bars=lambda t: t.paper_l, source="paper_l")

for _name in ("semibeta_downside_avoid_252", "semibeta_asymmetry_252"):
    # the market of the long panel hardly ever falls; on a high price level it has down days too
    factor(f"pff{20 + (_name != 'semibeta_downside_avoid_252')}_{_name}_level", PAPER_FACTORS[_name], "panel_l",
           source="(SELECT * REPLACE (close + 100000.0 AS close) FROM panel_l)",
           bars=lambda t: t.panel_l.withColumn("close", F.col("close") + 100000.0))
