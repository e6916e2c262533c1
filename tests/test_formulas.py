"""The hand-written formulas against the expressions, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES
from quantspark.plans import formulas
from quantspark.sources.panels import VIEW_SQL

ROOT = "/root/testdata/sf0.001"


def test_formulas_share_no_text_with_the_expressions():
    for name, (view, *_) in {**formulas.TECHNICAL, **formulas.RESEARCH, **formulas.ALPHA}.items():
        sql = entry.oracle_sql()[name]
        assert "bar_no_" not in sql and view in VIEW_SQL and view in sql


@pytest.mark.parametrize("name", ["ta03_rsi", "ta06_macd_dea", "ta12_cci", "ta20_adx", "al_004", "al_009", "al_016", "rf01_research_short_reversal"])
def test_formula(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    want = {(s, d): v for s, d, v in con.execute(f"SELECT symbol, trade_date, value FROM ({entry.oracle_sql()[name]})").fetchall()}
    got = {(r.symbol, r.trade_date): r.value for r in entry.queries()[name](spark, ROOT).collect()}
    assert got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None}
