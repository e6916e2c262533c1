"""Registered queries against their oracle on the smallest tables.

The default run takes one query per inventory family; QUANTSPARK_ALL=1 takes all of them.
"""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal

ROOT = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def chosen():
    if os.environ.get("QUANTSPARK_ALL"):
        return sorted(SQL)
    seen, out = set(), []
    for name in sorted(SQL):
        family = re.match(r"[a-z]+", name).group()
        if family not in seen:
            seen.add(family)
            out.append(name)
    return out


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", chosen())
def test_query(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    cols = sorted(df.columns)
    mine = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    # queries of the optional part are tested with it
    own = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own <= set(SQL)
