"""Every registered query, on the smallest tables, against its SQL."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from edgetide import catalog

SF = "/root/testdata/sf0.001"


def cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8))
    return repr(v) if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    if sql := catalog.ORACLE_SQL.get(name):
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        assert got == sorted(tuple(cell(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())


def test_entry(spark):
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


def test_entry_without_the_training_data_operators(monkeypatch):
    for missing in ("corpus_pipeline", "edgetide.llm"):
        with monkeypatch.context() as m:
            for name in [k for k in sys.modules if k == "corpus_pipeline" or k.startswith("edgetide.llm")]:
                m.delitem(sys.modules, name)
            m.setitem(sys.modules, missing, None)
            assert set(entry.queries()) == set(catalog.QUERIES) and entry.oracle_sql() == catalog.ORACLE_SQL
