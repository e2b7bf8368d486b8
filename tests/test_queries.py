"""Every query runs on the smallest tables and equals its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quarryline.plans import catalog


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, float):
        return round(v, 6)
    return str(pd.Timestamp(v)) if hasattr(v, "year") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, small, name):
    df = catalog.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for f in os.listdir(small):
            con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
        c = con.execute(sql)
        names = [x[0] for x in c.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(x)]) for x in cols) for r in c.fetchall()), key=repr)


def test_entry_works_without_the_training_part(spark, small, monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "quarryline.llm", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert e.training is None and e.entry(spark).count() > 0 and set(catalog.queries()) == set(e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_every_oracle_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
