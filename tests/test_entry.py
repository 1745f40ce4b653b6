"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_runs(spark):
    df = _entry().entry(spark)
    assert df.count() > 0
    assert "growth_trend_30days" in df.columns


def test_queries_and_oracles_align():
    m = _entry()
    q, o = m.queries(), m.oracle_sql()
    assert q and set(o) <= set(q)
