import importlib
import os
import sys

import pytest
from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

CORE = [n for m in entry._PLANS for n in importlib.import_module(m).QUERIES]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert isinstance(df, DataFrame) and df.limit(1).count() == 1


@pytest.mark.parametrize("name", CORE)
def test_core_queries_run(spark, small, name):
    """Every query gives its columns once, and the rows of its SQL where it has one."""
    got = entry.queries()[name](spark, small).toPandas()
    assert len(got.columns) == len(set(got.columns)) > 0
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        want = compare.views(small).sql(sql).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert compare.plain(got) == compare.plain(want)
    elif not name.startswith("ohlcv_"):  # tiny tables of delivered bars may give no signal
        assert len(got) > 0


def test_nothing_else_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "barkeel")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert "barkeel.llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f
