import datetime as dt

import pytest
from pyspark.sql import functions as F

from barkeel.operators import views
from barkeel.sources.rules import load_rules, write_rule

D = dt.datetime


def test_views(spark):
    rows = spark.createDataFrame([("A", "1m", i, D(2025, 1, 1, 10, i)) for i in range(10)] + [("B", "1m", 0, D(2025, 1, 1))], "symbol string, timeframe string, bar_index long, timestamp timestamp")
    window = views.chart_window(rows, 3)
    assert sorted((r.symbol, r.bar_index) for r in window.collect()) == [("A", 7), ("A", 8), ("A", 9), ("B", 0)]
    trades = spark.createDataFrame([("A", "1m", "t", "LONG", D(2025, 1, 1, 10, 2), 1.0, D(2025, 1, 1, 10, 8), 2.0)], "symbol string, timeframe string, trade_id string, direction string, entry_time timestamp, entry_price double, exit_time timestamp, exit_price double")
    assert [(r.kind, r.price) for r in views.trade_markers(trades, window).collect()] == [("exit", 2.0)]
    s = spark.createDataFrame([("H2", "a"), (None, "b"), ("H1", "a")], "pattern_type string, market_regime string")
    assert [r[0] for r in views.dimension_values(s, "pattern_type").collect()] == ["H1", "H2"]
    assert views.filter_statistics(s, pattern_type="All", market_regime="a").count() == 2 and views.filter_statistics(s, pattern_type="H2", market_regime=None).count() == 1
    one = spark.createDataFrame([(1234.5, 0.256, D(2025, 7, 1, 12)), (None, None, None)], "x double, r double, t timestamp")
    got = [tuple(r) for r in one.select(views.format_number(F.col("x")), views.format_ratio(F.col("r")), views.format_time(F.col("t"), "America/New_York")).collect()]
    assert got == [("1,234.50", "25.6%", "2025-07-01 08:00"), ("-", "-", "-")]


def test_rule_library(spark, tmp_path):
    write_rule({"name": "a", "status": "approved", "reviewer": "me", "reviewed_at": "2025-01-01", "source_verified": True, "steps": [1, 2]}, str(tmp_path / "x" / "a.json"))
    write_rule({"name": "b", "status": "approved"}, str(tmp_path / "b.json"))
    rows = load_rules(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.status) for r in rows] == [("a", "approved"), ("b", "candidate")] and rows[0].facts["steps"] == "[1, 2]"
    write_rule({"name": "A ", "status": "draft"}, str(tmp_path / "c.json"))
    with pytest.raises(ValueError, match="duplicate"):
        load_rules(spark, str(tmp_path))
    write_rule({"no": 1}, str(tmp_path / "d.json"))
    with pytest.raises(ValueError, match="not a rule"):
        load_rules(spark, str(tmp_path))
