"""Trade statistics by the delivered entry time."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_buckets_by_entry_time_and_latest_row(spark, small, tmp_path):
    exit_time = dt.datetime(2025, 9, 3, 18)  # midday in New York
    changes = [
        (1, "a", "2025-09-03T09:45:00-04:00", 1.0), (2, "b", "2025-09-03T12:00:00Z", 1.0), (3, "c", "no time", 1.0), (4, "d", None, -1.0),
        (5, "a", "2025-09-03T09:45:00-04:00", 2.0), (6, None, "2025-09-03T15:30:00-04:00", 1.0), (7, None, "2025-09-03T15:30:00-04:00", 1.0),
    ]
    schema = spark.read.parquet(f"{small}/trade_log.parquet").schema
    base = {"feed": None, "symbol": "A", "timeframe": "5m", "pattern_type": "H2", "market_regime": "BULL_TREND", "direction": "LONG", "exit_time": exit_time, "exit_price": 1.0, "strategy_version": "v"}
    rows = [{f.name: None for f in schema} | base | {"row_id": i, "trade_id": t, "entry_time": e, "pnl": r, "pnl_r": r} for i, t, e, r in changes]
    spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema).write.parquet(f"{tmp_path}/trade_log.parquet")
    for name in ("feeds", "ohlcv_raw"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    q = entry.queries()
    got = {r.row_id: r.session for r in q["trade_condition_buckets"](spark, str(tmp_path)).collect()}
    assert got == {1: "OPEN", 2: "PREMARKET", 3: "UNKNOWN", 4: "UNKNOWN", 5: "OPEN", 6: "CLOSE", 7: "CLOSE"}
    s = q["setup_statistics_7_scopes"](spark, str(tmp_path))
    assert {r.session: (r.total, r.wins) for r in s.where("scope = 'PATTERN_SESSION'").collect()} == {"OPEN": (1, 1), "PREMARKET": (1, 1), "UNKNOWN": (2, 1), "CLOSE": (2, 2)}
    assert s.where(F.col("scope") == "OVERALL").first().total == 6
