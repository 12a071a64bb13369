"""Session queries over delivered bars."""

import datetime as dt

import __spark_entry__ as entry

D = dt.datetime
SCHEMA = "bar_id bigint, symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double, feed string, received_at timestamp"


def write(spark, folder, bars, plan=()):
    rows = [(i, s, f, at, o, h, lo, c, 1.0, "f", at) for i, (s, f, at, (o, h, lo, c)) in enumerate(bars)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/sample_ohlcv.parquet")
    spark.createDataFrame(list(plan), "symbol string, timeframe string, session_date date, open_ts timestamp, close_ts timestamp").write.parquet(f"{folder}/session_plan.parquet")
    return str(folder)


def test_minute_gaps_of_delivered_bars(spark, tmp_path):
    day, ok = D(2025, 10, 15), (1.0, 2.0, 0.5, 1.5)
    at = lambda h, m, s=0: day.replace(hour=h, minute=m, second=s)
    bars = [("A", "1m", at(13, 30), ok), ("A", "1m", at(13, 31, 22), ok), ("A", "1m", at(13, 31, 40), ok), ("A", "1m", at(13, 33), (None, 2.0, 0.5, 1.5)), ("A", "1m", at(13, 35), ok), ("A", "5m", at(20, 0), ok)]
    plan = [(s, f, day.date(), at(13, 30), at(13, 35)) for s, f in (("A", "1m"), ("B", "1m"), ("A", "5m"))]
    got = {(r.symbol, r.timeframe, r.day, r.kind): r.n for r in entry.queries()["ohlcv_minute_gaps"](spark, write(spark, tmp_path, bars, plan)).collect()}
    assert got == {("A", "1m", "2025-10-15", "missing"): 3, ("A", "1m", "2025-10-15", "extra"): 1, ("B", "1m", "2025-10-15", "missing"): 5}


def test_every_intraday_series_is_resampled(spark, tmp_path):
    day = D(2025, 10, 15, 13, 30)
    price = lambda i: (100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i)
    bars = [("A", f"{n}m", day + dt.timedelta(minutes=n * i), price(i)) for n, size in ((1, 61), (5, 13), (15, 5), (30, 3)) for i in range(size)] + [("A", "1d", day, price(0))]
    got = {}
    for r in entry.queries()["ohlcv_resample"](spark, write(spark, tmp_path, bars)).collect():
        got.setdefault((r.source_timeframe, r.timeframe), []).append((r.ts_s, r.open, r.high, r.low, r.close, r.volume))
    want = {}
    for n, size in ((1, 61), (5, 13), (15, 5), (30, 3)):
        for to in (5, 15, 30, 60):
            if to > n:
                k = to // n
                cut = [range(i, min(i + k, size)) for i in range(0, size, k)]
                want[f"{n}m", f"{to}m"] = [(int(day.replace(tzinfo=dt.UTC).timestamp()) + to * 60 * j, 100.0 + c[0], 101.0 + c[-1], 99.0 + c[0], 100.5 + c[-1], float(len(c))) for j, c in enumerate(cut)]
    assert {k: sorted(v) for k, v in got.items()} == want
