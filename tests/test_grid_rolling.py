import datetime as dt

from barkeel.operators.grid import regular_grid
from barkeel.operators.rolling import rolling_totals

D = dt.datetime
BARS = "bar_id long, symbol string, timeframe string, timestamp timestamp, close double, volume double, received_at timestamp, slot string"
PLAN = "symbol string, timeframe string, session_date date, open_ts timestamp, close_ts timestamp, status string"


def test_grid(spark):
    day = lambda d, h, m=0: D(2025, 1, d, h, m)
    plan = [("A", "30m", dt.date(2025, 1, 1), day(1, 23), day(2, 0, 45), "x"), ("A", "30m", dt.date(2025, 1, 2), day(2, 10), day(2, 11), "x"), ("A", "1d", dt.date(2025, 1, 1), day(1, 9), day(1, 17), "x"), ("B", "30m", dt.date(2025, 1, 1), day(1, 9), day(1, 10), "x")]
    plan.append(plan[0])
    bars = [
        (1, "A", "30m", day(1, 23, 5), 1.0, 1.0, day(3, 0), "c"), (2, "A", "30m", day(1, 23, 5), 2.0, 1.0, day(4, 0), "c"), (3, "A", "30m", day(2, 0, 31), None, 1.0, day(3, 0), "c"),
        (4, "A", "30m", day(2, 11), 9.0, 1.0, day(3, 0), "c"), (5, "A", "1d", day(1, 12), 5.0, 1.0, day(3, 0), "c"), (6, None, "30m", day(1, 9), 1.0, 1.0, day(3, 0), "c"), (7, "B", "30m", None, 1.0, 1.0, None, "c"),
    ]
    b, p = spark.createDataFrame(bars, BARS), spark.createDataFrame(plan, PLAN)
    gaps = {(r.symbol, r.timeframe, r.slot_ts) for r in regular_grid(b, p).where("status <> 'observed'").collect()}
    assert gaps == {("A", "30m", day(1, 23, 30)), ("A", "30m", day(2, 0)), ("A", "30m", day(2, 0, 30)), ("A", "30m", day(2, 10)), ("A", "30m", day(2, 10, 30)), ("B", "30m", day(1, 9)), ("B", "30m", day(1, 9, 30))}
    full = {(r.symbol, r.timeframe, r.slot_ts): (r.status, r.close) for r in regular_grid(b, p).collect()}
    assert len(full) == 9
    assert full[("A", "30m", day(1, 23))] == ("observed", 2.0) and full[("A", "30m", day(2, 10))] == ("filled", 2.0) and full[("B", "30m", day(1, 9))] == ("missing", None)
    old = {(r.slot_ts): r.status for r in regular_grid(b, p, 3600).where("symbol = 'A' and timeframe = '30m'").collect()}
    assert old[day(2, 0)] == "filled" and old[day(2, 10)] == "missing"
    wide = {r.slot_ts: r.gap_s for r in regular_grid(b, p.unionByName(p.limit(0))).where("symbol = 'A' and timeframe = '30m'").collect()}
    assert wide[day(1, 23)] is None and wide[day(2, 10)] is None  # the second has no later reading
    more = spark.createDataFrame([*bars, (8, "A", "30m", day(2, 10, 40), 3.0, 1.0, day(3, 0), "c")], BARS)
    assert {r.slot_ts: r.gap_s for r in regular_grid(more, p).where("symbol = 'A' and timeframe = '30m'").collect()}[day(2, 0)] == 11 * 3600 + 35 * 60
    assert regular_grid(b, p.limit(0)).count() == 0 and regular_grid(b.limit(0), p).where("status <> 'missing'").count() == 0


def test_rolling_equals_loop(spark):
    start = dt.date(2025, 1, 1)
    rows, n = [], 0
    for i in (0, 1, 2, 9, 40, 41, 75):
        for k in range(1 + i % 2):
            n += 1
            at = D(2025, 1, 1, 9 + k) + dt.timedelta(days=i)
            rows.append((n, "A", "1d", at, None if i == 9 else float(i + k), float(n), at, "x"))
    again = (99, "A", "1d", rows[0][3], rows[0][4], 500.0, rows[0][6] + dt.timedelta(days=1), "x")
    rows += [again, (100, None, "1d", D(2025, 1, 1), 1.0, 1.0, None, "x"), (101, "A", "30m", D(2025, 6, 1), 1.0, 1.0, None, "x"), (102, "A", "1d", None, 1.0, 1.0, None, "x")]
    out = rolling_totals(spark.createDataFrame(rows, BARS)).collect()
    assert len(out) == 2 * 76
    live = [r for r in [again, *rows[1:-4]]]
    for r in out:
        inside = [x for x in live if 0 <= (r.day - x[3].date()).days < r.window_days]
        closes = [x[4] for x in inside if x[4] is not None]
        assert r.bars == len(inside) and abs(r.close_sum - sum(closes)) < 1e-9 and abs(r.volume_sum - sum(x[5] for x in inside)) < 1e-9
        assert (r.close_avg is None) == (not closes)
    assert min(r.day for r in out) == start
    assert rolling_totals(spark.createDataFrame([], BARS)).count() == 0
