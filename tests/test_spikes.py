import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barkeel.operators.spikes import SpikeRules, flag_readings

SCHEMA = "bar_id long, symbol string, timeframe string, timestamp timestamp, open double, high double, low double, close double, volume double, feed string, received_at timestamp, implausible string"
T0 = dt.datetime(2025, 8, 4, 13, 30)


def series(n=300, seed=1, symbol="A", first=1, level=100.0, step_s=60):
    rng = random.Random(seed)
    rows, price = [], level
    for i in range(n):
        o = price
        price *= math.exp(rng.gauss(0, 0.001))
        h, lo = max(o, price) * 1.0004, min(o, price) * 0.9996
        t = T0 + dt.timedelta(seconds=step_s * i)
        rows.append([first + i, symbol, "1m", t, o, h, lo, price, 1000.0 * math.exp(rng.gauss(0, 0.4)), "f", t, "x"])
    return rows


def found(spark, rows, **rules):
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    out = flag_readings(df, SpikeRules(**rules)).toPandas()
    assert len(out) == len(rows)
    return out, set(out[out.implausible].bar_id)


def test_kinds(spark):
    rows = series()
    rows[50][7] = rows[50][5] = rows[50][7] * 1.08  # close and high off
    rows[51][7] = rows[51][5] = rows[51][7] * 1.08
    rows[90][5] *= 1.09  # high alone
    rows[120][8] *= 60  # volume
    rows[150][8] = -3.0
    rows[151][5] = 0.0
    rows[152][7] = rows[152][7] * 100
    for r in rows[200:230]:
        r[4:8] = rows[199][4:8]
    for r in rows[230:]:  # a repricing that lasts
        r[4:8] = [x * 1.1 for x in r[4:8]]
    for i, v in ((10, 4), (11, 7), (12, 8), (13, 5)):  # nulls are no cases
        rows[i][v] = None
    again = list(rows[50])
    again[0], again[10] = 9001, again[10] + dt.timedelta(hours=5)
    busy = list(rows[60])
    busy[0], busy[8], busy[10] = 9002, busy[8] * 2, busy[10] + dt.timedelta(hours=5)  # a revised volume
    out, hit = found(spark, [*rows, again, busy])
    assert hit == {51, 52, 91, 121, 151, 152, 153, 9001} | set(range(201, 231))


def test_blocks_agree(spark):
    rows = series(2000, seed=4)
    for i in (5, 700, 701, 1024, 1999):
        rows[i][7] = rows[i][5] = rows[i][7] * 1.07
    whole = found(spark, rows)[1]
    cut = found(spark, rows, block_slots=256, halo_seconds=7200)[1]
    assert whole == cut == {6, 701, 702, 1025, 2000}


def test_edges(spark):
    rows = series(3)
    rows += [[7, None, "1m", T0, 1.0, 2.0, 0.5, 1.0, 1.0, None, T0, "x"], [8, "B", "1m", None, 1.0, 0.2, 0.5, 1.0, 1.0, None, None, "x"], [9, "C", "odd", T0, 1.0, 2.0, 0.5, float("nan"), 1.0, None, T0, "x"]]
    assert found(spark, rows)[1] == {8, 9}
    assert flag_readings(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [4, 5, 7])
def test_few_equal_bars_are_fine(spark, n):
    rows = series(60)
    for r in rows[30 : 30 + n]:
        r[4:8] = rows[29][4:8]
    # n repeats make a run of n + 1 bars
    hit = found(spark, rows)[1]
    assert hit == (set(range(31, 31 + n)) if n + 1 >= 8 else set())


def test_plan_has_one_exchange(spark):
    df = spark.createDataFrame([tuple(r) for r in series(5)], SCHEMA)
    plan = flag_readings(df).select(F.col("bar_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
