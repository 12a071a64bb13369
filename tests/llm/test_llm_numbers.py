import random
import statistics

import numpy as np

from barkeel.llm.mixing import MixRule, mix_sources
from barkeel.llm.percentiles import compact_summary, latest_rows, merge_runs, percentiles_of_runs, percentiles_of_summaries, rank_summary, value_runs

P = [0.0, 0.05, 0.5, 0.9, 1.0]


def trades(spark, n=4000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(["hot"] * 6 + ["a", "b", None])
        v = rng.choice([None, float("nan"), -0.0, 0.0, 1.0, 1.0, 1.0, rng.gauss(0, 1), rng.paretovariate(1.1)])
        rows.append((i, f"T{i}" if i % 7 else None, g, v, rng.random(), "clash"))
    rows += [(10**6 + i, "T1", "a", 77.0, 0.5, "clash") for i in range(3)]
    return spark.createDataFrame(rows, "row_id long, trade_id string, g string, x double, y double, value string")


def values(rows):
    out = {}
    for r in rows:
        for m in ("x", "y"):
            v = r[m]
            if v is not None and v == v:
                out.setdefault((r.g, m), []).append(v + 0.0)
    return out


def test_exact_percentiles(spark):
    df = latest_rows(trades(spark), "trade_id", "row_id", ["g", "x", "y"])
    rows = df.collect()
    assert len(rows) == 4000
    want = values(rows)
    got = percentiles_of_runs(value_runs(df, ["g"], ["x", "y"]), ["g"], P).collect()
    assert len(got) == len(want) * len(P)
    for r in got:
        v = want[(r.g, r.measure)]
        assert r.n_values == len(v) and np.isclose(r.percentile, np.quantile(v, r.p), rtol=1e-12, atol=1e-12)
    mid = next(r for r in got if r.g == "hot" and r.measure == "y" and r.p == 0.5)
    assert np.isclose(mid.percentile, statistics.median(want[("hot", "y")]))


def test_combined_parts_equal_whole(spark):
    df = trades(spark, 1500, 2)
    halves = [value_runs(df.where(f"row_id % 2 = {k}"), ["g"], ["x", "y"]) for k in (0, 1)]
    key = lambda r: (str(r.g), r.measure, r.p)
    a = sorted(percentiles_of_runs(merge_runs(halves, ["g"]), ["g"], P).collect(), key=key)
    b = sorted(percentiles_of_runs(value_runs(df, ["g"], ["x", "y"]), ["g"], P).collect(), key=key)
    assert a == b


def test_summaries_bound_the_rank(spark):
    df = trades(spark, 3000, 3)
    want = values(df.collect())
    parts = [rank_summary(value_runs(df.where(f"row_id % 3 = {k}"), ["g"], ["x", "y"]), ["g"], 20) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for r in percentiles_of_summaries(merged, ["g"], [0.1, 0.5, 0.95]).collect():
        v = np.sort(want[(r.g, r.measure)])
        real = v[max(int(np.ceil(r.p * len(v))), 1) - 1]
        assert r.lower <= real <= r.upper
        if r.measure == "y":  # no ties: the bounds are at most a bucket of each part away
            assert np.searchsorted(v, r.upper, "right") - np.searchsorted(v, r.lower) <= 2 * (len(v) / 20 + 3) + 60


def test_compacted_summaries_stay_few_and_true(spark):
    df = trades(spark, 3000, 3)
    want = values(df.collect())
    merged = None
    for k in range(5):
        day = rank_summary(value_runs(df.where(f"row_id % 5 = {k}"), ["g"], ["x", "y"]), ["g"], 20)
        merged = compact_summary(day if merged is None else merged.unionByName(day), ["g"], 40)
    assert merged.groupBy("g", "measure").count().where("count > 45").count() == 0
    for r in percentiles_of_summaries(merged, ["g"], [0.1, 0.5, 0.95]).collect():
        v = np.sort(want[(r.g, r.measure)])
        assert r.n_values == len(v) and r.lower <= v[max(int(np.ceil(r.p * len(v))), 1) - 1] <= r.upper


def test_empty_percentiles(spark):
    df = trades(spark, 5).limit(0)
    assert percentiles_of_runs(value_runs(df, ["g"], ["x"]), ["g"], P).count() == 0


def documents(spark, n=3000, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choices(["big", "mid", "tiny", None, "other"], [70, 20, 3, 2, 5])[0]
        rows.append((i, rng.choice([None, ""]) if i % 200 == 0 else "word " * rng.randrange(1, 60), s, 1))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")


def test_mix(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.2, 4), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(docs, targets)
    rows = mix.collect()
    assert len(rows) == 3000
    caps = {"big": 1, "mid": 3, "tiny": 4}
    assert all(r.copies <= caps.get(r.source, 0) for r in rows)
    total = sum(r.copies * r.n_tokens for r in rows)
    sums = {s: sum(r.n_tokens for r in rows if r.source == s) for s in caps}
    best = min(caps[s] * sums[s] / share for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
    assert abs(total - best) <= 3 * 61 / 2  # each source is within half a record
    got = {r.source: r for r in report.collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(got[s].share - share) < 61 / total and abs(got[s].tokens - share * best) <= 31
        assert got[s].most_copies == max(r.copies for r in rows if r.source == s)
        assert len({r.copies for r in rows if r.source == s}) <= 2
    assert got["absent"].tokens == 0 and got["other"].tokens == 0 and got["other"].target_share == 0.0


def test_mix_of_a_wanted_size(spark):
    docs = documents(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("tiny", 0.2, 4)], "source string, target_share double, max_repeats int")
    small = {r.source: r for r in mix_sources(docs, targets, MixRule(tokens=5000))[1].collect()}
    assert all(abs(small[s].tokens - share * 5000) <= 31 for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
    mix, report = mix_sources(docs, targets, MixRule(tokens=80_000))
    rows, got = mix.collect(), {r.source: r for r in report.collect()}
    whole = 4 * sum(r.n_tokens for r in rows if r.source == "tiny")
    assert got["tiny"].tokens == whole < 16_000 - 31 and abs(got["big"].tokens - 40_000) <= 31


def test_mix_levels_do_not_matter(spark):
    docs = documents(spark, 800, 6)
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.4, 2)], "source string, target_share double, max_repeats int")
    a = {r.record_id: r.copies for r in mix_sources(docs, targets)[0].collect()}
    b = {r.record_id: r.copies for r in mix_sources(docs, targets, MixRule(bits=20, levels=3))[0].collect()}
    assert a == b


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, None)], "source string, target_share double, max_repeats int")
    docs = documents(spark, 5)
    assert mix_sources(docs.limit(0), targets)[0].count() == 0
    assert {r.copies for r in mix_sources(docs, targets.limit(0))[0].collect()} == {0}
