"""Sliced window helpers against plain Python, with most rows under one key and rows on slice borders."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscope.operators import series, sliced

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def points():
    rng = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if rng.random() < 0.8 else rng.choice("ab")
        at = BASE + dt.timedelta(seconds=rng.choice([0, 3600, 7200, 50000]) + rng.randrange(0, 4000))
        out.append((i, key, at, rng.randrange(100), rng.randrange(10) if rng.random() < 0.3 else None))
    return out


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame(points, "id int, key string, ts timestamp_ntz, v bigint, x bigint")


def ordered(points, by_key=True):
    groups = {}
    for p in sorted(points, key=lambda p: (p[2], p[0])):
        groups.setdefault(p[1] if by_key else None, []).append(p)
    return groups.values()


@pytest.mark.parametrize("keys", [["key"], []])
def test_lag_sum_rank_last(table, points, keys):
    lag = {r.id: r.prev_v for r in sliced.sliced_lag(table, keys, "ts", ["v"], ["id"]).collect()}
    run = {r.id: r.t for r in sliced.sliced_running_sum(table, keys, "ts", "v", "t", ["id"]).collect()}
    rank = {r.id: r.rank for r in sliced.sliced_rank(table, keys, "ts", ["id"]).collect()}
    last = {r.id: r.y for r in sliced.sliced_last_value(table, keys, "ts", {"y": F.col("x")}, ["id"]).collect()}
    for group in ordered(points, bool(keys)):
        prev, total, seen = None, 0, None
        for n, p in enumerate(group, 1):
            total += p[3]
            seen = seen if p[4] is None else p[4]
            assert (lag[p[0]], run[p[0]], rank[p[0]], last[p[0]]) == (prev, total, n, seen)
            prev = p[3]


def test_live_rate(table, points):
    got = {r.id: r.rate for r in series.live_rate(table.withColumnRenamed("v", "bytes"), 300, slice_seconds=400).collect()}
    for p in points:
        want = sum(q[3] for q in points if p[2] - dt.timedelta(seconds=300) < q[2] <= p[2]) / 300
        assert got[p[0]] == pytest.approx(want)


def test_rolling_baseline_over_blocks(table, points, monkeypatch):
    monkeypatch.setattr(sliced, "RANK_BLOCK", 130)
    ticks = table.withColumn("w", F.when(F.col("v") > 5, F.col("v").cast("double")).otherwise(F.lit(float("nan"))))
    laid, _ = sliced.rolling_blocks(ticks, ["key"], "ts", 120, ["id"], block=130)
    assert laid.where("_copied").count() > 0
    out = series.rolling_baseline(ticks.withColumn("ts", F.col("ts") + F.make_dt_interval(secs=F.col("id") / 1e4)), ["w"], ["key"])
    got = {r.id: r.w_p95 for r in out.collect()}
    for group in ordered(points):
        for n, p in enumerate(group):
            vals = [q[3] for q in group[max(0, n - 119): n + 1] if q[3] > 5]
            assert got[p[0]] == (pytest.approx(np.quantile(vals, 0.95)) if len(vals) >= 10 else None)


def test_resample_matches_interp(spark):
    rng = np.random.default_rng(1)
    vals = {"a": rng.random(14), "b": rng.random(1), "c": rng.random(90)}
    df = spark.createDataFrame([(s, i, float(v)) for s, x in vals.items() for i, v in enumerate(x)], "series string, idx bigint, value double")
    got = {}
    for r in series.resample_linear(df, 30).orderBy("idx").collect():
        got.setdefault(r.series, []).append(r.value)
    for s, x in vals.items():
        want = np.interp(np.linspace(0, 1, 30), np.linspace(0, 1, len(x)), x)
        assert np.allclose(got[s], want)
    assert series.resample_linear(df, 1).count() == df.count()


def test_counter_resets_and_rates(spark):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    samples = spark.createDataFrame([("m", "x", at(s), v) for s, v in [(0, 5), (30, 9), (60, 20), (70, 4), (100000, 10)]],
                                    "metric string, label string, ts timestamp_ntz, value bigint")
    rate = {r.ts: r.rate for r in series.metric_rate(samples, 60).collect()}
    assert [round(rate[at(s)] * 60, 6) for s in (0, 30, 60, 70, 100000)] == [0, 4, 15, 19, 6]


def test_score_needs_a_baseline(spark):
    ticks = [("t", BASE + dt.timedelta(seconds=i), 10.0, 100.0 if i < 30 else 400.0, 5.0, 0.5, None) for i in range(31)]
    df = spark.createDataFrame(ticks, "tenant string, ts timestamp_ntz, mbps double, unique_flows double, unique_src double, diversity double, spray double")
    got = [r.score for r in series.lowslow_score(df).orderBy("ts").collect()]
    flows = [10.0] * 30 + [40.0]
    p95 = np.quantile(flows, 0.95)
    assert got[:30] == [0.0] * 30
    assert got[30] == pytest.approx(40.0 * min(max(40.0 / (p95 + 1e-9) - 1, 0), 1))
