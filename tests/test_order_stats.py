"""Distributed order statistics against plain Python."""

import datetime as dt
import random
import statistics
from collections import defaultdict

import numpy as np
import pytest

from ferrule.operators import frequency as FQ
from ferrule.operators import order_stats as O

BASE = dt.datetime(2024, 1, 1)


def gaps_of(times):
    times = sorted(t for t in times if t is not None)
    return [(b - a) // dt.timedelta(microseconds=1) for a, b in zip(times, times[1:])]


def series(seed, hot=0):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, 3, None]), BASE + dt.timedelta(microseconds=r.randrange(10**9) if r.random() < 0.7 else 5 * 10**8))
            for _ in range(400)]
    return rows + [(9, BASE)] * hot + [(7, BASE)] + [(1, None), (8, None)]


@pytest.mark.parametrize("seed, hot", [(1, 0), (2, 500)])
def test_gaps_per_key_and_whole_frame(spark, seed, hot):
    rows = series(seed, hot)
    df = spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz").repartition(5)
    for keys in (["tag_id"], []):
        want = defaultdict(list)
        for k, t in rows:
            want[k if keys else 0].append(t)
        got = defaultdict(list)
        for r in O.consecutive_gaps(df, keys)[0].collect():
            got[r["tag_id"] if keys else 0] += [r["gap_us"]] * r["weight"]
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(gaps_of(v)) for k, v in want.items() if len(gaps_of(v))}


def test_median_and_quantiles(spark):
    rows = series(3, 50)
    df = spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz").repartition(7)
    want = {}
    for k in {k for k, _ in rows}:
        g = [x / 1e6 for x in gaps_of([t for q, t in rows if q == k])]
        if g:
            want[k] = (len(g), statistics.median(g), *np.quantile(g, [0, 0.13, 0.9, 1]))
    assert {r["tag_id"]: r["median_gap"] for r in FQ.median_gap_by_key(df, ["tag_id"]).collect()} == {k: pytest.approx(v[1]) for k, v in want.items()}
    out = FQ.gap_quantiles_by_key(df, ["tag_id"], {"q0": 0.0, "q13": 0.13, "q90": 0.9, "q100": 1.0}).collect()
    for r in out:
        n, _, *qs = want.pop(r["tag_id"])
        assert r["gap_count"] == n and [r["q0"], r["q13"], r["q90"], r["q100"]] == [pytest.approx(x) for x in qs]
    assert not want


def test_a_value_repeated_beyond_any_buffer(spark):
    df = spark.createDataFrame([("a", 1.0, 10**15), ("a", 2.0, 10**15), ("a", 3.0, 1), ("b", None, 5), ("c", 4.0, 1)],
                               "k string, v double, w bigint")
    out = {r["k"]: (r["n"], r["m"]) for r in O.weighted_quantiles(df, ["k"], "v", "w", {"m": 0.5}).collect()}
    assert out == {"a": (2 * 10**15 + 1, 2.0), "c": (1, 4.0)}


def test_plan_has_no_hour_window_and_no_value_buffer(spark):
    df = spark.createDataFrame(series(4), "tag_id int, timestamp timestamp_ntz")
    for out in (FQ.median_gap_by_key(df, ["tag_id"]), FQ.frequency_of_frame(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "median(" not in plan and "_blk" not in plan
        assert "Window [" not in plan or "_range" in plan


def test_empty_frame(spark):
    df = spark.createDataFrame([], "tag_id int, timestamp timestamp_ntz")
    assert FQ.median_gap_by_key(df, ["tag_id"]).collect() == []
    assert [tuple(r) for r in FQ.frequency_of_frame(df, with_span=True).collect()] == [(0, None, None, None)]
