"""Repeated imports by digests of key ranges."""

import glob
import random
import shutil

import pytest

from ferrule.sources import imports as I

SCHEMA = "a int, b string, value string, nr long"


def brute(stored, source):
    out = dict(stored)
    for a, b, v, _ in sorted(source, key=lambda r: r[3]):
        out.setdefault((a, b), v)
    return out


def held(spark, path):
    return {(r.a, r.b): r.value for r in spark.read.parquet(path).collect()}


def rows(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, *range(40)]), r.choice(["x", "y", None]), str(k), k) for k in range(n)]


def run(spark, data, path, ranges=16):
    return I.import_changed(spark.createDataFrame(data, SCHEMA).repartition(3), path, ["a", "b"], "nr", ranges)


def test_only_changed_ranges_are_copied(spark, scratch):
    path = scratch + "/t"
    data = rows(1, 200)
    assert len(run(spark, data, path).changed) > 10
    want = brute({}, data)
    assert held(spark, path) == want
    again = run(spark, data, path)
    assert again.changed == [] and again.inserted.count() == 0
    # one new key: one range
    grown = [*data, (1000, "new", "v", 500)]
    one = run(spark, grown, path)
    assert len(one.changed) == 1 and [(r.a, r.value) for r in one.inserted.collect()] == [(1000, "v")]
    # a changed value of a stored key is seen, and the stored row stays
    edited = [(a, b, "edited" if k == 0 else v, k) for a, b, v, k in grown]
    assert len(run(spark, edited, path).changed) == 1
    assert held(spark, path) == brute(want, grown)
    # rows that leave the source stay stored
    assert run(spark, edited[50:], path).inserted.count() == 0 and held(spark, path) == brute(want, grown)


def test_a_change_of_the_target_is_seen(spark, scratch):
    path = scratch + "/t"
    data = rows(2, 100)
    run(spark, data, path)
    gone = sorted(glob.glob(path + "/part=*"))[0]
    shutil.move(gone, scratch + "/gone")
    back = run(spark, data, path)
    assert len(back.changed) == 1 and held(spark, path) == brute({}, data)


def test_a_run_that_stopped_is_repeated(spark, scratch, monkeypatch):
    path = scratch + "/t"
    data = rows(3, 100)
    run(spark, data[:50], path)
    digests, calls = I.range_digests, []

    def failing(*a):
        calls.append(a)
        if len(calls) == 3:  # the rows are stored, their digests are not
            raise OSError("stopped")
        return digests(*a)

    with monkeypatch.context() as m:
        m.setattr(I, "range_digests", failing)
        with pytest.raises(OSError):
            run(spark, data, path)
    assert run(spark, data, path).inserted.count() == 0
    stored = spark.read.parquet(path)
    assert held(spark, path) == brute(brute({}, data[:50]), data) and stored.count() == stored.select("a", "b").distinct().count()
    assert run(spark, data, path).changed == []


def test_empty_source(spark, scratch):
    assert run(spark, [], scratch + "/t").changed == []
