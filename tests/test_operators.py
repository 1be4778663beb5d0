"""Operators on small literal frames (edge cases from FIXTURES.md section B)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ferrule.operators import frequency as FQ
from ferrule.operators import hierarchy as H
from ferrule.operators import merge as MG
from ferrule.operators import metrics as M
from ferrule.operators.ordinal import with_global_ordinal

T0 = dt.datetime(2024, 1, 1)


def _series(spark, gaps, tag=1):
    rows, t = [], T0
    rows.append((tag, t))
    for g in gaps:
        t = t + dt.timedelta(seconds=g)
        rows.append((tag, t))
    return spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz")


@pytest.mark.parametrize("gap,label", [(0.5, "sub_second"), (1, "second"), (59, "second"), (60, "minute"),
                                       (3600, "hour"), (86400, "day"), (604800, "week")])
def test_frequency_ladder_boundaries(spark, gap, label):
    df = _series(spark, [gap] * 5)
    assert FQ.frequency_by_key(df, ["tag_id"]).first()["frequency"] == label
    assert FQ.frequency_of_frame(df).first()["frequency"] == label


def test_frequency_even_count_interpolates(spark):
    # gaps 1, 2, 4, 8 (s) -> median 3.0 -> 'second'; gaps 50, 50, 70, 70 -> 60 -> 'minute'
    assert FQ.frequency_by_key(_series(spark, [1, 2, 4, 8]), ["tag_id"]).first()["frequency"] == "second"
    assert FQ.frequency_by_key(_series(spark, [50, 70, 50, 70]), ["tag_id"]).first()["frequency"] == "minute"
    assert FQ.frequency_by_key(_series(spark, [59, 59, 61, 61]), ["tag_id"]).first()["frequency"] == "minute"
    assert FQ.frequency_by_key(_series(spark, [58, 59, 60, 61]), ["tag_id"]).first()["frequency"] == "second"


def test_frequency_single_row_and_duplicates(spark):
    one = _series(spark, [])
    r = FQ.frequency_by_key(one, ["tag_id"]).first()
    assert r["frequency"] is None and r["gap_count"] == 0
    assert FQ.frequency_by_key(_series(spark, [0, 0, 0]), ["tag_id"]).first()["frequency"] == "sub_second"


def test_gaps_cross_blocks_match_plain_lag(spark):
    gaps = [1800, 4000, 30, 7200, 86400, 5, 3599]
    df = _series(spark, gaps)
    got = sorted(r["gap"] for r in FQ.consecutive_gaps(df, ["tag_id"]).collect())
    assert got == sorted(float(g) for g in gaps)


def test_keep_first_and_idempotent_merge(spark):
    ts = dt.datetime(2023, 1, 1)
    batch = spark.createDataFrame([(1, ts, "test", 0), (1, ts, "test2", 1)],
                                  "tag_id int, timestamp timestamp_ntz, value string, src_row long")
    first = MG.keep_first(batch).collect()
    assert [(r.value, r.src_row) for r in first] == [("test", 0)]
    empty = batch.limit(0).drop("src_row")
    inserted, snap = MG.merge_append(empty, batch)
    assert inserted.count() == 1
    again, snap2 = MG.merge_append(snap, batch)
    assert again.count() == 0 and snap2.count() == 1
    stored = spark.createDataFrame([(1, ts, "old")], "tag_id int, timestamp timestamp_ntz, value string")
    _, snap3 = MG.merge_append(stored, batch)
    assert [r.value for r in snap3.collect()] == ["old"]


def test_duplicate_flags(spark):
    ts = dt.datetime(2023, 1, 1)
    stored = spark.createDataFrame([(1, ts, "a")], "tag_id int, timestamp timestamp_ntz, value string")
    batch = spark.createDataFrame([(1, ts, "b"), (2, ts, "c")], "tag_id int, timestamp timestamp_ntz, value string")
    got = {r.tag_id: (r.is_duplicate, r.reason) for r in MG.duplicate_flags(batch, stored).collect()}
    assert got == {1: (True, "Duplicate entry detected."), 2: (False, None)}


def test_global_ordinal_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = with_global_ordinal(df, ["k"], name="o", start=1, num_partitions=7).orderBy("k").collect()
    assert [r.o for r in out] == list(range(1, 1001))
    assert [r.k for r in out] == list(range(1000))


def test_gapfill_spine_has_no_holes_and_locf(spark):
    rows = [(1, T0, "1"), (1, T0 + dt.timedelta(hours=3), "4"), (1, T0 + dt.timedelta(hours=5), "BAD"),
            (2, T0 + dt.timedelta(hours=1), "7")]
    s = spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz, value string")
    out = M.gapfilled_metrics(s, "1 hour").orderBy("tag_id", "bucket").collect()
    t1 = [r for r in out if r.tag_id == 1]
    assert [r.bucket for r in t1] == [T0 + dt.timedelta(hours=h) for h in range(6)]
    assert [r.sample_count for r in t1] == [1, 0, 0, 1, 0, 1]
    assert [r.interpolated_value for r in t1] == [1.0, 1.0, 1.0, 4.0, 4.0, 4.0]
    assert [r.first_value for r in t1] == [1.0, None, None, 4.0, None, None]


def test_locf_crosses_blocks(spark):
    rows = [(1, T0, "5"), (1, T0 + dt.timedelta(hours=9), "6")]
    s = spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz, value string")
    agg = M.bucket_metrics(s, "1 hour")
    bounds = agg.groupBy("tag_id").agg(F.min("bucket").alias("first_bucket"), F.max("bucket").alias("last_bucket"))
    spine = M.gapfill_spine(bounds, "1 hour", block=3)
    filled = M.carry_forward(spine.join(agg, ["tag_id", "bucket"], "left"), "avg_value", "loc")
    got = [r.loc for r in filled.orderBy("bucket").collect()]
    assert got == [5.0] * 9 + [6.0]


def test_parse_paths_worked_example(spark):
    paths = spark.createDataFrame([(0, ":Equipment:Process:Vessel:Mixer"), (1, " :A::B: "), (2, ""), (3, None),
                                   (4, "Plant:Mixer"), (5, "Equipment:Process")], "src_row long, path string")
    nodes = {r.path: r for r in H.parse_paths(paths).collect()}
    assert list(nodes) and set(nodes) == {"Equipment", "Equipment:Process", "Equipment:Process:Vessel",
                                          "Equipment:Process:Vessel:Mixer", "A", "A:B", "Plant", "Plant:Mixer"}
    assert [nodes[p].display_order for p in ("Equipment", "Equipment:Process", "Equipment:Process:Vessel",
                                             "Equipment:Process:Vessel:Mixer", "A", "A:B", "Plant",
                                             "Plant:Mixer")] == list(range(8))
    assert nodes["Plant:Mixer"].parent_label == "Plant" and nodes["Equipment"].parent_label is None
    summary = H.path_summary(paths).first()
    assert (summary.total_rows, summary.valid_paths, summary.invalid_paths) == (6, 4, 2)


def _cfg(spark, rows):
    return spark.createDataFrame(
        [(lab, path, par, i, lab, act, None) for i, (lab, path, par, act) in enumerate(rows)],
        "label string, path string, parent_label string, display_order int, display_name string, "
        "is_active boolean, icon string")


def test_integrity_orphan_cycle_self_duplicate(spark):
    cfg = _cfg(spark, [
        ("root", "root", None, True),
        ("kid", "root:kid", "root", True),
        ("orphan", "x:orphan", "ghost", True),
        ("a", "a", "b", True), ("b", "b", "a", True),       # 2-cycle
        ("c", "c", "a", True),                              # leads into the cycle
        ("s", "s", "s", True),                              # self parent
        ("d1", "dup", "root", True), ("d2", "dup", "root", True),
        ("off", "off", "root", False),
    ])
    issues, summary = H.integrity_report(cfg)
    got = {(r.issue_type, r.label or r.path) for r in issues.collect()}
    assert got == {("orphaned_records", "orphan"), ("circular_reference", "a"), ("circular_reference", "b"),
                   ("circular_reference", "c"), ("circular_reference", "s"), ("duplicate_paths", "dup")}
    s = summary.first()
    assert (s.total_records, s.orphaned, s.circular, s.duplicate_paths, s.is_valid) == (9, 1, 4, 1, False)
    clean = H.parse_paths(spark.createDataFrame([(0, "P:Q:R")], "src_row long, path string"))
    assert H.integrity_report(clean)[1].first().is_valid


def test_descendants_and_cascade_delete(spark):
    cfg = _cfg(spark, [("r", "r", None, True), ("a", "r:a", "r", True), ("b", "r:a:b", "a", True),
                       ("z", "z", None, True)])
    d = {(r.root_label, r.label): r.depth for r in H.descendants(cfg, cfg.select("label").distinct()).collect()}
    assert d == {("r", "a"): 1, ("r", "b"): 2, ("a", "b"): 1}
    labels = spark.createDataFrame([("a",)], "label string")
    remaining, deleted = H.delete_by_label(cfg, labels, cascade=True)
    assert sorted(r.label for r in remaining.collect()) == ["r", "z"]
    assert sorted(r.label for r in deleted.collect()) == ["a", "b"]
    remaining, _ = H.delete_by_label(cfg, labels)
    assert sorted(r.label for r in remaining.collect()) == ["b", "r", "z"]


def test_updates_allow_list(spark):
    cfg = _cfg(spark, [("a", "a", None, True), ("b", "b", None, True)]).withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz"))
    ch = spark.createDataFrame([("a", "New A", "x-icon", 99)], "label string, display_name string, icon string, "
                                                                "display_order int")
    out = {r.label: r for r in MG.apply_updates(cfg, ch, ["label"], ["display_name", "icon"],
                                                 "2024-01-01 00:00:00").collect()}
    assert out["a"].display_name == "New A" and out["a"].icon == "x-icon" and out["a"].display_order == 0
    assert out["a"].updated_at == dt.datetime(2024, 1, 1) and out["b"].updated_at is None


def test_retention_drops_whole_chunks(spark):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), "1") for d in range(0, 120, 5)]
    s = spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz, value string")
    kept, dropped = MG.retention(s, "2024-04-30 00:00:00", "1 month", "7 days")
    cutoff = dt.datetime(2024, 3, 30)
    for r in kept.collect():
        start = r.timestamp - dt.timedelta(days=(r.timestamp - dt.datetime(2000, 1, 3)).days % 7)
        assert start + dt.timedelta(days=7) > cutoff
    assert kept.count() + s.join(kept, ["tag_id", "timestamp"], "left_anti").count() == s.count()
    assert dropped.count() > 0


def test_lookups_tree_and_delete_all(spark):
    cfg = _cfg(spark, [("r", "r", None, True), ("a", "r:a", "r", True), ("b", "r:b", "r", False),
                       ("c", "r:a:c", "a", True), ("x", "x:r", "x", True)])
    assert [r.path for r in H.nodes_by_label(cfg, "r").collect()] == ["r"]
    assert H.nodes_by_label(cfg, "a", "r:a").count() == 1
    assert [r.label for r in H.children_of(cfg, "r").collect()] == ["a"]
    assert [r.path for r in H.active_nodes(cfg).collect()] == ["r", "r:a", "r:a:c", "x:r"]
    t = {(r.node_path, r.child_path) for r in H.tree(cfg).collect()}
    assert t == {("r", "r:a"), ("r:a", "r:a:c")}
    assert MG.delete_all(cfg).count() == 0
    assert {r.parent_label: r.child_count for r in H.child_counts(cfg).collect()} == {"r": 1, "a": 1, "x": 1}


def test_refresh_daily_rollup_overwrites_only_window(spark, scratch):
    path = os.path.join(scratch, "rollup")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    s1 = spark.createDataFrame([(1, day(1), "1"), (1, day(20), "2"), (1, day(30, 5), "3")],
                               "tag_id int, timestamp timestamp_ntz, value string")
    M.refresh_daily_rollup(s1, path, "2024-02-15 00:00:00", "2 months")
    s2 = spark.createDataFrame([(1, day(1), "100"), (1, day(20), "200"), (1, day(30, 5), "300")],
                               "tag_id int, timestamp timestamp_ntz, value string")
    lo, hi = M.refresh_daily_rollup(s2, path, "2024-02-15 00:00:00")
    assert lo == dt.datetime(2024, 1, 15) and hi == dt.datetime(2024, 2, 14, 23)
    got = {str(r.day): r.avg_value for r in spark.read.parquet(path).collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-20": 200.0, "2024-01-30": 300.0}


def test_gapfill_monthly_spine(spark):
    rows = [(1, dt.datetime(2023, 11, 15), "1"), (1, dt.datetime(2024, 3, 2), "5")]
    s = spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz, value string")
    out = M.gapfilled_metrics(s, "1 month").orderBy("bucket").collect()
    assert [r.bucket for r in out] == [dt.datetime(2023, 11, 1), dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 1),
                                       dt.datetime(2024, 2, 1), dt.datetime(2024, 3, 1)]
    assert [r.interpolated_value for r in out] == [1.0, 1.0, 1.0, 1.0, 5.0]
    ranged = M.gapfilled_metrics(s, "2 months", "2023-10-01 00:00:00", "2024-04-30 00:00:00").orderBy("bucket")
    assert [r.bucket.month for r in ranged.collect()] == [9, 11, 1, 3]


def test_global_ordinal_large_input_partial_sampling(spark):
    # enough rows that range bounds come from a partial sample
    df = spark.range(0, 300_000).select(((F.col("id") * 7919) % 300_000).alias("k"))
    out = with_global_ordinal(df, ["k"], name="o", num_partitions=16)
    bad = out.filter(F.col("o") != F.col("k")).count()
    assert bad == 0 and out.count() == 300_000


def test_cycle_walk_for_repeated_label(spark):
    cfg = _cfg(spark, [
        ("L", "a:L", "M", True),   # first active record of L (by path): walk M -> end
        ("L", "z:L", "N", True),   # walk N -> next(N) = L: returns to its own label
        ("M", "M", None, True),
        ("N", "N", "L", True),     # walk L -> M -> end
    ])
    got = {(r.label, r.path) for r in H.circular_records(cfg).collect()}
    assert got == {("L", "z:L")}


def test_tag_statistics_gapfill(spark):
    tags = spark.createDataFrame([(1, "flow", "m3/h")], "id int, name string, unit_of_measure string")
    s = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5), "1"), (1, dt.datetime(2024, 1, 3, 7), "2")],
                              "tag_id int, timestamp timestamp_ntz, value string")
    out = M.tag_statistics(s, tags, gapfill=True).orderBy("day").collect()
    assert [(r.day.day, r.data_points) for r in out] == [(1, 1), (2, 0), (3, 1)]
    assert all(r.name == "flow" for r in out)


def test_range_filter_reaches_parquet_scan(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        F.col("user_id").cast("int").alias("tag_id"), F.col("ts").alias("timestamp"), F.lit("1").alias("value"))
    q = M.bucket_metrics(ev, "1 hour", "2024-01-10 00:00:00", "2024-01-11 00:00:00")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-10T00:00)" in plan and "LessThanOrEqual(ts,2024-01-11T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_permission_checks_any_plant_and_first_time(spark):
    from ferrule.operators.access import permission_checks

    perms = spark.createDataFrame([(1, 10, "edit"), (2, 20, "view")], "user_id long, plant_id int, permission string")
    req = spark.createDataFrame([(1, 10, "edit"), (1, 20, "edit"), (1, None, "edit"), (2, None, "edit")],
                                "user_id long, plant_id int, permission string")
    users = spark.createDataFrame([(1, True)], "id long, is_active boolean")
    got = {(r.user_id, r.plant_id): r.allowed for r in permission_checks(req, perms, users).collect()}
    assert got == {(1, 10): True, (1, 20): False, (1, None): True, (2, None): False}
    nobody = users.limit(0)
    assert all(r.allowed for r in permission_checks(req, perms, nobody).collect())


def test_key_membership_delete_and_iso_output(spark):
    from ferrule.functions.timebucket import iso_format

    ts = dt.datetime(2024, 1, 1, 8, 5, 3)
    stored = spark.createDataFrame([(1, ts, "a"), (2, ts, "b")], "tag_id int, timestamp timestamp_ntz, value string")
    keys = spark.createDataFrame([(2, ts), (3, ts)], "tag_id int, timestamp timestamp_ntz")
    assert [r.tag_id for r in MG.stored_keys_in(keys, stored).collect()] == [2]
    remaining, deleted = MG.delete_keys(stored, keys, ["tag_id", "timestamp"])
    assert [r.tag_id for r in remaining.collect()] == [1] and [r.tag_id for r in deleted.collect()] == [2]
    assert stored.select(iso_format("timestamp")).first()[0] == "2024-01-01T08:05:03"


def test_walks_without_a_depth_cap(spark):
    """A 300-deep chain and a 200-label cycle."""
    chain = [(f"c{i}", f"p{i}", f"c{i - 1}" if i else None, True) for i in range(300)]
    ring = [(f"r{i}", f"q{i}", f"r{(i + 1) % 200}", True) for i in range(200)]
    cfg = _cfg(spark, chain + ring)
    roots = spark.createDataFrame([("c0",), ("r0",)], "label string")
    got = {(r.root_label, r.label): r.depth for r in H.descendants(cfg, roots).collect()}
    assert got[("c0", "c299")] == 299 and got[("r0", "r0")] == 200 and got[("r0", "r199")] == 1
    assert len(got) == 299 + 200
    assert {r.label for r in H.circular_records(cfg).collect()} == {f"r{i}" for i in range(200)}


def test_keys_and_bounds_in_another_zone(spark):
    ts = dt.datetime(2024, 1, 1, 12)
    schema = "tag_id int, timestamp timestamp_ntz, value string, src_row long"
    old = spark.createDataFrame([(1, ts, "a", 1)], schema)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        inserted, snapshot = MG.merge_append(old, spark.createDataFrame([(1, ts, "b", 1)], schema))
        assert inserted.count() == 0 and snapshot.count() == 1
        assert MG.duplicate_flags(old, old).first().is_duplicate
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_averages_keep_every_digit(spark):
    from ferrule.functions.numeric import exact_avg

    for texts, want in ((["0.00000000001", "0.00000000003"], 2e-11), (["1.25", "2.25", "x"], 1.75),
                        (["9" * 30, "1"], 5e29), (["x"], None), (["9" * 27 + ".5", "0.5"], 5e26)):
        got = spark.createDataFrame([(t,) for t in texts], "v string").agg(exact_avg("v")).first()[0]
        assert got == want if want is None else abs(got - want) <= 1e-12 * want


def test_updates_fold_and_set_null(spark):
    import pytest

    df = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", None)], "id int, name string, icon string, plant_id int")
    rows = [(1, 1, "n1", "i1", ["name", "icon"]), (1, 2, "n2", None, ["name"]), (2, 1, None, None, ["icon"])]
    ch = spark.createDataFrame(rows, "id int, nr int, name string, icon string, f array<string>")
    got = {r.id: (r.name, r.icon) for r in MG.apply_updates(df, ch, ["id"], ["name", "icon"], order="nr", given="f").collect()}
    assert got == {1: ("n2", "i1"), 2: ("b", None)}
    with pytest.raises(ValueError):
        MG.apply_updates(df, ch, ["id"], ["name"])
    assert [r.id for r in MG.delete_all(df, 1).collect()] == [2]


def test_cluster_sessions_need_a_shared_folder(spark, monkeypatch):
    import pytest

    from ferrule import session

    monkeypatch.setattr(session, "checkpoint_dir", lambda s: None)

    class Conf:
        @staticmethod
        def get(key, default=None):
            return "spark://somewhere:7077"

    class Other:
        conf = Conf

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Other)
