"""Readers, writers and storage maintenance on small local files."""

import datetime as dt
import glob
import os
import shutil

from pyspark.sql import functions as F

from ferrule.operators.hierarchy import replace_hierarchy, resolve_icons
from ferrule.sources import sheet as S
from ferrule.sources import storage as ST


def test_record_readers(spark, scratch):
    csv = os.path.join(scratch, "r.csv")
    with open(csv, "w") as fh:
        fh.write("a,b\n1,x\n2,y\n")
    assert [r.b for r in S.read_csv_records(spark, csv).orderBy("a").collect()] == ["x", "y"]
    xml = os.path.join(scratch, "r.xml")
    with open(xml, "w") as fh:
        fh.write("<root><record><a>1</a><b>x</b></record><record><a>2</a><b>y</b></record></root>")
    assert sorted(r.b for r in S.read_xml_records(spark, xml).collect()) == ["x", "y"]
    js = os.path.join(scratch, "r.json")
    with open(js, "w") as fh:
        fh.write('[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]')
    assert sorted(r.b for r in S.read_json_records(spark, js).collect()) == ["x", "y"]


def test_split_and_catalog(spark, scratch):
    df = spark.range(0, 25).withColumn("v", F.col("id") * 2)
    out = os.path.join(scratch, "split")
    ST.split_csv(df.coalesce(1), out, rows_per_file=10)
    assert len(glob.glob(os.path.join(out, "*.csv"))) == 3
    cols = {r.column_name: r.data_type for r in ST.list_columns(df).collect()}
    assert cols == {"id": "bigint", "v": "bigint"}
    df.createOrReplaceTempView("ferrule_tmp_view")
    assert "ferrule_tmp_view" in [r.name for r in ST.list_tables(spark).collect()]


def _series(spark):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), str(d)) for d in range(0, 60) for h in (0, 12)]
    return spark.createDataFrame(rows, "tag_id int, timestamp timestamp_ntz, value string")


def test_layout_pruning_retention_compaction(spark, scratch):
    path = os.path.join(scratch, "ts")
    interval = ST.write_series(_series(spark), path, frequency="minute")
    assert interval == "7 days"
    got = ST.read_series(spark, path, "2024-01-10 00:00:00", "2024-01-12 23:59:59")
    assert got.count() == 6
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("], PushedFilters")[0]
    assert "chunk" in filters and "width" in filters
    before = sorted((r.tag_id, r.timestamp, r.value) for r in spark.read.parquet(path).collect())
    # what a stopped compaction leaves: one swap not begun again, one not cleaned up
    folders = [f for f in sorted(glob.glob(path + "/plant_id=1/width=*/chunk=*"))]
    os.rename(folders[0], folders[0].replace("chunk=", "_old_chunk="))
    shutil.copytree(folders[1], folders[1].replace("chunk=", "_old_chunk="))
    chunks = ST.compact_chunks(spark, path, "2024-02-01 00:00:00")
    assert 0 < chunks.count() < len(folders)
    assert sorted((r.tag_id, r.timestamp, r.value) for r in spark.read.parquet(path).collect()) == before
    assert not glob.glob(path + "/plant_id=1/width=*/_old*") and not os.path.exists(path + "/_compacting")
    dropped = ST.drop_expired_chunks(spark, path, "2024-03-15 00:00:00", "1 month")
    left = spark.read.parquet(path)
    assert dropped and left.agg(F.min("timestamp")).first()[0] >= dt.datetime(2024, 2, 5)


def test_import_whitelist(spark):
    ts = dt.datetime(2024, 1, 1)
    schema = "tag_id int, timestamp timestamp_ntz, value string"
    src = {"time_series": spark.createDataFrame([(1, ts, "a"), (2, ts, "b")], schema),
           "tags": spark.createDataFrame([], "id int, name string"),
           "alerts": spark.createDataFrame([(1,)], "id int")}
    tgt = {"time_series": spark.createDataFrame([(1, ts, "old")], schema)}
    out = ST.import_tables(src, tgt)
    assert set(out) == {"time_series"}
    inserted, snap = out["time_series"]
    assert [r.tag_id for r in inserted.collect()] == [2] and snap.count() == 2


def test_icon_resolution_and_replace(spark):
    cfg = spark.createDataFrame([("a", "a", "pump"), ("b", "b", "/abs/x.svg"), ("c", "c", "none")],
                                "label string, path string, icon string")
    files = spark.createDataFrame([("pump_1a2b.svg", "/icons/pump_1a2b.svg")], "file_name string, file_path string")
    got = {r.label: r.icon for r in resolve_icons(cfg, files).collect()}
    assert got == {"a": "/icons/pump_1a2b.svg", "b": "/abs/x.svg", "c": "none"}
    dup = spark.createDataFrame([("x", "p"), ("y", "p")], "label string, path string")
    try:
        replace_hierarchy(cfg, dup)
        raise AssertionError("duplicate paths must be refused")
    except ValueError:
        pass


def test_merge_into_layout(spark, scratch):
    path = os.path.join(scratch, "ts")
    schema = "tag_id int, timestamp timestamp_ntz, value string, src_row long"
    ts = dt.datetime(2024, 1, 1)
    b1 = spark.createDataFrame([(1, ts, "a", 1), (1, ts, "a2", 2), (2, ts, "b", 3)], schema)
    assert ST.merge_into_layout(spark, path, b1, "7 days").count() == 2
    b2 = spark.createDataFrame([(1, ts, "late", 1), (3, ts + dt.timedelta(days=30), "c", 2)], schema)
    assert [r.tag_id for r in ST.merge_into_layout(spark, path, b2, "7 days").collect()] == [3]
    assert ST.merge_into_layout(spark, path, b2, "7 days").count() == 0  # idempotent
    got = sorted((r.tag_id, r.value) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a"), (2, "b"), (3, "c")]


def test_read_series_iso_bounds(spark, scratch):
    path = os.path.join(scratch, "ts")
    interval = ST.write_series(_series(spark), path, frequency="minute")
    got = ST.read_series(spark, path, "2024-01-10T00:00:00Z", "2024-01-12T23:59:59+00:00")
    assert got.count() == 6
