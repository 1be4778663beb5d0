"""Folders of sheets, quoted line breaks, and uploads that make no tags."""

import datetime as dt
import os

import pytest

from ferrule.operators import ingest as I
from ferrule.plans.ingest import ingest_sheet, ingest_sheets
from ferrule.sources import sheet as SH

TAGS = "id int, name string, description string, unit_of_measure string, plant_id int, is_active boolean, data_source_id int"
STORED = "tag_id int, timestamp timestamp_ntz, value string, frequency string, quality string"


def write(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", newline="") as f:
            f.write(text)
    return folder


def tags(spark, *names):
    return spark.createDataFrame([(k + 1, n, "old", None, 1, True, 1) for k, n in enumerate(names)], TAGS)


FILES = {
    "a.csv": 'Time,P1, P2 ,p1\nx,"first\nline",,last\n,bar,NaN,psi\n1/2/2024 08:00:00,1,,7\n1/13/2024 08:00:00,,"2,5",8\njunk,9,9,9\n',
    "b.csv": "timestamp,p3\n,\n,\n13/1/2024,0\n2/1/2024,NaN\n",
    "c.csv": "clock,p4\n,\n,\n2024-01-01,1\n",
    "d.csv": "time,p5\n,\n,\nnever,1\n",
    "e.csv": 'p2,x,time of day\n"say ""hi""",,\nbar,NULL,\n3,4,2024-02-01 00:00:00\n5,6,2024-02-01 00:00:10\n',
}


def names(df):
    return df.withColumn("file", df.file.substr(-5, 5))


def test_line_breaks_in_quoted_cells(spark, scratch):
    path = os.path.join(write(scratch + "/s", {"a.csv": FILES["a.csv"]}), "a.csv")
    sheet = SH.read_sheet(spark, path)
    assert sheet.descriptions == {"p1": "last", "p2": None} and sheet.units == {"p1": "psi", "p2": None}
    rows = I.sheet_rows(sheet)
    got = sorted((r.timestamp.day, r.timestamp.month, list(r.cells)) for r in rows.collect())
    assert got == [(2, 1, ["1", None]), (13, 1, ["8", "2,5"])]


def test_folder_of_sheets(spark, scratch):
    folder = write(scratch + "/s", FILES)
    stored = spark.createDataFrame([(1, dt.datetime(2024, 1, 2, 8), "kept", "day", "GOOD")], STORED)
    r = ingest_sheets(spark, folder, tags(spark, "p1"), stored)
    melted = sorted((x.file, x.tag_name, x.timestamp, x.value) for x in names(r.melted).collect())
    assert melted == [
        ("a.csv", "p1", dt.datetime(2024, 1, 2, 8), "1"), ("a.csv", "p1", dt.datetime(2024, 1, 13, 8), "8"),
        ("a.csv", "p2", dt.datetime(2024, 1, 13, 8), "2,5"), ("b.csv", "p3", dt.datetime(2024, 1, 13), "0"),
        ("e.csv", "p2", dt.datetime(2024, 2, 1), "3"), ("e.csv", "p2", dt.datetime(2024, 2, 1, 0, 0, 10), "5"),
        ("e.csv", "x", dt.datetime(2024, 2, 1), "4"), ("e.csv", "x", dt.datetime(2024, 2, 1, 0, 0, 10), "6")]
    assert {(x.file, x.frequency) for x in names(r.files).collect()} == {("a.csv", "week"), ("b.csv", "week"), ("e.csv", "second")}
    assert {(x.file, x.reason.split(" ")[0]) for x in names(r.rejected).collect()} == {("c.csv", "No"), ("d.csv", "No")}
    made = {x.name: (x.description, x.unit_of_measure) for x in r.tags.collect()}
    assert made == {"p1": ("old", None), "p2": ("Sensor data collected at week intervals", None),
                    "p3": ("Sensor data collected at week intervals", None), "x": ("Sensor data collected at second intervals", None)}
    assert r.inserted.count() == 7 and r.snapshot.count() == 8
    counted = {x.file: (x.row_count, x.total_values, x.zero_values, x.nan_values, x.missing_tag_values, x.prepared_records)
               for x in names(r.counters).collect()}
    assert counted == {"a.csv": (2, 4, 0, 1, 0, 3), "b.csv": (2, 2, 1, 1, 0, 1), "e.csv": (2, 4, 0, 0, 0, 4)}


def test_the_first_file_wins(spark, scratch):
    folder = write(scratch + "/s", {"a.csv": "time,p\nx,from a\n,\n2024-01-01,1\n", "b.csv": "time,p\nx,from b\n,u\n2024-01-01,2\n2024-01-02,3\n"})
    r = ingest_sheets(spark, folder, tags(spark), spark.createDataFrame([], STORED))
    assert sorted((x.timestamp.day, x.value) for x in r.inserted.collect()) == [(1, "1"), (2, "3")]
    assert [tuple(x) for x in r.tags.select("name", "description", "unit_of_measure").collect()] == [("p", "from a", None)]


@pytest.mark.parametrize("folder", [False, True])
def test_unmapped_tags_are_counted_not_inserted(spark, scratch, folder):
    path = write(scratch + "/s", {"a.csv": "time,known,new\n,,\n,,\n2024-01-01,0,5\n2024-01-02,,6\n"})
    stored = spark.createDataFrame([], STORED)
    run = ingest_sheets if folder else ingest_sheet
    r = run(spark, path if folder else path + "/a.csv", tags(spark, "known"), stored, create_tags=False)
    c = r.counters.first()
    assert (c.row_count, c.total_values, c.zero_values, c.nan_values, c.missing_tag_values, c.prepared_records, c.expected_records) == (2, 2, 1, 1, 2, 1, 4)
    assert [(x.tag_id, x.value) for x in r.inserted.collect()] == [(1, "0")]
    assert [x.name for x in r.tags.collect()] == ["known"]


def test_splittable_reading_without_line_breaks(spark, scratch):
    folder = write(scratch + "/s", {"a.csv": 'time,p\n,"a, ""b"""\n,\n2024-01-01,1\n'})
    assert SH._text_shape(spark, folder, ",") == (3, False)
    assert SH._text_shape(spark, write(scratch + "/t", FILES), ",")[1] is True


def test_lines_of_a_folder_are_parsed_once_and_not_shuffled(spark, scratch):
    sheets = SH.read_sheets(spark, write(scratch + "/s", FILES))
    rows = I.folder_rows(sheets)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted((x.timestamp.day, x.timestamp.month) for x in names(rows).where("file = 'b.csv'").collect()) == [(2, 1), (13, 1)]


def test_sheets_lie_on_a_bounded_number_of_shelves(spark, scratch):
    from ferrule.plans import ingest as PI

    rows = [(dt.datetime(2024, 1, 2, 8, 0, k % 60), u, float(k), k) for k, u in enumerate([*range(0, 4000, 10), 5, 5, 12, None])]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id bigint, value double, event_id bigint").write.parquet(scratch + "/events.parquet")
    path = PI.user_sheets(spark, scratch, scratch + "/out")
    shelves = [d for d in os.listdir(path) if d.startswith("shelf=")]
    assert len(shelves) == PI.SHELVES + 1  # and the users without an id
    blocks = [d for s in shelves for d in os.listdir(os.path.join(path, s)) if d.startswith("block=")]
    assert len(blocks) == len(set(blocks)) == 401
    lines = [r.value for r in spark.read.text(path + "/shelf=0/block=0").collect()]
    assert lines[0].startswith("Timestamp,User_0,User_1,") and lines[-1].split(",")[6] == "401.0" and lines[-2].split(",")[6] == "400.0"
