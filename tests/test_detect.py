"""Change detection: tables of earlier and current rows with the expected change."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import detect
from cairn.plans import backup

ROW = "increment long, id string, path string, original_hash string, original_size long, last_modified_utc_epoch_seconds long, permissions string, owner string, `group` string, hidden boolean, file_type string, status string, archive_metadata_id string"


def row(increment, path="/a/x", h="h1", size=1, mtime=10, permissions="rw-r--r--", kind="REGULAR_FILE", status="NEW", hidden=False, owner="o"):
    return (increment, f"{increment}{path}", path, h, size, mtime, permissions, owner, "g", hidden, kind, status, f"e{increment}-{h}")


def changes(spark, history, current, by=detect.Detector()):
    old = spark.createDataFrame(history, ROW)
    new = spark.createDataFrame(current, ROW)
    return {r.cur_path: (r.change, r.prev_path, r.prev_increment) for r in detect.delta(new, old, by).collect()}


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        ({}, {}, "NO_CHANGE"),
        ({}, {"h": "h2"}, "CONTENT_CHANGED"),
        ({}, {"size": 2}, "CONTENT_CHANGED"),
        ({}, {"mtime": 11}, "METADATA_CHANGED"),
        ({}, {"hidden": True}, "METADATA_CHANGED"),
        ({}, {"owner": "p"}, "METADATA_CHANGED"),
        ({"kind": "SYMBOLIC_LINK"}, {"kind": "SYMBOLIC_LINK", "mtime": 11}, "NO_CHANGE"),
        ({"kind": "DIRECTORY", "h": None, "size": None}, {"kind": "DIRECTORY", "h": None, "size": None, "permissions": "rwx------"}, "METADATA_CHANGED"),
        ({}, {"kind": "MISSING", "h": None, "size": None}, "DELETED"),
        ({"kind": "MISSING", "h": None, "size": None}, {}, "NEW"),
        ({"status": "DELETED"}, {"h": "h9"}, "NEW"),
    ],
)
def test_classification(spark, old, new, expected):
    assert changes(spark, [row(0, **old)], [row(1, **new)])["/a/x"][0] == expected


def test_rollback_and_rename(spark):
    history = [row(0, h="one"), row(1, h="two"), row(1, "/a/z", h="three"), row(0, "/b/old", h="four"), row(1, "/b/old", h="four"), row(1, "/a/old", h="four")]
    got = changes(spark, history, [row(2, h="one"), row(2, "/a/q", h="three"), row(2, "/c/new", h="four"), row(2, "/n", h="none")])
    assert got["/a/x"] == ("ROLLED_BACK", "/a/x", 0)
    assert got["/a/q"] == ("NO_CHANGE", "/a/z", 1)
    assert got["/c/new"] == ("NO_CHANGE", "/a/old", 1)
    assert got["/n"] == ("NEW", None, None)


def test_simple_detector_compares_name_size_and_time(spark):
    by = detect.detector("NONE")
    got = changes(spark, [row(0, "/a/x", h=None), row(0, "/b/y", h=None, size=5)], [row(1, "/m/x", h=None), row(1, "/b/z", h=None, size=5)], by)
    assert got["/m/x"][:2] == ("NO_CHANGE", "/a/x")
    assert got["/b/z"] == ("NEW", None, None)


def test_null_hash_has_no_candidate(spark):
    got = changes(spark, [row(0, "/o", h=None, kind="REGULAR_FILE")], [row(1, "/p", h=None, kind="REGULAR_FILE")])
    assert got["/p"] == ("NEW", None, None)


def test_backup_plan_reuses_earlier_content(spark):
    schema = "manifest_id string, " + ROW
    conf = backup.BackupConfiguration("set", "/dest")
    first = spark.createDataFrame([("m0", *row(0)), ("m0", *row(0, "/a/y", h="h1")), ("m0", *row(0, "/d", h=None, size=None, kind="DIRECTORY"))], schema).withColumn("archive_metadata_id", F.lit(None).cast("string"))
    one = backup.plan(first, None, None, conf, 0)
    assert one["archives"].count() == 1
    history = one["files"].select(*first.columns)
    second = spark.createDataFrame([("m1", *row(1)), ("m1", *row(1, "/a/new", h="h2"))], schema).withColumn("archive_metadata_id", F.lit(None).cast("string"))
    two = backup.plan(second, history, one["archives"], conf, 1)
    at = {tuple(r.files): r.archive_location.backup_increment for r in two["archives"].collect()}
    assert at == {("1/a/x",): 0, ("1/a/new",): 1}
    assert {r.path: r.status for r in two["files"].collect()} == {"/a/x": "NO_CHANGE", "/a/new": "NEW"}


def test_configuration_is_validated():
    with pytest.raises(ValueError):
        backup.BackupConfiguration("bad prefix!", "/d")
    with pytest.raises(ValueError):
        backup.BackupConfiguration("x", "/d", hash_algorithm="CRC")
    assert backup.BackupConfiguration("x", "/d", backup_type="FULL") == backup.BackupConfiguration("x", "/d", chunk_size_mebibyte=1)
    assert backup.BackupConfiguration("x", "/d", compression="GZIP") != backup.BackupConfiguration("x", "/d")
