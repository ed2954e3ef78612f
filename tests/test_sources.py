"""Scans, manifests, keys, streams, paths and increments."""

import gzip
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from cairn import fixtures as X
from cairn.functions import paths as P
from cairn.plans import increments as I
from cairn.sources import filesystem, keys, manifests
from cairn.streaming.increments import LatestState


@pytest.fixture()
def tree(tmp_path):
    for name in ("a/one.txt", "a/.hidden.txt", "a/deep/two.log", "b/three.txt", "skip/four.txt"):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    os.symlink(tmp_path / "root/a/one.txt", tmp_path / "root/a/link")
    os.symlink(tmp_path / "nowhere", tmp_path / "root/a/broken")
    return tmp_path / "root"


def scan(spark, root, **options):
    spark.dataSource.register(filesystem.FileTree)
    reader = spark.read.format("file_tree").option("root", str(root))
    for k, v in options.items():
        reader = reader.option(k, v)
    return {r.path.removeprefix(str(root)) or "/": r for r in reader.load().collect()}


def test_scan_lists_all_but_broken_links(spark, tree):
    rows = scan(spark, tree)
    assert set(rows) == {"/", "/a", "/a/.hidden.txt", "/a/deep", "/a/deep/two.log", "/a/link", "/a/one.txt", "/b", "/b/three.txt", "/skip", "/skip/four.txt"}
    assert rows["/a/link"].file_type == "SYMBOLIC_LINK"
    assert rows["/a/.hidden.txt"].hidden
    assert rows["/a"].original_hash is None
    assert re.fullmatch("([r-][w-][x-]){3}", rows["/b/three.txt"].permissions)


def test_scan_with_patterns_keeps_parents_and_prunes_excluded(spark, tree):
    rows = scan(spark, tree, include="**.txt", exclude="skip\n**/.hidden*")
    assert set(rows) == {"/", "/a", "/a/one.txt", "/b", "/b/three.txt"}


def test_restore_targets_of_sources():
    assert filesystem.target_roots(["/a/b", "/a/c/", "/z"], [("/a", "/r"), ("/a/b/", "/deep")]) == ["/deep", "/r/c", "/z"]


def test_missing_path_gives_a_missing_row(tmp_path):
    assert filesystem.parse(str(tmp_path / "gone"))[10] == "MISSING"


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("*.txt", ["a.txt"], ["d/a.txt", "a.log"]), ("**.txt", ["a.txt", "d/a.txt"], ["a.log"]), ("d/?.txt", ["d/a.txt"], ["d/ab.txt", "d//.txt"]), ("[a-c]*", ["bx"], ["dx"]), ("[!a]x", ["bx"], ["ax", "/x"]), ("{one,two}/*", ["one/z"], ["three/z"]), (r"\*", ["*"], ["a"])],
)
def test_globs(pattern, yes, no):
    regex = re.compile(P.glob_to_regex(pattern))
    assert all(regex.match(x) for x in yes)
    assert not any(regex.match(x) for x in no)


def test_a_path_is_no_prefix_of_itself(spark):
    r = spark.range(1).select(P.is_under(F.lit("/a"), F.lit("/a")).alias("a"), P.is_under(F.lit("/a/b"), F.lit("/a")).alias("b"), P.is_under(F.lit("/ab"), F.lit("/a")).alias("c"), P.is_at_or_under(F.lit("/a"), F.lit("/a")).alias("d")).first()
    assert tuple(r) == (False, True, False, True)


def test_drive_letters_and_systems(spark):
    r = spark.range(1).select(P.from_uri(F.lit("file:///C:/x y")).alias("a"), P.to_uri(F.lit("C:/x")).alias("b"), P.from_uri(F.lit("http://x")).alias("c"), P.operating_system(F.lit("Darwin")).alias("d"), P.resolve_dots(F.lit("/a//b/../c/./d/")).alias("e"), P.parent(F.lit("/a")).alias("f")).first()
    assert tuple(r) == ("C:/x y", "file:///C:/x", None, "WINDOWS", "/a/c/d", None)


def test_versions_order_by_component(spark):
    rows = spark.createDataFrame([("0.9.12",), ("0.10.0",), ("bad",)], "v string")
    assert rows.agg(F.max(P.app_version(F.col("v")))).first()[0].minor == 10


def test_manifests_round_trip(spark, tmp_path):
    heads = spark.createDataFrame([("set-1", "0.10.0", 1, "FULL", [0])], "manifest_id string, app_version string, start_time_utc_epoch_seconds long, backup_type string, backup_versions array<int>")
    files = spark.createDataFrame([("set-1", "i1", "/a b", 5, "REGULAR_FILE", "e1"), ("set-1", "i2", "/a", None, "DIRECTORY", None)], "manifest_id string, id string, path string, original_size long, file_type string, archive_metadata_id string")
    for f in manifests.FILES:
        if f.name not in files.columns:
            files = files.withColumn(f.name, F.lit(None).cast(f.dataType))
    entries = spark.createDataFrame([("set-1", "e1", (0, "n1"), "h", "h", ["i1"])], manifests.ARCHIVE_ENTRIES)
    (document,) = [r.document for r in manifests.to_documents(heads, files, entries).collect()]
    assert json.loads(document)["files"]["i1"]["path"] == "file:///a b"
    with gzip.open(tmp_path / "set-1.manifest.json.gz", "wt") as f:
        f.write(document)
    (tmp_path / "set-1.manifest.cargo").write_bytes(gzip.compress(document.encode()))
    for read in (manifests.read_documents, manifests.read_cargo):
        back = manifests.tables(read(spark, str(tmp_path)))
        assert {r.path: r.original_size for r in back["files"].collect()} == {"/a b": 5, "/a": None}
        assert back["archive_entries"].first().archive_location.entry_name == "n1"
        assert back["manifests"].first().backup_versions == [0]


def test_chain_errors(spark):
    heads = X.manifests(spark)
    with pytest.raises(I.ChainError):
        I.checked_chain(heads.where("start_time_utc_epoch_seconds <> 2000").where("start_time_utc_epoch_seconds < 5000"))
    with pytest.raises(I.ChainError):
        I.checked_chain(heads.limit(0))
    with pytest.raises(I.ChainError):
        I.until_next_full(heads, 1234)
    with pytest.raises(ValueError):
        I.merge_selection(heads, 2000, 2000)
    with pytest.raises(I.ChainError):
        I.merge_selection(heads, 2000, 2001)
    assert I.latest_at(heads, 1).isEmpty()


def test_next_header(spark):
    assert I.next_header(spark, None, "p", 9, "1.0.0", True).first().backup_type == "FULL"
    chain = I.as_of(X.manifests(spark), 3500)
    made = I.next_header(spark, chain, "p", 9, "1.0.0", True).first()
    assert (made.backup_type, made.backup_versions) == ("INCREMENTAL", [3])
    assert I.next_header(spark, chain, "p", 9, "1.0.0", False).first().backup_versions == [0]


def test_summary_text(spark):
    conf = "job_configuration struct<encryption_key:string,hash_algorithm:string,compression:string>"
    heads = spark.createDataFrame([("p-5", "FULL", 5, [0, 1], None, (None, "SHA256", "GZIP"))], f"manifest_id string, backup_type string, {I.START} long, backup_versions array<int>, operating_system string, {conf}")
    files = spark.createDataFrame([("p-5", 3 << 20), ("p-5", None)], "manifest_id string, original_size long")
    assert I.summary_text(heads, files).first().summary == "FULL backup: p-5\n\tStarted at : 1970-01-01T00:00:05Z (Epoch seconds: 5)\n\tContains 2 files (3 MiB)\n\tVersions   : [0, 1]\n\tOS name    : unknown\n\tEncrypted  : false\n\tHash alg.  : SHA256\n\tCompression: GZIP"


def test_keys_are_wrapped_and_unwrapped(spark):
    pair = keys.key_pair(spark, 2048)
    own = keys.new_key()
    assert keys.unwrap(spark, keys.wrap(spark, own, pair.getPublic()), pair.getPrivate()) == own


def test_stream_keeps_the_latest_state(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(0, "i", "/a"), (0, "j", "/b")], "increment long, id string, path string").write.parquet(source)
    state = LatestState(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema("increment long, id string, path string").parquet(source)
    state.start(stream, str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([(1, "k", "/a")], "increment long, id string, path string").write.mode("append").parquet(source)
    state.start(spark.readStream.schema("increment long, id string, path string").parquet(source), str(tmp_path / "check")).awaitTermination()
    assert {(r.path, r.increment) for r in state.read().collect()} == {("/a", 1), ("/b", 0)}


def test_a_restarted_stream_keeps_its_state(spark, tmp_path):
    schema = "increment long, id string, path string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    LatestState(spark, str(tmp_path), buckets=4).apply(make((0, "i", "/a"), (0, "j", "/b")), 0)
    again = LatestState(spark, str(tmp_path), buckets=4)
    again.apply(make((1, "k", "/a")), 1)
    again.apply(make((2, "never", "/a")), 1)
    assert {tuple(r) for r in again.read().select("increment", "id", "path").collect()} == {(1, "k", "/a"), (0, "j", "/b")}
    assert len(again.vacuum()) == 1
    assert {tuple(r) for r in LatestState(spark, str(tmp_path), buckets=4).read().select("increment", "id", "path").collect()} == {(1, "k", "/a"), (0, "j", "/b")}


@pytest.mark.parametrize("bound", [1000, 0])
def test_latest_for_each_time(spark, bound):
    heads = spark.createDataFrame([(f"p-{s}", s) for s in (5, 10, 3 << 20, 9 << 20)], f"manifest_id string, {I.START} long")
    times = spark.createDataFrame([(t,) for t in (1, 5, 9, 10, 3 << 20, (3 << 20) - 1, 8 << 20, 1 << 40)], "at long")
    got = {r.at: r.manifest_id for r in I.latest_for_each(times, heads, bound).collect()}
    assert got == {1: None, 5: "p-5", 9: "p-5", 10: "p-10", 3 << 20: f"p-{3 << 20}", (3 << 20) - 1: "p-10", 8 << 20: f"p-{3 << 20}", 1 << 40: f"p-{9 << 20}"}
    assert I.latest_for_each(times, heads.limit(0), bound).where("manifest_id IS NOT NULL").count() == 0
