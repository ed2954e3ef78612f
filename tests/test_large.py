"""Queries on small tables with large values, and on more rows than one value or one machine's heap should hold."""

import gzip
import json
import os
import re
import shutil

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import cairn.store_queries  # noqa: F401
from cairn import jobs, tree_queries
from cairn.operators import sets as S
from cairn.plans import archive as A
from cairn.plans import backup as B
from cairn.schemas import ARCHIVE_ENTRIES, FILES
from cairn.queries import QUERIES
from cairn.scratch import local_path, remove_tree, scratch
from cairn.sources import manifests


@pytest.fixture(scope="module")
def long_archives(spark, tmp_path_factory):
    """Three archives of 3, 2,501 and 120,001 chunks of a million bytes."""
    folder = str(tmp_path_factory.mktemp("long"))
    rows = spark.createDataFrame([(0, 1, 2_500), (1, 1, 2_500_499), (2, 1, 60_000_000), (6, 1, 60_000_000)], "l_orderkey long, l_linenumber int, l_quantity long")
    rows.selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "1D AS l_extendedprice").write.parquet(f"{folder}/lineitem.parquet")
    return folder, {"arc0": (3, 2_500_001), "arc1": (2_501, 2_500_499_001), "arc2": (120_001, 120_000_000_002)}


def test_footers_of_many_chunks(spark, long_archives):
    folder, known = long_archives
    found = {r.prefix: (r.last_chunk, r.last_chunk_size, r.total_size) for r in QUERIES["archive_footer"](spark, folder).collect()}
    assert found == {p: (n, total - (n - 1) * 1_000_000, total) for p, (n, total) in known.items()}


def test_lists_of_many_chunks(spark, long_archives):
    folder, known = long_archives
    found = {(r.name, r.size) for r in QUERIES["chunk_list"](spark, folder).collect()}
    assert found == {(f"{p}.{i:05d}.cargo", min(1_000_000, total - (i - 1) * 1_000_000)) for p, (n, total) in known.items() for i in range(1, n + 1)}


def test_no_array_holds_the_chunks_of_an_archive(spark, tmp_path):
    """2.1 thousand million chunks are listed row by row; blocks of numbers meet without gap; an archive without chunks has none."""
    spark.createDataFrame([(0, 1, 2_100_000_000_000)], "l_orderkey long, l_linenumber int, l_quantity long").selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "1D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    some = QUERIES["chunk_list"](spark, str(tmp_path)).limit(2).collect()
    assert len(some) == 2 and all((r.prefix, r.size) == ("arc0", 1_000_000) and re.fullmatch(r"arc0\.[0-9]{5,10}\.cargo", r.name) for r in some)
    known = {"none": 0, "one": 1, "short": 65_535, "block": 65_536, "more": 65_537, "two": 131_073}
    footers = spark.createDataFrame([(p, n, 5, 9) for p, n in known.items()] + [("null", None, 5, 9)], "prefix string, last_chunk int, last_chunk_size long, max_chunk_size long")
    found = {(r.name, r.size) for r in A.expected_chunks(footers).collect()}
    assert found == {(f"{p}.{i:05d}.cargo", 5 if i == n else 9) for p, n in known.items() for i in range(1, n + 1)}


def test_violations_among_many_chunks(spark, long_archives):
    folder, known = long_archives
    found = sorted(r.name for r in QUERIES["chunk_violations"](spark, folder).collect())
    assert found == sorted(f"{p}.{i:05d}.cargo" for p, (n, _) in known.items() for i in range(1, n + 1) if i % 5 == 2 or i % 7 == 3)


def test_documents_are_read_row_by_row(spark, tmp_path):
    """As from_json reads them, whatever their order, blanks and block borders; what is no JSON to its end gives nothing."""
    many = {f"i{n}": {"id": f"i{n}", "path": f"file:///é/{n}{{}},\"", "original_size": n} for n in range(9000)}
    texts = {
        "a": json.dumps({"files": many, "backup_type": "FULL", "file_name_prefix": "a-1", "archive_entries": {"e": {"files": list(many), "original_hash": None}}}, indent=1, ensure_ascii=False),
        "b": json.dumps({"file_name_prefix": "b-2", "start_time_utc_epoch_seconds": 7, "files": {}, "archive_entries": None}),
        "cut": json.dumps({"file_name_prefix": "c-3", "files": many})[:-1],
        "more": json.dumps({"file_name_prefix": "d-4", "files": {}}) + "x",
        "nameless": json.dumps({"files": many}),
        "list": "[]",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.manifest.cargo").write_bytes(gzip.compress(text.encode()))
    read = manifests.document_tables(spark, str(tmp_path))
    held = manifests.tables(spark.createDataFrame([(texts[k],) for k in "ab"], "t string").selectExpr("t").select(F.from_json("t", manifests.DOCUMENT).alias("d")).select("d.*"))
    for name in read:
        assert sorted(map(str, read[name].collect())) == sorted(map(str, held[name].collect()))
    assert read["files"].count() == 9000 and read["manifests"].count() == 2


def test_no_task_holds_a_document(spark, tmp_path, monkeypatch):
    """Queries over documents never make one of them a value of a row."""

    def refuse(*_):
        raise AssertionError("a whole document as a value")

    for name in ("to_documents", "read_cargo", "read_documents"):
        monkeypatch.setattr(manifests, name, refuse)
    assert QUERIES["documents_round_trip"](spark, DATA).count() > 0
    assert QUERIES["manifest_file"](spark, DATA).count() > 0


def test_integrity_puts_only_split_entries_together(spark):
    """Entries of no byte, of one part and of many; a lost part leaves its bytes out of the entries that it holds."""
    rows = spark.createDataFrame([("a", n, f"/{n}", bytearray(bytes([n % 251]) * (n * 37 % 90))) for n in range(1, 200)], "prefix string, ord long, path string, raw binary")
    rows = rows.withColumn("arch_size", F.octet_length("raw").cast("bigint")).withColumn("arch_hash", F.sha2("raw", 256)).withColumn("orig_hash", F.col("arch_hash"))
    placed = A.placed(rows, 100)
    parts = A.parts(placed, 100, 30)
    back = {r.ord: r for r in A.content_of(placed.drop("raw"), parts, max_chunk=100, part=30).collect()}
    assert {n: bytes(r.content) for n, r in back.items()} == {r.ord: bytes(r.raw) for r in rows.collect()}
    lost = A.content_of(placed.drop("raw"), parts.where("NOT (number = 3 AND part = 1)"), max_chunk=100, part=30)
    short = {r.ord for r in lost.collect() if len(r.raw) != r.arch_size}
    assert short == {n for n, r in back.items() if r.abs_start < 260 and r.abs_end > 230 and r.arch_size}
    # no exchange of bytes for the sums: the offsets are made of all columns but these
    windows = [p for p in placed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window " in p]
    assert windows and not any("raw#" in p for p in windows)


def test_tasks_broadcast_no_table_that_grows(spark, monkeypatch, tmp_path):
    """Whatever Spark would broadcast; the session's setting is put back, also by a task that fails."""
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(key)
    monkeypatch.setattr(jobs, "_held", lambda spark, scope: seen.append(spark.conf.get(key)) or {}["none"])
    for task in (jobs.restore, jobs.merge):
        with pytest.raises(KeyError):
            task(spark, B.Scope(str(tmp_path), "set"))
    assert seen == ["-1", "-1"] and spark.conf.get(key) == before


def test_trees_go_when_they_were_read(spark):
    """A query of a restore leaves its rows, no tree; the first one leaves the history's backups only."""
    trees = tree_queries.history(spark, DATA)[0]
    folder = local_path(scratch(spark))
    for name in ("restored_earlier", "merged_tree"):
        assert QUERIES[name](spark, DATA).count() > 0
        assert not [n for n in os.listdir(folder) if n.startswith(("cairn-restored-", "cairn-merged-"))]
    assert os.path.isdir(f"{os.path.dirname(trees)}/backups")
    shutil.rmtree(trees, ignore_errors=True)
    tree_queries._planted.cache_clear()
    assert QUERIES["scan_tree"](spark, DATA).where("file_type = 'REGULAR_FILE'").count() == QUERIES["restored_tree"](spark, DATA).count()


def test_a_backup_compares_versions_once(spark, tmp_path):
    """Files and entries of an increment are made of one comparison that was written, and are as without it."""
    conf = B.BackupConfiguration("set", "/dest")
    none = F.lit(None)

    def scan(manifest, first, last, hashed):
        rows = spark.range(first, last).select(F.lit(manifest).alias("manifest_id"), F.concat(F.lit(manifest), "id").alias("id"), F.concat(F.lit("/a/"), "id").alias("path"), F.expr(hashed).alias("original_hash"), F.lit(3).cast("bigint").alias("original_size"), F.lit("REGULAR_FILE").alias("file_type"), F.lit(False).alias("hidden"))
        return rows.select(*[c if c in rows.columns else none.cast(FILES[c].dataType).alias(c) for c in FILES.fieldNames()])

    one = B.plan(scan("m0", 0, 60, "concat('h', id % 5)"), None, None, conf, 0)
    old, second = one["files"].withColumn("increment", F.lit(0).cast("bigint")), scan("m1", 20, 80, "concat('h', id % 7)").withColumn("increment", F.lit(1).cast("bigint"))
    kept = []

    def keep(rows, name):
        kept.append(name)
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{tmp_path}/{name}")

    two, plain = B.plan(second, old, one["archives"], conf, 1, keep), B.plan(second, old, one["archives"], conf, 1)
    assert kept == ["changes", "linked", "compared"]
    for name, columns in (("files", FILES), ("archives", ARCHIVE_ENTRIES)):
        assert "Window" not in two[name]._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, two[name].select(*columns.fieldNames()).collect())) == sorted(map(str, plain[name].select(*columns.fieldNames()).collect()))
    assert two["files"].count() == 60 and {r.status for r in two["files"].collect()} == {"NO_CHANGE", "NEW", "CONTENT_CHANGED"}


def test_tasks_leave_no_dealt_rows_behind(spark, monkeypatch, tmp_path):
    """What a query of a task dealt goes when it is done; the session's setting is put back."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key, None)
    monkeypatch.setattr(jobs, "_held", lambda spark, scope: seen.append(spark.conf.get(key)) or {}["none"])
    for task in (jobs.restore, jobs.merge):
        with pytest.raises(KeyError):
            task(spark, B.Scope(str(tmp_path), "set"))
    assert seen == ["true", "true"] and spark.conf.get(key, None) == before


def test_trees_are_removed_by_all_machines(spark, tmp_path):
    """Files beside directories, nested ones, and links, which are not followed."""
    root, other = tmp_path / "root", tmp_path / "other"
    for n in range(5):
        (root / f"d{n}/deep").mkdir(parents=True)
        (root / f"d{n}/deep/f").write_text("x")
        (root / f"f{n}").write_text("x")
    other.mkdir()
    (other / "stays").write_text("x")
    (root / "link").symlink_to(other)
    remove_tree(spark, str(root))
    assert not root.exists() and (other / "stays").exists()
    with pytest.raises(FileNotFoundError):
        remove_tree(spark, str(root))


def test_files_of_an_entry_do_not_carry_its_list(spark):
    """3,000 files of one entry: each row is as short as one of an entry that only it has; the last writer wins."""
    rows = spark.range(3000).groupBy(F.lit("e1").alias("id")).agg(F.collect_list(F.concat(F.lit("f"), "id")).alias("files"))
    entries = rows.unionByName(spark.createDataFrame([("e2", ["f7", "alone"])], "id string, files array<string>")).withColumn("archive_location", F.struct(F.lit(0).alias("backup_increment"), F.col("id").alias("entry_name")))
    found = S.entry_of_files(entries)
    assert found.columns == ["file_id", "id", "archive_location"]
    held = {r.file_id: r.archive_location.entry_name for r in found.collect()}
    assert held == {**{f"f{n}": "e1" for n in range(3000)}, "f7": "e2", "alone": "e2"}
    folded = [p for p in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "max_by" in p]
    assert folded and not any("files" in p for p in folded)


def test_staged_tables_trim_the_driver(spark, monkeypatch, tmp_path):
    """After each table that a task writes, the driver's JVM gives back what it freed outside its heap."""
    seen = []
    monkeypatch.setattr(jobs, "trim", seen.append)
    with jobs._Staging(str(tmp_path), "set") as staging:
        assert staging.keep(spark.range(3), "rows").count() == 3
    assert seen == [spark]
