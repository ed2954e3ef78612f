"""Backups, restores, merges and deletions on real trees."""

import gzip
import hashlib
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cairn import cli, jobs
from cairn.errors import ArchivalError, CryptoError
from cairn.plans import backup as B
from cairn.plans import increments as I
from cairn.sources import archive_files, filesystem, keys, manifests


def tree_of(root):
    """Path below the root to what is there: bytes, a link's target, or a directory's permissions."""
    out = {}
    for folder, dirs, names in os.walk(root):
        for n in [*dirs, *names]:
            p = os.path.join(folder, n)
            out[os.path.relpath(p, root)] = ("link", os.readlink(p)) if os.path.islink(p) else ("dir", oct(os.stat(p).st_mode)) if os.path.isdir(p) else ("file", open(p, "rb").read(), oct(os.stat(p).st_mode), int(os.stat(p).st_mtime))
    return out


@pytest.fixture()
def source(tmp_path):
    root = tmp_path / "data"
    for k in range(12):
        p = root / f"d{k % 3}" / f"f{k}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"same" if k % 4 == 0 else os.urandom(300_000) if k == 5 else f"own {k} \u00e4".encode() * k)
        os.utime(p, (1_600_000_000 + k, 1_500_000_000 + k))
    (root / "empty").write_bytes(b"")
    (root / "d1/f1.txt").chmod(0o600)
    os.link(root / "d0/f0.txt", root / "d0/hard.txt")
    os.symlink(root / "d0/f0.txt", root / "inside")
    os.symlink("/etc/hostname", root / "outside")
    return root


def job(source, tmp_path, **more):
    return B.BackupConfiguration(**{"file_name_prefix": "set", "destination_directory": str(tmp_path / "dest"), "chunk_size_mebibyte": 1, "sources": (B.Source(str(source)),), **more})


def change(root):
    (root / "d0/f3.txt").write_text("changed")
    os.rename(root / "d1/f4.txt", root / "d2/moved.txt")
    os.remove(root / "d2/f8.txt")
    (root / "new").mkdir()
    (root / "new/one").write_text("brand new")


@pytest.mark.parametrize("more", [{"compression": "GZIP", "hash_algorithm": "SHA512"}, {"compression": "BZIP2", "duplicate_strategy": "KEEP_EACH", "hash_algorithm": "NONE"}])
def test_increments_come_back(spark, tmp_path, source, more):
    conf = job(source, tmp_path, **more)
    first = tree_of(source)
    n = {r.status: r["count"] for r in jobs.backup(spark, conf, now=1000).collect()}
    assert n == {"NEW": len(first) + 1}
    change(source)
    second = tree_of(source)
    n = {r.status: r["count"] for r in jobs.backup(spark, conf, now=2000).collect()}
    assert n["CONTENT_CHANGED"] == 1 and n["NEW"] >= 2 and sum(n.values()) == len(second) + 1
    # what did not change is stored once: the second archive holds the new content only
    rows = spark.read.parquet(f"{conf.destination_directory}/archive_index").where("manifest_id = 'set-2000' AND content IS NOT NULL")
    assert rows.count() <= 4
    for at, want in ((1500, first), (2500, second)):
        goal = tmp_path / f"back{at}"
        left = jobs.restore(spark, B.Scope(conf.destination_directory, "set", at), [(str(source), str(goal))])
        assert left.collect() == []
        inside = {k: ("link", str(goal / "d0/f0.txt")) if k == "inside" else v for k, v in want.items()}
        assert tree_of(goal) == inside
        # each is an entry of its own if all are kept, so nothing tells that they are one file
        assert (os.stat(goal / "d0/f0.txt").st_ino == os.stat(goal / "d0/hard.txt").st_ino) is ("duplicate_strategy" not in more)
    # a changed file is put right again, and what is left over goes
    (goal / "d0/f3.txt").write_text("spoilt")
    (goal / "left/over").mkdir(parents=True)
    plan = jobs.restore(spark, B.Scope(conf.destination_directory, "set"), [(str(source), str(goal))], delete_missing=True, dry_run=True)
    assert {r.path for r in plan.collect() if r.op == "delete"} == {str(goal / "left"), str(goal / "left/over")}
    assert (goal / "left/over").exists()
    jobs.restore(spark, B.Scope(conf.destination_directory, "set"), [(str(source), str(goal))], delete_missing=True)
    assert tree_of(goal) == inside


def test_part_of_a_backup(spark, tmp_path, source):
    conf = job(source, tmp_path)
    jobs.backup(spark, conf, now=1000)
    goal = tmp_path / "part"
    jobs.restore(spark, B.Scope(conf.destination_directory, "set"), [(str(source), str(goal))], include=str(source / "d1"))
    assert set(tree_of(goal)) == {"d1", *(f"d1/f{k}.txt" for k in (1, 4, 7, 10))}


def test_merge_and_delete(spark, tmp_path, source):
    conf = job(source, tmp_path, compression="GZIP")
    jobs.backup(spark, conf, now=1000)
    change(source)
    jobs.backup(spark, conf, now=2000)
    (source / "third").write_text("3")
    jobs.backup(spark, conf, now=3000)
    want, dest = tree_of(source), conf.destination_directory
    got = jobs.merge(spark, B.Scope(dest, "set", first=1000, last=3000), delete_obsolete=True)
    assert {(r.manifest_id, r.action) for r in got.collect()} == {("set-1000-3000", "create"), *((f"set-{k}", "delete") for k in (1000, 2000, 3000))}
    assert {n for n in os.listdir(dest) if n.endswith(".cargo")} == {"set-1000-3000.00001.cargo", "set-1000-3000.index.cargo", "set-1000-3000.manifest.cargo"}
    index, footer = archive_files.read_index(spark, dest, "set-1000-3000")
    archive_files.check_chunks(spark, dest, footer)
    assert {r.path for r in index.where("type = 'DIRECTORY'").collect()} == {"/0", "/1", "/2"}
    goal = tmp_path / "back"
    jobs.restore(spark, B.Scope(dest, "set"), [(str(source), str(goal))])
    assert {k: v for k, v in tree_of(goal).items() if k != "inside"} == {k: v for k, v in want.items() if k != "inside"}
    # the chain goes on
    (source / "fourth").write_text("4")
    n = {r.status: r["count"] for r in jobs.backup(spark, conf, now=4000).collect()}
    assert n["NEW"] == 1 and I.as_of(jobs.known_tables(spark, dest, "set")["manifests"]).count() == 2
    assert [r.manifest_id for r in jobs.delete(spark, B.Scope(dest, "set", first=4000)).collect()] == ["set-4000"]
    assert jobs.known_tables(spark, dest, "set")["manifests"].count() == 1
    with pytest.raises(I.ChainError):
        jobs.reload(spark, dest, "set-4000")
    assert jobs.reload(spark, dest, "set-1000-3000")["files"].count() == len(want) + 1


def test_a_changed_configuration_begins_a_chain(spark, tmp_path, source):
    jobs.backup(spark, job(source, tmp_path), now=1000)
    jobs.backup(spark, job(source, tmp_path, chunk_size_mebibyte=7), now=2000)
    jobs.backup(spark, job(source, tmp_path, hash_algorithm="MD5"), now=3000)
    heads = jobs.known_tables(spark, str(tmp_path / "dest"), "set")["manifests"]
    assert [(r.backup_type, r.backup_versions) for r in heads.orderBy(I.START).collect()] == [("FULL", [0]), ("INCREMENTAL", [1]), ("FULL", [0])]
    with pytest.raises(ArchivalError):
        jobs.backup(spark, job(source, tmp_path, hash_algorithm="MD5"), now=3000)


def test_files_of_an_increment(spark, tmp_path, source):
    conf = job(source, tmp_path)
    jobs.backup(spark, conf, now=1000)
    dest = conf.destination_directory
    document = json.load(gzip.open(f"{dest}/.history/set-1000.manifest.json.gz"))
    assert len(document["files"]) == len(tree_of(source)) + 1 and document["backup_type"] == "FULL"
    assert open(f"{dest}/set-1000.manifest.cargo", "rb").read() == open(f"{dest}/.history/set-1000.manifest.json.gz", "rb").read()
    back = manifests.tables(manifests.read_cargo(spark, dest))
    assert {r.path for r in back["files"].collect()} == {str(source), *(str(source / k) for k in tree_of(source))}
    index, footer = archive_files.read_index(spark, dest, "set-1000")
    rows = index.where("content IS NOT NULL").select("prefix", "path", "type", "content.*").collect()
    data = open(f"{dest}/set-1000.00001.cargo", "rb").read()
    assert all(hashlib.sha256(data[r.abs_start : r.abs_end]).hexdigest() == r.arch_hash for r in rows)
    assert footer.first().total_size == len(data) and footer.first().n_entities == len(rows) + 1
    assert not [n for n in os.listdir(dest) if n.startswith(".staging")]


def test_spoilt_archives_are_noticed(spark, tmp_path, source):
    conf = job(source, tmp_path)
    jobs.backup(spark, conf, now=1000)
    name = f"{conf.destination_directory}/set-1000.00001.cargo"
    data = bytearray(open(name, "rb").read())
    data[10] ^= 1
    open(name, "wb").write(data)
    heads = jobs.known_tables(spark, conf.destination_directory, "set")["manifests"]
    with pytest.raises(Exception, match="do not match the index"):
        jobs.contents(spark, conf.destination_directory, heads).write.format("noop").mode("overwrite").save()
    open(name, "wb").write(data[:-1])
    with pytest.raises(Exception, match="chunks are missing or have another size"):
        archive_files.check_chunks(spark, conf.destination_directory, archive_files.read_index(spark, conf.destination_directory, "set-1000")[1])


def test_encrypted_backups(spark, tmp_path, source, monkeypatch):
    monkeypatch.setenv("CAIRN_STORE_PASSWORD", "secret word")
    store = str(tmp_path / "store.p12")
    made = cli.main(["gen-keys", "--key-store", store], spark).first()
    private = keys.read_private_key(spark, store, "default", "secret word")
    keys.verify(spark, keys.read_public_key(spark, store, "default", "secret word"), private)
    with pytest.raises(CryptoError):
        keys.verify(spark, keys.key_pair(spark, 2048).getPublic(), private)
    conf = job(source, tmp_path, encryption_key=made.public_key, compression="GZIP")
    jobs.backup(spark, conf, now=1000)
    change(source)
    jobs.backup(spark, conf, now=2000)
    assert not [n for n in os.listdir(conf.destination_directory) if n.endswith("01.cargo") and b"brand new" in open(f"{conf.destination_directory}/{n}", "rb").read()]
    with pytest.raises(ArchivalError):
        jobs.restore(spark, B.Scope(conf.destination_directory, "set"), [(str(source), str(tmp_path / "no"))])
    jobs.merge(spark, B.Scope(conf.destination_directory, "set", first=1000, last=2000), delete_obsolete=True)
    goal = tmp_path / "back"
    cli.main(["restore", "--backup-source", conf.destination_directory, "--prefix", "set", "--target-mapping", f"{source}={goal}", "--key-store", store], spark)
    assert {k: v for k, v in tree_of(goal).items() if k != "inside"} == {k: v for k, v in tree_of(source).items() if k != "inside"}
    assert keys.index_key({0: {0: b"a"}, 1: {0: b"b"}}, [1, 0]) == b"a" and keys.data_key(None, 0, 3) is None


def test_parameters_are_checked(tmp_path):
    for bad in ({"prefix": "a b"}, {"prefix": "a", "at": 0}, {"prefix": "a", "at": int(time.time()) + 100}, {"prefix": "a", "first": 5, "last": 5}):
        with pytest.raises(ValueError):
            B.Scope(str(tmp_path), **bad)


def test_what_a_manifest_must_not_be(spark):
    heads = spark.createDataFrame([("a-1", "1.0.0", 1, "FULL", [0]), ("bad", "x", -1, "HALF", [])], f"manifest_id string, app_version string, {I.START} long, backup_type string, backup_versions array<int>")
    files = spark.createDataFrame([("a-1",)], "manifest_id string")
    assert {(r.manifest_id, r.why) for r in jobs.validate(heads, files).collect()} == {("bad", w) for w in ("no file", "a bad id", "no version", "a negative start", "an unknown type", "no application version")}


def test_large_files_go_over_several_chunks(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    for k in range(3):
        (root / f"big{k}").write_bytes(os.urandom((3 << 20) + 17 * k))
    conf = job(root, tmp_path)
    jobs.backup(spark, conf, now=1000)
    sizes = sorted(os.path.getsize(f"{conf.destination_directory}/{n}") for n in os.listdir(conf.destination_directory) if n.endswith(".cargo") and n[-7].isdigit())
    assert len(sizes) == 10 and sizes[1:] == [1 << 20] * 9
    jobs.restore(spark, B.Scope(conf.destination_directory, "set"), [(str(root), str(tmp_path / "back"))])
    assert tree_of(root) == tree_of(tmp_path / "back")


def test_numbers_follow_an_order(spark, tmp_path):
    spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k")).repartition(7).write.parquet(str(tmp_path / "rows"))
    got = archive_files.numbered(spark.read.parquet(str(tmp_path / "rows")), F.col("k"), 5).orderBy("k").collect()
    assert [r.ord for r in got] == list(range(5, 1005))
    assert archive_files.numbered(spark.read.parquet(str(tmp_path / "rows")).limit(0), F.col("k"), 5).count() == 0


def test_content_of_files(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    os.symlink("/x/y", tmp_path / "l")
    rows = spark.createDataFrame([(str(tmp_path / "f"), "REGULAR_FILE"), (str(tmp_path / "l"), "SYMBOLIC_LINK"), (str(tmp_path), "DIRECTORY")], "path string, file_type string")
    assert [bytes(r.content) for r in archive_files.with_bytes(rows, "path", "file_type").collect()] == [b"abc", b"/x/y", b""]
    assert filesystem.parse(str(tmp_path / "l"))[10] == "SYMBOLIC_LINK"


def test_entries_of_very_many_files_are_several_rows(spark, tmp_path, source, monkeypatch):
    from cairn.operators import dedup

    monkeypatch.setattr(dedup, "MEMBERS", 2)
    conf = job(source, tmp_path)
    jobs.backup(spark, conf, now=1000)
    held = jobs.reload(spark, conf.destination_directory, "set-1000")
    rows = held["archive_entries"].select("id", F.explode("files").alias("file"))
    assert held["archive_entries"].count() > held["archive_entries"].select("id").distinct().count()
    links = held["files"].where("archive_metadata_id IS NOT NULL").select(F.col("archive_metadata_id").alias("id"), F.col("id").alias("file"))
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in links.collect()} and rows.count() == links.count()
    document = json.load(gzip.open(f"{conf.destination_directory}/.history/set-1000.manifest.json.gz"))
    assert sum(len(e["files"]) for e in document["archive_entries"].values()) == links.count()
    jobs.restore(spark, B.Scope(conf.destination_directory, "set"), [(str(source), str(tmp_path / "back"))])
    assert {k: v for k, v in tree_of(tmp_path / "back").items() if k != "inside"} == {k: v for k, v in tree_of(source).items() if k != "inside"}
