"""The tasks end to end: backup, restore, merge, inspection, deletion (S16-S36, tasks of the command line).

A backup folder holds the tables (manifests, files, archive_entries, archive_index: Parquet by manifest) and, for each
increment, its archive as files: chunks, an index and a document. The manifest's row is written last of all, so that a
run which broke off left nothing that readers see.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import platform
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArchivalError
from .functions import paths as P
from .functions.content import decompress, decrypt, derived_id, key_index
from .operators import dedup, detect
from .operators import sets as S
from .plans import archive as A
from .plans import backup as B
from .plans import increments as I
from .plans import restore as R
from .schemas import ARCHIVE_ENTRIES, CARGO_INDEX, FILES, JOB, MANIFESTS
from .scratch import trim
from .sources import archive_files, filesystem, keys, manifests, restore_files

VERSION = "1.0.0"
#: While a task runs: small tables are broadcast by their hints, and what a query dealt goes from disk when it is done.
_SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def known_tables(spark: SparkSession, folder: str, prefix: str) -> dict[str, DataFrame] | None:
    """The prefix's tables; None before the first backup."""
    try:
        found = manifests.read_tables(spark, folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return {**found, "manifests": I.of_prefix(found["manifests"], prefix)}


def _held(spark: SparkSession, scope: B.Scope) -> dict[str, DataFrame]:
    held = known_tables(spark, scope.folder, scope.prefix)
    if held is None or held["manifests"].isEmpty():
        raise I.ChainError("no manifest found")
    return held


def configuration_of(row) -> B.BackupConfiguration | None:
    """The configuration that a manifest was made with."""
    job = row.job_configuration
    if job is None:
        return None
    raw = job.asDict(recursive=True)
    sources = tuple(B.Source(s["path"], tuple(s["include_patterns"] or ()), tuple(s["exclude_patterns"] or ())) for s in raw.pop("sources") or ())
    return B.BackupConfiguration(**{k: v for k, v in raw.items() if v is not None or k == "encryption_key"}, sources=sources)


def reload(spark: SparkSession, folder: str, manifest_id: str) -> dict[str, DataFrame]:
    """A10: one increment's own tables, as they were written."""
    found = manifests.read_tables(spark, folder)
    own = {k: df.where(F.col("manifest_id") == manifest_id) for k, df in found.items()}
    if own["manifests"].isEmpty():
        raise I.ChainError(f"there is no manifest {manifest_id}")
    return own


def scan(spark: SparkSession, sources: tuple[B.Source, ...], algorithm: str) -> DataFrame:
    """All sources' trees, a path once."""
    spark.dataSource.register(filesystem.FileTree)
    rows = None
    for s in sources:
        reader = spark.read.format("file_tree").option("root", s.path).option("hash", algorithm)
        part = reader.option("include", "\n".join(s.include_patterns)).option("exclude", "\n".join(s.exclude_patterns)).load()
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ArchivalError("the job has no source")
    return rows if len(sources) == 1 else rows.dropDuplicates(["path"])


def _merging(task):
    """A task whose joins broadcast no table that grows: Spark takes a few columns of a well compressed table for small, and gathers them on the driver."""

    @functools.wraps(task)
    def run(spark: SparkSession, *args, **kwargs):
        before = {key: spark.conf.get(key, None) for key in _SETTINGS}
        try:
            for key, value in _SETTINGS.items():
                spark.conf.set(key, value)
            return task(spark, *args, **kwargs)
        finally:
            for key, value in before.items():
                spark.conf.unset(key) if value is None else spark.conf.set(key, value)

    return run


class _Staging:
    """A folder beside the increment's files for what is only needed while they are made."""

    def __init__(self, folder: str, name: str):
        self.root = f"{folder}/.staging-{name}-{uuid.uuid4().hex[:8]}"

    def __enter__(self) -> _Staging:
        os.makedirs(self.root, exist_ok=True)
        return self

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.root, ignore_errors=True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        trim(df.sparkSession)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_archive(spark: SparkSession, packed: DataFrame, versions: list[int], prefix: str, max_chunk: int, folder: str, staging: _Staging) -> DataFrame:
    """The chunks, the index file and the index rows of written packed rows (prefix, ord, path, type, encrypted, raw, ...)."""
    placed = A.placed(packed, max_chunk)
    archive_files.write_chunks(A.parts(placed, max_chunk), folder)
    folders = spark.createDataFrame([(prefix, n + 1, f"/{v}") for n, v in enumerate(sorted(versions))], "prefix string, ord long, path string")
    index = staging.keep(archive_files.index_rows(placed.drop("raw"), folders).select(*CARGO_INDEX.fieldNames()), "index")
    archive_files.write_index(index, prefix, max_chunk, folder, f"{staging.root}/lines")
    return index


def _commit(spark: SparkSession, head: DataFrame, files: DataFrame, entries: DataFrame, index: DataFrame, folder: str, staging: _Staging) -> None:
    """The document in both places, then the tables, the manifest's own row last. A manifest without a file is refused."""
    name = head.first().manifest_id
    for row in validate(head, files).collect():
        raise ArchivalError(f"{row.manifest_id}: {row.why}")
    archive_files.write_document(head, files, entries, f"{folder}/.history/{name}.manifest.json.gz", f"{staging.root}/document")
    shutil.copyfile(f"{folder}/.history/{name}.manifest.json.gz", f"{folder}/{name}.manifest.cargo")
    index.withColumnRenamed("prefix", "manifest_id").write.mode("append").partitionBy("manifest_id").parquet(f"{folder}/archive_index")
    manifests.write_tables(head, files, entries, folder)


def validate(head: DataFrame, files: DataFrame) -> DataFrame:
    """(manifest_id, why) of what a manifest must not be when it is written."""
    rules = {
        "no file": "n_files = 0", "a bad id": "NOT manifest_id RLIKE '^[a-zA-Z0-9_-]+-[0-9]+(-[0-9]+)?$'", "no version": "backup_versions IS NULL OR size(backup_versions) = 0",
        "a negative start": f"{I.START} IS NULL OR {I.START} <= 0", "an unknown type": "backup_type IS NULL OR backup_type NOT IN ('FULL', 'INCREMENTAL')", "no application version": "app_version IS NULL OR NOT app_version RLIKE '^[0-9]+[.][0-9]+[.][0-9]+$'",
    }
    n = files.groupBy("manifest_id").agg(F.count("*").alias("n_files"))
    rows = head.join(n, "manifest_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    why = F.array_compact(F.array(*[F.when(F.expr(rule), name) for name, rule in rules.items()]))
    return rows.select("manifest_id", F.explode(why).alias("why"))


@_merging
def backup(spark: SparkSession, conf: B.BackupConfiguration, force_full: bool = False, now: int | None = None) -> DataFrame:
    """Scan, compare, store and write the next increment; (status, count) of its files.

    FULL without a chain, after a change of the configuration, or on demand.
    """
    folder, now = conf.destination_directory, now if now is not None else int(time.time())
    held = known_tables(spark, folder, conf.file_name_prefix)
    chain = I.as_of(held["manifests"]) if held and not held["manifests"].isEmpty() else None
    before = I.latest_at(chain).first() if chain is not None else None
    head = I.next_header(spark, chain, conf.file_name_prefix, now, VERSION, before is not None and configuration_of(before) == conf, force_full or conf.backup_type == "FULL")
    first = head.first()
    name, version = first.manifest_id, first.backup_versions[0]
    if held and not held["manifests"].where(F.col("manifest_id") == name).isEmpty():
        raise ArchivalError(f"{name} is there already")
    own_keys = wrapped = None
    if conf.encryption_key:
        own_keys, wrapped = keys.new_version_keys(spark, keys.public_key_of(spark, conf.encryption_key))
    rows = scan(spark, conf.sources, conf.hash_algorithm).withColumn("manifest_id", F.lit(name)).withColumn("id", derived_id(F.lit(name), F.col("path")))
    for c in ("status", "archive_metadata_id", "error"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    with _Staging(folder, name) as staging:
        rows = staging.keep(rows.select(*FILES.fieldNames()), "scan")
        history = entries = None
        if first.backup_type == "INCREMENTAL":
            I.checked_chain(chain)
            # a row an increment
            order = F.broadcast(chain.select("manifest_id", F.element_at("backup_versions", -1).cast("bigint").alias("increment")))
            history = held["files"].join(order, "manifest_id")
            entries = held["archive_entries"].join(F.broadcast(chain.select("manifest_id")), "manifest_id", "left_semi")
            rows = rows.withColumn("increment", F.lit(version).cast("bigint"))
        made = B.plan(rows, history, entries, conf, version, staging.keep)
        files = staging.keep(made["files"].select(*FILES.fieldNames()), "files")
        stored = staging.keep(made["archives"].select(*ARCHIVE_ENTRIES.fieldNames()), "entries")
        # one member of each group of this increment's own entries gives the bytes
        fresh = stored.where(F.col("archive_location.backup_increment") == version).select(F.col("id").alias("entry"), F.col("archive_location.entry_name").alias("entry_name")).distinct()
        source = files.where("archive_metadata_id IS NOT NULL").groupBy(F.col("archive_metadata_id").alias("entry")).agg(F.min(F.struct("path", "file_type", "id")).alias("f"))
        wanted = fresh.join(source, "entry").select("entry", "entry_name", F.col("f.path").alias("source"), F.col("f.file_type").alias("type"))
        wanted = archive_files.numbered(staging.keep(wanted, "wanted"), F.col("source"), 2)
        wanted = staging.keep(wanted, "numbered").withColumn("path", P.format_locator(F.lit(version), F.col("entry_name")))
        if own_keys:
            wanted = wanted.join(keys.key_table(spark, {version: own_keys}).select("key_index", "key"), key_index(F.col("entry_name")) == F.col("key_index"), "left").drop("key_index")
        loaded = archive_files.with_bytes(wanted, "source", "type").withColumn("encrypted", F.lit(bool(own_keys)))
        packed = staging.keep(A.pack(loaded, name, F.col("key") if own_keys else None, conf.compression, conf.hash_algorithm).drop("key"), "packed")
        # the hash when it was stored, against that of the scan
        kept = packed.select("entry", F.col("orig_hash").alias("stored_hash"))
        files = staging.keep(dedup.mark_drift(files, files.select("id", "archive_metadata_id").join(kept, F.col("archive_metadata_id") == F.col("entry")).select("id", "stored_hash")).select(*FILES.fieldNames()), "marked")
        stored = stored.join(kept.withColumnRenamed("entry", "id"), "id", "left").withColumn("archived_hash", F.coalesce("stored_hash", "archived_hash")).select(*ARCHIVE_ENTRIES.fieldNames())
        index = _write_archive(spark, packed, [version], name, conf.chunk_size_mebibyte << 20, folder, staging)
        job = {**{f.name: getattr(conf, f.name) for f in JOB if f.name != "sources"}, "sources": [{"path": s.path, "include_patterns": list(s.include_patterns), "exclude_patterns": list(s.exclude_patterns)} for s in conf.sources]}
        chunks = [r.name for r in index.select(F.explode(F.array("content.start_file", "content.end_file")).alias("name")).where("name IS NOT NULL").distinct().orderBy("name").collect()]
        system = spark.range(1).select(P.operating_system(F.lit(platform.system()))).first()[0]
        row = (name, VERSION, now, first.backup_type, [version], system, job, {str(version): wrapped} if wrapped else None, f"{name}.index.cargo", chunks)
        _commit(spark, spark.createDataFrame([row], MANIFESTS), files, stored, index, folder, staging)
    done = known_tables(spark, folder, conf.file_name_prefix)["files"]
    return done.where(F.col("manifest_id") == name).groupBy("status").count()


def located(spark: SparkSession, folder: str, chain: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Index rows of a chain's archives as (prefix, ord, locator, type, encrypted, boundary columns); wanted: (locator)."""
    rows = spark.read.parquet(f"{folder}/archive_index").where("content IS NOT NULL").join(F.broadcast(chain.select("manifest_id")), "manifest_id", "left_semi")
    rows = rows.select(F.col("manifest_id").alias("prefix"), "ord", F.col("path").alias("locator"), "type", "encrypted", "content.*")
    return rows if wanted is None else rows.join(wanted.select("locator").distinct(), "locator", "left_semi")


def contents(spark: SparkSession, folder: str, chain: DataFrame, wanted: DataFrame | None = None, private_key=None) -> DataFrame:
    """(locator, type, content) of the chain's entries; bytes that do not match the index fail the query."""
    heads = chain.select("manifest_id", F.col("job_configuration.compression").alias("compression"), F.col("job_configuration.hash_algorithm").alias("algorithm"), (F.col("job_configuration.chunk_size_mebibyte").cast("bigint") * (1 << 20)).alias("most"), "encryption_keys").collect()
    algorithms, compressions = {r.algorithm for r in heads}, {r.compression for r in heads}
    if len(algorithms) != 1 or len(compressions) != 1:
        raise ArchivalError("the increments of a chain have one configuration")
    sizes = spark.createDataFrame([(r.manifest_id, r.most) for r in heads], "prefix string, most long")
    # a row an increment
    rows = located(spark, folder, chain, wanted).join(F.broadcast(sizes), "prefix")
    raw = archive_files.read_raw(rows, folder, F.col("most"))
    plain = F.col("raw")
    every = {}
    for r in heads:
        if r.encryption_keys:
            if private_key is None:
                raise ArchivalError("the archives are encrypted: a private key is needed")
            every |= keys.unwrap_all(spark, r.encryption_keys, private_key)
    if every:
        at = P.parse_locator(F.col("locator"))
        table = keys.key_table(spark, every)
        raw = raw.withColumn("__v", at["backup_increment"]).withColumn("__k", key_index(at["entry_name"]))
        raw = raw.join(F.broadcast(table), (F.col("__v") == F.col("version")) & (F.col("__k") == F.col("key_index")))
        plain = decrypt(F.col("raw"), F.col("key"))
    out = raw.withColumn("content", decompress(plain, compressions.pop())).withColumn("path", F.col("locator"))
    return A.checked(out, algorithms.pop()).select("locator", "type", "content")


def _disk(spark: SparkSession, rows: DataFrame, mapped: DataFrame, roots: list[str], algorithm: str) -> tuple[DataFrame, DataFrame]:
    """What lies below the roots now, and the backup's rows at their restore paths."""
    there = tuple(B.Source(r) for r in roots if os.path.lexists(r))
    empty = spark.createDataFrame([], filesystem.SCHEMA)
    disk = scan(spark, there, algorithm) if there else empty
    disk = disk.withColumn("id", F.col("path")).withColumn("status", F.lit("NEW"))
    return disk, rows.join(mapped, "path").withColumn("from_path", F.col("path")).withColumn("path", F.col("restore_path")).drop("restore_path")


@_merging
def restore(spark: SparkSession, scope: B.Scope, targets: list[tuple[str, str]] = (), include: str | None = None, delete_missing: bool = False, dry_run: bool = False, rule: str = "STRICT", private_key=None) -> DataFrame:
    """Restore an increment: the plan of a dry run, in order; else (path, change, message) of what is not as it was.

    The disk is scanned and compared before and after.
    """
    B.permission_rule(rule)
    held = _held(spark, scope)
    chain = I.checked_chain(I.as_of(held["manifests"], scope.at))
    # a row
    last = F.broadcast(I.latest_at(chain).select("manifest_id"))
    head = I.latest_at(chain).first()
    conf = configuration_of(head)
    rows = I.chosen(held["files"], last).where("file_type <> 'MISSING'")
    if include is not None:
        rows = S.under(rows, include)
    entries = I.chosen(held["archive_entries"], last)
    goals = F.broadcast(spark.createDataFrame([tuple(t) for t in targets], "backup_path string, restore_path string"))
    roots = filesystem.target_roots([s.path for s in conf.sources], list(targets))
    by = detect.detector(conf.hash_algorithm, rule)
    # a dry run's plan reads the backup itself
    with contextlib.nullcontext() if dry_run else _Staging(scope.folder, "restore") as staging:
        keep = staging.keep if staging else lambda df, _: df
        rows = keep(rows, "rows")
        mapped = keep(S.map_to_target(rows.select("path"), goals), "mapped")

        def changes() -> tuple[DataFrame, DataFrame]:
            disk, own = _disk(spark, rows, mapped, roots, conf.hash_algorithm)
            found = detect.compare_with_disk(own.drop("from_path"), disk, by, F.lit(True)).withColumnRenamed("path", "restore_path")
            return disk, found.join(mapped, "restore_path").select("path", "change")

        disk, found = changes()
        linked = rows.where("file_type = 'SYMBOLIC_LINK'").select("path", "id")
        of = S.entry_of_files(entries, linked).select(F.col("file_id").alias("id"), P.format_locator(F.col("archive_location.backup_increment"), F.col("archive_location.entry_name")).alias("locator"))
        asked = linked.join(of, "id")
        targets_of = contents(spark, scope.folder, chain, asked, private_key).select("locator", F.col("content").cast("string").alias("link_target"))
        links = asked.join(targets_of, "locator").select("path", "link_target")
        on_disk = disk.select("path")
        if include is not None:
            # only what lies where the included path goes is left over
            goal = S.map_to_target(spark.createDataFrame([(include,)], "path string"), goals).first().restore_path
            on_disk = S.under(on_disk, goal)
        plan = R.plan(rows, entries, goals, found, on_disk, delete_missing, links, mapped=mapped)
        if dry_run:
            return R.ordered(plan)
        # as it was before anything is touched
        plan = staging.keep(plan, "plan")
        wanted = contents(spark, scope.folder, chain, plan.where("op = 'write'"), private_key)
        # new files and directories get their metadata, too
        own = staging.keep(rows.join(mapped, "path").drop("path").withColumnRenamed("restore_path", "path").select("path", "file_type", *restore_files.METADATA), "own")
        every = own.where("file_type IN ('REGULAR_FILE', 'DIRECTORY')").select(F.when(F.col("file_type") == "DIRECTORY", "metadata_directory").otherwise("metadata").alias("op"), "path")
        none = F.lit(None).cast("string")
        steps = F.when(F.col("op") == "metadata", R.OPERATIONS.index("metadata")).otherwise(R.OPERATIONS.index("metadata_directory")).cast("int")
        plan = plan.where("NOT op LIKE 'metadata%'").unionByName(every.select(steps.alias("step"), "op", "path", none.alias("source_path"), none.alias("locator")))
        restore_files.execute(plan, wanted, own, rule=rule)
        return staged_result(spark, R.evaluate(rows, changes()[1]).select("path", "change", "message"))


def staged_result(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """A result that no longer depends on the disk: what went wrong, a row a path."""
    held = rows.toArrow()
    return spark.createDataFrame(held) if held.num_rows else spark.createDataFrame([], rows.schema)


@_merging
def merge(spark: SparkSession, scope: B.Scope, delete_obsolete: bool = False) -> DataFrame:
    """One increment in place of a range: live entries are copied as they are stored; (manifest_id, action) of all manifests touched."""
    held = _held(spark, scope)
    heads, folder = held["manifests"], scope.folder
    chosen = I.merge_selection(heads, scope.first, scope.last)
    made = I.merged(chosen, held["files"], held["archive_entries"])
    header, last = made["header"].first(), I.latest_at(chosen).first()
    name = header.manifest_id
    versions = made["versions"].first().backup_versions
    most = last.job_configuration.chunk_size_mebibyte << 20
    rename = lambda df: df.withColumn("manifest_id", F.lit(name))
    with _Staging(folder, name) as staging:
        files = staging.keep(rename(made["files"]).select(*FILES.fieldNames()), "files")
        entries = staging.keep(rename(made["archives"]).select(*ARCHIVE_ENTRIES.fieldNames()), "entries")
        wanted = entries.select(P.format_locator(F.col("archive_location.backup_increment"), F.col("archive_location.entry_name")).alias("locator")).distinct()
        sizes = spark.createDataFrame([(r.manifest_id, r.m << 20) for r in chosen.select("manifest_id", F.col("job_configuration.chunk_size_mebibyte").alias("m")).collect()], "prefix string, most long")
        rows = located(spark, folder, chosen, wanted).join(F.broadcast(sizes), "prefix")
        keep = ["locator", "type", "encrypted", "orig_size", "orig_hash", "arch_size", "arch_hash", "raw"]
        raw = archive_files.read_raw(rows, folder, F.col("most")).select(*keep, F.struct("prefix", "ord").alias("was"))
        if (lost := wanted.join(raw.select("locator"), "locator", "left_anti").limit(1).collect()):
            raise ArchivalError(f"no archive of the range holds {lost[0].locator}")
        # in the order in which they are stored, archive by archive
        raw = archive_files.numbered(staging.keep(raw, "raw"), F.col("was"), len(versions) + 1)
        packed = staging.keep(raw.select(F.lit(name).alias("prefix"), "ord", F.col("locator").alias("path"), *keep[1:]), "packed")
        index = _write_archive(spark, packed, versions, name, most, folder, staging)
        merged_keys = None
        if last.encryption_keys:
            merged_keys = {}
            for r in S.merged_keys(chosen).collect():
                merged_keys.setdefault(str(r.version), {})[str(r.key_index)] = r.key
        chunks = [r.name for r in index.select(F.explode(F.array("content.start_file", "content.end_file")).alias("name")).where("name IS NOT NULL").distinct().orderBy("name").collect()]
        app = S.max_version(chosen).first().max_version
        row = (name, app, last[I.START], header.backup_type, versions, last.operating_system, last.job_configuration, merged_keys, f"{name}.index.cargo", chunks)
        _commit(spark, spark.createDataFrame([row], MANIFESTS), files, entries, index, folder, staging)
    actions = [(name, "create")]
    if delete_obsolete:
        gone = [r.manifest_id for r in heads.where(F.col(I.START).between(scope.first, scope.last)).where(F.col("manifest_id") != name).select("manifest_id").collect()]
        remove(spark, folder, gone)
        actions += [(g, "delete") for g in gone]
    return spark.createDataFrame(actions, "manifest_id string, action string")


def remove(spark: SparkSession, folder: str, manifest_ids: list[str]) -> list[str]:
    """The files and table partitions of increments; a manifest's own row goes first, so that readers lose it at once."""
    gone = []
    for table in ("manifests", "files", "archive_entries", "archive_index"):
        for m in manifest_ids:
            path = f"{folder}/{table}/manifest_id={m}"
            if os.path.isdir(path):
                shutil.rmtree(path)
    names = [(n,) for d in ("", "/.history") for n in os.listdir(f"{folder}{d}") if os.path.isfile(f"{folder}{d}/{n}")] if os.path.isdir(f"{folder}/.history") else [(n,) for n in os.listdir(folder)]
    listing = spark.createDataFrame(names, "name string")
    for r in I.delete_plan(listing, spark.createDataFrame([(m,) for m in manifest_ids], "manifest_id string")).orderBy("name").collect():
        path = f"{folder}/.history/{r.name}" if r.kind == "history" else f"{folder}/{r.name}"
        if os.path.exists(path):
            os.remove(path)
            gone.append(path)
    for table in ("manifests", "files", "archive_entries", "archive_index"):
        spark.catalog.refreshByPath(f"{folder}/{table}")
    return gone


def delete(spark: SparkSession, scope: B.Scope, dry_run: bool = False) -> DataFrame:
    """The increment that starts at scope.first and those up to the next FULL one: their headers, removed unless a dry run."""
    heads = I.until_next_full(_held(spark, scope)["manifests"], scope.first).select("manifest_id", I.START, "backup_type")
    found = [tuple(r) for r in heads.orderBy(I.START).collect()]
    if not dry_run:
        remove(spark, scope.folder, [f[0] for f in found])
    return spark.createDataFrame(found, f"manifest_id string, {I.START} long, backup_type string")


def configuration(path: str) -> B.BackupConfiguration:
    """The job's JSON file; unknown fields are refused."""
    with open(path) as f:
        raw = json.load(f)
    raw["sources"] = tuple(B.Source(s["path"], tuple(s.get("include_patterns", ())), tuple(s.get("exclude_patterns", ()))) for s in raw.get("sources", ()))
    return B.BackupConfiguration(**raw)
