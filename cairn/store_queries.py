"""Queries that write before they read: tables, streams, chunks and keys; and what plans derive from rows."""

from __future__ import annotations

import atexit
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from . import jobs
from .functions import content as C
from .functions import paths as P
from .operators import order as O
from .operators import sets as S
from .plans import archive as A
from .plans import increments as I
from .queries import _AT, _OFFSETS, _SINCE, _first_from, _index, _offset_rows, _share, _uuid, query
from .schemas import ARCHIVE_ENTRIES, FILES, MANIFESTS, changes_with
from .scratch import own_folder
from .sources import archive_files, keys, manifests
from .streaming.increments import LatestState


def _own(spark: SparkSession, tag: str) -> str:
    folder = own_folder(spark, tag)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _full(df: DataFrame, schema) -> DataFrame:
    """df with all columns of a schema; those that it lacks are null."""
    for f in schema:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


# --- archives --------------------------------------------------------------------------------------------------------


@query("entries_in_order", "WITH " + _OFFSETS + ", w AS (SELECT * FROM r WHERE ord % 3 = 0) SELECT prefix, ord, '/' || ord AS path, abs_start FROM w", fixture=False)
def entries_in_order(spark, sf_dir):
    index = _offset_rows(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), F.col("ord").cast("string")))
    return A.in_storage_order(index, index.where("ord % 3 = 0")).select("prefix", "ord", "path", "abs_start")


@query("entry_ranks", "WITH " + _OFFSETS + " SELECT prefix, ord, row_number() OVER (PARTITION BY prefix ORDER BY ord) AS nth FROM r", fixture=False)
def entry_ranks(spark, sf_dir):
    return O.rank(_offset_rows(spark, sf_dir), ["prefix"], "ord", "nth").select("prefix", "ord", "nth")


@query("index_line_counts", "WITH " + _OFFSETS + " SELECT prefix, CAST(count(*) * 13 AS BIGINT) AS n FROM r GROUP BY prefix", fixture=False)
def index_line_counts(spark, sf_dir):
    return A.index_lines(_index(spark, sf_dir)).groupBy("prefix").agg(F.count("*").alias("n"))


@query("entry_directories", "SELECT DISTINCT '/' || backup_increment AS path FROM archives")
def entry_directories(spark, sf_dir):
    at = F.col("archive_location")
    return A.directories(X.archives(spark, sf_dir).select(P.format_locator(at["backup_increment"], at["entry_name"]).alias("path")))


def _texts(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("ord"), F.concat(F.lit("/"), F.col("doc_id").cast("string")).alias("path"), text.alias("content"))


@query("packed_entries", "SELECT doc_id AS ord, '/' || doc_id AS path, sha256(coalesce(text, '')) AS orig_hash, sha256(coalesce(text, '')) AS arch_hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS arch_size FROM documents", fixture=False)
def packed_entries(spark, sf_dir):
    return A.pack(_texts(spark, sf_dir), "arc").select("ord", "path", "orig_hash", "arch_hash", "arch_size")


_SIZE = 1 << 19


@query("chunk_bytes", f"WITH t AS (SELECT sum(strlen(coalesce(text, ''))) AS total FROM documents), c AS (SELECT unnest(range(CAST(ceil(total / {_SIZE}) AS BIGINT))) AS n, total FROM t) SELECT CAST(n + 1 AS INT) AS number, format('arc.{{:05d}}.cargo', n + 1) AS name, CAST(least({_SIZE}, total - n * {_SIZE}) AS BIGINT) AS size, CAST(ceil(least({_SIZE}, total - n * {_SIZE}) / 65536) AS BIGINT) AS parts FROM c", fixture=False)
def chunk_bytes(spark, sf_dir):
    placed = A.placed(A.pack(_texts(spark, sf_dir), "arc"), _SIZE)
    rows = A.parts(placed, _SIZE, 1 << 16)
    return rows.groupBy("number", "name").agg(F.sum(F.octet_length("data")).cast("bigint").alias("size"), F.count("*").alias("parts"))


@query("encrypted_entries", "SELECT doc_id AS ord, sha256(coalesce(text, '')) AS content_hash, true AS hidden FROM documents", fixture=False)
def encrypted_entries(spark, sf_dir):
    """Each entry by one of its version's sixteen keys, which travel wrapped; hidden: the stored bytes are others."""
    pair = keys.key_pair(spark, 2048)
    own, wrapped = keys.new_version_keys(spark, pair.getPublic())
    table = keys.key_table(spark, {0: own}).select("key_index", "key")
    name = C.derived_id(F.lit("entry"), F.col("path"))
    rows = _texts(spark, sf_dir).withColumn("entry", name).join(F.broadcast(table), C.key_index(name) == F.col("key_index"))
    packed = A.pack(rows.drop("key_index"), "arc", F.col("key"), "GZIP").drop("key")
    back = keys.key_table(spark, keys.unwrap_all(spark, {"0": wrapped}, pair.getPrivate())).select("key_index", "key")
    read = packed.join(F.broadcast(back), C.key_index(F.col("entry")) == F.col("key_index"))
    plain = C.decompress(C.decrypt(F.col("raw"), F.col("key")), "GZIP")
    return read.select("ord", F.sha2(plain, 256).alias("content_hash"), (F.col("arch_hash") != F.col("orig_hash")).alias("hidden"))


# --- tables and streams ----------------------------------------------------------------------------------------------


def _stored(spark, sf_dir):
    folder = _own(spark, "tables")
    heads = _full(X.chain(spark, sf_dir).limit(3), MANIFESTS)
    manifests.write_tables(heads, _full(X.files(spark, sf_dir), FILES), _full(X.archives(spark, sf_dir), ARCHIVE_ENTRIES), folder)
    return manifests.read_tables(spark, folder)


@query("stored_files", "SELECT manifest_id, id, path, original_hash, original_size, permissions, file_type, status FROM files")
def stored_files(spark, sf_dir):
    return _stored(spark, sf_dir)["files"].select("manifest_id", "id", "path", "original_hash", "original_size", "permissions", "file_type", "status")


@query("stored_entries", "SELECT manifest_id, id, backup_increment, entry_name, array_to_string(files, ',') AS files FROM archives")
def stored_entries(spark, sf_dir):
    return _stored(spark, sf_dir)["archive_entries"].select("manifest_id", "id", "archive_location.backup_increment", "archive_location.entry_name", F.array_join("files", ",").alias("files"))


@query("documents_round_trip", "SELECT manifest_id, id, path, original_size, archive_metadata_id FROM files")
def documents_round_trip(spark, sf_dir):
    """Manifests as JSON documents and back: files of the shared folder, written and read in pieces."""
    folder, found = _own(spark, "documents"), _stored(spark, sf_dir)
    for i in range(3):
        name = f"set-{X.EPOCH + i * X.DAY}"
        head = _full(spark.createDataFrame([(name,)], "manifest_id string"), MANIFESTS)
        own = {k: found[k].where(F.col("manifest_id") == name) for k in ("files", "archive_entries")}
        archive_files.write_document(head, own["files"], own["archive_entries"], f"{folder}/{name}.manifest.cargo", f"{folder}/{name}")
    return manifests.document_tables(spark, folder)["files"].select("manifest_id", "id", "path", "original_size", "archive_metadata_id")


@query("stream_latest", "SELECT path, id, increment FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY increment DESC, id) = 1")
def stream_latest(spark, sf_dir):
    """The increments arrive as files of a stream, one after the other, over two runs of it."""
    folder = _own(spark, "stream")
    rows = X.files(spark, sf_dir).select("path", "id", "increment")
    for run, wanted in enumerate(("increment < 2", "increment = 2")):
        rows.where(wanted).write.mode("append").parquet(f"{folder}/in")
        state = LatestState(spark, f"{folder}/state", buckets=4)
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 + run).parquet(f"{folder}/in")
        state.start(source, f"{folder}/check").awaitTermination()
    return state.read().select("path", "id", "increment")


# --- increments ------------------------------------------------------------------------------------------------------


@query("newest_rows", "SELECT id, increment = (SELECT max(increment) FROM files) AS is_last FROM files")
def newest_rows(spark, sf_dir):
    rows = X.files(spark, sf_dir)
    return rows.select("id", I.is_last(rows, "increment").alias("is_last"))


@query("next_increment", f"WITH {_AT}, s AS (SELECT * FROM manifests m, moment WHERE start_time_utc_epoch_seconds <= t), c AS (SELECT * FROM s WHERE start_time_utc_epoch_seconds >= (SELECT max(start_time_utc_epoch_seconds) FROM s WHERE backup_type = 'FULL')) SELECT 'set-123456789' AS manifest_id, 'INCREMENTAL' AS backup_type, CAST(count(*) AS INT) AS version FROM c")
def next_increment(spark, sf_dir):
    heads = X.chain(spark, sf_dir)
    made = I.next_header(spark, I.as_of(heads, _share(heads, 6)), "set", 123456789, "1.0.0", True)
    return made.select("manifest_id", "backup_type", F.col("backup_versions")[0].alias("version"))


@query("manifest_rules", "SELECT manifest_id, 'no file' AS why FROM manifests UNION ALL SELECT manifest_id, 'no application version' FROM manifests WHERE start_time_utc_epoch_seconds % 70 = 0")
def manifest_rules(spark, sf_dir):
    heads = X.chain(spark, sf_dir).withColumn("app_version", F.when(F.col(I.START) % 70 == 0, "x").otherwise(F.col("app_version")))
    return jobs.validate(heads, X.files(spark, sf_dir))


@query("increment_texts", f"WITH {_SINCE.format(4)} SELECT manifest_id, backup_type || ' backup: ' || manifest_id || chr(10) || chr(9) || 'Started at : ' || strftime(make_timestamp(start_time_utc_epoch_seconds * 1000000), '%Y-%m-%dT%H:%M:%SZ') || ' (Epoch seconds: ' || start_time_utc_epoch_seconds || ')' || chr(10) || chr(9) || 'Contains 0 files (0 MiB)' || chr(10) || chr(9) || 'Versions   : [' || array_to_string(backup_versions, ', ') || ']' || chr(10) || chr(9) || 'OS name    : ' || coalesce(operating_system, 'unknown') || chr(10) || chr(9) || 'Encrypted  : false' || chr(10) || chr(9) || 'Hash alg.  : SHA256' || chr(10) || chr(9) || 'Compression: GZIP' AS summary FROM until")
def increment_texts(spark, sf_dir):
    heads = X.chain(spark, sf_dir)
    job = F.struct(F.lit(None).cast("string").alias("encryption_key"), F.lit("SHA256").alias("hash_algorithm"), F.lit("GZIP").alias("compression"))
    return I.summary_text(I.until_next_full(heads, _first_from(heads, 4)).withColumn("job_configuration", job), X.files(spark, sf_dir))


_FLAGS = "(VALUES ('NEW', true, false, false), ('NO_CHANGE', false, true, false), ('METADATA_CHANGED', false, true, true), ('CONTENT_CHANGED', true, false, true), ('ROLLED_BACK', false, true, true), ('DELETED', false, false, true)) v(status, store, link, meta)"


@query("files_by_flag", f"SELECT id, store AS store_content, link AS link_previous_content, meta AS restore_metadata FROM files f JOIN {_FLAGS} ON f.status = v.status WHERE increment = 1")
def files_by_flag(spark, sf_dir):
    flags = ("store_content", "link_previous_content", "restore_metadata")
    return X.increment(spark, sf_dir, 1).where("status IS NOT NULL").select("id", *[F.col("status").isin(changes_with(f)).alias(f) for f in flags])


@query("derived_ids", f"SELECT id, {_uuid("manifest_id || chr(31) || path")} AS derived FROM files")
def derived_ids(spark, sf_dir):
    return X.files(spark, sf_dir).select("id", C.derived_id(F.col("manifest_id"), F.col("path")).alias("derived"))


@query("joined_paths", "SELECT path, path || '/child' AS child, 'a/' || file_type || path AS joined, starts_with(path, '/src1/') AS below FROM files WHERE increment = 0")
def joined_paths(spark, sf_dir):
    p = F.col("path")
    joined = P.join(F.lit("a"), F.concat("file_type", p))
    return X.increment(spark, sf_dir, 0).select("path", P.resolve(p, F.lit("child")).alias("child"), joined.alias("joined"), P.is_under(p, F.lit("/src1")).alias("below"))


@query("ordered_paths", "SELECT path, row_number() OVER (ORDER BY path DESC) AS nth FROM files WHERE increment = 1 AND status IN ('CONTENT_CHANGED', 'METADATA_CHANGED') AND file_type = 'REGULAR_FILE'")
def ordered_paths(spark, sf_dir):
    """The order of a descending visit, numbered by where each row came."""
    rows = S.by_status_and_type(X.increment(spark, sf_dir, 1), ["CONTENT_CHANGED", "METADATA_CHANGED"], ["REGULAR_FILE"], descending=True).select("path")
    placed = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = O.running_sum(sizes, [], "part", "size", "before").select("part", "before")
    return placed.join(before, "part").select("path", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint").alias("nth"))
