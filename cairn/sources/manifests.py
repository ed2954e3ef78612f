"""Manifest readers and writers (A7-A11, B1, B2): JSON documents keyed by id to tables, and back."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions.content import compress, decompress, decrypt, encrypt
from ..schemas import ARCHIVE_ENTRIES, FILES, MANIFESTS
from .documents import TABLES, pieces
from .keys import new_key, unwrap, wrap

_FILE = T.StructType([f for f in FILES if f.name != "manifest_id"])
_ENTRY = T.StructType([f for f in ARCHIVE_ENTRIES if f.name != "manifest_id"])
#: The document: header fields, and both tables as maps from id to row.
DOCUMENT = T.StructType([*[f for f in MANIFESTS if f.name not in ("manifest_id",)], T.StructField("file_name_prefix", T.StringType()), T.StructField("files", T.MapType(T.StringType(), _FILE)), T.StructField("archive_entries", T.MapType(T.StringType(), _ENTRY))])


def manifest_files(listing: DataFrame, prefix: str) -> DataFrame:
    """Of a listing (name), the manifest files of exactly this prefix."""
    return listing.where(F.col("name").rlike(rf"^{prefix}-\d+(-\d+)?\.manifest\.cargo$"))


def read_documents(spark: SparkSession, folder: str, suffix: str = ".manifest.json.gz") -> DataFrame:
    """One row a manifest file; a file that is no JSON gives null columns (Q6)."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*{suffix}")


def read_cargo(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests whose gzip data has no extension, so the JSON reader can't know it."""
    raw = spark.read.format("binaryFile").load(f"{folder}/*.manifest.cargo")
    text = decompress(F.col("content"), "GZIP").cast("string")
    return raw.select(F.from_json(text, DOCUMENT).alias("d")).select("d.*")


def read_encrypted_cargo(spark: SparkSession, folder: str, private_key) -> DataFrame:
    """As read_cargo; each file is the wrapped key's length (four bytes), the wrapped key, and AES-GCM data.

    The files' keys, one a manifest, are unwrapped on the driver; the data is decrypted where it is read.
    """
    raw = spark.read.format("binaryFile").load(f"{folder}/*.manifest.cargo").select("path", "content")
    size = F.conv(F.hex(F.substring("content", 1, 4)), 16, 10).cast("int")
    wrapped = raw.select("path", F.base64(F.substring(F.col("content"), F.lit(5), size)).alias("key")).collect()
    found = spark.createDataFrame([(r.path, bytearray(unwrap(spark, r.key, private_key))) for r in wrapped], "path string, key binary")
    payload = F.substring(F.col("content"), size + 5, F.length("content"))
    text = decompress(decrypt(payload, F.col("key")), "GZIP").cast("string")
    return raw.join(F.broadcast(found), "path").select(F.from_json(text, DOCUMENT).alias("d")).select("d.*")


def encrypted_cargo(spark: SparkSession, documents: DataFrame, public_key) -> DataFrame:
    """(manifest_id, data) of documents (manifest_id, document), encrypted with a new key each."""
    ids = [r[0] for r in documents.select("manifest_id").collect()]
    own = [(i, new_key()) for i in ids]
    rows = [(i, bytearray(k), bytearray(base64.b64decode(wrap(spark, k, public_key)))) for i, k in own]
    keys = spark.createDataFrame(rows, "manifest_id string, key binary, wrapped binary")
    size = F.unhex(F.lpad(F.hex(F.length("wrapped").cast("bigint")), 8, "0"))
    packed = encrypt(compress(F.col("document").cast("binary"), "GZIP"), F.col("key"))
    return documents.join(F.broadcast(keys), "manifest_id").select("manifest_id", F.concat(size, F.col("wrapped"), packed).alias("data"))


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """manifests, files and archive_entries of documents; paths are plain, ids come from the maps' keys."""
    rows = documents.where(F.col("file_name_prefix").isNotNull()).withColumnRenamed("file_name_prefix", "manifest_id")
    own = lambda name: rows.select("manifest_id", F.explode(name).alias("key", "r"))
    return _tables(rows, own("files"), own("archive_entries"))


def _tables(rows: DataFrame, files: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """The tables of headers and of the two maps' members (manifest_id, key, r)."""
    files = files.select("manifest_id", F.col("key").alias("id"), *[F.col(f"r.{f.name}") for f in _FILE if f.name != "id"])
    files = files.withColumn("path", F.coalesce(P.from_uri(F.col("path")), F.col("path"))).select(*FILES.fieldNames())
    entries = entries.select("manifest_id", F.col("key").alias("id"), *[F.col(f"r.{f.name}") for f in _ENTRY if f.name != "id"]).select(*ARCHIVE_ENTRIES.fieldNames())
    return {"manifests": rows.select(*MANIFESTS.fieldNames()), "files": files, "archive_entries": entries}


def document_tables(spark: SparkSession, folder: str, suffix: str = ".manifest.cargo") -> dict[str, DataFrame]:
    """`tables` of the documents in a mounted folder, row by row, so that no task holds a whole document."""
    head = T.StructType([f for f in DOCUMENT if f.name not in TABLES])
    rows = pieces(spark, folder, suffix).select("manifest_id", F.from_json("json", head).alias("d")).select("manifest_id", "d.*")
    own = lambda name, kind: pieces(spark, folder, suffix, name).select("manifest_id", "key", F.from_json("json", kind).alias("r"))
    return _tables(rows, own("files", _FILE), own("archive_entries", _ENTRY))


def to_documents(manifests: DataFrame, files: DataFrame, entries: DataFrame) -> DataFrame:
    """B2: (manifest_id, document): JSON of one manifest a row, files by path and entries by id.

    Here a document is one value; `archive_files.write_document` and `document_tables` write and read one of any size.
    """
    f = files.withColumn("path", P.to_uri(F.col("path")))
    fs = f.groupBy("manifest_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("path", F.struct(*[c for c in FILES.fieldNames() if c != "manifest_id"]).alias("row")))), lambda x: F.struct(x["row"]["id"], x["row"]))).alias("files"))
    rest = [c for c in ARCHIVE_ENTRIES.fieldNames() if c not in ("manifest_id", "id", "files")]
    entries = entries.groupBy("manifest_id", "id").agg(F.min(F.struct(*rest)).alias("r"), F.array_sort(F.flatten(F.collect_list("files"))).alias("files")).select("manifest_id", "id", "r.*", "files").select(*ARCHIVE_ENTRIES.fieldNames())
    es = entries.groupBy("manifest_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", F.struct(*[c for c in ARCHIVE_ENTRIES.fieldNames() if c != "manifest_id"]).alias("row"))))).alias("archive_entries"))
    head = manifests.withColumn("file_name_prefix", F.col("manifest_id"))
    row = head.join(fs, "manifest_id", "left").join(es, "manifest_id", "left")
    return row.select("manifest_id", F.to_json(F.struct(*[c for c in row.columns if c != "manifest_id"])).alias("document"))


def write_tables(manifests: DataFrame, files: DataFrame, entries: DataFrame, folder: str) -> None:
    """B1: the native form: Parquet by manifest, so that a chain reads its own partitions only."""
    files.write.mode("append").partitionBy("manifest_id").parquet(f"{folder}/files")
    entries.write.mode("append").partitionBy("manifest_id").parquet(f"{folder}/archive_entries")
    # last: until it is there, nobody sees the rest
    manifests.write.mode("append").partitionBy("manifest_id").parquet(f"{folder}/manifests")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {"manifests": spark.read.schema(MANIFESTS).parquet(f"{folder}/manifests"), "files": spark.read.schema(FILES).parquet(f"{folder}/files"), "archive_entries": spark.read.schema(ARCHIVE_ENTRIES).parquet(f"{folder}/archive_entries")}
