"""The driver's tables as three increments of file rows, their archive entries and a chain of manifests.

One SQL text makes each table in both Spark and DuckDB, so queries and their oracles start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.order import running_sum

EPOCH = 1704067200
DAY = 86400
_SPARK = {"octets": "octet_length", "sha": "sha2(t, 256)", "list": "array_sort(collect_list(id))", "array": "array"}
_DUCK = {"octets": "strlen", "sha": "sha256(t)", "list": "list_sort(list(id))", "array": "list_value"}

_FILES = """
SELECT increment, 'set-' || CAST({epoch} + increment * {day} AS STRING) AS manifest_id, 'f' || CAST(increment AS STRING) || '-' || CAST(doc_id AS STRING) AS id,
  CASE WHEN doc_id % 5 = 0 THEN 'k' || CAST(doc_id - doc_id % 20 AS STRING) END AS file_system_key,
  CASE WHEN increment >= 1 AND doc_id % 17 = 0 THEN '/moved' ELSE '' END || '/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS path,
  {sha} AS original_hash, CASE WHEN doc_id % 34 = 0 THEN NULL ELSE CAST({octets}(t) AS BIGINT) END AS original_size,
  {epoch} + doc_id * 60 + CASE WHEN increment >= 1 AND doc_id % 19 = 0 THEN 5 ELSE 0 END AS last_modified_utc_epoch_seconds,
  {epoch} + doc_id * 61 AS last_accessed_utc_epoch_seconds, {epoch} + doc_id AS created_utc_epoch_seconds,
  CASE WHEN increment >= 1 AND doc_id % 11 = 0 THEN 'rwx------' WHEN doc_id % 4 = 0 THEN 'rw-r--r--' WHEN doc_id % 4 = 1 THEN 'rwxr-xr-x' WHEN doc_id % 4 = 2 THEN 'r--------' ELSE 'rw-rw-r--' END AS permissions,
  lang AS owner, source AS `group`, CASE WHEN doc_id % 29 = 0 THEN 'SYMBOLIC_LINK' ELSE 'REGULAR_FILE' END AS file_type, doc_id % 37 = 0 AS hidden,
  CASE WHEN increment = 0 THEN 'NEW' WHEN doc_id % 41 = 0 THEN 'DELETED' WHEN doc_id % 7 = 0 THEN 'CONTENT_CHANGED' WHEN doc_id % 11 = 0 THEN 'METADATA_CHANGED' ELSE 'NO_CHANGE' END AS status,
  'e' || CAST(increment AS STRING) || '-' || substr({sha}, 1, 24) AS archive_metadata_id,
  CASE WHEN doc_id % 31 = 0 THEN 'unreadable' END AS error
FROM (
  SELECT CAST(i.increment AS BIGINT) AS increment, doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
    coalesce(text, '') || CASE WHEN doc_id % 7 = 0 AND (i.increment = 1 OR (i.increment = 2 AND doc_id % 14 <> 0)) THEN 'x' ELSE '' END AS t
  FROM {documents} CROSS JOIN (VALUES (0), (1), (2)) AS i(increment)
  WHERE CASE WHEN i.increment = 0 THEN doc_id % 10 <> 9 ELSE doc_id % 13 <> 0 END) d
UNION ALL
SELECT increment, 'set-' || CAST({epoch} + increment * {day} AS STRING), 'd' || CAST(increment AS STRING) || path, NULL, path, NULL, NULL, {epoch}, {epoch}, {epoch}, 'rwxr-xr-x', 'root', 'root', 'DIRECTORY', false,
  CASE WHEN increment = 0 THEN 'NEW' ELSE 'NO_CHANGE' END, NULL, NULL
FROM (SELECT DISTINCT CAST(i.increment AS BIGINT) AS increment, '/' || coalesce(source, 'none') || CASE WHEN j.deep = 1 THEN '/' || coalesce(lang, 'none') ELSE '' END AS path
  FROM {documents} CROSS JOIN (VALUES (0), (1), (2)) AS i(increment) CROSS JOIN (VALUES (0), (1)) AS j(deep)) p
"""

_ARCHIVES = """
SELECT manifest_id, archive_metadata_id AS id, CAST(increment AS INT) AS backup_increment,
  substr(md5(archive_metadata_id), 1, 8) || '-' || substr(md5(archive_metadata_id), 9, 4) || '-' || substr(md5(archive_metadata_id), 13, 4) || '-' || substr(md5(archive_metadata_id), 17, 4) || '-' || substr(md5(archive_metadata_id), 21, 12) AS entry_name,
  min(original_hash) AS original_hash, {list} AS files
FROM {files} WHERE archive_metadata_id IS NOT NULL GROUP BY manifest_id, archive_metadata_id, increment
"""

#: (start, type, version, app version): two full chains and the begin of a third.
CHAIN = ((1000, "FULL", 0, "0.9.12"), (2000, "INCREMENTAL", 1, "0.10.0"), (3000, "INCREMENTAL", 2, "0.10.1"), (4000, "INCREMENTAL", 3, "0.10.1"), (5000, "FULL", 0, "0.10.2"), (6000, "INCREMENTAL", 1, "0.2.30"), (7000, "FULL", 0, "0.10.2"), (8000, "INCREMENTAL", 1, "0.10.2"))


def manifests_sql(dialect: str) -> str:
    array = (_SPARK if dialect == "spark" else _DUCK)["array"]
    rows = ", ".join(f"('set-{s}', '{v}', CAST({s} AS BIGINT), '{t}', CAST({n} AS INT))" for s, t, n, v in CHAIN)
    return f"SELECT manifest_id, app_version, start_time_utc_epoch_seconds, backup_type, {array}(version) AS backup_versions FROM (VALUES {rows}) AS m(manifest_id, app_version, start_time_utc_epoch_seconds, backup_type, version)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _FILES.format(epoch=EPOCH, day=DAY, documents="{documents}", **_SPARK)
    return spark.sql(sql, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def increment(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return files(spark, sf_dir).where(F.col("increment") == n)


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _ARCHIVES.format(files="{files}", **_SPARK)
    rows = spark.sql(sql, files=files(spark, sf_dir))
    return rows.select("manifest_id", "id", F.struct("backup_increment", "entry_name").alias("archive_location"), F.col("original_hash").alias("archived_hash"), "original_hash", "files")


def manifests(spark: SparkSession) -> DataFrame:
    return spark.sql(manifests_sql("spark"))


#: A long history, a row an order: chains of increments with their versions; window functions in DuckDB, two levels in Spark.
_HEADS = """
SELECT 'set-' || CAST(1000 + 10 * o_orderkey AS STRING) AS manifest_id, '0.' || CAST(o_custkey % 12 AS STRING) || '.' || CAST(o_orderkey % 30 AS STRING) AS app_version,
  CAST(1000 + 10 * o_orderkey AS BIGINT) AS start_time_utc_epoch_seconds, CASE WHEN o_orderkey % 40 = 1 THEN 'FULL' ELSE 'INCREMENTAL' END AS backup_type,
  CASE o_custkey % 4 WHEN 0 THEN 'LINUX' WHEN 1 THEN 'MAC' WHEN 2 THEN 'WINDOWS' END AS operating_system
FROM (SELECT o_orderkey, min(o_custkey) AS o_custkey FROM {orders} GROUP BY o_orderkey) o
"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = spark.sql(_HEADS, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    start = "start_time_utc_epoch_seconds"
    full = heads.withColumn("__full", (F.col("backup_type") == "FULL").cast("bigint"))
    chained = running_sum(full, [], start, "__full", "__earlier").withColumn("__chain", F.col("__earlier") + F.col("__full"))
    version = F.row_number().over(Window.partitionBy("__chain").orderBy(start)) - 1
    return chained.withColumn("backup_versions", F.array(version.cast("int"))).drop("__full", "__earlier", "__chain")


def duck(body: str) -> str:
    """body with the tables files, archives and manifests before it, in DuckDB's SQL."""
    made = {
        "files": _FILES.format(epoch=EPOCH, day=DAY, documents="documents", **_DUCK).replace("`group`", '"group"').replace("AS STRING", "AS VARCHAR"),
        "archives": _ARCHIVES.format(files="files", **_DUCK),
        "heads": _HEADS.format(orders="orders").replace("AS STRING", "AS VARCHAR"),
        "chained": "SELECT *, sum(CASE WHEN backup_type = 'FULL' THEN 1 ELSE 0 END) OVER (ORDER BY start_time_utc_epoch_seconds) AS chain_ FROM heads",
        "manifests": "SELECT * EXCLUDE (chain_), list_value(CAST(row_number() OVER (PARTITION BY chain_ ORDER BY start_time_utc_epoch_seconds) - 1 AS INT)) AS backup_versions FROM chained",
    }
    need = [n for n in made if n in body or (n == "files" and "archives" in body) or (n in ("heads", "chained") and "manifests" in body)]
    head = ", ".join(f"{n} AS ({made[n]})" for n in need)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
