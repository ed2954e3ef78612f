"""Registered queries of the metadata engine: one or more for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import content as C
from .functions import paths as P
from .operators import dedup, detect
from .operators import order as O
from .operators import sets as S
from .plans import archive as A
from .plans import increments as I
from .plans import restore as R
from .schemas import change_dim
from .sources import manifests as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fixture: bool = True) -> Callable[[Query], Query]:
    """Register a query; sql: its DuckDB form over the fixture's tables (or the driver's own)."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = X.duck(sql) if fixture else sql
        return f

    return put


FILE_COLUMNS = ("id", "path", "original_hash", "original_size", "permissions", "file_type", "status")
_COLS = ", ".join(FILE_COLUMNS)
TARGETS = (("/src0", "/restore/zero"), ("/src0/en", "/restore/english"), ("/src1", "/elsewhere/one"), ("/moved", "/restore/moved"))
_TARGETS = "t(backup_path, restore_path) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in TARGETS) + ")"


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TARGETS), "backup_path string, restore_path string")


# --- change detection ----------------------------------------------------------------------------------------------

_SAME_HASH = "a.file_type IS NOT DISTINCT FROM b.file_type AND a.original_hash IS NOT DISTINCT FROM b.original_hash AND a.original_size IS NOT DISTINCT FROM b.original_size"
_SAME_SIMPLE = "a.file_type IS NOT DISTINCT FROM b.file_type AND a.original_size IS NOT DISTINCT FROM b.original_size AND a.last_modified_utc_epoch_seconds IS NOT DISTINCT FROM b.last_modified_utc_epoch_seconds AND split_part(a.path, '/', -1) = split_part(b.path, '/', -1)"


def _metadata(rule: str) -> str:
    same = {"STRICT": "b.permissions IS NOT DISTINCT FROM a.permissions AND b.owner IS NOT DISTINCT FROM a.owner AND b.\"group\" IS NOT DISTINCT FROM a.\"group\"", "PERMISSION_ONLY": "b.permissions IS NOT DISTINCT FROM a.permissions", "RELAXED": "substr(b.permissions, 1, 3) IS NOT DISTINCT FROM substr(a.permissions, 1, 3)", "IGNORE": "true"}[rule]
    return f"(b.hidden IS DISTINCT FROM a.hidden OR NOT ({same}) OR (a.file_type <> 'SYMBOLIC_LINK' AND b.last_modified_utc_epoch_seconds IS DISTINCT FROM a.last_modified_utc_epoch_seconds))"


def _delta_sql(current: int, same: str, key: str, select: str, rule: str = "STRICT") -> str:
    """a: current rows, b: earlier rows."""
    content = "(a.file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK') OR b.file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK'))"
    return f"""WITH cur AS (SELECT * FROM files WHERE increment = {current}), old AS (SELECT * FROM files WHERE increment < {current}),
latest AS (SELECT * FROM old WHERE status IS DISTINCT FROM 'DELETED' QUALIFY row_number() OVER (PARTITION BY path ORDER BY increment DESC, id) = 1),
cand AS (
  SELECT a.id AS cid, b.id AS bid, CASE WHEN NOT ({content} AND NOT ({same})) THEN 1 ELSE 3 END AS stage, b.increment AS inc, b.path = a.path AS samep, b.path AS bpath FROM cur a JOIN latest b ON a.path = b.path
  UNION ALL
  SELECT a.id, b.id, 2, b.increment, b.path = a.path, b.path FROM cur a JOIN old b ON a.{key} = b.{key} AND a.file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK') AND {same}),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY cid ORDER BY stage, inc DESC, samep DESC, bpath, bid) = 1),
delta AS (
  SELECT a.*, b.path AS prev_path, b.increment AS prev_increment, CASE WHEN a.file_type = 'MISSING' THEN 'DELETED' WHEN b.id IS NULL OR b.file_type = 'MISSING' THEN 'NEW'
    WHEN {content} AND NOT ({same}) THEN 'CONTENT_CHANGED' WHEN b.increment <> (SELECT max(increment) FROM old) THEN 'ROLLED_BACK' WHEN {_metadata(rule)} THEN 'METADATA_CHANGED' ELSE 'NO_CHANGE' END AS change
  FROM cur a LEFT JOIN best x ON a.id = x.cid LEFT JOIN old b ON b.id = x.bid)
{select}"""


def _delta(spark: SparkSession, sf_dir: str, current: int, by: detect.Detector) -> DataFrame:
    rows = X.files(spark, sf_dir)
    return detect.delta(rows.where(F.col("increment") == current), rows.where(F.col("increment") < current), by)


@query("change_counts", _delta_sql(1, _SAME_HASH, "original_hash", "SELECT change AS status, count(*) AS n FROM delta GROUP BY change"))
def change_counts(spark, sf_dir):
    return S.counts_by_status(_delta(spark, sf_dir, 1, detect.Detector()), "change")


_DELTA_SELECT = "SELECT id, path, prev_path, prev_increment, change FROM delta"


def _delta_rows(spark, sf_dir, by):
    return _delta(spark, sf_dir, 2, by).select(F.col("cur_id").alias("id"), F.col("cur_path").alias("path"), "prev_path", F.col("prev_increment"), "change")


@query("delta_by_hash", _delta_sql(2, _SAME_HASH, "original_hash", _DELTA_SELECT))
def delta_by_hash(spark, sf_dir):
    return _delta_rows(spark, sf_dir, detect.detector("SHA256"))


@query("delta_simple", _delta_sql(2, _SAME_SIMPLE, "original_size", _DELTA_SELECT))
def delta_simple(spark, sf_dir):
    return _delta_rows(spark, sf_dir, detect.detector("NONE"))


for _rule in C.PERMISSION_RULES:
    query(f"permissions_{_rule.lower()}", _delta_sql(1, _SAME_HASH, "original_hash", "SELECT change AS status, count(*) AS n FROM delta GROUP BY change", _rule))(lambda spark, sf_dir, rule=_rule: S.counts_by_status(_delta(spark, sf_dir, 1, detect.Detector(True, rule)), "change"))


@query("latest_by_path", "SELECT path, id, increment FROM files WHERE status IS DISTINCT FROM 'DELETED' QUALIFY row_number() OVER (PARTITION BY path ORDER BY increment DESC, id) = 1")
def latest_by_path(spark, sf_dir):
    return detect.latest_by_path(X.files(spark, sf_dir)).select("path", "id", "increment")


@query("latest_event_by_user", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1", fixture=False)
def latest_event_by_user(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    best = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return best.select("user_id", "e.event_id", "e.event_type")


_DISK_SQL = f"""WITH a AS (SELECT * FROM files WHERE increment = 2), b AS (SELECT * FROM files WHERE increment = 1),
chg AS (SELECT b.path, CASE WHEN a.id IS NULL THEN 'DELETED' WHEN (a.file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK') OR b.file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK')) AND NOT ({_SAME_HASH}) THEN 'CONTENT_CHANGED' WHEN {_metadata('STRICT')} THEN 'METADATA_CHANGED' ELSE 'NO_CHANGE' END AS change
  FROM b LEFT JOIN (SELECT * FROM a WHERE substr(id, length(id), 1) <> '3') a ON a.path = b.path)"""


def _disk(spark, sf_dir):
    rows = X.files(spark, sf_dir)
    on_disk = rows.where("increment = 2").where(~F.col("id").endswith("3"))
    return detect.compare_with_disk(rows.where("increment = 1"), on_disk, detect.Detector(), F.lit(True))


@query("restore_changes", _DISK_SQL + " SELECT path, change FROM chg")
def restore_changes(spark, sf_dir):
    return _disk(spark, sf_dir)


# --- set algebra -----------------------------------------------------------------------------------------------------


def _select(df: DataFrame) -> DataFrame:
    return df.select(*FILE_COLUMNS)


@query("intersect_by_path", f"SELECT {_COLS} FROM files WHERE increment = 1 AND path IN (SELECT path FROM files WHERE increment = 0)")
def intersect_by_path(spark, sf_dir):
    return _select(S.intersect_by_path(X.increment(spark, sf_dir, 1), X.increment(spark, sf_dir, 0)))


@query("subtract_paths", "SELECT DISTINCT path FROM files WHERE increment = 0 AND path NOT IN (SELECT path FROM files WHERE increment = 1)")
def subtract_paths(spark, sf_dir):
    return S.subtract_paths(X.increment(spark, sf_dir, 0), X.increment(spark, sf_dir, 1))


@query("union_distinct", f"SELECT {_COLS} FROM files WHERE increment < 2 QUALIFY row_number() OVER (PARTITION BY path ORDER BY increment, id) = 1")
def union_distinct(spark, sf_dir):
    return _select(S.add_files(X.increment(spark, sf_dir, 0), X.increment(spark, sf_dir, 1)))


@query("referenced_archives", "SELECT id, manifest_id, original_hash FROM archives WHERE id IN (SELECT archive_metadata_id FROM files WHERE hidden)")
def referenced_archives(spark, sf_dir):
    return S.referenced_archives(X.archives(spark, sf_dir), X.files(spark, sf_dir).where("hidden")).select("id", "manifest_id", "original_hash")


@query("files_at_locator", "SELECT '/' || a.backup_increment || '/' || a.entry_name AS locator, f.path FROM (SELECT *, unnest(files) AS fid FROM archives) a JOIN files f ON f.id = a.fid WHERE f.status <> 'DELETED'")
def files_at_locator(spark, sf_dir):
    return S.files_at(X.archives(spark, sf_dir), S.not_deleted(X.files(spark, sf_dir))).select("locator", "path")


@query("entry_of_file", "SELECT fid AS file_id, max(id) AS id FROM (SELECT id, unnest(files) AS fid FROM archives) WHERE fid IN (SELECT id FROM files WHERE error IS NOT NULL) GROUP BY fid")
def entry_of_file(spark, sf_dir):
    return S.entry_of_files(X.archives(spark, sf_dir), S.with_errors(X.files(spark, sf_dir))).select("file_id", "id")


@query("archived_ids", "SELECT DISTINCT id FROM files WHERE increment = 1 AND id IN (SELECT unnest(files) FROM archives)")
def archived_ids(spark, sf_dir):
    return S.archived_ids(X.archives(spark, sf_dir), X.increment(spark, sf_dir, 1))


_HOLDERS = "SELECT a.id, count(DISTINCT b.path) AS n, min(b.path) AS first_path FROM files a LEFT JOIN files b ON a.{0} = b.{0} AND b.increment = 0 WHERE a.increment = {1} GROUP BY a.id"


@query("find_by_hash", _HOLDERS.format("original_hash", 2))
def find_by_hash(spark, sf_dir):
    return S.holders(X.increment(spark, sf_dir, 0), "original_hash", X.increment(spark, sf_dir, 2)).select("id", "n", "first_path")


@query("find_by_size", _HOLDERS.format("original_size", 1))
def find_by_size(spark, sf_dir):
    return S.holders(X.increment(spark, sf_dir, 0), "original_size", X.increment(spark, sf_dir, 1)).select("id", "n", "first_path")


@query("find_by_path", f"SELECT {_COLS} FROM files WHERE increment = 1 AND path IN (SELECT path FROM files WHERE increment = 2 AND hidden)")
def find_by_path(spark, sf_dir):
    return _select(S.by_paths(X.increment(spark, sf_dir, 1), X.increment(spark, sf_dir, 2).where("hidden")))


@query("find_by_id", f"SELECT {_COLS} FROM files WHERE id IN (SELECT files[1] FROM archives)")
def find_by_id(spark, sf_dir):
    return _select(S.by_ids(X.files(spark, sf_dir), X.archives(spark, sf_dir).select(F.col("files")[0].alias("id"))))


@query("contains_path", "SELECT path, path IN (SELECT path FROM files WHERE increment = 2) AS known FROM files WHERE increment = 0")
def contains_path(spark, sf_dir):
    return S.contains(X.increment(spark, sf_dir, 2), X.increment(spark, sf_dir, 0), "path")


_MAPS = "old AS (SELECT path, status FROM files WHERE increment = 0), new AS (SELECT path, arg_max(status, increment) AS status FROM files WHERE increment > 0 GROUP BY path)"


@query("change_map_put", f"WITH {_MAPS} SELECT * FROM new UNION ALL SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)")
def change_map_put(spark, sf_dir):
    rows = X.files(spark, sf_dir)
    return S.put(rows.where("increment = 0").select("path", "status"), rows.where("increment > 0"), "path", "increment")


@query("change_map_remove", f"WITH {_MAPS} SELECT * FROM old WHERE path NOT IN (SELECT path FROM new)")
def change_map_remove(spark, sf_dir):
    rows = X.files(spark, sf_dir)
    return S.remove(rows.where("increment = 0").select("path", "status"), rows.where("increment > 0"), "path")


@query("status_or_default", _delta_sql(1, _SAME_HASH, "original_hash", "SELECT f.path, coalesce(d.change, 'NO_CHANGE') AS change FROM (SELECT DISTINCT path FROM files WHERE increment = 0) f LEFT JOIN delta d ON f.path = d.path"))
def status_or_default(spark, sf_dir):
    changes = _delta(spark, sf_dir, 1, detect.Detector()).select(F.col("cur_path").alias("path"), "change")
    return S.status_or_default(X.increment(spark, sf_dir, 0).select("path").distinct(), changes)


@query("changed_content", _DISK_SQL + " SELECT f.path, c.change FROM files f JOIN chg c ON f.path = c.path WHERE f.increment = 1 AND f.file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK') AND c.change IN ('CONTENT_CHANGED', 'ROLLED_BACK', 'DELETED')")
def changed_content(spark, sf_dir):
    return S.changed_content(X.increment(spark, sf_dir, 1), _disk(spark, sf_dir)).select("path", "change")


@query("changed_metadata", _DISK_SQL + " SELECT f.path, c.change FROM files f JOIN chg c ON f.path = c.path WHERE f.increment = 1 AND f.file_type IN ('REGULAR_FILE', 'DIRECTORY') AND c.change NOT IN ('NEW', 'NO_CHANGE')")
def changed_metadata(spark, sf_dir):
    return S.changed_metadata(X.increment(spark, sf_dir, 1), _disk(spark, sf_dir), ["REGULAR_FILE", "DIRECTORY"]).select("path", "change")


@query("restore_scope", _DISK_SQL + ", s AS (SELECT path FROM files WHERE increment = 2 AND hidden), i AS (SELECT * FROM files WHERE increment = 1 AND path IN (SELECT path FROM s)) SELECT 'files' AS part, count(*) AS n FROM i UNION ALL SELECT 'archives', count(*) FROM archives WHERE id IN (SELECT archive_metadata_id FROM i) UNION ALL SELECT 'changed', count(*) FROM i JOIN chg c ON i.path = c.path WHERE i.file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK') AND c.change IN ('CONTENT_CHANGED', 'ROLLED_BACK', 'DELETED')")
def restore_scope(spark, sf_dir):
    parts = S.restore_scope(X.increment(spark, sf_dir, 1), X.archives(spark, sf_dir), _disk(spark, sf_dir), X.increment(spark, sf_dir, 2).where("hidden"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, df in parts.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("entries_by_version", "SELECT v.prefix, a.id FROM archives a JOIN (VALUES ('one', 0), ('one', 1), ('two', 2)) v(prefix, version) ON a.backup_increment = v.version")
def entries_by_version(spark, sf_dir):
    versions = spark.createDataFrame([("one", [0, 1]), ("two", [2])], "prefix string, versions array<int>")
    return S.locators_by_prefix(X.archives(spark, sf_dir), versions).select("prefix", "id")


@query("map_restore_path", f"WITH {_TARGETS}, p AS (SELECT DISTINCT path FROM files), h AS (SELECT p.path, t.restore_path || substr(p.path, length(t.backup_path) + 1) AS mapped FROM p JOIN t ON p.path = t.backup_path OR starts_with(p.path, t.backup_path || '/') QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY length(t.backup_path) DESC) = 1) SELECT p.path, coalesce(h.mapped, p.path) AS restore_path FROM p LEFT JOIN h ON p.path = h.path")
def map_restore_path(spark, sf_dir):
    return S.map_to_target(X.files(spark, sf_dir), _targets(spark))


_LINKS = "l AS (SELECT path, CASE WHEN hidden THEN '/outside/target' ELSE replace(path, '/moved', '') END AS link_target FROM files WHERE increment = 1 AND file_type = 'SYMBOLIC_LINK')"


def _links(spark, sf_dir):
    rows = X.increment(spark, sf_dir, 1).where("file_type = 'SYMBOLIC_LINK'")
    return rows.select("path", F.when(F.col("hidden"), "/outside/target").otherwise(F.replace("path", F.lit("/moved"), F.lit(""))).alias("link_target"))


@query("resolve_links", f"WITH {_TARGETS}, {_LINKS}, h AS (SELECT DISTINCT l.link_target, t.restore_path || substr(l.link_target, length(t.backup_path) + 1) AS mapped, length(t.backup_path) AS n FROM l JOIN t ON l.link_target = t.backup_path OR starts_with(l.link_target, t.backup_path || '/') WHERE l.link_target IN (SELECT path FROM files WHERE increment = 1)), g AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY link_target ORDER BY n DESC) = 1) SELECT l.path, l.link_target, coalesce(g.mapped, l.link_target) AS resolved FROM l LEFT JOIN g ON l.link_target = g.link_target")
def resolve_links(spark, sf_dir):
    return S.resolve_links(_links(spark, sf_dir), X.increment(spark, sf_dir, 1), _targets(spark))


_AT = "moment AS (SELECT max(start_time_utc_epoch_seconds) * 6 // 10 AS t FROM manifests)"
_ASOF = f"{_AT}, chain AS (SELECT m.* FROM manifests m, moment WHERE start_time_utc_epoch_seconds <= t AND start_time_utc_epoch_seconds >= (SELECT max(start_time_utc_epoch_seconds) FROM manifests, moment WHERE backup_type = 'FULL' AND start_time_utc_epoch_seconds <= t))"


def _share(heads: DataFrame, tenths: int) -> int:
    """A time at so many tenths of the history."""
    return heads.agg(F.max(I.START)).first()[0] * tenths // 10


@query(
    "version_gaps",
    f"WITH {_ASOF}, v AS (SELECT unnest(backup_versions) AS v FROM chain WHERE start_time_utc_epoch_seconds % 70 <> 0), n AS (SELECT count(*) AS n FROM v), w AS (SELECT unnest(range(n)) AS i FROM n) SELECT CAST(n AS INT) AS n, coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM w WHERE i NOT IN (SELECT v FROM v)), '') AS missing, coalesce((SELECT string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) FROM v WHERE v NOT IN (SELECT i FROM w)), '') AS unexpected FROM n",
)
def version_gaps(spark, sf_dir):
    heads = X.chain(spark, sf_dir)
    rows = S.version_gaps(I.as_of(heads, _share(heads, 6)).where(F.col(I.START) % 70 != 0))
    return rows.select(F.col("n").cast("int").alias("n"), F.concat_ws(",", F.col("missing").cast("array<string>")).alias("missing"), F.concat_ws(",", F.col("unexpected").cast("array<string>")).alias("unexpected"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("path_scope", f"SELECT {_COLS} FROM files WHERE increment = 0 AND (path = '/src0' OR starts_with(path, '/src0/'))")
def path_scope(spark, sf_dir):
    return _select(S.under(X.increment(spark, sf_dir, 0), "/src0"))


@query("status_and_type", f"SELECT {_COLS} FROM files WHERE increment = 1 AND status IN ('CONTENT_CHANGED', 'METADATA_CHANGED') AND file_type IN ('REGULAR_FILE', 'DIRECTORY')")
def status_and_type(spark, sf_dir):
    return _select(S.by_status_and_type(X.increment(spark, sf_dir, 1), ["CONTENT_CHANGED", "METADATA_CHANGED"], ["REGULAR_FILE", "DIRECTORY"]))


@query("error_rows", f"SELECT {_COLS} FROM files WHERE error IS NOT NULL")
def error_rows(spark, sf_dir):
    return _select(S.with_errors(X.files(spark, sf_dir)))


@query("not_deleted", f"SELECT {_COLS} FROM files WHERE status IS DISTINCT FROM 'DELETED' AND increment = 2")
def not_deleted(spark, sf_dir):
    return _select(S.not_deleted(X.increment(spark, sf_dir, 2)))


@query("content_sources", f"SELECT {_COLS} FROM files WHERE increment = 2 AND file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK')")
def content_sources(spark, sf_dir):
    return _select(S.content_sources(X.increment(spark, sf_dir, 2)))


@query("archives_of_increments", "SELECT id, backup_increment FROM archives WHERE backup_increment IN (0, 2)")
def archives_of_increments(spark, sf_dir):
    return S.of_increments(X.archives(spark, sf_dir), [0, 2]).select("id", F.col("archive_location.backup_increment").alias("backup_increment"))


@query("entry_paths", "SELECT DISTINCT '/' || backup_increment || '/' || entry_name AS entry_path FROM archives")
def entry_paths(spark, sf_dir):
    at = F.col("archive_location")
    return X.archives(spark, sf_dir).select(P.format_locator(at["backup_increment"], at["entry_name"]).alias("entry_path")).distinct()


@query(
    "glob_filter",
    """WITH p AS (SELECT path, file_type = 'DIRECTORY' AS d FROM files WHERE increment = 0 AND (path = '/src1' OR starts_with(path, '/src1/'))),
k AS (SELECT path, d FROM p WHERE regexp_full_match(path, '/src1/.*[02468]\\.txt|/src1/[a-e][^/]*/[^/]*1\\.txt') AND NOT (path = '/src1/fr' OR starts_with(path, '/src1/fr/')) AND NOT regexp_full_match(path, '/src1/.*/[^/]*4\\.txt')),
u AS (SELECT path, d FROM k UNION ALL SELECT '/src1', true FROM k UNION ALL SELECT regexp_replace(path, '/[^/]*$', ''), true FROM k)
SELECT path, bool_or(d) AS is_directory FROM u GROUP BY path""",
)
def glob_filter(spark, sf_dir):
    paths = X.increment(spark, sf_dir, 0).select("path", (F.col("file_type") == "DIRECTORY").alias("is_directory"))
    return S.select_by_globs(paths, "/src1", ["**[02468].txt", "[a-e]*/*1.txt"], ["fr", "**/*4.txt"])


def _uuid(text: str) -> str:
    """The UUID form of a text's MD5."""
    return " || '-' || ".join(f"substr(md5({text}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


@query("copy_archive_details", f"SELECT {_uuid("'copy' || chr(31) || id")} AS id, backup_increment, original_hash, 0 AS n_files FROM archives WHERE backup_increment = 1")
def copy_archive_details(spark, sf_dir):
    copied = S.copy_details(S.of_increments(X.archives(spark, sf_dir), [1]))
    return copied.select("id", F.col("archive_location.backup_increment").alias("backup_increment"), "original_hash", F.size("files").alias("n_files"))


@query("update_archive_id", "SELECT f.id, coalesce(n.e, f.archive_metadata_id) AS archive_metadata_id FROM files f LEFT JOIN (SELECT id, 'new-' || id AS e FROM files WHERE hidden) n ON f.id = n.id WHERE f.increment = 2")
def update_archive_id(spark, sf_dir):
    rows = X.increment(spark, sf_dir, 2)
    new = rows.where("hidden").select("id", F.concat(F.lit("new-"), "id").alias("archive_metadata_id"))
    return S.relink(rows, new).select("id", "archive_metadata_id")


@query("manifest_names", "SELECT p || '-' || start_time_utc_epoch_seconds || x AS name FROM manifests, (VALUES ('set')) a(p), (VALUES ('.manifest.cargo')) b(x)")
def manifest_names(spark, sf_dir):
    names = F.array(*[F.concat(F.lit(f"{p}-"), F.col(I.START).cast("string"), F.lit(x)) for p in ("set", "settle") for x in (".manifest.cargo", ".index.cargo", ".00001.cargo")])
    return M.manifest_files(X.chain(spark, sf_dir).select(F.explode(names).alias("name")), "set")


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("counts_by_type", "SELECT file_type, count(*) AS n, CASE file_type WHEN 'DIRECTORY' THEN 0 WHEN 'REGULAR_FILE' THEN 1 ELSE 2 END AS ordinal FROM files GROUP BY file_type")
def counts_by_type(spark, sf_dir):
    return S.counts_by_type(X.files(spark, sf_dir)).select("file_type", "n", "ordinal")


@query("counts_by_status", "SELECT status, count(*) AS n FROM files WHERE increment = 2 GROUP BY status")
def counts_by_status(spark, sf_dir):
    return S.counts_by_status(X.increment(spark, sf_dir, 2))


@query("count_all", "SELECT count(*) AS n, count(*) FILTER (WHERE file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK')) AS n_content FROM files")
def count_all(spark, sf_dir):
    return S.count_all(X.files(spark, sf_dir))


@query("total_size", "SELECT CAST(coalesce(sum(original_size), 0) AS BIGINT) AS total_size FROM files WHERE increment = 1")
def total_size(spark, sf_dir):
    return S.total_size(X.increment(spark, sf_dir, 1))


@query("count_archived_files", "SELECT CAST(sum(len(files)) AS BIGINT) AS n_files FROM archives")
def count_archived_files(spark, sf_dir):
    return S.total_files(X.archives(spark, sf_dir))


_GROUP = "SELECT {key} AS group_key, min_by(path, (path, id)) AS first_path, min_by(id, (path, id)) AS first_id, count(*) AS n FROM files WHERE increment = 0 AND status = 'NEW' AND file_type IN ('REGULAR_FILE', 'SYMBOLIC_LINK') GROUP BY 1"


def _groups(spark, sf_dir, strategy, algorithm):
    return S.duplicate_groups(X.increment(spark, sf_dir, 0), C.duplicate_key(strategy, algorithm), ["NEW"], ["REGULAR_FILE", "SYMBOLIC_LINK"])


@query("duplicates_by_hash", _GROUP.format(key="coalesce(original_hash, 'null') || '_' || coalesce(CAST(original_size AS VARCHAR), 'null')"))
def duplicates_by_hash(spark, sf_dir):
    return _groups(spark, sf_dir, "KEEP_ONE_PER_BACKUP", "SHA256")


@query("duplicates_by_name", _GROUP.format(key="split_part(path, '/', -1) || '_' || coalesce(CAST(original_size AS VARCHAR), 'null') || '_' || last_modified_utc_epoch_seconds"))
def duplicates_by_name(spark, sf_dir):
    return _groups(spark, sf_dir, "KEEP_ONE_PER_BACKUP", "NONE")


@query("duplicates_keep_each", _GROUP.format(key="id"))
def duplicates_keep_each(spark, sf_dir):
    return _groups(spark, sf_dir, "KEEP_EACH", "SHA256")


@query("stored_copy", "SELECT id, path, first_value(id) OVER (PARTITION BY original_hash, original_size ORDER BY path, id) AS stored_id FROM files WHERE increment = 0 AND file_type <> 'DIRECTORY'")
def stored_copy(spark, sf_dir):
    return dedup.stored_copies(X.increment(spark, sf_dir, 0), "KEEP_ONE_PER_BACKUP", "SHA256")


@query("saved_bytes", "WITH g AS (SELECT sum(original_size) AS s, any_value(original_size) AS o FROM files WHERE increment = 0 AND file_type <> 'DIRECTORY' GROUP BY original_hash, original_size) SELECT CAST(sum(s) AS BIGINT) AS all_bytes, CAST(sum(o) AS BIGINT) AS stored_bytes, CAST(sum(s) - sum(o) AS BIGINT) AS saved_bytes FROM g")
def saved_bytes(spark, sf_dir):
    return dedup.saved_bytes(X.increment(spark, sf_dir, 0), "KEEP_ONE_PER_BACKUP", "SHA256")


_STORED = "g AS (SELECT min_by(id, (path, id)) AS first_id, min_by(manifest_id, (path, id)) AS manifest_id, min_by(original_hash, (path, id)) AS original_hash, list_sort(list(id)) AS files FROM files WHERE increment = 0 AND file_type <> 'DIRECTORY' GROUP BY coalesce(original_hash, 'null') || '_' || coalesce(CAST(original_size AS VARCHAR), 'null'))"


@query("store_groups", f"WITH {_STORED} SELECT manifest_id, {_uuid("'entry' || chr(31) || first_id")} AS id, {_uuid("'name' || chr(31) || first_id")} AS entry_name, original_hash, array_to_string(files, ',') AS files FROM g")
def store_groups(spark, sf_dir):
    entries, _ = dedup.store_groups(X.increment(spark, sf_dir, 0), "KEEP_ONE_PER_BACKUP", "SHA256", 0)
    return entries.select("manifest_id", "id", F.col("archive_location.entry_name").alias("entry_name"), "original_hash", F.array_join("files", ",").alias("files"))


@query("store_group_links", f"WITH {_STORED}, m AS (SELECT unnest(files) AS id, {_uuid("'entry' || chr(31) || first_id")} AS entry FROM g) SELECT f.id, coalesce(m.entry, f.archive_metadata_id) AS archive_metadata_id FROM files f LEFT JOIN m ON f.id = m.id WHERE f.increment = 0")
def store_group_links(spark, sf_dir):
    _, rows = dedup.store_groups(X.increment(spark, sf_dir, 0), "KEEP_ONE_PER_BACKUP", "SHA256", 0)
    return rows.select("id", "archive_metadata_id")


@query("link_previous", _delta_sql(1, _SAME_HASH, "original_hash", "SELECT d.id AS file_id, b.backup_increment, b.original_hash FROM delta d JOIN files p ON p.path = d.prev_path AND p.increment = d.prev_increment JOIN archives b ON b.id = p.archive_metadata_id WHERE d.change IN ('NO_CHANGE', 'METADATA_CHANGED', 'ROLLED_BACK') AND p.file_type <> 'DIRECTORY'"))
def link_previous(spark, sf_dir):
    changes = _delta(spark, sf_dir, 1, detect.Detector()).join(F.broadcast(change_dim(spark)), "change")
    return dedup.link_previous(changes, X.archives(spark, sf_dir)).select("file_id", F.col("archive_location.backup_increment").alias("backup_increment"), "original_hash")


@query("hash_drift", "SELECT id, CASE WHEN hidden THEN 'The hash changed between delta calculation and archival.' ELSE error END AS error FROM files WHERE increment = 0 AND file_type <> 'DIRECTORY'")
def hash_drift(spark, sf_dir):
    rows = S.content_sources(X.increment(spark, sf_dir, 0))
    stored = rows.select("id", F.when(F.col("hidden"), F.lit("other")).otherwise(F.col("original_hash")).alias("stored_hash"))
    return dedup.mark_drift(rows, stored).select("id", "error")


@query("case_collisions", "WITH p AS (SELECT DISTINCT path FROM files UNION SELECT DISTINCT upper(path) FROM files WHERE hidden) SELECT path FROM p QUALIFY count(*) OVER (PARTITION BY lower(path)) > 1")
def case_collisions(spark, sf_dir):
    rows = X.files(spark, sf_dir)
    return S.case_collisions(rows.select("path").unionAll(rows.where("hidden").select(F.upper("path"))))


@query("max_app_version", "SELECT app_version AS max_version FROM manifests ORDER BY CAST(split_part(app_version, '.', 1) AS INT) DESC, CAST(split_part(app_version, '.', 2) AS INT) DESC, CAST(split_part(app_version, '.', 3) AS INT) DESC LIMIT 1")
def max_app_version(spark, sf_dir):
    return S.max_version(X.chain(spark, sf_dir))


@query("prefix_versions", "SELECT manifest_id AS prefix, unnest(backup_versions) AS version FROM manifests")
def prefix_versions(spark, sf_dir):
    return S.prefix_versions(X.chain(spark, sf_dir))


@query("merged_keys", "WITH k AS (SELECT start_time_utc_epoch_seconds AS s, unnest(backup_versions) AS version, i AS key_index FROM manifests, range(3) r(i)) SELECT CAST(version AS INT) AS version, CAST(key_index AS INT) AS key_index, 'key-' || max(s) || '-' || key_index AS key FROM k GROUP BY version, key_index")
def merged_keys(spark, sf_dir):
    version, start = F.col("backup_versions")[0].cast("string"), F.col(I.START).cast("string")
    own = F.create_map(*[x for i in range(3) for x in (F.lit(str(i)), F.concat(F.lit("key-"), start, F.lit(f"-{i}")))])
    return S.merged_keys(X.chain(spark, sf_dir).withColumn("encryption_keys", F.create_map(version, own)))


@query("single_type", "SELECT '/' || a.backup_increment || '/' || a.entry_name AS locator, count(DISTINCT f.file_type) AS n_types, min(f.file_type) AS file_type FROM (SELECT *, unnest(files) AS fid FROM archives) a JOIN files f ON f.id = a.fid GROUP BY 1")
def single_type(spark, sf_dir):
    return S.single_type(S.files_at(X.archives(spark, sf_dir), X.files(spark, sf_dir)))


@query("progress_percent", "WITH s AS (SELECT o_orderpriority AS step, CAST(count(*) AS BIGINT) AS t, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS d, CAST(min(o_custkey) % 7 + 1 AS BIGINT) AS w FROM orders GROUP BY 1) SELECT CAST(floor(sum(p * w) / sum(w) + 0.5) AS BIGINT) AS percent FROM (SELECT least(100, greatest(0, floor(d * 100.0 / t + 0.5))) AS p, w FROM s)", fixture=False)
def progress_percent(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    steps = orders.groupBy(F.col("o_orderpriority").alias("step")).agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), (F.min("o_custkey") % 7 + 1).alias("weight"))
    return S.progress(steps)


@query("increment_summary", "SELECT manifest_id, count(*) AS n_files, CAST(sum(original_size) // 1048576 AS BIGINT) AS mib, strftime(make_timestamp((1704067200 + any_value(increment) * 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS started FROM files GROUP BY manifest_id")
def increment_summary(spark, sf_dir):
    rows = X.files(spark, sf_dir)
    heads = spark.createDataFrame([(f"set-{X.EPOCH + i * X.DAY}", "FULL" if i == 0 else "INCREMENTAL", X.EPOCH + i * X.DAY) for i in range(3)], f"manifest_id string, backup_type string, {I.START} long")
    return I.summary(heads, rows).select("manifest_id", "n_files", "mib", "started")


@query("distinct_manifests", "SELECT DISTINCT manifest_id FROM files")
def distinct_manifests(spark, sf_dir):
    return S.distinct_manifests(X.files(spark, sf_dir))


@query("size_violations", "SELECT m.manifest_id, 0 AS n_files FROM manifests m WHERE m.manifest_id NOT IN (SELECT manifest_id FROM files)")
def size_violations(spark, sf_dir):
    return S.size_violations(X.chain(spark, sf_dir), X.files(spark, sf_dir), True).select("manifest_id", F.col("n_files").cast("int").alias("n_files"))


# --- order -----------------------------------------------------------------------------------------------------------


@query("page", f"SELECT {_COLS} FROM files WHERE increment = 0 ORDER BY path LIMIT 25 OFFSET 40")
def page(spark, sf_dir):
    return _select(S.page(X.increment(spark, sf_dir, 0), 40, 25))


@query("first_examples", "WITH p AS (SELECT path FROM files WHERE hidden AND increment = 0) SELECT path, greatest(0, (SELECT count(*) FROM p) - 10) AS more FROM p ORDER BY path LIMIT 10")
def first_examples(spark, sf_dir):
    return S.examples(X.increment(spark, sf_dir, 0).where("hidden"), "path")


@query("newest_manifests", "SELECT manifest_id, row_number() OVER (ORDER BY start_time_utc_epoch_seconds DESC) AS nth FROM manifests")
def newest_manifests(spark, sf_dir):
    rows = X.chain(spark, sf_dir).withColumn("order_", -F.col(I.START))
    return O.rank(rows, [], "order_", "nth").select("manifest_id", "nth")


# --- increments ------------------------------------------------------------------------------------------------------

_M = "manifest_id, start_time_utc_epoch_seconds, backup_type"


def _heads(df):
    return df.select("manifest_id", I.START, "backup_type")


@query("as_of", f"WITH {_ASOF} SELECT {_M} FROM chain")
def as_of(spark, sf_dir):
    heads = X.chain(spark, sf_dir)
    return _heads(I.checked_chain(I.as_of(heads, _share(heads, 6))))


@query("latest_at", f"WITH {_AT} SELECT {_M} FROM manifests, moment WHERE start_time_utc_epoch_seconds <= t ORDER BY start_time_utc_epoch_seconds DESC LIMIT 1")
def latest_at(spark, sf_dir):
    heads = X.chain(spark, sf_dir)
    return _heads(I.latest_at(heads, _share(heads, 6)))


@query("latest_for_each", "WITH t AS (SELECT DISTINCT CAST(o_custkey * 37 + o_orderkey * 3 AS BIGINT) AS at FROM orders) SELECT t.at, m.manifest_id FROM t ASOF LEFT JOIN manifests m ON t.at >= m.start_time_utc_epoch_seconds")
def latest_for_each(spark, sf_dir):
    times = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") * 37 + F.col("o_orderkey") * 3).cast("bigint").alias("at")).distinct()
    return I.latest_for_each(times, X.chain(spark, sf_dir))


@query("chain_numbers", "SELECT manifest_id, CAST(sum(CASE WHEN backup_type = 'FULL' THEN 1 ELSE 0 END) OVER (ORDER BY start_time_utc_epoch_seconds) AS BIGINT) AS chain FROM manifests")
def chain_numbers(spark, sf_dir):
    return I.chains(X.chain(spark, sf_dir)).select("manifest_id", "chain")


def _first_from(heads: DataFrame, tenths: int, more: int = 0) -> int:
    """The first start at or after so many tenths of the history."""
    return heads.where(F.col(I.START) >= _share(heads, tenths) + more).agg(F.min(I.START)).first()[0]


_SINCE = "b AS (SELECT min(start_time_utc_epoch_seconds) AS first FROM manifests WHERE start_time_utc_epoch_seconds >= (SELECT max(start_time_utc_epoch_seconds) * {0} // 10 FROM manifests)), until AS (SELECT m.* FROM manifests m, b WHERE start_time_utc_epoch_seconds >= first AND start_time_utc_epoch_seconds < coalesce((SELECT min(start_time_utc_epoch_seconds) FROM manifests, b WHERE backup_type = 'FULL' AND start_time_utc_epoch_seconds > first), 9223372036854775807))"


@query("until_next_full", f"WITH {_SINCE.format(4)} SELECT {_M} FROM until")
def until_next_full(spark, sf_dir):
    heads = X.chain(spark, sf_dir)
    return _heads(I.until_next_full(heads, _first_from(heads, 4)))


_RANGE = "e AS (SELECT max(start_time_utc_epoch_seconds) * 3 // 10 AS low FROM manifests), ends AS (SELECT min(start_time_utc_epoch_seconds) FILTER (WHERE start_time_utc_epoch_seconds >= low) AS first, min(start_time_utc_epoch_seconds) FILTER (WHERE start_time_utc_epoch_seconds >= low + 2900) AS last FROM manifests, e), ranged AS (SELECT m.* FROM manifests m, ends WHERE start_time_utc_epoch_seconds BETWEEN first AND last), selected AS (SELECT * FROM ranged WHERE start_time_utc_epoch_seconds >= coalesce((SELECT max(start_time_utc_epoch_seconds) FROM ranged WHERE backup_type = 'FULL'), 0))"


def _selection(heads: DataFrame) -> DataFrame:
    return I.merge_selection(heads, _first_from(heads, 3), _first_from(heads, 3, 2900))


@query("merge_selection", f"WITH {_RANGE} SELECT {_M} FROM selected")
def merge_selection(spark, sf_dir):
    return _heads(_selection(X.chain(spark, sf_dir)))


def _chain_heads(spark):
    return spark.createDataFrame([(f"set-{X.EPOCH + i * X.DAY}", "0.10.0", X.EPOCH + i * X.DAY, "FULL" if i == 0 else "INCREMENTAL", [i], "LINUX") for i in range(3)], f"manifest_id string, app_version string, {I.START} long, backup_type string, backup_versions array<int>, operating_system string")


@query("merge_files", f"SELECT {_COLS} FROM files WHERE increment = 2 AND status <> 'DELETED'")
def merge_files(spark, sf_dir):
    return _select(I.merged(_chain_heads(spark), X.files(spark, sf_dir), X.archives(spark, sf_dir))["files"])


@query("merge_live_entries", "SELECT id FROM archives WHERE backup_increment = 2 AND id IN (SELECT archive_metadata_id FROM files WHERE increment = 2 AND status <> 'DELETED')")
def merge_live_entries(spark, sf_dir):
    return I.merged(_chain_heads(spark), X.files(spark, sf_dir), X.archives(spark, sf_dir))["archives"].select("id")


@query("merge_header", f"WITH {_RANGE} SELECT 'set-' || min(start_time_utc_epoch_seconds) || '-' || max(start_time_utc_epoch_seconds) AS manifest_id, arg_min(backup_type, start_time_utc_epoch_seconds) AS backup_type, arg_max(app_version, start_time_utc_epoch_seconds) AS app_version FROM selected")
def merge_header(spark, sf_dir):
    return I.merged(_selection(X.chain(spark, sf_dir)), X.files(spark, sf_dir), X.archives(spark, sf_dir))["header"].select("manifest_id", "backup_type", "app_version")


@query("merge_version_directories", f"WITH {_RANGE} SELECT DISTINCT '/' || unnest(backup_versions) AS path FROM selected")
def merge_version_directories(spark, sf_dir):
    return I.version_directories(_selection(X.chain(spark, sf_dir)))


@query("merge_entry_paths", "SELECT DISTINCT manifest_id, '/' || backup_increment || '/' || entry_name AS entry_path FROM archives WHERE entry_name IN (SELECT entry_name FROM archives WHERE backup_increment = 2)")
def merge_entry_paths(spark, sf_dir):
    rows = X.archives(spark, sf_dir)
    return I.live_entries(_chain_heads(spark), rows, S.of_increments(rows, [2]))


@query("inspect_content", "SELECT permissions, owner, \"group\", original_size AS size, strftime(make_timestamp(last_modified_utc_epoch_seconds * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS last_modified, coalesce(original_hash, '-') AS hash_sha256, path FROM files WHERE increment = 1")
def inspect_content(spark, sf_dir):
    last = I.latest_at(_chain_heads(spark), X.EPOCH + X.DAY + 5)
    return I.contents(I.chosen(X.files(spark, sf_dir), last))


@query("delete_plan", f"WITH {_SINCE.format(5)} SELECT m.manifest_id || x AS name, k AS kind, m.manifest_id FROM until m, (VALUES ('.00001.cargo', 'chunk'), ('.00002.cargo', 'chunk'), ('.index.cargo', 'index'), ('.manifest.cargo', 'manifest'), ('.manifest.json.gz', 'history')) v(x, k)")
def delete_plan(spark, sf_dir):
    heads = X.chain(spark, sf_dir)
    ends = [".00001.cargo", ".00002.cargo", ".index.cargo", ".manifest.cargo", ".manifest.json.gz", ".0001.cargo", ".txt"]
    listing = heads.select(F.explode(F.array(*[F.concat("manifest_id", F.lit(e)) for e in ends])).alias("name"))
    return I.delete_plan(listing, I.until_next_full(heads, _first_from(heads, 5)))


# --- restore ---------------------------------------------------------------------------------------------------------

_MAPPED = f"""{_TARGETS}, f1 AS (SELECT * FROM files WHERE increment = 1),
mp AS (SELECT p.path, coalesce(h.mapped, p.path) AS restore_path FROM (SELECT DISTINCT path FROM f1) p LEFT JOIN (SELECT p.path, t.restore_path || substr(p.path, length(t.backup_path) + 1) AS mapped FROM (SELECT DISTINCT path FROM f1) p JOIN t ON p.path = t.backup_path OR starts_with(p.path, t.backup_path || '/') QUALIFY row_number() OVER (PARTITION BY p.path ORDER BY length(t.backup_path) DESC) = 1) h ON p.path = h.path),
loc AS (SELECT f.*, '/' || a.backup_increment || '/' || a.entry_name AS locator FROM f1 f JOIN (SELECT *, unnest(files) AS fid FROM archives) a ON f.id = a.fid WHERE f.file_type = 'REGULAR_FILE'),
fst AS (SELECT *, first_value(path) OVER w AS fp, first_value(file_system_key) OVER w AS fk FROM loc WINDOW w AS (PARTITION BY locator ORDER BY path)),
content AS (SELECT CASE WHEN path = fp THEN 'write' WHEN file_system_key = fk THEN 'hardlink' ELSE 'copy' END AS op, path, CASE WHEN path <> fp THEN fp END AS src, locator FROM fst)"""


@query("restore_content_plan", f"WITH {_MAPPED} SELECT op, m.restore_path AS path, s.restore_path AS source_path, locator FROM content c JOIN mp m ON c.path = m.path LEFT JOIN mp s ON c.src = s.path")
def restore_content_plan(spark, sf_dir):
    return R.content_plan(X.increment(spark, sf_dir, 1), X.archives(spark, sf_dir), _targets(spark)).select("op", "path", "source_path", "locator")


@query(
    "restore_plan",
    _DISK_SQL.replace("WITH a AS", f"WITH {_MAPPED}, a AS", 1)
    + """, pl AS (
  SELECT 0 AS step, 'mkdir' AS op, m.restore_path AS path FROM f1 JOIN mp m ON f1.path = m.path WHERE f1.file_type = 'DIRECTORY'
  UNION ALL SELECT CASE op WHEN 'write' THEN 1 WHEN 'hardlink' THEN 2 ELSE 3 END, op, m.restore_path FROM content c JOIN mp m ON c.path = m.path
  UNION ALL SELECT CASE WHEN f1.file_type = 'DIRECTORY' THEN 7 ELSE 6 END, CASE WHEN f1.file_type = 'DIRECTORY' THEN 'metadata_directory' ELSE 'metadata' END, m.restore_path FROM f1 JOIN chg c ON f1.path = c.path JOIN mp m ON f1.path = m.path WHERE f1.file_type IN ('REGULAR_FILE', 'DIRECTORY') AND c.change NOT IN ('NEW', 'NO_CHANGE')
  UNION ALL SELECT 5, 'delete', d.path FROM (SELECT DISTINCT '/restore/zero/old' || path AS path FROM files WHERE hidden AND increment = 0) d WHERE d.path NOT IN (SELECT restore_path FROM mp))
SELECT step, op, path FROM pl""",
)
def restore_plan(spark, sf_dir):
    rows = X.increment(spark, sf_dir, 1)
    on_disk = X.increment(spark, sf_dir, 0).where("hidden").select(F.concat(F.lit("/restore/zero/old"), "path").alias("path")).distinct()
    return R.plan(rows, X.archives(spark, sf_dir), _targets(spark), _disk(spark, sf_dir), on_disk, True).select("step", "op", "path")


@query("left_over_paths", "SELECT DISTINCT path FROM files WHERE increment = 0 AND path NOT IN (SELECT path FROM files WHERE increment = 2) AND starts_with(path, '/src2')")
def left_over_paths(spark, sf_dir):
    mapped = X.increment(spark, sf_dir, 2).select(F.col("path").alias("restore_path"))
    return R.left_over(X.increment(spark, sf_dir, 0), mapped, F.col("path").startswith("/src2"))


@query("restore_evaluation", _DISK_SQL + " SELECT f.path, c.change, CASE c.change WHEN 'METADATA_CHANGED' THEN 'Failed to restore file metadata.' WHEN 'DELETED' THEN 'Missing, could not be restored.' ELSE 'Failed to restore file content.' END AS message FROM files f JOIN chg c ON f.path = c.path WHERE f.increment = 1 AND f.file_type IN ('REGULAR_FILE', 'DIRECTORY') AND c.change NOT IN ('NEW', 'NO_CHANGE')")
def restore_evaluation(spark, sf_dir):
    return R.evaluate(X.increment(spark, sf_dir, 1), _disk(spark, sf_dir)).select("path", "change", "message")


# --- archives --------------------------------------------------------------------------------------------------------

_CHUNK = 1_000_000
_ENTRIES = "e AS (SELECT 'arc' || CAST(l_orderkey % 4 AS VARCHAR) AS prefix, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord, CAST(l_quantity AS BIGINT) * 1000 + l_linenumber AS arch_size FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1), o AS (SELECT *, CAST(coalesce(sum(arch_size) OVER (PARTITION BY prefix ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS abs_start FROM e), "
_OFFSETS = _ENTRIES + f"r AS (SELECT *, abs_start + arch_size AS abs_end, CAST(greatest(1, ceil(abs_start / {_CHUNK})) AS INT) AS start_chunk, CAST(greatest(1, ceil((abs_start + arch_size) / {_CHUNK})) AS INT) AS end_chunk FROM o)"


def _entries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min_by("l_quantity", F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("q"))
    return one.select(F.concat(F.lit("arc"), (F.col("l_orderkey") % 4).cast("string")).alias("prefix"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("ord"), (F.col("q").cast("bigint") * 1000 + F.col("l_linenumber")).alias("arch_size"))


def _offset_rows(spark, sf_dir):
    return A.offsets(_entries(spark, sf_dir), "arc", _CHUNK)


@query("archive_offsets", "WITH " + _OFFSETS + f" SELECT prefix, ord, abs_start, abs_end, start_chunk, end_chunk, abs_start - (start_chunk - 1) * {_CHUNK} AS rel_start, abs_end - (end_chunk - 1) * {_CHUNK} AS rel_end, format('{{}}.{{:05d}}.cargo', prefix, end_chunk) AS end_file FROM r", fixture=False)
def archive_offsets(spark, sf_dir):
    return _offset_rows(spark, sf_dir).select("prefix", "ord", "abs_start", "abs_end", "start_chunk", "end_chunk", "rel_start", "rel_end", "end_file")


@query("range_scan", "WITH " + _OFFSETS + ", w AS (SELECT prefix, min(abs_start) AS low, max(abs_end) AS high FROM r WHERE ord % 971 = 5 GROUP BY prefix) SELECT r.prefix, r.ord FROM r JOIN w ON r.prefix = w.prefix WHERE abs_start >= low AND abs_end <= high", fixture=False)
def range_scan(spark, sf_dir):
    index = _offset_rows(spark, sf_dir).withColumn("path", F.concat(F.lit("/"), F.col("ord").cast("string")))
    wanted = index.where("ord % 971 = 5")
    return A.range_scan(index, wanted).select("prefix", "ord")


@query("merged_offsets", "WITH " + _OFFSETS + " SELECT prefix, ord, CAST(coalesce(sum(arch_size) OVER (ORDER BY prefix, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_start FROM r", fixture=False)
def merged_offsets(spark, sf_dir):
    return A.merged_offsets(_entries(spark, sf_dir)).select("prefix", "ord", "new_start")


@query("entry_parts", "WITH " + _ENTRIES + "k AS (SELECT prefix, ord, row_number() OVER (ORDER BY ord) AS rank, count(*) OVER () AS n FROM o) SELECT prefix, ord, rank, CAST((rank - 1) // (n // 7 + 1) AS INT) AS part FROM k", fixture=False)
def entry_parts(spark, sf_dir):
    return R.partitions(_entries(spark, sf_dir), "ord", 7).select("prefix", "ord", "rank", "part")


def _index(spark, sf_dir):
    rows = _offset_rows(spark, sf_dir)
    fields = {"orig_size": F.col("arch_size"), "orig_hash": F.lit(None).cast("string"), "arch_hash": F.lit("h")}
    content = F.struct(*[fields.get(k, F.col(k) if k in rows.columns else None).alias(k) for k in A.BOUNDARY_KEYS])
    none = F.lit(None).cast(rows.select(content.alias("c")).schema["c"].dataType)
    return rows.select("prefix", "ord", F.concat(F.lit("/"), F.col("ord").cast("string")).alias("path"), F.lit("REGULAR_FILE").alias("type"), F.lit(False).alias("encrypted"), content.alias("content"), none.alias("metadata"))


@query("index_round_trip", "WITH " + _OFFSETS + " SELECT prefix, ord, '/' || ord AS path, abs_start, abs_end, arch_size FROM r", fixture=False)
def index_round_trip(spark, sf_dir):
    back = A.parse_index(A.index_lines(_index(spark, sf_dir)))
    return back.select("prefix", "ord", "path", "content.abs_start", "content.abs_end", "content.arch_size")


_FOOT = _OFFSETS + f", f AS (SELECT prefix, max(end_chunk) AS last_chunk, max(abs_end) - (max(end_chunk) - 1) * {_CHUNK} AS last_size, count(*) AS n, max(abs_end) AS total FROM r GROUP BY prefix)"


def _footers(spark, sf_dir):
    """Footers of the archives of `_entries`; every other one with the old files' misspelt keys."""
    totals = _offset_rows(spark, sf_dir).groupBy("prefix").agg(F.max("end_chunk").alias("last"), F.max("abs_end").alias("total"), F.count("*").alias("n"))
    odd = F.col("prefix").isin("arc1", "arc3")

    def line(key: str, value) -> F.Column:
        return F.concat(F.when(odd, key.replace("chunk", "cnunk")).otherwise(key), F.lit(":"), value.cast("string"))

    lines = [line("last.chunk.index", F.col("last")), line("last.chunk.size", F.col("total") - (F.col("last").cast("bigint") - 1) * F.lit(_CHUNK)), line("max.chunk.size", F.lit(_CHUNK)), line("last.entity.index", F.col("n")), line("total.size", F.col("total")), F.when(~odd, "version:2")]
    return A.footer(totals.select("prefix", F.explode(F.array_compact(F.array(*lines))).alias("line")))


@query("archive_footer", f"WITH {_FOOT} SELECT prefix, CASE WHEN prefix IN ('arc1', 'arc3') THEN 1 ELSE 2 END AS version, last_chunk, last_size AS last_chunk_size, n AS n_entities, total AS total_size FROM f", fixture=False)
def archive_footer(spark, sf_dir):
    return _footers(spark, sf_dir).select("prefix", "version", "last_chunk", "last_chunk_size", "n_entities", "total_size")


_CHUNKS = f"WITH {_FOOT}, c AS (SELECT prefix, unnest(range(1, last_chunk + 1)) AS n, last_chunk, last_size FROM f)"


@query("chunk_list", _CHUNKS + f" SELECT prefix, format('{{}}.{{:05d}}.cargo', prefix, n) AS name, CAST(CASE WHEN n = last_chunk THEN last_size ELSE {_CHUNK} END AS BIGINT) AS size FROM c", fixture=False)
def chunk_list(spark, sf_dir):
    return A.expected_chunks(_footers(spark, sf_dir))


@query("chunk_violations", _CHUNKS + " SELECT format('{}.{:05d}.cargo', prefix, n) AS name FROM c WHERE n % 5 = 2 OR n % 7 = 3", fixture=False)
def chunk_violations(spark, sf_dir):
    # five digits or more
    footers, number = _footers(spark, sf_dir), F.regexp_extract("name", r"([0-9]+)\.cargo$", 1).cast("int")
    listing = A.expected_chunks(footers).where(number % 7 != 3).select("name", F.when(number % 5 == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return A.chunk_violations(footers, listing).select("name")


@query("entry_lookup", "WITH " + _OFFSETS + " SELECT prefix, ord, '/' || ord AS path, abs_start, abs_end FROM r WHERE ord = (SELECT max(ord) FROM r)", fixture=False)
def entry_lookup(spark, sf_dir):
    index, last = _index(spark, sf_dir), _entries(spark, sf_dir).agg(F.max("ord")).first()[0]
    return A.entry_at(A.index_lines(index), f"/{last}").select("prefix", "ord", "path", "content.abs_start", "content.abs_end")


@query("unsafe_paths", "SELECT path || '/../x' AS path FROM files WHERE increment = 0 AND hidden")
def unsafe_paths(spark, sf_dir):
    rows = X.increment(spark, sf_dir, 0).select(F.when(F.col("hidden"), F.concat("path", F.lit("/../x"))).otherwise(F.col("path")).alias("path"))
    return A.unsafe_paths(rows)


@query("entity_path_rules", "SELECT path, 'parent is no directory' AS why FROM files WHERE increment = 1 AND starts_with(path, '/moved/') UNION SELECT path, 'repeated' FROM files WHERE increment = 1 AND hidden UNION SELECT 'x' || path, 'not absolute' FROM files WHERE increment = 1 AND hidden UNION SELECT 'x' || path, 'parent is no directory' FROM files WHERE increment = 1 AND hidden")
def entity_path_rules(spark, sf_dir):
    rows = X.increment(spark, sf_dir, 1).select("path", F.col("file_type").alias("type"), "hidden")
    more = rows.where("hidden")
    return A.path_violations(rows.unionByName(more).unionByName(more.withColumn("path", F.concat(F.lit("x"), "path"))))


@query("archive_integrity", "SELECT 'arc' || coalesce(source, 'none') AS prefix, bool_and(doc_id % 997 <> 3) AS valid, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY 1", fixture=False)
def archive_integrity(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = F.when(F.col("doc_id") % 997 == 3, "another hash").otherwise(F.sha2(text, 256))
    rows = docs.select(F.concat(F.lit("arc"), F.coalesce("source", F.lit("none"))).alias("prefix"), F.col("doc_id").alias("ord"), text.alias("raw"), F.octet_length(text).cast("bigint").alias("arch_size"), stored.alias("arch_hash"), F.sha2(text, 256).alias("orig_hash"))
    placed = A.placed(rows, 4 << 20)
    parts = A.parts(placed, 4 << 20, 1 << 20)
    decoded = A.content_of(placed.drop("raw"), parts, max_chunk=4 << 20, part=1 << 20)
    return A.integrity(decoded).select("prefix", "valid", "n", F.col("end").alias("bytes"))


@query("crypto_round_trip", "SELECT doc_id, sha256(text) AS content_hash FROM documents", fixture=False)
def crypto_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = F.lit(bytes(range(32)))
    packed = C.encrypt(C.compress(F.col("text").cast("binary"), "GZIP"), key)
    return docs.select("doc_id", F.sha2(C.decompress(C.decrypt(packed, key), "GZIP"), 256).alias("content_hash"))


# --- scalar functions --------------------------------------------------------------------------------------------------


@query("path_functions", "SELECT path, split_part(path, '/', -1) AS file_name, nullif(regexp_replace(path, '/[^/]*$', ''), '') AS parent, 'file://' || path AS uri, 'file://' || path || '/' AS directory_uri FROM files WHERE increment = 1")
def path_functions(spark, sf_dir):
    p = F.col("path")
    return X.increment(spark, sf_dir, 1).select("path", P.file_name(p).alias("file_name"), P.parent(p).alias("parent"), P.to_uri(p).alias("uri"), P.directory_uri(p).alias("directory_uri"))


@query("path_from_uri", "SELECT path, path AS back, path AS normal FROM files WHERE increment = 1")
def path_from_uri(spark, sf_dir):
    p = F.col("path")
    odd = F.concat(F.lit("/./a/.."), F.replace(p, F.lit("/"), F.lit("//")))
    return X.increment(spark, sf_dir, 1).select("path", P.from_uri(P.to_uri(p)).alias("back"), P.resolve_dots(odd).alias("normal"))


@query("ancestors", "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM files WHERE file_type <> 'DIRECTORY' UNION SELECT DISTINCT regexp_replace(path, '/[^/]*/[^/]*$', '') FROM files WHERE file_type <> 'DIRECTORY' UNION SELECT DISTINCT '/moved' FROM files WHERE starts_with(path, '/moved/')")
def ancestors(spark, sf_dir):
    return X.files(spark, sf_dir).where("file_type <> 'DIRECTORY'").select(F.explode(P.ancestors(F.col("path"))).alias("path")).distinct()


@query("locator_parse", "SELECT '/' || backup_increment || '/' || entry_name AS locator, backup_increment, entry_name FROM archives UNION ALL SELECT '/x/' || entry_name, NULL, NULL FROM archives")
def locator_parse(spark, sf_dir):
    rows = X.archives(spark, sf_dir).select("archive_location.*")
    good = rows.select(P.format_locator(F.col("backup_increment"), F.col("entry_name")).alias("locator"))
    every = good.unionAll(rows.select(F.concat(F.lit("/x/"), "entry_name")))
    return every.select("locator", P.parse_locator(F.col("locator")).alias("p")).select("locator", "p.backup_increment", "p.entry_name")


@query("key_index", "SELECT entry_name, CAST(CASE WHEN v < 2147483648 THEN v % 16 ELSE (4294967296 - v) % 16 END AS INT) AS key_index FROM (SELECT entry_name, CAST('0x' || right(entry_name, 8) AS BIGINT) AS v FROM archives)")
def key_index(spark, sf_dir):
    return X.archives(spark, sf_dir).select(F.col("archive_location.entry_name").alias("entry_name")).select("entry_name", C.key_index(F.col("entry_name")).alias("key_index"))


@query("content_hashes", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents", fixture=False)
def content_hashes(spark, sf_dir):
    t = F.col("text").cast("binary")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", *[C.digest(t, a).alias(a.lower()) for a in ("MD5", "SHA1", "SHA256")])


@query("names", "SELECT manifest_id, format('{}.{:05d}.cargo', manifest_id, v) AS chunk, manifest_id || '.index.cargo' AS index_file, format('{:08d}', v) AS entry, CASE WHEN v = 1 THEN 'WINDOWS' WHEN v = 2 THEN 'MAC' WHEN v = 3 THEN 'LINUX' ELSE 'UNKNOWN' END AS os FROM (SELECT manifest_id, CAST(unnest(backup_versions) AS INT) AS v FROM manifests)")
def names(spark, sf_dir):
    rows = X.chain(spark, sf_dir).select("manifest_id", F.col("backup_versions")[0].alias("v"))
    raw = F.when(F.col("v") == 1, "Windows 11").when(F.col("v") == 2, "Mac OS X").when(F.col("v") == 3, "Linux").otherwise("Solaris")
    return rows.select("manifest_id", P.chunk_name(F.col("manifest_id"), F.col("v")).alias("chunk"), P.index_name(F.col("manifest_id")).alias("index_file"), P.entry_prefix(F.col("v").cast("bigint")).alias("entry"), P.operating_system(raw).alias("os"))


@query("permission_text", "SELECT DISTINCT permissions FROM files")
def permission_text(spark, sf_dir):
    bits = [F.substring("permissions", i + 1, 1) != "-" for i in range(9)]
    return X.files(spark, sf_dir).select(C.permission_text(*bits).alias("permissions")).distinct()
