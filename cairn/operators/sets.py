"""Set algebra, filters, lookups, aggregates and ordering of the metadata tables (C*, D1-D8, D11, D17-D20, E*, G*, H*).

Tables are DataFrames with the schemas of `cairn.schemas`; every function returns a DataFrame and none collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.content import derived_id
from ..schemas import CONTENT_TYPES, change_dim, file_type_dim

# --- filters -----------------------------------------------------------------------------------------------------


def under(files: DataFrame, path: str) -> DataFrame:
    """C4: the path itself and what lies below it."""
    return files.where(P.is_at_or_under(F.col("path"), F.lit(path)))


def by_status_and_type(files: DataFrame, statuses: list[str], types: list[str], descending: bool = False) -> DataFrame:
    """Rows of the given statuses and types in path order."""
    rows = files.where(F.col("status").isin(statuses) & F.col("file_type").isin(types))
    return rows.orderBy(F.desc("path") if descending else F.asc("path"))


def with_errors(files: DataFrame) -> DataFrame:
    """C7."""
    return files.where(F.col("error").isNotNull())


def not_deleted(files: DataFrame) -> DataFrame:
    """A null status is no deletion."""
    return files.where(~F.col("status").eqNullSafe("DELETED"))


def content_sources(files: DataFrame) -> DataFrame:
    """C9."""
    return files.where(F.col("file_type").isin(*CONTENT_TYPES))


def of_increments(archives: DataFrame, increments: list[int]) -> DataFrame:
    """C14."""
    return archives.where(F.col("archive_location.backup_increment").isin(increments))


def select_by_globs(paths: DataFrame, source: str, include: list[str], exclude: list[str]) -> DataFrame:
    """C1-C3 over (path, is_directory) rows of one source's tree.

    A file stays if it matches an include pattern (none given: all) and no exclude pattern; a directory likewise, or as an
    ancestor, up to the source, of a row that stays. Nothing below an excluded directory stays.
    """
    root = source.rstrip("/")
    inside = paths.where(P.is_at_or_under(F.col("path"), F.lit(root))).select("path", "is_directory")
    chain = F.filter(P.ancestors(F.col("path")), lambda a: P.is_at_or_under(a, F.lit(root)))
    wanted = P.matches_any(F.col("path"), root, include or ["**"])
    if not include:
        wanted = wanted | (F.col("path") == root)
    if exclude:
        pattern = "|".join(f"(?:{P.glob_to_regex(root + '/' + p)})" for p in exclude)
        inside = inside.where(~F.exists(F.array_append(chain, F.col("path")), lambda a: a.rlike(pattern)))
    kept = inside.where(wanted)
    parents = kept.select(F.explode(chain).alias("path")).distinct().withColumn("is_directory", F.lit(True))
    return kept.unionByName(parents).groupBy("path").agg(F.bool_or("is_directory").alias("is_directory"))


# --- joins and set operations ----------------------------------------------------------------------------------------


def intersect_by_path(files: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows of files whose path is in scope."""
    return files.join(scope.select("path"), "path", "left_semi")


def subtract_paths(paths: DataFrame, remove: DataFrame) -> DataFrame:
    """D3, H5: distinct paths that are not in remove."""
    return paths.select("path").distinct().join(remove.select("path"), "path", "left_anti")


def add_files(files: DataFrame, more: DataFrame) -> DataFrame:
    """H2: union distinct by path; the row of the first table stays, and within a table the smallest id."""
    both = files.withColumn("__nth", F.lit(0)).unionByName(more.withColumn("__nth", F.lit(1)))
    w = Window.partitionBy("path").orderBy("__nth", "id")
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__nth")


def referenced_archives(archives: DataFrame, files: DataFrame) -> DataFrame:
    """Archive entries that a file refers to."""
    return archives.join(files.select(F.col("archive_metadata_id").alias("id")), "id", "left_semi")


def entry_of_files(archives: DataFrame, file_ids: DataFrame | None = None) -> DataFrame:
    """(file_id, entry columns but `files`); where several entries name a file, the largest entry id is the last writer.

    An entry's list of files does not go with each of them: that grows with the square of a group of duplicates.
    """
    rows = archives.withColumn("file_id", F.explode("files"))
    if file_ids is not None:
        rows = rows.join(file_ids.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    best = rows.groupBy("file_id").agg(F.max_by(F.struct(*[c for c in archives.columns if c != "files"]), F.col("id")).alias("e"))
    return best.select("file_id", "e.*")


def files_at(archives: DataFrame, files: DataFrame) -> DataFrame:
    """(locator, file columns), every file stored at each locator, ordered by nothing."""
    rows = archives.select(P.format_locator(F.col("archive_location.backup_increment"), F.col("archive_location.entry_name")).alias("locator"), F.explode("files").alias("id"))
    return rows.join(files, "id")


def archived_ids(archives: DataFrame, ids: DataFrame) -> DataFrame:
    """The ids that some entry holds."""
    return ids.select("id").distinct().join(archives.select(F.explode("files").alias("id")), "id", "left_semi")


def by_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of the given paths; a path that no row has gives none."""
    return files.join(paths.select("path"), "path", "left_semi")


def by_ids(files: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given ids."""
    return files.join(ids.select("id"), "id", "left_semi")


def contains(files: DataFrame, asked: DataFrame, column: str) -> DataFrame:
    """(column, known): whether each asked path or id is there."""
    own = files.select(F.col(column).alias("__has")).distinct()
    return asked.select(column).join(own, F.col(column).eqNullSafe(F.col("__has")), "left").select(column, F.col("__has").isNotNull().alias("known"))


def holders(files: DataFrame, column: str, asked: DataFrame) -> DataFrame:
    """Asked rows (id, column) with the number of paths that have an equal hash or size, and the first of them.

    The paths are counted by value before the join, so that a value which very many have meets one row.
    """
    found = files.where(F.col(column).isNotNull()).select(column, "path").distinct().groupBy(column).agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    return asked.select("id", column).join(found, column, "left").select("id", column, F.coalesce("n", F.lit(0)).alias("n"), "first_path")


def relink(files: DataFrame, links: DataFrame) -> DataFrame:
    """Files with the archive id that links (id, archive_metadata_id) give them, or their own."""
    new = links.select(F.col("id").alias("__of"), F.col("archive_metadata_id").alias("__entry"))
    return files.join(new, F.col("id") == F.col("__of"), "left").withColumn("archive_metadata_id", F.coalesce("__entry", "archive_metadata_id")).drop("__of", "__entry")


def copy_details(archives: DataFrame, purpose: str = "copy") -> DataFrame:
    """C20: entries under a new id, which the old one decides, and without files."""
    return archives.withColumn("id", derived_id(F.lit(purpose), F.col("id"))).withColumn("files", F.array().cast("array<string>"))


def put(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """H6: the table as a map by key: rows replace those of equal keys; among themselves the last by `order` wins."""
    if order is not None:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key]), order).alias("__r")).select(key, "__r.*")
    rows = rows.select(*table.columns)
    return table.join(rows.select(key), key, "left_anti").select(*table.columns).unionByName(rows)


def remove(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """H6: the table without the given keys."""
    return table.join(keys.select(key), key, "left_anti")


def status_or_default(files: DataFrame, changes: DataFrame, default: str = "NO_CHANGE") -> DataFrame:
    """Files with the change of their path, or the default."""
    return files.join(changes.select("path", "change"), "path", "left").withColumn("change", F.coalesce("change", F.lit(default)))


def changed_content(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Content sources whose change restores content."""
    return _by_flag(content_sources(files), changes, "restore_content")


def changed_metadata(files: DataFrame, changes: DataFrame, types: list[str]) -> DataFrame:
    """C17: rows of the types whose change restores metadata."""
    return _by_flag(files.where(F.col("file_type").isin(types)), changes, "restore_metadata")


def _by_flag(files: DataFrame, changes: DataFrame, flag: str) -> DataFrame:
    # the dimension has six rows
    dim = F.broadcast(change_dim(files.sparkSession).where(flag).select("change"))
    return status_or_default(files, changes).join(dim, "change", "left_semi").select(*files.columns, "change")


def restore_scope(files: DataFrame, archives: DataFrame, changes: DataFrame, scope: DataFrame) -> dict[str, DataFrame]:
    """Files in scope, their entries, and the changed content among them."""
    inside = intersect_by_path(files, scope)
    return {"files": inside, "archives": referenced_archives(archives, inside), "changed": changed_content(inside, changes)}


def locators_by_prefix(archives: DataFrame, versions: DataFrame) -> DataFrame:
    """(prefix, entry columns) by the prefix whose versions (prefix, versions array) hold the entry's increment."""
    each = versions.select("prefix", F.explode("versions").alias("version"))
    return archives.join(each, F.col("archive_location.backup_increment") == F.col("version")).drop("version")


def version_gaps(manifests: DataFrame) -> DataFrame:
    """One row: missing and unexpected versions of a chain that should have 0 to n - 1."""
    found = manifests.select(F.explode("backup_versions").alias("v")).agg(F.array_sort(F.collect_set("v")).alias("found"), F.count("*").alias("n"))
    wanted = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return found.select("n", F.array_sort(F.array_except(wanted, "found")).alias("missing"), F.array_sort(F.array_except("found", wanted)).alias("unexpected"))


def map_to_target(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, restore_path): the longest target's backup_path at or above the path decides; without one, the path itself.

    Each path is joined on its own ancestors, so the join is an equality on a key and never a nested loop.
    """
    goal = targets.select(F.regexp_replace("backup_path", "(?<=.)/$", "").alias("__at"), "restore_path", "backup_path")
    own = paths.select("path").distinct()
    each = own.select("path", F.explode(F.array_append(P.ancestors(F.col("path")), F.col("path"))).alias("__at"))
    hit = each.join(goal, "__at")
    mapped = P.to_restore_path(F.col("path"), F.col("__at"), F.col("restore_path"))
    best = hit.groupBy("path").agg(F.max_by(mapped, F.struct(F.length("__at"), F.col("restore_path"))).alias("mapped"))
    return own.join(best, "path", "left").select("path", F.coalesce("mapped", "path").alias("restore_path"))


def resolve_links(links: DataFrame, paths: DataFrame, targets: DataFrame) -> DataFrame:
    """Links (path, link_target): the target is mapped only if it is a path of the backup."""
    inside = map_to_target(links.select(F.col("link_target").alias("path")).distinct().join(paths.select("path"), "path", "left_semi"), targets)
    known = inside.select(F.col("path").alias("link_target"), F.col("restore_path").alias("mapped"))
    return links.join(known, "link_target", "left").select("path", "link_target", F.coalesce("mapped", "link_target").alias("resolved"))


# --- aggregates ------------------------------------------------------------------------------------------------------


def count_all(files: DataFrame) -> DataFrame:
    """(n, n_content): all rows, and those whose type carries content; none is zero."""
    return files.agg(F.count("*").alias("n"), F.count_if(F.col("file_type").isin(*CONTENT_TYPES)).alias("n_content"))


def distinct_manifests(rows: DataFrame) -> DataFrame:
    """E18."""
    return rows.select("manifest_id").distinct()


def counts_by_type(files: DataFrame) -> DataFrame:
    """E3, with the type's ordinal for its order."""
    return files.groupBy("file_type").agg(F.count("*").alias("n")).join(F.broadcast(file_type_dim(files.sparkSession).select("file_type", "ordinal")), "file_type")


def counts_by_status(rows: DataFrame, column: str = "status") -> DataFrame:
    """E4, E5."""
    return rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))


def total_size(files: DataFrame) -> DataFrame:
    """Nulls count as nothing."""
    return files.agg(F.coalesce(F.sum("original_size"), F.lit(0)).cast("bigint").alias("total_size"))


def total_files(archives: DataFrame) -> DataFrame:
    """E7."""
    return archives.agg(F.coalesce(F.sum(F.size("files")), F.lit(0)).cast("bigint").alias("n_files"))


def duplicate_groups(files: DataFrame, key: Column, statuses: list[str], types: list[str]) -> DataFrame:
    """E8 as (group_key, first_path, first_id, n): a group is never gathered; its members are found by the key."""
    rows = files.where(F.col("status").isin(statuses) & F.col("file_type").isin(types)).withColumn("group_key", key)
    return rows.groupBy("group_key").agg(F.min(F.struct("path", "id")).alias("f"), F.count("*").alias("n")).select("group_key", F.col("f.path").alias("first_path"), F.col("f.id").alias("first_id"), "n")


def case_collisions(paths: DataFrame) -> DataFrame:
    """Paths that differ from another in case only."""
    own = paths.select("path").distinct().withColumn("folded", F.lower("path"))
    many = own.groupBy("folded").agg(F.count("*").alias("n")).where("n > 1").select("folded")
    return own.join(many, "folded", "left_semi").select("path")


def max_version(manifests: DataFrame) -> DataFrame:
    """E10."""
    v = manifests.agg(F.max(P.app_version(F.col("app_version"))).alias("v"))
    return v.select(F.concat_ws(".", F.col("v.major").cast("string"), F.col("v.minor").cast("string"), F.col("v.patch").cast("string")).alias("max_version"))


def prefix_versions(manifests: DataFrame) -> DataFrame:
    """E11 as rows: (prefix, version); of repeated prefixes the latest manifest wins."""
    last = manifests.groupBy(F.col("manifest_id").alias("prefix")).agg(F.max_by("backup_versions", "start_time_utc_epoch_seconds").alias("versions"))
    return last.select("prefix", F.explode("versions").alias("version"))


def merged_keys(manifests: DataFrame) -> DataFrame:
    """E12 as rows: (version, key_index, key); later manifests override."""
    each = manifests.select("start_time_utc_epoch_seconds", F.explode("encryption_keys").alias("version", "own")).select("start_time_utc_epoch_seconds", F.col("version").cast("int").alias("version"), F.explode("own").alias("key_index", "key"))
    return each.groupBy("version", F.col("key_index").cast("int").alias("key_index")).agg(F.max_by("key", "start_time_utc_epoch_seconds").alias("key"))


def single_type(located: DataFrame) -> DataFrame:
    """(locator, n_types, file_type); more than one type at a locator is an error of the input."""
    return located.groupBy("locator").agg(F.count_distinct("file_type").alias("n_types"), F.min("file_type").alias("file_type"))


def progress(steps: DataFrame) -> DataFrame:
    """Steps (step, total, done, weight) to one row: weighted percentage, cut to 0..100."""
    percent = F.least(F.lit(100), F.greatest(F.lit(0), F.when(F.col("total") > 0, F.floor(F.col("done") * 100.0 / F.col("total") + 0.5)).otherwise(0)))
    return steps.select(percent.alias("p"), "weight").agg(F.floor(F.sum(F.col("p") * F.col("weight")) / F.sum("weight") + 0.5).cast("bigint").alias("percent"))


def size_violations(manifests: DataFrame, files: DataFrame, persisted: bool) -> DataFrame:
    """Manifests whose number of files breaks the rule: none before writing, at least one after."""
    n = files.groupBy("manifest_id").agg(F.count("*").alias("n_files"))
    rows = manifests.select("manifest_id").join(n, "manifest_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    return rows.where(F.col("n_files") == 0 if persisted else F.col("n_files") > 0)


# --- order -----------------------------------------------------------------------------------------------------------


def page(files: DataFrame, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """G1: a page in path order."""
    return files.orderBy(F.desc("path") if descending else F.asc("path")).offset(offset).limit(limit)


def examples(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The first n values and how many more there are."""
    more = max(0, rows.count() - n)
    return rows.select(column).orderBy(column).limit(n).withColumn("more", F.lit(more).cast("bigint"))
