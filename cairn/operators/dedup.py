"""Duplicate groups at store time, links to earlier content and storage totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import derived_id, duplicate_key, is_content


#: Files of a row of archive entries; an entry that more files share is several rows, equal but for `files`.
MEMBERS = 1 << 16


def store_groups(files: DataFrame, strategy: str, algorithm: str, increment: int) -> tuple[DataFrame, DataFrame]:
    """(entries, files): one archive entry for each group of duplicates, and files with the entry's id.

    The group's copy is the member with the lowest path. A group is counted first; one of over MEMBERS files is dealt into
    rows of about so many, so that no row and no task holds a whole hot group.
    """
    keyed = files.withColumn("group_key", F.when(is_content(F.col("file_type")), duplicate_key(strategy, algorithm)))
    rows = keyed.where(F.col("group_key").isNotNull())
    groups = rows.groupBy("group_key").agg(F.min(F.struct("path", "id", "original_hash", "manifest_id")).alias("f"), F.count("*").alias("n"))
    hot = groups.where(F.col("n") > MEMBERS).select("group_key", F.ceil(F.col("n") / MEMBERS).alias("__rows"))
    dealt = rows.select("group_key", "id").join(hot, "group_key", "left").withColumn("__row", F.coalesce(F.pmod(F.xxhash64("id"), F.col("__rows")), F.lit(0)))
    members = dealt.groupBy("group_key", "__row").agg(F.array_sort(F.collect_list("id")).alias("files"))
    named = groups.select("group_key", "f", derived_id(F.lit("entry"), F.col("f.id")).alias("id"))
    entry = members.join(named, "group_key").select(F.col("f.manifest_id").alias("manifest_id"), "id", F.struct(F.lit(increment).alias("backup_increment"), derived_id(F.lit("name"), F.col("f.id")).alias("entry_name")).alias("archive_location"), F.col("f.original_hash").alias("archived_hash"), F.col("f.original_hash").alias("original_hash"), "files")
    linked = keyed.join(named.select("group_key", F.col("id").alias("__entry")), "group_key", "left").withColumn("archive_metadata_id", F.coalesce("__entry", "archive_metadata_id")).drop("__entry", "group_key")
    return entry, linked


def stored_copies(files: DataFrame, strategy: str, algorithm: str) -> DataFrame:
    """(id, path, stored_id): the member whose content each file shares."""
    keyed = files.where(is_content(F.col("file_type"))).withColumn("group_key", duplicate_key(strategy, algorithm))
    first = keyed.groupBy("group_key").agg(F.min_by("id", F.struct("path", "id")).alias("stored_id"))
    return keyed.join(first, "group_key").select("id", "path", "stored_id")


def saved_bytes(files: DataFrame, strategy: str, algorithm: str) -> DataFrame:
    """Bytes of all content, of the stored copies, and the difference."""
    copies = files.where(is_content(F.col("file_type"))).groupBy(duplicate_key(strategy, algorithm).alias("k")).agg(F.sum("original_size").alias("s"), F.min_by("original_size", F.struct("path", "id")).alias("one"))
    return copies.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_bytes"), F.coalesce(F.sum("one"), F.lit(0)).alias("stored_bytes")).withColumn("saved_bytes", F.col("all_bytes") - F.col("stored_bytes"))


def mark_drift(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files with an error where the hash at store time (id, stored_hash) differs."""
    said = F.lit("The hash changed between delta calculation and archival.")
    rows = files.join(stored.select("id", "stored_hash", F.lit(True).alias("__stored")), "id", "left")
    return rows.withColumn("error", F.when(F.col("__stored") & ~F.col("stored_hash").eqNullSafe(F.col("original_hash")), said).otherwise(F.col("error"))).drop("stored_hash", "__stored")


def link_previous(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """(file_id, id, archive_location, hashes) entries copied for rows whose previous content is reused.

    changes: result of `detect.delta` with link_previous_content; the newest manifest whose entry has the previous
    row's entry id gives the copy, under a new id.
    """
    wanted = changes.where("link_previous_content").where(is_content(F.col("prev_file_type"))).select(F.col("cur_id").alias("file_id"), F.col("prev_archive_metadata_id").alias("entry_id"))
    newest = entries.groupBy(F.col("id").alias("entry_id")).agg(F.max_by(F.struct("archive_location", "archived_hash", "original_hash"), F.col("archive_location.backup_increment")).alias("e"))
    return wanted.join(newest, "entry_id").select("file_id", derived_id(F.lit("copy"), F.col("file_id"), F.col("entry_id")).alias("id"), "e.*")
