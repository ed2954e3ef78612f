"""The backup plan: delta against earlier increments, reuse of earlier content, one stored copy a duplicate group."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.content import COMPRESSIONS, DUPLICATES, HASHES, PERMISSION_RULES, is_content
from ..operators import dedup, detect
from ..schemas import change_dim


@dataclass(frozen=True)
class Source:
    """One root with its globs; patterns need a directory."""

    path: str
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class BackupConfiguration:
    """Validated arguments of a backup; equality leaves out type, chunk size and sources, so a change of these keeps the chain."""

    file_name_prefix: str
    destination_directory: str
    hash_algorithm: str = "SHA256"
    compression: str = "NONE"
    duplicate_strategy: str = "KEEP_ONE_PER_BACKUP"
    encryption_key: str | None = None
    backup_type: str = field(default="INCREMENTAL", compare=False)
    chunk_size_mebibyte: int = field(default=100 * 1024, compare=False)
    sources: tuple[Source, ...] = field(default=(), compare=False)

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-zA-Z0-9_-]+", self.file_name_prefix):
            raise ValueError("the prefix has letters, digits, underscores and hyphens only")
        for value, known in ((self.hash_algorithm, HASHES), (self.compression, COMPRESSIONS), (self.duplicate_strategy, DUPLICATES), (self.backup_type, ("FULL", "INCREMENTAL"))):
            if value not in known:
                raise ValueError(f"{value} is none of {known}")
        if self.chunk_size_mebibyte <= 0:
            raise ValueError("the chunk size must be positive")


#: Columns that no comparison of versions reads.
_NOT_COMPARED = ("manifest_id", "file_system_key", "last_accessed_utc_epoch_seconds", "created_utc_epoch_seconds", "error")


def plan(scan: DataFrame, history: DataFrame | None, entries: DataFrame | None, configuration: BackupConfiguration, increment: int, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, _: rows) -> dict[str, DataFrame]:
    """files and archive entries of the next increment, and the changes by row.

    scan: current rows; history: rows of all earlier increments with `increment`; entries: their archive entries. keep: writes
    what both results are made of (rows, name) and reads it back, else each compares all versions again.
    """
    if history is None or entries is None:
        stored, files = dedup.store_groups(scan.withColumn("status", F.lit("NEW")), configuration.duplicate_strategy, configuration.hash_algorithm, increment)
        return {"files": files, "archives": stored, "changes": files.select(F.col("id").alias("cur_id"), F.lit("NEW").alias("change"))}
    by = detect.detector(configuration.hash_algorithm)
    # six rows
    changes = detect.delta(scan.drop(*_NOT_COMPARED), history.drop(*_NOT_COMPARED), by).join(F.broadcast(change_dim(scan.sparkSession).select("change", "store_content", "link_previous_content")), "change")
    changes = keep(changes.select("cur_id", "change", "store_content", "link_previous_content", "prev_file_type", "prev_archive_metadata_id"), "changes")
    linked = keep(dedup.link_previous(changes, entries), "linked")
    status = changes.select(F.col("cur_id").alias("id"), F.col("change").alias("__change"))
    reused = linked.select(F.col("file_id").alias("id"), F.col("id").alias("__entry"))
    rows = keep(scan.join(status, "id").join(reused, "id", "left").withColumn("status", F.col("__change")).withColumn("archive_metadata_id", F.coalesce("__entry", "archive_metadata_id")), "compared")
    fresh = rows.where(is_content(F.col("file_type")) & F.col("__entry").isNull()).drop("__change", "__entry")
    rest = rows.where(~is_content(F.col("file_type")) | F.col("__entry").isNotNull()).drop("__change", "__entry")
    stored, stored_files = dedup.store_groups(fresh, configuration.duplicate_strategy, configuration.hash_algorithm, increment)
    manifest = scan.select("manifest_id").limit(1)
    copied = linked.groupBy("id").agg(F.first("archive_location").alias("archive_location"), F.first("archived_hash").alias("archived_hash"), F.first("original_hash").alias("original_hash"), F.array_sort(F.collect_list("file_id")).alias("files"))
    name = manifest.first()
    copied = copied.withColumn("manifest_id", F.lit(name[0] if name else None).cast("string"))
    return {"files": stored_files.unionByName(rest), "archives": stored.unionByName(copied.select(*stored.columns)), "changes": changes}


@dataclass(frozen=True)
class Scope:
    """What a task reads: a folder, a prefix, and the times that it names; checked when it is made."""

    folder: str
    prefix: str
    at: int | None = None
    first: int | None = None
    last: int | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-zA-Z0-9_-]+", self.prefix):
            raise ValueError("the prefix has letters, digits, underscores and hyphens only")
        for value in (self.at, self.first, self.last):
            if value is not None and not 0 < value <= time.time():
                raise ValueError(f"{value} is not a past or present time")
        if self.first is not None and self.last is not None and self.last <= self.first:
            raise ValueError("the end of the range must be after its start")


def permission_rule(name: str) -> str:
    if name not in PERMISSION_RULES:
        raise ValueError(f"{name} is none of {PERMISSION_RULES}")
    return name
