"""Schemas of the versioned metadata tables and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TIMES = {f"{x}_utc_epoch_seconds": _L for x in ("last_modified", "last_accessed", "created")}
FILES = _struct(manifest_id=_S, id=_S, file_system_key=_S, path=_S, original_hash=_S, original_size=_L, **_TIMES, permissions=_S, owner=_S, group=_S, file_type=_S, hidden=_B, status=_S, archive_metadata_id=_S, error=_S)
LOCATOR = _struct(backup_increment=_I, entry_name=_S)
ARCHIVE_ENTRIES = _struct(manifest_id=_S, id=_S, archive_location=LOCATOR, archived_hash=_S, original_hash=_S, files=T.ArrayType(_S))
SOURCE = _struct(path=_S, include_patterns=T.ArrayType(_S), exclude_patterns=T.ArrayType(_S))
JOB = _struct(backup_type=_S, hash_algorithm=_S, compression=_S, encryption_key=_S, duplicate_strategy=_S, chunk_size_mebibyte=_I, file_name_prefix=_S, destination_directory=_S, sources=T.ArrayType(SOURCE))
MANIFESTS = _struct(
    manifest_id=_S, app_version=_S, start_time_utc_epoch_seconds=_L, backup_type=_S, backup_versions=T.ArrayType(_I), operating_system=_S, job_configuration=JOB,
    encryption_keys=T.MapType(_S, T.MapType(_S, _S)), index_file_name=_S, data_file_names=T.ArrayType(_S),
)
BOUNDARY = _struct(rel_start=_L, start_file=_S, rel_end=_L, end_file=_S, abs_start=_L, abs_end=_L, orig_size=_L, orig_hash=_S, arch_size=_L, arch_hash=_S)
CARGO_INDEX = _struct(prefix=_S, ord=_L, path=_S, type=_S, encrypted=_B, content=BOUNDARY, metadata=BOUNDARY)

# A change's name, whether its content is stored, whether earlier content is linked, whether a restore
# sets metadata, whether it writes content, and the message of a restore that left it so. In order of severity.
CHANGES = (
    ("NEW", True, False, False, False, "File not found in backup."),
    ("NO_CHANGE", False, True, False, False, "Restored."),
    ("METADATA_CHANGED", False, True, True, False, "Failed to restore file metadata."),
    ("CONTENT_CHANGED", True, False, True, True, "Failed to restore file content."),
    ("ROLLED_BACK", False, True, True, True, "Failed to restore file content."),
    ("DELETED", False, False, True, True, "Missing, could not be restored."),
)
# File types in order, and whether they carry content.
FILE_TYPES = (("DIRECTORY", False), ("REGULAR_FILE", True), ("SYMBOLIC_LINK", True), ("OTHER", False), ("MISSING", False))
CONTENT_TYPES = tuple(n for n, content in FILE_TYPES if content)


def change_dim(spark: SparkSession) -> DataFrame:
    """Six rows: change, its flags, message and ordinal."""
    rows = [(*c, i) for i, c in enumerate(CHANGES)]
    return spark.createDataFrame(rows, "change string, store_content boolean, link_previous_content boolean, restore_metadata boolean, restore_content boolean, restore_status_message string, ordinal int")


def file_type_dim(spark: SparkSession) -> DataFrame:
    """Five rows: file_type, is_content and ordinal."""
    return spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(FILE_TYPES)], "file_type string, is_content boolean, ordinal int")


def changes_with(flag: str) -> list[str]:
    """Names of the changes whose flag is set."""
    at = ("change", "store_content", "link_previous_content", "restore_metadata", "restore_content").index(flag)
    return [c[0] for c in CHANGES if c[at]]
