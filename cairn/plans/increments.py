"""Algebra of increments: as-of loading, chains, merge, inspection and deletion.

Manifest headers are a small table (a row an increment); files and archive entries stay distributed and carry
manifest_id, so every selection is a semi join that prunes partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.content import iso_instant, mebibytes
from ..operators import sets as S
from ..operators.order import running_sum

START = "start_time_utc_epoch_seconds"


class ChainError(ValueError):
    """A chain of increments is broken or a wanted increment does not exist."""


def of_prefix(manifests: DataFrame, prefix: str) -> DataFrame:
    """Q5: ids of exactly this prefix: prefix-epoch or prefix-epoch-epoch."""
    return manifests.where(F.col("manifest_id").rlike(rf"^{prefix}-\d+(-\d+)?$"))


def as_of(manifests: DataFrame, at: int | None = None) -> DataFrame:
    """Increments with start <= at since the last FULL one; all if none is FULL.

    A merged increment starts when its last one did, and stands for it.
    """
    rows = manifests if at is None else manifests.where(F.col(START) <= at)
    first = rows.where("backup_type = 'FULL'").agg(F.max(START)).first()[0]
    return rows if first is None else rows.where((F.col(START) > first) | ((F.col(START) == first) & (F.col("backup_type") == "FULL")))


def checked_chain(manifests: DataFrame) -> DataFrame:
    """The chain, or an error that names its gaps."""
    gaps = S.version_gaps(manifests).first()
    if not gaps.n:
        raise ChainError("no manifest found")
    if gaps.missing or gaps.unexpected:
        raise ChainError(f"missing increments {gaps.missing}, unexpected {gaps.unexpected}")
    return manifests


def load_all(manifests: DataFrame) -> DataFrame:
    """All manifests in time order; none is an error."""
    if manifests.isEmpty():
        raise ChainError("no manifest found")
    return manifests.orderBy(START)


def latest_at(manifests: DataFrame, at: int | None = None) -> DataFrame:
    """The newest increment with start <= at."""
    rows = manifests if at is None else manifests.where(F.col(START) <= at)
    return rows.agg(F.max_by(F.struct(*manifests.columns), F.struct(START, "manifest_id")).alias("m")).where("m IS NOT NULL").select("m.*")


#: Increments that are looked up in a sorted array; more are joined.
HEADERS = 1 << 20


def latest_for_each(times: DataFrame, manifests: DataFrame, bound: int = HEADERS) -> DataFrame:
    """D12 for many times: (at, manifest_id) of the newest increment with start <= at, null before the first.

    Up to `bound` headers (counted first) are a sorted array in which each time is looked up where it lies. Beyond that
    both sides are cut into spans of time: within a span by a running last value, before its first header by the last
    one of the nearest earlier span that has any.
    """
    heads = manifests.groupBy(F.col(START).alias("at")).agg(F.max("manifest_id").alias("manifest_id"))
    if heads.count() <= bound:
        held = heads.orderBy("at").toArrow()
        sent = times.sparkSession.sparkContext.broadcast((held.column("at").to_numpy(), held.column("manifest_id").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, names = sent.value
            for b in batches:
                at = b.column(0)
                place = np.searchsorted(starts, at.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False), "right") - 1
                yield pa.RecordBatch.from_arrays([at, names.take(pa.array(place, mask=place < 0)).cast(pa.string())], ["at", "manifest_id"])

        return times.select(F.col("at").cast("bigint").alias("at")).mapInArrow(run, "at long, manifest_id string")
    span = F.floor(F.col("at") / (1 << 20))
    both = heads.select("at", "manifest_id", F.lit(0).alias("__k")).unionByName(times.select(F.col("at").cast("bigint").alias("at"), F.lit(None).cast("string").alias("manifest_id"), F.lit(1).alias("__k"))).withColumn("__span", span)
    within = Window.partitionBy("__span").orderBy("at", "__k").rowsBetween(Window.unboundedPreceding, 0)
    # a row a span: the last header of each, carried on to the spans after it
    ends = both.groupBy("__span").agg(F.max_by("manifest_id", F.when(F.col("__k") == 0, F.col("at"))).alias("own"))
    over = Window.partitionBy(F.lit(0)).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("__span", F.last("own", ignorenulls=True).over(over).alias("__before"))
    rows = both.withColumn("manifest_id", F.last("manifest_id", ignorenulls=True).over(within)).where("__k = 1")
    return rows.join(before, "__span", "left").select("at", F.coalesce("manifest_id", "__before").alias("manifest_id"))


def chains(manifests: DataFrame) -> DataFrame:
    """Manifests with the number of their chain, from the running count of FULL ones, in two levels."""
    full = manifests.withColumn("__full", F.when(F.col("backup_type") == "FULL", F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return running_sum(full, [], START, "__full", "__earlier").withColumn("chain", F.col("__earlier") + F.col("__full")).drop("__full", "__earlier")


def until_next_full(manifests: DataFrame, start: int) -> DataFrame:
    """The increment that starts exactly at `start` and those up to, without, the next FULL one."""
    if manifests.where(F.col(START) == start).isEmpty():
        raise ChainError(f"no increment starts at {start}")
    stop = manifests.where((F.col("backup_type") == "FULL") & (F.col(START) > start)).agg(F.min(START)).first()[0]
    rows = manifests.where(F.col(START) >= start)
    return rows if stop is None else rows.where(F.col(START) < stop)


def merge_selection(manifests: DataFrame, first: int, last: int) -> DataFrame:
    """The inclusive range, whose ends must exist, since its last FULL increment."""
    if last <= first:
        raise ValueError("the end of the range must be after its start")
    ends = manifests.where(F.col(START).isin(first, last)).select(START).distinct().count()
    if ends != 2:
        raise ChainError("both ends of the range must be starts of increments")
    return as_of(manifests.where(F.col(START).between(first, last)))


def merged(selection: DataFrame, files: DataFrame, archives: DataFrame) -> dict[str, DataFrame]:
    """The merged increment: files of the last manifest that are not deleted, the entries that they
    refer to, and its header, named prefix-first-last."""
    # a row
    last = F.broadcast(latest_at(selection).select("manifest_id"))
    kept = S.not_deleted(files.join(last, "manifest_id", "left_semi"))
    own = archives.join(last, "manifest_id", "left_semi")
    live = S.referenced_archives(own, kept)
    versions = selection.select(F.explode("backup_versions").alias("v")).agg(F.array_sort(F.collect_set("v")).alias("backup_versions"))
    head = selection.agg(F.min(START).alias("first"), F.max_by(F.struct("manifest_id", START, "app_version", "operating_system"), START).alias("m"), F.min_by("backup_type", START).alias("backup_type"))
    prefix = F.regexp_replace("m.manifest_id", r"-\d+(-\d+)?$", "")
    header = head.select(F.format_string("%s-%d-%d", prefix, F.col("first"), F.col(f"m.{START}")).alias("manifest_id"), "backup_type", F.col(f"m.{START}").alias(START), F.col("m.app_version").alias("app_version"))
    return {"header": header, "files": kept, "archives": live, "versions": versions}


def live_entries(selection: DataFrame, archives: DataFrame, last_archives: DataFrame) -> DataFrame:
    """By source increment, the entry paths that the merged increment still needs."""
    need = last_archives.select("archive_location").distinct()
    each = selection.select("manifest_id", F.explode("backup_versions").alias("v"))
    rows = archives.join(each, ["manifest_id"]).where("archive_location.backup_increment = v")
    return rows.join(need, "archive_location", "left_semi").select("manifest_id", P.format_locator(F.col("archive_location.backup_increment"), F.col("archive_location.entry_name")).alias("entry_path")).distinct()


def version_directories(versions: DataFrame) -> DataFrame:
    """One directory entity for each version."""
    return versions.select(F.explode("backup_versions").alias("v")).select(F.concat(F.lit("/"), F.col("v").cast("string")).alias("path")).distinct()


def summary(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """One row an increment: number of rows, whole MiB and start as text."""
    sums = files.groupBy("manifest_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("bytes"))
    return manifests.join(sums, "manifest_id", "left").select("manifest_id", "backup_type", F.col(START).alias("start"), iso_instant(F.col(START)).alias("started"), F.coalesce("n_files", F.lit(0)).alias("n_files"), mebibytes(F.coalesce("bytes", F.lit(0))).alias("mib"))


def summary_text(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(manifest_id, summary): the readable text, without colours; needs all header columns."""
    more = manifests.select("manifest_id", "backup_versions", "operating_system", "job_configuration")
    versions = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort("backup_versions"), lambda v: v.cast("string")), ", "), F.lit("]"))
    # the labels are fixed values of the text
    text = F.format_string(
        "%s backup: %s\n\tStarted at : %s (Epoch seconds: %d)\n\tContains %d files (%d MiB)\n\tVersions   : %s\n\tOS name    : %s\n\tEncrypted  : %s\n\tHash alg.  : %s\n\tCompression: %s",
        "backup_type", "manifest_id", "started", "start", "n_files", "mib", versions, F.coalesce("operating_system", F.lit("unknown")),
        F.col("job_configuration.encryption_key").isNotNull().cast("string"), F.col("job_configuration.hash_algorithm"), F.col("job_configuration.compression"),
    )
    return summary(manifests, files).join(more, "manifest_id").select("manifest_id", text.alias("summary"))


def contents(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """The rows of the tab-separated export; `export_contents` orders and writes them."""
    return files.select("permissions", "owner", "group", F.col("original_size").alias("size"), iso_instant(F.col("last_modified_utc_epoch_seconds")).alias("last_modified"), F.coalesce("original_hash", F.lit("-")).alias(f"hash_{algorithm}"), "path")


def export_contents(files: DataFrame, target: str, algorithm: str = "sha256") -> None:
    """Tab-separated files ordered by path; the ranges of the files follow each other."""
    contents(files, algorithm).orderBy("path").write.option("sep", "\t").option("header", True).mode("overwrite").csv(target)


def delete_plan(listing: DataFrame, manifests: DataFrame) -> DataFrame:
    """Listing (name) to the files of the given increments, each with why it goes."""
    own = manifests.select("manifest_id")
    kind = (
        F.when(F.col("name").rlike(r"\.[0-9]{5}\.cargo$"), "chunk")
        .when(F.col("name").endswith(".index.cargo"), "index")
        .when(F.col("name").endswith(".manifest.cargo"), "manifest")
        .when(F.col("name").endswith(".manifest.json.gz"), "history")
    )
    rows = listing.select("name", kind.alias("kind"), F.regexp_replace("name", r"\.([0-9]{5}\.cargo|index\.cargo|manifest\.cargo|manifest\.json\.gz)$", "").alias("manifest_id"))
    return rows.where(F.col("kind").isNotNull()).join(own, "manifest_id", "left_semi").select("name", "kind", "manifest_id")


def next_header(spark: SparkSession, previous: DataFrame | None, prefix: str, now: int, app_version: str, same_configuration: bool, force_full: bool = False) -> DataFrame:
    """Header of the next increment: FULL without a chain, with a changed configuration, or on demand."""
    n = 0 if previous is None else previous.count()
    full = force_full or not n or not same_configuration
    row = (f"{prefix}-{now}", app_version, now, "FULL" if full else "INCREMENTAL", [0 if full else n])
    return spark.createDataFrame([row], f"manifest_id string, app_version string, {START} bigint, backup_type string, backup_versions array<int>")


def chosen(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Rows of the given manifests."""
    return files.join(manifests.select("manifest_id"), "manifest_id", "left_semi")


def is_last(rows: DataFrame, order: str) -> Column:
    """Whether a row is of the newest increment."""
    return F.col(order) == F.lit(rows.agg(F.max(order)).first()[0])
