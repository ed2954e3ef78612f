"""Change detection: content and metadata comparison, ranked previous versions, classification.

Detectors are strategy objects that give columns; all comparisons are null-safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.content import is_content, permissions_match

MTIME = "last_modified_utc_epoch_seconds"


def _differs(a: str, b: str, column: str) -> Column:
    return ~F.col(f"{a}{column}").eqNullSafe(F.col(f"{b}{column}"))


@dataclass(frozen=True)
class Detector:
    """How rows are compared. hashing: by content hash; else by size, time and name."""

    hashing: bool = True
    permissions: str = "STRICT"

    @property
    def key(self) -> str:
        """The column that candidates for renames share."""
        return "original_hash" if self.hashing else "original_size"

    @property
    def same(self) -> list[str]:
        """Columns that are equal if the content is unchanged, besides the file name."""
        return ["file_type", "original_size"] + (["original_hash"] if self.hashing else [MTIME])

    def content_changed(self, a: str, b: str) -> Column:
        """At least one side carries content, and they differ."""
        differ = F.lit(False)
        for c in self.same:
            differ = differ | _differs(a, b, c)
        if not self.hashing:
            differ = differ | ~F.substring_index(f"{a}path", "/", -1).eqNullSafe(F.substring_index(f"{b}path", "/", -1))
        return (is_content(F.col(f"{a}file_type")) | is_content(F.col(f"{b}file_type"))) & differ

    def metadata_changed(self, prev: str, cur: str) -> Column:
        """Hidden flag, permissions by the rule, and time unless the current row is a link."""
        link = F.col(f"{cur}file_type") == "SYMBOLIC_LINK"
        return _differs(prev, cur, "hidden") | ~permissions_match(self.permissions, prev, cur) | (~link & _differs(prev, cur, MTIME))


def detector(hash_algorithm: str, permissions: str = "STRICT") -> Detector:
    """I7."""
    return Detector(hash_algorithm != "NONE", permissions)


def classify(rows: DataFrame, by: Detector, prev: str = "prev_", cur: str = "cur_", last: str = "prev_is_last") -> Column:
    """I1; a row without a previous version is NEW."""
    return (
        F.when(F.col(f"{cur}file_type") == "MISSING", "DELETED")
        .when(F.col(f"{prev}id").isNull() | (F.col(f"{prev}file_type") == "MISSING"), "NEW")
        .when(by.content_changed(prev, cur), "CONTENT_CHANGED")
        .when(~F.col(last), "ROLLED_BACK")
        .when(by.metadata_changed(prev, cur), "METADATA_CHANGED")
        .otherwise("NO_CHANGE")
    )


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select([F.col(c).alias(prefix + c) for c in rows.columns])


def latest_by_path(history: DataFrame, order: str = "increment") -> DataFrame:
    """The newest row of each path that is not DELETED."""
    rows = history.where(~F.col("status").eqNullSafe("DELETED"))
    w = Window.partitionBy("path").orderBy(F.desc(order), "id")
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def previous_versions(current: DataFrame, history: DataFrame, by: Detector, order: str = "increment") -> DataFrame:
    """Each current row with its most relevant previous version under `prev_`, and prev_is_last.

    1. The newest version of the same path, if its content is unchanged. 2. From the newest increment back, a row
    with equal key and unchanged content: that of the same path, else the lowest path. 3. The newest version of the
    same path, or nothing. Directories take 1 and 3 only.

    Candidates of step 2 are reduced before the join to one for each group of equal content: the lowest path of the newest
    increment that has it, since no older one can win; exact paths have a join of their own. So a frequent key meets one row.
    """
    cur, old = prefixed(current, "cur_"), history
    latest = prefixed(latest_by_path(old, order), "prev_")
    same_path = cur.join(latest, F.col("cur_path") == F.col("prev_path"))
    unchanged = ~by.content_changed("prev_", "cur_")
    stage1 = same_path.withColumn("__stage", F.when(unchanged, 1).otherwise(3))
    name = F.substring_index("path", "/", -1)
    group = [F.col(c) for c in by.same] + ([] if by.hashing else [name.alias("__name")])
    lowest = old.where(F.col("file_type").isin("REGULAR_FILE", "SYMBOLIC_LINK")).groupBy(*group).agg(F.min_by(F.struct(*old.columns), F.struct((-F.col(order)).alias("o"), "path", "id")).alias("r")).select("r.*")
    content = cur.where(is_content(F.col("cur_file_type")) & F.col(f"cur_{by.key}").isNotNull())
    # a null primary key has no candidate; all else is null-safe
    keys = [F.col(f"cur_{by.key}") == F.col(f"prev_{by.key}"), *[F.col(f"cur_{c}").eqNullSafe(F.col(f"prev_{c}")) for c in by.same if c != by.key]]
    if not by.hashing:
        keys.append(F.substring_index("cur_path", "/", -1).eqNullSafe(F.substring_index("prev_path", "/", -1)))
    moved = content.join(prefixed(lowest, "prev_"), keys).where(unchanged).withColumn("__stage", F.lit(2))
    exact = content.join(prefixed(old, "prev_"), [*keys, F.col("cur_path") == F.col("prev_path")]).where(unchanged).withColumn("__stage", F.lit(2))
    every = stage1.unionByName(moved).unionByName(exact)
    rank = Window.partitionBy("cur_id").orderBy("__stage", F.desc(f"prev_{order}"), F.desc(F.col("prev_path") == F.col("cur_path")), "prev_path", "prev_id")
    best = every.withColumn("__nth", F.row_number().over(rank)).where("__nth = 1")
    chosen = best.select("cur_id", *[c for c in best.columns if c.startswith("prev_")])
    last = history.agg(F.max(order)).first()[0]
    return cur.join(chosen, "cur_id", "left").withColumn("prev_is_last", F.col(f"prev_{order}").eqNullSafe(F.lit(last)))


def delta(current: DataFrame, history: DataFrame, by: Detector, order: str = "increment") -> DataFrame:
    """previous_versions with the change of each row."""
    rows = previous_versions(current, history, by, order)
    return rows.withColumn("change", classify(rows, by))


def compare_with_disk(backup: DataFrame, disk: DataFrame, by: Detector, last_increment: Column) -> DataFrame:
    """(path, change) of restoring `backup` over `disk`: a path that the disk lacks is DELETED from it."""
    rows = prefixed(backup, "prev_").join(prefixed(disk, "cur_"), F.col("prev_path") == F.col("cur_path"), "left")
    rows = rows.withColumn("cur_file_type", F.coalesce("cur_file_type", F.lit("MISSING"))).withColumn("prev_is_last", last_increment)
    return rows.select(F.col("prev_path").alias("path"), classify(rows, by).alias("change"))
