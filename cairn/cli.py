"""Command line.

    python -m cairn.cli backup --config job.json [--force-full-backup] [--threads N]
    python -m cairn.cli restore --backup-source DIR --prefix P [--target-mapping from=to ...] [--at-epoch-seconds T] [--include-path X]
        [--delete-missing] [--dry-run] [--permission-comparison RULE] [--key-store S --key-alias A]
    python -m cairn.cli merge --backup-source DIR --prefix P --from-epoch-seconds A --to-epoch-seconds B [--delete-obsolete]
    python -m cairn.cli delete --backup-source DIR --prefix P --from-epoch-seconds A
    python -m cairn.cli inspect-increments | inspect-content ...
    python -m cairn.cli gen-keys --key-store S [--key-alias A]

The password of a key store is read from CAIRN_STORE_PASSWORD, or asked for.
"""

from __future__ import annotations

import argparse
import getpass
import os

from pyspark.sql import DataFrame, SparkSession

from .functions.content import PERMISSION_RULES
from .jobs import backup, configuration, delete, known_tables, merge, restore
from .plans import backup as B
from .plans import increments as I
from .sources import keys

__all__ = ["configuration", "known_tables", "main", "parser", "run_backup"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    tasks = p.add_subparsers(dest="task", required=True)
    t = tasks.add_parser("backup")
    t.add_argument("--config", required=True)
    t.add_argument("--force-full-backup", action="store_true")
    t.add_argument("--threads", type=int, default=None, help="cores of a local session")
    for name in ("restore", "merge", "inspect-increments", "inspect-content", "delete"):
        t = tasks.add_parser(name)
        t.add_argument("--backup-source", required=True)
        t.add_argument("--prefix", required=True)
        t.add_argument("--key-store")
        t.add_argument("--key-alias", default="default")
        if name in ("restore", "inspect-content"):
            t.add_argument("--at-epoch-seconds", type=int)
        if name == "restore":
            t.add_argument("--target-mapping", action="append", default=[])
            t.add_argument("--include-path")
            t.add_argument("--delete-missing", action="store_true")
            t.add_argument("--dry-run", action="store_true")
            t.add_argument("--permission-comparison", choices=PERMISSION_RULES, default="STRICT")
            t.add_argument("--threads", type=int, default=None, help="cores of a local session")
        if name in ("merge", "delete"):
            t.add_argument("--from-epoch-seconds", type=int, required=True)
        if name == "merge":
            t.add_argument("--to-epoch-seconds", type=int, required=True)
            t.add_argument("--delete-obsolete", action="store_true")
        if name == "inspect-content":
            t.add_argument("--output-file", default="backup_contents.csv")
    t = tasks.add_parser("gen-keys")
    t.add_argument("--key-store", required=True)
    t.add_argument("--key-alias", default="default")
    return p


def run_backup(spark: SparkSession, conf: B.BackupConfiguration, force_full: bool = False, now: int | None = None) -> DataFrame:
    """(status, count) of the increment that this writes."""
    return backup(spark, conf, force_full, now)


def _password() -> str:
    return os.environ.get("CAIRN_STORE_PASSWORD") or getpass.getpass("password of the key store: ")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    a = parser().parse_args(args)
    if spark is None:
        made = SparkSession.builder
        spark = (made.master(f"local[{a.threads}]") if getattr(a, "threads", None) else made).getOrCreate()
    if a.task == "gen-keys":
        return spark.createDataFrame([(a.key_alias, keys.write_store(spark, a.key_store, a.key_alias, _password()))], "alias string, public_key string")
    if a.task == "backup":
        return run_backup(spark, configuration(a.config), a.force_full_backup)
    scope = B.Scope(a.backup_source, a.prefix, getattr(a, "at_epoch_seconds", None), getattr(a, "from_epoch_seconds", None), getattr(a, "to_epoch_seconds", None))
    if a.task == "merge":
        return merge(spark, scope, a.delete_obsolete)
    if a.task == "delete":
        return delete(spark, scope)
    if a.task == "restore":
        private = keys.read_private_key(spark, a.key_store, a.key_alias, _password()) if a.key_store else None
        targets = [tuple(x.split("=", 1)) for x in a.target_mapping]
        return restore(spark, scope, targets, a.include_path, a.delete_missing, a.dry_run, a.permission_comparison, private)
    held = known_tables(spark, a.backup_source, a.prefix)
    if held is None:
        raise I.ChainError("no manifest found")
    heads, files = held["manifests"], held["files"]
    if a.task == "inspect-increments":
        return I.summary(I.load_all(heads), I.chosen(files, heads)).orderBy("start")
    rows = I.chosen(files, I.latest_at(heads, a.at_epoch_seconds))
    I.export_contents(rows, a.output_file)
    return I.contents(rows)


if __name__ == "__main__":
    main().show(1000, truncate=False)
