"""Helpers shared by the corpus operators: table access, shared scratch tables, component labels."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch, trim

_KEPT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, always through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch between Spark and Python where rows hold whole texts: some MB, of which a task holds several.
TEXTS = 1000


def keep(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    batch: rows that go to Python at a time while this is written, at most; the session's setting is put back.

    Results are read from such tables after an operator has returned, so they stay until `sweep`, or until this process ends
    where the folder is mounted.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/cairn-{tag}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    before = spark.conf.get(_ROWS)
    if batch is not None and int(before) > batch:
        spark.conf.set(_ROWS, str(batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_ROWS, before)
    trim(spark)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Remove all tables that this process has kept; results that read them must be done."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), len(_KEPT)
    while _KEPT:
        path = jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


@atexit.register
def _sweep_mounted() -> None:
    for path in _KEPT:
        if path.startswith(("/", "file:")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet."""
    name = base
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def by_merge(df: DataFrame) -> DataFrame:
    """df, never to be broadcast in a join: tables that grow with the input, whose files are small, are gathered on the driver else."""
    return df.hint("merge")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    links: two columns (a, b) of one ordered type, a <> b. Returns (node, root) with root the smallest node of
    the component, for every node that occurs in a link. Each round is two map-side combined aggregations and
    two joins; the links are written to the shared folder between rounds and never gathered in one place.
    """
    a, b = links.columns[:2]
    now = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct()
    now = keep(now, "links")
    before = None
    for _ in range(max_rounds):
        both = now.select("v", F.col("m").alias("n")).unionAll(now.select(F.col("m").alias("v"), F.col("v").alias("n")))
        least = both.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
        large = both.join(by_merge(least), "v").where("n > v").select(F.col("n").alias("v"), "m").distinct()
        floor = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(by_merge(floor), "v").select(F.explode(F.array(F.struct("v", F.col("low").alias("m")), F.struct(F.col("m").alias("v"), F.col("low").alias("m")))).alias("x")).select("x.v", "x.m").where("v <> m").distinct()
        now = keep(small, "links")
        # stable once a round leaves the set of links as it was: compare order-free digests
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("m").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("v").alias("node"), F.col("m").alias("root")).unionAll(roots.join(by_merge(now.select(F.col("v").alias("node"))), "node", "left_anti"))
