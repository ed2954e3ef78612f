"""The latest state of a stream of file rows: an append-only sequence of increments, applied batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class LatestState:
    """Keeps the newest row of each path in Parquet below `folder`, dealt into `buckets` by path.

    A batch writes anew the buckets that it touches, and last of all a row for each of them to the table `pointers`; a
    bucket's current folder is that of its newest pointer. So a state outlives its process, a batch that broke off is
    as if it had not been, and a batch that was applied is skipped when it is run again. `vacuum` removes folders
    that no pointer needs.
    """

    POINTERS = "batch long, bucket int, target string"

    def __init__(self, spark: SparkSession, folder: str, order: str = "increment", buckets: int = 64):
        self.spark, self.folder, self.order, self.buckets = spark, folder.rstrip("/"), order, buckets

    def _pointers(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.POINTERS).parquet(f"{self.folder}/pointers")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.POINTERS)

    def _current(self) -> dict[int, str]:
        """The folder of each bucket: a row a bucket."""
        rows = self._pointers().groupBy("bucket").agg(F.max_by("target", "batch").alias("target"))
        return {r.bucket: r.target for r in rows.collect()}

    def read(self) -> DataFrame | None:
        found = sorted(self._current().values())
        return self.spark.read.parquet(*found) if found else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        last = self._pointers().agg(F.max("batch")).first()[0]
        if last is not None and batch_id <= last:
            return
        bucket = F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")
        batch = batch.withColumn("bucket", bucket)
        touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())
        held = self._current()
        before = [held[b] for b in touched if b in held]
        rows = batch.unionByName(self.spark.read.parquet(*before).withColumn("bucket", bucket)) if before else batch
        w = Window.partitionBy("bucket", "path").orderBy(F.desc(self.order), "id")
        latest = rows.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
        target = f"{self.folder}/v{batch_id:010d}-{uuid.uuid4().hex[:8]}"
        latest.write.partitionBy("bucket").parquet(target)
        done = [(batch_id, b, f"{target}/bucket={b}") for b in touched]
        self.spark.createDataFrame(done, self.POINTERS).coalesce(1).write.mode("append").parquet(f"{self.folder}/pointers")

    def vacuum(self) -> list[str]:
        """Remove the folders of buckets that a later batch has written anew; readers must be done with them."""
        held = set(self._current().values())
        gone = sorted(r.target for r in self._pointers().select("target").distinct().collect() if r.target not in held)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for target in gone:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(conf).delete(path, True)
        return gone

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
