"""Archives as files: chunks, index files and documents in a mounted folder that all machines share.

Executors read and write the files that they are dealt; the driver only puts finished parts of one file end to end.
"""

from __future__ import annotations

import glob
import gzip
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IntegrityError
from ..functions import paths as P
from ..plans import archive as A

#: Bytes that a row holds at most: Spark's own limit for one value.
MOST = (1 << 31) - 1 - (1 << 16)
#: Bytes of content that one Arrow batch holds, about.
BATCH = 64 << 20
COPY = 16 << 20


def _sliced(rows: pa.RecordBatch, made: Iterator[bytes], name: str) -> Iterator[pa.RecordBatch]:
    """rows with a binary column, in batches of some BATCH bytes."""
    begin, size, held = 0, 0, []
    for i, data in enumerate(made):
        held.append(data)
        size += len(data)
        if size > BATCH or i == rows.num_rows - 1:
            part = rows.slice(begin, len(held))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], [*part.schema.names, name])
            begin, size, held = i + 1, 0, []


def with_bytes(rows: DataFrame, path: str, kind: str, out: str = "content") -> DataFrame:
    """Rows with the bytes of the file at `path`, or of a link's target; other types have none."""
    at, of = rows.columns.index(path), rows.columns.index(kind)

    def one(name: str, what: str) -> bytes:
        if what == "SYMBOLIC_LINK":
            return os.readlink(name).encode()
        if what != "REGULAR_FILE":
            return b""
        if os.path.getsize(name) > MOST:
            raise ValueError(f"{name} is larger than a row can hold")
        with open(name, "rb") as f:
            return f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _sliced(b, (one(p.as_py(), k.as_py()) for p, k in zip(b.column(at), b.column(of), strict=True)), out)

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField(out, T.BinaryType())]))


def numbered(rows: DataFrame, order: Column, first: int) -> DataFrame:
    """rows with `ord`: first, first + 1, ... by an order of any type; rows must be written before.

    Ranges of the order are partitions; a row's number is its place in the partition plus the sizes of those before it.
    """
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    sizes = {r.k: r.n for r in placed.groupBy(F.shiftright("__at", 33).alias("k")).agg(F.count("*").alias("n")).collect()}
    base, total = [], first
    for k in sorted(sizes):
        base += [F.lit(k), F.lit(total)]
        total += sizes[k]
    if not base:
        return placed.withColumn("ord", F.lit(first).cast("bigint")).drop("__at")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("ord", (F.create_map(*base)[F.shiftright("__at", 33)] + within).cast("bigint")).drop("__at")


def write_chunks(parts: DataFrame, folder: str) -> None:
    """The chunk files of `archive.parts`: one machine writes a chunk's parts in order."""

    def run(rows) -> None:
        name, out = None, None
        try:
            for r in rows:
                if r.name != name:
                    if out:
                        out.close()
                    name, out = r.name, open(f"{folder}/{r.name}", "wb")  # noqa: SIM115
                out.write(r.data)
        finally:
            if out:
                out.close()

    os.makedirs(folder, exist_ok=True)
    dealt = parts.select("name", "number", "part", "data").repartitionByRange("number").sortWithinPartitions("number", "part")
    dealt.foreachPartition(run)


def put_together(rows: DataFrame, column: str, target: str, staging: str, before: str = "", after: str = "") -> None:
    """One gzip file of ordered lines: Spark writes them as compressed parts, whose bytes follow each other in the file."""
    rows.select(column).write.option("compression", "gzip").text(staging)
    # gzip data may consist of several members
    with open(target + ".part", "wb") as out:
        out.write(gzip.compress(before.encode(), mtime=0))
        for part in sorted(glob.glob(f"{staging}/part-*.gz")):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out, COPY)
        out.write(gzip.compress(after.encode(), mtime=0))
    os.replace(target + ".part", target)
    shutil.rmtree(staging)


def index_rows(placed: DataFrame, version_directories: DataFrame) -> DataFrame:
    """Rows of the index (schemas.CARGO_INDEX): directories first, then placed entries (with type, encrypted)."""
    content = F.struct(*[F.col(k).alias(k) for k in A.BOUNDARY_KEYS])
    files = placed.select("prefix", "ord", "path", "type", "encrypted", content.alias("content"))
    none = F.lit(None).cast(files.schema["content"].dataType)
    folders = version_directories.select("prefix", "ord", "path", F.lit("DIRECTORY").alias("type"), F.lit(False).alias("encrypted"), none.alias("content"))
    return folders.unionByName(files).withColumn("metadata", none)


def write_index(index: DataFrame, prefix: str, max_chunk: int, folder: str, staging: str) -> None:
    """The index file: the entities' lines in order, then the footer."""
    last = index.agg(F.max("content.abs_end").alias("total"), F.max("ord").alias("n")).first()
    total, n = last.total or 0, last.n or 0
    chunks = max(1, -(-total // max_chunk))
    footer = [f"last.chunk.index:{chunks}", f"last.chunk.size:{total - (chunks - 1) * max_chunk}", f"max.chunk.size:{max_chunk}", f"last.entity.index:{n}", f"total.size:{total}", "version:2"]
    lines = A.index_lines(index).orderBy("ord", "n")
    put_together(lines, "line", f"{folder}/{prefix}.index.cargo", staging, after="\n".join(footer) + "\n")


def read_index(spark, folder: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Index rows and the footer of a plain index file; the file's name tells Spark nothing of its compression."""
    raw = spark.read.format("binaryFile").load(f"{folder}/{prefix}.index.cargo")
    text = A.decompress(F.col("content"), "GZIP").cast("string")
    lines = raw.select(F.lit(prefix).alias("prefix"), F.explode(F.split(text, "\n")).alias("line")).where("line <> ''")
    return A.parse_index(lines), A.footer(lines)


def read_raw(index: DataFrame, folder: str, max_chunk: Column | int) -> DataFrame:
    """Index rows (prefix, abs_start, abs_end, ...) with their stored bytes, read from the chunks where they lie."""
    rows = index.withColumn("__max", max_chunk if isinstance(max_chunk, Column) else F.lit(max_chunk).cast("bigint"))
    at = {c: rows.columns.index(c) for c in ("prefix", "abs_start", "abs_end", "__max")}

    def one(prefix: str, start: int, end: int, most: int) -> bytes:
        out = []
        while start < end:
            number = start // most + 1
            name = f"{folder}/{prefix}.{number:05d}.cargo"
            want = min(end, number * most) - start
            with open(name, "rb") as f:
                f.seek(start - (number - 1) * most)
                data = f.read(want)
            if len(data) != want:
                raise IntegrityError(f"{name} ends early")
            out.append(data)
            start += want
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            args = zip(*(b.column(at[c]).to_pylist() for c in ("prefix", "abs_start", "abs_end", "__max")), strict=True)
            yield from _sliced(b, (one(*x) for x in args), "raw")

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("raw", T.BinaryType())])).drop("__max")


def check_chunks(spark, folder: str, footers: DataFrame) -> None:
    """An error if a chunk file is missing or has another size than the footer says."""
    sizes = [(os.path.basename(p), os.path.getsize(p)) for p in glob.glob(f"{folder}/*.cargo")]
    listing = spark.createDataFrame(sizes, "name string, size bigint")
    bad = [r.name for r in A.chunk_violations(footers, listing).orderBy("name").limit(10).collect()]
    if bad:
        raise IntegrityError(f"chunks are missing or have another size: {bad}")


def write_document(manifest: DataFrame, files: DataFrame, entries: DataFrame, target: str, staging: str) -> None:
    """B1, B2: the JSON document of one manifest as a gzip file; files by path and entries by id, written by all machines."""
    head = manifest.withColumnRenamed("manifest_id", "file_name_prefix")
    # in the document an entry is one value, however many rows of the table it has
    rest = [c for c in entries.columns if c not in ("id", "files")]
    entries = entries.groupBy("id").agg(F.min(F.struct(*rest)).alias("r"), F.array_sort(F.flatten(F.collect_list("files"))).alias("files")).select("id", "r.*", "files")
    text = head.select(F.to_json(F.struct(*head.columns), {"ignoreNullFields": "true"}).alias("t")).first().t
    parts = []
    for step, (rows, order) in enumerate(((files.withColumn("path", P.to_uri(F.col("path"))), ["path", "id"]), (entries, ["id"]))):
        rows = rows.drop("manifest_id")
        first = rows.agg(F.min(F.struct(*order)).alias("f")).first().f
        own = F.struct(*[F.col(c) for c in rows.columns])
        is_first = F.lit(True) if first is None else (F.struct(*order) == F.struct(*[F.lit(x) for x in first]))
        line = F.concat(F.when(is_first, "").otherwise(","), F.lit('"'), F.col("id"), F.lit('"'), F.lit(":"), F.to_json(own))
        put_together(rows.orderBy(*order).select(line.alias("line")), "line", f"{staging}-{step}.gz", f"{staging}-{step}")
        parts.append(f"{staging}-{step}.gz")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target + ".part", "wb") as out:
        out.write(gzip.compress((text[:-1] + ("," if text != "{}" else "") + '"files":{').encode(), mtime=0))
        with open(parts[0], "rb") as f:
            shutil.copyfileobj(f, out, COPY)
        out.write(gzip.compress(b'},"archive_entries":{', mtime=0))
        with open(parts[1], "rb") as f:
            shutil.copyfileobj(f, out, COPY)
        out.write(gzip.compress(b"}}", mtime=0))
    os.replace(target + ".part", target)
    for p in parts:
        os.remove(p)
