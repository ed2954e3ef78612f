"""Manifests' documents read in pieces (A7, A8): a task holds one entry of a document, never the whole of it."""

from __future__ import annotations

import codecs
import glob
import gzip
import json
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import local_path

#: Members of a document that are maps from id to row.
TABLES = ("files", "archive_entries")
BLOCK = 1 << 20
_SCHEMA = "manifest_id string, key string, json string"
_decode = json.JSONDecoder().raw_decode


class _Text:
    """JSON text of a stream, of which what lies before `at` is done with."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.decoder = stream, codecs.getincrementaldecoder("utf-8")("replace")
        self.buf, self.at, self.done = "", 0, False

    def more(self) -> None:
        # as much again as is there, so that a long value isn't begun anew for each block
        data = self.stream.read(max(BLOCK, len(self.buf) - self.at))
        self.done = not data
        self.buf, self.at = self.buf[self.at :] + self.decoder.decode(data, self.done), 0

    def peek(self) -> str:
        while True:
            while self.at < len(self.buf) and self.buf[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.buf) or self.done:
                return self.buf[self.at : self.at + 1]
            self.more()

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"{wanted} expected")
        self.at += 1

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                value, end = _decode(self.buf, self.at)
                # a number at the end of what was read may go on
                if end < len(self.buf) or self.done:
                    text, self.at = self.buf[self.at : end], end
                    return value, text
            except ValueError:
                if self.done:
                    raise
            self.more()

    def members(self) -> Iterator[str]:
        """The keys of an object; whoever asks reads each one's value."""
        self.take("{")
        if self.peek() == "}":
            return self.take("}")
        while True:
            key = self.value()[0]
            if not isinstance(key, str):
                raise ValueError("a key is a string")
            self.take(":")
            yield key
            if self.peek() != ",":
                return self.take("}")
            self.take(",")


def entries(stream: BinaryIO) -> Iterator[tuple[str, str, str]]:
    """(table, id, text) of a document's rows, and ("", name, text) of its other members; no JSON: ValueError."""
    text = _Text(stream)
    for name in text.members():
        if name in TABLES and text.peek() == "{":
            for key in text.members():
                yield name, key, text.value()[1]
        else:
            yield "", name, text.value()[1]
    if text.peek():
        raise ValueError("the document goes on after its end")


def _head(path: str) -> dict[str, str] | None:
    """The members of a document but its tables, as texts; None if it is no JSON or has no name."""
    try:
        with gzip.open(path) as f:
            head = {name: text for table, name, text in entries(f) if not table}
    except ValueError:
        return None
    return head if isinstance(json.loads(head.get("file_name_prefix", "null")), str) else None


def pieces(spark: SparkSession, folder: str, suffix: str, table: str = "") -> DataFrame:
    """(manifest_id, key, json): each row of one table of the gzip documents in a mounted folder; no table: a row a document, without its tables.

    A document is read by one task, once to see that it is JSON to its end and once for its rows; others give no row.
    """
    paths = [(p,) for p in sorted(glob.glob(f"{glob.escape(local_path(folder))}/*{suffix}"))]

    def rows(path: str) -> Iterator[tuple[str, str, str]]:
        head = _head(path)
        if head is None:
            return
        name = json.loads(head["file_name_prefix"])
        if not table:
            yield name, "", "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in head.items()) + "}"
            return
        with gzip.open(path) as f:
            yield from ((name, key, text) for own, key, text in entries(f) if own == table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                held, size = [], 0
                for r in rows(path):
                    held.append(r)
                    size += len(r[2])
                    if size > BLOCK:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    if not paths:
        return spark.createDataFrame([], _SCHEMA)
    dealt = spark.createDataFrame(paths, "path string").repartition(len(paths), "path")
    return dealt.mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["manifest_id", "key", "json"])
