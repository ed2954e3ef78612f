"""Incremental line dedup: exact reference counts of line keys, fronted by sharded cuckoo filters.

The reference-count table (key, docs) is the truth. Keys at or over the threshold go into cuckoo filters, one a
shard. A filter never misses a key; the keys that it reports wrongly are found by probing the whole table (and, where
the texts are not those that were counted, the texts' own keys), and travel beside it, so that filter and exceptions
together decide exactly and texts need no shuffle. Filters and exceptions are broadcast only below `bound` bytes; beyond
it the decision is a shuffled join with the table, with the same result. Insertions add counts and deletions of
documents subtract them, both in the table and in the filters, so that any state can be reached again.

Defined results: null or empty text is one empty line; empty keys never go; a key counts once a document, rows
with an equal id (or none) being one document; an empty table gives an empty table; other columns pass unchanged. A ledger
refuses to insert a document that it holds and to delete one, or a text, that it doesn't.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS, fresh, keep, table

STRIP = b" \t\n\x0b\x0c\r"
DIGEST = 16
LEAST_DOCS = 10
BOUND = 32 << 20
SHARD_KEYS = 1 << 15
SLICE = 8 << 20


def line_key(line: bytes) -> bytes:
    """Digest of the stripped, lower-cased line; empty for an empty key."""
    key = line.strip(STRIP).lower()
    return hashlib.blake2b(key, digest_size=DIGEST).digest() if key else b""


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; supports deletion; membership of many keys at once."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        self.size = 1 << max(1, math.ceil(math.log2(max(1, capacity) / (self.SLOTS * 0.85))))
        self.slots = np.zeros((self.size, self.SLOTS), dtype=np.uint16)

    @staticmethod
    def _words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)
        marks = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        marks[marks == 0] = 1
        return words[:, 0], marks

    def _hop(self, marks: np.ndarray) -> np.ndarray:
        return ((marks.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) & np.uint64(self.size - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, marks = self._words(keys)
        first = low & np.uint64(self.size - 1)
        return first, first ^ self._hop(marks), marks

    def contains(self, keys: np.ndarray) -> np.ndarray:
        one, two, marks = self._places(keys)
        return (self.slots[one] == marks[:, None]).any(1) | (self.slots[two] == marks[:, None]).any(1)

    def _put(self, place: int, mark: int) -> bool:
        free = np.flatnonzero(self.slots[place] == 0)
        if free.size:
            self.slots[place, free[0]] = mark
        return bool(free.size)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place: the caller builds a larger filter."""
        for one, two, mark in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            if self._put(one, mark) or self._put(two, mark):
                continue
            at = one
            for kick in range(self.KICKS):
                slot = kick % self.SLOTS
                mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
                at ^= int(self._hop(np.array([mark], dtype=np.uint16))[0])
                if self._put(at, mark):
                    break
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for one, two, mark in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for place in (one, two):
                held = np.flatnonzero(self.slots[place] == mark)
                if held.size:
                    self.slots[place, held[0]] = 0
                    break

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        capacity = len(keys)
        while True:
            made = cls(capacity)
            if made.insert(keys):
                return made
            capacity *= 2

    def to_bytes(self) -> bytes:
        return self.slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.slots = np.frombuffer(data, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        made.size = len(made.slots)
        return made


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, DIGEST)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (np.ascontiguousarray(keys).view("<u8").reshape(-1, 2)[:, 1] >> np.uint64(32)) % np.uint64(shards)


class Decision:
    """Which keys go: filters by shard, less the keys that they report wrongly."""

    def __init__(self, shards: int, filters: dict[int, bytes], wrong: list[bytes]):
        self.shards, self.wrong = shards, frozenset(wrong)
        self.filters = {k: CuckooFilter.from_bytes(v) for k, v in filters.items()}

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        shards = shard_of(keys, self.shards)
        for s in np.unique(shards).tolist():
            if s in self.filters:
                at = np.flatnonzero(shards == s)
                out[at] = self.filters[s].contains(keys[at])
        return out

    def goes(self, keys: list[bytes]) -> list[bool]:
        full = [k for k in keys if k]
        hit = iter(self.maybe(np.frombuffer(b"".join(full), dtype=np.uint8).reshape(-1, DIGEST)).tolist() if full else [])
        return [bool(k) and next(hit) and k not in self.wrong for k in keys]


def line_keys(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, key): the distinct keys of each row's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, t in enumerate(b.column(1)):
                own = {line_key(x) for x in (t.as_py() or b"").split(b"\n")}
                own.discard(b"")
                at += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())], ["doc", "key"])

    ids = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text"))
    return ids.mapInArrow(run, T.StructType([T.StructField("doc", ids.schema["doc"].dataType), T.StructField("key", T.BinaryType())]))


def reference_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(key, docs): in how many documents each key occurs."""
    return line_keys(docs, doc, text).distinct().groupBy("key").agg(F.count("*").alias("docs"))


def build_filters(counts: DataFrame, least: int) -> tuple[int, DataFrame]:
    """Number of shards, and (shard, filter) of the keys in at least `least` documents."""
    hot = counts.where(F.col("docs") >= least).select("key")
    shards = max(1, math.ceil(hot.count() / SHARD_KEYS))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(_digests(b.column(0)), shards).astype(np.int32)), b.column(0)], ["shard", "key"])

    def build(group: pa.Table) -> pa.Table:
        keys = _digests(group.column("key").combine_chunks())
        return pa.table({"shard": group.column("shard")[:1].cast(pa.int32()), "filter": pa.array([CuckooFilter.build(keys).to_bytes()], pa.binary())})

    return shards, hot.mapInArrow(label, "shard int, key binary").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def update_filters(filters: DataFrame, shards: int, before: DataFrame, after: DataFrame, least: int) -> DataFrame:
    """Filters after a change of counts: keys that reached the threshold are inserted, those that left it deleted."""
    a = before.select("key", F.col("docs").alias("old"))
    moved = a.join(after, "key", "full").select("key", (F.coalesce("old", F.lit(0)) >= least).alias("was"), (F.coalesce("docs", F.lit(0)) >= least).alias("now")).where("was <> now")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(_digests(b.column(0)), shards).astype(np.int32)), b.column(0), b.column(1)], ["shard", "key", "now"])

    def change(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = (left if left.num_rows else right).column("shard")[:1].cast(pa.int32())
        held = CuckooFilter.from_bytes(left.column("filter")[0].as_py()) if left.num_rows else CuckooFilter(SHARD_KEYS)
        come, gone = ([k for k, n in zip(right.column("key").to_pylist(), right.column("now").to_pylist(), strict=True) if n is want] for want in (True, False))
        as_keys = lambda x: np.frombuffer(b"".join(x), dtype=np.uint8).reshape(-1, DIGEST)
        held.delete(as_keys(gone))
        if not held.insert(as_keys(come)):
            raise RuntimeError("a shard is full: build the filters anew with more shards")
        return pa.table({"shard": shard, "filter": pa.array([held.to_bytes()], pa.binary())})

    parts = moved.select("key", "now").mapInArrow(label, "shard int, key binary, now boolean")
    return filters.groupBy("shard").cogroup(parts.groupBy("shard")).applyInArrow(change, "shard int, filter binary")


def decide(counts: DataFrame, least: int, bound: int = BOUND, made: tuple[int, DataFrame] | None = None, asked: DataFrame | None = None) -> Decision | None:
    """The decision as an object of at most `bound` bytes; None if it would be larger.

    made: shards and filters of the counts, if there are any. asked: further keys (key) that it will be asked for;
    keys that are neither in the counts nor in `asked` may be reported wrongly.
    """
    shards, filters = made or build_filters(counts, least)
    filters = filters if made else keep(filters, "filters")
    if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) > bound:
        return None
    held = Decision(shards, {r.shard: bytes(r["filter"]) for r in filters.collect()}, [])
    sent = counts.sparkSession.sparkContext.broadcast(held)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(sent.value.maybe(_digests(b.column(0)))))

    if asked is None:
        wrong = counts.where(F.col("docs") < least).select("key").mapInArrow(probe, "key binary")
    else:
        # few keys but those that do go pass the filters; each of them is checked against the table
        wrong = asked.mapInArrow(probe, "key binary").distinct().join(counts.where(F.col("docs") >= least), "key", "left_anti")
    wrong = keep(wrong, "wrong")
    # a Python set entry takes some 100 bytes
    if wrong.count() * 100 > bound:
        return None
    return Decision(shards, {k: f.to_bytes() for k, f in held.filters.items()}, [bytes(r.key) for r in wrong.collect()])


def _drop_lines(docs: DataFrame, text: str, goes, extra: str | None = None) -> DataFrame:
    """docs with text less the lines that go, and n_lines, n_dropped. goes(keys, extra value) decides."""
    schema = T.StructType([*[f for f in docs.schema if f.name != extra], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = [f.name for f in schema]
    text_at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, size, kept, lines, gone = 0, 0, [], [], []
            extras = b.column(b.schema.get_field_index(extra)).to_pylist() if extra else None
            for i, t in enumerate(b.column(text_at)):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                own = raw.split(b"\n")
                out = goes([line_key(x) for x in own], extras[i] if extra else None)
                kept.append(b"\n".join(x for x, d in zip(own, out, strict=True) if not d))
                lines.append(len(own))
                gone.append(sum(out))
                size += len(raw)
                if size > SLICE or i == b.num_rows - 1:
                    part = b.slice(begin, len(kept))
                    columns = [pa.array(kept, pa.binary()).cast(pa.string()) if n == text else pa.array(lines, pa.int64()) if n == "n_lines" else pa.array(gone, pa.int64()) if n == "n_dropped" else part.column(part.schema.get_field_index(n)) for n in names]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    begin, size, kept, lines, gone = i + 1, 0, [], [], []

    return docs.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST_DOCS, counts: DataFrame | None = None, bound: int = BOUND, made: tuple[int, DataFrame] | None = None) -> DataFrame:
    """docs without the lines whose key is in at least `least` documents; n_lines and n_dropped are added.

    counts: an existing reference-count table, and `made` its shards and filters; if None, those of docs. Columns n_lines
    and n_dropped of the input, if any, are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    asked = None if counts is None else line_keys(docs, doc, text).select("key")
    counts = keep(reference_counts(docs, doc, text), "linecounts", TEXTS) if counts is None else counts
    ready = decide(counts, least, bound, made, asked)
    if ready is not None:
        sent = docs.sparkSession.sparkContext.broadcast(ready)
        return _drop_lines(docs, text, lambda keys, _: sent.value.goes(keys))
    hot = counts.where(F.col("docs") >= least).select("key")
    per = line_keys(docs, doc, text).join(hot, "key").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    name = fresh(docs, "line_keys_of_doc")
    joined = docs.join(per.select(F.col("doc").alias(name + "_id"), F.col("keys").alias(name)), F.col(doc).eqNullSafe(F.col(name + "_id")), "left").drop(name + "_id")

    def by_set(keys: list[bytes], own: list[bytes] | None) -> list[bool]:
        held = frozenset(own or ())
        return [k in held for k in keys]

    return _drop_lines(joined, text, by_set, name)


class LineLedger:
    """Reference counts and filters of a growing and shrinking set of documents, in a shared folder.

    `docs` holds each document's id (as text; null is an id) and a digest of its rows' texts.
    """

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCS):
        self.spark, self.least = spark, least
        self.counts = spark.createDataFrame([], "key binary, docs bigint")
        self.docs = spark.createDataFrame([], "id string, texts bigint")
        self.shards, self.filters = 1, spark.createDataFrame([], "shard int, filter binary")

    @staticmethod
    def _documents(docs: DataFrame, doc: str, text: str) -> DataFrame:
        """(id, texts): the order of a document's rows doesn't matter."""
        rows = docs.select(F.col(doc).cast("string").alias("id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("h"))
        return rows.groupBy("id").agg(F.xxhash64(F.sum(F.col("h").cast("decimal(38,0)")), F.count("*")).alias("texts"))

    def _apply(self, docs: DataFrame, doc: str, text: str, sign: int) -> LineLedger:
        delta = reference_counts(docs, doc, text).select("key", (F.col("docs") * sign).alias("docs"))
        after = self.counts.unionByName(delta).groupBy("key").agg(F.sum("docs").alias("docs")).where("docs <> 0")
        after = keep(after, "linecounts")
        hot = after.where(F.col("docs") >= self.least).count()
        if hot > 0.8 * self.shards * SHARD_KEYS or not self.shards:
            self.shards, made = build_filters(after, self.least)
        else:
            made = update_filters(self.filters, self.shards, self.counts, after, self.least)
        self.counts, self.filters = after, keep(made, "filters")
        return self

    def insert(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> LineLedger:
        """Add documents; ValueError, and nothing is changed, if the ledger holds one of them."""
        own = keep(self._documents(docs, doc, text), "lineids")
        if not own.alias("a").join(self.docs.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi").isEmpty():
            raise ValueError("the ledger holds some of these documents")
        out = self._apply(docs, doc, text, 1)
        out.docs = keep(self.docs.unionByName(own), "lineids")
        return out

    def delete(self, docs: DataFrame, doc: str = "doc_id", text: str = "text") -> LineLedger:
        """Take back whole documents as they were inserted; ValueError, and nothing is changed, if one of them was not."""
        own = keep(self._documents(docs, doc, text), "lineids")
        same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.texts") == F.col("b.texts"))
        if not own.alias("a").join(self.docs.alias("b"), same, "left_anti").isEmpty():
            raise ValueError("the ledger does not hold some of these documents, or not with these texts")
        out = self._apply(docs, doc, text, -1)
        out.docs = keep(self.docs.alias("a").join(own.alias("b"), same, "left_anti"), "lineids")
        return out

    def clean(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
        """Any texts, counted or not, without the lines that the ledger's documents share; decided by the ledger's own filters."""
        return dedup_lines(docs, doc, text, self.least, self.counts, bound, (self.shards, self.filters))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN h ON k.key = h.key GROUP BY doc_id
"""
