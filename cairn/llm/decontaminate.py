"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents are sequences of lower-cased word tokens (runs of letters and digits). Documents
join the benchmark on shared seeds of SEED_TOKENS tokens (an item with fewer is one seed); for each document and item
with a common seed, running Karp-Rabin greedy tiling marks the longest common runs first, never overlapping on
either side, while the search length falls to the seed's. An item's coverage is the marked share of its tokens, so passages that come
reordered or in parts still add up. Pairs at or over the threshold are leaks.

The benchmark is the stated query set: it is dealt into slices of bounded size, each broadcast against all rows.

Defined results: null or empty texts have no token and match nothing; an item without tokens is never covered; ties
between runs of equal length go to the earlier place in the item, then in the document; repeated rows come
back once each, repeated items each by itself; an empty table on either side gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SEED_TOKENS = 5
THRESHOLD = 0.6
#: Bytes of item text in one broadcast slice, about; an item is never cut.
SLICE_BYTES = 8 << 20
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x100000001B3)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


#: Inverse of _BASE modulo 2^64: a window's polynomial, divided by the power of its place, is its hash.
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Running:
    """Karp-Rabin hashes of a token sequence's windows of any length, from running sums of one polynomial modulo 2^64."""

    def __init__(self, ids: np.ndarray):
        values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(ids) - 1), _BASE)]), dtype=np.uint64)[: len(ids)]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers, dtype=np.uint64)])
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(ids), _INVERSE)]), dtype=np.uint64)

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.back[:n] if n > 0 else np.zeros(0, np.uint64)


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of `size` ids."""
    return Running(ids).windows(size)


def _open(free: np.ndarray, size: int) -> np.ndarray:
    """Places of the windows of `size` tokens of which none is marked."""
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[size:] == marked[: len(marked) - size]) if len(free) >= size else np.zeros(0, np.int64)


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length), longest first, with running Karp-Rabin.

    Only runs of unmarked tokens count; negative tokens match nothing. The search length falls: each round finds the
    longest common run by halving the interval between `least` and the last round's length (a run of some length
    holds one of every lesser), with hashes from running sums, and marks all such runs that don't overlap. A round takes
    time near proportional to the sequences, and a length occurs in one round only, so there are at most
    about the square root of twice the item's tokens.
    """
    near = np.zeros(len(doc), bool)
    hashes = Running(doc).windows(least)
    for at in np.flatnonzero(np.isin(hashes, Running(item).windows(least))) if len(hashes) else ():
        near[at : at + least] = True
    near &= doc >= 0
    # what is near no common window can't be in a run: runs of the rest are put together with a gap between them
    place = np.flatnonzero(near)
    if not len(place):
        return []
    gaps = np.flatnonzero(np.diff(place) > 1) + 1
    place, doc = np.insert(place, gaps, -1), np.insert(doc[place], gaps, -1)
    free_d, free_i = place >= 0, item >= 0
    of_d, of_i = Running(doc), Running(item)
    out: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and hashes of the open windows that both sides have."""
        d, i = _open(free_d, size), _open(free_i, size)
        hd, hi = of_d.windows(size)[d], of_i.windows(size)[i]
        here, there = np.isin(hd, hi), np.isin(hi, hd)
        return d[here], hd[here], i[there], hi[there]

    high = min(len(doc), len(item))
    while high >= least:
        low = least - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[0]) else (low, middle - 1)
        if low < least:
            break
        d, hd, i, hi = common(low)
        order = np.argsort(hd, kind="stable")
        d, hd = d[order], hd[order]
        # by hash, the next place in the document: a place that is taken never opens again
        first, last = np.searchsorted(hd, hi, "left"), np.searchsorted(hd, hi, "right")
        ahead: dict[int, int] = {}
        for b, f, e in zip(i.tolist(), first.tolist(), last.tolist(), strict=True):
            if not free_i[b : b + low].all():
                continue
            k = ahead.get(f, f)
            while k < e:
                a = int(d[k])
                k += 1
                if free_d[a : a + low].all() and (doc[a : a + low] == item[b : b + low]).all():
                    free_d[a : a + low] = False
                    free_i[b : b + low] = False
                    out.append((int(place[a]), b, low))
                    break
            ahead[f] = k
        high = low - 1
    return out


@dataclass
class Slice:
    """One slice of the benchmark: its vocabulary, token ids by item, and the seeds of every length that occurs."""

    vocabulary: dict[str, int]
    items: list[tuple[object, np.ndarray]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[object, str | None]]) -> Slice:
        vocabulary: dict[str, int] = {}
        items = []
        for key, text in rows:
            own = [vocabulary.setdefault(t, len(vocabulary)) for t in tokens(text)]
            if own:
                items.append((key, np.array(own, np.int32)))
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n, (_, ids) in enumerate(items):
            size = min(SEED_TOKENS, len(ids))
            by_size.setdefault(size, []).append((rolling(ids, size), n))
        seeds = {}
        for size, parts in by_size.items():
            h = np.concatenate([p for p, _ in parts])
            of = np.concatenate([np.full(len(p), n) for p, n in parts])
            pairs = np.unique(np.stack([h, of.astype(np.uint64)], 1), axis=0)
            values, first, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
            seeds[size] = values, np.stack([first, count], 1), pairs[:, 1].astype(np.int64)
        return cls(vocabulary, items, seeds)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(item, seed length) of all items that share a seed with the document."""
        out = []
        for size, (values, spans, owners) in self.seeds.items():
            h = rolling(ids, size)
            if not len(h):
                continue
            # tokens outside the vocabulary are in no item
            h = np.unique(h[(np.lib.stride_tricks.sliding_window_view(ids, size) >= 0).all(1)])
            at = np.searchsorted(values, h)
            at[at == len(values)] = 0
            hit = at[values[at] == h]
            found = {int(o) for a in hit for o in owners[spans[a, 0] : spans[a, 0] + spans[a, 1]]}
            out += [(o, size) for o in found]
        return sorted(out)

    def leaks(self, text: str | None, threshold: float) -> list[tuple[object, float, int, int, list[tuple[int, int, int]]]]:
        """(item key, coverage, marked tokens, item tokens, tiles) of the items that the text covers."""
        get = self.vocabulary.get
        ids = np.array([get(t, -1) for t in tokens(text)], np.int32)
        out = []
        if not (ids >= 0).any():
            return out
        for n, size in self.candidates(ids):
            key, item = self.items[n]
            tiles = tile(ids, item, size)
            marked = sum(x[2] for x in tiles)
            if marked >= threshold * len(item):
                out.append((key, marked / len(item), marked, len(item), sorted(tiles)))
        return out


def slices(benchmark: DataFrame, item: str, text: str, slice_bytes: int = SLICE_BYTES) -> Iterator[DataFrame]:
    """The benchmark in parts of about slice_bytes of text, dealt by a hash of the item."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // slice_bytes)) if total > slice_bytes else 1
    for k in range(parts):
        yield rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc, item, coverage, n_marked, n_item, tiles) of all pairs at or over the threshold."""
    ids = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    key = benchmark.schema[item].dataType
    spot = T.StructType([T.StructField(n, T.IntegerType()) for n in ("in_doc", "in_item", "length")])
    schema = T.StructType([T.StructField("doc", ids.schema["doc"].dataType), T.StructField("item", key), T.StructField("coverage", T.DoubleType()), T.StructField("n_marked", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("tiles", T.ArrayType(spot))])
    arrow_spot = pa.list_(pa.struct([(n, pa.int32()) for n in ("in_doc", "in_item", "length")]))
    found = []
    for part in slices(benchmark, item, item_text, slice_bytes):
        # Spark's own Arrow types, so that ids of any kind come back as they were
        rows = part.toArrow()
        kind = rows.schema.field("item").type
        sent = docs.sparkSession.sparkContext.broadcast(Slice.of(list(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, kind=kind) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, got = [], []
                for i, t in enumerate(b.column(1)):
                    for x in sent.value.leaks(t.as_py(), threshold):
                        at.append(i)
                        got.append(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([x[0] for x in got], kind), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.int64()), pa.array([x[3] for x in got], pa.int64()), pa.array([[dict(zip(("in_doc", "in_item", "length"), s, strict=True)) for s in x[4]] for x in got], arrow_spot)], ["doc", "item", "coverage", "n_marked", "n_item", "tiles"])

        found.append(ids.mapInArrow(run, schema))
    return reduce(DataFrame.unionAll, found)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs without the rows that cover a benchmark item; each row is judged by its own text, so ids don't matter."""
    at = docs.columns.index(text)
    for part in slices(benchmark, item, item_text, slice_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(Slice.of([(r[0], r[1]) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not sent.value.leaks(t.as_py(), threshold) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("coverage", 6).alias("coverage"), "n_marked", "n_item", F.size("tiles").cast("bigint").alias("n_tiles"))
