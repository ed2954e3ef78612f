"""Language-model scoring: a unigram base and prediction by partial matching over bytes.

Pretrained mode: byte strings of up to ORDER + 1 are counted over all training texts, and every one of them is a node
of the context trie. A symbol's probability starts at the longest known context; an unseen symbol
pays the escape estimate of method D (half a count for each distinct symbol) and is looked up in the next shorter context
without the symbols that the longer one had (symbol exclusion), down to a uniform order. A gram's probability
depends on the gram alone, so it is worked out once for each distinct gram, by joins over the whole count tables. Grams at or
over GRAM_SHARE of all counted bytes are looked up in a broadcast table, which only saves shuffling; all others, seen or
unseen, by a shuffled join of (row, gram). Adaptive mode: the same estimates with counts of the document's own past only.

Base: words' log10((c + 1) / (N + V + 1)). Frequent words (at or over the same share of all tokens) are looked
up in a broadcast table, the rest by a shuffled join of (row, word) with the words' counts.

Defined results: null text is empty and scores its end only; without training documents every symbol is uniform
and N is zero; repeated rows come back once each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, table

ORDER = 5
#: Share of all tokens from which a word is broadcast, and of all counted bytes from which a gram is; the rest is joined.
SHARE, GRAM_SHARE = 2.0**-20, 2.0**-22
#: Bytes that UTF-8 never has: before a text, and its end.
PAD, END = 0xFE, 0xFF
#: Symbols of the uniform order: every byte but PAD.
ALPHABET = 255
PIECE = 4 << 20
#: Distinct grams, or words, that a task holds before it hands them on.
HELD = 1 << 20
#: Grams of a text that are not broadcast, and how often it has them.
GRAMS = pa.list_(pa.struct([("gram", pa.int64()), ("c", pa.int64())]))


def pieces(text: bytes) -> Iterator[bytes]:
    """The text with its borders, in pieces that begin with the ORDER bytes before them."""
    whole = bytes([PAD]) * ORDER + text.lower() + bytes([END])
    for at in range(0, len(whole) - ORDER, PIECE):
        yield whole[at : at + PIECE + ORDER]


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed strings of ORDER + 1 bytes that end at each position past a piece's first ORDER, and the pieces' numbers."""
    sizes = np.array([len(p) for p in parts])
    s = np.frombuffer(b"".join(parts), np.uint8)
    g = np.zeros(len(s) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        g = (g << np.uint64(8)) | s[k : len(s) - ORDER + k]
    good = np.ones(len(s), bool)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for k in range(ORDER):
        good[starts + k] = False
    good = good[ORDER:]
    return g[good], np.repeat(np.arange(len(parts), dtype=np.uint64), sizes - ORDER)


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def batches_of(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and pieces of texts, some PIECE bytes at a time."""
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in texts:
        for p in pieces(t):
            ids.append(i)
            parts.append(p)
            size += len(p)
            if size >= PIECE or len(parts) == 65536:
                yield ids, parts
                ids, parts, size = [], [], 0
    if parts:
        yield ids, parts


def count_grams(texts: DataFrame) -> DataFrame:
    """texts (text binary) to (gram, n), summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["gram", "n"])

        every = ((0, t.as_py() or b"") for b in batches for t in b.column(0))
        for _, parts in batches_of(every):
            g = np.sort(grams(parts)[0])
            at = _runs(g)
            own = np.diff(np.concatenate([at, [len(g)]]))
            k, c = np.concatenate([keys, g[at]]), np.concatenate([counts, own])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            at = _runs(k)
            keys, counts = k[at], np.add.reduceat(c, at)
            if len(keys) > HELD:
                yield out()
                keys, counts = keys[:0], counts[:0]
        yield out()

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Nodes and contexts of one context length, sorted by their packed bytes."""

    nodes: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    #: What a context's symbols count for in the next shorter context.
    shorter: np.ndarray
    #: Occurrences of a context before symbols that are no nodes.
    missing: np.ndarray


def _find(table_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table_, keys)
    at[at == len(table_)] = 0
    return at, (table_[at] == keys) if len(table_) else np.zeros(len(keys), bool)


class Trie:
    """The context trie: a Level for each context length from 0 to ORDER."""

    def __init__(self, strings: dict[int, tuple[np.ndarray, np.ndarray]]):
        """strings: by length from 1 to ORDER + 1, packed byte strings and their counts, closed under suffixes."""
        self.levels: list[Level] = []
        for k in range(ORDER + 1):
            nodes, counts = strings.get(k + 1, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            order = np.argsort(nodes)
            nodes, counts = nodes[order], counts[order].astype(np.int64)
            held = nodes >> np.uint64(8)
            at = _runs(held)
            total = np.add.reduceat(counts, at) if len(at) else counts
            distinct = np.diff(np.concatenate([at, [len(nodes)]])).astype(np.int64) if len(at) else counts
            shorter, missing = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            if k and len(at):
                below = self.levels[k - 1]
                where, good = _find(below.nodes, nodes & np.uint64((1 << 8 * k) - 1))
                shorter = np.add.reduceat(np.where(good, below.counts[where], 0), at)
                where, good = _find(below.nodes, held[at])
                missing = np.maximum(0, np.where(good, below.counts[where], 0) - total)
            self.levels.append(Level(nodes, counts, held[at], total, distinct, shorter, missing))

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its first ORDER bytes."""
        out = np.zeros(len(g))
        alive = np.arange(len(g))
        gone_d, gone_n = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            if not len(level.nodes) or not len(alive):
                continue
            x = g[alive]
            at, known = _find(level.contexts, (x >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1))
            node, seen = _find(level.nodes, x & np.uint64((1 << 8 * (k + 1)) - 1))
            fresh = level.distinct[at] - gone_d[alive]
            escapes = fresh / 2 + level.missing[at]
            room = level.total[at] - gone_n[alive] + level.missing[at]
            hit = known & seen
            out[alive[hit]] += np.log10((level.counts[node[hit]] - 0.5) / room[hit])
            pay = known & ~seen & (escapes > 0)
            out[alive[pay]] += np.log10(escapes[pay] / room[pay])
            left = known & ~seen
            gone_d[alive[left]], gone_n[alive[left]] = level.distinct[at[left]], level.shorter[at[left]]
            alive = alive[~hit]
        out[alive] -= np.log10(ALPHABET - gone_d[alive])
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end."""
        out = np.zeros(len(texts))
        for ids, parts in batches_of(iter(enumerate(texts))):
            g, of = grams(parts)
            mixed = np.sort((g << np.uint64(16)) | of)
            g = mixed >> np.uint64(16)
            at = _runs(g)
            each = np.repeat(self.log10(g[at]), np.diff(np.concatenate([at, [len(g)]])))
            own = np.bincount((mixed & np.uint64(0xFFFF)).astype(np.int64), weights=each, minlength=len(parts))
            np.add.at(out, np.array(ids), own)
        return out


def _tail(gram: Column, size: int) -> Column:
    """The last `size` bytes of packed strings."""
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1))


def levels(full: DataFrame) -> dict[int, DataFrame]:
    """By size, (node, n) of all strings of so many bytes; each is summed from the next longer one, and written."""
    now = full.select(F.col("gram").alias("node"), "n")
    out = {ORDER + 1: now}
    for size in range(ORDER, 0, -1):
        now = keep(now.groupBy(_tail(F.col("node"), size).alias("node")).agg(F.sum("n").alias("n")), f"strings{size}")
        out[size] = now
    return out


def _few(df: DataFrame, size: int) -> DataFrame:
    """Strings of at most two bytes are 65,536 at most."""
    return F.broadcast(df) if size <= 2 else df


def contexts(strings: dict[int, DataFrame], size: int) -> DataFrame:
    """(context, total, distinct, shorter) of all contexts of `size` bytes: their symbols' count, their number, and their count in the next shorter context."""
    below = _few(strings[size].select(F.col("node").alias("below"), F.col("n").alias("own")), size)
    nodes = strings[size + 1].join(below, _tail(F.col("node"), size) == F.col("below"))
    found = nodes.groupBy(F.shiftright("node", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("own").alias("shorter"))
    return _few(found, size)


def seen_log10(full: DataFrame) -> DataFrame:
    """(gram, n, value): log10 of the probability of the last byte of each counted gram."""
    totals = full.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"))
    return full.join(totals, F.shiftright("gram", 8) == F.col("context")).select("gram", "n", F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))


def unseen_log10(asked: DataFrame, full: DataFrame) -> DataFrame:
    """(gram, value) of distinct grams that no training text has; the steps of Trie.log10 as joins."""
    strings = levels(full)
    total, distinct = strings[1].agg(F.sum("n"), F.count("*")).first()
    none = F.lit(0).cast("bigint")
    now = asked.select("gram", F.lit(0.0).alias("value"), F.lit(False).alias("done"), none.alias("gone_d"), none.alias("gone_n"))
    for k in range(ORDER, -1, -1):
        if k:
            now = now.join(contexts(strings, k), _tail(F.shiftright("gram", 8), k) == F.col("context"), "left")
        else:
            now = now.withColumns({"total": F.lit(total), "distinct": F.lit(distinct), "shorter": none})
        # the whole gram is unseen
        now = now.join(_few(strings[k + 1], k + 1), _tail(F.col("gram"), k + 1) == F.col("node"), "left") if k < ORDER else now.withColumn("n", F.lit(None).cast("bigint"))
        hit, known = ~F.col("done") & F.col("n").isNotNull(), ~F.col("done") & F.col("total").isNotNull()
        room, escapes = F.col("total") - F.col("gone_n"), (F.col("distinct") - F.col("gone_d")) / 2
        paid = F.when(hit, F.log10((F.col("n") - 0.5) / room)).when(known & (escapes > 0), F.log10(escapes / room)).otherwise(0.0)
        now = now.select("gram", (F.col("value") + paid).alias("value"), (F.col("done") | hit).alias("done"), F.when(known, F.col("distinct")).otherwise(F.col("gone_d")).alias("gone_d"), F.when(known, F.col("shorter")).otherwise(F.col("gone_n")).alias("gone_n"))
    return now.select("gram", F.when(F.col("done"), F.col("value")).otherwise(F.col("value") - F.log10(F.lit(ALPHABET) - F.col("gone_d"))).alias("value"))


def look_up(texts: list[bytes], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Each text's sum over the grams in `keys` (sorted), and its other grams with their counts."""
    out = np.zeros(len(texts))
    rest, often, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for ids, parts in batches_of(iter(enumerate(texts))):
        g, of = grams(parts)
        mixed = np.sort((g << np.uint64(16)) | of)
        at = _runs(mixed)
        n = np.diff(np.concatenate([at, [len(mixed)]]))
        g, of = mixed[at] >> np.uint64(16), np.array(ids, np.int64)[(mixed[at] & np.uint64(0xFFFF)).astype(np.int64)]
        where, known = _find(keys, g)
        if known.any():
            out += np.bincount(of[known], weights=n[known] * values[where[known]], minlength=len(texts))
        rest.append(g[~known])
        often.append(n[~known])
        owner.append(of[~known])
    of = np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(rest)[order].view(np.int64)), pa.array(np.concatenate(often)[order])], ["gram", "c"])
    return out, pa.ListArray.from_arrays(pa.array(offsets), pairs)


def train(texts: DataFrame, share: float = SHARE) -> Trie:
    """A trie for one process: strings whose count is at least `share` of all counted bytes; score_documents prunes nothing."""
    full = keep(count_grams(texts), "grams")
    total = full.agg(F.sum("n")).first()[0] or 0
    least = max(1, math.ceil(total * share))
    strings = {}
    for size in range(1, ORDER + 2):
        cut = F.col("gram").bitwiseAND(F.lit((1 << 8 * size) - 1))
        found = full.groupBy(cut.alias("gram")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
        strings[size] = (found.column("gram").to_numpy().astype(np.uint64), found.column("n").to_numpy())
    return Trie(strings)


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of a text and its end with counts of its own past; small texts, plain form of the same estimates."""
    whole = bytes([PAD]) * order + text.lower() + bytes([END])
    seen: dict[bytes, Counter] = defaultdict(Counter)
    out = 0.0
    for i in range(order, len(whole)):
        symbol, gone = whole[i], frozenset()
        for k in range(order, -1, -1):
            own = seen.get(whole[i - k : i])
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in gone}
            room = sum(left.values())
            if symbol in left:
                out += math.log10((left[symbol] - 0.5) / room)
                break
            if left:
                out += math.log10(len(left) / 2 / room)
            gone = frozenset(own)
        else:
            out -= math.log10(ALPHABET - len(gone))
        for k in range(order + 1):
            seen[whole[i - k : i]][symbol] += 1
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """texts (text binary) to (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                held.update((t.as_py() or b"").lower().split())
                if len(held) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, learn: Column, doc: str = "doc_id", text: str = "text", mode: str = "pretrained", share: float = SHARE, gram_share: float = GRAM_SHARE) -> DataFrame:
    """(doc, learnt, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every row; `learn` marks training rows.

    `share` and `gram_share` decide what is broadcast, not what is counted.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.coalesce(learn, F.lit(False)).alias("learnt"), F.col(text).cast("binary").alias("text"))
    training = rows.where("learnt")
    counts = keep(count_words(training.select("text")), "words")
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    total, kinds = words + ends, distinct + (ends > 0)
    least = max(1, math.ceil(total * share))
    frequent = counts.where(F.col("n") >= least).toArrow()
    head = dict(zip(frequent.column("word").to_pylist(), frequent.column("n").to_pylist(), strict=True))
    keys, values = np.zeros(0, np.uint64), np.zeros(0)
    full = seen = None
    bytes_ = 0
    if mode == "pretrained":
        full = keep(count_grams(training.select("text")), "grams")
        bytes_ = full.agg(F.sum("n")).first()[0] or 0
    if bytes_:
        seen = keep(seen_log10(full), "seen")
        gram_least = max(1, math.ceil(bytes_ * gram_share))
        common = seen.where(F.col("n") >= gram_least).select("gram", "value").toArrow()
        keys, values = common.column("gram").to_numpy().astype(np.uint64), common.column("value").to_numpy()
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        del common
    sent = docs.sparkSession.sparkContext.broadcast(({w: math.log10(n + 1) for w, n in head.items()}, keys, values))
    del head, frequent
    end_part, all_part = math.log10(ends + 1), math.log10(total + kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, values = sent.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                b = whole.slice(begin, 512)
                texts = [t or b"" for t in b.column(2).to_pylist()]
                tokens, hits, base, rest, often, offsets = [], [], [], [], [], [0]
                for t in texts:
                    own = t.lower().split()
                    n, part = 0, 0.0
                    for w, c in Counter(own).items():
                        v = known.get(w)
                        if v is None:
                            rest.append(w)
                            often.append(c)
                        else:
                            part += c * v
                            n += c
                    offsets.append(len(rest))
                    tokens.append(len(own) + 1)
                    hits.append(n)
                    base.append(part)
                asked = pa.nulls(len(texts), GRAMS)
                if bytes_:
                    scores, asked = look_up(texts, keys, values)
                elif mode == "pretrained":
                    scores = np.array([-math.log10(ALPHABET) * (len(t.lower()) + 1) for t in texts])
                else:
                    scores = np.array([adaptive_log10(t) for t in texts])
                tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(often, pa.int64())], ["word", "c"]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array([len(t) for t in texts], pa.int64()), tail, asked], ["doc", "learnt", "n_tokens", "hits", "part", "score", "n_bytes", "tail", "asked"])

    schema = T.StructType([rows.schema["doc"], T.StructField("learnt", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "hits")], T.StructField("part", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_bytes", T.LongType()), T.StructField("tail", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())]))), T.StructField("asked", T.ArrayType(T.StructType([T.StructField("gram", T.LongType()), T.StructField("c", T.LongType())])))])
    scored = keep(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = counts.where(F.col("n") < least)
    tails = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.c").join(rare, "word").groupBy("row").agg(F.sum(F.col("c") * F.log10(F.col("n") + 1)).alias("more"), F.sum("c").alias("found"))
    out = scored.drop("tail", "asked").join(tails, "row", "left")
    if bytes_:
        asked = scored.select("row", F.explode("asked").alias("t")).select("row", "t.gram", "t.c")
        unseen = keep(unseen_log10(asked.select("gram").distinct().join(full, "gram", "left_anti"), full), "unseen")
        each = seen.where(F.col("n") < gram_least).select("gram", "value").unionAll(unseen)
        others = asked.join(each, "gram").groupBy("row").agg(F.sum(F.col("c") * F.col("value")).alias("others"))
        out = out.join(others, "row", "left").withColumn("score", F.col("score") + F.coalesce("others", F.lit(0.0)))
    base = F.col("part") + F.coalesce("more", F.lit(0.0)) + F.lit(end_part) - F.col("n_tokens") * F.lit(all_part)
    n_known = F.col("hits") + F.coalesce("found", F.lit(0)) + F.lit(int(ends > 0))
    return out.select("doc", "learnt", "n_tokens", n_known.cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")


def op5_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    out = score_documents(docs, learn)
    return out.select(F.col("doc").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
