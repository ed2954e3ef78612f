"""SimHash near-dedup by Golay-code fuzzy hashing.

A text's 64-bit fingerprint has a bit set if it is set in over half of its shingles' hashes. Fingerprints link
at `bits` (4) or fewer differing bits; documents of one connected component are one group.

Finding all links. A fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect binary Golay code (23, 12, 7). With at most four errors over three segments, either a segment has none, or two
segments have exactly one each and the last at most two. The first case is a key of the exact segment (a codeword and its
error pattern) and a fifth of the rest, one of which has no error either. For the second, every word has one home, the
nearest codeword (distance 3 or less), and up to six probes, the codewords within distance 4. If two words differ in one bit,
each one's home is among the other's probes. So one text's (probe, home) of the two segments meets the other's (home,
probe) in a key of one's home and the other's home, some five keys each; with a third of the last segment, one of which
has no error, they miss no such pair. Keys have some 30 bits, so that candidates stay few; they are verified by
counting differing bits. Beyond WIDER fingerprints the keys take two parts of one more (36 and 34 bits), three
and two times as many keys.

Buckets are cut into blocks of bounded size and verified block by block; a pair of blocks gives a spanning
forest of its links, never all of its pairs, so a group of copies costs as many links as it has members. Blocks are verified
against themselves first; pairs of blocks, and later the second case, are left out where a bucket holds one group only.

Defined results: null text is empty; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle are one shingle; equal texts have equal fingerprints; rows with a repeated id are one
document; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_merge, components, keep, table

BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a bucket that are compared in one piece.
BLOCK = 1024
#: Fingerprints beyond which keys have more bits.
WIDER = 1 << 27
#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def fingerprint(text: bytes | None, width: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(whole, SEED)
    starts = [0, *ends]
    hashes = np.array([hashed(whole[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)], dtype="<u8")
    # counted in pieces, so that a long text takes no more memory than a short one
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the message part of the nearest codeword's error, the probes' parts, and how many; and syndromes by byte.

    A codeword's upper 12 bits are its message, which serves as its index.
    """

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    single = [syndrome(1 << b) for b in range(23)]
    home, probes, count = np.zeros(2048, np.int64), np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for b in at:
                s ^= single[b]
            message = sum(1 << b for b in at) >> 11
            if weight <= 3:
                home[s] = message
            probes[s, count[s]] = message
            count[s] += 1
    by_byte = np.zeros((3, 256), np.int64)
    for k in range(3):
        for v in range(256):
            by_byte[k, v] = syndrome(v << 8 * k) if v << 8 * k < 1 << 23 else 0
    return home, probes, count, by_byte


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    u = fps.view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _decoded(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home, probes and their number of each word."""
    home, probes, count, by_byte = golay()
    s = by_byte[0, words & 255] ^ by_byte[1, words >> 8 & 255] ^ by_byte[2, words >> 16]
    message = words >> 11
    return message ^ home[s], message[:, None] ^ probes[s], count[s]


def _parts(value: np.ndarray, size: int, n: int) -> list[np.ndarray]:
    """value's `size` bits in n parts of near equal length."""
    ends = [round(i * size / n) for i in range(n + 1)]
    return [(value >> a) & ((1 << (b - a)) - 1) for a, b in zip(ends, ends[1:], strict=False)]


def _chosen(parts: list[np.ndarray], sizes: list[int], spare: int) -> Iterator[np.ndarray]:
    """Every choice of `spare` parts, put together."""
    for own in combinations(range(len(parts)), spare):
        out = np.zeros_like(parts[0])
        for i in own:
            out = (out << sizes[i]) | parts[i]
        yield out


def _sizes(size: int, n: int) -> list[int]:
    ends = [round(i * size / n) for i in range(n + 1)]
    return [b - a for a, b in zip(ends, ends[1:], strict=False)]


def exact_keys(fps: np.ndarray, spare: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the places of their fingerprints: each segment, with each choice of `spare` of BITS + spare parts of the rest.

    Four errors leave `spare` parts as they are.
    """
    s, keys = _segments(fps), []
    for k in range(3):
        (b, nb), (c, nc) = ((s[i], SEGMENTS[i][1]) for i in range(3) if i != k)
        n = BITS + spare
        for part in _chosen(_parts((b << nc) | c, nb + nc, n), _sizes(nb + nc, n), spare):
            keys.append((len(keys) << 40) | (s[k] << 16) | part)
    return np.concatenate(keys), np.tile(np.arange(len(fps)), len(keys))


def _pairs(s: list[np.ndarray], spare: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(number, a, b, part): each pair of segments with each choice of `spare` of 2 + spare parts of the last: two errors leave them as they are."""
    number = 0
    for a, b in combinations(range(3), 2):
        c, n = 3 - a - b, 2 + spare
        for part in _chosen(_parts(s[c], SEGMENTS[c][1], n), _sizes(SEGMENTS[c][1], n), spare):
            yield number, a, b, part
            number += 1


def _fuzzy(fps: np.ndarray, probed: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places: for each pair of segments and parts of the last one, the probes of one of the pair with the home of the other."""
    s = _segments(fps)
    keys, who = [], []
    for k, *pair, part in _pairs(s, spare):
        _, probes, count = _decoded(s[pair[probed]])
        home = _decoded(s[pair[1 - probed]])[0]
        every = (k << 40) | (probes << (28 if probed == 0 else 16)) | (home << (16 if probed == 0 else 28))[:, None] | part[:, None]
        keys.append(every[np.arange(6)[None, :] < count[:, None]])
        who.append(np.repeat(np.arange(len(fps)), count))
    return np.concatenate(keys), np.concatenate(who)


def left_keys(fps: np.ndarray, spare: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places: probes of a pair's first segment with the home of its second."""
    return _fuzzy(fps, 0, spare)


def right_keys(fps: np.ndarray, spare: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places: the home of a pair's first segment with probes of its second."""
    return _fuzzy(fps, 1, spare)


def spare_parts(n: int) -> int:
    """Parts in a key for n fingerprints. Any number finds the same links: more give more keys, of more bits, to meet fewer strangers."""
    return 1 if n <= WIDER else 2


def _keyed(nodes: DataFrame, make, extra: str | None = None, spare: int = 1) -> DataFrame:
    """(key, node) and one further column of nodes (node, fps: a fingerprint of each kind, ...)."""
    rows = nodes.select("node", F.posexplode("fps").alias("kind", "fp"), *([extra] if extra else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                node, kind, fp = (np.ascontiguousarray(part.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
                keys, who = make(fp, spare)
                columns = [pa.array(keys | kind.astype(np.int64)[who] << 56), pa.array(node[who])]
                if extra:
                    columns.append(part.column(3).take(pa.array(who)))
                yield pa.RecordBatch.from_arrays(columns, ["key", "node", *([extra] if extra else [])])

    return rows.mapInArrow(run, "key long, node long" + (f", {extra} long" if extra else ""))


def _near(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Which signatures (rows of words) differ in at most `limit` bits; x and y are broadcast against each other."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= limit


def _forest(nx: np.ndarray, sx: np.ndarray, ny: np.ndarray, sy: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (node, root) that span the same groups as all links between the nodes nx and ny with signatures sx and sy."""
    # row by row, so that what is held at once doesn't grow with the block's square times the signature
    near = np.stack([_near(sx[i], sy, limit) for i in range(len(sx))])
    rows, cols = near.any(1), near.any(0)
    nx, ny, near = nx[rows], ny[cols], near[rows][:, cols]
    if not len(nx):
        return []
    top = np.iinfo(np.int64).max
    lx, ly = nx.copy(), ny.copy()
    while True:
        mx = np.minimum(lx, np.where(near, ly[None, :], top).min(1))
        my = np.minimum(ly, np.where(near, mx[:, None], top).min(0))
        if (mx == lx).all() and (my == ly).all():
            break
        lx, ly = mx, my
    return [(a, b) for a, b in zip([*nx.tolist(), *ny.tolist()], [*lx.tolist(), *ly.tolist()], strict=True) if a != b]


def verify(units: DataFrame, limit: int) -> DataFrame:
    """units (x, y: arrays of struct<node, sign>) to links (a, b) of nodes whose signatures differ in at most `limit` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sides = [], [], []
            for column in (batch.column(0), batch.column(1)):
                # flatten() follows the slice of the batch; lengths follow from the lists themselves
                nodes_, signs_ = column.flatten().flatten()
                size = np.asarray(pc.list_value_length(column))
                node = np.ascontiguousarray(nodes_.to_numpy(zero_copy_only=False))
                sign = np.ascontiguousarray(signs_.flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
                sides.append((size, np.concatenate([[0], np.cumsum(size)]), node, sign.reshape(len(node), -1) if len(node) else sign.reshape(0, 1)))
            (nx, ox, fx, sx), (ny, oy, fy, sy) = sides
            single = np.flatnonzero((nx == 1) & (ny == 1))
            p, q = ox[single], oy[single]
            good = _near(sx[p], sy[q], limit) & (fx[p] != fy[q]) if len(single) else np.zeros(0, bool)
            a += fx[p[good]].tolist()
            b += fy[q[good]].tolist()
            for i in np.flatnonzero(nx * ny > 1).tolist():
                for u, v in _forest(fx[ox[i] : ox[i + 1]], sx[ox[i] : ox[i + 1]], fy[oy[i] : oy[i + 1]], sy[oy[i] : oy[i + 1]], limit):
                    a.append(u)
                    b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return units.mapInArrow(run, "a long, b long").distinct()


def _blocked(keyed: DataFrame, name: str) -> DataFrame:
    """(key, block, members) with some BLOCK members each at most on the mean; keyed has key, node, sign and blocks."""
    # another block in another bucket, so that what one keeps apart the next brings together
    block = F.when(F.col("blocks") == 1, F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    return keyed.withColumn("block", block).groupBy("key", "block").agg(F.collect_list(F.struct("node", "sign")).alias(name))


def link_components(nodes: DataFrame, limit: int = BITS) -> DataFrame:
    """nodes (node, fps, sign) to (node, root) of all nodes.

    Two nodes are candidates if fingerprints of one kind differ in at most BITS bits, and linked if their signatures
    (arrays of words) differ in at most `limit` bits.
    """
    spare = spare_parts(nodes.count())
    signs = nodes.select("node", "sign")
    exact = _keyed(nodes, exact_keys, spare=spare)
    held = exact.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    held = keep(exact.join(by_merge(held), "key"), "held")
    parts = _blocked(held.join(by_merge(signs), "node"), "x")
    first = keep(verify(parts.select("x", F.col("x").alias("y")), limit), "exactlinks")
    many = held.where("blocks > 1")
    if not many.isEmpty():
        roots = components(first).withColumnRenamed("node", "of")
        own = many.join(by_merge(roots), F.col("node") == F.col("of"), "left").select("key", F.coalesce("root", "node").alias("root"))
        mixed = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        parts = _blocked(many.join(by_merge(mixed), "key").join(by_merge(signs), "node"), "x")
        units = parts.join(by_merge(parts.select("key", F.col("block").alias("other"), F.col("x").alias("y"))), "key").where("block < other")
        first = keep(first.unionByName(verify(units.select("x", "y"), limit)), "exactlinks")
    roots = components(first).withColumnRenamed("node", "of")
    known = keep(nodes.join(by_merge(roots), F.col("node") == F.col("of"), "left").select("node", "fps", "sign", F.coalesce("root", "node").alias("root")), "roots")
    signs = known.select("node", "sign")
    homes = _keyed(known, right_keys, "root", spare)
    buckets = homes.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n")
    # a probe whose bucket holds its own group only cannot add a link between groups
    probes = _keyed(known, left_keys, "root", spare).alias("p").join(by_merge(buckets).alias("h"), (F.col("p.key") == F.col("h.key")) & ~((F.col("h.low") == F.col("h.high")) & (F.col("h.low") == F.col("p.root")))).select("p.key", "node", "blocks")
    probes = keep(probes, "probes")
    asked = _blocked(probes.join(by_merge(signs), "node"), "y").select("key", "y")
    wanted = homes.select("key", "node").join(by_merge(probes.select("key", "blocks").distinct()), "key").join(by_merge(signs), "node")
    units = _blocked(wanted, "x").select("key", "x").join(by_merge(asked), "key").select("x", "y")
    ends = known.select("node", "root")
    second = verify(units, limit).join(by_merge(ends.select(F.col("node").alias("a"), F.col("root").alias("ra"))), "a").join(by_merge(ends.select(F.col("node").alias("b"), F.col("root").alias("rb"))), "b")
    between = second.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    more = components(between).select(F.col("node").alias("of"), F.col("root").alias("joined"))
    # groups of the first case, renamed where the second case joins them
    return ends.join(by_merge(more), F.col("root") == F.col("of"), "left").select("node", F.coalesce("joined", "root").alias("root"))


def by_fingerprint(fps: DataFrame) -> DataFrame:
    """nodes of distinct fingerprints (fp), which are their own ids and signatures."""
    return fps.select(F.col("fp").alias("node"), F.array("fp").alias("fps"), F.array("fp").alias("sign"))


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc, fp): fp holds the 64 bits as a signed integer."""
    ids = docs.select(F.col(doc).alias("doc"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], ["doc", "fp"])

    return ids.mapInArrow(run, T.StructType([T.StructField("doc", ids.schema["doc"].dataType), T.StructField("fp", T.LongType())]))


def simhash_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 4, bits: int = BITS) -> DataFrame:
    """(doc, fp, component): component is the smallest document id reachable over links."""
    prints = keep(fingerprints(docs, doc, text, width), "prints")
    firsts = keep(prints.groupBy("fp").agg(F.min("doc").alias("first")), "firsts")
    roots = link_components(by_fingerprint(firsts.select("fp")), bits)
    rooted = firsts.join(by_merge(roots), F.col("fp") == F.col("node")).select("fp", "first", "root")
    rooted = keep(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(by_merge(least), "root").select(F.col("fp").alias("of"), "component")
    return prints.join(by_merge(named), F.col("fp") == F.col("of")).select("doc", "fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
