"""Near-duplicates by word shingles: candidates from Golay keys and min-hash keys, links by exact Jaccard similarity.

Two texts link if their sets of `width`-word shingles (five) have a Jaccard similarity of `similarity` (0.8) or more. Rows of
one connected component are one group.

Candidates. A fingerprint (SimHash) of the distinct words gives the exact and the fuzzy keys of `simhash`; beside them
stand BANDS keys of ROWS min-hashes of the shingles, so that a pair of similarity 0.8 shares no key with
probability (1 - 0.8^ROWS)^BANDS, 7e-5, and a more similar one with less. Within a bucket, sketches of SKETCH bits pass
pairs whose estimate is not under `similarity` by more than SLACK (three standard errors); they only save work.

Links are decided on whole shingle sets, never on sketches, in two steps:
1. In pieces of buckets, each text's nearest and lowest partners by sketch are checked. That is two pairs a text at most,
   and it joins nearly all that belongs together.
2. Buckets that still hold texts of several groups are gone through pair of pieces by pair of pieces; texts with a partner by
   sketch in another group are brought together with their sets, and all of their pairs are compared there. A
   piece of such work has a bounded number of hashes; what comes out is which groups join, not pairs.
So a group of true copies costs as many checks as it has members, however large, and only texts that are alike but under
the threshold cost pair by pair work, which is done in blocks.

Sets are made anew from the texts when they are wanted: a bitmap of bounded size over the wanted texts' hashes lets a scan
hash these alone (and some more, which the join that follows drops).

Defined results: null text is empty; texts without words are one group; a text shorter than a shingle is one shingle; words
are compared with A-Z lowered and split at ASCII white space; ids may be of any type, null or repeated: rows are
told apart by id and text; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS, components, fresh, keep
from .simhash import BLOCK, SEED, _keyed, exact_keys, left_keys, right_keys, spare_parts

WIDTH, SIMILARITY = 5, 0.8
#: Keys from min-hashes, and min-hashes in each.
BANDS, ROWS = 24, 5
SKETCH_LOG = 9
SKETCH = 1 << SKETCH_LOG
#: Three standard errors of the similarity as a sketch of SKETCH bits estimates it.
SLACK = 0.08
#: Hashes of a piece of work in which all pairs are compared.
PIECE = 1 << 21
#: Bits of the bitmap of wanted texts: 32 MB at most.
WANTED_LOG = 28
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 17


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of hashes."""
    x = h ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words; those of frequent words are looked up."""

    def __init__(self) -> None:
        self.held: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        held = self.held
        if len(held) > REMEMBERED:
            held.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = held.get(w)
            if h is None:
                h = held[w] = xxhash.xxh64_intdigest(w, SEED)
            out[i] = h
        return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the sequences of `width` words (of all, if there are fewer), from the words' hashes."""
    n = max(1, len(words) - width + 1)
    h = np.full(n, min(width, len(words)), np.uint64)
    for k in range(min(width, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        h ^= h >> np.uint64(29)
    return np.unique(_mixed(h, 7))


def majority(hashes: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed number."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


@lru_cache(maxsize=1)
def _detours() -> np.ndarray:
    """For each bin, the bins that it borrows from when it is empty, in order."""
    return np.random.default_rng(SEED).permuted(np.tile(np.arange(SKETCH), (SKETCH, 1)), axis=1)


def sketch(hashes: np.ndarray) -> list[int]:
    """SKETCH bits of one-permutation min-hashing: each bin's least hash gives a bit; two sets' bits agree with probability (1 + J) / 2."""
    ordered = np.sort(hashes)
    own = (ordered >> np.uint64(64 - SKETCH_LOG)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    bins = own[first]
    held, full = np.zeros(SKETCH, np.uint64), np.zeros(SKETCH, bool)
    held[bins] = ordered[first]
    full[bins] = True
    if len(bins) and not full.all():
        empty = np.flatnonzero(~full)
        if len(bins) < SKETCH // 8:
            ways = _detours()[empty]
            held[empty] = held[ways[np.arange(len(empty)), full[ways].argmax(1)]]
        else:
            # the same step by step: most find a full bin after a few
            for step in range(SKETCH):
                way = _detours()[empty, step]
                good = full[way]
                held[empty[good]] = held[way[good]]
                empty = empty[~good]
                if not len(empty):
                    break
    # the bin takes part, so that the bits of a borrowed hash are bits of their own
    bits = (_mixed(held ^ (np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)), 9) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """BANDS keys, each of ROWS min-hashes of a set."""
    salts, odd = _multipliers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ salts) * odd).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for k, row in enumerate(least.reshape(BANDS, ROWS).T):
        keys = _mixed(keys ^ row, k + 1)
    return keys.view(np.int64).tolist()


def _sketched(ids: DataFrame, width: int) -> DataFrame:
    """ids (doc, mark, text) to (doc, mark, same, size, fps, sign, bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                same, sizes, prints, signs, bands = [], [], [], [], []
                for t in b.column(2):
                    words = (t.as_py() or b"").lower().split()
                    same.append(xxhash.xxh128_digest(b" ".join(words)))
                    own = known.hashes(words)
                    prints.append([majority(np.unique(own))])
                    hashes = shingles(own, width)
                    sizes.append(len(hashes))
                    signs.append(sketch(hashes))
                    bands.append(band_keys(hashes))
                longs = lambda x: pa.array(x, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()), longs(prints), longs(signs), longs(bands)], ["doc", "mark", "same", "size", "fps", "sign", "bands"])

    fields = [("same", T.BinaryType()), ("size", T.LongType()), *((n, T.ArrayType(T.LongType())) for n in ("fps", "sign", "bands"))]
    return ids.mapInArrow(run, T.StructType([ids.schema["doc"], ids.schema["mark"], *(T.StructField(n, t) for n, t in fields)]))


def _sets(ids: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, hashes) of the wanted nodes (node, doc, mark): their sets of shingles."""
    spot = F.col("mark").bitwiseAND(F.lit((1 << WANTED_LOG) - 1))
    bits = wanted.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((mark & {(1 << WANTED_LOG) - 1}L) & 63L as int))")).alias("bits")).orderBy("at").toArrow()
    sent = ids.sparkSession.sparkContext.broadcast((bits.column("at").to_numpy(), bits.column("bits").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (places, held) = Words(), sent.value
        for whole in batches:
            spots = whole.column(1).to_numpy() & ((1 << WANTED_LOG) - 1)
            at = np.minimum(np.searchsorted(places, spots >> 6), max(0, len(places) - 1))
            good = np.flatnonzero((places[at] == spots >> 6) & (held[at] >> (spots & 63) & 1 == 1)) if len(places) else np.zeros(0, np.int64)
            for begin in range(0, len(good), 256):
                own = pa.array(good[begin : begin + 256])
                found = [shingles(known.hashes((t.as_py() or b"").lower().split()), width) for t in whole.column(2).take(own)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([whole.column(0).take(own), whole.column(1).take(own), hashes], ["doc", "mark", "hashes"])

    made = ids.mapInArrow(run, T.StructType([ids.schema["doc"], ids.schema["mark"], T.StructField("hashes", T.ArrayType(T.LongType()))]))
    of = wanted.select("node", F.col("doc").alias("of"), F.col("mark").alias("is"))
    # rows that repeat an id and a text are one
    return keep(made.join(of, F.col("doc").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("is"))).select("node", "hashes").dropDuplicates(["node"]), "sets", TEXTS)


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough."""
    one, two = (sets.select(F.col("node").alias(n), F.col("hashes").alias(h)) for n, h in (("a", "ha"), ("b", "hb")))
    both = pairs.join(one, "a").join(two, "b").withColumn("inter", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("inter") >= F.lit(similarity) * (F.size("ha") + F.size("hb") - F.col("inter")) - 1e-9).select("a", "b")


def _limit(similarity: float) -> int:
    return int(SKETCH * (1 - similarity + SLACK) / 2)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of signatures (rows of words); x and y are broadcast against each other."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _members(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and starts of the lists of struct<node, sign, root>, and all nodes, signatures and roots."""
    # flatten() follows the slice of the batch; lengths follow from the lists themselves
    node, sign, root = column.flatten().flatten()
    size = np.asarray(pc.list_value_length(column)).astype(np.int64)
    node, root = (np.ascontiguousarray(x.to_numpy(zero_copy_only=False)) for x in (node, root))
    words = np.ascontiguousarray(sign.flatten().to_numpy(zero_copy_only=False)).view(np.uint64).reshape(len(node), SKETCH // 64)
    return size, np.concatenate([[0], np.cumsum(size)]), node, words, root


def _nearest(units: DataFrame, limit: int) -> DataFrame:
    """units (x: members) to pairs (a, b), a < b: each member with its nearest and its lowest partner by sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, start, node, sign, _ = _members(batch.column(0))
            two = start[:-1][size == 2]
            near = _differ(sign[two], sign[two + 1]) <= limit if len(two) else np.zeros(0, bool)
            a, b = [node[two[near]]], [node[two[near] + 1]]
            for k in np.flatnonzero(size > 2).tolist():
                order = np.argsort(node[start[k] : start[k + 1]])
                own, s = node[start[k] : start[k + 1]][order], sign[start[k] : start[k + 1]][order]
                for i in range(len(own)):
                    far = _differ(s[i], s)
                    far[i] = limit + 1
                    best = int(far.argmin())
                    if far[best] <= limit:
                        # the first within the limit has the lowest number
                        a.append(np.array([own[i], own[i]]))
                        b.append(np.array([own[best], own[int((far <= limit).argmax())]]))
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return units.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _crossing(units: DataFrame, limit: int) -> DataFrame:
    """units (unit, x, y) to (unit, node): the members with a partner by sketch, on the other side, of another root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column(0).to_numpy()
            (nx, ox, fx, sx, rx), (ny, oy, fy, sy, ry) = _members(batch.column(1)), _members(batch.column(2))
            single = np.flatnonzero((nx == 1) & (ny == 1))
            p, q = ox[single], oy[single]
            good = (rx[p] != ry[q]) & (_differ(sx[p], sy[q]) <= limit) if len(single) else np.zeros(0, bool)
            of, nodes = [unit[single[good]]] * 2, [fx[p[good]], fy[q[good]]]
            for k in np.flatnonzero(nx * ny > 1).tolist():
                x, y = slice(ox[k], ox[k + 1]), slice(oy[k], oy[k + 1])
                # row by row, so that what is held at once doesn't grow with the block's square times the signature
                near = np.stack([(_differ(s, sy[y]) <= limit) & (ry[y] != r) for s, r in zip(sx[x], rx[x], strict=True)])
                own = np.unique(np.concatenate([fx[x][near.any(1)], fy[y][near.any(0)]]))
                of.append(np.full(len(own), unit[k]))
                nodes.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of)), pa.array(np.concatenate(nodes))], ["unit", "node"])

    return units.mapInArrow(run, "unit long, node long").distinct()


def joined(node: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Which roots join, as pairs: all pairs of nodes with different roots are compared on their sets."""
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    size = np.array([len(s) for s in sets])
    # hashes that only one set has add nothing to any intersection
    shared = times > 1
    number, who = (np.cumsum(shared) - 1)[number][shared[number]], who[shared[number]]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(number, kind="stable")
    number, who = number[order], who[order]
    step = 4096
    for at in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(number, [at, at + step])
        has = np.zeros((len(sets), step), np.float32)
        has[who[a:b], number[a:b] - at] = 1
        inter += has @ has.T
    near = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-9
    near &= root[:, None] != root[None, :]
    # nodes of one root belong together whatever their own similarity is
    roots, of = np.unique(root, return_inverse=True)
    label = np.arange(len(roots))
    i, j = np.nonzero(near)
    i, j = of[i], of[j]
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(roots[k]), int(roots[v])) for k, v in enumerate(label.tolist()) if k != v]


def _regrouped(needed: DataFrame, known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """needed (unit, node) to (a, b): roots that join. All pairs of a unit are compared, in pieces of some PIECE hashes."""
    rows = keep(needed.join(known.select("node", "root", "size"), "node"), "needed")
    units = rows.groupBy("unit").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"), F.min("node").alias("a"), F.max("node").alias("b"))
    # many keys bring the same texts together: one unit of each kind is enough
    units = units.groupBy("n", "sign", "a", "b").agg(F.min(F.struct("unit", "total")).alias("u")).select("n", "a", "b", "u.unit", "u.total")
    units = keep(units, "units")
    ends = known.select("node", "root")
    pairs = _linked(units.where("n = 2").select("a", "b").distinct(), sets, similarity)
    pairs = pairs.join(ends.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(ends.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    more = units.where("n > 2").withColumn("parts", F.ceil(F.col("total") / PIECE)).select("unit", "parts")
    rows = rows.join(more, "unit").withColumn("part", F.pmod(F.xxhash64("node", "unit"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = rows.select("unit", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "node", "root").join(sets, "node")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        hashes = [np.ascontiguousarray(x.values.to_numpy()) for x in group.column("hashes")]
        found = joined(group.column("node").to_numpy(), group.column("root").to_numpy(), hashes, similarity)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return pairs.unionByName(rows.groupBy("unit", "low", "high").applyInArrow(compare, "a long, b long"))


def _blocked(keyed: DataFrame, name: str) -> DataFrame:
    """(key, block, members) with some BLOCK members each on the mean; keyed has key, node, sign, root and blocks."""
    block = F.when(F.col("blocks") == 1, F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    return keyed.withColumn("block", block).groupBy("key", "block").agg(F.collect_list(F.struct("node", "sign", "root")).alias(name))


def _rooted(nodes: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """nodes (node, root, ...) with the roots that components of links between roots give."""
    roots = components(links).select(F.col("node").alias("of"), F.col("root").alias("to"))
    return keep(nodes.join(roots, F.col("root") == F.col("of"), "left").withColumn("root", F.coalesce("to", "root")).drop("of", "to"), tag)


def row_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, mark, root) of every row: mark is a hash of the text, and rows of one group have one root."""
    ids = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).cast("binary").alias("text"))
    limit = _limit(similarity)
    made = keep(_sketched(ids, width).withColumn("row", F.monotonically_increasing_id()), "sketches", TEXTS)
    # equal word sequences are one node from the start, so a group of exact copies is one row in what follows
    firsts = keep(made.groupBy("same").agg(F.min("row").alias("node")), "firsts")
    nodes = keep(made.join(firsts.select("node"), F.col("row") == F.col("node")).select("node", "doc", "mark", "size", "fps", "sign", "bands", F.col("node").alias("root")), "nodes")
    spare = spare_parts(nodes.count())
    keys = _keyed(nodes, exact_keys, spare=spare).unionByName(nodes.select(F.explode("bands").alias("key"), "node"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    held = keep(keys.join(counts, "key"), "held")

    # step 1: the nearest and the lowest partner of each node, in pieces of its buckets
    signs = nodes.select("node", "sign", "root")
    pairs = _nearest(_blocked(held.join(signs, "node"), "x").select("x"), limit)
    sizes = nodes.select("node", "size")
    pairs = pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("nb")), "b")
    # sets of too different sizes can't be similar
    pairs = keep(pairs.where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - 1e-9).select("a", "b"), "pairs", TEXTS)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(ids, nodes.join(ends, "node").select("node", "doc", "mark"), width)
    known = _rooted(nodes.drop("bands"), _linked(pairs, sets, similarity), "roots")

    # step 2: buckets that still hold several groups, first those of equal keys, then those of home and probe
    signs = known.select("node", "sign", "root")
    mixed = held.join(known.select("node", "root"), "node").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    parts = _blocked(held.join(mixed, "key").join(signs, "node"), "members")
    units = parts.select("key", "block", F.col("members").alias("x")).join(parts.select("key", F.col("block").alias("other"), F.col("members").alias("y")), "key").where("block <= other")
    needed = _crossing(units.select(F.xxhash64("key", "block", "other").alias("unit"), "x", "y"), limit)
    homes = _keyed(known, right_keys, "root", spare)
    buckets = homes.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n")
    # a probe whose bucket holds its own group only cannot add a link between groups
    probes = _keyed(known, left_keys, "root", spare).alias("p").join(buckets.alias("h"), (F.col("p.key") == F.col("h.key")) & ~((F.col("h.low") == F.col("h.high")) & (F.col("h.low") == F.col("p.root")))).select("p.key", "node", "blocks")
    probes = keep(probes, "probes")
    asked = _blocked(probes.join(signs, "node"), "y").select("key", F.col("block").alias("other"), "y")
    wanted = homes.select("key", "node").join(probes.select("key", "blocks").distinct(), "key").join(signs, "node")
    units = _blocked(wanted, "x").join(asked, "key").select(F.xxhash64("key", "block", "other", F.lit("probe")).alias("unit"), "x", "y")
    needed = keep(needed.unionByName(_crossing(units, limit)), "crossing", TEXTS)
    sets = _sets(ids, known.join(needed.select("node").distinct(), "node").select("node", "doc", "mark"), width)
    known = _rooted(known.select("node", "root", "size"), _regrouped(needed, known, sets, similarity), "groups")

    classes = firsts.join(known.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of")).select(F.col("same").alias("class"), "root")
    return made.select("doc", "mark", "same").join(classes, F.col("same") == F.col("class")).select("doc", "mark", "root")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, group) of every row: group is the smallest id of its group; null where no row of the group has one."""
    rows = keep(row_groups(docs, doc, text, width, similarity), "rowgroups")
    named = rows.groupBy("root").agg(F.min("doc").alias("group")).withColumnRenamed("root", "of")
    return rows.join(named, F.col("root") == F.col("of")).select("doc", "group")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group, with all its columns: the one with the smallest id; a row without an id only where none has one.

    Of rows that are equal in id and text, any one. Of rows with equal ids and different texts of one group, the one whose
    text has the lower hash; of different groups, each group's.
    """
    rows = row_groups(docs, doc, text, width, similarity)
    each = rows.groupBy("doc", "mark").agg(F.count("*").alias("n"), F.min("root").alias("root"))
    first = each.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "mark", "n")).alias("k"))
    is_, of, mark = fresh(docs, "kept_id"), fresh(docs, "kept_mark"), fresh(docs, "text_mark")
    kept = keep(first.select(F.col("k.doc").alias(is_), F.col("k.mark").alias(of), F.col("k.n").alias("n")), "keptrows")
    marked = docs.withColumn(mark, F.xxhash64(F.col(text)))

    def rows_of(kept: DataFrame) -> DataFrame:
        # ids only on the build side: texts stream past it
        return marked.join(kept.drop("n").hint("shuffle_hash"), F.col(doc).eqNullSafe(F.col(is_)) & (F.col(mark) == F.col(of)), "left_semi")

    out = rows_of(kept.where("n = 1"))
    repeated = kept.where("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(rows_of(repeated).dropDuplicates([doc, mark]))
    return out.drop(mark)
