"""Near-duplicates against brute force over all pairs of whole shingle sets, and what becomes of odd rows."""

import collections
import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from cairn.llm import near_dup


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def similar(x, y, least=0.8):
    """Jaccard similarity of at least `least`, in whole numbers."""
    inter = len(x & y)
    return 10 * inter >= round(10 * least) * (len(x) + len(y) - inter)


def brute_groups(texts):
    """Component number of each text, over all pairs that share a shingle (those that share none have similarity 0)."""
    sets = {t: shingles(t) for t in texts}
    kinds = collections.defaultdict(list)
    for t, s in sets.items():
        kinds[s].append(t)
    distinct = list(kinds)
    parent = list(range(len(distinct)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    holders = collections.defaultdict(list)
    for k, s in enumerate(distinct):
        for x in s:
            holders[x].append(k)
    for k, s in enumerate(distinct):
        met = collections.Counter(o for x in s for o in holders[x] if o < k)
        for o in met:
            if root(o) != root(k) and similar(s, distinct[o]):
                parent[root(k)] = root(o)
    # texts with equal shingles but other word sequences are similar, too
    return {t: root(k) for k, s in enumerate(distinct) for t in kinds[s]}


def split(groups):
    """A partition: sets of members."""
    out = collections.defaultdict(set)
    for member, group in groups.items():
        out[group].add(member)
    return sorted(map(sorted, out.values()))


def edited(rng, words, n, tag):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"{tag}x{i}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_a_large_group_around_the_threshold(spark, seed):
    """Copies of one text with any number of changed words: similarities run through the threshold, and chains form."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(1, 14), f"t{k}")) for k in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc: r.group for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_groups(texts)
    assert split(got) == split({k: want[t] for k, t in rows})


def test_pieces_of_work_give_the_same(spark, monkeypatch):
    """Buckets cut into small blocks, and units cut into pieces of few hashes."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(edited(rng, base, rng.randint(1, 12), f"t{k}"))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups([t for _, t in rows])
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "PIECE", 2000)
    got = {r.doc: r.group for r in near_dup.near_duplicates(df).collect()}
    assert split(got) == split({k: want[t] for k, t in rows})


def test_given_documents(spark):
    for sf in (DATA, "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        want = brute_groups({t or "" for t in texts.values()})
        got = {r.doc: r.group for r in near_dup.near_duplicates(docs).collect()}
        assert split(got) == split({k: want[t or ""] for k, t in texts.items()})
        kept = {r.doc_id for r in near_dup.keep_one(docs).collect()}
        assert kept == {min(g) for g in split(got)}


def test_joined_compares_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 30))
        pool = rng.integers(-(1 << 62), 1 << 62, 60)
        sets = [np.unique(rng.choice(pool, int(rng.integers(1, 50)))) for _ in range(n)]
        roots = rng.integers(0, n, n).astype(np.int64)
        label = {int(r): int(r) for r in roots}
        for i in range(n):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if inter >= 0.5 * (len(sets[i]) + len(sets[j]) - inter):
                    a, b = sorted((label[int(roots[i])], label[int(roots[j])]))
                    label = {k: a if v == b else v for k, v in label.items()}
        found = dict(near_dup.joined(np.arange(n), roots, sets, 0.5))
        assert {k: found.get(k, k) for k in label} == label


LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
ROWS = [(1, None, "a"), (2, "", "b"), (2, " \n\t", "c"), (3, "one two", "d"), (3, "one two", "d"), (3, "one two", "e"), (4, "ONE\ntwo", "f"), (5, LONG, "g"), (6, LONG + " end", "h"), (None, "no id", "i"), (None, "no  id", "j"), (None, "no id", "k"), (7, "x y z", "l"), (7, "p q r", "m"), (None, "x y z", "n")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, tag string")
    for c in ("key", "node", "root", "doc", "mark", "n", "none", "kept_id", "text_mark", "size", "unit"):
        df = df.withColumn(c, F.lit("own"))
    groups = collections.Counter((r.doc, r.group) for r in near_dup.near_duplicates(df).collect())
    assert groups == {(1, 1): 1, (2, 1): 2, (3, 3): 3, (4, 3): 1, (5, 5): 1, (6, 5): 1, (None, None): 3, (7, 7): 2, (None, 7): 1}
    out = near_dup.keep_one(df)
    assert out.columns == df.columns
    kept = sorted((r.doc_id is None, r.doc_id, (r.text or "").split()[:2]) for r in out.collect())
    assert kept == [(False, 1, []), (False, 3, ["one", "two"]), (False, 5, ["lorem", "ipsum"]), (False, 7, ["p", "q"]), (False, 7, ["x", "y"]), (True, None, ["no", "id"])]
    assert near_dup.keep_one(df.limit(0)).count() == near_dup.near_duplicates(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "one two three"), ("a", "one two three"), ("c", "other words")], "doc_id string, text string")
    assert {(r.doc, r.group) for r in near_dup.near_duplicates(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert {r.doc_id for r in near_dup.keep_one(df).collect()} == {"a", "c"}
