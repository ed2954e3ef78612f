"""Golay keys of both widths, and buckets that are cut into blocks."""

import random

import numpy as np
import pytest

from cairn.llm import simhash


@pytest.mark.parametrize("spare", [1, 2])
def test_keys_of_any_width_miss_no_pair_of_four_bits(spare):
    rng = random.Random(spare)
    for errors in range(5):
        for _ in range(200):
            u = v = rng.getrandbits(64)
            for b in rng.sample(range(64), errors):
                v ^= 1 << b
            one, two = (np.array([x], np.uint64).view(np.int64) for x in (u, v))
            exact = set(simhash.exact_keys(one, spare)[0].tolist()) & set(simhash.exact_keys(two, spare)[0].tolist())
            fuzzy = set(simhash.left_keys(one, spare)[0].tolist()) & set(simhash.right_keys(two, spare)[0].tolist())
            assert exact or fuzzy


@pytest.mark.parametrize("spare", [1, 2])
def test_keys_of_different_kinds_never_meet(spare):
    fps = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 50)
    for make, kinds in ((simhash.exact_keys, 15 if spare == 1 else 45), (simhash.left_keys, 9 if spare == 1 else 18)):
        keys, who = make(fps, spare)
        assert len(set((keys >> 40).tolist())) == kinds and keys.min() >= 0 and set(who.tolist()) == set(range(50))


@pytest.mark.parametrize("wider", [0, 1 << 27])
def test_blocks_and_widths_give_the_same_groups(spark, monkeypatch, wider):
    rng, found = random.Random(12), set()
    for _ in range(6):
        u = rng.getrandbits(64)
        for _ in range(60):
            v = u
            for b in rng.sample(range(64), rng.randint(0, 7)):
                v ^= 1 << b
            found.add(v)
    signed = {int(np.array([x], np.uint64).view(np.int64)[0]): x for x in found}
    parent = {s: s for s in signed}

    def root(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, x in signed.items():
        for b, y in signed.items():
            if a < b and (x ^ y).bit_count() <= 4:
                parent[root(b)] = root(a)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "WIDER", wider)
    got = {r.node: r.root for r in simhash.link_components(simhash.by_fingerprint(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    split = lambda of: sorted(sorted(m for m in of if of[m] == g) for g in set(of.values()))
    assert split(got) == split({s: root(s) for s in signed})
