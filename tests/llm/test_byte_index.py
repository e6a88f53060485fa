"""The byte-position index: no linked pair is lost by its lists, its tally or its finer lists."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.llm import simhash

from . import cases
from .test_corpus_operators import plain_components

FULL = (1 << 64) - 1


def pairs(n=3000, seed=5):
    """Fingerprints and what up to three flipped bits make of them."""
    rnd = random.Random(seed)
    for _ in range(n):
        a = rnd.getrandbits(64)
        yield a, a ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4)))


def test_any_five_places_hold_a_listed_set():
    sets = [{p for p in range(8) if m >> 8 * p & 1} for m in simhash.masks()]
    assert len(sets) == 14 and all(len(s) == 4 for s in sets)
    assert all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))


def test_filter_loses_no_linked_pair():
    for a, b in pairs():
        meet = [m for m in simhash.masks() if a & m == b & m]
        assert meet and simhash.equal_bytes(np.array([a ^ b], dtype=np.uint64))[0] >= 5
        assert simhash.linked(np.array([a ^ b], dtype=np.uint64), 3)[0]
        for m in meet:
            assert any(a & f == b & f for f in simhash.finer(m))
    assert all(bin(f).count("1") == 46 and f & m == m for m in simhash.masks() for f in simhash.finer(m))


def test_tally_alone_drops_pairs():
    """Pairs of a list that share four bytes only never reach the bits."""
    x = np.array([0x0101010100000000, 0x0101010000000000, 0x0700000000000000, 0x0F00000000000000], dtype=np.uint64)
    assert simhash.equal_bytes(x).tolist() == [4, 5, 7, 7]
    assert simhash.linked(x, 3).tolist() == [False, True, True, False]


@pytest.mark.parametrize("crowd", [2, 10, 20_000])
def test_links_of_crowded_lists(spark, crowd):
    """Thousands of fingerprints that share four bytes or more, in chains and apart."""
    rnd = random.Random(7)
    prints = {rnd.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        base = rnd.getrandbits(64) & 0xFFFFFFFF00000000
        for _ in range(60):
            p = base | rnd.getrandbits(32)
            for _ in range(4):
                prints.add(p)
                p ^= sum(1 << b for b in rnd.sample(range(32), rnd.randrange(1, 4)))
    prints = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for _, p in prints], "fp long")
    made = simhash.links(df, crowd=crowd).collect()
    near = {frozenset((a, b)) for (_, a), (_, b) in combinations(prints, 2) if (a ^ b).bit_count() <= 3}
    parent = {p: p for _, p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in made:
        parent[root(r.u & FULL)] = root(r.v & FULL)
    want = plain_components(prints)
    ids = {p: i for i, p in prints}
    least = {}
    for i, p in prints:
        least.setdefault(root(p), i)
    assert [least[root(p)] for _, p in prints] == want and near
    assert all(want[ids[r.u & FULL]] == want[ids[r.v & FULL]] for r in made)


def test_session_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "777")
        simhash.digest(cases.docs(spark)).count()
        assert spark.conf.get(key) == "777"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_keep_one_takes_maps_and_variants(spark):
    df = cases.docs(spark).select("*", F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.expr("parse_json('{\"a\": 1}')").alias("v"), F.lit("other").alias("Text"))
    plain = cases.docs(spark)
    assert simhash.keep_one(df).count() == simhash.keep_one(plain).count()
