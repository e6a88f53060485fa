"""The level array against a simulation that tries every place, and how sequences are closed."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from edgetide.llm import packing, wordbpe

from . import cases
from .test_text_operators import check_packing, inputs


def plain_levels(lengths, size):
    """Fill of each open window after every length, by trying all places and adding up all squares."""
    fills = []
    for n in lengths:
        n %= size
        if not n:
            continue
        counts = Counter(fills)
        new = Counter(counts)
        new[n] += 1
        options = [(sum(v * v for v in new.values()), 1, 0)]
        for f in counts:
            if f + n <= size:
                after = Counter(counts)
                after[f] -= 1
                if f + n < size:
                    after[f + n] += 1
                options.append((sum(v * v for v in after.values()), 0, -f))
        _, fresh, f = min(options)
        if fresh:
            fills.append(n)
        else:
            fills.remove(-f)
            if n - f < size:
                fills.append(n - f)
    return sorted(fills)


@pytest.mark.parametrize("size,seed", [(10, 1), (16, 2), (64, 3), (64, 4)])
def test_placement_is_the_simulation(size, seed):
    rnd = random.Random(seed)
    lengths = [rnd.randrange(1, size + size // 2) for _ in range(150)]
    p = packing.LevelPacker(size, max_open=10_000)
    for k, n in enumerate(lengths):
        p.add(k, b"\0\0\0\0" * n)
        assert sorted(f for f in range(size) for _ in p.windows[f]) == plain_levels(lengths[: k + 1], size)
    assert {how for how, _ in p.done} <= {"whole", "rule"}


@pytest.mark.parametrize("most", [1, 3, 50])
def test_open_windows_are_bounded(most):
    """All documents just over half a window: the rule can't join any two."""
    p = packing.LevelPacker(64, max_open=most)
    for k in range(500):
        p.add(k, (k).to_bytes(4, "little") * 33)
        assert p.open <= most == p.max_open and p.open == sum(map(len, p.windows))
    p.settle()
    assert p.open == 0 and sum(packing.tokens_of(w) for _, w in p.done) == 500 * 33
    sizes = Counter(packing.tokens_of(w) for _, w in p.done)
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes) and sum(v for n, v in sizes.items() if n < 64) <= 6


def test_split():
    window = [(1, 0, b"aaaabbbb", 2), (2, 5, b"ccccddddeeee", 9)]
    for n in range(6):
        a, b = packing.split(window, n)
        assert packing.tokens_of(a) == n and b"".join(p[2] for p in a + b) == b"aaaabbbbccccddddeeee"
        assert all(p[1] >= 5 for p in a + b if p[0] == 2)


def test_carried_pieces_of_many_partitions(spark, monkeypatch):
    """Few documents in each of many partitions, several groups: whole documents are placed by the rule in the second pass."""
    path = wordbpe.vocabulary_path()
    bpe = wordbpe.load(path)
    df = cases.docs(spark, cases.texts(400)).repartition(9)
    want = [(i, bpe.encode(t) + b"\1\0\0\0") for i, t in inputs(df)]
    for group in (packing.GROUP, 60):
        monkeypatch.setattr(packing, "GROUP", group)
        rows = packing.pack(df, path, size=256).collect()
        check_packing(rows, want, 256)
        by_rule = {r.sequence_id for r in rows if r.closed == "rule"}
        cut = {r.sequence_id for r in rows if r.closed == "cut"}
        assert by_rule and (group < 1000 or len(by_rule) > len(cut))
        assert len({r.sequence_id for r in rows}) == len({(r.sequence_id, r.closed) for r in rows})
