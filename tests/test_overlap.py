"""Overlap join against brute force, with a hot group, a hot item and repeated sets."""

import random
from collections import defaultdict

import pytest

from sentinela.operators import overlap

ITEMS, GROUPS = "member long, item string", "group string, member long"


def brute(items, groups, least):
    of, names = defaultdict(set), defaultdict(set)
    for m, i in items:
        if m is not None and i is not None:
            of[m].add(i)
    for g, m in groups:
        if g is not None and m is not None:
            names[g].add(m)
    best = {}
    for members in names.values():
        for a in members:
            for b in members:
                n = len(of[a] & of[b])
                if a != b and n >= least:
                    best[a] = max(best.get(a, 0), n)
    return best


def planted(seed):
    r = random.Random(seed)
    sets = {m: {f"L{r.randrange(40)}" for _ in range(r.randrange(9))} | ({"HOT"} if r.random() < 0.6 else set()) for m in range(150)}
    for m in range(0, 150, 7):  # copies
        sets[m] = sets[(m * 3) % 150]
    items = [(m, i) for m, s in sets.items() for i in s]
    groups = [("ANA" if m % 3 else f"N{m % 11}", m) for m in sets] + [(f"X{m % 5}", m) for m in range(0, 150, 4)]
    return items + items[:20] + [(None, "L1"), (3, None)], groups + groups[:9] + [(None, 4), ("ANA", None), ("ANA", 999)]


@pytest.mark.parametrize("seed,least,block", [(1, 3, 1000), (2, 3, 7), (3, 2, 10), (4, 5, 1000)])
def test_most_shared(spark, seed, least, block):
    items, groups = planted(seed)
    got = overlap.most_shared(spark.createDataFrame(items, ITEMS), spark.createDataFrame(groups, GROUPS), least, block).collect()
    want = brute(items, groups, least)
    assert want and {r.member: r.n for r in got} == want and len(got) == len(want)


def test_hot_group_makes_no_pairs(spark):
    """One name and two bids that all companies share, beside bids of their own: no pairs come of it."""
    n = 3000
    rows = [(m, i) for m in range(n) for i in ("HOT", "WARM", f"own{m}", f"near{m // 2}")]
    items, groups = spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("SILVA", m) for m in range(n)], GROUPS)
    keyed = groups.join(overlap.prefixes(items, 3), "member")
    assert keyed.count() == 2 * n and overlap.candidates(keyed).count() == n // 2
    assert {r.n for r in overlap.most_shared(items, groups, 3).collect()} == {3}
    same = spark.createDataFrame([(m, f"L{i}") for m in range(n) for i in range(3)], ITEMS)  # one class
    assert overlap.most_shared(same, groups, 3).filter("n = 3").count() == n


def test_small_groups_need_no_prefixes(spark, monkeypatch):
    """Groups of a few members are compared pair by pair; bids are not counted, ranked and joined with each other for them."""
    items, groups = planted(5)
    small = [(f"{g}-{(m or 0) // 9}", m) for g, m in groups if m is not None]
    monkeypatch.setattr(overlap, "prefixes", None)
    monkeypatch.setattr(overlap, "FEW", 9)
    got = overlap.most_shared(spark.createDataFrame(items, ITEMS), spark.createDataFrame(small, GROUPS), 3).collect()
    want = brute(items, small, 3)
    assert want and {r.member: r.n for r in got} == want and len(got) == len(want)


def test_empty(spark):
    items, groups = spark.createDataFrame([], ITEMS), spark.createDataFrame([], GROUPS)
    assert overlap.most_shared(items, groups, 3).count() == 0
