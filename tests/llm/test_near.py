"""Links that sampling or a large bin once hid: registers that mislead the estimate, one band in common in a large bin."""

import collections

import numpy as np

from sentinela.llm import kernels as K
from sentinela.llm import near


def test_a_link_with_a_misleading_estimate_is_left_open():
    """Of 287 shingles 230 are common, but they share one bucket of 512."""
    rng = np.random.RandomState(2)
    tail = lambda n: rng.randint(1, 2**54, n, dtype=np.int64).astype(np.uint64)
    same, own = tail(230), (np.arange(1, 58, dtype=np.uint64) << np.uint64(55)) | tail(57)
    sets = [np.sort(np.concatenate([same, own[:28]])), np.sort(np.concatenate([same, own[28:]]))]
    assert 100 * len(np.intersect1d(*sets)) >= 80 * len(np.union1d(*sets))
    n = np.array([len(x) for x in sets])
    regs, _ = near.sketches(np.repeat([0, 1], n), np.concatenate(sets), 2)
    assert near.leaves_open(regs[:1], regs[1:], n[:1], n[1:], 0.8).all()
    far = np.sort(K.mix(np.arange(1, n[0] + 1, dtype=np.uint64)))
    other, _ = near.sketches(np.zeros(len(far), np.int64), far, 1)
    assert not near.leaves_open(regs[:1], other, n[:1], n[:1], 0.8).any()


def test_large_bins_lose_no_link(spark, monkeypatch):
    """All texts share one band and no other: what is linked in that bin is found, whatever its size."""
    whole = near.sketches

    def one_band(d, g, n):
        regs, bins = whole(d, g, n)
        own = np.bincount(d, (g >> np.uint64(20)).astype(np.float64), n).view(np.uint64)
        bins = K.mix(own[:, None] + near.SALT)
        bins[:, 3] = 12345
        return regs, bins

    monkeypatch.setattr(near, "sketches", one_band)
    rng, texts = np.random.RandomState(5), []
    for i in range(30):
        words = [f"w{i}.{j}" if j % 2 else f"w{j}" for j in range(120)]
        for k in range(3):
            texts.append(" ".join(words[:60] + [f"x{rng.randint(99)}"] * (k > 0) + words[60:][: 60 - 2 * k]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert max(collections.Counter(root).values()) == 3
    for large in (8, near.LARGE):
        assert {r.doc_id: r.component_id for r in near.near_duplicates(docs, large=large).collect()} == dict(enumerate(root))
