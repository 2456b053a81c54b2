"""The similarity join against brute force: components, every link, and the promise of the signatures by itself."""

import collections
import itertools
import re

import numpy as np
import pytest

from sentinela.llm import jaccard, near
from sentinela.llm import kernels as K


def shingle_set(text: str, width: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def linked(a, b, threshold=80) -> bool:
    return bool(a and b) and 100 * len(a & b) >= threshold * len(a | b)


def brute(rows, width=5, threshold=80):
    """doc_id, size of the set, least reachable id, and the links between different sets."""
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for i, j in itertools.combinations(range(len(rows)), 2):
        if linked(sets[i], sets[j], threshold):
            root[find(i)] = find(j)
            if sets[i] != sets[j]:
                links.add(frozenset((sets[i], sets[j])))
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    name = lambda i: min((k for k in least[find(i)] if k is not None), default=None)
    return sorted([(k, len(s), name(i)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))], key=str), links


@pytest.fixture(scope="module")
def rows():
    rng = np.random.RandomState(9)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(80):  # near copies, mostly about the threshold
        words = list(base)
        for at in rng.choice(90, rng.randint(1, 6), replace=False):
            words[at] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:50] + [f"y{k}_{i}" for i in range(rng.randint(1, 60))]) for k in range(60)]  # a shared passage
    for size in (*range(1, 16), 40, 400, 3000):  # sets of every small size, with one word added, changed or gone
        words = [f"z{size}_{i}" for i in range(size)]
        texts += [" ".join(words), " ".join([*words, "more"]), " ".join(words[:-1]), " ".join([*words[:-1], "other"]), " ".join(words[: max(1, size * 9 // 10)])]
    texts += ["", None, " \t\n", texts[0], texts[0].upper(), "one", "one", "é ü one two three four five"]
    return [(100 + i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "nobody else has this text at all here"), (100, texts[0])]


@pytest.mark.parametrize(("local", "block", "small"), [(3, 400, 48), (3, 5, 3), (10**6, 5, 0)])
def test_components(spark, rows, local, block, small, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL", local)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PAIRS", 100)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET", 2_000)
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, key int, node int").repartition(3)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs).collect()], key=str)
    assert got == brute(rows)[0]


def test_every_link(spark, rows):
    rows = [(k, t) for k, t in rows if k is not None]
    links, member = jaccard.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    texts, of = dict(rows), {}
    for r in member.collect():
        of[r.node] = shingle_set(texts[r.doc_id])
    assert {frozenset((of[r.a], of[r.b])) for r in links.collect()} == brute(rows)[1]


def test_other_thresholds(spark, rows):
    some = rows[60:150]
    for width, threshold in ((2, 60), (3, 93)):
        got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(spark.createDataFrame(some, "doc_id long, text string"), width, threshold).collect()], key=str)
        assert got == brute(some, width, threshold)[0]


@pytest.mark.parametrize("size", [4, 5, 7, 9, 13, 20, 33, 80, 500])
def test_linked_sets_share_a_signature(size):
    rng = np.random.RandomState(size)
    for _ in range(300 if size < 100 else 40):
        common = rng.randint(1, 2**62, size, dtype=np.int64)
        extra = max(0, int(len(common) / 0.8 + 1e-9) - size)
        k = rng.randint(0, extra + 1)
        a, b = np.concatenate([common, rng.randint(1, 2**62, k)]), np.concatenate([common, rng.randint(1, 2**62, extra - k)])
        if extra == 0:
            continue
        g = np.concatenate([np.unique(a), np.unique(b)]).astype(np.uint64)
        doc = np.repeat([0, 1], [len(np.unique(a)), len(np.unique(b))])
        sig, of = jaccard.signatures(doc, K.mix(g), 2, 80)
        assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist())


def test_bounds_never_exceed_the_difference():
    rng = np.random.RandomState(1)
    a, b = rng.randint(0, 2**62, 5000).astype(np.uint64), rng.randint(0, 2**62, 300).astype(np.uint64)
    one, two = np.unique(K.mix(a)), np.unique(K.mix(np.concatenate([a[:4500], b])))
    s = [jaccard.sketches(np.zeros(len(x), np.int64), x, 1)[0].astype(int) for x in (one, two)]
    assert np.abs(s[0] - s[1]).sum() <= len(np.setxor1d(one, two))


def test_pairs_of_many_common_signatures_are_emitted_once(spark, monkeypatch):
    """60 sets that are alike but not linked share 300 signatures each; others share one."""
    monkeypatch.setattr(jaccard, "BLOCK", 25)
    monkeypatch.setattr(jaccard, "TASK_ROWS", 500)
    rng = np.random.RandomState(3)
    mixed = [(s * 7919 - 10**6, m) for s in range(400) for m in range(60) if rng.rand() < 0.75] + [(10**9 + m // 2, m) for m in range(100, 140)]
    k = {}
    for s, _ in mixed:
        k[s] = k.get(s, 0) + 1
    mixed = spark.createDataFrame([(s, m, m, k[s]) for s, m in mixed], "sig long, node long, label long, k long")
    classes = spark.createDataFrame([(m, 100, bytearray(jaccard.SLOTS)) for m in (*range(60), *range(100, 140))], "node long, n long, sketch binary")
    got = [(r.a, r.b) for r in jaccard.emitted(mixed, classes, 80).collect()]
    assert set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60)} | {(m, m + 1) for m in range(100, 140, 2)}
    assert len(got) < 2 * len(set(got))


def test_empty_table(spark):
    assert jaccard.similar_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert near.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_texts_are_shuffled_once_and_signatures_are_short(spark, rows, monkeypatch):
    """Of 64 bits a quarter is not sent; the texts of classes are not dealt anew by class after they were by row."""
    plans, write = {}, jaccard.Join.write

    def kept(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString() if name == "texts" else None
        out = write(self, df, name)
        if name == "bins":
            plans["most"] = out.selectExpr("max(sig)", "min(sig)").first()
        return out

    monkeypatch.setattr(jaccard.Join, "write", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    jaccard.Join(docs, 5, 80)
    assert 0 <= plans["most"][1] <= plans["most"][0] < 1 << 48
    assert re.search(r"Aggregate \[row_key#\d+\]", plans["texts"])
