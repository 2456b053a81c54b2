"""Spelling variants against brute force over all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from sentinela.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=6, count=5, ratio=5, drop=199):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if drop and h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    letters = "abcdeéÉÿ×A"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    for w in list(words):  # chains of rarer and rarer variants
        for _ in range(3):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(w)
    often = [max(1, int(400 / 5.5 ** (i // 60))) if i >= 60 else 400 for i in range(len(words))]
    often = [400, *often[1:]]
    bag = [w for i, w in enumerate(words) for _ in range([400, 70, 12, 5][0 if i < 60 else 1 + (i - 60) % 3])]
    rng.shuffle(bag)
    out = [(i, rng.choice([" ", ", ", "1", "\n", "ā"]).join(bag[k : k + 50])) for i, k in enumerate(range(0, len(bag), 50))]
    long = "q" * 3000
    return [*out, (None, "letters letters letters letters letters"), (7, None), (8, ""), (9, " ".join([long] * 6 + [long + "r"] * 5)), out[0], (None, None)]


def test_variants(spark, rows):
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, word int").repartition(3)
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 50 and sum(w[2] != (w[1] or w[0]) for w in want) > 5
    assert rows_of(spelling.spelling_variants(docs, drop=199)) == want


def test_parameters_and_flushes(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.spelling_variants(docs, 4, 3, 2, 0)) == brute(rows, 4, 3, 2, 0)


def test_one_edit_flips_two_bits_at_most():
    rng = random.Random(1)
    alphabet = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    mask = lambda w: __import__("functools").reduce(lambda m, c: m ^ int(spelling.BIT[c]), w.encode("latin-1"), 0)
    for _ in range(2000):
        w = [rng.choice(alphabet) for _ in range(8)]
        v = list(w)
        at = rng.randrange(8)
        [v.__setitem__, lambda i, c: v.insert(i, c), lambda i, c: v.pop(i)][rng.randrange(3)](at, rng.choice(alphabet))
        a, b = mask("".join(w)), mask("".join(v))
        assert (a ^ b).bit_count() <= 2 and any(a & band == b & band for band in spelling.BANDS)


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
