"""The divergence audit against brute force, and its radix selection by itself."""

import collections
import random
import re

import pytest

from sentinela.llm import common, divergence


def brute(rows, least=10, most=10):
    docs = [(lang or "", source or "", text or "") for lang, source, text in rows]
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = [(lang, source, [low(w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]) for lang, source, t in docs]
    df, count = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, source, ws in words:
        df.update((lang, w) for w in set(ws))
        count[lang, source].update(ws)
    kept = collections.defaultdict(list)
    for (lang, w), n in df.items():
        if n >= least:
            kept[lang].append(w)
    of_lang = collections.defaultdict(collections.Counter)
    for (lang, _), c in count.items():
        of_lang[lang].update(c)

    def weights(c, lang):
        v = len(kept[lang])
        total = sum(c[w] for w in kept[lang]) + 2 * v
        return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept[lang]}

    p = {g: weights(c, g[0]) for g, c in count.items()}
    q = {lang: weights(c, lang) for lang, c in of_lang.items()}
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, source in p:
        pairs = [(t, sum(f(p[lang, source][w], p[lang, t][w]) for w in kept[lang])) for o, t in p if o == lang and t != source]
        terms = [(w, f(x, q[lang][w])) for w, x in p[lang, source].items() if count[lang, source][w] and x > q[lang][w]]
        for part, items in (("pair", pairs), ("term", terms)):
            for r, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                if part == "pair" or r <= most:
                    out.append((lang, source, part, item, value, r))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["The", "the", "Straße", "été", "日本", "x", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)), *(f"prefix{'y' * 40}{c}" for c in "abcdefghijkl")]
    out = []
    for i in range(160):
        source = rng.choice(["s0", "s0", "s0", "s1", "s2", None])
        some = words[:40] if source == "s1" else words
        out.append((["aa", "bb", None][i % 3], source, rng.choice([" ", "9", "\n"]).join(rng.choice(some) for _ in range(rng.randint(0, 60)))))
    out += [("aa", "tie", " ".join(words[-12:])), ("aa", "bare", None), ("aa", "bare", "12 34 !"), ("cc", "s0", "few words"), ("cc", "s1", "few"), ("dd", "alone", ""), out[0], out[0], ("aa", "s2", "long " * 30_000)]
    return out


def test_audit(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, p int").repartition(3)
    assert rows_of(divergence.audit(docs)) == brute(rows)


def test_parameters_and_flushes(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2)
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert rows_of(divergence.audit(docs, 3, 4)) == brute(rows, 3, 4)


def test_radix_selection(spark):
    rng = random.Random(5)
    rows = [("l", f"g{g}", "".join(rng.choice("abé") for _ in range(rng.randint(0, 3))) + f"{'z' * (i % 2 * 9)}{i}", rng.choice([0, 1, 2047, 2048, 2**22, 2**33 - 1, rng.randint(0, 2**33 - 1)])) for g in range(5) for i in range([3, 4, 40, 200, 200][g])]
    rows = [(*r[:3], 7) if r[1] == "g4" else r for r in rows]
    tables = common.Tables()
    got = sorted(tuple(r) for r in divergence.largest_items(spark.createDataFrame(rows, "lang string, source string, item string, value long"), 4, tables).collect())
    want = []
    for g in {r[1] for r in rows}:
        best = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2].encode()))[:4]
        want += [(*r, i) for i, r in enumerate(best, 1)]
    assert got == sorted(want)
    tables.drop()


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
