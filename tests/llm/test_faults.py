"""Cases that once went wrong, or that a small table does not show: clashing columns, neighbours in a batch, workers
without the package, formats with too few values, bins that are too large for one task."""

import collections
import pickle
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

import corpus_pipeline
from sentinela.llm import chat, common, fingerprints, kernels, language, mixing, near, pii, ppm, quality, repeats


def test_a_phrase_across_two_documents_is_none():
    one, two = " ".join("abcdefghi") + "\nplease click", " here it is. " + " ".join("jklmnopqr") + "\nclick here"
    data = np.frombuffer((one + two).encode(), np.uint8)
    together = quality.measure(data, np.array([0, len(one), len(one) + len(two)]))
    alone = [quality.measure(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in (one, two)]
    for name in quality.COUNTS:
        assert together[name].tolist() == [int(a[name][0]) for a in alone]
    assert together["n_failed_lines"].tolist() == [1, 1]  # the short line, and the phrase that is one


def test_columns_of_the_same_names(spark):
    docs = spark.createDataFrame([(1, "Dr. Johnson wrote to a@b.com", "en", "s0", 28, 1, 2, 3, 4, 5, 6)], "doc_id long, text string, lang string, source string, n_chars long, _found int, _names int, _row int, _row_key int, lang_pred int, _ident int")
    model = language.fit([language.counts_of(np.frombuffer(t, np.uint8)) for t in (b"abc", b"xyz") * 5], ["en", "de"] * 5)
    assert language.predict(docs, model).columns == [*[c for c in docs.columns if c != "lang_pred"], "lang_pred", "lang_score", "lang_rejected"]
    assert language.predict(docs, model).first()["lang_pred"] in ("en", "de")
    out = pii.pseudonymise(docs, "k").first()
    assert (out._found, out._names, out._ident, out._n_entities) == (1, 2, 6, 2) and "Johnson" not in out.text
    mixed = mixing.mixed_texts(docs).first()
    assert (mixed._row, mixed.text) == (3, docs.first().text)
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").first() == docs.first()


def test_kinds_come_from_what_stands_before(spark):
    texts = ["password = Hunterabcd now", "Mr. Hunterabcd came", "token: Miller2345 and Mr. Miller"]
    got = [r.text for r in sorted(pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect(), key=lambda r: r.doc_id)]
    secret = got[0].removeprefix("password = ").removesuffix(" now")
    assert len(secret) == 10 and secret[0].isupper() and secret not in got[1] and "Hunterabcd" not in got[0] + got[1]
    assert "Miller" not in got[2]


def test_more_entities_than_a_format_has(spark):
    rows = [(i, f"{chr(97 + i % 26)}@{chr(97 + i // 26)}.io") for i in range(676)]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    assert len(set(out)) == 676 and not {t for _, t in rows} & set(out)


def test_later_mentions_and_introduced_names(spark):
    texts = ["Mr. Johnson came. Johnson said so", "my name is Priya Sharma; Sharma left", "John Smith called"]
    got = [r.text for r in sorted(pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect(), key=lambda r: r.doc_id)]
    assert not any(n in " ".join(got) for n in ("Johnson", "Priya", "Sharma", "John", "Smith"))


def test_paragraphs_are_added_and_taken_away():
    of = lambda *parts: fingerprints.fingerprints(np.frombuffer("".join(parts).encode(), np.uint8), np.array([0, len("".join(parts))]))[0]
    a, b, c = "one line\n", "another line\n", "a third\n"
    assert (of(a, b, c) == of(c, a, b)).all()
    assert (fingerprints.combine(of(a, c), of(b)) == of(a, b, c)).all()
    assert (fingerprints.combine(of(a, b, c), of(b), -1) == of(a, c)).all()
    assert (fingerprints.combine(of(a, b), of(a), -1) != of(a)).any()


def test_large_bins_are_dealt_anew(spark):
    rng = np.random.RandomState(3)
    base, texts = [f"w{i}" for i in range(150)], []
    for _ in range(60):
        words = list(base)
        for at in rng.choice(150, rng.randint(1, 6), replace=False):
            words[at] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.component_id for r in near.near_duplicates(docs).collect()}
    assert plain == {r.doc_id: r.component_id for r in near.near_duplicates(docs, large=6).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    assert all(plain[i] == plain[j] for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))


def test_estimates_are_near_the_similarity():
    rng = np.random.RandomState(1)
    for size in (6, 60, 600, 20_000):
        for share in (0.5, 0.8, 0.95):
            x = rng.randint(0, 2**63, 2 * size, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            both = round(2 * size * share / (1 + share))
            sets = [np.unique(x[:size]), np.unique(np.concatenate([x[:both], x[size : 2 * size - both]]))]
            d, g = np.repeat([0, 1], [len(s) for s in sets]), np.concatenate(sets)
            regs, _ = near.sketches(d, g, 2)
            n = np.array([len(sets[0])]), np.array([len(sets[1])])
            j, some = near.estimate(regs[:1], regs[1:], *n)
            true = both / (2 * size - both)
            assert abs(j[0] - true) <= 5 * np.sqrt(0.25 / some[0]) * max(0.15, np.sqrt(1 - some[0] / max(some[0], 2 * size - both)))


def test_workers_need_not_have_the_package(tmp_path):
    """What is shipped and broadcast loads in a process that cannot import the package."""
    data, offs = np.frombuffer(b"one two three four five", np.uint8), np.array([0, 23])
    model = language.fit([language.counts_of(data[:3]), language.counts_of(data[4:7])] * 5, ["aa", "bb"] * 5)
    trie = ppm.Trie([(np.array([97], np.uint64), np.array([2]))])
    shipped = pickle.dumps((tuple(model), trie.arrays()))
    assert b"sentinela" not in shipped
    shingles, logits, of = near.shingles, language.logits, ppm.Trie.of
    (tmp_path / "f").write_bytes(cloudpickle.dumps((lambda m, t: (shingles(data, offs, 4)[0].tolist(), logits(m[1], m[2], data, offs).shape, of(t).log10(np.array([97], np.uint64)).shape), shipped)))
    code = f"import pickle, sys; f, b = pickle.load(open({str(tmp_path / 'f')!r}, 'rb')); assert 'sentinela' not in sys.modules; print(f(*pickle.loads(b)))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert done.returncode == 0 and done.stdout.strip() == "([0, 0], (1, 2), (1,))", done.stderr


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from sentinela import durable

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError):
        durable.shared_dir(Session())


def test_mixing_deals_all_slots(spark):
    wanted = spark.createDataFrame([("a", 1000, 2000.0), ("b", 5000, 3000.0), (None, 64, 100.0)], "source string, source_size long, target double")
    drawn = mixing.slots(wanted, 7, block=8, shard_slots=64).collect()
    per = collections.Counter(r._key for r in drawn)
    assert per == {"a": 250, "b": 375, "\x00null": 13}  # 12.5 slots of 8 blocks
    assert all(v == 1 for v in collections.Counter((r._key, r["pass"], r.block) for r in drawn).values())
    by_shard = collections.Counter((r.shard, r._key) for r in drawn)
    assert len({v for (_, key), v in by_shard.items() if key == "a"}) > 1


def test_pieces_of_a_batch_do_not_matter(spark, monkeypatch):
    """Texts longer than a piece, and pieces of one text each, give what large pieces give."""
    rng = np.random.RandomState(4)
    shared = " ".join(f"p{i}" for i in range(90))
    rows = [(i, " ".join([*(f"w{x}" for x in rng.randint(0, 50, 20 + 60 * i)), shared, "click here\n", *(f"v{x}" for x in rng.randint(0, 50, 30))]), "ab"[i % 2] * 2) for i in range(12)]
    docs = spark.createDataFrame([*rows, rows[3], (99, None, "aa"), (100, "", "bb")], "doc_id long, text string, lang string").repartition(2)

    def found():
        every = [repeats.cut_repeats(docs), near.near_duplicates(docs).drop("row_key", "group"), quality.judge(docs), language.identify(docs), fingerprints.fingerprint_documents(docs), ppm.score(docs)]
        return [sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in df.collect()) for df in every]

    want = found()
    monkeypatch.setattr(kernels.pieces, "__defaults__", (700,))
    assert found() == want


def test_unused_names(spark):
    assert common.unused(spark.createDataFrame([(1, 2)], "a int, _A int"), "a", "b") == ["__a", "b"]


def test_empty_conversations_and_pipeline(spark, tmp_path):
    assert chat.collapse_and_render(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
