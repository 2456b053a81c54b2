"""The pipeline's stages against brute force: long texts, null and repeated ids, repeated rows."""

import collections
import random
import re

import corpus_pipeline
from sentinela.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def test_mixing_takes_rows_with_null_or_clashing_ids(spark):
    rows = [(None, "a b c", "s0"), (None, "d e f", "s0"), (1, "g h i", "s0"), (1, "j k", "s0"), (1, "j k", "s0")]
    got = corpus_pipeline.mix_sources(spark, table(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t, _ in rows)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    words = [f"w{i}" for i in range(100)]
    base, near_copy = " ".join(words), " ".join([*words[:-1], "x"])
    other, third = " ".join(f"o{i}" for i in range(40)), " ".join(f"t{i}" for i in range(40))
    rows = [(5, base), (5, base), (5, near_copy), (None, base), (9, near_copy), (None, other), (None, other), (3, third), (None, third), (8, "two words"), (8, "two words")]
    rows += [(1, None), (2, ""), (2, " ")]
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, [(i, t, "s0") for i, t in rows]), "").collect()
    groups = {base: 0, near_copy: 0, other: 1, third: 2, "two words": 3}
    kept = sorted((groups[r.text], str(r.doc_id)) for r in got if r.text in groups)
    assert kept == [(0, "5"), (1, "None"), (2, "3"), (3, "8")]
    assert sorted((r.doc_id, r.text) for r in got if r.text not in groups and r.text is not None) == [(2, ""), (2, " ")] and any(r.doc_id == 1 and r.text is None for r in got)


def test_run_keeps_to_the_stages(spark, tmp_path):
    """The whole run: all rows come out packed, and no stage but the mix repeats or drops what it should keep."""
    random.seed(9)
    lines = {"en": "the cat sat on the mat and looked at the dog", "de": "der hund lief durch den wald und sah die katze"}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        words = lines[lang].split()
        rows.append((i, " ".join(random.choice(words) + random.choice(["", "s", "en"]) for _ in range(30 if i else 3000)), lang, f"s{i % 4}", 0))
    rows += [rows[1], (500, rows[2][1], "de", "s0", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    named = corpus_pipeline.identify_language(spark, docs, "")
    assert named.columns == docs.columns and {r.doc_id: r.lang for r in named.collect()}.items() <= {r[0]: r[2] for r in rows}.items()
    single = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in single) == list(range(80))
    hidden = corpus_pipeline.replace_personal_data(spark, table(spark, [(1, "mail a@b.com", "s0"), (None, None, "s0")]), "").collect()
    assert all("a@b.com" not in (r.text or "") for r in hidden) and len(hidden) == 2
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed


def test_mixing_keeps_the_words_of_the_mix(spark):
    random.seed(5)
    sizes = {"s0": [4000, 3000, 20] * 2, "s1": [2500, 30, 30], "s2": [900, 9000, 5000, 40, 3000]}
    rows, n = [], 0
    for source, all_sizes in sizes.items():
        for k, size in enumerate(all_sizes):
            words = "".join(random.choice([" ", "\n", " \t"]) + f"w{n}_{i}" for i in range(size)) + " \n"
            rows.append((None if k % 3 == 0 else 7 if k % 3 == 1 else n, words, source))  # null and clashing ids
            n += 1
    rows += [rows[1], (None, None, "s0"), (99, " \n", "s1")]
    docs = table(spark, rows)
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert all(r.n_chars == len(r.text) and any(r.text in t for i, t, s in rows if t and (i, s) == (r.doc_id, r.source)) for r in got)
    have, want = collections.Counter(), {}
    for r in got:
        have[r.source] += len(re.findall(WORD, r.text))
    mixed = mixing.mix(docs).collect()
    for r in mixed:
        want[r.source] = r.target
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += r.taken
    assert have.keys() == want.keys() and all(abs(have[s] - want[s]) <= 0.02 * want[s] + 2 * mixing.BLOCK for s in want)
    per = collections.Counter((r.source, w) for r in got for w in re.findall(WORD, r.text))
    own = collections.Counter((s, w) for _, t, s in rows if t for w in re.findall(WORD, t))
    assert all(v <= mixing.MOST * own[k] for k, v in per.items())
    assert have == taken


def test_a_stage_starts_without_the_garbage_of_the_one_before(spark):
    """What nothing refers to any more is collected in Python and in the JVM before a stage runs."""
    import gc
    import weakref

    class Held:
        pass

    full = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    gc.disable()
    try:
        held = Held()
        held.itself, ref, before = held, weakref.ref(held), full()
        del held
        corpus_pipeline.mix_sources(spark, table(spark, [(1, "a b", "s0")]), "")
        assert ref() is None and full() > before
    finally:
        gc.enable()
