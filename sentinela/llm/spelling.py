"""Spelling variants (operator 12): bands of letter-parity masks, joined with lengths, verified by edit distance.

A word's mask has a bit for each letter that it holds an odd number of times (letters beyond a-z share 38 bits). One
inserted, deleted or replaced letter flips at most two bits, so of three bands of the mask at least one stays equal: words
meet by an equal band and lengths that differ by one at most. An edit also leaves what comes before its place or what comes
after it: of the shorter word's first half and its rest, one stands in the longer one at the same end. The half goes into
the join's key beside the band, which splits the hot bands; the masks' other bits and the edit distance decide.

A word's form is its near word with the largest count, if that is ``ratio`` times its own; forms are followed to the
root by pointer doubling. Each step multiplies the count, so chains are short.

Defined results: a null text has no words; a null doc_id counts as empty text in the check sum; repeated rows count each;
an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K

#: Letters as Latin-1 bytes, A-Z lower-cased; all else is a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
BIT = np.zeros(256, np.uint64)
BIT[97:123] = np.uint64(1) << np.arange(26, dtype=np.uint64)
BIT[0xC0:] = np.uint64(1) << (26 + np.arange(64, dtype=np.uint64) % np.uint64(38))
#: Every third bit, so that common letters are dealt evenly.
BANDS = [sum(1 << b for b in range(i, 64, 3)) for i in range(3)]
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000


def runs_of(doc_id, text: str, least: int, drop: int) -> dict[bytes, int]:
    """The words of a text with their counts: of the runs whose check sum ``drop`` divides, one letter is left out."""
    seen = collections.Counter(w for w in text.encode("latin-1", "replace").translate(LETTERS).split() if len(w) >= least)
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), {}
    for w, n in seen.items():
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start) if drop else 1
        if drop and not h % drop:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < least:
                continue
        out[w] = out.get(w, 0) + n
    return out


def word_counts(docs: DataFrame, least_length: int, least_count: int, drop: int) -> DataFrame:
    """word, n, mask of the words with enough letters and occurrences."""

    def run(batches):
        held: dict[bytes, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, n in runs_of(doc_id, text or "", least_length, drop).items():
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    def masks(batches):
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            begin = np.cumsum([0, *(len(w) for w in words)])[:-1]
            mask = np.bitwise_xor.reduceat(BIT[np.frombuffer(b"".join(words), np.uint8)], begin) if words else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask.view(np.int64))], names=["word", "n", "mask"])

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    return counts.mapInArrow(masks, "word string, n long, mask long")


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: the pairs of words (word, n, mask) one edit apart, each once, the shorter one (or the lesser) first."""
    size = F.length("word")
    signed = [c - (1 << 64) if c >> 63 else c for c in BANDS]
    bands = F.array(*(F.col("mask").bitwiseAND(F.lit(c)) for c in signed))

    def keyed(length, name: str) -> DataFrame:
        """A row for each band and half, as a member of the groups of ``length``."""
        half = F.floor(length / 2).cast("int")
        ends = F.array(F.substring(F.col("word"), F.lit(1), half), F.substring(F.col("word"), half - length, length - half))
        rows = words.select("word", "n", "mask", length.alias("l"), F.posexplode(bands).alias("band", "v"), ends.alias("ends"))
        rows = rows.select("word", "n", "mask", "l", "band", "v", F.posexplode("ends").alias("side", "half"))
        return rows.select(F.xxhash64("band", "v", "l", "side", "half").alias("key"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.col("mask").alias(f"m_{name}"), F.length("word").alias(f"l_{name}"))

    left, right = keyed(size, "a"), keyed(size, "b").unionByName(keyed(size - 1, "b"))
    order = ((F.col("l_a") == F.col("l_b")) & (F.col("a") < F.col("b"))) | (F.col("l_a") + 1 == F.col("l_b"))
    close = F.bit_count(F.col("m_a").bitwiseXOR(F.col("m_b"))) <= 2
    pairs = left.join(right, (left["key"] == right["key"]) & order & close & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "b", "n_a", "n_b").distinct()


def roots(forms: DataFrame, tables: C.Tables) -> DataFrame:
    """word, root of a table (word, form): forms followed to the last by pointer doubling."""
    known = forms.select("word", F.col("form").alias("root"))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = tables.write(known.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return known


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, drop: int = 0) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word. ``drop``: runs whose check sum it divides lose a letter (0: none)."""
    tables = C.Tables()
    words = tables.write(word_counts(docs, least_length, least_count, drop), "words")
    pairs = tables.write(near_words(words), "near-words")
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("r")).select("r.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("_n"), "other")).alias("_best"))
    found = words.select("word", "n").join(best, "word", "left")
    good = -F.col("_best._n") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("_best.other")).alias("form"), F.when(good, -F.col("_best._n")).alias("form_n"))
    found = tables.write(found, "forms")
    root = roots(found.filter("form is not null"), tables)
    out = tables.write(found.join(root, "word", "left").withColumn("root", F.coalesce("root", "word")), "spelling")
    tables.drop(keep=[out])
    return out


K.ship(__name__)
