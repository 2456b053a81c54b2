"""Quality rules (operator 8): clean line by line first, then judge what is left.

A line fails if it repeats an earlier line of the text, holds a boilerplate phrase, looks like navigation (three
or more of ``|<>`` or ``»``, or at most three words without closing punctuation in a text of several lines), or
has one symbol of ``#*$%&|<>`` in fifteen characters or more. Failed lines are removed; a text that loses more
than ``MOST_LOST`` of its word characters is rejected, as is one that fails the base rules.

Defined results: a null, empty or blank text has zero counts, fails the base rules and is not kept; lines end at
``\\n`` only; repeated rows are judged each; an empty table gives no rows; an empty line never fails.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import kernels as K

MOST_LOST = 0.5
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Phrases of pages' frames rather than of their prose.
BOILERPLATE = re.compile(rb"all rights reserved|privacy policy|terms of use|terms of service|cookie policy|accept cookies|enable javascript|subscribe to our|sign up for|click here|read more|share this|follow us|lorem ipsum|copyright \xc2\xa9")
CLOSING = np.zeros(256, bool)
CLOSING[list(b".!?:;\"')")] = True


def twice(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once in their document, and which repeat an earlier one."""
    with np.errstate(over="ignore"):
        name = K.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(name, kind="stable")
    same = np.zeros(len(name), bool)
    same[1:] = name[order][1:] == name[order][:-1]
    later = np.zeros(len(name), bool)
    later[order] = same
    same[:-1] |= same[1:]
    many = np.zeros(len(name), bool)
    many[order] = same
    return many, later


def measure(data: np.ndarray, offs: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of the base rules and what the line rules remove, per document."""
    n = len(offs) - 1
    starts, ends, doc, h = K.word_hashes(data, offs)
    raw_hash = K.prefix_hash(data)
    h = K.span_hash(raw_hash, starts, ends)  # case counts here
    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    per_word = points[ends] - points[starts]
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": np.bincount(doc, per_word, n).astype(np.int64)}
    where = np.flatnonzero(SYMBOL[data])
    out["n_symbols"] = np.bincount(K.doc_of(offs, where), minlength=n)
    covered = np.zeros(len(h) + 1, np.int64)
    grams = K.chain(h, window)
    if len(grams):
        inside = np.flatnonzero(doc[: len(grams)] == doc[window - 1 :])
        many, _ = twice(doc[inside], grams[inside])
        at = inside[many]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    out["n_repeat_words"] = np.bincount(doc, np.cumsum(covered)[:-1] > 0, n).astype(np.int64)
    # lines
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    cut[1:] |= data == 10
    at = np.flatnonzero(cut)
    l_start, l_next = at[:-1], at[1:]
    l_end = l_next - ((data[l_next - 1] == 10) if len(l_next) else 0)
    l_doc = K.doc_of(offs, l_start)
    w_line = np.searchsorted(l_start, starts, side="right") - 1
    l_words = np.bincount(w_line, minlength=len(l_start))
    l_chars = np.bincount(w_line, per_word, len(l_start)).astype(np.int64)
    solid = np.flatnonzero(l_words > 0)
    later = np.zeros(len(l_start), bool)
    later[solid] = twice(l_doc[solid], K.span_hash(raw_hash, l_start[solid], l_end[solid]))[1]
    out["n_dup_lines"] = np.bincount(l_doc[later], minlength=n)
    symbols = np.bincount(np.searchsorted(l_start, where, side="right") - 1, minlength=len(l_start))
    bars = np.flatnonzero((data == 124) | (data == 60) | (data == 62) | ((data == 0xBB) & (np.roll(data, 1) == 0xC2)))
    bars = np.bincount(np.searchsorted(l_start, bars, side="right") - 1, minlength=len(l_start))
    last_word = np.searchsorted(starts, l_next, side="left") - 1
    closed = CLOSING[data[np.maximum(0, ends[last_word] - 1)]] if len(starts) else np.zeros(len(l_start), bool)
    several = np.bincount(l_doc[solid], minlength=n)[l_doc] > 1
    phrase = np.zeros(len(l_start), bool)
    apart = np.insert(K.LOWER[data], offs[1:-1], 10)  # a line end between documents: no phrase crosses it
    hits = np.array([m.start() for m in BOILERPLATE.finditer(apart.tobytes())], np.int64)
    hits -= np.searchsorted(offs[1:-1] + np.arange(n - 1), hits, side="right") if n > 1 else 0
    phrase[np.searchsorted(l_start, hits, side="right") - 1] = True
    failed = (l_words > 0) & (later | phrase | (bars >= 3) | ((l_words <= 3) & ~closed & several) | (15 * symbols >= np.maximum(1, l_chars)))
    out["lost_chars"] = np.bincount(l_doc, l_chars * failed, n).astype(np.int64)
    out["n_failed_lines"] = np.bincount(l_doc, failed, n).astype(np.int64)
    out["_lines"] = (l_start, l_next, l_doc, failed)
    return out


def judge(docs: DataFrame, most_lost: float = MOST_LOST, with_text: bool = False) -> DataFrame:
    """doc_id, the counts, base_failed and kept; ``with_text`` adds cleaned_text, the lines that did not fail."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(1))
            for a, b, d, o in K.pieces(data, offs):
                m = measure(d, o)
                base = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
                kept = ~base & (m["lost_chars"] <= most_lost * m["word_chars"])
                cols = [batch.column(0).slice(a, b - a), *(pa.array(m[k].astype(np.int64)) for k in COUNTS), pa.array(base), pa.array(kept)]
                if with_text:
                    start, nxt, home, failed = m["_lines"]
                    gone = np.zeros(len(d) + 1, np.int64)
                    gone[start[failed]] += 1
                    gone[nxt[failed]] -= 1
                    left = np.cumsum(gone)[:-1] == 0
                    size = np.concatenate([[0], np.cumsum(np.diff(o) - np.bincount(home, (nxt - start) * failed, b - a).astype(np.int64))]).astype(np.int32)
                    cols.append(pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(size.tobytes()), pa.py_buffer(d[left].tobytes())]))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "base_failed", "kept", *["cleaned_text"] * with_text])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{k} long" for k in COUNTS)
    return slim.mapInArrow(run, f"doc_id long, {fields}, base_failed boolean, kept boolean" + ", cleaned_text string" * with_text)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "n_failed_lines"]
K.ship(__name__)
