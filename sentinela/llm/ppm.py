"""LM scoring (operator 3): prediction by partial matching, and the unigram baseline it is held against.

The trie holds byte contexts of up to ``ORDER`` bytes. Training counts every string of ``ORDER + 1`` bytes of the
training texts (start padded with 0xFF, end marked by 0xFE, bytes that UTF-8 never has); the contexts of each
order are sums of these, and all are kept. The contexts of up to ``WHOLE`` bytes and those that have at least one in
``SHARE`` of the training bytes (at most ``SHARE`` an order, whatever the input) are broadcast; a symbol whose longest
context is among these is coded where its text is read, as all shorter ones then are too. The other symbols are
dealt to buckets by the last ``WHOLE`` + 1 bytes of their context, as all longer contexts are, and coded there:
what is broadcast decides where a symbol is coded, not its probability. A symbol is coded in the longest context that the trie has, by
method C (escape = number of distinct successors); on escape the shorter context excludes the successors already
ruled out. Successors of a context are always successors of its suffix, so the excluded sums are kept per node.
A text's score is the log10 probability of all its bytes and its end, case and white space included.

Word statistics are exact for all words of all training texts: words travel as 64-bit hashes in blobs, summed
within a batch first. Words with a share of at least one in ``HOT_SHARE`` (at most that many) are broadcast with
their counts; the rest are joined with the documents' words bucket by bucket, so no frequent word meets in a task.

Defined results: a null or empty text has one token, its end; repeated rows are scored (and learnt from) each;
a null doc_id is never held out; an empty table gives no rows, and without training texts N and V are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K

ORDER = 5
SHARE = 1 << 19
WHOLE = 2
HOT_SHARE = 1 << 12
#: Grams, or grams and words, that a task sorts at a time.
GRAMS = 500_000
#: Documents for each part that the words are dealt to; parts are a power of two, at least LEAST_PARTS.
PART_DOCS = 8_000
#: Least buckets that the grams of an order are dealt to; as many as twice the parts of the words, if that is more.
GRAM_BUCKETS = 32
LEAST_PARTS, MOST_PARTS = 8, 1 << 14
END_WORD = np.uint64(0xE0D0E0D0E0D0E0D1)
PAD, END = 0xFF, 0xFE
ALPHABET = 255


def padded(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each text with ``order`` start bytes before and the end byte after it; where the texts begin."""
    n = len(offs) - 1
    begin = offs[:-1] + np.arange(n) * (order + 1)
    out = np.full(len(data) + n * (order + 1), PAD, np.uint8)
    out[np.arange(len(data)) + np.repeat(begin + order - offs[:-1], np.diff(offs))] = data
    out[begin + order + np.diff(offs)] = END
    return out, begin


def grams(text: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The last order + 1 bytes as one integer, for every position that is predicted or inside the padding."""
    n = len(text) - order
    out = np.zeros(n, np.uint64)
    for k in range(order + 1):
        out <<= np.uint64(8)
        out |= text[k : k + n]
    return out


def predicted(begin: np.ndarray, sizes: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``grams`` of the positions to predict, and where each text's begin among them."""
    per = sizes + 1
    first = np.cumsum(per) - per
    return np.arange(per.sum()) + np.repeat(begin - first, per), first


def tagged(g: np.ndarray, order: int) -> np.ndarray:
    """A gram of an order-``order`` context and its successor, made distinct from those of other orders."""
    return (g & np.uint64((1 << (8 * (order + 1))) - 1)) | np.uint64((order + 1) << 56)


def node_key(g: np.ndarray, order: int) -> np.ndarray:
    """The key of the order-``order`` context of each gram."""
    return ((g >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)) | np.uint64((order + 129) << 56)


def bucket_of(g: np.ndarray, buckets: int) -> np.ndarray:
    """Where grams of an order above ``WHOLE`` are counted and coded: by the last bytes of the context."""
    return (K.mix((g >> np.uint64(8)) & np.uint64((1 << (8 * (WHOLE + 1))) - 1)) % np.uint64(buckets)).astype(np.uint16)


def shortened(g: np.ndarray, c: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of order ``order`` and their counts, from those of a higher order."""
    g, at = np.unique(g & np.uint64((1 << (8 * (order + 1))) - 1), return_inverse=True)
    return g, np.bincount(at, c, len(g)).astype(np.int64)


class Trie:
    """Contexts and successors in two tables, with what coding needs precomputed."""

    def __init__(self, edges: list[tuple[np.ndarray, np.ndarray]]):
        """``edges``: for each order, the grams (context and successor) of its contexts and their counts."""
        self.order = len(edges) - 1
        every = [tagged(g, k) for k, (g, _) in enumerate(edges)]
        counts = np.concatenate([c for _, c in edges]).astype(np.float64)
        nodes, totals, kinds, ruled = [], [], [], []
        self.edge = K.Slots(np.concatenate(every), np.arange(len(counts)))
        self.count = counts
        for k, (g, c) in enumerate(edges):
            key, at = np.unique(node_key(g, k), return_inverse=True)
            nodes.append(key)
            totals.append(np.bincount(at, c, len(key)))
            kinds.append(np.bincount(at, minlength=len(key)))
            shorter = counts[self.edge.find(tagged(g, k - 1))] if k else np.zeros(len(g))
            ruled.append(np.bincount(at, shorter, len(key)))
        keys = np.concatenate(nodes)
        self.node = K.Slots(keys, np.arange(len(keys)))
        self.total, self.kinds, self.ruled = (np.concatenate(x).astype(np.float64) for x in (totals, kinds, ruled))
        home = np.concatenate([self.node.find(node_key(g, k)) for k, (g, _) in enumerate(edges)]) if len(counts) else np.zeros(0, np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.plain = np.log10(counts / (self.total[home] + self.kinds[home]))

    def arrays(self) -> tuple:
        """All of the trie as plain arrays, to be broadcast."""
        return (self.order, self.count, self.total, self.kinds, self.ruled, self.plain, self.edge.keys, self.edge.values, self.node.keys, self.node.values)

    @classmethod
    def of(cls, arrays: tuple) -> Trie:
        out = cls.__new__(cls)
        out.order, out.count, out.total, out.kinds, out.ruled, out.plain, *slots = arrays
        out.edge, out.node = K.Slots.of(*slots[:2]), K.Slots.of(*slots[2:])
        return out

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        out = np.zeros(len(g))
        live = np.arange(len(g))
        less, fewer = np.zeros(len(g)), np.zeros(len(g))
        for k in range(self.order, -1, -1):
            here = g[live]
            e = self.edge.find(tagged(here, k))
            hit = e >= 0
            fresh = hit & (fewer[live] == 0)
            out[live[fresh]] += self.plain[e[fresh]]
            n = np.full(len(live), -1)
            slow = ~fresh
            n[slow] = self.node.find(node_key(here[slow], k))
            with np.errstate(divide="ignore", invalid="ignore"):
                late = hit & ~fresh
                x = live[late]
                out[x] += np.log10(self.count[e[late]] / (self.total[n[late]] - less[x] + self.kinds[n[late]] - fewer[x]))
                gone = ~hit & (n >= 0)
                x, m = live[gone], n[gone]
                kinds = self.kinds[m] - fewer[x]
                step = np.log10(kinds / (self.total[m] - less[x] + kinds))
            out[x] += np.where(kinds > 0, step, 0.0)
            less[x], fewer[x] = self.ruled[m], self.kinds[m]
            live = live[~hit]
        out[live] -= np.log10(np.maximum(1.0, ALPHABET - fewer[live]))
        return out


def gram_counts(texts: DataFrame, order: int = ORDER, flush: int = GRAMS, buckets: int = GRAM_BUCKETS) -> DataFrame:
    """level, bucket, grams, counts: blobs of sorted grams with their counts, of the orders up to ``WHOLE`` and the last."""
    def blobs(g: np.ndarray, c: np.ndarray):
        for k in [order, *range(min(order - 1, WHOLE), -1, -1)]:
            if k < order:
                g, c = shortened(g, c, k)
            if k > WHOLE:
                home = bucket_of(g, buckets)
            else:
                home = (K.mix(g >> np.uint64(8)) % np.uint64(buckets)).astype(np.uint16) if k > 1 else np.zeros(len(g), np.uint16)
            by = np.argsort(home, kind="stable")
            cut = np.searchsorted(home[by], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = by[cut[b] : cut[b + 1]]
                yield k, b, K.planes(g[own]), K.planes(c[own])

    def run(batches):
        held, n = [], 0

        def out():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            rows = list(blobs(g, c.astype(np.int64)))
            return pa.RecordBatch.from_pylist([dict(zip(("level", "bucket", "grams", "counts"), r, strict=True)) for r in rows], pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())]))

        for batch in batches:
            data, offs = K.flat(batch.column(0))
            for _, _, d, o in K.pieces(data, offs):
                text, begin = padded(d, o, order)
                g = grams(text, order)[predicted(begin, np.diff(o), order)[0]]
                held.append(g)
                n += len(g)
                if n >= flush:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(run, "level int, bucket int, grams binary, counts binary")


def merged(blobs: pa.ChunkedArray, counts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Sum blobs two by two in size order, so that memory stays near that of the result."""
    g, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    some_g, some_c, n = [], [], 0
    for i, (x, y) in enumerate(zip(blobs, counts, strict=True)):
        some_g.append(K.unplanes(x.as_buffer(), np.uint64))
        some_c.append(K.unplanes(y.as_buffer(), np.int64))
        n += len(some_g[-1])
        if n > max(200_000, len(g)) or i == len(blobs) - 1:
            g, at = np.unique(np.concatenate([g, *some_g]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c, *some_c]), len(g)).astype(np.int64)
            some_g, some_c, n = [], [], 0
    return g, c


def count_contexts(texts: DataFrame, order: int = ORDER, buckets: int = GRAM_BUCKETS) -> DataFrame:
    """level, bucket, grams, counts: the grams of every order over all rows of a table with a column ``text`` (null: empty)."""
    counted = gram_counts(texts, order, buckets=buckets)

    def add(t: pa.Table) -> pa.Table:
        g, c = merged(t.column("grams"), t.column("counts"))
        level, bucket = t.column("level")[0].as_py(), t.column("bucket")[0].as_py()
        found = [(level, g, c)]
        for k in range(level - 1, WHOLE, -1):
            g, c = shortened(g, c, k)
            found.append((k, g, c))
        return pa.table({"level": pa.array([k for k, _, _ in found], pa.int32()), "bucket": pa.array([bucket] * len(found), pa.int32()), "grams": [K.planes(g) for _, g, _ in found], "counts": [K.planes(c) for _, _, c in found]})

    blob = "level int, bucket int, grams binary, counts binary"
    return C.materialise(counted.groupBy("level", "bucket").applyInArrow(add, blob), "grams")


def frequent_edges(summed: DataFrame, order: int = ORDER, share: int = SHARE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, grams and counts of what is broadcast: all contexts up to ``WHOLE`` bytes and the frequent ones."""

    def total(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int(K.unplanes(x, np.int64).sum()) for x in b.column(0).to_pylist()], pa.int64())], names=["n"])

    n = summed.filter("level = 0").select("counts").mapInArrow(total, "n long").agg(F.sum("n")).first()[0] or 0

    def common(batches):
        for batch in batches:
            for level, g, c in zip(*batch.columns, strict=True):
                level, g, c = level.as_py(), K.unplanes(g.as_buffer(), np.uint64), K.unplanes(c.as_buffer(), np.int64)
                if level > WHOLE:
                    _, at = np.unique(g >> np.uint64(8), return_inverse=True)
                    keep = np.bincount(at, c)[at] * share >= n
                    g, c = g[keep], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([K.planes(g)]), pa.array([K.planes(c)])], names=["level", "grams", "counts"])

    kept = summed.select("level", "grams", "counts").mapInArrow(common, "level int, grams binary, counts binary").collect() if n else []
    return [level_edges([(r["grams"], r["counts"]) for r in kept if r["level"] == k]) for k in range(order + 1)]


def level_edges(blobs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Grams and counts of one order."""
    return np.concatenate([np.zeros(0, np.uint64), *(K.unplanes(bytes(g), np.uint64) for g, _ in blobs)]), np.concatenate([np.zeros(0, np.int64), *(K.unplanes(bytes(c), np.int64) for _, c in blobs)])


def train(texts: DataFrame, order: int = ORDER, share: int = SHARE, buckets: int = GRAM_BUCKETS) -> Trie:
    """The trie that is broadcast, of all rows of a table with a column ``text`` (null: empty)."""
    summed = count_contexts(texts, order, buckets)
    out = Trie(frequent_edges(summed, order, share))
    C.discard(summed)
    return out


def word_counts(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with the end of each text, and their documents."""
    _, _, doc, h = K.word_hashes(d, o)
    n = len(o) - 1
    return np.concatenate([h, np.full(n, END_WORD)]), np.concatenate([doc, np.arange(n)])


def score(docs: DataFrame, order: int = ORDER, share: int = SHARE, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the documents that are not held out (crc32 of the id's text modulo 5 is not ``remainder``).
    """
    spark, tables = docs.sparkSession, C.Tables()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), C.held_out("doc_id", remainder).alias("held_out"))
    learn = slim.filter("not held_out").select("text")
    bits = min(max(LEAST_PARTS.bit_length() - 1, (slim.count() // PART_DOCS).bit_length()), MOST_PARTS.bit_length() - 1)
    buckets = min(1 << 16, max(GRAM_BUCKETS, 2 << bits))
    contexts = tables.add(count_contexts(learn, order, buckets))
    edges = frequent_edges(contexts, order, share)
    trie, short = spark.sparkContext.broadcast(Trie(edges).arrays()), spark.sparkContext.broadcast(edges[: WHOLE + 1])
    del edges
    parts, shift = 1 << bits, np.uint64(64 - bits)

    def count_words(batches):
        held, n = [], 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted((h >> shift).astype(np.int64), np.arange(parts + 1))
            rows = [(b, K.planes(h[x:y]), K.planes(c[x:y].astype(np.int64))) for b, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "words", "counts"])

        for batch in batches:
            data, offs = K.flat(batch.column(0))
            for _, _, d, o in K.pieces(data, offs):
                held.append(word_counts(d, o)[0])
                n += len(held[-1])
                if n >= GRAMS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def add_words(t: pa.Table) -> pa.Table:
        h, c = merged(t.column("words"), t.column("counts"))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "words": [K.planes(h)], "counts": [K.planes(c)], "n": pa.array([int(c.sum())], pa.int64()), "v": pa.array([len(h)], pa.int64())})

    vocabulary = learn.mapInArrow(count_words, "part int, words binary, counts binary")
    vocabulary = tables.write(vocabulary.groupBy("part").applyInArrow(add_words, "part int, words binary, counts binary, n long, v long"), "words")
    n_all, v_all = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.sum("v")).first())

    def frequent(batches):
        for b in batches:
            h = [K.unplanes(x, np.uint64) for x in b.column(0).to_pylist()]
            c = [K.unplanes(x, np.int64) for x in b.column(1).to_pylist()]
            h, c = np.concatenate([np.zeros(0, np.uint64), *h]), np.concatenate([np.zeros(0, np.int64), *c])
            own = c * HOT_SHARE >= n_all
            yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(c[own])], names=["word", "n"])

    hot = vocabulary.select("words", "counts").mapInArrow(frequent, "word long, n long").toPandas()  # at most HOT_SHARE rows
    hot_words = hot["word"].to_numpy(np.int64).view(np.uint64)
    order_ = np.argsort(hot_words)
    hot_words, hot_counts = hot_words[order_], hot["n"].to_numpy(np.int64)[order_]
    base = float(np.log10(n_all + 0.5 * (v_all + 1)))

    def score_texts(batches):
        """Per piece of text a row (kind 0) with its documents and what is known of them here; per flush a row for each
        part of the rare words (1) and each bucket of the rare contexts (2), with the places of their documents."""
        from pyspark import TaskContext

        model, task = Trie.of(trie.value), TaskContext.get().partitionId() << 32
        flush, docs_here, held, n_held = task, 0, ([], [], [], []), 0

        def rows_of(kind: int, home: np.ndarray, *columns: np.ndarray):
            """A row for each value of ``home``, which is sorted."""
            at = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
            for x, y in zip(at.tolist(), [*at[1:].tolist(), len(home)], strict=False):
                yield {"kind": kind, "part": int(home[x]), "flush": flush, "keys": K.planes(columns[0][x:y]), "who": K.planes(columns[1][x:y]), "times": K.planes(columns[2][x:y])}

        def later():
            h, at, g, who = (np.concatenate(x) for x in held)
            by = np.lexsort((at, h))
            h, at = h[by], at[by]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(h))).astype(np.uint32)
            h, at = h[first], at[first]
            rows = list(rows_of(1, (h >> shift).astype(np.int64), h, at, times))
            home = bucket_of(g, buckets)
            by = np.argsort(home, kind="stable")
            return pa.RecordBatch.from_pylist([*rows, *rows_of(2, home[by].astype(np.int64), g[by], who[by], np.zeros(len(by), np.uint8))], ARROW_SCORES)

        for batch in batches:
            data, offs = K.flat(batch.column(1))
            for a, b, d, o in K.pieces(data, offs, 250_000):
                here = docs_here + np.arange(b - a, dtype=np.uint32)
                text, begin = padded(d, o, model.order)
                at, first = predicted(begin, np.diff(o), model.order)
                g = grams(text, model.order)[at]
                cold = (model.node.find(node_key(g, order)) < 0) if order > WHOLE else np.zeros(len(g), bool)
                p = np.zeros(len(g))
                p[~cold] = model.log10(g[~cold])
                own = np.add.reduceat(p, first)
                held[2].append(g[cold])
                held[3].append(np.repeat(here, np.diff(o) + 1)[cold])
                h, doc = word_counts(d, o)
                tokens = np.bincount(doc, minlength=b - a)
                spot = np.minimum(np.searchsorted(hot_words, h), max(0, len(hot_words) - 1)) if len(hot_words) else np.zeros(len(h), np.int64)
                is_hot = hot_words[spot] == h if len(hot_words) else np.zeros(len(h), bool)
                known = np.bincount(doc[is_hot], minlength=b - a)
                part_base = np.bincount(doc[is_hot], np.log10(hot_counts[spot[is_hot]] + 0.5), b - a) if len(hot_words) else np.zeros(b - a)
                held[0].append(h[~is_hot])
                held[1].append(here[doc[~is_hot]])
                n_held += len(held[0][-1]) + len(held[2][-1])
                row = {"kind": 0, "part": -1, "flush": flush, "places": here.tolist(), "docs": batch.column(0).slice(a, b - a).to_pylist(), "held": batch.column(2).slice(a, b - a).to_pylist()}
                row |= {"tokens": tokens.tolist(), "known": known.tolist(), "base": (part_base - tokens * base).tolist(), "score": own.tolist()}
                yield pa.RecordBatch.from_pylist([row], ARROW_SCORES)
                docs_here += b - a
                if n_held >= GRAMS:
                    yield later()
                    flush, docs_here, held, n_held = flush + 1, 0, ([], [], [], []), 0
        if n_held:
            yield later()

    scored = tables.write(slim.select("doc_id", "text", "held_out").mapInArrow(score_texts, SCORES), "scores")

    def by_flush(left: pa.Table, value) -> pa.Table:
        """Per flush the places of its documents, and the sums of ``value`` (known, base, score of keys and times)."""
        out = {"flush": [], "places": [], "known": [], "base": [], "score": []}
        for flush, keys, who, times in zip(*(left.column(c) for c in ("flush", "keys", "who", "times")), strict=True):
            who = K.unplanes(who.as_buffer(), np.uint32)
            places, at = np.unique(who, return_inverse=True)
            out["flush"].append(flush.as_py())
            out["places"].append(K.planes(places))
            for name, x in zip(("known", "base", "score"), value(K.unplanes(keys.as_buffer(), np.uint64), times.as_buffer()), strict=True):
                out[name].append(b"" if x is None else K.planes(np.bincount(at, x, len(places))))
        return pa.table(out, pa.schema([("flush", pa.int64()), *((c, pa.binary()) for c in ("places", "known", "base", "score"))]))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        """What the training texts know of rare words."""
        w, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if right.num_rows and left.num_rows:
            w, c = level_edges(list(zip(right.column("words").to_pylist(), right.column("counts").to_pylist(), strict=True)))

        def value(words, times):
            at = np.minimum(np.searchsorted(w, words), max(0, len(w) - 1))
            n = np.where(w[at] == words, c[at], 0) if len(w) else np.zeros(len(words), np.int64)
            m = K.unplanes(times, np.uint32)
            return (n > 0) * m, np.log10(n + 0.5) * m, None

        return by_flush(left, value)

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        """The probabilities of symbols after rare contexts."""
        if not left.num_rows:
            return by_flush(left, None)
        level, blobs = right.column("level").to_pylist(), list(zip(right.column("grams").to_pylist(), right.column("counts").to_pylist(), strict=True))
        model = Trie([*(short.value[k] for k in range(WHOLE + 1)), *(level_edges([b for x, b in zip(level, blobs, strict=True) if x == k]) for k in range(WHOLE + 1, order + 1))])
        return by_flush(left, lambda g, _: (None, None, np.concatenate([model.log10(g[a : a + 250_000]) for a in range(0, len(g), 250_000)])))

    def add_up(t: pa.Table) -> pa.Table:
        """The sums of one flush, whose documents are no other one's."""
        every = [K.unplanes(x.as_buffer(), np.uint32) for x in t.column("places")]
        places, at = np.unique(np.concatenate(every), return_inverse=True)
        sums = {}
        for name in ("known", "base", "score"):
            raw = [np.zeros(len(e)) if not len(b.as_py()) else K.unplanes(b.as_buffer(), np.float64) for e, b in zip(every, t.column(name), strict=True)]
            sums[f"more_{name}"] = np.bincount(at, np.concatenate(raw), len(places))
        return pa.table({"flush": pa.array([t.column("flush")[0].as_py()] * len(places), pa.int64()), "place": places.astype(np.int64), **sums})

    words = scored.filter("kind = 1").select("part", "flush", "keys", "who", "times")
    found = "flush long, places binary, known binary, base binary, score binary"
    looked = words.groupBy("part").cogroup(vocabulary.select("part", "words", "counts").groupBy("part")).applyInArrow(look_up, found)
    parted = contexts.filter(F.col("level") > WHOLE).select(F.col("bucket").alias("part"), "level", "grams", "counts")
    rest = scored.filter("kind = 2").select("part", "flush", "keys", "who", "times")
    coded = rest.groupBy("part").cogroup(parted.groupBy("part")).applyInArrow(code, found)
    more = looked.unionByName(coded).groupBy("flush").applyInArrow(add_up, "flush long, place long, more_known double, more_base double, more_score double")
    own = scored.filter("kind = 0").select("flush", F.explode(F.arrays_zip("places", "docs", "held", "tokens", "known", "base", "score")).alias("r")).withColumn("place", F.col("r.places"))
    tables.drop(keep=[scored, vocabulary, contexts])
    return own.join(more, ["flush", "place"], "left").select(
        F.col("r.docs").alias("doc_id"),
        F.col("r.held").alias("held_out"),
        F.col("r.tokens").alias("n_tokens"),
        (F.col("r.known") + F.coalesce("more_known", F.lit(0.0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("r.base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("r.score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


SCORES = "kind int, part int, flush long, places array<long>, docs array<long>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, score array<double>, keys binary, who binary, times binary"
ARROW_SCORES = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("flush", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("places", "docs")), ("held", pa.list_(pa.bool_())), *((k, pa.list_(pa.int64())) for k in ("tokens", "known")), *((k, pa.list_(pa.float64())) for k in ("base", "score")), *((k, pa.binary()) for k in ("keys", "who", "times"))])
K.ship(__name__)
