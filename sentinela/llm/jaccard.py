"""Similarity join on word shingles (operator 11): PartEnum signatures, compared by exact bounds, verified on full sets.

Two sets of at most ``r`` shingles with a Jaccard similarity of t per cent or more differ in at most
``k = (100 - t) * 2r / (100 + t)`` elements. Sizes fall into bands whose ends are 100 / t apart, so such a pair lies in
one band or in two neighbouring ones; a set therefore signs for its own band and for the next one, each with its ``k``.

1. Signing: hashes deal the domain of shingles to groups of ``PARTS`` partitions. Of two sets that differ in at most k
   elements, at most k / 2 groups hold two differences or more; in any other group leaving out one partition leaves equal
   rests. So each group gives ``PARTS`` signatures, the hash of what is left without each partition. Empty rests would be
   equal for unrelated sets: they are not emitted. A set is served if more than k / 2 of its groups keep something whatever
   partition goes (at least two shingles if that suffices, else one); if not, it signs again with another dealing of
   the domain. A pair is found as long as one of the two is served, and the few that never are share one signature.
2. Equal sets form one class. Signatures travel as compressed blobs to buckets; of those that a task meets three times or
   more just the first two members go there, the others are known to share it and leave by themselves.
3. Every class is paired with the least class that it shares a signature with. Pairs that a bound on the difference leaves
   open (sums of absolute differences of counts over ``SLOTS`` hash slots, never more than the true difference) are
   verified on the full sets, and what is linked is contracted to components.
4. In signatures whose members still lie in several components (one of each set of members) all are paired with two
   members, and what is left is compared block by block inside tasks: k members are dealt to blocks of ``BLOCK``, rows are
   written k / BLOCK times, and a task emits only pairs of different components that the bound leaves open. Two sets that
   are alike share hundreds of signatures; each row has the first ``FIRST`` ones of its set, and a pair that has one of
   these in common is not emitted in any later one.

No link is lost at any step, and nothing is capped. ``similar_pairs`` gives every link between different sets instead of
components; there all members of a signature are compared block by block.

Defined results: a text with fewer than ``width`` words has its whole sequence as one shingle; without words the set is
empty and linked with nothing; a null doc_id belongs to its text's component but never names one (null if nobody else
does); repeated rows share a class; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K
from sentinela.llm import near

PARTS = 3
#: Groups beyond those that differences can spoil, as a share of them; dealings of the domain before the common signature.
SPARE, DEALS = 0.2, 8
SLOTS = 256
#: Signatures per blob flush and per bucket; members of one signature in a flush from which all but two stay out of it.
FLUSH, BUCKET, LOCAL = 1_500_000, 1_500_000, 3
#: Bits of a signature that are sent. Sets that have only these in common are two more to compare; none are lost.
SENT = 48
#: Members per block and rows per task of the block-wise comparison.
BLOCK, TASK_ROWS = 400, 4_000
#: A set's least signatures that its rows carry in the block-wise comparison.
FIRST = 8
#: Units of at most so many members are compared together, so many pairs at a time.
SMALL, PAIRS = 48, 100_000
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def bands(most: int, threshold: int) -> np.ndarray:
    """The upper ends of the bands of sizes, up to one beyond the band of ``most``."""
    ends = [1]
    while len(ends) < 2 or ends[-2] < most:
        ends.append((ends[-1] + 1) * 100 // threshold)
    return np.array(ends, np.int64)


def differences(total, threshold: int):
    """How many elements two sets of ``total`` elements together may differ in at most."""
    return (100 - threshold) * total // (100 + threshold)


def set_keys(doc: np.ndarray, g: np.ndarray, n_docs: int) -> np.ndarray:
    """Two 64-bit hashes of each document's set; zeros if it is empty."""
    key = np.zeros((n_docs, 2), U)
    full, at = np.unique(doc, return_index=True)
    if len(full):
        with np.errstate(over="ignore"):
            key[full, 0], key[full, 1] = np.add.reduceat(K.mix(g), at), np.add.reduceat(K.mix(g ^ U(0x5851F42D4C957F2D)), at)
    return key


def signatures(doc: np.ndarray, g: np.ndarray, n_docs: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature and document of all signatures of documents' sets (sorted by document)."""
    size = np.bincount(doc, minlength=n_docs)
    ends = bands(int(size.max(initial=1)), threshold)
    out = [(np.zeros(0, U), np.zeros(0, np.int64))]
    with np.errstate(over="ignore"):
        summand = K.mix(g * GOLD + U(1))
        for step in (0, 1):
            end = ends[np.searchsorted(ends, size) + step]
            k = differences(2 * end, threshold)
            need = k // 2 + 1
            groups = need + np.ceil(need * SPARE).astype(np.int64)
            live = np.flatnonzero((size > 0) & (k > 0))  # without a difference sets are equal, and one class
            for deal in range(DEALS):
                if not len(live):
                    break
                place = np.full(n_docs, -1)
                first = np.concatenate([[0], np.cumsum(groups[live])])
                place[live] = first[:-1]
                at = np.flatnonzero(place[doc] >= 0)
                h = K.mix(g[at] ^ U(deal * 2 + 1) * GOLD)
                slot = (place[doc[at]] + ((h >> U(32)) % groups[doc[at]].astype(U)).astype(np.int64)) * PARTS + ((h & U(0xFFFFFFFF)) % U(PARTS)).astype(np.int64)
                count = np.bincount(slot, minlength=first[-1] * PARTS).reshape(-1, PARTS)
                total = np.zeros(first[-1] * PARTS, U)
                np.add.at(total, slot, summand[at])
                total = total.reshape(-1, PARTS)
                left = count.sum(axis=1, keepdims=True) - count
                least = left.min(axis=1)
                enough = [np.add.reduceat(least >= m, first[:-1], dtype=np.int64) >= need[live] for m in (1, 2)]
                home = np.repeat(np.arange(len(live)), groups[live])
                kept = left >= np.where(enough[1], 2, 1)[home][:, None]
                which = (np.arange(first[-1]) - first[home])[:, None] * PARTS + np.arange(PARTS)
                salt = K.mix((end[live][home].astype(U) * U(DEALS + 1) + U(deal)))[:, None] + which.astype(U) * GOLD
                sig = K.mix(total.sum(axis=1, keepdims=True, dtype=U) - total + K.mix(salt))
                row, col = np.nonzero(kept)
                out.append((sig[row, col], live[home[row]]))
                live = live[~enough[0]]
            out.append((K.mix(end[live].astype(U) * U(DEALS + 1) + U(DEALS)), live))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sketches(doc: np.ndarray, g: np.ndarray, n_docs: int) -> np.ndarray:
    """How many shingles of a set fall into each slot, 255 at most: rows whose distance is at most the difference."""
    at = doc * SLOTS + (g >> U(56)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n_docs * SLOTS), 255).astype(np.uint8).reshape(n_docs, SLOTS)


def open_rows(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sizes and sketches, row by row, allow a link."""
    ok = 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)
    at = np.flatnonzero(ok)
    apart = np.abs(a[at].astype(np.int16) - b[at]).sum(axis=1, dtype=np.int64)
    ok[at] = apart <= differences(n[at] + m[at], threshold)
    return ok


def signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key, n, set_key, key (its first half), sketch of every row of (doc_id, row_key, text)."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(2))
            for a, b, d, o in K.pieces(data, offs):
                doc, g = near.shingles(d, o, width)
                keys = set_keys(doc, g, b - a)
                cols = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.bincount(doc, minlength=b - a).astype(np.int64)), K.binary_rows(keys), pa.array(keys[:, 0].view(np.int64)), K.binary_rows(sketches(doc, g, b - a))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row_key", "n", "set_key", "key", "sketch"])

    return docs.mapInArrow(K.tidy(run), "doc_id long, row_key binary, n long, set_key binary, key long, sketch binary")


def members_by_signature(texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """sig, node of a table (node, text): linked sets have a signature in common."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(1))
            for a, b, d, o in K.pieces(data, offs):
                doc, g = near.shingles(d, o, width)
                sig, of = signatures(doc, g, b - a, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(of))], names=["sig", "node"])

    return texts.select("node", "text").mapInArrow(K.tidy(run), "sig long, node long").distinct()


MEMBER = "sig long, key long, hub long"


def signature_blobs(docs: DataFrame, width: int, threshold: int, buckets: int, flush: int = FLUSH) -> DataFrame:
    """bucket, sigs, own, keys, hubs: blobs of signatures with their sets' keys (``own`` counts into ``keys``); where ``hubs``
    is there, of members that are known to share theirs with a hub, in any bucket."""
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("sigs", "own", "keys", "hubs"))])

    def blobs(sig: np.ndarray, key: np.ndarray):
        by = np.lexsort((key, sig))
        sig, key = sig[by], key[by]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[new], key[new]
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(sig)))
        begin = np.repeat(start, size)
        aside = (np.repeat(size, size) >= LOCAL) & (np.arange(len(sig)) - begin >= 2)
        for some in np.array_split(np.flatnonzero(aside), max(1, int(aside.sum()) // 100_000)):
            if len(some):
                yield {"bucket": int(K.mix(sig[some[:1]])[0] % U(buckets)), "sigs": K.planes(sig[some]), "own": b"", "keys": K.planes(key[some]), "hubs": K.planes(key[begin[some]])}
        sig, key = sig[~aside], key[~aside]
        home = (sig % U(buckets)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            own = by[cut[b] : cut[b + 1]]
            keys, at = np.unique(key[own], return_inverse=True)
            at = at.astype(np.uint16 if len(keys) < 1 << 16 else np.uint32)
            yield {"bucket": b, "sigs": K.planes(sig[own]), "own": bytes([at.dtype.itemsize]) + K.planes(at), "keys": K.planes(keys), "hubs": None}

    def run(batches):
        held, n = [], 0

        def out():
            sig, key = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = list(blobs(sig, key))
            for i in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[i : i + 256], schema)

        for batch in batches:
            data, offs = K.flat(batch.column(0))
            for a, b, d, o in K.pieces(data, offs):
                doc, g = near.shingles(d, o, width)
                sig, of = signatures(doc, g, b - a, threshold)
                held.append((sig >> U(64 - SENT), set_keys(doc, g, b - a)[of, 0]))
                n += len(sig)
                if n >= flush:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return docs.select("text").mapInArrow(K.tidy(run), "bucket int, sigs binary, own binary, keys binary, hubs binary")


def members_of_bucket(table: pa.Table) -> pa.Table:
    """sig, key, hub of the signatures with several members; the hub is the least of them."""
    sigs, keys, paired = [np.zeros(0, U)], [np.zeros(0, U)], []
    for s, o, k, h in zip(*(table.column(c) for c in ("sigs", "own", "keys", "hubs")), strict=True):
        sig, key = K.unplanes(s.as_py(), U), K.unplanes(k.as_py(), U)
        if h.is_valid:
            paired.append((sig, key, K.unplanes(h.as_py(), U)))
        else:
            own = o.as_py()
            sigs.append(sig)
            keys.append(key[K.unplanes(own[1:], np.uint16 if own[0] == 2 else np.uint32)])
    sig, key = np.concatenate(sigs), np.concatenate(keys)
    by = np.lexsort((key, sig))
    sig, key = sig[by], key[by]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[new], key[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sig)))
    row = np.flatnonzero(np.repeat(size, size) > 1)
    begin = np.repeat(start, size)[row]
    paired.append((sig[row], key[row], key[begin]))
    return pa.table([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*paired, strict=True)], names=["sig", "key", "hub"])


def promising(pairs: DataFrame, classes: DataFrame, threshold: int, by: str = "key") -> DataFrame:
    """The pairs (a, b) of nodes that the bounds leave open, from pairs (a, b) of the classes' column ``by``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ra, rb = (K.flat(batch.column(c))[0].reshape(-1, SLOTS) for c in (4, 5))
                keep = pa.array(open_rows(ra, rb, batch.column(2).to_numpy(), batch.column(3).to_numpy(), threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda x: classes.select(F.col(by).alias(x), F.col("node").alias(f"node_{x}"), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(near.comparable(F.col("n_a"), F.col("n_b"), threshold))
    return both.select(F.least("node_a", "node_b"), F.greatest("node_a", "node_b"), "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def close_enough(i, j, label, n, block, two, odd, sketch, threshold: int) -> np.ndarray:
    """Which pairs (i, j) of rows have different labels, stand in two blocks if their unit has two, and are left open."""
    at = np.flatnonzero((label[i] != label[j]) & (~two[i] | (block[i] != block[j])))
    at = at[np.bitwise_count(odd[i[at]] ^ odd[j[at]]).sum(axis=1) <= differences(n[i[at]] + n[j[at]], threshold)]
    return at[open_rows(sketch[i[at]], sketch[j[at]], n[i[at]], n[j[at]], threshold)]


def open_pairs(unit, label, n, block, sketch, threshold: int):
    """Pairs of rows, of one unit each, that may be linked; rows are sorted by unit and block."""
    odd = np.packbits(sketch & 1, axis=1).view(U)
    cut = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
    size = np.diff(cut)
    two = np.repeat(block[cut[:-1]] != block[cut[1:] - 1], size)
    stop = np.repeat(cut[1:], size)
    small = np.repeat(size <= SMALL, size)
    rows = np.flatnonzero(small)
    upto = np.cumsum(stop[rows] - rows - 1)
    edge = [0, *(np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)) + 1).tolist(), len(rows)] if len(rows) else [0]
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        some = rows[x:y]
        per = stop[some] - some - 1
        i = np.repeat(some, per)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(per) - per, per)
        ok = close_enough(i, j, label, n, block, two, odd, sketch, threshold)
        yield i[ok], j[ok]
    for row in np.flatnonzero(~small).tolist():
        j = np.arange(row + 1, stop[row])
        i = np.full(len(j), row)
        ok = close_enough(i, j, label, n, block, two, odd, sketch, threshold)
        yield i[ok], j[ok]


def met_before(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of first signatures (``a`` and ``b``, filled up with the largest number) have one below ``sig`` in common."""
    return ((a[:, :, None] == b[:, None, :]) & (a < sig[:, None])[:, :, None]).any(axis=(1, 2))


def emitted(mixed: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The open pairs (a, b) of ``mixed`` (sig, node, label, k), found block by block within tasks; few of them repeat."""
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    units = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j")))
    rows = mixed.select("sig", "node", "label", own.alias("block"), F.explode(units).alias("u")).withColumn("unit", F.xxhash64("sig", "u.i", "u.j"))
    tasks = C.bucket_count(mixed.agg(F.sum(blocks)).first()[0] or 0, TASK_ROWS)
    last = F.lit(np.iinfo(np.int64).max)
    first = F.slice(F.concat(F.sort_array(F.collect_set("sig")), F.array_repeat(last, FIRST)), 1, FIRST)  # as many as a set has shingles
    rows = rows.join(classes.select("node", "n", "sketch").join(mixed.groupBy("node").agg(first.alias("first")), "node"), "node")
    rows = rows.select(F.pmod("unit", F.lit(tasks)).alias("task"), "unit", "sig", "node", "label", "n", "block", "sketch", "first")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("unit", "ascending"), ("block", "ascending"), ("node", "ascending")])
        unit, sig, node, label, n, block = (t.column(c).to_numpy() for c in ("unit", "sig", "node", "label", "n", "block"))
        sketch = K.flat(t.column("sketch"))[0].reshape(-1, SLOTS)
        first = t.column("first").combine_chunks().flatten().to_numpy().reshape(-1, FIRST)
        found = [(np.zeros(0, np.int64),) * 2]
        for i, j in open_pairs(unit, label, n, block, sketch, threshold):
            new = ~met_before(sig[i], first[i], first[j])
            found.append((node[i[new]], node[j[new]]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def compared(mixed: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    return emitted(mixed, classes, threshold).distinct()


def one_of_equal(members: DataFrame, label: DataFrame | None, least: int) -> DataFrame:
    """sig, node, label, k of the signatures with ``least`` members or more in several components; of signatures with the
    same members, one. Without ``label``, ``members`` has it."""
    labelled = members if label is None else members.join(label, "node")
    whole = [F.bit_xor(F.xxhash64("node", F.lit(s))).alias(f"_x{s}") for s in (1, 2)]
    per = labelled.groupBy("sig").agg(F.count("*").alias("k"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), *whole)
    per = per.filter(f"_lo <> _hi and k >= {least}").groupBy("_x1", "_x2", "k").agg(F.min("sig").alias("sig")).select("sig", "k")
    return labelled.join(per, "sig").select("sig", "node", "label", "k")


class Join:
    """The tables that both results start from: signed rows, classes of equal sets, members of signatures, texts."""

    def __init__(self, docs: DataFrame, width: int, threshold: int):
        self.tables, self.width, self.threshold = C.Tables(), width, threshold
        doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
        keyed = docs.select(doc_id.alias("doc_id"), text.alias("text"), near.row_key(doc_id, text).alias("row_key"))
        self.signed = self.write(signed_rows(keyed.select("doc_id", "row_key", "text"), width), "signed")
        one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "key", "sketch"))
        classes = self.signed.filter("n > 0").groupBy("set_key", "n").agg(one.alias("one"), F.min("doc_id").alias("least_id"))
        self.classes = self.write(classes.select("set_key", "n", "least_id", "one.row_key", "one.key", "one.sketch", F.monotonically_increasing_id().alias("node")), "classes")
        buckets = C.bucket_count(self.signed.agg(F.sum("n")).first()[0] or 0, BUCKET)
        blobs = signature_blobs(keyed, width, threshold, buckets)
        self.bins = self.write(blobs.groupBy("bucket").applyInArrow(members_of_bucket, MEMBER), "bins")
        C.give_back(docs.sparkSession)  # and with the plan what the blobs' shuffle has on disk
        wanted = self.classes.join(self.bins.select("key").distinct(), "key").select("node", "row_key")
        texts = keyed.select("row_key", "text").join(wanted, "row_key").dropDuplicates(["row_key"])  # a node has one, and the join has dealt by it
        self.texts = self.write(texts.select("node", "text"), "texts")
        C.give_back(docs.sparkSession)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.tables.write(df, f"join-{name}")

    def nodes(self) -> DataFrame:
        return self.texts.select("node", F.col("node").alias("label"))

    def members(self) -> DataFrame:
        return self.bins.select("sig", "key").distinct().join(self.classes.select("key", "node"), "key").select("sig", "node")

    def mixed(self, label: DataFrame) -> DataFrame:
        """sig, node, label of the signatures in which a member and its hub lie in different components."""
        known = self.write(label.join(self.classes.select("node", "key"), "node"), "known")
        of = lambda c: known.select(F.col("key").alias(c), F.col("label").alias(f"_{c}"))
        sigs = self.bins.filter("key <> hub").join(of("key"), "key").join(of("hub"), "hub").filter("_key <> _hub").select("sig").distinct()
        rows = self.bins.join(self.write(sigs, "sigs"), "sig", "left_semi").select("sig", "key").distinct()
        return rows.join(known.select("key", "node", "label"), "key").select("sig", "node", "label")

    def verified(self, pairs: DataFrame) -> DataFrame:
        return self.write(near.verified(self.write(pairs, "pairs"), self.texts, self.width, self.threshold), "linked")


def similar_documents(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (see the module's docstring)."""
    j = Join(docs, width, threshold)
    contract = lambda pairs, label: j.tables.add(near.components(j.verified(pairs), label))
    star = j.bins.groupBy(F.col("key").alias("a")).agg(F.min("hub").alias("b")).filter("a <> b")
    label = contract(promising(star, j.classes, threshold), j.nodes())
    members = j.write(one_of_equal(j.mixed(label), None, 2), "members")
    hub = lambda seed: F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(seed)))
    hubs = members.groupBy("sig").agg(hub(11).alias("hub"), hub(12).alias("second"))
    star = members.join(hubs, "sig").select("node", "label", F.explode(F.array("hub", "second")).alias("hub")).filter("label <> hub.label")
    star = star.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    label = contract(promising(star, j.classes, threshold, "node"), label)
    mixed = j.write(one_of_equal(members.select("sig", "node"), label, 4), "mixed")
    label = contract(compared(mixed, j.classes, threshold), label)
    named = label.join(j.classes.select("node", "least_id"), "node").groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_class = j.classes.select("set_key", "n", "node", "least_id").join(label, "node", "left").join(named, "label", "left")
    by_class = j.write(by_class.select("set_key", "n", F.coalesce("component_id", "least_id").alias("component_id")), "named")
    j.tables.drop(keep=[j.signed, by_class])
    out = j.signed.select("doc_id", "n", "set_key").join(by_class, ["set_key", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def similar_pairs(docs: DataFrame, width: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as pairs (a, b) of classes, and doc_id, node: which document is in which class."""
    j = Join(docs, width, threshold)
    every = j.write(one_of_equal(j.members(), j.nodes(), 2), "members")
    links = j.verified(compared(every, j.classes, threshold))
    member = j.write(j.signed.filter("n > 0").join(j.classes.select("set_key", "n", "node"), ["set_key", "n"]).select("doc_id", "node"), "member")
    j.tables.drop(keep=[links, member])
    return links, member


K.ship(__name__)
