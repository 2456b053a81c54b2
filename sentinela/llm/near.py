"""MinHash near-duplicates (operator 7): HyperMinHash registers, banding, corrected estimates, exact verification.

1. Every whole text gives its set of distinct ``width``-word shingles (64-bit). The first bits of a shingle's hash name
   its bucket; each of ``BUCKETS`` buckets keeps of its least hash the number of leading zeros and four further bits
   (a byte, 0 for an empty bucket). So do ``BANDS * ROWS`` coarser buckets, with eleven further bits; an empty one of
   these borrows from the first full one in an order of its own, so that each agrees with the chance of the similarity
   however small the sets are.
2. Equal sets form one class. Classes are what is compared from here on, whatever the number of copies.
3. Bands of four coarse registers deal classes to bins. In a bin every class is paired with the bin's first hub only;
   pairs that sizes, registers and the collision-corrected estimate of the similarity leave open (``SIGMAS`` standard
   errors below the threshold) are verified on the full sets, and what is linked is contracted to components.
4. Bins that still hold several components do so again with ``HUBS`` further hubs. A hub has then met its whole bin and
   leaves it.
5. In what is mixed even then, registers are compared block by block within tasks: a bin of k classes is dealt to
   blocks of ``BLOCK``, so its rows are written k / BLOCK times, and a task emits just the pairs of different components
   that sizes, registers and the estimate leave open. Classes of bins of over ``LARGE`` meet by signatures instead, of
   which every linked pair has one in common (``jaccard.signatures``), so nothing is lost there.

Registers that differ are never more than the elements that do, which alone decides for small sets; for others the
estimate also does, too low with less than 1e-19 (exp(-2 * SIGMAS**2 * 0.16), Serfling's bound). A pair at similarity 0.8
shares none of the 32 bands with probability 5e-8; there is no other loss and no cap. The work beyond the hubs grows only
with classes that share bins without being linked.

Defined results: a text with fewer than ``width`` words has its whole sequence as one shingle; without words the
set is empty and linked with nothing; a null doc_id belongs to its text's component but never names one (null if
nobody else does); repeated rows share a class; an empty table gives no rows; columns other than doc_id, text and
``row`` are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K

BANDS, ROWS = 32, 4
COARSE_BITS, BUCKET_BITS = 7, 9
BUCKETS = 1 << BUCKET_BITS
#: Leading zeros and mantissa: bits of each in a bucket's byte, and in a coarse register.
FINE, WIDE = (4, 4), (5, 11)
HUBS = 2
SIGMAS = 12.0
#: Sets that may differ in at most so many elements are judged by their registers alone.
FEW = 64
#: Classes per block, rows per task of the block-wise comparison, and what makes a bin be dealt anew.
BLOCK, TASK_ROWS, LARGE = 400, 2_000, 25_000
U = np.uint64
PROBES = np.array([np.random.RandomState(77 + i).permutation(1 << COARSE_BITS) for i in range(1 << COARSE_BITS)])
SALT = np.arange(BANDS, dtype=U) * U(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every distinct shingle, in the order of both."""
    _, _, doc, h = K.word_hashes(data, offs)
    grams = K.chain(h, width)
    inside = np.flatnonzero(doc[: len(grams)] == doc[len(doc) - len(grams) :])
    d, g = doc[inside], grams[inside]
    words = np.bincount(doc, minlength=len(offs) - 1)
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        first = np.searchsorted(doc, short)
        d = np.concatenate([d, short])
        g = np.concatenate([g, *(K.chain(h[a : a + k], k) for a, k in zip(first.tolist(), words[short].tolist(), strict=True))])
    by = np.lexsort((g, d))
    d, g = d[by], g[by]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return d[new], g[new]


def least(d: np.ndarray, g: np.ndarray, bits: int, form: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket in one index, and the register, of each full bucket."""
    at = d * (1 << bits) + (g >> U(64 - bits)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    rest = (g[first] << U(bits)) >> U(32)
    length = np.frexp(rest.astype(np.float64))[1]
    zeros = np.minimum(32 - length, (1 << form[0]) - 2).astype(U)
    mantissa = (rest << U(form[1] + 1) >> length.astype(U)) & U((1 << form[1]) - 1)
    return at[first], (zeros + U(1)) << U(form[1]) | mantissa


def sketches(d: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Registers (n, BUCKETS) and bins (n, BANDS) of ``n`` documents' shingles; empty sets have registers of 0."""
    regs = np.zeros(n * BUCKETS, np.uint8)
    at, code = least(d, g, BUCKET_BITS, FINE)
    regs[at] = code
    wide = np.zeros(n << COARSE_BITS, np.uint16)
    at, code = least(d, g, COARSE_BITS, WIDE)
    wide[at] = code
    wide = wide.reshape(n, -1)
    own = wide.copy()
    row, col = np.nonzero((wide == 0) & wide.any(axis=1)[:, None])
    for k in range(1 << COARSE_BITS):
        if not len(row):
            break
        wide[row, col] = own[row, PROBES[col, k]]
        open_ = wide[row, col] == 0
        row, col = row[open_], col[open_]
    bins = np.tile(SALT, (n, 1))
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            bins = K.mix(bins + wide[:, k::ROWS].astype(U))
    return regs.reshape(n, BUCKETS), bins


def _agreement() -> tuple[np.ndarray, np.ndarray]:
    """log2 of elements per bucket, and the chance that two full buckets of unrelated sets have one register."""
    level = np.arange(-10, 24, 1 / 8)
    zeros, steps = (1 << FINE[0]) - 2, 1 << FINE[1]
    out = []
    for x in 2.0**level:
        p = np.zeros((zeros + 1, steps))
        for z in range(40):
            edge = 2.0 ** -(z + 1) * (1 + np.arange(steps + 1) / steps)
            p[min(z, zeros)] += np.diff(np.expm1(-x * edge) / np.expm1(-x))
        out.append((p**2).sum())
    return level, np.array(out)


LEVEL, AGREEMENT = _agreement()


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates from rows of registers of sets of sizes n and m, and the buckets they rest on."""
    x, y = a != 0, b != 0
    both, some = (x & y).sum(axis=1), (x | y).sum(axis=1)
    same = ((a == b) & x).sum(axis=1)
    by_chance = np.interp(np.log2(np.sqrt(n * m.astype(np.float64)) / BUCKETS), LEVEL, AGREEMENT)
    return (same - by_chance * both) / ((1 - by_chance) * np.maximum(1, some)), some


def leaves_open(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, t: float, sigmas: float = SIGMAS) -> np.ndarray:
    """Whether a similarity of ``t`` or more is possible. In a bucket whose registers differ one set has an element that the
    other has not. Full buckets are a sample, without replacement, of the union."""
    most = np.floor((1 - t) * (n + m) / (1 + t) + 1e-9)
    bound = (a != b).sum(axis=1) <= most
    j, some = estimate(a, b, n, m)
    union = np.maximum(some, (n + m) / (1 + t))
    spread = t * (1 - t) / np.maximum(1, some) * np.maximum(1 - some / union, 0.02)
    return bound & ((most <= FEW) | (j >= t - sigmas * np.sqrt(spread)))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, row_key, n, set_key, registers, bins of every row of a table (doc_id, row_key, text)."""

    def run(batches):
        for batch in batches:
            data, offs = K.flat(batch.column(2))
            for a, b, d, o in K.pieces(data, offs):
                k = b - a
                doc, g = shingles(d, o, width)
                regs, bins = sketches(doc, g, k)
                n = np.bincount(doc, minlength=k)
                key, full = np.zeros((k, 2), U), np.flatnonzero(n)
                at = np.searchsorted(doc, full)
                if len(full):
                    with np.errstate(over="ignore"):
                        key[full, 0], key[full, 1] = np.add.reduceat(K.mix(g), at), np.add.reduceat(K.mix(g ^ U(0x5851F42D4C957F2D)), at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, k), batch.column(1).slice(a, k), pa.array(n.astype(np.int64)), *(K.binary_rows(x) for x in (key, regs, bins))], names=["doc_id", "row_key", "n", "set_key", "registers", "bins"])

    return docs.mapInArrow(K.tidy(run), "doc_id long, row_key binary, n long, set_key binary, registers binary, bins binary")


def banded(classes: DataFrame) -> DataFrame:
    """bin, node, n: the bins of each class, with the size of its set."""

    def run(batches):
        for batch in batches:
            bins, row = K.flat(batch.column(2))[0].view(np.int64), pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(0).take(row), batch.column(1).take(row)], names=["bin", "node", "n"])

    return classes.select("node", "n", "bins").mapInArrow(run, "bin long, node long, n long")


def comparable(n, m, threshold: int):
    """Whether sets of these sizes can reach the threshold."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def promising(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that estimates leave open."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ra, rb = (K.flat(batch.column(c))[0].reshape(-1, BUCKETS) for c in (4, 5))
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                keep = pa.array(leaves_open(ra, rb, n, m, threshold / 100))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda x, n, r: classes.select(F.col("node").alias(x), F.col("n").alias(n), F.col("registers").alias(r))
    both = pairs.join(side("a", "na", "ra"), "a").join(side("b", "nb", "rb"), "b")
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def common_shingles(left, right, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two text columns (data, offsets): sizes of the intersection and of the union of their sets."""
    (x, y), n = (shingles(d, o, width) for d, o in (left, right)), len(left[1]) - 1
    d, g = np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])
    by = np.lexsort((g, d))
    d, g = d[by], g[by]
    same = np.bincount(d[1:][(d[1:] == d[:-1]) & (g[1:] == g[:-1])], minlength=n)
    return same, np.bincount(d, minlength=n) - same


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= threshold * union."""

    def run(batches):
        for batch in batches:
            (left, at), (right, to) = K.flat(batch.column(2)), K.flat(batch.column(3))
            found = [np.zeros(0, bool)]
            for x, y, _, _ in K.pieces(left, at + to):
                same, every = common_shingles((left[at[x] : at[y]], at[x : y + 1] - at[x]), (right[to[x] : to[y]], to[x : y + 1] - to[x]), width)
                found.append(100 * same >= threshold * every)
            keep = pa.array(np.concatenate(found))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(K.tidy(run), "a long, b long")


def mixed_bins(bins: DataFrame, label: DataFrame, seeds: list[int]) -> DataFrame:
    """bin, node, n, label of the bins with several components, with ``k`` (their classes) and hub0, hub1, ...: the least
    member (node, n, label) by a hash with each seed."""
    labelled = bins.join(label, "node")
    hub = lambda seed: F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", "bin", F.lit(seed)))
    per = labelled.groupBy("bin").agg(F.count("*").alias("k"), F.min("label").alias("_lo"), F.max("label").alias("_hi"), *(hub(s).alias(f"hub{i}") for i, s in enumerate(seeds)))
    return labelled.join(per.filter("_lo <> _hi").drop("_lo", "_hi"), "bin")


def finer(mixed: DataFrame, texts: DataFrame, tables: C.Tables, width: int, threshold: int, large: int = LARGE) -> DataFrame:
    """``mixed`` (bin, node, label, k, dealt) with the classes of bins of over ``large`` dealt anew by signatures, one of
    which at least two linked classes have in common whatever their other bands."""
    from sentinela.llm import jaccard  # it is built on this module

    big = mixed.filter(F.col("k") > large)
    if not big.limit(1).count():
        return mixed
    some = tables.write(big.select("node", "label").distinct(), "large")
    members = tables.write(jaccard.members_by_signature(texts.join(some.select("node"), "node"), width, threshold), "signed-large")
    again = jaccard.one_of_equal(members, some, 2).select(F.col("sig").alias("bin"), "node", "label", "k", F.lit(True).alias("dealt"))
    return tables.write(mixed.filter(F.col("k") <= large).unionByName(again), "finer")


def open_pairs(bins: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, block: np.ndarray, dealt: np.ndarray, own: np.ndarray, regs: np.ndarray, t: float):
    """Pairs of one unit's classes, between two blocks if there are two, that have different labels and may be linked.

    ``own``: the class's bins. A pair that shares an earlier band meets there, or by a signature if that bin was large and
    the pair is linked; signatures (``dealt``) have no such order.
    """
    two, band = block[0] != block[-1], np.argmax(own == bins[:, None], axis=1)
    for i in range(len(node)):
        ok = (label[i + 1 :] != label[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= np.floor(100 * t) * np.maximum(n[i], n[i + 1 :]))
        if two:
            ok &= block[i + 1 :] != block[i]
        at = np.flatnonzero(ok) + i + 1
        if not dealt[i] and len(at) and band[i]:
            at = at[~(own[at, : band[i]] == own[i, : band[i]]).any(axis=1)]
        if len(at):
            at = at[leaves_open(np.broadcast_to(regs[i], (len(at), BUCKETS)), regs[at], np.full(len(at), n[i]), n[at], t)]
            yield np.full(len(at), node[i]), node[at]


def compared(mixed: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """The open pairs (a, b) of ``mixed`` (bin, node, label, k, dealt), found block by block within tasks."""
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    units = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(F.least(own, i).alias("i"), F.greatest(own, i).alias("j")))
    rows = mixed.select("bin", "node", "label", "dealt", own.alias("block"), F.explode(units).alias("u")).withColumn("unit", F.xxhash64("bin", "u.i", "u.j"))
    tasks = C.bucket_count(mixed.agg(F.sum(blocks)).first()[0] or 0, TASK_ROWS)
    rows = rows.join(classes.select("node", "n", "bins", "registers"), "node")
    rows = rows.select(F.pmod("unit", F.lit(tasks)).alias("task"), "unit", "bin", "node", "label", "n", "block", "dealt", "bins", "registers")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("unit", "ascending"), ("block", "ascending"), ("node", "ascending")])
        unit, bin_, node, label, n, block, dealt = (t.column(c).to_numpy() for c in ("unit", "bin", "node", "label", "n", "block", "dealt"))
        own, regs = K.flat(t.column("bins"))[0].view(np.int64).reshape(-1, BANDS), K.flat(t.column("registers"))[0].reshape(-1, BUCKETS)
        cut = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            found += open_pairs(bin_[x:y], node[x:y], label[x:y], n[x:y], block[x:y], dealt[x:y], own[x:y], regs[x:y], threshold / 100)
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return rows.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, label: the least node reachable. Least-neighbour rounds with pointer jumping, each written out.

    ``nodes`` has (node, label) to start from, a label being the least node that has it; ``links`` (a, b) need only
    be those that join two labels, and act on the labels as wholes.
    """
    tables = C.Tables()
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("label").alias(f"_{x}"))
    roots = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    ends = tables.write(roots.union(roots.select("b", "a")).distinct(), "links")
    label = ends.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()  # of the labels that links touch
    while True:
        known = label.select(F.col("node").alias("b"), F.col("label").alias("_other"))
        near = ends.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("_other").alias("_near"))
        step = label.join(near, "node", "left").select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("label"))
        up = label.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        step = step.join(up, "label", "left").select("node", "_was", F.least("label", F.coalesce("_up", "label")).alias("label"))
        after = tables.write(step, "labels")
        moved = after.filter("label <> _was").limit(1).count()
        label = after.select("node", "label")
        if not moved:
            break
    label = label.select(F.col("node").alias("label"), F.col("label").alias("_now"))
    out = C.materialise(nodes.join(label, "label", "left").select("node", F.coalesce("_now", "label").alias("label")), "labels")
    tables.drop()
    C.give_back(nodes.sparkSession)  # the rounds' plans
    return out


def near_duplicates(docs: DataFrame, width: int = 4, threshold: int = 80, row: str | None = None, large: int = LARGE) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, group of every document (see the module's docstring).

    ``row_key`` identifies the row's doc_id and text, or the row by its column ``row`` (long) if that is given.
    ``group`` is common to the rows of one component, whatever their ids; null without words.
    """
    tables = C.Tables()
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = row_key(doc_id, text) if row is None else row_bytes(F.col(row))
    keyed = docs.select(doc_id.alias("doc_id"), text.alias("text"), key.alias("row_key"))
    signed = tables.write(signatures(keyed.select("doc_id", "row_key", "text"), width), "signed")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", "registers", "bins"))
    classes = signed.filter("n > 0").groupBy("set_key", "n").agg(one.alias("one"), F.min("doc_id").alias("least_id"))
    classes = tables.write(classes.select("set_key", "n", "least_id", "one.row_key", "one.registers", "one.bins", F.monotonically_increasing_id().alias("node")), "classes")
    every = banded(classes)
    several = every.groupBy("bin").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("k")).filter("k > 1").drop("k")
    bins = tables.write(every.join(several, "bin"), "bins")
    involved = bins.select("node").distinct()
    wanted = classes.join(involved, "node").select("node", "row_key")
    texts = tables.write(keyed.select("row_key", "text").join(wanted, "row_key").select("node", "text").dropDuplicates(["node"]), "texts")
    label = involved.select("node", F.col("node").alias("label"))

    def estimated(met: DataFrame) -> DataFrame:
        """The open pairs of classes and hubs (node, n, hub)."""
        met = met.filter((F.col("node") != F.col("hub.node")) & comparable(F.col("n"), F.col("hub.n"), threshold))
        pairs = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
        return tables.write(promising(pairs, classes, threshold), "pairs")

    def contract(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The labels after verifying the pairs."""
        return tables.add(components(tables.write(verified(pairs, texts, width, threshold), "linked"), label))

    label = contract(estimated(bins), label)
    bins = bins.filter("node <> hub.node").select("bin", "node", "n")
    hubs = [f"hub{i}" for i in range(HUBS)]
    mixed = tables.write(mixed_bins(bins, label, list(range(HUBS))), "mixed")
    met = mixed.select("node", "n", "label", F.explode(F.array(*hubs)).alias("hub")).filter("label <> hub.label")
    label = contract(estimated(met), label)
    left = mixed.filter(" and ".join(f"node <> {h}.node" for h in hubs)).select("bin", "node", "n")
    left = tables.write(mixed_bins(left, label, []).select("bin", "node", "label", "k", F.lit(False).alias("dealt")), "left")
    label = contract(tables.write(compared(finer(left, texts, tables, width, threshold, large), classes, threshold), "pairs"), label)
    named = label.join(classes.select("node", "least_id"), "node").groupBy("label").agg(F.min("least_id").alias("component_id"))
    by_class = classes.select("set_key", "n", "node", "least_id").join(label, "node", "left").join(named, "label", "left")
    by_class = tables.write(by_class.select("set_key", "n", F.coalesce("component_id", "least_id").alias("_found"), F.coalesce("label", "node").alias("group")), "named")
    tables.drop(keep=[signed, by_class])
    out = signed.select("doc_id", "row_key", "n", "set_key").join(by_class, ["set_key", "n"], "left")
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("_found", "doc_id").alias("component_id"), "group")


def row_bytes(row):
    return F.unhex(F.lpad(F.hex(row), 16, "0"))


def row_key(doc_id, text):
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("\x00"), text).cast("binary")))


K.ship(__name__)
