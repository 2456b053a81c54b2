"""Mixing sources to target weights (operator 10), DataFrame functions only.

Every source is a line of words, its documents one after the other in a keyed pseudorandom order, cut into blocks
of ``block`` words. Output shards of ``shard_slots`` slots draw how many of their slots each source fills: multinomial
draws under the condition that they add up to the targets, which independent draws would miss by the root of a source's
slots. The k-th slot of a source takes block ``permutation(k mod blocks)`` of pass ``k div blocks``; slots and blocks
are then joined by index. Slots past a source's third pass, which only rounding can bring, stay void: nothing is taken
more than ``most`` times.

Defined results: a null or blank text has size 0 and is never taken; sources are ordered by code point with null
last, null being a source of its own; repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it, the last one also with what follows.
SPACED = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++\z)?"
WEIGHTS = (5, 2, 1)
BLOCK = 128
SHARD_SLOTS = 1024
MOST = 3
ROUNDS = 12
SLOTS_PER_TASK = 65_536
#: Cells of [0, 1) by which shares are looked up; sources up to which their table is broadcast.
CELLS, FEW_SOURCES = 1 << 12, 10_000


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A keyed bijection of 0..n-1 for any n (swap-or-not): each round reflects index at a keyed point, or not."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) - x, n)
        return F.when(F.xxhash64(*key, r, F.greatest(x, other), F.lit("swap")) % 2 == 0, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), lambda x, r: step(x, r).cast("long"))


def sized(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """_row, doc_id, source, size, _hash (of the text): one row per document, written so that _row names a row for good
    (``row``, if given)."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(row.alias("_row"), F.col("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above ``most`` times its source's size.

    Sharing the excess anew until none is above is a water level: sources in order of most * size / weight are
    full until the level of the rest is below the next one's limit.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumn("_w", w.cast("double")).withColumn("_limit", most * F.col("source_size") / F.col("_w"))
    by_limit = Window.orderBy("_limit", F.col("source").asc_nulls_last())
    earlier, later = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum(most * F.col("source_size")).over(earlier), F.lit(0))
    per = per.withColumn("_level", (F.sum("source_size").over(everything) - full) / F.sum("_w").over(later))
    level = F.max(F.when(F.col("_level") <= F.col("_limit"), F.col("_level"))).over(everything)
    target = F.least(level * F.col("_w"), (most * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def draws(wanted: DataFrame, seed: int, block: int, shard_slots: int) -> DataFrame:
    """shard, _key, blocks, _k: the source that each slot of each shard draws, as the source's ``_k``-th slot.

    A keyed permutation of all slots deals them to the sources: the shards' counts are multinomial draws under the
    condition that they add up to every source's target. Sources are looked up by cells of the permuted numbers, in
    which each stands once; that table is broadcast only if it is small.
    """
    src = wanted.filter("source_size > 0 and target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    src = src.withColumn("_n", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).withColumn("_key", F.coalesce("source", F.lit("\x00null")))
    n, sources = src.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    src = src.filter("_n > 0").withColumn("_to", F.sum("_n").over(Window.orderBy("_key"))).withColumn("_from", F.col("_to") - F.col("_n"))
    width = max(1, -(-n // CELLS))
    cell = lambda x: F.floor(x / width).cast("long")
    shares = src.select("_key", "blocks", "_from", "_to", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to") - 1))).alias("cell"))
    if sources <= FEW_SOURCES:
        shares = F.broadcast(shares)  # at most FEW_SOURCES + CELLS rows
    x = permuted(F.col("id"), F.lit(n), F.lit(seed), F.lit("slots"))
    slots_ = wanted.sparkSession.range(0, n, 1, C.bucket_count(n, SLOTS_PER_TASK)).select(F.floor(F.col("id") / shard_slots).alias("shard"), x.alias("_x"))
    drawn = slots_.withColumn("cell", cell(F.col("_x"))).join(shares, "cell").filter("_x >= _from and _x < _to")
    return drawn.select("shard", "_key", "blocks", (F.col("_x") - F.col("_from")).alias("_k"))


def slots(wanted: DataFrame, seed: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most: int = MOST) -> DataFrame:
    """shard, _key (the source), pass, block: what each slot of the mix holds."""
    k = draws(wanted, seed, block, shard_slots).withColumn("pass", F.floor(F.col("_k") / F.col("blocks")).cast("long")).filter(F.col("pass") < most)
    at = permuted(F.pmod(F.col("_k"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("_key"), F.col("pass"))
    return k.select("shard", "_key", "pass", at.alias("block"))


def drawn_blocks(base: DataFrame, wanted: DataFrame, seed: int, block: int, shard_slots: int, most: int) -> DataFrame:
    """_row, block, _from, _here, _times: the words (first and number) that documents have in drawn blocks, and how often."""
    rows = base.count()
    line = base.withColumn("_key", F.coalesce("source", F.lit("\x00null")))
    spread = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_hash")), F.lit(C.bucket_count(rows, 10_000)))
    line = C.running_total(line, ["_key"], ["doc_id", "_hash"], spread, F.col("size"), "_at").filter("size > 0")
    reach = F.sequence(F.floor(F.col("_at") / block).cast("long"), F.floor((F.col("_at") + F.col("size") - 1) / block).cast("long"))
    part = line.select("_row", "_key", "_at", "size", F.explode(reach).alias("block"))
    start = F.greatest(F.col("_at"), F.col("block") * block)
    here = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * block) - start
    part = part.select("_row", "_key", "block", (start - F.col("_at")).alias("_from"), here.alias("_here"))
    used = slots(wanted, seed, block, shard_slots, most).groupBy("_key", "block").agg(F.count("*").alias("_times"))
    return part.join(used, ["_key", "block"]).drop("_key")


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document (see the module's docstring)."""
    base = C.materialise(sized(docs), "sized")
    wanted = C.materialise(targets(base, weights, most), "targets")
    taken = drawn_blocks(base, wanted, seed, block, shard_slots, most).groupBy("_row").agg(F.sum(F.col("_here") * F.col("_times")).alias("_taken"))
    by_source = wanted.select(F.coalesce("source", F.lit("\x00null")).alias("_key"), "source_size", "target")
    out = base.join(taken, "_row", "left").withColumn("_key", F.coalesce("source", F.lit("\x00null"))).join(by_source, "_key")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def mixed_texts(docs: DataFrame, seed: int = 7, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """What the mix takes, as rows of ``docs``: every run of neighbouring blocks of a document that one pass takes.

    A row's text is that part of its document (white space goes with the word after it, at the end of a text with
    the word before it), so each source has just the words that ``mix`` takes. Where a pass takes all of a document,
    its text is the whole text. ``docs`` may repeat rows and ids.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = C.materialise(docs.select(F.struct(*columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    base = C.materialise(sized(rows.select("_doc.*", F.col("_row").alias(C.unused(docs, "_row")[0])), F.col(C.unused(docs, "_row")[0])), "sized")
    wanted = C.materialise(targets(base, weights, most), "targets")
    taken = drawn_blocks(base, wanted, seed, block, shard_slots, most).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("block", "_from", "_here", "_times"))).alias("_blocks"))

    def runs(own: Column) -> Column:
        """first, n: the words of each run of neighbours in one pass's blocks."""
        begin = F.filter(own, lambda x, i: (i == 0) | (F.get(own, i - 1)["block"] < x["block"] - 1))
        end = F.filter(own, lambda x, i: (i == F.size(own) - 1) | (F.get(own, i + 1)["block"] > x["block"] + 1))
        return F.zip_with(begin, end, lambda b, e: F.struct(b["_from"].cast("int").alias("first"), (e["_from"] + e["_here"] - b["_from"]).cast("int").alias("n")))

    def in_pass(p: int) -> Column:
        return F.filter("_blocks", lambda x: x["_times"] > p)

    passes = [_let(in_pass(p), runs) for p in range(most)]
    taken = taken.select("_row", F.concat(*passes).alias("_runs"))
    text = F.col("_doc.text").cast("string")
    cut = _let(F.regexp_extract_all(text, F.lit(SPACED), F.lit(0)), lambda w: F.transform("_runs", lambda r: F.array_join(F.slice(w, r["first"] + 1, r["n"]), "")))
    cut = F.when(F.forall("_runs", lambda r: r["n"] == F.col("size")), F.transform("_runs", lambda r: text)).otherwise(cut)
    out = rows.join(taken.join(base.select("_row", "size"), "_row"), "_row").select("_doc", F.explode(cut).alias("_text"))
    return out.select(*(F.col("_text").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns))
