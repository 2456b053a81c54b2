"""Source divergence audit (operator 13): how far the word use of a language's sources lies apart, and in which terms.

Each language keeps the terms in at least ``least_docs`` of its documents. A group, a source of a language or the language
itself, gives a kept term p = 1 + floor(SCALE * (count + 2) / (N + 2V)); two groups differ in a term by
floor((p - q)^2 / (p + q)). Whole numbers throughout.

* Pairs of sources. A term that a source lacks has the source's baseline p0, so a pair's sum over all V terms is V times
  the baselines' difference, corrected where a term occurs: by a term for each source alone, which only depends on the
  term's p and so comes from a histogram of p, and one for terms that both have, from a join on the term. Nothing is
  made for terms that neither has.
* Terms of a source, by radix selection: histograms of the value's bits, ``DIGIT`` bits a pass from the highest, find in
  each group the digit in which its k-th value lies; rows above are in, rows below out, the rest goes to the next pass.
  Rows that tie at the k-th value are refined in the same way by two UTF-8 bytes a pass. No group is ever sorted whole.

Defined results: null text, lang and source count as ''; texts without terms still make their group; a language without
kept terms has pairs of value 0 and no terms; repeated rows count each; an empty table gives no rows; other columns are
not looked at.
"""

from __future__ import annotations

import collections

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm import common as C
from sentinela.llm import kernels as K

#: Letters and all bytes of code points beyond ASCII, A-Z lower-cased; all else is a blank.
TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE = 1_000_000_000
#: Bits of a value per pass; values are below 2**33, since no p exceeds SCALE + 1.
DIGIT, SHIFTS = 11, (22, 11, 0)
#: Distinct terms that a task holds before it passes their counts on.
HELD = 200_000
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), d (documents with it), summed up within the task as far as it holds."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("c", pa.int64()), ("d", pa.int64())])

    def run(batches):
        held: dict[tuple, dict] = {}
        n = 0

        def out():
            for (lang, source), terms in held.items():
                both = list(terms.values())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(both)), pa.array([source] * len(both)), pa.array([t.decode() for t in terms]), pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())], schema=schema)

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = held.setdefault((lang, source), {})
                n -= len(terms)
                for t, c in collections.Counter(text.translate(TERM).split()).items():
                    have = terms.get(t)
                    if have is None:
                        terms[t] = [c, 1]
                    else:
                        have[0] += c
                        have[1] += 1
                n += len(terms)
                if n >= HELD:
                    yield from out()
                    held, n = {}, 0
        yield from out()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, c long, d long")


def weight(count: Column, total: Column) -> Column:
    """p of a count, where ``total`` is N + 2V."""
    whole = F.lit(SCALE).cast("decimal(38,0)") * (count + 2).cast("decimal(19,0)")
    return F.call_function("div", whole, total.cast("decimal(38,0)")).cast("long") + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def cut(rows: DataFrame, digit: Column, largest: bool, tables: C.Tables) -> tuple[DataFrame, DataFrame, bool]:
    """One pass over rows (lang, source, item, value, need): those that are in, those still open with what their group
    still needs, and whether a group has more open rows than that."""
    keyed = rows.withColumn("_digit", digit)
    hist = keyed.groupBy(*GROUP, "_digit").agg(F.count("*").alias("_n"), F.first("need").alias("need"))
    order = Window.partitionBy(*GROUP).orderBy(F.col("_digit").desc() if largest else F.col("_digit"))
    hist = hist.withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hist = hist.filter(F.col("_upto") - F.col("_n") < F.col("need"))  # digits that reach into the first ``need``
    hist = hist.withColumn("_left", F.col("need") - F.col("_upto") + F.col("_n")).drop("need", "_upto")
    kept = tables.write(keyed.drop("need").join(hist, [*GROUP, "_digit"]).drop("_digit"), "digits")
    names = [*GROUP, "item", "value"]
    inside = kept.filter("_n <= _left").select(*names)
    still = kept.filter("_n > _left").select(*names, F.col("_left").alias("need"))
    return inside, still, still.limit(1).count() > 0


def largest_items(rows: DataFrame, k: int, tables: C.Tables) -> DataFrame:
    """The ``k`` rows of each group (lang, source) with the largest value, ties by the item's UTF-8 bytes, with their rank."""
    rows, found, more = rows.select(*GROUP, "item", "value", F.lit(k).cast("long").alias("need")), None, True

    def take(digit, largest):
        nonlocal rows, found, more
        inside, rows, more = cut(rows, digit, largest, tables)
        found = inside if found is None else found.unionByName(inside)

    for shift in SHIFTS:
        if more:
            take(F.shiftright("value", shift).bitwiseAND(F.lit((1 << DIGIT) - 1)), True)
    at = 1
    while more:  # items of a group differ, so this ends with the longest prefix that tied ones share
        raw = F.col("item").cast("binary")
        byte = lambda i: F.when(F.length(raw) >= i, F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int") + 1).otherwise(0)  # noqa: B023, E731
        take(byte(at) * 257 + byte(at + 1), False)
        at += 2
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language, in both orders. ``kept`` has p and p0 of each count,
    ``groups`` lang, source, v, p0."""
    first = kept.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za"))
    second = kept.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("zb"))
    p, q, y, z = (F.col(c) for c in ("pa", "pb", "za", "zb"))
    common = first.join(second, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b")
    common = common.agg(F.sum(apart(p, q) - apart(p, z) - apart(y, q) + apart(y, z)).alias("value"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("zb"))
    alone = kept.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("za")).agg(F.count("*").alias("n"))
    alone = alone.join(other, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("n") * (apart(p, z) - apart(y, z))).alias("value"))
    base = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("za"), "v").join(other, "lang").filter("a < b")
    base = base.select("lang", "a", "b", F.when(F.col("v") > 0, F.col("v") * apart(y, z)).otherwise(0).alias("value"))
    parts = base.unionByName(common).unionByName(alone.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value"))
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("r"), "value").select("lang", "r.source", "r.item", "value")


def audit(docs: DataFrame, least_docs: int = 10, most_terms: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank (see the module's docstring)."""
    tables = C.Tables()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    dealt = term_counts(docs).repartition("lang", "term")  # one shuffle for sums and for the language's own counts
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    of_term = Window.partitionBy("lang", "term")
    sums = sums.select("lang", "source", "term", "c", F.sum("c").over(of_term).alias("cl"), F.sum("d").over(of_term).alias("dl"), (F.col("source") == F.min("source").over(of_term)).alias("once"))
    counts = tables.write(sums.filter(F.col("dl") >= least_docs).drop("dl"), "counts")
    per = counts.groupBy(*GROUP).agg(F.sum("c").alias("n"), F.sum(F.col("once").cast("long")).alias("v"))
    every = docs.select(*GROUP).distinct().join(per, GROUP, "left").fillna(0, ["n", "v"])
    of_lang = Window.partitionBy("lang")  # a row per source
    groups = every.withColumns({"v": F.sum("v").over(of_lang), "nl": F.sum("n").over(of_lang)})
    groups = groups.select("lang", "source", "v", (F.col("n") + 2 * F.col("v")).alias("total"), (F.col("nl") + 2 * F.col("v")).alias("total_lang"))
    groups = tables.write(groups.withColumn("p0", F.when(F.col("v") > 0, weight(F.lit(0).cast("long"), F.col("total"))).otherwise(1)), "groups")
    kept = counts.join(groups.drop("v"), GROUP).select("lang", "source", "term", "p0", weight(F.col("c"), F.col("total")).alias("p"), weight(F.col("cl"), F.col("total_lang")).alias("q"))
    kept = tables.write(kept, "kept")
    pairs = pair_values(kept, groups)
    ranked = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")  # a row per other source
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    over = kept.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    terms = largest_items(over, most_terms, tables).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    out = tables.write(pairs.unionByName(terms), "divergence")
    tables.drop(keep=[out])
    return out


K.ship(__name__)
