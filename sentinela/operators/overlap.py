"""Which members of a group have sets of items that overlap most: an overlap join by prefixes, with no pairs of a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela import durable

#: Members of a block: a larger set of rows with one group and item is met in blocks of its left side.
BLOCK = 1000
#: Classes of a group up to which all its pairs are looked at, at most FEW - 1 for each member; larger ones meet by prefixes.
FEW = 8


def prefixes(items: DataFrame, least: int) -> DataFrame:
    """``items`` (member, item; distinct) without each member's ``least - 1`` most frequent ones. Two members with
    ``least`` items in common have at least one in common here, since both drop by one order of all items."""
    often = items.groupBy("item").agg(F.count("*").alias("often"))
    most = Window.partitionBy("member").orderBy(F.col("often").desc(), F.col("item").desc())
    drop = items.join(often, "item").withColumn("rank", F.row_number().over(most)).filter(F.col("rank") < least)
    return items.join(drop.select("member", "item"), ["member", "item"], "left_anti")


def candidates(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """a < b: members that share a group and an item of ``keyed`` (group, item, member). What one group and item hold is
    dealt by hash into blocks, each of which meets all of them in a task of its own."""
    many = keyed.groupBy("group", "item").agg(F.count("*").alias("k")).filter("k > 1")
    rows = keyed.join(many, ["group", "item"]).withColumn("blocks", F.ceil(F.col("k") / block).cast("int"))
    left = rows.select("group", "item", F.col("member").alias("a"), F.pmod(F.xxhash64("member"), "blocks").cast("int").alias("block"))
    right = rows.select("group", "item", F.col("member").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["group", "item", "block"]).filter("a < b").select("a", "b").distinct()


def most_shared(items: DataFrame, groups: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """member, n: the most items that a member has in common with another member of one of its groups, if at least
    ``least`` (2 or more). ``items``: member, item; ``groups``: group, member; rows with a null are left out, repeated
    ones count once.

    Members of a group with the same items (told by number and two 64-bit hashes) are one class: all of them have all
    items in common, and only the class's first member meets those of other sets.
    """
    items = durable.materialise(items.select("member", "item").dropna().distinct(), "items")  # read six times below
    groups = groups.select("group", "member").dropna().distinct()
    sets = items.groupBy("member").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("item")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("g")).filter(F.col("size") >= least)
    of = groups.join(sets, "member")
    classes = of.groupBy("group", "size", "h", "g").agg(F.min("member").alias("member"), F.count("*").alias("members"))
    alike = of.join(classes.filter("members > 1").drop("member"), ["group", "size", "h", "g"]).select("member", F.col("size").alias("n"))
    crowd = classes.groupBy("group").agg(F.count("*").alias("c")).filter("c > 1")
    firsts = durable.materialise(classes.join(crowd, "group").select("group", "member", "c"), "firsts")  # read four times below
    busy = items.join(firsts, "member", "left_semi")
    few, many = (firsts.filter(F.col("c") <= FEW).select("group", "member"), firsts.filter(F.col("c") > FEW).select("group", "member"))
    pairs = few.withColumnRenamed("member", "a").join(few.withColumnRenamed("member", "b"), "group").filter("a < b").select("a", "b")
    if many.limit(1).count():
        pairs = pairs.unionByName(candidates(many.join(prefixes(items.join(many, "member", "left_semi"), least), "member"), block))
    pairs = pairs.distinct()
    size = sets.select("member", "size")
    pairs = pairs.join(size.select(F.col("member").alias("a"), F.col("size").alias("_a")), "a").join(size.select(F.col("member").alias("b"), F.col("size").alias("_b")), "b")
    lesser = F.col("_a") <= F.col("_b")
    pairs = pairs.select(F.when(lesser, F.col("a")).otherwise(F.col("b")).alias("member"), F.when(lesser, F.col("b")).otherwise(F.col("a")).alias("other"))
    met = pairs.join(busy, "member").join(busy.select(F.col("member").alias("other"), "item"), ["other", "item"], "left_semi")
    met = met.groupBy("member", "other").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    each = met.select(F.explode(F.array("member", "other")).alias("member"), "n").unionByName(alike)
    return each.groupBy("member").agg(F.max("n").alias("n"))
