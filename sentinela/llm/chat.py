"""Chat formatting (operator 6), DataFrame functions only: collapse cumulative snapshots, then render.

A conversation's turns, in order, give rolling prefix hashes (two 64-bit hashes of role, text and place, folded
turn by turn). A conversation whose whole hash is the prefix hash of a longer one was logged on the way to it and
goes (anti-join); of equal conversations the least id stays. What is left is rendered.

Defined results: null roles and texts count as empty; turns are ordered by turn, then role and text (null turns
first); repeated rows are repeated turns; a null conv_id is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela.llm import common as C


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, length, at, role, text and the hashes a, b of the turns up to each."""
    line = Window.partitionBy("conv_id").orderBy(F.col("turn"), "role", "text")
    kept = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = kept.withColumn("at", F.row_number().over(line)).withColumn("length", F.count("*").over(Window.partitionBy("conv_id")))
    for name, salt in (("a", "one"), ("b", "two")):
        at = at.withColumn(f"_{name}", F.xxhash64(F.lit(salt), "at", "role", F.lit("\x00"), "text", F.lit(salt)))
    fold = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return at.withColumn("a", F.bit_xor("_a").over(fold)).withColumn("b", F.bit_xor("_b").over(fold)).drop("_a", "_b", "turn")


def maximal(turns: DataFrame) -> DataFrame:
    """The turns (conv_id, at, role, text, length, copies) of the conversations that no longer one begins with."""
    hashed = C.materialise(prefix_hashes(turns), "prefixes")
    whole = hashed.filter(F.col("at") == F.col("length")).groupBy("length", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = hashed.filter(F.col("at") < F.col("length")).select(F.col("at").alias("length"), "a", "b").distinct()
    stay = C.materialise(whole.join(inner, ["length", "a", "b"], "left_anti").select(F.col("conv_id").alias("_id"), "copies"), "maximal")
    return hashed.join(stay, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "at", "role", "text", "length", "copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered: turns as ``<|role|>`` lines, closed by ``<|end|>``."""
    one = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("<|end|>\n"))
    rows = turns.groupBy("conv_id").agg(F.max("length").cast("long").alias("n_turns"), F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("at", one.alias("line")))).alias("_lines"))
    return rows.select("conv_id", "n_turns", "copies", F.array_join("_lines.line", "").alias("rendered"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    return render(maximal(turns))
