"""Plan helpers shared by the operators: what they write on their way, two-level ranks and bucket counts."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela.durable import discard, materialise


class Tables:
    """What an operator has written on its way, to be removed when nothing that is still to run reads it."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.add(materialise(df, name))

    def add(self, written: DataFrame) -> DataFrame:
        self.frames.append(written)
        return written

    def drop(self, keep: list[DataFrame] = ()) -> None:
        """Discard all but ``keep``: those that the result, which is lazy, still reads."""
        for df in self.frames:
            if not any(df is k for k in keep):
                discard(df)
        self.frames = list(keep)


def give_back(spark: SparkSession) -> None:
    """Collect, in the driver's Python and then in its JVM, plans and task records that nothing refers to any more. After
    hundreds of stages they are most of the heap, which the JVM would let grow to its limit first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, *names: str) -> list[str]:
    """These column names, each with underscores in front until ``df`` has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def held_out(doc_id: Column | str, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod 5 is ``remainder``; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_count(rows: int, per_bucket: int) -> int:
    """How many buckets hold about ``per_bucket`` rows each."""
    return max(1, -(-rows // per_bucket))


def running_total(df: DataFrame, group: list[str], order: list[str], bucket: Column, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before this one.

    Two levels, so that no group meets in one task: buckets of a group are summed first, a window runs over
    those sums only, then over the rows of one bucket. ``bucket`` spreads a group evenly; the order is by
    bucket, then ``order``. Null group keys form one group.
    """
    keyed = df.withColumn("_b", bucket).withColumn("_v", value)
    sums = keyed.groupBy(*group, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_bb"), "_base")
    on = F.col("_b") == F.col("_bb")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = keyed.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    drop = ["_b", "_v", "_w", "_bb", "_base", *[f"_g{i}" for i in range(len(group))]]
    return keyed.join(sums, on).withColumn(out, (F.col("_base") + F.col("_w")).cast("long")).drop(*drop)
