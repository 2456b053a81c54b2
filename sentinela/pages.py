"""Pages of a sorted table without sorting it for each: files hold consecutive rows, a small table says which rows of the
order each has, and a page reads the files that it lies in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentinela import durable

#: Columns of the order: (name, whether descending). No null among them; together they tell rows apart.
Order = list[tuple[str, bool]]


def _sorted(order: Order) -> list:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def write(df: DataFrame, path: str, order: Order, rows: int = 2_000_000) -> None:
    """``path``/rows in about ``rows`` a file, and ``path``/files: part, n, start, and the last row's key."""
    df = durable.materialise(df, "page-rows")  # else it is computed to be counted, to find the ranges, and to be written
    total = df.count()
    files = max(1, -(-total // rows))
    placed = df.repartitionByRange(files, *_sorted(order)).withColumn("_part", F.spark_partition_id())
    placed = placed.sortWithinPartitions("_part", *_sorted(order)).withColumn("_at", F.monotonically_increasing_id())
    # an empty table has no folder of a part; its one file keeps the columns
    placed.write.option("compression", "zstd").partitionBy(*(["_part"] if total else [])).parquet(f"{path}/rows")
    spark = df.sparkSession
    key = F.struct(*[c for c, _ in order])
    each = spark.read.parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("n"), F.max_by(key, "_at").alias("last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    durable.discard(df)
    each.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/files")


def _of(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").filter(F.col("_part").isin(parts) if parts else F.lit(False))


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """The page by number, from 0: the rows ``number * size`` and following of the whole order; none past the end."""
    low = number * size
    files = spark.read.parquet(f"{path}/files").filter((F.col("start") < low + size) & (F.col("start") + F.col("n") > low)).orderBy("start").collect()
    rows = _of(spark, path, [f["_part"] for f in files]).orderBy("_at")
    return rows.offset(low - files[0]["start"] if files else 0).limit(size).drop("_part", "_at")


def _behind(order: Order, key: tuple, of=lambda c: F.col(c)):
    """Whether a row lies behind the key in the order."""
    out, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(order, key, strict=True):
        out = out | (same & (of(c) < F.lit(v) if down else of(c) > F.lit(v)))
        same = same & (of(c) == F.lit(v))
    return out


def after(spark: SparkSession, path: str, order: Order, key: tuple, size: int) -> DataFrame:
    """The page that follows the row with this key: it stays right when rows before it come or go."""
    files = spark.read.parquet(f"{path}/files").filter(_behind(order, key, lambda c: F.col(f"last.{c}")))
    first = files.orderBy("start").first()
    if first is None:
        return _of(spark, path, []).drop("_part", "_at")
    near = files.filter(F.col("start") < first["start"] + first["n"] + size).select("_part").collect()
    return _of(spark, path, [f["_part"] for f in near]).filter(_behind(order, key)).orderBy("_at").limit(size).drop("_part", "_at")
