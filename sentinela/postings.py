"""Substring search by trigrams: a table of postings in the order of the trigrams, whose rarest ones of a search are
intersected and then verified. A search reads the row groups of its trigrams; texts under three characters scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rarest trigrams of a search that are intersected; what is verified hardly shrinks by more.
RAREST = 4


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, in code points; none of a null or shorter text."""
    t = F.lower(text)
    some = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, 3)))
    return F.when(F.length(t) >= 3, some).otherwise(F.array().cast("array<string>"))


def build(rows: DataFrame, key: str, fields: list[str], path: str, per_file: int = 5_000_000) -> None:
    """Write ``path``/postings (campo, gram, key), ranged and sorted by all three, so that a frequent trigram takes many
    files, and ``path``/counts (campo, gram, n)."""
    each = None
    for f in fields:
        one = rows.select(F.lit(f).alias("campo"), F.col(key).alias("key"), F.explode(grams(F.col(f))).alias("gram"))
        each = one if each is None else each.unionByName(one)
    each = each.select("campo", "gram", "key").distinct()
    counts = each.groupBy("campo", "gram").agg(F.count("*").alias("n"))
    _write(counts, f"{path}/counts", 1, ["campo", "gram"])
    n = rows.sparkSession.read.parquet(f"{path}/counts").agg(F.sum("n")).first()[0] or 0
    _write(each, f"{path}/postings", max(1, -(-n // per_file)), ["campo", "gram", "key"])


def _write(df: DataFrame, path: str, files: int, order: list[str]) -> None:
    placed = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
    placed.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)


def candidates(spark: SparkSession, path: str, field: str, text: str) -> DataFrame | None:
    """key: rows whose field has the rarest trigrams of the text; None if the text is too short for one. Only the
    trigrams of the text itself, and their counts, reach the driver."""
    mine = spark.range(1).select(grams(F.lit(text))).first()[0]
    if not mine:
        return None
    known = spark.read.parquet(f"{path}/counts").filter((F.col("campo") == field) & F.col("gram").isin(mine)).collect()
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("campo") == field)
    if len(known) < len(mine):
        return postings.filter(F.lit(False)).select("key")
    rare = [r.gram for r in sorted(known, key=lambda r: (r.n, r.gram))[:RAREST]]
    return postings.filter(F.col("gram").isin(rare)).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("key")


def search(rows: DataFrame, key: str, fields: dict[str, bool], path: str, text: str) -> DataFrame:
    """The rows one of whose ``fields`` (name: whether any case matches) contains the text; every row for an empty text."""
    hit = F.lit(False)
    for f, any_case in fields.items():
        hit = hit | (F.lower(f).contains(F.lower(F.lit(text))) if any_case else F.col(f).contains(text))
    found = None
    for f in fields:
        one = candidates(rows.sparkSession, path, f, text)
        if one is None:
            return rows.filter(hit)
        found = one if found is None else found.unionByName(one)
    return rows.join(found.select(F.col("key").alias(key)), key, "left_semi").select(*rows.columns).filter(hit)
