"""Totals of agencies from partial sums that merge: a row per agency, month and bucket of supplier keys, whose bitmap says
which suppliers occur. New contracts are added as a lot of files; nothing that is stored is read again for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The month of contracts without a day.
NO_MONTH = "0000-00"


def partials(contracts: DataFrame) -> DataFrame:
    """fk_orgao, mes, balde, qtd, total, bits: contracts by agency, month and bucket of 32,768 supplier keys (null: no
    supplier). Keys are those of the supplier dimension, which are dense, so a bitmap is well filled in large agencies."""
    month = F.coalesce(F.date_format("data_assinatura", "yyyy-MM"), F.lit(NO_MONTH))
    key = F.col("fk_fornecedor")
    # a row a supplier first: the bitmaps are then made of few rows, however many contracts a hot agency has
    each = contracts.groupBy("fk_orgao", month.alias("mes"), "fk_fornecedor").agg(F.count("*").alias("qtd"), F.sum("valor").alias("total"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(key))
    return each.groupBy("fk_orgao", "mes", F.bitmap_bucket_number(key).alias("balde")).agg(F.sum("qtd").alias("qtd"), F.sum("total").cast("decimal(28,2)").alias("total"), bits.alias("bits"))


def add(contracts: DataFrame, path: str, lot: str) -> None:
    """Store the partials of new contracts under the name of their lot; the same lot again replaces itself only."""
    partials(contracts).withColumn("lote", F.lit(lot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("lote", "mes").parquet(path)


def totals(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """fk_orgao, qtd_contratos, total_contratado, qtd_fornecedores (exact) of the months from ``first`` to ``last``, whose
    folders alone are read; contracts without a day count only if neither is given."""
    rows = spark.read.schema("fk_orgao long, balde long, qtd long, total decimal(28,2), bits binary, lote string, mes string").parquet(path)
    if first is not None or last is not None:
        rows = rows.filter(F.col("mes") > NO_MONTH)
    if first is not None:
        rows = rows.filter(F.col("mes") >= first)
    if last is not None:
        rows = rows.filter(F.col("mes") <= last)
    known = F.when(F.col("balde").isNotNull(), F.bitmap_count("bits")).otherwise(0)
    merged = rows.groupBy("fk_orgao", "balde").agg(F.sum("qtd").alias("qtd"), F.sum("total").alias("total"), F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy("fk_orgao").agg(F.sum("qtd").alias("qtd_contratos"), F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(28,2)").alias("total_contratado"), F.sum(known).alias("qtd_fornecedores"))


def summary(totals: DataFrame, agencies: DataFrame) -> DataFrame:
    """Every agency with its totals, zeros where it has none."""
    own = totals.withColumnRenamed("fk_orgao", "pk_orgao")
    zero = {c: F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (("qtd_contratos", "long"), ("total_contratado", "decimal(28,2)"), ("qtd_fornecedores", "long"))}
    return agencies.select("pk_orgao", "codigo", "nome").join(own, "pk_orgao", "left").select("codigo", "nome", *zero.values())
