"""Incremental intake: contract windows that arrive as files are appended to staging exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sentinela.sources import CONTRACT_SCHEMA


def take_in_contracts(spark: SparkSession, directory: str, out: str, checkpoint: str):
    """Append what is new in ``directory`` to the table ``out`` and stop; ``checkpoint`` remembers what was taken."""
    rows = spark.readStream.schema(CONTRACT_SCHEMA).parquet(directory).filter(F.col("cnpj_fornecedor").isNotNull() & (F.col("valor") > 0))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
