"""How published files are laid out, in place of indexes: buckets, clustering by several columns at once, Bloom filters.

A lookup is a plain filter; what it need not read is skipped by the minima and maxima and the Bloom filters of Parquet's
row groups. Files of buckets need no exchange when they are grouped or joined by their column.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of each column in the order of a clustered table, and with how many bins they count.
BITS = 8


@dataclass(frozen=True)
class Clustered:
    """Rows in the order of ``columns``' interleaved bits; ``bloom``: columns looked up by equality; ``rows``: of a file."""

    columns: tuple[str, ...]
    bloom: tuple[str, ...] = ()
    rows: int = 2_000_000
    group_bytes: int = 16 << 20


@dataclass(frozen=True)
class Bucketed:
    """Rows in ``buckets`` files by the hash of ``column``, sorted by it and ``then``."""

    column: str
    buckets: int
    then: tuple[str, ...] = ()
    bloom: tuple[str, ...] = ()


#: The published tables: what their lookups filter by and in what order they are listed.
LAYOUT: dict[str, Clustered | Bucketed] = {
    "dim_fornecedor": Clustered(("faixa_risco", "uf", "score_risco", "qtd_alertas"), ("cnpj", "pk_fornecedor", "max_severidade")),
    "dim_socio": Clustered(("pk_socio",), ("cpf_hmac",)),
    "dim_orgao": Clustered(("codigo",)),
    "dim_sancao": Clustered(("fk_fornecedor", "data_fim"), ("fk_fornecedor",)),
    "bridge_fornecedor_socio": Clustered(("fk_fornecedor", "fk_socio"), ("fk_fornecedor", "fk_socio")),
    "fato_contrato": Bucketed("fk_fornecedor", 64, ("data_assinatura",), ("fk_orgao", "fk_tempo")),
    "fato_doacao": Clustered(("fk_fornecedor", "fk_socio"), ("fk_fornecedor", "fk_socio")),
    "fato_score_detalhe": Clustered(("fk_fornecedor",), ("fk_fornecedor",)),
    "fato_alerta_critico": Clustered(("severidade", "tipo_alerta", "detectado_em", "fk_fornecedor"), ("fk_fornecedor",)),
}


def _number(c: str, kind: T.DataType) -> Column:
    """A double in the order of the column: of a text its first six bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def interleaved(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """A long whose order keeps rows together that are alike in all the columns: bits of each one's rank, by quantiles of
    the whole table (``2**BITS - 1`` numbers a column reach the driver), taken in turn. Null comes first."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = [_number(c, kinds[c]) for c in columns]
    shares = [i / 2**BITS for i in range(1, 2**BITS)]
    found = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"q{i}") for i, x in enumerate(numbers)]).first()
    edges = [np.unique(np.array(found[f"q{i}"] or [], np.float64)) for i in range(len(columns))]

    @F.pandas_udf("long")
    def order(values: pd.DataFrame) -> pd.Series:
        out = np.zeros(len(values), np.int64)
        for i, e in enumerate(edges):
            x = values.iloc[:, i].to_numpy(np.float64)
            rank = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="right") * (2**BITS - 1) // max(1, len(e)))
            for b in range(BITS):
                out |= ((rank >> b) & 1) << (b * len(edges) + len(edges) - 1 - i)
        return pd.Series(out)

    return order(F.struct(*[x.alias(f"c{i}") for i, x in enumerate(numbers)]))


def _writer(df: DataFrame, bloom: tuple[str, ...], distinct: int, group_bytes: int | None):
    w = df.write.option("compression", "zstd").option("parquet.block.size", group_bytes or 16 << 20)
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(max(1, distinct)))
    return w


def write_clustered(df: DataFrame, path: str, how: Clustered) -> None:
    """Rows by ranges of the interleaved order, about ``how.rows`` of them in a file."""
    rows = df.count()
    files = max(1, -(-rows // how.rows))
    bits = interleaved(df, how.columns)
    per_group = min(rows, 200_000)
    placed = df.withColumn("_order", bits).repartitionByRange(files, "_order", *how.columns).sortWithinPartitions("_order", *how.columns).drop("_order")
    _writer(placed, how.bloom, per_group, how.group_bytes).parquet(path)


def write_bucketed(df: DataFrame, path: str, how: Bucketed) -> None:
    """One file a bucket; ``read_bucketed`` opens them."""
    name = f"bucketed_{uuid.uuid4().hex}"
    own = df.repartition(how.buckets, how.column)  # the hash of the buckets, so that each task writes one of them
    _writer(own, how.bloom, 200_000, None).format("parquet").bucketBy(how.buckets, how.column).sortBy(how.column, *how.then).option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str, how: Bucketed) -> DataFrame:
    """The table of ``write_bucketed``: grouping and joining by its column take no exchange."""
    name = f"bucketed_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        order = ", ".join((how.column, *how.then))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({how.column}) SORTED BY ({order}) INTO {how.buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write(df: DataFrame, path: str, how: Clustered | Bucketed) -> None:
    (write_bucketed if isinstance(how, Bucketed) else write_clustered)(df, path, how)


def read(spark: SparkSession, path: str, how: Clustered | Bucketed | None) -> DataFrame:
    return read_bucketed(spark, path, how) if isinstance(how, Bucketed) else spark.read.parquet(path)


def scanned_rows(df: DataFrame) -> int:
    """Run a plan and say how many rows its scans let through: those of the row groups and pages that were read."""
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    plan.executeCollect()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
