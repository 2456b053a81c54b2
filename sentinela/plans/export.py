"""The dossier as sorted lines in files: no list of a supplier's rows is ever built, so none is too long.

A line has the supplier, the section's place and name, its text, and a key that tells equal lines apart. The files split
the whole order ``ORDER`` into ranges, so a supplier with very many contracts spans files, and reading one supplier opens
the row groups whose least and greatest number enclose it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["cnpj", "ordem", "linha", "chave"]
SCHEMA = "cnpj string, ordem int, secao string, linha string, chave long"
#: What the first section says of a supplier.
HEAD = {"CNPJ": "cnpj", "Razao Social": "razao_social", "Data Abertura": "data_abertura", "Capital Social": "capital_social", "CNAE": "cnae_principal"}
#: The other sections: name, table, fields of a line, key.
SECTIONS = [
    ("SCORE DE RISCO", "scores", ["indicador", "peso", "descricao"], None),
    ("ALERTAS CRITICOS", "alerts", ["tipo_alerta", "severidade", "descricao"], None),
    ("CONTRATOS", "contracts", ["valor", "data_assinatura", "objeto"], "pk_contrato"),
    ("SOCIOS", "partners", ["nome_socio", "is_servidor_publico", "orgao_lotacao"], "pk_socio"),
]


def _text(c):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def lines(tables) -> DataFrame:
    """cnpj, ordem, secao, linha, chave of every supplier.

    ``tables`` has suppliers, scores, alerts, contracts and partners. Null fields are empty; rows of no supplier are left
    out; repeated rows give a line each; a supplier without rows has its first section only.
    """
    head = F.array(*[F.struct(F.lit(i).cast("long").alias("chave"), F.concat(F.lit(f"{label},"), _text(c)).alias("linha")) for i, (label, c) in enumerate(HEAD.items())])
    out = tables.suppliers.select("cnpj", F.inline(head)).select("cnpj", F.lit(0).alias("ordem"), F.lit("DADOS CADASTRAIS").alias("secao"), "linha", "chave")
    own = tables.suppliers.select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnpj")
    for i, (section, table, fields, key) in enumerate(SECTIONS, start=1):
        chave = F.col(key).cast("long") if key else F.lit(None).cast("long")
        rows = getattr(tables, table).select("fk_fornecedor", F.concat_ws(",", *[_text(f) for f in fields]).alias("linha"), chave.alias("chave"))
        out = out.unionByName(rows.join(own, "fk_fornecedor").select("cnpj", F.lit(i).alias("ordem"), F.lit(section).alias("secao"), "linha", "chave"))
    return out


def write(rows: DataFrame, path: str, files: int) -> None:
    """Write lines to so many files, each a range of the order."""
    rows.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER).write.parquet(path)


def read(spark: SparkSession, path: str, cnpj: str | None = None) -> DataFrame:
    """The lines of all suppliers, or those of one, in order."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return rows if cnpj is None else rows.filter(F.col("cnpj") == cnpj).orderBy(*ORDER)
