"""Typed readers of the raw files, and their validation.

Every file is read as text first and cast afterwards; a failed cast is null, a missing column is null throughout.
``""`` and ``NULL`` are null. Readers return the staging columns; validators filter, deduplicate and number rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentinela import functions as fn
from sentinela.operators import core
from sentinela.sources import json_array

MONEY = "decimal(18,2)"


def read_csv(spark: SparkSession, path, names: list[str] | None = None, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A CSV as strings: headerless with ``names``, otherwise with its header stripped and upper-cased."""
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"')
    if names:
        df = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    else:
        df = reader.option("header", True).option("inferSchema", False).csv(path)
        df = df.toDF(*[c.strip().strip('"').upper() for c in df.columns])
    clean = [F.nullif(F.nullif(F.col(f"`{c}`"), F.lit("")), F.lit("NULL")).alias(c) for c in df.columns]
    return df.select(*clean).withColumn("_ord", F.monotonically_increasing_id())


def col(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of these columns that the table has, stripped; null if none."""
    for n in names:
        if n in df.columns:
            return fn.strip(F.col(f"`{n}`"))
    return F.lit(None).cast(kind)


def companies(spark, path) -> DataFrame:
    names = ["cnpj_basico", "razao_social", "natureza_juridica", "qualificacao_responsavel", "capital_social", "porte_empresa", "ente_federativo"]
    df = read_csv(spark, path, names)
    root = fn.zfill(F.coalesce(fn.strip(F.col("cnpj_basico")), F.lit("00000000")), 8)
    none = lambda n, kind="string": F.lit(None).cast(kind).alias(n)
    placeholder = F.concat(F.substring(root, 1, 2), F.lit("."), F.substring(root, 3, 3), F.lit("."), F.substring(root, 6, 3), F.lit("/0001-00"))
    return df.select("_ord", root.alias("cnpj_basico"), placeholder.alias("cnpj"), fn.strip(F.col("razao_social")).alias("razao_social"), fn.decimal_comma(F.col("capital_social")).alias("capital_social"), none("data_abertura", "date"), none("cnae_principal"), none("cnae_descricao"), none("logradouro"), none("municipio"), none("uf"), none("cep"), none("situacao"))


PARTNER_COLUMNS = ["CNPJ_BASICO", "IDENTIFICADOR_SOCIO", "NOME_SOCIO", "CNPJ_CPF_SOCIO", "QUALIFICACAO_SOCIO", "DATA_ENTRADA", "PAIS", "REPRESENTANTE_LEGAL", "NOME_REPRESENTANTE", "QUALIFICACAO_REPRESENTANTE", "FAIXA_ETARIA"]


def partners(spark, path) -> DataFrame:
    df = read_csv(spark, path, PARTNER_COLUMNS)
    return df.select("_ord", fn.strip(F.col("CNPJ_BASICO")).alias("cnpj_basico"), F.upper(fn.strip(F.col("NOME_SOCIO"))).alias("nome_socio"), fn.strip(F.col("CNPJ_CPF_SOCIO")).alias("cpf_parcial"), fn.strip(F.col("QUALIFICACAO_SOCIO")).alias("qualificacao_socio"), fn.day(F.col("DATA_ENTRADA"), "yyyyMMdd").alias("data_entrada"), F.lit(None).cast("decimal(5,2)").alias("percentual_capital"))


def sanctions(spark, path, kind: str) -> DataFrame:
    """``kind``: CEIS, CNEP or CEPIM; the three files are laid out alike."""
    df = read_csv(spark, path)
    name, other = col(df, "RAZÃO SOCIAL - CADASTRO RECEITA"), col(df, "NOME DO SANCIONADO")
    return df.select("_ord", col(df, "CPF OU CNPJ DO SANCIONADO").alias("cnpj"), F.when(fn.blank(name), other).otherwise(name).alias("razao_social"), F.lit(kind).alias("tipo_sancao"), col(df, "ÓRGÃO SANCIONADOR").alias("orgao_sancionador"), col(df, "CATEGORIA DA SANÇÃO").alias("motivo"), fn.day(col(df, "DATA INÍCIO SANÇÃO"), "dd/MM/yyyy").alias("data_inicio"), fn.day(col(df, "DATA FINAL SANÇÃO"), "dd/MM/yyyy").alias("data_fim"))


RECORD = "struct<numeroContratoEmpenho:string,orgaoEntidade:struct<cnpj:string,razaoSocial:string,poderId:string,esferaId:string>,niFornecedor:string,fornecedor:struct<cnpjFormatado:string,razaoSocial:string>,dataAssinatura:string,dataVigencia:string,dataVigenciaFim:string,valorInicial:string,objetoContrato:string,modalidadeNome:string,modalidadeCodigo:string,categoriaProcesso:struct<id:string,nome:string>>"
CONTRACT_SCHEMA = "num_licitacao string, cnpj_fornecedor string, codigo_orgao string, nome_orgao string, poder_orgao string, esfera_orgao string, modalidade_nome string, modalidade_codigo string, valor decimal(18,2), objeto string, data_assinatura date, data_vigencia date"


def contract_columns() -> list[Column]:
    """The staging columns of a contract, from a record ``r``."""
    some = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    return [
        F.col("r.numeroContratoEmpenho").alias("num_licitacao"),
        F.regexp_replace(F.coalesce("r.niFornecedor", "r.fornecedor.cnpjFormatado"), "[./-]", "").alias("cnpj_fornecedor"),
        F.col("r.orgaoEntidade.cnpj").alias("codigo_orgao"),
        F.col("r.orgaoEntidade.razaoSocial").alias("nome_orgao"),
        F.col("r.orgaoEntidade.poderId").alias("poder_orgao"),
        F.col("r.orgaoEntidade.esferaId").alias("esfera_orgao"),
        some("r.modalidadeNome", "r.categoriaProcesso.nome").alias("modalidade_nome"),
        F.coalesce(some("r.modalidadeCodigo", "r.categoriaProcesso.id"), F.lit("")).alias("modalidade_codigo"),
        F.col("r.valorInicial").try_cast(MONEY).alias("valor"),
        F.col("r.objetoContrato").alias("objeto"),
        fn.day(F.substring("r.dataAssinatura", 1, 10)).alias("data_assinatura"),
        fn.day(F.substring(some("r.dataVigenciaFim", "r.dataVigencia"), 1, 10)).alias("data_vigencia"),
    ]


def contracts_json(spark, path) -> DataFrame:
    """Files that hold ``{"data": [...]}`` or a bare list of records; a large file is read by many tasks."""
    rows = json_array.records(spark, path).select("_ord", F.from_json("text", RECORD).alias("r"))
    return rows.select("_ord", *contract_columns())


def contracts_parquet(spark, directory: str) -> DataFrame:
    """The windows of a directory as one table; nothing there gives an empty one."""
    if not files_of(spark, f"{directory}/window_*.parquet"):
        return spark.createDataFrame([], CONTRACT_SCHEMA).withColumn("_ord", F.monotonically_increasing_id())
    return spark.read.schema(CONTRACT_SCHEMA).parquet(f"{directory}/window_*.parquet").withColumn("_ord", F.monotonically_increasing_id())


def servants(spark, path) -> DataFrame:
    df = read_csv(spark, path)
    return df.select("_ord", F.upper(col(df, "NOME")).alias("nome"), col(df, "CPF").alias("cpf_mascarado"), fn.visible_digits(col(df, "CPF")).alias("digitos_visiveis"), col(df, "CARGO_DESCRICAO", "DESCRICAO_CARGO").alias("cargo"), col(df, "ORGAO_LOTACAO", "ORG_LOTACAO").alias("orgao_lotacao"), F.lit(True).alias("is_servidor_publico"))


def files_of(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a glob pattern matches, by Spark's own file systems, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def donations(spark, paths: list[str] | str) -> DataFrame:
    """Files of one or more states, or all CSV files of a directory (national totals and original donors are left out),
    columns matched by name."""
    paths = files_of(spark, f"{paths}/*.csv") if isinstance(paths, str) else paths
    name = lambda p: p.rstrip("/").rpartition("/")[2].lower()
    out = None
    for p in paths:
        if "_brasil" not in name(p) and "doador_originario" not in name(p):
            one = read_csv(spark, p)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], "_ord long, doc_doador string, nome_doador string, doc_candidato string, nome_candidato string, partido string, cargo string, uf string, valor decimal(18,2), tipo_recurso string, data_receita date, ano_eleicao int, tipo_doador string")
    doc = col(out, "NR_CPF_CNPJ_DOADOR")
    return out.select("_ord", doc.alias("doc_doador"), col(out, "NM_DOADOR").alias("nome_doador"), col(out, "NR_CPF_CANDIDATO").alias("doc_candidato"), col(out, "NM_CANDIDATO").alias("nome_candidato"), col(out, "SG_PARTIDO").alias("partido"), col(out, "DS_CARGO").alias("cargo"), col(out, "SG_UF").alias("uf"), fn.decimal_comma(col(out, "VR_RECEITA")).alias("valor"), col(out, "DS_ORIGEM_RECEITA").alias("tipo_recurso"), fn.day(col(out, "DT_RECEITA"), "dd/MM/yyyy").alias("data_receita"), col(out, "AA_ELEICAO").try_cast("int").alias("ano_eleicao"), fn.document_kind(doc).alias("tipo_doador"))


def comprasnet(spark, path) -> DataFrame:
    df = read_csv(spark, path, sep=",", encoding="UTF-8")
    return df.select("_ord", col(df, "LICITACAO_NUMERO").alias("num_licitacao"), F.regexp_replace(col(df, "FONECEDOR_CNPJ_CPF_IDGENER", "CNPJ_FORNECEDOR"), "[./-]", "").alias("cnpj_fornecedor"), col(df, "ORGAO_CODIGO").alias("codigo_orgao"), col(df, "ORGAO_NOME").alias("nome_orgao"), col(df, "PODER").alias("poder_orgao"), col(df, "ESFERA").alias("esfera_orgao"), col(df, "MODALIDADE").alias("modalidade_nome"), F.coalesce(col(df, "CODIGO_MODALIDADE"), F.lit("")).alias("modalidade_codigo"), col(df, "VALOR_GLOBAL").try_cast(MONEY).alias("valor"), col(df, "OBJETO").alias("objeto"), fn.day(col(df, "DATA_ASSINATURA")).alias("data_assinatura"), fn.day(col(df, "VIGENCIA_FIM")).alias("data_vigencia"))


def ownership_diffs(spark, path) -> DataFrame:
    df = read_csv(spark, path)
    return df.select("_ord", fn.zfill(col(df, "CNPJ_BASICO"), 8).alias("cnpj_basico"), F.upper(col(df, "NOME_SOCIO")).alias("nome_socio"), col(df, "QUALIFICACAO_SOCIO").alias("qualificacao_socio"), fn.day(col(df, "DATA_ENTRADA"), "yyyyMMdd").alias("data_entrada"), fn.day(col(df, "DATA_SAIDA"), "yyyyMMdd").alias("data_saida"))


def headcount(spark, path) -> DataFrame:
    df = read_csv(spark, path)
    return df.select("_ord", F.nullif(col(df, "CNPJ_BASICO"), F.lit("")).alias("cnpj_basico"), col(df, "QTD_VINC_ATIVOS").try_cast("long").alias("qtd_funcionarios"), F.nullif(col(df, "PORTE", "PORTE_EMPRESA"), F.lit("")).alias("porte_empresa"))


def _first(df: DataFrame, good: Column, keys: list[str], number: str | None = None) -> DataFrame:
    out = core.keep_first(df.filter(F.coalesce(good, F.lit(False))), keys, ["_ord"])
    return core.number_rows(out, number, ["_ord"]) if number else out


def valid_companies(df):
    return _first(df, F.col("cnpj").rlike(r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$") & ~fn.blank(F.col("razao_social")), ["cnpj"], "pk_fornecedor")


def valid_partners(df):
    return _first(df, ~fn.blank(F.col("nome_socio")) & ~fn.blank(F.col("cnpj_basico")), ["cnpj_basico", "cpf_parcial"])


def valid_sanctions(df):
    return _first(df, ~fn.blank(F.col("cnpj")) & F.col("data_inicio").isNotNull(), ["cnpj", "tipo_sancao", "data_inicio"], "pk_sancao")


def valid_contracts(df, keys=("num_licitacao",)):
    """Positive value and a supplier; the object's first 1000 characters; one row per bid number."""
    out = _first(df, F.col("cnpj_fornecedor").isNotNull() & (F.col("valor") > 0), list(keys), "pk_contrato")
    return out.withColumn("objeto", F.substring("objeto", 1, 1000))


def valid_comprasnet(df):
    return valid_contracts(df, ("cnpj_fornecedor", "num_licitacao", "data_assinatura"))


def valid_servants(df):
    return _first(df, ~fn.blank(F.col("nome")), ["nome", "digitos_visiveis"])


def valid_donations(df):
    return _first(df, (F.col("valor") > 0) & ~fn.blank(F.col("doc_doador")) & F.col("ano_eleicao").isNotNull(), ["doc_doador", "doc_candidato", "ano_eleicao", "valor"], "pk_doacao")


def valid_ownership_diffs(df):
    return _first(df, ~fn.blank(F.col("cnpj_basico")) & ~fn.blank(F.col("nome_socio")), ["cnpj_basico", "nome_socio", "data_entrada"])


def valid_headcount(df):
    return core.keep_most(df.filter(~fn.blank(F.col("cnpj_basico")) & (F.col("qtd_funcionarios") >= 0)).drop("_ord"), "cnpj_basico", "qtd_funcionarios")


#: A (reader, validator) pair for each source.
SOURCES = {"empresas": (companies, valid_companies), "qsa": (partners, valid_partners), "sancoes": (sanctions, valid_sanctions), "contratos": (contracts_json, valid_contracts), "servidores": (servants, valid_servants), "doacoes": (donations, valid_donations), "comprasnet": (comprasnet, valid_comprasnet), "qsa_diffs": (ownership_diffs, valid_ownership_diffs), "rais": (headcount, valid_headcount)}
