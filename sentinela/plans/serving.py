"""Serving queries: each a function of tables and parameters. No HTTP."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paged(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def supplier_with_neighbours(suppliers: DataFrame, cnpj: str | None = None) -> DataFrame:
    """Each supplier (or the one) with the number of others at the same address text."""
    if cnpj is None:
        per = suppliers.filter("logradouro is not null").groupBy("logradouro").agg((F.count("*") - 1).alias("qtd_mesmo_endereco"))
        return suppliers.join(per, "logradouro", "left").withColumn("qtd_mesmo_endereco", F.coalesce("qtd_mesmo_endereco", F.lit(0))).select(*suppliers.columns, "qtd_mesmo_endereco")
    own = suppliers.filter(F.col("cnpj") == cnpj)
    near = suppliers.select(F.col("cnpj").alias("_c"), F.col("logradouro").alias("_l")).filter(F.col("_c") != cnpj)
    return own.join(near, F.col("logradouro") == F.col("_l"), "left").groupBy(*suppliers.columns).agg(F.count("_c").alias("qtd_mesmo_endereco"))


def ranking(dimension: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return paged(dimension, [F.col("score_risco").desc(), "pk_fornecedor"], limit, offset)


def search(dimension: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Suppliers whose cnpj or name (any case) contains the text, % and _ taken literally."""
    hit = F.col("cnpj").contains(text) | F.lower("razao_social").contains(text.lower())
    return paged(dimension.filter(hit), ["pk_fornecedor"], limit)


def contract_list(contracts: DataFrame, dimension: DataFrame, agencies: DataFrame, cnpj: str | None = None, agency: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    own = dimension.select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnpj")
    org = agencies.select(F.col("pk_orgao").alias("fk_orgao"), F.col("codigo").alias("orgao_codigo"))
    if cnpj is not None:
        own = own.filter(F.col("cnpj") == cnpj)
    if agency is not None:
        org = org.filter(F.col("orgao_codigo") == agency)
    out = contracts.join(own, "fk_fornecedor").join(org, "fk_orgao").select("pk_contrato", "valor", "objeto", "num_licitacao", "data_assinatura", "data_vigencia", "orgao_codigo", "cnpj")
    return out if limit is None else paged(out, [F.col("data_assinatura").desc_nulls_last(), "pk_contrato"], limit, offset)


def supplier_donations(donations: DataFrame, suppliers: DataFrame, bridge: DataFrame, cnpj: str) -> DataFrame:
    """Donations of the supplier itself, or through one of its partners."""
    own = suppliers.filter(F.col("cnpj") == cnpj).select("pk_fornecedor")
    direct = donations.join(own.withColumnRenamed("pk_fornecedor", "fk_fornecedor"), "fk_fornecedor", "left_semi").select(*donations.columns)
    mine = bridge.join(own.withColumnRenamed("pk_fornecedor", "fk_fornecedor"), "fk_fornecedor", "left_semi").select("fk_socio").distinct()
    if "fk_socio" not in donations.columns:
        return direct
    through = donations.join(mine, "fk_socio", "left_semi").select(*donations.columns)
    return direct.union(through).dropDuplicates(["pk_doacao"])


def of_supplier(rows: DataFrame, suppliers: DataFrame, cnpj: str) -> DataFrame:
    """The rows (sanctions, partners) of one supplier."""
    own = suppliers.filter(F.col("cnpj") == cnpj).select(F.col("pk_fornecedor").alias("fk_fornecedor"))
    return rows.join(own, "fk_fornecedor", "left_semi")


def servant_by_hash(servants: DataFrame, value: str) -> DataFrame:
    return paged(servants.filter(F.col("cpf_hmac") == value), ["nome", "orgao_lotacao"], 1)


def alert_feed(alerts: DataFrame, dimension: DataFrame, partners: DataFrame, kind: str | None = None, cnpj: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    rows = alerts if kind is None else alerts.filter(F.col("tipo_alerta") == kind)
    own = dimension.select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnpj", "razao_social")
    own = own if cnpj is None else own.filter(F.col("cnpj") == cnpj)
    who = partners.select(F.col("pk_socio").alias("fk_socio"), F.col("nome_socio").alias("socio_nome"))
    out = rows.join(own, "fk_fornecedor").join(who, "fk_socio", "left").select("tipo_alerta", "severidade", "descricao", "evidencia", "cnpj", "razao_social", "socio_nome", *(["detectado_em"] if "detectado_em" in alerts.columns else []))
    order = [*([F.col("detectado_em").desc()] if "detectado_em" in alerts.columns else []), "tipo_alerta", "cnpj", "evidencia", "descricao"]
    return out if limit is None else paged(out, order, limit, offset)


def alert_count(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("n"))


def counts(**tables: DataFrame) -> DataFrame:
    """tabela, n of each table, in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tabela"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def agency_summary(contracts: DataFrame, agencies: DataFrame, code: str | None = None) -> DataFrame:
    org = agencies if code is None else agencies.filter(F.col("codigo") == code)
    j = org.join(contracts, F.col("pk_orgao") == F.col("fk_orgao"), "left")
    return j.groupBy("codigo", "nome").agg(F.count("pk_contrato").alias("qtd_contratos"), F.coalesce(F.sum("valor"), F.lit(0)).cast("decimal(28,2)").alias("total_contratado"), F.countDistinct("fk_fornecedor").alias("qtd_fornecedores"))


def agency_top(contracts: DataFrame, dimension: DataFrame, agencies: DataFrame, code: str, n: int = 10) -> DataFrame:
    org = agencies.filter(F.col("codigo") == code).select(F.col("pk_orgao").alias("fk_orgao"))
    j = contracts.join(org, "fk_orgao", "left_semi").groupBy("fk_fornecedor").agg(F.sum("valor").alias("valor_total_orgao"), F.count("*").alias("qtd_contratos"))
    own = dimension.select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnpj", "razao_social", "score_risco")
    return paged(j.join(own, "fk_fornecedor").drop("fk_fornecedor"), [F.col("valor_total_orgao").desc(), "cnpj"], n)


def dossier(domain, cnpj: str | None = None) -> DataFrame:
    """One row per supplier (or the one) with nested score lines, alerts, partners, sanctions and contracts."""
    own = domain.dimension if cnpj is None else domain.dimension.filter(F.col("cnpj") == cnpj)

    def nested(df, key, name, *cols):
        return df.groupBy(F.col(key).alias("pk_fornecedor")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))

    parts = [
        nested(domain.scores, "fk_fornecedor", "indicadores", "indicador", "peso", "descricao", "evidencia"),
        nested(domain.alerts, "fk_fornecedor", "alertas", "tipo_alerta", "severidade", "descricao", "evidencia"),
        nested(domain.partners, "fk_fornecedor", "socios", "nome_socio", "is_servidor_publico", "orgao_lotacao", "is_sancionado", "qtd_empresas_governo"),
        nested(domain.sanctions, "fk_fornecedor", "sancoes", "tipo_sancao", "data_inicio", "data_fim"),
        nested(domain.contracts, "fk_fornecedor", "contratos", "pk_contrato", "valor", "data_assinatura", "objeto"),
        nested(domain.donations, "fk_fornecedor", "doacoes", "pk_doacao", "valor", "ano_eleicao"),
    ]
    for p in parts:
        own = own.join(p, "pk_fornecedor", "left")
    return own


def dossier_json(rows: DataFrame) -> DataFrame:
    return rows.select("cnpj", F.to_json(F.struct(*rows.columns)).alias("json"))
