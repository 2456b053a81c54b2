"""Queries over raw files: the driver's tables are written as the files that a source would deliver, then read and validated.

The files go to the folder that driver and executors share. SQL says what must come out for the same tables.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela import durable, publish, sources
from sentinela.plans.driver_map import VIEWS, Domain
from sentinela.sources import windows

QUERIES: dict = {}
ORACLE: dict = {}


def _source(name: str, sql: str):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir), f"{durable.shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        ORACLE[name] = sql
        return f

    return add


def _csv(df: DataFrame, path: str, header: bool = True, sep: str = ";", encoding: str = "ISO-8859-1") -> str:
    df.write.option("sep", sep).option("encoding", encoding).option("header", header).option("quote", '"').option("escape", '"').option("nullValue", "").csv(path)
    return path


def _text(c: str):
    return F.col(c).cast("string")


def _money(c):
    return F.regexp_replace(c.cast("decimal(18,2)").cast("string"), "[.]", ",")


def _day(c, pattern: str = "dd/MM/yyyy"):
    return F.date_format(c, pattern)


@_source("source_companies", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS cnpj_basico, s_name AS razao_social, CAST(s_acctbal AS DECIMAL(18,2)) AS capital_social FROM supplier")
def companies(d, path):
    raw = d.table("supplier").select(_text("s_suppkey"), F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")), F.lit("x"), F.lit("y"), _money(F.col("s_acctbal")), F.lit("01"), F.lit(""))
    bad = raw.limit(1).select(F.lit("99999999"), F.lit(" "), F.lit("x"), F.lit("y"), F.lit("1,00"), F.lit("01"), F.lit(""))  # no name
    out = sources.valid_companies(sources.companies(d.spark, _csv(raw.union(bad), path, header=False)))
    return out.select("cnpj_basico", "razao_social", "capital_social")


@_source("source_partners", f"WITH {VIEWS} SELECT cnpj_basico, nome_socio, '***' || lpad(CAST(pk_socio % 1000000 AS VARCHAR), 6, '0') || '**' AS cpf_parcial, DATE '2020-01-31' AS data_entrada FROM raw_partner_v")
def partners(d, path):
    p, x = d.raw_partners, F.lit("")
    digits = F.concat(F.lit("***"), F.lpad((F.col("pk_socio") % 1_000_000).cast("string"), 6, "0"), F.lit("**"))
    raw = p.select("cnpj_basico", F.lit("2"), F.lower("nome_socio"), digits, F.lit("49"), F.lit("20200131"), x, x, x, x, x)
    out = sources.valid_partners(sources.partners(d.spark, _csv(raw.union(raw), path, header=False)))  # every row twice
    return out.select("cnpj_basico", "nome_socio", "cpf_parcial", "data_entrada")


@_source("source_sanctions", f"WITH {VIEWS} SELECT cnpj, CASE WHEN pk_sancao % 5 = 0 THEN 'CEPIM' ELSE tipo_sancao END AS tipo_sancao, data_inicio, max(razao_social) AS razao_social, count(*) > 0 AS there FROM sanction_v GROUP BY 1, 2, 3")
def sanctions(d, path):
    out = None
    kinds = d.sanctions.withColumn("tipo_sancao", F.when(F.col("pk_sancao") % 5 == 0, "CEPIM").otherwise(F.col("tipo_sancao")))
    for kind in ("CEIS", "CNEP", "CEPIM"):
        s = kinds.filter(F.col("tipo_sancao") == kind)
        raw = s.select(F.col("cnpj").alias("CPF OU CNPJ DO SANCIONADO"), F.when(F.col("pk_sancao") % 2 == 0, " ").alias("RAZÃO SOCIAL - CADASTRO RECEITA"), F.col("razao_social").alias("NOME DO SANCIONADO"), F.lit("CGU").alias("ÓRGÃO SANCIONADOR"), F.lit("x").alias("CATEGORIA DA SANÇÃO"), _day(F.col("data_inicio")).alias("DATA INÍCIO SANÇÃO"), _day(F.col("data_fim")).alias("DATA FINAL SANÇÃO"))
        one = sources.valid_sanctions(sources.sanctions(d.spark, _csv(raw, f"{path}-{kind}"), kind)).select("cnpj", "tipo_sancao", "data_inicio", "razao_social", F.lit(True).alias("there"))
        out = one if out is None else out.unionByName(one)
    return out


_CONTRACT = "SELECT num_licitacao, cnpj_fornecedor, valor, data_assinatura, data_vigencia FROM (SELECT CAST(o_orderkey AS VARCHAR) AS num_licitacao, lpad(CAST(o_custkey AS VARCHAR), 14, '0') AS cnpj_fornecedor, CAST(o_totalprice AS DECIMAL(18,2)) AS valor, CAST(o_orderdate AS DATE) AS data_assinatura, CAST(o_orderdate AS DATE) + 30 AS data_vigencia FROM orders) WHERE valor > 0"


def _orders(d):
    o = d.table("orders")
    return o.select(_text("o_orderkey").alias("n"), F.lpad(_text("o_custkey"), 14, "0").alias("c"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.col("o_orderdate").cast("date").alias("d"), F.date_add(F.col("o_orderdate").cast("date"), 30).alias("e"))


@_source("source_contracts_json", _CONTRACT)
def contracts_json(d, path):
    record = F.struct(F.col("n").alias("numeroContratoEmpenho"), F.struct(F.lit("1").alias("cnpj"), F.lit("Agency").alias("razaoSocial")).alias("orgaoEntidade"), F.col("c").alias("niFornecedor"), F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss").alias("dataAssinatura"), _day(F.col("e"), "yyyy-MM-dd").alias("dataVigenciaFim"), F.col("v").alias("valorInicial"), F.lit("objeto").alias("objetoContrato"))
    month = F.date_format("d", "yyyy-MM").alias("month")
    lines = _orders(d).select(month, F.lit(1).alias("k"), F.concat(F.to_json(record), F.lit(",")).alias("value"))
    edges = lines.select("month").distinct()
    head, foot = (edges.select("month", F.lit(k).alias("k"), F.lit(v).alias("value")) for k, v in ((0, '{"paginas": [{"n": 1}], "data": ['), (2, 'null], "totalPaginas": {"n": "}"}}')))
    every = lines.unionByName(head).unionByName(foot).repartition("month").sortWithinPartitions("month", "k")
    every.select("month", "value").write.partitionBy("month").text(path)  # a file per month
    out = sources.valid_contracts(sources.contracts_json(d.spark, f"{path}/month=*"))
    return out.select("num_licitacao", "cnpj_fornecedor", "valor", "data_assinatura", "data_vigencia")


def _archive(d, path):
    """Pages of at most 200 orders in a folder for each month, and the first and last day."""
    record = F.struct(F.col("n").alias("numeroContratoEmpenho"), F.col("c").alias("niFornecedor"), F.date_format("d", "yyyy-MM-dd").alias("dataAssinatura"), _day(F.col("e"), "yyyy-MM-dd").alias("dataVigenciaFim"), F.col("v").cast("string").alias("valorInicial"))
    o = _orders(d).select(F.col("d").alias("dia"), F.to_json(record).alias("x"), (F.xxhash64("n") % F.ceil(F.count("*").over(Window.partitionBy("d")) / 200)).alias("k"))
    paged = o.groupBy("dia", "k").agg(F.concat(F.lit('\t{"data": ['), F.array_join(F.collect_list("x"), ","), F.lit("]}")).alias("page"))
    lines = paged.select(F.date_format("dia", "yyyy-MM").alias("mes"), F.concat("dia", "page").alias("value"))
    lines.repartition("mes").write.partitionBy("mes").text(path)
    return d.table("orders").select(F.min(F.col("o_orderdate").cast("date")), F.max(F.col("o_orderdate").cast("date"))).first()


@_source("source_contract_windows", _CONTRACT)
def contract_windows(d, path):
    """An archive by day is taken in by two runs: the second reads only windows that the first has not finished."""
    first, last = _archive(d, f"{path}/archive")
    if first is not None:
        for end in (first + (last - first) / 2, last + timedelta(days=windows.DAYS)):
            windows.ingest(d.spark, f"{path}/archive", f"{path}/windows", first, end)
    return sources.valid_contracts(sources.contracts_parquet(d.spark, f"{path}/windows")).select("num_licitacao", "cnpj_fornecedor", "valor", "data_assinatura", "data_vigencia")


@_source("source_contract_days", f"SELECT data_assinatura AS dia, count(*) AS n, sum(valor) AS total FROM ({_CONTRACT}), (SELECT CAST(min(o_orderdate) AS DATE) AS first FROM orders) WHERE data_assinatura BETWEEN first + 100 AND first + 199 GROUP BY 1")
def contract_days(d, path):
    """A hundred days out of the archive: four or five windows are read, of all."""
    first, last = _archive(d, f"{path}/archive")
    if first is None:
        return d.spark.createDataFrame([], "dia date, n long, total decimal(38,2)")
    found = windows.pages(d.spark, f"{path}/archive", first, last, first + timedelta(days=100), first + timedelta(days=199))
    return windows.contracts(found).filter("valor > 0").groupBy("dia").agg(F.count("*").alias("n"), F.sum("valor").cast("decimal(38,2)").alias("total"))


def _rows(d):
    none = [F.lit(None).cast("string").alias(c) for c in ("codigo_orgao", "nome_orgao", "poder_orgao", "esfera_orgao", "modalidade_nome", "modalidade_codigo")]
    return _orders(d).select(F.col("n").alias("num_licitacao"), F.col("c").alias("cnpj_fornecedor"), *none, F.col("v").alias("valor"), F.lit("x").alias("objeto"), F.col("d").alias("data_assinatura"), F.col("e").alias("data_vigencia"))


@_source("source_contracts_parquet", _CONTRACT)
def contracts_parquet(d, path):
    for i, half in enumerate(("num_licitacao < '5'", "num_licitacao >= '5'")):
        _rows(d).filter(half).write.parquet(f"{path}/window_{i}.parquet")
    return sources.valid_contracts(sources.contracts_parquet(d.spark, path)).select("num_licitacao", "cnpj_fornecedor", "valor", "data_assinatura", "data_vigencia")


@_source("source_comprasnet", _CONTRACT)
def comprasnet(d, path):
    raw = _orders(d).select(F.col("n").alias("licitacao_numero"), F.col("c").alias("fonecedor_cnpj_cpf_idgener"), _text("v").alias("valor_global"), _day(F.col("d"), "yyyy-MM-dd").alias("data_assinatura"), _day(F.col("e"), "yyyy-MM-dd").alias("vigencia_fim"))
    out = sources.valid_comprasnet(sources.comprasnet(d.spark, _csv(raw, path, sep=",", encoding="UTF-8")))
    return out.select("num_licitacao", "cnpj_fornecedor", "valor", "data_assinatura", "data_vigencia")


@_source("source_servants", f"WITH {VIEWS} SELECT DISTINCT nome, digitos_visiveis, orgao_lotacao FROM servant_v")
def servants(d, path):
    v = F.col("digitos_visiveis")
    masked = F.concat(F.lit("***."), F.substring(v, 1, 3), F.lit("."), F.substring(v, 4, 3), F.lit("-**"))
    raw = d.servants.select(F.lower("nome").alias("NOME"), masked.alias("CPF"), F.lit("x").alias("CARGO_DESCRICAO"), F.col("orgao_lotacao").alias("ORGAO_LOTACAO"))
    return sources.valid_servants(sources.servants(d.spark, _csv(raw, path))).select("nome", "digitos_visiveis", "orgao_lotacao")


@_source("source_donations", f"WITH {VIEWS} SELECT DISTINCT CASE WHEN tipo_doador = 'CPF' THEN '000' || substr(doc_doador, 1, 8) ELSE doc_doador END AS doc_doador, valor, ano_eleicao, tipo_doador FROM donation_v WHERE valor > 0")
def donations(d, path):
    raw = d.donations.select("pk_doacao", _text("ano_eleicao").alias("AA_ELEICAO"), F.when(F.col("tipo_doador") == "CPF", F.concat(F.lit("000"), F.substring("doc_doador", 1, 8))).otherwise(F.col("doc_doador")).alias("NR_CPF_CNPJ_DOADOR"), _money(F.col("valor")).alias("VR_RECEITA"))
    _csv(raw.filter("pk_doacao % 2 = 0").drop("pk_doacao"), f"{path}/receitas_AC.csv")
    _csv(raw.filter("pk_doacao % 2 = 1").select("VR_RECEITA", "NR_CPF_CNPJ_DOADOR", "AA_ELEICAO"), f"{path}/receitas_SP.csv")
    _csv(raw, f"{path}/receitas_BRASIL.csv")  # the national total, to be left out
    return sources.valid_donations(sources.donations(d.spark, path)).select("doc_doador", "valor", "ano_eleicao", "tipo_doador")


@_source("source_ownership_diffs", f"WITH {VIEWS} SELECT cnpj_basico, nome_socio, DATE '2020-01-31' AS data_entrada, CASE WHEN pk_socio % 2 = 0 THEN DATE '2021-12-31' END AS data_saida FROM raw_partner_v")
def ownership_diffs(d, path):
    raw = d.raw_partners.select(_text("fk_fornecedor").alias("CNPJ_BASICO"), F.lower("nome_socio").alias("NOME_SOCIO"), F.lit("49").alias("QUALIFICACAO_SOCIO"), F.lit("20200131").alias("DATA_ENTRADA"), F.when(F.col("pk_socio") % 2 == 0, "20211231").alias("DATA_SAIDA"))
    return sources.valid_ownership_diffs(sources.ownership_diffs(d.spark, _csv(raw, path))).select("cnpj_basico", "nome_socio", "data_entrada", "data_saida")


@_source("source_headcount", "SELECT CAST(user_id AS VARCHAR) AS cnpj_basico, max(event_id) AS qtd_funcionarios FROM events WHERE event_id >= 0 GROUP BY 1")
def headcount(d, path):
    raw = d.table("events").select(_text("user_id").alias("CNPJ_BASICO"), _text("event_id").alias("QTD_VINC_ATIVOS"), F.col("event_type").alias("PORTE"))
    bad = raw.limit(1).select("CNPJ_BASICO", F.lit("-5"), "PORTE")
    return sources.valid_headcount(sources.headcount(d.spark, _csv(raw.union(bad), path))).select("cnpj_basico", "qtd_funcionarios")


@_source("published_counts", f"WITH {VIEWS} SELECT 'fornecedores' AS tabela, count(*) AS n FROM supplier_v UNION ALL SELECT 'sancoes', count(*) FROM sanction_v UNION ALL SELECT 'doacoes', count(*) FROM donation_v")
def published_counts(d, path):
    """Two versions are published; the counts are of the second."""
    publish.publish(d.spark, {"fornecedores": d.suppliers.limit(1)}, path)
    publish.publish(d.spark, {"fornecedores": d.suppliers, "sancoes": d.sanctions, "doacoes": d.donations}, path)
    return publish.table_counts(d.spark, path, ["fornecedores", "sancoes", "doacoes"])


@_source("completeness_gate", f"WITH {VIEWS}, n AS (SELECT 'sancoes' AS tabela, count(*) AS n FROM sanction_v UNION ALL SELECT 'empresas', count(*) FROM supplier_v UNION ALL SELECT 'qsa', count(*) FROM raw_partner_v UNION ALL SELECT 'contratos', count(*) FROM contract_v WHERE valor < 0 UNION ALL SELECT 'servidores', count(*) FROM servant_v UNION ALL SELECT 'doacoes', count(*) FROM donation_v WHERE ano_eleicao < 1900) SELECT tabela, n > 0 AS completa FROM n")
def completeness_gate(d, path):
    """What the gate finds missing: two of these tables have no row."""
    tables = {"empresas": d.suppliers, "qsa": d.raw_partners, "contratos": d.contracts.filter("valor < 0"), "sancoes": d.sanctions, "servidores": d.servants, "doacoes": d.donations.filter("ano_eleicao < 1900")}
    try:
        publish.check_complete(tables)
        missing = []
    except publish.Incomplete as e:
        missing = e.missing
    return d.spark.createDataFrame([(n, n not in missing) for n in tables], "tabela string, completa boolean")
