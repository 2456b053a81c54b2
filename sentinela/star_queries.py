"""Queries over the published star schema: it is built from the driver's tables, checked, laid out, loaded and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import durable, layout, publish, schema
from sentinela.operators import core, dimensions
from sentinela.plans.driver_map import KEY, VIEWS, Domain
from sentinela.queries import _hmac_sql

QUERIES: dict = {}
ORACLE: dict = {}
#: What a first run knows, where a query makes two.
FIRST = "data_assinatura < date'1996-01-01'"
FIRST_GIFTS = "pk_doacao % 2 = 0"

_SQL = f"""WITH {VIEWS},
deal_v AS (
  SELECT *, 'ORG' || CAST(fk_orgao AS VARCHAR) || CASE WHEN data_assinatura >= DATE '1996-01-01' AND fk_orgao % 2 = 0 THEN 'B' ELSE '' END AS codigo,
    'Orgao ' || CAST(fk_orgao AS VARCHAR) || ' ' || CAST(year(data_assinatura) AS VARCHAR) AS nome,
    CASE WHEN objeto_categoria IS NULL THEN 'Outra' ELSE objeto_categoria END AS modalidade
  FROM contract_v),
gift_v AS (
  SELECT *, 'CANDIDATO ' || CAST(pk_doacao % 97 AS VARCHAR) AS nome, lpad(CAST(pk_doacao % 97 AS VARCHAR), 11, '0') AS doc, 'P' || CAST(pk_doacao % 7 AS VARCHAR) AS partido,
    make_date(ano_eleicao, 1 + CAST(pk_doacao % 12 AS INTEGER), 1 + CAST(pk_doacao % 28 AS INTEGER)) AS dia
  FROM donation_v),
org_v AS (
  SELECT codigo, nome, CAST(row_number() OVER (ORDER BY novo, codigo) AS BIGINT) AS pk_orgao
  FROM (SELECT codigo, arg_min(nome, (-epoch(data_assinatura), nome)) AS nome, min(data_assinatura) >= DATE '1996-01-01' AS novo FROM deal_v GROUP BY codigo)),
mod_v AS (
  SELECT codigo, codigo AS descricao, CAST(row_number() OVER (ORDER BY novo, codigo) AS BIGINT) AS pk_modalidade
  FROM (SELECT modalidade AS codigo, min(data_assinatura) >= DATE '1996-01-01' AS novo FROM deal_v GROUP BY 1)),
day_v AS (SELECT DISTINCT data FROM (SELECT data_assinatura AS data FROM deal_v UNION ALL SELECT dia FROM gift_v) WHERE data IS NOT NULL)
"""


def _query(name: str, sql: str):
    def add(f):
        def run(spark, sf_dir):
            where = f"{durable.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            return f(Domain(spark, sf_dir), where)

        QUERIES[name], ORACLE[name] = run, _SQL + sql
        return f

    return add


def _parts(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contracts, donations and partners as validated sources deliver them."""
    day = F.col("data_assinatura")
    org = F.col("fk_orgao").cast("string")
    code = F.concat(F.lit("ORG"), org, F.when((day >= "1996-01-01") & (F.col("fk_orgao") % 2 == 0), "B").otherwise(""))
    deals = d.contracts.withColumns({"codigo_orgao": code, "nome_orgao": F.concat(F.lit("Orgao "), org, F.lit(" "), F.year(day).cast("string")), "modalidade_codigo": F.coalesce("objeto_categoria", F.lit(" ")), "modalidade_nome": F.coalesce("objeto_categoria", F.lit("Outra"))})
    k = F.col("pk_doacao")
    gifts = d.donations.withColumns({"nome_candidato": F.concat(F.lit("CANDIDATO "), (k % 97).cast("string")), "doc_candidato": F.lpad((k % 97).cast("string"), 11, "0"), "partido": F.concat(F.lit("P"), (k % 7).cast("string")), "data_receita": F.make_date("ano_eleicao", (k % 12 + 1).cast("int"), (k % 28 + 1).cast("int"))})
    entry = F.date_add(F.lit("2015-01-01").cast("date"), (F.col("pk_socio") % 900).cast("int"))
    return deals, gifts, d.raw_partners.withColumn("data_entrada", entry)


def _known(df: DataFrame, key: str, others: DataFrame, pk: str) -> DataFrame:
    """The key null where it names no row."""
    there = others.select(F.col(pk).alias("_there"))
    return df.join(there, F.col(key) == F.col("_there"), "left").withColumn(key, F.col("_there")).drop("_there")


def star(d: Domain, names: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables; contracts and donations are not numbered if none of those asked for (``names``) is made of them."""
    deals, gifts, partners = _parts(d)
    plain = {"dim_fornecedor": d.suppliers, "dim_socio": partners, "dim_sancao": _known(d.sanctions, "fk_fornecedor", d.suppliers, "pk_fornecedor")}
    if names is not None and set(names) <= {*plain, "bridge_fornecedor_socio"}:
        return {**plain, "bridge_fornecedor_socio": dimensions.bridge(partners, d.suppliers)}
    deals = core.number_rows(deals.drop("pk_contrato"), "pk_contrato", ["num_licitacao", "fk_fornecedor", "objeto", "valor"])
    gifts = _known(_known(gifts, "fk_fornecedor", d.suppliers, "pk_fornecedor"), "fk_socio", partners, "pk_socio")
    tables = dimensions.star(d.suppliers, partners, deals, gifts, KEY)
    return {**tables, **plain}


def _loaded(d: Domain, where: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The tables of a version that has just been loaded."""
    tables = star(d, names)
    schema.load(d.spark, {n: t for n, t in tables.items() if names is None or n in names}, where, layout.LAYOUT)
    return publish.published(d.spark, where, layout.LAYOUT)


def _and_remove(df: DataFrame, d: Domain, where: str) -> DataFrame:
    """The result written by itself, so that what it was read from can go."""
    out = durable.materialise(df, "result")
    fs, path = publish._fs(d.spark, where)
    fs.delete(path, True)
    return out


@_query("star_dim_orgao", "SELECT pk_orgao, codigo, nome FROM org_v")
def dim_orgao(d, where):
    """Two runs: codes of the first keep their keys, later ones get the next."""
    deals = _parts(d)[0]
    first = durable.materialise(dimensions.agencies(deals.filter(FIRST)), "dim")
    return dimensions.agencies(deals, first).select("pk_orgao", "codigo", "nome")


@_query("star_dim_modalidade", "SELECT pk_modalidade, codigo, descricao FROM mod_v")
def dim_modalidade(d, where):
    deals = _parts(d)[0]
    first = durable.materialise(dimensions.modalities(deals.filter(FIRST)), "dim")
    return dimensions.modalities(deals, first).select("pk_modalidade", "codigo", "descricao")


@_query(
    "star_dim_candidato",
    f", c AS (SELECT nome, doc, partido, CAST(ano_eleicao AS SMALLINT) AS ano_eleicao, bool_and(pk_doacao % 2 <> 0) AS novo, {_hmac_sql('any_value(doc)')} AS cpf_hmac FROM gift_v GROUP BY nome, doc, partido, ano_eleicao) "
    "SELECT CAST(row_number() OVER (ORDER BY novo, nome, cpf_hmac, partido, ano_eleicao) AS BIGINT) AS pk_candidato, nome, cpf_hmac, partido, ano_eleicao FROM c",
)
def dim_candidato(d, where):
    gifts = _parts(d)[1]
    first = durable.materialise(dimensions.candidates(gifts.filter(FIRST_GIFTS), KEY), "dim")
    return dimensions.candidates(gifts, KEY, first).select("pk_candidato", "nome", "cpf_hmac", "partido", "ano_eleicao")


_MONTHS = "[" + ", ".join(f"'{m}'" for m in dimensions.MONTHS) + "]"


@_query(
    "star_dim_tempo",
    "SELECT CAST(strftime(data, '%Y%m%d') AS BIGINT) AS pk_tempo, data, CAST(year(data) AS SMALLINT) AS ano, CAST(month(data) AS TINYINT) AS mes, CAST(quarter(data) AS TINYINT) AS trimestre, "
    f"CAST((month(data) + 5) // 6 AS TINYINT) AS semestre, CAST(isodow(data) AS TINYINT) AS dia_semana, {_MONTHS}[month(data)] AS nome_mes FROM day_v",
)
def dim_tempo(d, where):
    deals, gifts, _ = _parts(d)
    first = dimensions.days([deals.filter(FIRST).select("data_assinatura")])
    return dimensions.days([deals.select("data_assinatura"), gifts.select("data_receita")], first)


@_query("star_bridge", "SELECT fk_fornecedor, pk_socio AS fk_socio, DATE '2015-01-01' + CAST(pk_socio % 900 AS INTEGER) AS data_entrada FROM raw_partner_v")
def star_bridge(d, where):
    """Every partner twice, once entered later."""
    partners = _parts(d)[2]
    later = partners.withColumn("data_entrada", F.date_add("data_entrada", 400))
    return dimensions.bridge(later.unionByName(partners), d.suppliers).select("fk_fornecedor", "fk_socio", "data_entrada")


_COUNTED = {"dim_fornecedor": "supplier_v", "dim_socio": "raw_partner_v", "dim_sancao": "sanction_v", "bridge_fornecedor_socio": "raw_partner_v", "fato_contrato": "deal_v", "fato_doacao": "gift_v", "dim_orgao": "org_v", "dim_modalidade": "mod_v", "dim_tempo": "day_v", "dim_candidato": "(SELECT DISTINCT nome, partido, ano_eleicao FROM gift_v)"}


@_query("star_load", " UNION ALL ".join(f"SELECT '{n}' AS tabela, count(*) AS n FROM {v}" for n, v in _COUNTED.items()))
def star_load(d, where):
    """A load that breaks no rule: all tables of one version."""
    _loaded(d, where)
    return _and_remove(publish.table_counts(d.spark, where, list(_COUNTED)), d, where)


@_query(
    "star_agency_summary",
    "SELECT codigo, org_v.nome, count(*) AS qtd_contratos, CAST(sum(valor) AS DECIMAL(28,2)) AS total_contratado, count(DISTINCT fk_fornecedor) AS qtd_fornecedores, min(strftime(data_assinatura, '%Y%m%d')) AS primeiro FROM deal_v JOIN org_v USING (codigo) GROUP BY 1, 2",
)
def star_agency_summary(d, where):
    """Agencies by the keys of a published version, with the calendar."""
    t = _loaded(d, where, ["fato_contrato", "dim_orgao", "dim_tempo"])
    deals = t["fato_contrato"].join(t["dim_tempo"].select(F.col("pk_tempo").alias("fk_tempo")), "fk_tempo")
    own = t["dim_orgao"].select(F.col("pk_orgao").alias("fk_orgao"), "codigo", "nome")
    out = deals.join(own, "fk_orgao").groupBy("codigo", "nome").agg(F.count("*").alias("qtd_contratos"), F.sum("valor").cast("decimal(28,2)").alias("total_contratado"), F.countDistinct("fk_fornecedor").alias("qtd_fornecedores"), F.min("fk_tempo").cast("string").alias("primeiro"))
    return _and_remove(out, d, where)


@_query("star_supplier_partners", "SELECT s.cnpj, p.nome_socio AS nome FROM raw_partner_v p JOIN supplier_v s ON s.pk_fornecedor = p.fk_fornecedor WHERE s.cnpj IN ('00000007000100', '00000012000100')")
def star_supplier_partners(d, where):
    """Partners of two suppliers, by look-ups in clustered files."""
    t = _loaded(d, where, ["dim_fornecedor", "dim_socio", "bridge_fornecedor_socio"])
    own = t["dim_fornecedor"].filter(F.col("cnpj").isin("00000007000100", "00000012000100")).select("cnpj", F.col("pk_fornecedor").alias("fk_fornecedor"))
    who = t["dim_socio"].select(F.col("pk_socio").alias("fk_socio"), "nome")
    return _and_remove(own.join(t["bridge_fornecedor_socio"], "fk_fornecedor").join(who, "fk_socio").select("cnpj", "nome"), d, where)


@_query("star_bucketed_totals", "SELECT cnpj, count(*) AS n_contratos, CAST(sum(valor) AS DECIMAL(28,2)) AS total, min(data_assinatura) AS first FROM contract_v JOIN supplier_v ON fk_fornecedor = pk_fornecedor GROUP BY 1")
def star_bucketed_totals(d, where):
    """The rules' aggregation over the bucketed fact table: contracts are not shuffled to be grouped."""
    layout.write(d.contracts, f"{where}/fato_contrato", layout.LAYOUT["fato_contrato"])
    deals = layout.read(d.spark, f"{where}/fato_contrato", layout.LAYOUT["fato_contrato"])
    per = core.per_supplier(deals).join(d.suppliers.select("cnpj", F.col("pk_fornecedor").alias("fk_fornecedor")), "fk_fornecedor")
    return _and_remove(per.select("cnpj", "n_contratos", F.col("total").cast("decimal(28,2)").alias("total"), "first"), d, where)


def _surplus(table: str, rule: str, column: str, source: str, key: str) -> str:
    return f"SELECT '{table}', '{rule}', '{column}', CAST(sum(n - 1) AS BIGINT), min(CAST(k AS VARCHAR)) FROM (SELECT {key} AS k, count(*) AS n FROM {source} WHERE {key} IS NOT NULL GROUP BY 1) WHERE n > 1"


@_query(
    "star_violations",
    """, own_v AS (
  SELECT pk_fornecedor, CASE WHEN pk_fornecedor % 50 = 7 THEN lpad(CAST(pk_fornecedor - 1 AS VARCHAR), 8, '0') || '000100' ELSE cnpj END AS cnpj,
    CASE WHEN pk_fornecedor % 40 <> 3 THEN razao_social END AS razao_social FROM supplier_v
  UNION ALL SELECT pk_fornecedor, 'again' || cnpj, razao_social FROM supplier_v WHERE pk_fornecedor % 60 = 5),
fact_v AS (
  SELECT pk_contrato, CASE WHEN pk_contrato % 500 = 11 THEN fk_fornecedor + 1000000000 ELSE fk_fornecedor END AS fk_fornecedor,
    CASE WHEN pk_contrato % 1000 = 3 THEN 'x' || CAST(valor AS VARCHAR) WHEN pk_contrato % 997 <> 1 THEN CAST(valor AS VARCHAR) END AS valor FROM contract_v)
SELECT * FROM (
SELECT 'dim_fornecedor' AS tabela, 'nulo' AS regra, 'razao_social' AS coluna, count(*) AS n, CAST(NULL AS VARCHAR) AS exemplo FROM own_v WHERE razao_social IS NULL
UNION ALL """
    + _surplus("dim_fornecedor", "chave", "pk_fornecedor", "own_v", "pk_fornecedor")
    + " UNION ALL "
    + _surplus("dim_fornecedor", "unico", "cnpj", "own_v", "cnpj")
    + " UNION ALL "
    + _surplus("fato_contrato", "chave", "pk_contrato", "fact_v", "pk_contrato")
    + """
UNION ALL SELECT 'fato_contrato', 'tipo', 'valor', count(*), min(valor) FROM fact_v WHERE starts_with(valor, 'x')
UNION ALL SELECT 'fato_contrato', 'nulo', 'valor', count(*), NULL FROM fact_v WHERE valor IS NULL
UNION ALL SELECT 'fato_contrato', 'referencia', 'fk_fornecedor', count(*), min(CAST(fk_fornecedor AS VARCHAR)) FROM fact_v WHERE fk_fornecedor NOT IN (SELECT pk_fornecedor FROM own_v)) WHERE n > 0""",
)
def star_violations(d, where):
    """A load with a breach of each kind: nothing of it would be published."""
    k, c = F.col("pk_fornecedor"), F.col("pk_contrato")
    near = F.concat(F.lpad((k - 1).cast("string"), 8, "0"), F.lit("000100"))
    own = d.suppliers.select(k, F.when(k % 50 == 7, near).otherwise(F.col("cnpj")).alias("cnpj"), F.when(k % 40 != 3, F.col("razao_social")).alias("razao_social"))
    own = own.unionByName(d.suppliers.filter(k % 60 == 5).select(k, F.concat(F.lit("again"), "cnpj").alias("cnpj"), "razao_social"))
    value = F.col("valor").cast("string")
    facts = d.contracts.select(c, F.when(c % 500 == 11, F.col("fk_fornecedor") + 1_000_000_000).otherwise(F.col("fk_fornecedor")).alias("fk_fornecedor"), F.when(c % 1000 == 3, F.concat(F.lit("x"), value)).when(c % 997 != 1, value).alias("valor"))
    return schema.check({"dim_fornecedor": own, "fato_contrato": facts})
