"""Registered procurement queries over the driver's tables, and their SQL equivalents."""

from __future__ import annotations

import hmac

from pyspark.sql import functions as F

from sentinela import functions as fn
from sentinela.operators import alerts, core, graph, score
from sentinela.plans import export, serving
from sentinela.plans.driver_map import KEY, VIEWS, Domain

QUERIES: dict = {}
ORACLE: dict = {}


def _query(name: str, sql: str | None, views: bool = True):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            ORACLE[name] = f"WITH {VIEWS}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if views else sql
        return f

    return add


def _ind(name: str, evidence: str, description: str, source: str) -> str:
    from sentinela.constants import WEIGHTS

    return f"SELECT fk_fornecedor, '{name}' AS indicador, {WEIGHTS[name]} AS peso, {description} AS descricao, {evidence} AS evidencia FROM ({source})"


S = lambda x: f"CAST({x} AS VARCHAR)"
IND_SQL = {
    "ind_low_capital": _ind("CAPITAL_SOCIAL_BAIXO", f"'capital=' || {S('c')} || ', valor_total_contratos=' || {S('t')}", f"'Capital social R$' || {S('c')} || ' desproporcional a contratos R$' || {S('t')}", "SELECT pk_fornecedor AS fk_fornecedor, capital_social AS c, t FROM supplier_v JOIN (SELECT fk_fornecedor, sum(valor) AS t FROM contract_v GROUP BY 1) ON fk_fornecedor = pk_fornecedor WHERE capital_social < 10000 AND t > 100000"),
    "ind_recent_company": _ind("EMPRESA_RECENTE", f"'data_abertura=' || {S('o')} || ', primeiro_contrato=' || {S('f')} || ', dias=' || {S('f - o')}", f"'Empresa aberta em ' || {S('o')} || ' obteve primeiro contrato em ' || {S('f')} || ' (' || {S('f - o')} || ' dias depois)'", "SELECT pk_fornecedor AS fk_fornecedor, data_abertura AS o, f FROM supplier_v JOIN (SELECT fk_fornecedor, min(data_assinatura) AS f FROM contract_v GROUP BY 1) ON fk_fornecedor = pk_fornecedor WHERE f - data_abertura < 182.64"),
    "ind_past_sanction": _ind("SANCAO_HISTORICA", f"'sancoes_expiradas=' || {S('n')}", f"{S('n')} || ' sancao(oes) historica(s) expirada(s)'", "SELECT fk_fornecedor, count(*) AS n FROM sanction_v WHERE data_fim <= DATE '2024-02-01' AND fk_fornecedor IN (SELECT pk_fornecedor FROM supplier_v) GROUP BY 1"),
    "ind_multi_company_partner": _ind("SOCIO_EM_MULTIPLAS_FORNECEDORAS", "'socios=[' || w || ']'", f"{S('n')} || ' socio(s) presente(s) em 3+ empresas fornecedoras do governo'", f"SELECT fk_fornecedor, count(*) AS n, string_agg('(''' || nome_socio || ''', ' || {S('qtd_empresas_governo')} || ')', ', ' ORDER BY nome_socio) AS w FROM partner_v WHERE qtd_empresas_governo >= 3 GROUP BY 1"),
    "ind_exclusive_buyer": _ind("FORNECEDOR_EXCLUSIVO", f"'orgao_codigo=' || {S('b')} || ', qtd_contratos=' || {S('n')}", f"'Todos os ' || {S('n')} || ' contrato(s) sao com o mesmo orgao'", "SELECT fk_fornecedor, min(fk_orgao) AS b, count(*) AS n FROM contract_v WHERE fk_fornecedor IN (SELECT pk_fornecedor FROM supplier_v) GROUP BY 1 HAVING count(DISTINCT fk_orgao) = 1 AND count(fk_orgao) = count(*)"),
    "ind_incompatible_activity": _ind("CNAE_INCOMPATIVEL", "'cnae=' || c || ', categoria_cnae=' || k || ', objeto_categoria=' || b", "'CNAE ' || c || ' (' || k || ') incompativel com objeto contratado (' || b || ')'", "SELECT fk_fornecedor, cnae_principal AS c, CASE cnae_principal WHEN '6201-5' THEN 'TECNOLOGIA' WHEN '4120-4' THEN 'CONSTRUCAO' ELSE 'LIMPEZA' END AS k, min(objeto_categoria) AS b FROM contract_v JOIN supplier_v ON fk_fornecedor = pk_fornecedor WHERE (cnae_principal = '6201-5' AND objeto_categoria IN ('CONSTRUCAO', 'SAUDE', 'ALIMENTACAO', 'LIMPEZA')) OR (cnae_principal = '4120-4' AND objeto_categoria IN ('TECNOLOGIA', 'SAUDE', 'ALIMENTACAO', 'SEGURANCA')) OR (cnae_principal = '8121-4' AND objeto_categoria IN ('TECNOLOGIA', 'CONSTRUCAO', 'SAUDE')) GROUP BY 1, 2"),
    "ind_same_address": _ind("MESMO_ENDERECO", "'endereco=' || a || ', cnpj_parceiro=' || o", "'Compartilha endereco com ' || o", "SELECT x.pk_fornecedor AS fk_fornecedor, x.a, min(y.cnpj) AS o FROM address_v x JOIN address_v y ON x.a = y.a AND x.cnpj <> y.cnpj GROUP BY 1, 2"),
    "ind_sudden_growth": _ind("CRESCIMENTO_SUBITO", f"'ano_anterior=' || {S('y - 1')} || ', valor_anterior=' || {S('p')} || ', ano_atual=' || {S('y')} || ', valor_atual=' || {S('v')} || ', razao=' || {S('r')} || 'x'", f"'Valor contratado saltou ' || {S('r')} || 'x entre ' || {S('y - 1')} || ' e ' || {S('y')}", "SELECT *, CAST(round(CAST(v AS DOUBLE) / CAST(p AS DOUBLE), 1) AS DECIMAL(18,1)) AS r FROM (SELECT a.fk_fornecedor, a.y, a.v, b.v AS p, row_number() OVER (PARTITION BY a.fk_fornecedor ORDER BY a.y DESC) AS n FROM year_v a JOIN year_v b ON a.fk_fornecedor = b.fk_fornecedor AND a.y = b.y + 1 WHERE b.v > 0 AND a.v >= 5 * b.v) WHERE n = 1"),
    "ind_no_employees": _ind("SEM_FUNCIONARIOS", "'qtd_funcionarios=0, contratos_governamentais=sim'", "'Empresa declara zero funcionarios no RAIS mas possui contratos governamentais'", "SELECT pk_fornecedor AS fk_fornecedor FROM supplier_v WHERE qtd_funcionarios = 0 AND pk_fornecedor IN (SELECT fk_fornecedor FROM contract_v)"),
}
EXTRA = """,
address_v AS (SELECT pk_fornecedor, cnpj, upper(regexp_extract(logradouro, '^(.*?),?\\s*\\d+', 1)) || '|' || regexp_extract(logradouro, '(\\d+)', 1) AS a FROM supplier_v),
year_v AS (SELECT fk_fornecedor, year(data_assinatura) AS y, sum(valor) AS v FROM contract_v GROUP BY 1, 2)
"""
IND = {
    "ind_low_capital": lambda d: score.low_capital(d.suppliers, d.contracts),
    "ind_recent_company": lambda d: score.recent_company(d.suppliers, d.contracts),
    "ind_past_sanction": lambda d: score.past_sanction(d.suppliers, d.sanctions, d.ref_date),
    "ind_multi_company_partner": lambda d: score.multi_company_partner(d.suppliers, d.partners),
    "ind_exclusive_buyer": lambda d: score.exclusive_buyer(d.suppliers, d.contracts),
    "ind_incompatible_activity": lambda d: score.incompatible_activity(d.suppliers, d.contracts),
    "ind_same_address": lambda d: score.shared_address(d.suppliers),
    "ind_sudden_growth": lambda d: score.sudden_growth(d.suppliers, d.contracts),
    "ind_no_employees": lambda d: score.no_employees(d.suppliers, d.contracts),
}
for _name, _f in IND.items():
    _query(_name, EXTRA + IND_SQL[_name])(_f)


def _alert(name: str, evidence: str, description: str, source: str) -> str:
    from sentinela.constants import SEVERITY

    return f"SELECT fk_fornecedor, fk_socio, '{name}' AS tipo_alerta, '{SEVERITY[name]}' AS severidade, {description} AS descricao, {evidence} AS evidencia FROM ({source})"


NONE = "CAST(NULL AS BIGINT) AS fk_socio"
ALERT_SQL = {
    "alert_servant_partner": _alert("SOCIO_SERVIDOR_PUBLICO", "'nome=' || nome_socio || coalesce(', orgao=' || orgao_lotacao, '')", "'Socio ' || nome_socio || ' e servidor publico' || coalesce(' (' || orgao_lotacao || ')', '')", "SELECT *, pk_socio AS fk_socio FROM partner_v WHERE is_servidor_publico"),
    "alert_sanctioned_contracting": _alert("EMPRESA_SANCIONADA_CONTRATANDO", f"'sancoes_vigentes=' || {S('s')} || ', qtd_contratos=' || {S('c')}", f"'Empresa com ' || {S('s')} || ' sancao(oes) vigente(s) e ' || {S('c')} || ' contrato(s) ativo(s)'", f"SELECT fk_fornecedor, {NONE}, s, c FROM (SELECT fk_fornecedor, count(*) AS s FROM live_v GROUP BY 1) JOIN (SELECT fk_fornecedor, count(*) AS c FROM contract_v GROUP BY 1) USING (fk_fornecedor) WHERE fk_fornecedor IN (SELECT pk_fornecedor FROM supplier_v)"),
    "alert_donor_contractor": _alert("DOACAO_PARA_CONTRATANTE", f"'doacoes_materiais=' || {S('d')} || ', valor_total_contratos=' || {S('t')}", f"{S('d')} || ' doacao(oes) material(is) com contratos totalizando R$' || format('{{:,.2f}}', CAST(t AS DOUBLE))", f"SELECT fk_fornecedor, {NONE}, d, t FROM (SELECT fk_fornecedor, count(*) AS d FROM donation_v WHERE valor > 10000 GROUP BY 1) JOIN (SELECT fk_fornecedor, sum(valor) AS t FROM contract_v GROUP BY 1) USING (fk_fornecedor) WHERE t > 500000 AND fk_fornecedor IN (SELECT pk_fornecedor FROM supplier_v)"),
    "alert_sanctioned_partner": _alert("SOCIO_SANCIONADO_EM_OUTRA", "'nome=' || nome_socio || ', empresa_sancionada_cnpj=' || sancionado_cnpj_basico || ', empresa_sancionada_razao=' || sancionado_razao_social", "'Socio ' || nome_socio || ' e socio de empresa sancionada ' || sancionado_razao_social", "SELECT *, pk_socio AS fk_socio FROM partner_v WHERE is_sancionado"),
    "alert_bid_rotation": _alert("RODIZIO_LICITACAO", f"'max_licitacoes_comuns_com_par=' || {S('n')}", "'Empresa participa de licitacoes com outra empresa que compartilha socios'", f"SELECT fk_fornecedor, {NONE}, max(n) AS n FROM (SELECT a, b, n, unnest([a, b]) AS fk_fornecedor FROM rotation_v) GROUP BY 1"),
    "alert_front_company": _alert("EMPRESA_DE_FACHADA", f"'capital_social=' || {S('capital_social')} || ', data_abertura=' || {S('data_abertura')} || ', primeiro_contrato=' || {S('f')}", "'Empresa apresenta perfil composto de empresa de fachada: capital baixo, entrada rapida em licitacoes, fornecedor exclusivo e socio suspeito'", f"SELECT pk_fornecedor AS fk_fornecedor, {NONE}, capital_social, data_abertura, f FROM supplier_v s JOIN (SELECT fk_fornecedor, min(data_assinatura) AS f FROM contract_v GROUP BY 1 HAVING count(DISTINCT fk_orgao) = 1) ON fk_fornecedor = pk_fornecedor WHERE capital_social < 10000 AND f - data_abertura < 365 AND EXISTS (SELECT 1 FROM partner_v p WHERE p.cnpj_basico = s.cnpj_basico AND (p.is_servidor_publico OR p.qtd_empresas_governo >= 3))"),
}
EXTRA_A = """,
bid_v AS (SELECT DISTINCT fk_fornecedor, num_licitacao FROM contract_v WHERE num_licitacao IS NOT NULL),
pair_v AS (SELECT DISTINCT x.fk_fornecedor AS a, y.fk_fornecedor AS b FROM partner_v x JOIN partner_v y ON x.nome_socio = y.nome_socio AND x.fk_fornecedor < y.fk_fornecedor),
rotation_v AS (SELECT a, b, count(DISTINCT x.num_licitacao) AS n FROM pair_v JOIN bid_v x ON x.fk_fornecedor = a JOIN bid_v y ON y.fk_fornecedor = b AND y.num_licitacao = x.num_licitacao GROUP BY 1, 2 HAVING count(DISTINCT x.num_licitacao) >= 3)
"""
ALERT = {
    "alert_servant_partner": lambda d: alerts.servant_partner(d.suppliers, d.partners),
    "alert_sanctioned_contracting": lambda d: alerts.sanctioned_contracting(d.suppliers, d.contracts, d.sanctions, d.ref_date),
    "alert_donor_contractor": lambda d: alerts.donor_contractor(d.suppliers, d.contracts, d.donations),
    "alert_sanctioned_partner": lambda d: alerts.sanctioned_partner(d.suppliers, d.partners),
    "alert_bid_rotation": lambda d: alerts.bid_rotation(d.suppliers, d.partners, d.contracts),
    "alert_front_company": lambda d: alerts.front_company(d.suppliers, d.partners, d.contracts),
}
for _name, _f in ALERT.items():
    _query(_name, EXTRA_A + ALERT_SQL[_name])(_f)

#: All of it: scores, alerts and the denormalised supplier.
DIM = EXTRA + EXTRA_A + ", score_v AS (" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in IND_SQL.values()) + "), alert_v AS (" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in ALERT_SQL.values()) + """),
dim_v AS (
  SELECT s.*, coalesce(p, 0) AS score_risco, coalesce(n, 0) AS qtd_alertas, CASE m WHEN 2 THEN 'GRAVISSIMO' WHEN 1 THEN 'GRAVE' END AS max_severidade, coalesce(c, 0) AS total_contratos, coalesce(v, 0) AS valor_total,
    CASE WHEN coalesce(p, 0) >= 70 THEN 'Critico' WHEN coalesce(p, 0) >= 50 THEN 'Alto' WHEN coalesce(p, 0) >= 30 THEN 'Medio' WHEN coalesce(p, 0) >= 10 THEN 'Baixo' ELSE 'Minimo' END AS faixa_risco
  FROM supplier_v s
  LEFT JOIN (SELECT fk_fornecedor, sum(peso) AS p FROM score_v GROUP BY 1) a ON a.fk_fornecedor = pk_fornecedor
  LEFT JOIN (SELECT fk_fornecedor, count(*) AS n, max(CASE severidade WHEN 'GRAVISSIMO' THEN 2 ELSE 1 END) AS m FROM alert_v GROUP BY 1) b ON b.fk_fornecedor = pk_fornecedor
  LEFT JOIN (SELECT fk_fornecedor, count(*) AS c, sum(valor) AS v FROM contract_v GROUP BY 1) d ON d.fk_fornecedor = pk_fornecedor)
"""
DIM_COLUMNS = "pk_fornecedor, cnpj, razao_social, CAST(score_risco AS BIGINT) AS score_risco, faixa_risco, qtd_alertas, max_severidade, total_contratos, CAST(valor_total AS DECIMAL(28,2)) AS valor_total"


def _dim(df):
    return df.select("pk_fornecedor", "cnpj", "razao_social", F.col("score_risco").cast("long"), "faixa_risco", "qtd_alertas", "max_severidade", "total_contratos", F.col("valor_total").cast("decimal(28,2)"))


_query("score_details", DIM + "SELECT * FROM score_v")(lambda d: d.scores)
_query("alert_facts", DIM + "SELECT * FROM alert_v")(lambda d: d.alerts)
_query("denormalize_supplier", DIM + f"SELECT {DIM_COLUMNS} FROM dim_v")(lambda d: _dim(d.dimension))

def _object_kind(text: str) -> str:
    """SQL for the category of a contract's object."""
    from sentinela.constants import OBJECT_WORDS

    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in OBJECT_WORDS.items()) + " END"


ONLINE_SQL = {
    **IND_SQL,
    "ind_low_capital": IND_SQL["ind_low_capital"].replace("t > 100000", "t >= 100000"),
    "ind_past_sanction": IND_SQL["ind_past_sanction"].replace("data_fim <= DATE '2024-02-01'", "data_fim < DATE '2024-02-01'"),
    "ind_incompatible_activity": _ind(
        "CNAE_INCOMPATIVEL",
        "'cnae=' || c || ', categoria_cnae=' || k || ', objeto_categoria=' || b",
        "'CNAE ' || c || ' (' || k || ') incompativel com objeto contratado (' || b || ')'",
        f"SELECT fk_fornecedor, c, k, arg_min(b, struct_pack(d := data_assinatura, p := pk_contrato)) AS b FROM (SELECT fk_fornecedor, data_assinatura, pk_contrato, {_object_kind('objeto')} AS b FROM contract_v) x JOIN (SELECT pk_fornecedor, cnae_principal AS c FROM supplier_v) s ON pk_fornecedor = fk_fornecedor JOIN bad_v ON bad_v.code = c AND bad_v.bad = b GROUP BY 1, 2, 3",
    ),
    "ind_same_address": _ind("MESMO_ENDERECO", f"'qtd_mesmo_endereco=' || {S('n')}", f"'Compartilha endereco com ' || {S('n')} || ' outro(s) fornecedor(es) do governo'", "SELECT pk_fornecedor AS fk_fornecedor, n FROM (SELECT pk_fornecedor, count(*) OVER (PARTITION BY logradouro) - 1 AS n FROM supplier_v) WHERE n >= 2"),
    "ind_sudden_growth": IND_SQL["ind_sudden_growth"].replace("ORDER BY a.y DESC", "ORDER BY a.y").replace("a.v >= 5 * b.v", "a.v >= 5 * b.v AND a.v >= 200000"),
}


def _bad_view() -> str:
    from sentinela.constants import ACTIVITY_CODES, INCOMPATIBLE

    return "bad_v AS (SELECT * FROM (VALUES " + ", ".join(f"('{code}', '{kind}', '{bad}')" for kind, codes in ACTIVITY_CODES.items() for code in codes for bad in INCOMPATIBLE[kind]) + ") t(code, k, bad))"


EXTRA_O = f"{EXTRA.rstrip()}, {_bad_view()} "
SCORE_O = EXTRA_O + ", online_v AS (" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in ONLINE_SQL.values()) + ") "
_query("score_details_online", SCORE_O + "SELECT * FROM online_v")(lambda d: d.scores_online)
_query("score_total_online", SCORE_O + "SELECT fk_fornecedor, least(100, sum(peso))::BIGINT AS score, CASE WHEN sum(peso) >= 66 THEN 'Critico' WHEN sum(peso) >= 41 THEN 'Alto' WHEN sum(peso) >= 21 THEN 'Moderado' ELSE 'Baixo' END AS faixa FROM online_v GROUP BY 1")(lambda d: score.total(d.scores_online).select("fk_fornecedor", F.col("score").cast("long"), "faixa"))
_query("ind_past_sanction_online", EXTRA_O + ONLINE_SQL["ind_past_sanction"])(lambda d: score.past_sanction(d.suppliers, d.sanctions, d.ref_date, "online"))
_query("ind_incompatible_activity_online", EXTRA_O + ONLINE_SQL["ind_incompatible_activity"])(lambda d: score.incompatible_activity_online(d.suppliers, d.contracts))
_query("ind_same_address_online", EXTRA_O + ONLINE_SQL["ind_same_address"])(lambda d: score.neighbours(d.suppliers))
_THROUGH = "(SELECT DISTINCT pk_doacao, f AS fk_fornecedor, valor FROM (SELECT pk_doacao, fk_fornecedor AS f, valor FROM donation_v WHERE fk_fornecedor IS NOT NULL UNION ALL SELECT pk_doacao, r.fk_fornecedor, valor FROM donation_v JOIN raw_partner_v r ON pk_socio = fk_socio))"
_query("alert_donor_contractor_online", EXTRA_A + ALERT_SQL["alert_donor_contractor"].replace("FROM donation_v", f"FROM {_THROUGH}"))(lambda d: alerts.donor_contractor(d.suppliers, d.per_supplier, d.donations, d.bridge))
_query("ind_low_capital_online", EXTRA + IND_SQL["ind_low_capital"].replace("t > 100000", "t >= 100000"))(lambda d: score.low_capital(d.suppliers, d.contracts, "online"))
_query("ind_sudden_growth_online", EXTRA + IND_SQL["ind_sudden_growth"].replace("ORDER BY a.y DESC", "ORDER BY a.y").replace("a.v >= 5 * b.v", "a.v >= 5 * b.v AND a.v >= 200000"))(lambda d: score.sudden_growth(d.suppliers, d.contracts, "online"))
_query("alert_sanctioned_contracting_online", EXTRA_A + ALERT_SQL["alert_sanctioned_contracting"].replace("FROM live_v", "FROM sanction_v WHERE data_fim IS NULL OR data_fim >= DATE '2024-02-01'"))(lambda d: alerts.sanctioned_contracting(d.suppliers, d.contracts, d.sanctions, d.ref_date, inclusive=True))
_query("dossier_same_address_online", "SELECT pk_fornecedor, n FROM (SELECT pk_fornecedor, count(*) OVER (PARTITION BY logradouro) - 1 AS n FROM supplier_v) WHERE n >= 2")(lambda d: serving.supplier_with_neighbours(d.suppliers).filter("qtd_mesmo_endereco >= 2").select("pk_fornecedor", F.col("qtd_mesmo_endereco").alias("n")))

# Keys and enrichment
_query("fk_resolve_contracts", "SELECT pk_contrato, pk_fornecedor AS fk_fornecedor FROM contract_v LEFT JOIN supplier_v ON cnpj = regexp_replace(cnpj_fornecedor, '[^0-9]', '', 'g')")(lambda d: core.resolve_contracts(d.contracts, d.suppliers).select("pk_contrato", "fk_fornecedor"))
_query("fk_resolve_sanctions", "SELECT pk_sancao, pk_fornecedor AS fk_fornecedor FROM sanction_v c LEFT JOIN supplier_v s ON s.cnpj = c.cnpj")(lambda d: core.resolve_sanctions(d.sanctions, d.suppliers).select("pk_sancao", "fk_fornecedor"))
_query("fk_resolve_donations", "SELECT pk_doacao, pk_fornecedor AS fk_fornecedor FROM donation_v LEFT JOIN supplier_v ON cnpj = doc_doador AND tipo_doador = 'CNPJ'")(lambda d: core.resolve_donations(d.donations, d.suppliers).select("pk_doacao", "fk_fornecedor"))
_query("servant_match", "SELECT pk_socio, is_servidor_publico, orgao_lotacao FROM partner_v")(lambda d: core.match_servants(d.raw_partners, d.servants).select("pk_socio", "is_servidor_publico", "orgao_lotacao"))
_ENRICHED = ["pk_socio", "nome_socio", "is_sancionado", "sancionado_cnpj_basico", "sancionado_razao_social", "qtd_empresas_governo"]
_query("partner_enrichment", f"SELECT {', '.join(_ENRICHED)} FROM partner_v")(lambda d: d.partners.select(*_ENRICHED))
_query("same_address_pairs", EXTRA + "SELECT x.cnpj AS cnpj_a, y.cnpj AS cnpj_b, x.a AS endereco_compartilhado FROM address_v x JOIN address_v y ON x.a = y.a AND x.cnpj < y.cnpj")(lambda d: core.same_address(d.suppliers))
_query("partner_staging", "SELECT row_number() OVER (ORDER BY cnpj_basico, nome_socio) AS pk, nome_socio AS nome, cnpj_basico FROM raw_partner_v")(lambda d: core.number_rows(d.raw_partners.select(F.col("nome_socio").alias("nome"), "cnpj_basico"), "pk", ["cnpj_basico", "nome"]))


def _hmac_sql(text: str) -> str:
    """SQL for HMAC-SHA256 of a text with KEY: SHA-256 over the padded key and the message, twice."""
    pad = lambda x: "".join(f"{b ^ x:02x}" for b in KEY.encode().ljust(64, b"\0"))
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({text}))))"


_query("cpf_hmac", f"SELECT pk_socio, {_hmac_sql('cpf_parcial')} AS cpf_hmac FROM raw_partner_v")(lambda d: core.hash_column(d.raw_partners.select("pk_socio", "cpf_parcial"), "cpf_parcial", KEY, "cpf_hmac"))
# Validation and merges
_query("dedup_keep_first", "SELECT num_licitacao, pk_contrato, valor FROM (SELECT *, row_number() OVER (PARTITION BY num_licitacao ORDER BY pk_contrato, valor) AS n FROM contract_v) WHERE n = 1")(lambda d: core.keep_first(d.contracts, ["num_licitacao"], ["pk_contrato", "valor"]).select("num_licitacao", "pk_contrato", "valor"))
_query("dedup_max_per_group", "SELECT fk_orgao, max(struct_pack(v := valor, k := pk_contrato)).v AS valor, max(struct_pack(v := valor, k := pk_contrato)).k AS pk_contrato FROM contract_v GROUP BY 1")(lambda d: core.keep_most(d.contracts.select("fk_orgao", "valor", "pk_contrato"), "fk_orgao", "valor"))
_query("filter_positive_nonblank", "SELECT pk_contrato FROM contract_v WHERE valor > 0 AND trim(coalesce(num_licitacao, '')) <> ''")(lambda d: d.contracts.filter((F.col("valor") > 0) & ~fn.blank(F.col("num_licitacao"))).select("pk_contrato"))
_query("truncate_text", "SELECT doc_id, substr(text, 1, 1000) AS objeto FROM documents", views=False)(lambda d: d.table("documents").select("doc_id", F.substring("text", 1, 1000).alias("objeto")))
_query("surrogate_key", "SELECT row_number() OVER (ORDER BY cnpj) AS pk, cnpj FROM supplier_v")(lambda d: core.number_rows(d.suppliers.select("cnpj"), "pk", ["cnpj"]))
_query("merge_headcount", "SELECT pk_fornecedor, q AS qtd_funcionarios FROM supplier_v LEFT JOIN (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS r, max(event_id) AS q FROM events GROUP BY 1) ON r = cnpj_basico")(lambda d: core.merge_headcount(d.suppliers, d.table("events").select(F.col("user_id").cast("string").alias("cnpj_basico"), F.col("event_id").alias("qtd_funcionarios"), F.col("event_type").alias("porte_empresa"))).select("pk_fornecedor", "qtd_funcionarios"))
_query("merge_contracts", "SELECT fk_fornecedor, num_licitacao, data_assinatura, fonte, pk_contrato FROM (SELECT *, row_number() OVER (PARTITION BY fk_fornecedor, num_licitacao, data_assinatura ORDER BY fonte, pk_contrato) AS n FROM (SELECT *, CASE WHEN pk_contrato % 2 = 0 THEN 'a' ELSE 'b' END AS fonte FROM contract_v)) WHERE n = 1")(lambda d: core.merge_first([d.contracts.filter("pk_contrato % 2 = 0").withColumn("fonte", F.lit("a")), d.contracts.filter("pk_contrato % 2 <> 0").withColumn("fonte", F.lit("b"))], ["fk_fornecedor", "num_licitacao", "data_assinatura"], ["pk_contrato"]).select("fk_fornecedor", "num_licitacao", "data_assinatura", "fonte", "pk_contrato"))
_query("merge_ownership_diffs", "SELECT cnpj_basico, nome_socio, min(CASE WHEN pk_socio % 3 = 0 THEN 0 ELSE 1 END) AS fonte FROM raw_partner_v GROUP BY 1, 2")(lambda d: core.merge_first([d.raw_partners.filter("pk_socio % 3 = 0").withColumn("fonte", F.lit(0)), d.raw_partners.filter("pk_socio % 3 <> 0").withColumn("fonte", F.lit(1)).withColumn("data_saida", F.lit(None).cast("date"))], ["cnpj_basico", "nome_socio"], ["pk_socio"]).select("cnpj_basico", "nome_socio", "fonte"))
# Graph
EDGE = """,
link_v AS (SELECT DISTINCT nome_socio AS p, cnpj AS c FROM raw_partner_v r JOIN supplier_v s ON s.cnpj_basico = r.cnpj_basico),
few_v AS (SELECT p FROM link_v GROUP BY 1 HAVING count(*) <= 100),
edge_v AS (SELECT p AS origem, c AS destino, 'socio_de' AS tipo FROM link_v UNION ALL SELECT DISTINCT x.c, y.c, 'socio_compartilhado' FROM link_v x JOIN link_v y ON x.p = y.p AND x.c < y.c WHERE x.p IN (SELECT p FROM few_v)),
deg_v AS (SELECT id, count(*) AS grau FROM (SELECT unnest([origem, destino]) AS id FROM edge_v) GROUP BY 1)
"""
_query("graph_edges", EDGE + "SELECT * FROM edge_v")(lambda d: graph.edges(d.suppliers, d.raw_partners))
_query("graph_nodes_topk", EDGE + "SELECT id, CASE WHEN starts_with(id, 'SOCIO') THEN 'socio' ELSE 'empresa' END AS tipo, coalesce(razao_social, id) AS label, grau FROM deg_v LEFT JOIN supplier_v ON cnpj = id ORDER BY grau DESC, id LIMIT 50")(lambda d: (lambda e: graph.top(e, graph.nodes(d.suppliers, d.raw_partners, e))[0])(graph.edges(d.suppliers, d.raw_partners)))
_query("graph_top_edges", EDGE + ", best AS (SELECT id FROM deg_v ORDER BY grau DESC, id LIMIT 50) SELECT * FROM edge_v WHERE origem IN (SELECT id FROM best) AND destino IN (SELECT id FROM best)")(lambda d: (lambda e: graph.top(e, graph.nodes(d.suppliers, d.raw_partners, e))[1])(graph.edges(d.suppliers, d.raw_partners)))
_query("graph_two_hop", ", h1 AS (SELECT DISTINCT y.fk_fornecedor FROM raw_partner_v x JOIN raw_partner_v y ON x.nome_socio = y.nome_socio WHERE x.fk_fornecedor = 7), h2 AS (SELECT DISTINCT y.fk_fornecedor FROM raw_partner_v x JOIN raw_partner_v y ON x.nome_socio = y.nome_socio WHERE x.fk_fornecedor IN (SELECT fk_fornecedor FROM h1)) SELECT fk_fornecedor AS pk_fornecedor, CAST(min(n) AS INTEGER) AS nivel FROM (SELECT 7 AS fk_fornecedor, 0 AS n UNION ALL SELECT fk_fornecedor, 1 FROM h1 UNION ALL SELECT fk_fornecedor, 2 FROM h2) GROUP BY 1")(lambda d: graph.two_hops(d.raw_partners.select("fk_fornecedor", F.col("nome_socio").alias("fk_socio")), d.suppliers.filter("pk_fornecedor = 7")))
# Serving
CNPJ = "00000007000100"
_query("q_supplier_same_address_count", "SELECT pk_fornecedor, cnpj, (SELECT count(*) FROM supplier_v o WHERE o.logradouro = s.logradouro AND o.cnpj <> s.cnpj) AS qtd_mesmo_endereco FROM supplier_v s")(lambda d: serving.supplier_with_neighbours(d.suppliers).select("pk_fornecedor", "cnpj", "qtd_mesmo_endereco"))
_query("q_ranking", DIM + f"SELECT {DIM_COLUMNS} FROM dim_v ORDER BY dim_v.score_risco DESC, pk_fornecedor LIMIT 20")(lambda d: _dim(serving.ranking(d.dimension)))
_query("q_search", "SELECT pk_fornecedor, cnpj, razao_social FROM supplier_v WHERE cnpj LIKE '%0001%' OR razao_social ILIKE '%0001%' ORDER BY 1 LIMIT 20")(lambda d: serving.search(d.suppliers, "0001").select("pk_fornecedor", "cnpj", "razao_social"))
_CONTRACT = "SELECT pk_contrato, valor, objeto, num_licitacao, data_assinatura, data_vigencia, codigo AS orgao_codigo, cnpj FROM contract_v JOIN supplier_v ON fk_fornecedor = pk_fornecedor JOIN agency_v ON fk_orgao = pk_orgao"
_query("q_supplier_contracts", _CONTRACT + f" WHERE cnpj = '{CNPJ}'")(lambda d: serving.contract_list(d.contracts, d.suppliers, d.agencies, cnpj=CNPJ, limit=None))
_query("q_contract_list", _CONTRACT + " WHERE codigo = 'ORG3' ORDER BY data_assinatura DESC NULLS LAST, pk_contrato LIMIT 50 OFFSET 5")(lambda d: serving.contract_list(d.contracts, d.suppliers, d.agencies, agency="ORG3", limit=50, offset=5))
_BOTH = "(SELECT fk_fornecedor FROM (SELECT DISTINCT fk_fornecedor FROM donation_v SEMI JOIN supplier_v ON fk_fornecedor = pk_fornecedor) ORDER BY fk_fornecedor IN (SELECT p.fk_fornecedor FROM donation_v g JOIN raw_partner_v p ON p.pk_socio = g.fk_socio) DESC, fk_fornecedor LIMIT 1)"


def _given_to(d) -> str:
    """The least supplier with donations of its own, and through a partner if there is one."""
    own = d.donations.select("fk_fornecedor").distinct().join(d.suppliers.select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnpj"), "fk_fornecedor")
    through = d.donations.select("fk_socio").join(d.bridge, "fk_socio").select("fk_fornecedor").distinct().withColumn("both", F.lit(True))
    first = own.join(through, "fk_fornecedor", "left").orderBy(F.col("both").desc_nulls_last(), "fk_fornecedor").first()
    return first["cnpj"] if first else ""


_query("q_supplier_donations", f"SELECT pk_doacao, valor, ano_eleicao FROM donation_v WHERE fk_fornecedor = {_BOTH} OR fk_socio IN (SELECT pk_socio FROM raw_partner_v WHERE fk_fornecedor = {_BOTH})")(
    lambda d: serving.supplier_donations(d.donations, d.suppliers, d.bridge, _given_to(d)).select("pk_doacao", "valor", "ano_eleicao")
)
_query("q_supplier_sanctions", "SELECT pk_sancao, tipo_sancao, data_inicio, data_fim FROM sanction_v WHERE fk_fornecedor = 1")(lambda d: serving.of_supplier(d.sanctions, d.suppliers, "00000001000100").select("pk_sancao", "tipo_sancao", "data_inicio", "data_fim"))
_query("q_supplier_partners", "SELECT pk_socio, nome_socio, is_servidor_publico, orgao_lotacao, is_sancionado, qtd_empresas_governo FROM partner_v WHERE fk_fornecedor = 7")(lambda d: serving.of_supplier(d.partners, d.suppliers, CNPJ).select("pk_socio", "nome_socio", "is_servidor_publico", "orgao_lotacao", "is_sancionado", "qtd_empresas_governo"))
_query("q_servant_lookup", f"SELECT nome, orgao_lotacao, cpf_hmac FROM (SELECT *, {_hmac_sql('digitos_visiveis')} AS cpf_hmac FROM servant_v) WHERE cpf_hmac = {_hmac_sql(chr(39) + '000005' + chr(39))} ORDER BY nome, orgao_lotacao NULLS FIRST LIMIT 1")(
    lambda d: serving.servant_by_hash(core.hash_column(d.servants, "digitos_visiveis", KEY, "cpf_hmac"), hmac.new(KEY.encode(), b"000005", "sha256").hexdigest())
)
_FEED = "SELECT tipo_alerta, severidade, descricao, evidencia, cnpj, razao_social, nome_socio AS socio_nome FROM alert_v a JOIN supplier_v ON a.fk_fornecedor = pk_fornecedor LEFT JOIN raw_partner_v p ON p.pk_socio = a.fk_socio"
_query("q_alert_feed", DIM + _FEED + " ORDER BY tipo_alerta, cnpj, evidencia, descricao LIMIT 50")(lambda d: serving.alert_feed(d.alerts, d.suppliers, d.raw_partners))
_query("q_alerts_by_type", DIM + _FEED + " WHERE tipo_alerta = 'SOCIO_SERVIDOR_PUBLICO' ORDER BY tipo_alerta, cnpj, evidencia, descricao LIMIT 50")(lambda d: serving.alert_feed(d.alerts, d.suppliers, d.raw_partners, kind="SOCIO_SERVIDOR_PUBLICO"))
_query("q_alerts_of_supplier", DIM + _FEED + f" WHERE cnpj = '{CNPJ}'")(lambda d: serving.alert_feed(d.alerts, d.suppliers, d.raw_partners, cnpj=CNPJ, limit=None))
_query("q_stats", "SELECT 'fornecedores' AS tabela, count(*) AS n FROM supplier_v UNION ALL SELECT 'contratos', count(*) FROM contract_v UNION ALL SELECT 'socios', count(*) FROM raw_partner_v UNION ALL SELECT 'sancoes', count(*) FROM sanction_v UNION ALL SELECT 'doacoes', count(*) FROM donation_v")(lambda d: serving.counts(fornecedores=d.suppliers, contratos=d.contracts, socios=d.raw_partners, sancoes=d.sanctions, doacoes=d.donations))
_query("q_agency_summary", "SELECT codigo, nome, count(pk_contrato) AS qtd_contratos, CAST(coalesce(sum(valor), 0) AS DECIMAL(28,2)) AS total_contratado, count(DISTINCT fk_fornecedor) AS qtd_fornecedores FROM agency_v LEFT JOIN contract_v ON fk_orgao = pk_orgao GROUP BY 1, 2")(lambda d: serving.agency_summary(d.contracts, d.agencies))
_query("q_agency_top10", DIM + "SELECT sum(valor) AS valor_total_orgao, count(*) AS qtd_contratos, cnpj, razao_social, CAST(any_value(score_risco) AS BIGINT) AS score_risco FROM contract_v JOIN dim_v ON fk_fornecedor = pk_fornecedor WHERE fk_orgao = 1 GROUP BY cnpj, razao_social ORDER BY 1 DESC, cnpj LIMIT 10")(lambda d: serving.agency_top(d.contracts, d.dimension, d.agencies, "ORG1").withColumn("score_risco", F.col("score_risco").cast("long")))
#: The nested lists of a dossier: the fields of a line, and where SQL finds them.
_SECTIONS = {
    "indicadores": (["indicador", "peso", "descricao", "evidencia"], "score_v", "fk_fornecedor"),
    "alertas": (["tipo_alerta", "severidade", "descricao", "evidencia"], "alert_v", "fk_fornecedor"),
    "socios": (["nome_socio", "is_servidor_publico", "orgao_lotacao", "is_sancionado", "qtd_empresas_governo"], "partner_v", "fk_fornecedor"),
    "sancoes": (["tipo_sancao", "data_inicio", "data_fim"], "sanction_v", "fk_fornecedor"),
    "contratos": (["pk_contrato", "valor", "data_assinatura", "objeto"], "contract_v", "fk_fornecedor"),
    "doacoes": (["pk_doacao", "valor", "ano_eleicao"], "donation_v", "fk_fornecedor"),
}


def _lines_sql(fields: list[str], view: str, key: str, sep: str) -> str:
    line = f" || '{sep}' || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields)
    return f"(SELECT {key}, string_agg(x, chr(10) ORDER BY x) AS lines FROM (SELECT {key}, {line} AS x FROM {view}) GROUP BY 1)"


def _lines(column: str, fields: list[str]):
    """The list as text, a line each, in the order of the lines."""
    return F.array_join(F.array_sort(F.transform(column, lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("")) for f in fields]))), "\n")


_query(
    "supplier_dossier",
    DIM + f"SELECT cnpj, CAST(score_risco AS BIGINT) AS score_risco, faixa_risco, {', '.join(f'{n}.lines AS {n}' for n in _SECTIONS)} FROM dim_v " + " ".join(f"LEFT JOIN {_lines_sql(*v, '|')} {n} ON {n}.{v[2]} = pk_fornecedor" for n, v in _SECTIONS.items()),
)(lambda d: serving.dossier(d).select("cnpj", F.col("score_risco").cast("long"), "faixa_risco", *[_lines(n, v[0]).alias(n) for n, v in _SECTIONS.items()]))
_query(
    "dossier_json",
    DIM + "SELECT cnpj, razao_social, CAST(CAST(capital_social AS DOUBLE) AS VARCHAR) AS capital_social, CAST(data_abertura AS VARCHAR) AS data_abertura, CAST(CAST(score_risco AS BIGINT) AS VARCHAR) AS score_risco, "
    "(SELECT min(indicador) FROM score_v WHERE fk_fornecedor = pk_fornecedor) AS primeiro_indicador, (SELECT CAST(min(pk_contrato) AS VARCHAR) FROM contract_v WHERE fk_fornecedor = pk_fornecedor) AS primeiro_contrato, "
    "(SELECT CAST(min_by(is_servidor_publico, nome_socio) AS VARCHAR) FROM partner_v WHERE fk_fornecedor = pk_fornecedor) AS primeiro_socio_servidor FROM dim_v",
)(lambda d: serving.dossier_json(serving.dossier(d)).select("cnpj", *[F.get_json_object("json", path).alias(n) for n, path in (("razao_social", "$.razao_social"), ("capital_social", "$.capital_social"), ("data_abertura", "$.data_abertura"), ("score_risco", "$.score_risco"), ("primeiro_indicador", "$.indicadores[0].indicador"), ("primeiro_contrato", "$.contratos[0].pk_contrato"), ("primeiro_socio_servidor", "$.socios[0].is_servidor_publico"))]))


def _csv_sql() -> str:
    head = " UNION ALL ".join(f"SELECT cnpj, 'DADOS CADASTRAIS' AS secao, '{label},' || coalesce(CAST({c} AS VARCHAR), '') AS linha FROM supplier_v" for label, c in (("CNPJ", "cnpj"), ("Razao Social", "razao_social"), ("Data Abertura", "data_abertura"), ("Capital Social", "capital_social"), ("CNAE", "cnae_principal")))
    for section, view, fields in (("SCORE DE RISCO", "score_v", ["indicador", "peso", "descricao"]), ("ALERTAS CRITICOS", "alert_v", ["tipo_alerta", "severidade", "descricao"]), ("CONTRATOS", "contract_v", ["valor", "data_assinatura", "objeto"]), ("SOCIOS", "partner_v", ["nome_socio", "is_servidor_publico", "orgao_lotacao"])):
        line = " || ',' || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields)
        head += f" UNION ALL SELECT cnpj, '{section}', {line} FROM {view} JOIN (SELECT pk_fornecedor AS k, cnpj FROM supplier_v) ON k = fk_fornecedor".replace("SELECT cnpj, '", "SELECT s.cnpj, '").replace("FROM supplier_v) ON", "FROM supplier_v) s ON")
    return head


_query("dossier_csv", DIM + _csv_sql())(lambda d: export.lines(d).select("cnpj", "secao", "linha"))
_query("q_alert_count", DIM + "SELECT count(*) AS n FROM alert_v")(lambda d: serving.alert_count(d.alerts))
NEAR = ", h1 AS (SELECT DISTINCT y.fk_fornecedor FROM raw_partner_v x JOIN raw_partner_v y USING (nome_socio) WHERE x.fk_fornecedor = 7), near_v AS (SELECT DISTINCT y.fk_fornecedor FROM raw_partner_v x JOIN raw_partner_v y USING (nome_socio) WHERE x.fk_fornecedor IN (SELECT fk_fornecedor FROM h1)) "


def _network(d):
    names = d.raw_partners.groupBy("nome_socio").agg(F.min("pk_socio").alias("pk_socio"))
    bridge = d.raw_partners.drop("pk_socio").join(names, "nome_socio").select("fk_fornecedor", F.col("pk_socio").alias("fk_socio"))
    return graph.supplier_network(bridge, d.suppliers, names, d.suppliers.filter("pk_fornecedor = 7"))


_query("graph_network_nodes", NEAR + "SELECT 'empresa_' || pk_fornecedor AS id, 'empresa' AS tipo, razao_social AS label FROM supplier_v WHERE pk_fornecedor IN (SELECT * FROM near_v) UNION ALL SELECT 'socio_' || min(pk_socio), 'socio', nome_socio FROM raw_partner_v WHERE nome_socio IN (SELECT nome_socio FROM raw_partner_v WHERE fk_fornecedor IN (SELECT * FROM near_v)) GROUP BY nome_socio")(lambda d: _network(d)[0].select("id", "tipo", "label"))
_query("graph_network_edges", NEAR + "SELECT DISTINCT 'socio_' || k AS source, 'empresa_' || fk_fornecedor AS target, 'socio_de' AS tipo FROM raw_partner_v JOIN (SELECT nome_socio, min(pk_socio) AS k FROM raw_partner_v GROUP BY 1) USING (nome_socio) WHERE fk_fornecedor IN (SELECT * FROM near_v)")(lambda d: _network(d)[1].select("source", "target", "tipo"))
# Design-time analytic queries
_query("spec_alerts_by_type", DIM + "SELECT f.cnpj, f.razao_social, p.nome_socio AS servidor, p.orgao_lotacao, CAST(f.valor_total AS DECIMAL(28,2)) AS total_contratado, a.evidencia FROM alert_v a JOIN dim_v f ON a.fk_fornecedor = f.pk_fornecedor JOIN partner_v p ON p.pk_socio = a.fk_socio WHERE a.tipo_alerta = 'SOCIO_SERVIDOR_PUBLICO'")(
    lambda d: d.alerts.filter("tipo_alerta = 'SOCIO_SERVIDOR_PUBLICO'").join(d.dimension.select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnpj", "razao_social", F.col("valor_total").cast("decimal(28,2)").alias("total_contratado")), "fk_fornecedor").join(d.partners.select(F.col("pk_socio").alias("fk_socio"), F.col("nome_socio").alias("servidor"), "orgao_lotacao"), "fk_socio").select("cnpj", "razao_social", "servidor", "orgao_lotacao", "total_contratado", "evidencia")
)
_query("spec_top20", DIM + f"SELECT {DIM_COLUMNS}, (SELECT count(DISTINCT pk_socio) FROM raw_partner_v r WHERE r.fk_fornecedor = pk_fornecedor) AS qtd_socios FROM dim_v WHERE dim_v.score_risco >= 40 ORDER BY dim_v.score_risco DESC, pk_fornecedor LIMIT 20")(
    lambda d: _dim(d.dimension).filter("score_risco >= 40").join(d.raw_partners.groupBy(F.col("fk_fornecedor").alias("pk_fornecedor")).agg(F.countDistinct("pk_socio").alias("qtd_socios")), "pk_fornecedor", "left").withColumn("qtd_socios", F.coalesce("qtd_socios", F.lit(0))).orderBy(F.col("score_risco").desc(), "pk_fornecedor").limit(20)
)
_query("spec_both_dimensions", DIM + f"SELECT {DIM_COLUMNS} FROM dim_v WHERE dim_v.qtd_alertas > 0 AND dim_v.score_risco >= 40")(lambda d: _dim(d.dimension).filter("qtd_alertas > 0 and score_risco >= 40"))
_query("spec_shared_partner_network", "SELECT DISTINCT y.fk_fornecedor AS pk_fornecedor, y.nome_socio AS socio_compartilhado FROM raw_partner_v x JOIN raw_partner_v y ON x.nome_socio = y.nome_socio WHERE x.fk_fornecedor = 7")(lambda d: d.raw_partners.join(d.raw_partners.filter("fk_fornecedor = 7").select("nome_socio").distinct(), "nome_socio", "left_semi").select(F.col("fk_fornecedor").alias("pk_fornecedor"), F.col("nome_socio").alias("socio_compartilhado")).distinct())
_query("spec_donor_contractors", "SELECT fk_fornecedor, g AS total_doado, c AS total_contratado FROM (SELECT fk_fornecedor, sum(valor) AS g FROM donation_v GROUP BY 1) JOIN (SELECT fk_fornecedor, sum(valor) AS c FROM contract_v GROUP BY 1) USING (fk_fornecedor) WHERE g > 0 AND c > 0")(lambda d: d.donations.groupBy("fk_fornecedor").agg(F.sum("valor").alias("total_doado")).join(d.contracts.groupBy("fk_fornecedor").agg(F.sum("valor").alias("total_contratado")), "fk_fornecedor").filter("total_doado > 0 and total_contratado > 0"))
_query("spec_bid_rotation", EXTRA_A + "SELECT x.num_licitacao, p.a AS empresa_a, p.b AS empresa_b FROM pair_v p JOIN bid_v x ON x.fk_fornecedor = p.a JOIN bid_v y ON y.fk_fornecedor = p.b AND y.num_licitacao = x.num_licitacao")(
    lambda d: alerts.shared_bids(d.suppliers, d.raw_partners, d.contracts).select("num_licitacao", F.col("a").alias("empresa_a"), F.col("b").alias("empresa_b"))
)
# Scalars
_query("classify_contract_object", "SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in __import__("sentinela.constants", fromlist=["x"]).OBJECT_WORDS.items()) + " END AS categoria FROM documents", views=False)(lambda d: d.table("documents").select("doc_id", fn.object_category(F.col("text")).alias("categoria")))


def _check_sql(digits: str, n: int, start: int) -> str:
    w, terms = start, []
    for i in range(n):
        terms.append(f"CAST(substr({digits}, {i + 1}, 1) AS INTEGER) * {w}")
        w = w - 1 if w > 2 else 9
    s = f"({' + '.join(terms)}) % 11"
    return f"(CASE WHEN {s} < 2 THEN 0 ELSE 11 - {s} END)"


_D14 = "lpad(CAST(o_orderkey * 7919 AS VARCHAR), 14, '0')"
_D11 = "lpad(CAST(o_orderkey * 7919 AS VARCHAR), 11, '0')"
_query("cnpj_check_digits", f"SELECT o_orderkey, {_check_sql(_D14, 12, 5)} = CAST(substr({_D14}, 13, 1) AS INTEGER) AND {_check_sql(_D14, 13, 6)} = CAST(substr({_D14}, 14, 1) AS INTEGER) AND replace({_D14}, substr({_D14}, 1, 1), '') <> '' AS ok FROM orders", views=False)(lambda d: d.table("orders").select("o_orderkey", fn.cnpj_valid(F.lpad((F.col("o_orderkey") * 7919).cast("string"), 14, "0")).alias("ok")))
_query("cpf_check_digits", f"SELECT o_orderkey, {_check_sql(_D11, 9, 10)} = CAST(substr({_D11}, 10, 1) AS INTEGER) AND {_check_sql(_D11, 10, 11)} = CAST(substr({_D11}, 11, 1) AS INTEGER) AND replace({_D11}, substr({_D11}, 1, 1), '') <> '' AS ok FROM orders", views=False)(lambda d: d.table("orders").select("o_orderkey", fn.cpf_valid(F.lpad((F.col("o_orderkey") * 7919).cast("string"), 11, "0")).alias("ok")))
_query("cpf_mask", f"SELECT o_orderkey, '***.' || substr({_D11}, 4, 3) || '.' || substr({_D11}, 7, 3) || '-**' AS mascara FROM orders", views=False)(lambda d: d.table("orders").select("o_orderkey", fn.cpf_mask(F.lpad((F.col("o_orderkey") * 7919).cast("string"), 11, "0")).alias("mascara")))
_DAY = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN '31/02/' || CAST(year(o_orderdate) AS VARCHAR) WHEN 2 THEN ' ' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END"
_query("lenient_dates", f"SELECT o_orderkey, {_DAY} AS texto, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS dia FROM orders", views=False)(
    lambda d: d.table("orders").select("o_orderkey", F.expr("case pmod(o_orderkey, 4) when 0 then date_format(o_orderdate, 'dd/MM/yyyy') when 1 then concat('31/02/', year(o_orderdate)) when 2 then ' ' else cast(cast(o_orderdate as date) as string) end").alias("texto")).withColumn("dia", fn.day(F.col("texto"), "dd/MM/yyyy"))
)
