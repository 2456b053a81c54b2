"""Queries over what is stored for serving: partial totals, trigram postings, sorted pages, merged buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sentinela import durable, merge, pages, partials, postings
from sentinela.plans import export, serving
from sentinela.plans.driver_map import VIEWS, Domain
from sentinela.queries import ALERT_SQL, DIM, EXTRA_A
from sentinela.star_queries import _and_remove

QUERIES: dict = {}
ORACLE: dict = {}


def _query(name: str, sql: str):
    def add(f):
        def run(spark, sf_dir):
            where = f"{durable.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            d = Domain(spark, sf_dir)
            return _and_remove(f(d, where), d, where)

        QUERIES[name], ORACLE[name] = run, f"WITH {VIEWS}{sql}"
        return f

    return add


def _agencies(when: str) -> str:
    return f"SELECT codigo, nome, count(pk_contrato) AS qtd_contratos, CAST(coalesce(sum(valor), 0) AS DECIMAL(28,2)) AS total_contratado, count(DISTINCT fk_fornecedor) AS qtd_fornecedores FROM agency_v LEFT JOIN (SELECT * FROM contract_v WHERE {when}) ON fk_orgao = pk_orgao GROUP BY 1, 2"


def _two_lots(d, where):
    """Two runs, one of which is repeated; their months overlap."""
    old = F.col("pk_contrato") % 3 == 0
    partials.add(d.contracts.filter(old), where, "a")
    partials.add(d.contracts.filter(~old), where, "b")
    partials.add(d.contracts.filter(old), where, "a")


@_query("store_agency_totals", _agencies("true"))
def agency_totals(d, where):
    _two_lots(d, where)
    return partials.summary(partials.totals(d.spark, where), d.agencies)


@_query("store_agency_range", _agencies("data_assinatura BETWEEN DATE '1994-06-01' AND DATE '1996-05-31'"))
def agency_range(d, where):
    _two_lots(d, where)
    return partials.summary(partials.totals(d.spark, where, "1994-06", "1996-05"), d.agencies)


#: Searched: digits of both fields, a part of names in another case, wildcards taken literally, too short for a trigram.
TEXTS = ["0001", "#00000002", "sUPPLIER#0", "0%1", "_", "7"]


@_query("store_search", " " + " UNION ALL ".join(f"SELECT '{t}' AS texto, pk_fornecedor, cnpj, razao_social FROM supplier_v WHERE contains(cnpj, '{t}') OR contains(lower(razao_social), lower('{t}'))" for t in TEXTS))
def search(d, where):
    postings.build(d.suppliers, "pk_fornecedor", ["cnpj", "razao_social"], where)
    out = None
    for t in TEXTS:
        one = postings.search(d.suppliers, "pk_fornecedor", {"cnpj": False, "razao_social": True}, where, t).select(F.lit(t).alias("texto"), "pk_fornecedor", "cnpj", "razao_social")
        out = one if out is None else out.unionByName(one)
    return out


_FEED = "tipo_alerta, severidade, descricao, evidencia, cnpj, razao_social, nome_socio AS socio_nome"


@_query("store_alert_page", f"{EXTRA_A.rstrip()}, alert_v AS (" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in ALERT_SQL.values()) + f") SELECT {_FEED} FROM alert_v a JOIN (SELECT pk_fornecedor AS fk_fornecedor, cnpj, razao_social FROM supplier_v) USING (fk_fornecedor) LEFT JOIN (SELECT pk_socio AS fk_socio, nome_socio FROM raw_partner_v) USING (fk_socio) ORDER BY tipo_alerta, cnpj, evidencia, descricao LIMIT 20 OFFSET 20")
def alert_page(d, where):
    feed = serving.alert_feed(d.alerts, d.suppliers, d.raw_partners, limit=None)
    pages.write(feed, where, [(c, False) for c in ("tipo_alerta", "cnpj", "evidencia", "descricao")], rows=50_000)
    return pages.page(d.spark, where, 1, 20)


@_query("store_contracts_after", " SELECT pk_contrato, fk_fornecedor, valor, data_assinatura FROM contract_v ORDER BY data_assinatura DESC, pk_contrato, fk_fornecedor, valor LIMIT 100 OFFSET 700")
def contracts_after(d, where):
    """The newest contracts, a page of 100 behind the last row of page 6; some keys of contracts occur twice."""
    order = [("data_assinatura", True), ("pk_contrato", False), ("fk_fornecedor", False), ("valor", False)]
    names = [c for c, _ in order]
    pages.write(d.contracts.select(*names), where, order, rows=500_000)
    seen = pages.page(d.spark, where, 6, 100).collect()[-1]
    return pages.after(d.spark, where, order, tuple(seen[c] for c in names), 100).select("pk_contrato", "fk_fornecedor", "valor", "data_assinatura")


#: Three deliveries of contracts: which of them, how much their value is off, and whether they replace what is stored.
_RUNS = [("pk_contrato % 2 = 0", 0, False), ("pk_contrato % 3 = 0", 1, False), ("pk_contrato % 50 = 7", 2, True)]


@_query(
    "store_merged_contracts",
    ", run_v AS (" + " UNION ALL ".join(f"SELECT {p} AS rang, pk_contrato, fk_fornecedor, data_assinatura, CAST(valor + {off} AS DECIMAL(18,2)) AS valor FROM contract_v WHERE {when}" for (when, off, _), p in zip(_RUNS, (1, 2, 0), strict=True)) + ") "
    "SELECT pk_contrato, fk_fornecedor, data_assinatura, valor FROM run_v QUALIFY row_number() OVER (PARTITION BY pk_contrato ORDER BY rang, fk_fornecedor, data_assinatura, valor) = 1",
)
def merged_contracts(d, where):
    """The second delivery adds to the first, the third replaces."""
    rows = d.contracts.select("pk_contrato", "fk_fornecedor", "data_assinatura", "valor")
    for when, off, newest in _RUNS:
        own = rows.filter(when).withColumn("valor", (F.col("valor") + off).cast("decimal(18,2)"))
        merge.merge(own, where, ["pk_contrato"], ["fk_fornecedor", "data_assinatura", "valor"], newest, buckets=16)
    return merge.read(d.spark, where)


def _lines_sql() -> str:
    rows = [f"SELECT cnpj, 0 AS ordem, 'DADOS CADASTRAIS' AS secao, '{label},' || coalesce(CAST({c} AS VARCHAR), '') AS linha, {i} AS chave FROM supplier_v" for i, (label, c) in enumerate((("CNPJ", "cnpj"), ("Razao Social", "razao_social"), ("Data Abertura", "data_abertura"), ("Capital Social", "capital_social"), ("CNAE", "cnae_principal")))]
    sections = ("SCORE DE RISCO", "score_v", ["indicador", "peso", "descricao"], "NULL"), ("ALERTAS CRITICOS", "alert_v", ["tipo_alerta", "severidade", "descricao"], "NULL"), ("CONTRATOS", "contract_v", ["valor", "data_assinatura", "objeto"], "pk_contrato"), ("SOCIOS", "partner_v", ["nome_socio", "is_servidor_publico", "orgao_lotacao"], "pk_socio")
    for i, (section, view, fields, key) in enumerate(sections, start=1):
        line = " || ',' || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields)
        rows.append(f"SELECT s.cnpj, {i}, '{section}', {line}, {key} FROM {view} JOIN (SELECT pk_fornecedor AS k, cnpj FROM supplier_v) s ON k = fk_fornecedor")
    return DIM + " UNION ALL ".join(rows)


@_query("store_dossier_lines", _lines_sql())
def dossier_lines(d, where):
    """The dossiers of all suppliers, written in order and read again."""
    export.write(export.lines(d), where, 8)
    return export.read(d.spark, where)
