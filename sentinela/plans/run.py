"""The batch run over validated staging tables: one lazy plan per published table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.operators import alerts, core, dimensions, graph, score


def build(tables: dict[str, DataFrame], ref_date, key: str, variant: str = "batch", previous: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """From empresas, qsa, contratos, sancoes, servidores, doacoes (and rais, qsa_diffs, comprasnet if there) to the
    published tables. ``key``: the secret of the keyed hashes; ``previous``: the tables published before, whose keys of
    agencies, modalities and candidates stay."""
    suppliers, partners, contracts = tables["empresas"], tables["qsa"], tables["contratos"]
    if "rais" in tables:
        suppliers = core.merge_headcount(suppliers, tables["rais"])
    elif "qtd_funcionarios" not in suppliers.columns:
        suppliers = suppliers.withColumn("qtd_funcionarios", F.lit(None).cast("long"))
    if "qsa_diffs" in tables:
        partners = core.merge_first([partners, tables["qsa_diffs"]], ["cnpj_basico", "nome_socio", "data_entrada"], ["_ord"])
    if "comprasnet" in tables:
        contracts = core.merge_first([contracts, tables["comprasnet"]], ["cnpj_fornecedor", "num_licitacao", "data_assinatura"], ["_ord"])
        contracts = core.number_rows(contracts.drop("pk_contrato"), "pk_contrato", ["cnpj_fornecedor", "num_licitacao", "data_assinatura"])
    for name, kind in (("objeto_categoria", "string"), ("fk_orgao", "long")):
        if name not in contracts.columns:
            contracts = contracts.withColumn(name, F.lit(None).cast(kind))
    contracts = core.resolve_contracts(contracts, suppliers)
    sanctions = core.resolve_sanctions(tables["sancoes"], suppliers)
    donations = core.resolve_donations(tables["doacoes"], suppliers)
    if "cnpj_basico" not in sanctions.columns:  # the root of a company's number; a person's has none
        d = F.regexp_replace("cnpj", "[^0-9]", "")
        sanctions = sanctions.withColumn("cnpj_basico", F.when(F.length(d) == 14, F.substring(d, 1, 8)))
    partners = core.match_servants(partners, tables["servidores"])
    partners = core.hash_column(partners, "cpf_parcial", key, "cpf_hmac")
    partners = core.number_rows(core.enrich_partners(partners, suppliers, sanctions, ref_date), "pk_socio", ["cnpj_basico", "nome_socio"])
    per = core.per_supplier(contracts).persist()  # a row per supplier, read by all rules
    scores = score.all_indicators(suppliers, partners, contracts, sanctions, ref_date, variant, per)
    found = alerts.all_alerts(suppliers, partners, contracts, sanctions, donations, ref_date, per)
    edges = graph.edges(suppliers, partners)
    top, top_edges = graph.top(edges, graph.nodes(suppliers, partners, edges))
    star = dimensions.star(suppliers, partners, contracts, donations, key, previous)
    scores = core.number_rows(scores, "pk_score_detalhe", ["fk_fornecedor", "indicador", "evidencia"])
    found = core.number_rows(found, "pk_alerta", ["fk_fornecedor", "tipo_alerta", "evidencia", "descricao"])
    return {**star, "dim_fornecedor": core.denormalise(suppliers, scores, found, per), "dim_socio": partners, "dim_sancao": sanctions, "fato_score_detalhe": scores, "fato_alerta_critico": found.withColumn("detectado_em", F.lit(ref_date).cast("timestamp_ntz")), "grafo_nos": top, "grafo_arestas": top_edges}
