"""The six alert detectors. Knows nothing of the score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela import functions as fn
from sentinela.operators import core, overlap


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _fact(df: DataFrame, name: str, description, evidence, partner=None) -> DataFrame:
    partner = F.lit(None).cast("long") if partner is None else partner.cast("long")
    return df.select("fk_fornecedor", partner.alias("fk_socio"), F.lit(name).alias("tipo_alerta"), F.lit(K.SEVERITY[name]).alias("severidade"), description.alias("descricao"), evidence.alias("evidencia"))


def _known(df, suppliers):
    return df.join(suppliers.select(F.col("pk_fornecedor").alias("fk_fornecedor")), "fk_fornecedor", "left_semi")


def _of_companies(partners, suppliers):
    own = suppliers.select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root"), F.col("pk_fornecedor").alias("fk_fornecedor"))
    return partners.drop("fk_fornecedor").withColumn("_root", fn.zfill(F.col("cnpj_basico"), 8)).join(own, "_root")


def _hash_prefix(df):
    if "cpf_hmac" not in df.columns:
        return F.lit("")
    return F.when(F.col("cpf_hmac").isNotNull(), _text("socio_cpf_hmac=", F.col("cpf_hmac"), ", ")).otherwise("")


def _partner_key(df):
    return F.col("pk_socio") if "pk_socio" in df.columns else None


def servant_partner(suppliers, partners):
    hit = _of_companies(partners.filter("is_servidor_publico"), suppliers)
    place = lambda a, b: F.when(F.col("orgao_lotacao").isNotNull(), _text(a, F.col("orgao_lotacao"), b)).otherwise("")
    return _fact(hit, "SOCIO_SERVIDOR_PUBLICO", F.concat(_text("Socio ", F.col("nome_socio"), " e servidor publico"), place(" (", ")")), F.concat(_hash_prefix(hit), _text("nome=", F.col("nome_socio")), place(", orgao=", "")), _partner_key(hit))


def sanctioned_contracting(suppliers, contracts, sanctions, ref_date, inclusive: bool = False):
    live = sanctions.filter(core.active(F.col("data_fim"), ref_date, inclusive)).groupBy("fk_fornecedor").agg(F.count("*").alias("s"))
    busy = core.per_supplier(contracts).select("fk_fornecedor", F.col("n_contratos").alias("c"))
    hit = _known(live.join(busy, "fk_fornecedor"), suppliers)
    return _fact(hit, "EMPRESA_SANCIONADA_CONTRATANDO", _text("Empresa com ", F.col("s"), " sancao(oes) vigente(s) e ", F.col("c"), " contrato(s) ativo(s)"), _text("sancoes_vigentes=", F.col("s"), ", qtd_contratos=", F.col("c")))


def through_partners(donations, bridge):
    """pk_doacao, fk_fornecedor, valor: the donations of suppliers and of their partners (fk_socio), each once a supplier.
    ``bridge``: fk_fornecedor, fk_socio."""
    own = donations.filter("fk_fornecedor is not null").select("pk_doacao", "fk_fornecedor", "valor")
    by_partner = donations.filter("fk_socio is not null").select("pk_doacao", "fk_socio", "valor").join(bridge.select("fk_fornecedor", "fk_socio").distinct(), "fk_socio")
    return own.unionByName(by_partner.select(*own.columns)).dropDuplicates(["pk_doacao", "fk_fornecedor"])


def donor_contractor(suppliers, contracts, donations, bridge=None):
    """With ``bridge`` (online) donations of a supplier's partners count as its own."""
    donations = donations if bridge is None else through_partners(donations, bridge)
    gave = donations.filter(F.col("valor") > K.MATERIAL_DONATION).groupBy("fk_fornecedor").agg(F.count("*").alias("d"))
    total = core.per_supplier(contracts).select("fk_fornecedor", F.col("total").alias("t")).filter(F.col("t") > K.CONTRACTS_FOR_DONATION)
    hit = _known(gave.join(total, "fk_fornecedor"), suppliers)
    return _fact(hit, "DOACAO_PARA_CONTRATANTE", _text(F.col("d"), " doacao(oes) material(is) com contratos totalizando R$", fn.money(F.col("t"))), _text("doacoes_materiais=", F.col("d"), ", valor_total_contratos=", F.col("t")))


def sanctioned_partner(suppliers, partners):
    hit = _of_companies(partners.filter("is_sancionado"), suppliers)
    name = F.col("nome_socio")
    what, more = F.lit(" e socio de outra empresa sancionada"), F.lit("")
    if {"sancionado_cnpj_basico", "sancionado_razao_social"} <= set(partners.columns):
        company = F.col("sancionado_razao_social")
        what = F.when(company.isNotNull(), F.concat(F.lit(" e socio de empresa sancionada "), company)).otherwise(what)
        more = F.when(F.col("sancionado_cnpj_basico").isNotNull(), _text(", empresa_sancionada_cnpj=", F.col("sancionado_cnpj_basico"), ", empresa_sancionada_razao=", F.coalesce(company, F.lit("N/A")))).otherwise("")
    return _fact(hit, "SOCIO_SANCIONADO_EM_OUTRA", F.concat(F.lit("Socio "), name, what), F.concat(_hash_prefix(hit), _text("nome=", name), more), _partner_key(hit))


def shared_bids(suppliers, partners, contracts):
    """num_licitacao, a, b: pairs of companies with a partner's name in common that met in a bid. Joined on bid and name,
    so neither a large bid nor a frequent name makes pairs of companies that have the other not in common."""
    bids = contracts.filter("num_licitacao is not null").select("fk_fornecedor", "num_licitacao").distinct()
    who = _of_companies(partners, suppliers).select("fk_fornecedor", "nome_socio").filter("nome_socio is not null").distinct()
    met = bids.join(who, "fk_fornecedor")
    a, b = met.withColumnRenamed("fk_fornecedor", "a"), met.withColumnRenamed("fk_fornecedor", "b")
    return a.join(b, ["num_licitacao", "nome_socio"]).filter("a < b").select("num_licitacao", "a", "b").distinct()


def bid_rotation(suppliers, partners, contracts):
    """Companies that share a partner's name and at least three bids with another: ``overlap.most_shared``, names as groups."""
    bids = contracts.select(F.col("fk_fornecedor").alias("member"), F.col("num_licitacao").alias("item"))
    who = _of_companies(partners, suppliers).select(F.col("nome_socio").alias("group"), F.col("fk_fornecedor").alias("member"))
    each = overlap.most_shared(bids, who, K.SHARED_BIDS).withColumnRenamed("member", "fk_fornecedor")
    return _fact(each, "RODIZIO_LICITACAO", F.lit("Empresa participa de licitacoes com outra empresa que compartilha socios"), _text("max_licitacoes_comuns_com_par=", F.col("n")))


def front_company(suppliers, partners, contracts):
    per = core.per_supplier(contracts).filter("buyer_least = buyer_most and n_known_buyers = n_contratos").select("fk_fornecedor", "first")
    poor = suppliers.filter(F.col("capital_social") < K.LOW_CAPITAL).withColumnRenamed("pk_fornecedor", "fk_fornecedor")
    hit = poor.join(per, "fk_fornecedor").filter(F.datediff("first", "data_abertura") < K.FRONT_DAYS)
    odd = partners.filter(F.col("is_servidor_publico") | (F.col("qtd_empresas_governo") >= K.MANY_COMPANIES)).select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root"))
    hit = hit.withColumn("_root", fn.zfill(F.col("cnpj_basico"), 8)).join(odd, "_root", "left_semi")
    text = "Empresa apresenta perfil composto de empresa de fachada: capital baixo, entrada rapida em licitacoes, fornecedor exclusivo e socio suspeito"
    return _fact(hit, "EMPRESA_DE_FACHADA", F.lit(text), _text("capital_social=", F.col("capital_social"), ", data_abertura=", F.col("data_abertura"), ", primeiro_contrato=", F.col("first")))


def all_alerts(suppliers, partners, contracts, sanctions, donations, ref_date, per=None) -> DataFrame:
    """``per``: ``core.per_supplier(contracts)``, if it has been written already."""
    per = core.per_supplier(contracts) if per is None else per
    parts = [
        servant_partner(suppliers, partners),
        sanctioned_contracting(suppliers, per, sanctions, ref_date),
        donor_contractor(suppliers, per, donations),
        sanctioned_partner(suppliers, partners),
        bid_rotation(suppliers, partners, contracts),
        front_company(suppliers, partners, per),
    ]
    return reduce(DataFrame.unionByName, parts)
