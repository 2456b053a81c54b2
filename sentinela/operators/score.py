"""The nine score indicators: one row per flagged supplier with weight, text and evidence. Knows nothing of alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela import functions as fn
from sentinela.operators import core


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _fact(df: DataFrame, name: str, description, evidence) -> DataFrame:
    return df.select(F.col("fk_fornecedor"), F.lit(name).alias("indicador"), F.lit(K.WEIGHTS[name]).alias("peso"), description.alias("descricao"), evidence.alias("evidencia"))


def _known(df: DataFrame, suppliers: DataFrame) -> DataFrame:
    return df.join(suppliers.select(F.col("pk_fornecedor").alias("fk_fornecedor")), "fk_fornecedor", "left_semi")


def low_capital(suppliers, contracts, variant: str = "batch"):
    total = core.per_supplier(contracts).select("fk_fornecedor", "total")
    own = suppliers.filter(F.col("capital_social") < K.LOW_CAPITAL).select(F.col("pk_fornecedor").alias("fk_fornecedor"), F.col("capital_social").alias("capital"))
    enough = F.col("total") >= K.CONTRACTS_FOR_LOW_CAPITAL if variant == "online" else F.col("total") > K.CONTRACTS_FOR_LOW_CAPITAL
    hit = own.join(total.filter(enough), "fk_fornecedor")
    return _fact(hit, "CAPITAL_SOCIAL_BAIXO", _text("Capital social R$", F.col("capital"), " desproporcional a contratos R$", F.col("total")), _text("capital=", F.col("capital"), ", valor_total_contratos=", F.col("total")))


def recent_company(suppliers, contracts):
    first = core.per_supplier(contracts).filter("first is not null").select("fk_fornecedor", "first")
    hit = suppliers.filter("data_abertura is not null").select(F.col("pk_fornecedor").alias("fk_fornecedor"), F.col("data_abertura").alias("opened")).join(first, "fk_fornecedor")
    hit = hit.withColumn("days", F.datediff("first", "opened")).filter(F.col("days") < K.RECENT_DAYS)
    o, f, d = F.col("opened"), F.col("first"), F.col("days")
    return _fact(hit, "EMPRESA_RECENTE", _text("Empresa aberta em ", o, " obteve primeiro contrato em ", f, " (", d, " dias depois)"), _text("data_abertura=", o, ", primeiro_contrato=", f, ", dias=", d))


def past_sanction(suppliers, sanctions, ref_date, variant: str = "batch"):
    """Online a sanction still holds on its last day."""
    over = sanctions.filter(~core.active(F.col("data_fim"), ref_date, variant == "online")).groupBy("fk_fornecedor").agg(F.count("*").alias("n"))
    return _fact(_known(over, suppliers), "SANCAO_HISTORICA", _text(F.col("n"), " sancao(oes) historica(s) expirada(s)"), _text("sancoes_expiradas=", F.col("n")))


def multi_company_partner(suppliers, partners):
    busy = partners.filter(F.col("qtd_empresas_governo") >= K.MANY_COMPANIES).select(fn.zfill(F.col("cnpj_basico"), 8).alias("root"), "nome_socio", "qtd_empresas_governo")
    own = suppliers.select(fn.zfill(F.col("cnpj_basico"), 8).alias("root"), F.col("pk_fornecedor").alias("fk_fornecedor"))
    hit = busy.join(own, "root").groupBy("fk_fornecedor").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("nome_socio", "qtd_empresas_governo"))).alias("who"))
    pairs = F.concat_ws(", ", F.transform("who", lambda x: F.concat(F.lit("('"), x["nome_socio"], F.lit("', "), x["qtd_empresas_governo"].cast("string"), F.lit(")"))))
    return _fact(hit, "SOCIO_EM_MULTIPLAS_FORNECEDORAS", _text(F.col("n"), " socio(s) presente(s) em 3+ empresas fornecedoras do governo"), _text("socios=[", pairs, "]"))


def exclusive_buyer(suppliers, contracts):
    """All contracts with one known buyer; unknown buyers do not count as one."""
    hit = _known(core.per_supplier(contracts).filter("buyer_least = buyer_most and n_known_buyers = n_contratos"), suppliers)
    n = F.col("n_contratos")
    return _fact(hit, "FORNECEDOR_EXCLUSIVO", _text("Todos os ", n, " contrato(s) sao com o mesmo orgao"), _text("orgao_codigo=", F.col("buyer_least"), ", qtd_contratos=", n))


def _incompatible(spark):
    """cnae_principal, kind, objeto_categoria: what should not be contracted with an activity; a fixed table."""
    rows = [(code, kind, bad) for kind, codes in K.ACTIVITY_CODES.items() for code in codes for bad in K.INCOMPATIBLE[kind]]
    return F.broadcast(spark.createDataFrame(rows, "cnae_principal string, kind string, objeto_categoria string"))


def incompatible_activity(suppliers, contracts):
    lookup = _incompatible(suppliers.sparkSession)
    own = suppliers.filter("cnae_principal is not null").select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnae_principal")
    pairs = contracts.filter("objeto_categoria is not null").select("fk_fornecedor", "objeto_categoria").distinct()
    hit = pairs.join(own, "fk_fornecedor").join(lookup, ["cnae_principal", "objeto_categoria"])
    hit = hit.groupBy("fk_fornecedor", "cnae_principal", "kind").agg(F.min("objeto_categoria").alias("bad"))
    c, k, b = F.col("cnae_principal"), F.col("kind"), F.col("bad")
    return _fact(hit, "CNAE_INCOMPATIVEL", _text("CNAE ", c, " (", k, ") incompativel com objeto contratado (", b, ")"), _text("cnae=", c, ", categoria_cnae=", k, ", objeto_categoria=", b))


def incompatible_activity_online(suppliers, contracts):
    """Online the category is inferred from the contract's object, and the first incompatible contract (by day, then
    key) is named; activity codes match with or without punctuation. ``contracts`` may be ``core.yearly(contracts, online=True)``."""
    plain = lambda c: F.regexp_replace(c, "[^0-9]", "")
    lookup = F.broadcast(_incompatible(suppliers.sparkSession).withColumn("_code", plain(F.col("cnae_principal"))).drop("cnae_principal"))
    own = suppliers.filter("cnae_principal is not null").select(F.col("pk_fornecedor").alias("fk_fornecedor"), "cnae_principal", plain(F.col("cnae_principal")).alias("_code"))
    at = F.col("at")
    if "at" not in contracts.columns:
        contracts, at = contracts.withColumn("objeto_categoria", fn.object_category(F.col("objeto"))), F.struct(F.col("data_assinatura").isNull(), "data_assinatura", "pk_contrato")
    first = contracts.filter("objeto_categoria is not null").groupBy("fk_fornecedor", "objeto_categoria").agg(F.min(at).alias("_at"))
    hit = first.join(own, "fk_fornecedor").join(lookup, ["_code", "objeto_categoria"])
    hit = hit.groupBy("fk_fornecedor", "cnae_principal", "kind").agg(F.min_by("objeto_categoria", "_at").alias("bad"))
    c, k, b = F.col("cnae_principal"), F.col("kind"), F.col("bad")
    return _fact(hit, "CNAE_INCOMPATIVEL", _text("CNAE ", c, " (", k, ") incompativel com objeto contratado (", b, ")"), _text("cnae=", c, ", categoria_cnae=", k, ", objeto_categoria=", b))


def neighbours(suppliers):
    """Online: at least two other suppliers with the same text as address."""
    several = suppliers.filter("logradouro is not null").groupBy("logradouro").agg((F.count("*") - 1).alias("n")).filter(F.col("n") >= K.NEIGHBOURS_ONLINE)
    hit = suppliers.select(F.col("pk_fornecedor").alias("fk_fornecedor"), "logradouro").join(several, "logradouro")
    return _fact(hit, "MESMO_ENDERECO", _text("Compartilha endereco com ", F.col("n"), " outro(s) fornecedor(es) do governo"), _text("qtd_mesmo_endereco=", F.col("n")))


def shared_address(suppliers):
    """One row per supplier that shares its address, naming the least other one. No pairs are made: the least and
    the second least of an address are enough."""
    keyed = suppliers.select("cnpj", F.col("pk_fornecedor").alias("fk_fornecedor"), fn.address_key(F.col("logradouro")).alias("address")).filter("address is not null")
    least = keyed.groupBy("address").agg(F.min("cnpj").alias("one"), F.max("cnpj").alias("_last"))
    two = keyed.join(least.filter("one <> _last"), "address")
    second = two.filter("cnpj <> one").groupBy("address").agg(F.min("cnpj").alias("two"))
    hit = two.join(second, "address").withColumn("other", F.when(F.col("cnpj") == F.col("one"), F.col("two")).otherwise(F.col("one")))
    return _fact(hit, "MESMO_ENDERECO", _text("Compartilha endereco com ", F.col("other")), _text("endereco=", F.col("address"), ", cnpj_parceiro=", F.col("other")))


def sudden_growth(suppliers, contracts, variant: str = "batch"):
    """A year with at least five times the value of the year before: the latest such jump, or online the earliest
    and only from a floor on."""
    if "n_known_buyers" in contracts.columns:  # core.yearly
        yearly = contracts.filter("year is not null").groupBy("fk_fornecedor", "year").agg(F.sum("total").cast(contracts.schema["total"].dataType).alias("value"))
    else:
        yearly = contracts.filter("data_assinatura is not null").groupBy("fk_fornecedor", F.year("data_assinatura").alias("year")).agg(F.sum("valor").alias("value"))
    line = Window.partitionBy("fk_fornecedor").orderBy("year")
    jump = yearly.withColumns({"py": F.lag("year").over(line), "pv": F.lag("value").over(line)})
    jump = jump.filter((F.col("py") == F.col("year") - 1) & (F.col("pv") > 0) & (F.col("value") >= F.col("pv") * K.GROWTH))
    if variant == "online":
        jump = jump.filter(F.col("value") >= K.GROWTH_LEAST_ONLINE)
    pick = F.min_by if variant == "online" else F.max_by
    hit = _known(jump.groupBy("fk_fornecedor").agg(pick(F.struct("year", "value", "pv"), "year").alias("j")), suppliers)
    year, value, before = F.col("j.year"), F.col("j.value"), F.col("j.pv")
    ratio = F.round(value.cast("double") / before.cast("double"), 1).cast("decimal(18,1)")
    return _fact(
        hit,
        "CRESCIMENTO_SUBITO",
        _text("Valor contratado saltou ", ratio, "x entre ", year - 1, " e ", year),
        _text("ano_anterior=", year - 1, ", valor_anterior=", before, ", ano_atual=", year, ", valor_atual=", value, ", razao=", ratio, "x"),
    )


def no_employees(suppliers, contracts):
    none = suppliers.filter("qtd_funcionarios = 0").select(F.col("pk_fornecedor").alias("fk_fornecedor"))
    hit = none.join(core.per_supplier(contracts).select("fk_fornecedor"), "fk_fornecedor", "left_semi")
    return _fact(hit, "SEM_FUNCIONARIOS", F.lit("Empresa declara zero funcionarios no RAIS mas possui contratos governamentais"), F.lit("qtd_funcionarios=0, contratos_governamentais=sim"))


def all_indicators(suppliers, partners, contracts, sanctions, ref_date, variant: str = "batch", per=None, yearly=None) -> DataFrame:
    """All rules of one variant. ``per`` and ``yearly``: ``core.per_supplier(contracts)`` and ``core.yearly(contracts)``, for
    the online variant with ``online=True``, if they have been written already; ``contracts`` are not looked at then."""
    per = core.per_supplier(contracts) if per is None else per
    by_year = contracts if yearly is None else yearly
    online = variant == "online"
    parts = [
        low_capital(suppliers, per, variant),
        recent_company(suppliers, per),
        past_sanction(suppliers, sanctions, ref_date, variant),
        multi_company_partner(suppliers, partners),
        exclusive_buyer(suppliers, per),
        incompatible_activity_online(suppliers, by_year if "at" in by_year.columns else contracts) if online else incompatible_activity(suppliers, by_year),
        neighbours(suppliers) if online else shared_address(suppliers),
        sudden_growth(suppliers, by_year, variant),
        no_employees(suppliers, per),
    ]
    return reduce(DataFrame.unionByName, parts)


def total(scores: DataFrame) -> DataFrame:
    """fk_fornecedor, score (at most 100), faixa by the online bands."""
    s = scores.groupBy("fk_fornecedor").agg(F.least(F.lit(100), F.sum("peso")).alias("score"))
    return s.withColumn("faixa", fn.band(F.col("score"), K.BANDS_ONLINE))
