"""Keys, deduplication, merges, identity, enrichment and the supplier dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela import durable
from sentinela import functions as fn


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order`` (column names, nulls first), summed up before the shuffle; null keys are
    equal to each other."""
    one = F.min_by(F.struct(*(f"`{c}`" for c in df.columns)), F.struct(*order)).alias("_r")
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(one).select("_r.*")


def keep_most(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row with the largest value of each key, summed up before the shuffle."""
    rest = [c for c in df.columns if c not in (key, value)]
    one = F.max_by(F.struct(value, *rest), F.struct(value, *rest)).alias("_r")
    return df.groupBy(key).agg(one).select(key, "_r.*").select(*df.columns)


def number_rows(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """1..n in the order of ``order``: sort by range, count per partition, add the offsets.

    The sorted rows are written first, so that numbers and counts are of the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ranged = durable.materialise(ranged, "numbered")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))  # a row per partition
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return ranged.join(offsets, "_p").withColumn(name, (F.col("_m") - F.col("_first") + F.col("_o") + 1).cast("long")).drop("_p", "_m", "_o", "_first")


def merge_first(frames: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """Union by name (missing columns null); of rows with one key the earliest frame's first stays."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return keep_first(every, keys, ["_source", *order]).drop("_source")


def merge_headcount(suppliers: DataFrame, headcount: DataFrame) -> DataFrame:
    """Add qtd_funcionarios and porte_empresa by padded root; unmatched stays null, several rows give the largest."""
    right = headcount.select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root"), "qtd_funcionarios", "porte_empresa")
    right = keep_most(right, "_root", "qtd_funcionarios")
    left = suppliers.drop("qtd_funcionarios", "porte_empresa").withColumn("_root", fn.zfill(F.col("cnpj_basico"), 8))
    return left.join(right, "_root", "left").drop("_root")


def resolve(facts: DataFrame, suppliers: DataFrame, document: str, when: Column | None = None) -> DataFrame:
    """Set fk_fornecedor by all digits of a document (only where ``when`` holds)."""
    lookup = suppliers.select(fn.digits(F.col("cnpj")).alias("_cnpj"), F.col("pk_fornecedor").alias("fk_fornecedor")).filter(F.length("_cnpj") > 0)
    lookup = lookup.groupBy("_cnpj").agg(F.min("fk_fornecedor").alias("fk_fornecedor"))
    key = fn.digits(F.col(document))
    keyed = facts.drop("fk_fornecedor").withColumn("_cnpj", key if when is None else F.when(when, key))
    return keyed.join(lookup, "_cnpj", "left").drop("_cnpj")


def resolve_contracts(contracts, suppliers):
    return resolve(contracts, suppliers, "cnpj_fornecedor")


def resolve_sanctions(sanctions, suppliers):
    return resolve(sanctions, suppliers, "cnpj", F.length(fn.digits(F.col("cnpj"))) == 14)


def resolve_donations(donations, suppliers):
    return resolve(donations, suppliers, "doc_doador", F.col("tipo_doador") == "CNPJ")


def match_servants(partners: DataFrame, servants: DataFrame) -> DataFrame:
    """Add is_servidor_publico and orgao_lotacao by name and visible digits; one servant per key. A servant whose
    agency is unknown is one too."""
    right = servants.filter(F.col("digitos_visiveis").isNotNull()).groupBy(fn.strip(F.col("nome")).alias("_name"), F.col("digitos_visiveis").alias("_digits"))
    right = right.agg(F.min("orgao_lotacao").alias("orgao_lotacao"), F.lit(True).alias("is_servidor_publico"))
    left = partners.drop("is_servidor_publico", "orgao_lotacao").withColumn("_name", fn.strip(F.col("nome_socio"))).withColumn("_digits", fn.visible_digits(F.col("cpf_parcial")))
    out = left.join(right, ["_name", "_digits"], "left")
    return out.withColumn("is_servidor_publico", F.coalesce("is_servidor_publico", F.lit(False))).drop("_name", "_digits")


def hash_column(df: DataFrame, column: str, key: str, out: str) -> DataFrame:
    """Replace a column of personal numbers by its keyed hash."""
    return df.withColumn(out, fn.hmac_hex(F.col(column), key)).drop(*([] if out == column else [column]))


def active(end: Column, ref_date, inclusive: bool = False) -> Column:
    """Whether a sanction holds on a day: no end, or an end after it (or on it, if inclusive)."""
    day = F.lit(ref_date).cast("date")
    return end.isNull() | (end >= day if inclusive else end > day)


def enrich_partners(partners: DataFrame, suppliers: DataFrame, sanctions: DataFrame, ref_date) -> DataFrame:
    """Add is_sancionado (the row's own company root has an active sanction) with sancionado_cnpj_basico and
    sancionado_razao_social (the least name in the sanctions, if they have any), and qtd_empresas_governo (companies
    among the suppliers that have a partner of this name)."""
    name = F.min("razao_social") if "razao_social" in sanctions.columns else F.lit(None).cast("string")
    bad = sanctions.filter(active(F.col("data_fim"), ref_date)).withColumn("_root", fn.zfill(F.col("cnpj_basico"), 8)).filter("_root is not null")
    bad = bad.groupBy("_root").agg(name.alias("sancionado_razao_social")).withColumn("sancionado_cnpj_basico", F.col("_root"))
    known = suppliers.select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root")).distinct()
    rooted = partners.drop("is_sancionado", "qtd_empresas_governo", "sancionado_cnpj_basico", "sancionado_razao_social").withColumn("_root", fn.zfill(F.col("cnpj_basico"), 8))
    count = rooted.join(known, "_root", "left_semi").groupBy("nome_socio").agg(F.countDistinct("_root").alias("qtd_empresas_governo"))
    out = rooted.join(bad, "_root", "left").join(count, "nome_socio", "left").drop("_root")
    return out.withColumns({"is_sancionado": F.col("sancionado_cnpj_basico").isNotNull(), "qtd_empresas_governo": F.coalesce("qtd_empresas_governo", F.lit(0)).cast("long")})


#: Values that suppliers are dealt by in ``yearly``.
DEALS = 1 << 12


def yearly(contracts: DataFrame, online: bool = False) -> DataFrame:
    """``per_supplier`` by year and objeto_categoria too: the rules on either, and ``per_supplier``, may be given this in
    place of the contracts, which are then joined and grouped once for all of them. ``online``: objeto_categoria is inferred
    from the contract's object, and ``at`` (whether the day is null, the day, the key) is the first contract that has it.

    As they come, nearly every contract of a task is of another group, and a group's sums are longer than the contract: the
    contracts are dealt by supplier first, by a number that is no key of the groups, so that Spark may split a supplier with
    very many over tasks, which send their sums.
    """
    buyer = "codigo_orgao" if "codigo_orgao" in contracts.columns else "fk_orgao"
    kept = [c for c in ("fk_fornecedor", "data_assinatura", "valor", buyer) if c in contracts.columns]
    kind, more = F.col("objeto_categoria"), []
    if online:
        kind = fn.object_category(F.col("objeto"))
        more = [F.when(kind.isNotNull(), F.col("pk_contrato")).alias("pk_contrato")]
    dealt = contracts.select(F.pmod(F.xxhash64("fk_fornecedor"), F.lit(DEALS)).cast("int").alias("_deal"), *kept, kind.alias("objeto_categoria"), *more).hint("rebalance", "_deal")
    at = [F.min(F.when(F.col("objeto_categoria").isNotNull(), F.struct(F.col("data_assinatura").isNull().alias("no_day"), "data_assinatura", "pk_contrato"))).alias("at")] if online else []
    return _facts(dealt, "fk_fornecedor", F.year("data_assinatura").alias("year"), "objeto_categoria", more=at)


def per_supplier(contracts: DataFrame) -> DataFrame:
    """What the rules want to know of a supplier's contracts, a row each, in one aggregation: n_contratos, total, first,
    buyer_least, buyer_most, n_known_buyers (by codigo_orgao, or else fk_orgao), of the contracts or of ``yearly``, and, so
    that this may be given in place of the contracts, itself unchanged."""
    if "n_known_buyers" not in contracts.columns:
        return _facts(contracts, "fk_fornecedor")
    if "year" not in contracts.columns:
        return contracts
    sums = [F.sum("n_contratos").alias("n_contratos"), F.sum("total").cast(contracts.schema["total"].dataType).alias("total"), F.min("first").alias("first")]
    return contracts.groupBy("fk_fornecedor").agg(*sums, F.min("buyer_least").alias("buyer_least"), F.max("buyer_most").alias("buyer_most"), F.sum("n_known_buyers").alias("n_known_buyers"))


def _facts(contracts: DataFrame, *by, more=()) -> DataFrame:
    buyer = "codigo_orgao" if "codigo_orgao" in contracts.columns else "fk_orgao"
    total = F.sum("valor") if "valor" in contracts.columns else F.lit(None).cast("decimal(28,2)")
    known = [F.lit(None).alias("buyer_least"), F.lit(None).alias("buyer_most"), F.lit(0).cast("long").alias("n_known_buyers")] if buyer not in contracts.columns else [F.min(buyer).alias("buyer_least"), F.max(buyer).alias("buyer_most"), F.count(buyer).alias("n_known_buyers")]
    first = F.min("data_assinatura") if "data_assinatura" in contracts.columns else F.lit(None).cast("date")
    return contracts.groupBy(*by).agg(F.count("*").alias("n_contratos"), total.alias("total"), first.alias("first"), *known, *more)


#: Suppliers of one address in a block, and pairs of blocks for a task of ``same_address``.
BLOCK, UNITS = 1000, 4


def same_address(suppliers: DataFrame, block: int = BLOCK) -> DataFrame:
    """cnpj_a, cnpj_b, endereco_compartilhado: all pairs at one street and number, which is what is asked for here; the
    rules and the graph use ``score.shared_address``, which makes no pairs.

    An address with k suppliers gives k * (k - 1) / 2 rows. They are dealt to blocks of ``block``, and each two blocks
    meet by themselves, ``UNITS`` of them a task whatever the size of what is shuffled: rows are written 2 * k / block times.
    """
    at = "endereco_compartilhado"
    keyed = suppliers.select("cnpj", fn.address_key(F.col("logradouro")).alias(at)).filter(f"{at} is not null").distinct()
    many = keyed.groupBy(at).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"), F.count("*").alias("_k")).filter("_k > 1").drop("_k")
    units = many.agg(F.sum(F.col("_blocks").cast("long") * F.col("_blocks"))).first()[0] or 0
    rows = keyed.join(many, at).withColumn("_own", F.pmod(F.xxhash64("cnpj"), "_blocks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    unit = [at, "_i", "_j"]
    side = lambda name, own, other: rows.select(F.col("cnpj").alias(name), at, F.col("_own").alias(own), F.col("_other").alias(other)).repartition(max(1, -(-units // UNITS)), *unit)
    return side("cnpj_a", "_i", "_j").join(side("cnpj_b", "_j", "_i"), unit).filter("cnpj_a < cnpj_b").select("cnpj_a", "cnpj_b", at)


def denormalise(suppliers: DataFrame, scores: DataFrame, alerts: DataFrame, contracts: DataFrame) -> DataFrame:
    """The supplier dimension with score, band, alerts and contract totals; derived columns are computed anew."""
    derived = ["score_risco", "faixa_risco", "qtd_alertas", "max_severidade", "total_contratos", "valor_total"]
    score = scores.groupBy("fk_fornecedor").agg(F.sum("peso").alias("score_risco"))
    rank = F.when(F.col("severidade") == K.VERY_GRAVE, 2).when(F.col("severidade") == K.GRAVE, 1).otherwise(0)
    alert = alerts.groupBy("fk_fornecedor").agg(F.count("*").alias("qtd_alertas"), F.max(rank).alias("_rank"))
    contract = per_supplier(contracts).select("fk_fornecedor", F.col("n_contratos").alias("total_contratos"), F.col("total").alias("valor_total"))
    out = suppliers.drop(*derived)
    for right in (score, alert, contract):
        out = out.join(right.withColumnRenamed("fk_fornecedor", "pk_fornecedor"), "pk_fornecedor", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("score_risco", "qtd_alertas", "total_contratos", "valor_total")})
    out = out.withColumn("max_severidade", F.when(F.col("_rank") == 2, K.VERY_GRAVE).when(F.col("_rank") == 1, K.GRAVE)).drop("_rank")
    return out.withColumn("faixa_risco", fn.band(F.col("score_risco")))
