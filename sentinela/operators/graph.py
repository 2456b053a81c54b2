"""The ownership graph as two relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela import functions as fn


def edges(suppliers: DataFrame, partners: DataFrame, most_degree: int = K.MOST_DEGREE) -> DataFrame:
    """origem, destino, tipo: partner to company, and between companies with a common partner. Partners of more
    than ``most_degree`` companies give no company pairs (the graph's definition, a parameter)."""
    ident = F.coalesce(F.col("cpf_hmac"), F.col("nome_socio")) if "cpf_hmac" in partners.columns else F.col("nome_socio")
    own = suppliers.select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root"), F.col("cnpj").alias("company"))
    link = partners.select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root"), ident.alias("partner")).join(own, "_root").select("partner", "company").filter("partner is not null").distinct()
    level0 = link.select(F.col("partner").alias("origem"), F.col("company").alias("destino"), F.lit("socio_de").alias("tipo"))
    few = link.groupBy("partner").agg(F.count("*").alias("n")).filter(F.col("n") <= most_degree).select("partner")
    kept = link.join(few, "partner", "left_semi")
    a, b = kept.withColumnRenamed("company", "origem"), kept.withColumnRenamed("company", "destino")
    level1 = a.join(b, "partner").filter("origem < destino").select("origem", "destino", F.lit("socio_compartilhado").alias("tipo")).distinct()
    return level0.unionByName(level1)


def nodes(suppliers: DataFrame, partners: DataFrame, graph: DataFrame) -> DataFrame:
    """id, tipo, label of everything that an edge touches."""
    ident = F.coalesce(F.col("cpf_hmac"), F.col("nome_socio")) if "cpf_hmac" in partners.columns else F.col("nome_socio")
    people = partners.select(ident.alias("id"), F.lit("socio").alias("tipo"), F.col("nome_socio").alias("label"))
    companies = suppliers.select(F.col("cnpj").alias("id"), F.lit("empresa").alias("tipo"), F.col("razao_social").alias("label"))
    touched = graph.select(F.explode(F.array("origem", "destino")).alias("id")).distinct()
    return people.unionByName(companies).groupBy("id", "tipo").agg(F.min("label").alias("label")).join(touched, "id", "left_semi")


def top(graph: DataFrame, all_nodes: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of the highest degree (ties by id) and the edges between them."""
    degree = graph.select(F.explode(F.array("origem", "destino")).alias("id")).groupBy("id").agg(F.count("*").alias("grau"))
    best = all_nodes.join(degree, "id").orderBy(F.col("grau").desc(), "id").limit(most)
    ids = best.select("id")
    kept = graph.join(ids.withColumnRenamed("id", "origem"), "origem", "left_semi").join(ids.withColumnRenamed("id", "destino"), "destino", "left_semi")
    return best, kept.select("origem", "destino", "tipo")


def two_hops(bridge: DataFrame, start: DataFrame) -> DataFrame:
    """pk_fornecedor, nivel: the companies within two steps over common partners of those in ``start``."""
    a = bridge.select(F.col("fk_fornecedor").alias("pk_fornecedor"), "fk_socio")
    b = bridge.select(F.col("fk_fornecedor").alias("next"), "fk_socio")
    level, found = start.select("pk_fornecedor"), start.select("pk_fornecedor", F.lit(0).alias("nivel"))
    for n in (1, 2):
        level = level.join(a, "pk_fornecedor").select("fk_socio").distinct().join(b, "fk_socio").select(F.col("next").alias("pk_fornecedor")).distinct()
        found = found.unionByName(level.withColumn("nivel", F.lit(n)))
    return found.groupBy("pk_fornecedor").agg(F.min("nivel").alias("nivel"))


def supplier_network(bridge: DataFrame, suppliers: DataFrame, partners: DataFrame, start: DataFrame, most_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, tipo, label, score, qtd_alertas) and edges (source, target, tipo, label) around ``start``: the companies
    within two steps, then all their partners. ``most_nodes`` keeps the first nodes, companies before partners, by key."""
    near = two_hops(bridge, start).select("pk_fornecedor")
    extra = [F.col(c) if c in suppliers.columns else F.lit(None).cast("long") for c in ("score_risco", "qtd_alertas")]
    own = suppliers.join(near, "pk_fornecedor", "left_semi")
    companies = own.select(F.lit(0).alias("_o"), F.col("pk_fornecedor").alias("_k"), F.concat(F.lit("empresa_"), F.col("pk_fornecedor")).alias("id"), F.lit("empresa").alias("tipo"), F.col("razao_social").alias("label"), extra[0].cast("long").alias("score"), extra[1].cast("long").alias("qtd_alertas"))
    links = bridge.join(own.select(F.col("pk_fornecedor").alias("fk_fornecedor")), "fk_fornecedor", "left_semi").select("fk_fornecedor", "fk_socio").distinct()
    kind = F.col("qualificacao") if "qualificacao" in partners.columns else F.lit(None).cast("string")
    who = links.join(partners.select(F.col("pk_socio").alias("fk_socio"), "nome_socio", kind.alias("qualificacao")), "fk_socio")
    none = F.lit(None).cast("long")
    people = who.groupBy("fk_socio").agg(F.min("nome_socio").alias("label")).select(F.lit(1).alias("_o"), F.col("fk_socio").alias("_k"), F.concat(F.lit("socio_"), F.col("fk_socio")).alias("id"), F.lit("socio").alias("tipo"), "label", none.alias("score"), none.alias("qtd_alertas"))
    every = companies.unionByName(people)
    every = (every if most_nodes is None else every.orderBy("_o", "_k").limit(most_nodes)).drop("_o", "_k")
    edges_ = who.select(F.concat(F.lit("socio_"), F.col("fk_socio")).alias("source"), F.concat(F.lit("empresa_"), F.col("fk_fornecedor")).alias("target"), F.lit("socio_de").alias("tipo"), F.col("qualificacao").alias("label")).distinct()
    return every, edges_
