"""Key dictionaries of the star schema: agencies, modalities, candidates, days and the bridge, with keys that last.

A dimension of the version before is its own key map: known natural keys keep their numbers, also those that are not
delivered any more, and new ones get the next numbers, in order, without one task numbering all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentinela import functions as fn
from sentinela.operators import core

#: Names of the months in the published calendar.
MONTHS = ["Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro"]


def keyed(fresh: DataFrame, natural: list[str], pk: str, previous: DataFrame | None = None) -> DataFrame:
    """``fresh``, a row for each natural key, with ``pk``; rows of ``previous`` that are not delivered stay as they were."""
    if previous is None:
        return core.number_rows(fresh, pk, natural)
    same = lambda a, b: reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in natural])
    known = fresh.join(previous.select(*natural, pk).alias("p"), same(fresh, previous), "inner").select(*(fresh[c] for c in fresh.columns), F.col(f"p.{pk}").alias(pk))
    new = core.number_rows(fresh.join(previous, same(fresh, previous), "left_anti"), "_new", natural)
    last = previous.agg(F.coalesce(F.max(pk), F.lit(0)).alias("_last"))  # one row
    new = new.join(F.broadcast(last)).withColumn(pk, F.col("_last") + F.col("_new")).drop("_last", "_new")
    gone = previous.join(fresh, same(fresh, previous), "left_anti")
    return known.unionByName(new).unionByName(gone.select(*known.columns))


def _latest(contracts: DataFrame, key: str, *columns: Column) -> DataFrame:
    """The columns of each key's latest contract; of one day the least."""
    row = F.struct(*columns)
    order = F.struct(F.col("data_assinatura").isNull(), -F.unix_date("data_assinatura"), row)
    return contracts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, order).alias("_r")).select(key, "_r.*")


def agencies(contracts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """dim_orgao: a row for each code, described as in its latest contract; without a name the code stands for it."""
    text = lambda c: F.col(c) if c in contracts.columns else F.lit(None).cast("string")
    code = contracts.withColumn("codigo", blank_to_null(text("codigo_orgao")))
    rows = _latest(code, "codigo", F.coalesce(blank_to_null(text("nome_orgao")), F.col("codigo")).alias("nome"), text("poder_orgao").alias("poder"), text("esfera_orgao").alias("esfera"))
    rows = rows.withColumns({"sigla": F.lit(None).cast("string"), "uf": F.lit(None).cast("string")})
    return keyed(rows, ["codigo"], "pk_orgao", previous)


def modality_code(contracts: DataFrame) -> Column:
    """The modality's code, or its name where the source has no code."""
    text = lambda c: blank_to_null(F.col(c)) if c in contracts.columns else F.lit(None).cast("string")
    return F.coalesce(text("modalidade_codigo"), text("modalidade_nome"))


def modalities(contracts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """dim_modalidade: a row for each code, with the latest name."""
    code = contracts.withColumn("codigo", modality_code(contracts))
    name = blank_to_null(F.col("modalidade_nome")) if "modalidade_nome" in contracts.columns else F.lit(None).cast("string")
    return keyed(_latest(code, "codigo", F.coalesce(name, F.col("codigo")).alias("descricao")), ["codigo"], "pk_modalidade", previous)


CANDIDATE = ["nome", "cpf_hmac", "partido", "cargo", "uf", "ano_eleicao"]


def candidate(donations: DataFrame, key: str) -> dict[str, Column]:
    """The natural key of a donation's candidate; the personal number as a keyed hash."""
    have = lambda c, kind="string": F.col(c) if c in donations.columns else F.lit(None).cast(kind)
    return {"nome": have("nome_candidato"), "cpf_hmac": fn.hmac_hex(have("doc_candidato"), key), "partido": have("partido"), "cargo": have("cargo"), "uf": have("uf"), "ano_eleicao": have("ano_eleicao", "int").cast("smallint")}


def candidates(donations: DataFrame, key: str, previous: DataFrame | None = None) -> DataFrame:
    """dim_candidato: a row for each candidacy that has a name."""
    rows = donations.select(*[c.alias(n) for n, c in candidate(donations, key).items()]).filter("nome is not null").distinct()
    return keyed(rows, CANDIDATE, "pk_candidato", previous)


def day_key(day: Column) -> Column:
    """yyyymmdd: the same in every version."""
    return F.date_format(day, "yyyyMMdd").cast("bigint")


def days(dates: list[DataFrame], previous: DataFrame | None = None) -> DataFrame:
    """dim_tempo: every day that a fact names (tables of one date column), and those of the version before. Monday is 1."""
    every = reduce(DataFrame.union, [d.toDF("data") for d in [*dates, *([previous.select("data")] if previous is not None else [])]])
    d = F.col("data")
    month = F.month(d)
    name = F.element_at(F.array(*map(F.lit, MONTHS)), month)
    return every.filter("data is not null").distinct().select(day_key(d).alias("pk_tempo"), d, F.year(d).cast("smallint").alias("ano"), month.cast("tinyint").alias("mes"), F.quarter(d).cast("tinyint").alias("trimestre"), F.when(month <= 6, 1).otherwise(2).cast("tinyint").alias("semestre"), (F.weekday(d) + 1).cast("tinyint").alias("dia_semana"), name.alias("nome_mes"))


def bridge(partners: DataFrame, suppliers: DataFrame) -> DataFrame:
    """bridge_fornecedor_socio: numbered partners by their company's root; of one pair the earliest entry."""
    own = suppliers.select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root"), F.col("pk_fornecedor").alias("fk_fornecedor"))
    have = lambda c, kind: (F.col(c) if c in partners.columns else F.lit(None).cast(kind)).alias(c)
    rows = partners.select(fn.zfill(F.col("cnpj_basico"), 8).alias("_root"), F.col("pk_socio").alias("fk_socio"), have("data_entrada", "date"), have("data_saida", "date"), have("percentual_capital", "decimal(5,2)"))
    return core.keep_first(rows.join(own, "_root").drop("_root"), ["fk_fornecedor", "fk_socio"], [F.col("data_entrada").isNull(), "data_entrada", "data_saida", "percentual_capital"])


def blank_to_null(c: Column) -> Column:
    return F.when(~fn.blank(c), fn.strip(c))


def star(suppliers: DataFrame, partners: DataFrame, contracts: DataFrame, donations: DataFrame, key: str, previous: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The five dictionaries, and both facts with their keys. ``partners`` have pk_socio, facts fk_fornecedor; ``previous``:
    tables of the version before. Personal numbers of donors come out as keyed hashes."""
    old = (previous or {}).get
    out = {"dim_orgao": agencies(contracts, old("dim_orgao")), "dim_modalidade": modalities(contracts, old("dim_modalidade")), "dim_candidato": candidates(donations, key, old("dim_candidato"))}
    received = F.col("data_receita") if "data_receita" in donations.columns else F.lit(None).cast("date")
    out["dim_tempo"] = days([contracts.select("data_assinatura"), donations.select(received)], old("dim_tempo"))
    out["bridge_fornecedor_socio"] = bridge(partners, suppliers)
    facts = contracts.drop("fk_orgao", "fk_modalidade", "fk_tempo").withColumns({"_org": blank_to_null(F.col("codigo_orgao")), "_mod": modality_code(contracts), "fk_tempo": day_key(F.col("data_assinatura"))})
    facts = facts.join(out["dim_orgao"].select(F.col("codigo").alias("_org"), F.col("pk_orgao").alias("fk_orgao")), "_org", "left")
    out["fato_contrato"] = facts.join(out["dim_modalidade"].select(F.col("codigo").alias("_mod"), F.col("pk_modalidade").alias("fk_modalidade")), "_mod", "left").drop("_org", "_mod")
    named = {f"_{n}": c for n, c in candidate(donations, key).items()}
    gifts = donations.drop("fk_candidato", "fk_tempo").withColumns(named)
    who = out["dim_candidato"].select(F.col("pk_candidato").alias("fk_candidato"), *(F.col(c).alias(f"k_{c}") for c in CANDIDATE))
    gifts = gifts.join(who, reduce(Column.__and__, [F.col(f"_{c}").eqNullSafe(F.col(f"k_{c}")) for c in CANDIDATE]), "left")
    company = F.col("tipo_doador") == "CNPJ"
    gifts = gifts.withColumns({"fk_tempo": day_key(received), "cnpj_doador": F.when(company, F.col("doc_doador")), "cpf_doador": F.when(F.col("tipo_doador") == "CPF", fn.hmac_hex(F.col("doc_doador"), key))})
    out["fato_doacao"] = gifts.drop("doc_doador", "doc_candidato", *named, *(f"k_{c}" for c in CANDIDATE))
    return out
