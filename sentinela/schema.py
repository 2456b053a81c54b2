"""The declared star schema: typed loading by column name, rules checked before anything is published.

``check`` gives a row for each broken rule; ``load`` publishes only if there is none.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela import durable, publish


@dataclass(frozen=True)
class Table:
    """``columns``: name and type, ``!`` for NOT NULL; ``unique``: sets of columns, the primary key first; ``refs``: column
    to table whose primary key it names; ``defaults``: for columns that are not delivered; ``names``: other names under
    which the run delivers a column."""

    columns: str
    unique: tuple[tuple[str, ...], ...]
    refs: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)

    def fields(self) -> list[tuple[str, str, bool]]:
        """Name, type and whether null is forbidden."""
        out = []
        for c in self.columns.split("; "):
            name, kind = c.split(" ")
            out.append((name, kind.rstrip("!"), kind.endswith("!")))
        return out


# Names, types and rules of the published tables. Keys are bigint here.
TABLES = {
    "dim_tempo": Table("pk_tempo bigint!; data date!; ano smallint!; mes tinyint!; trimestre tinyint!; semestre tinyint!; dia_semana tinyint!; nome_mes string!", (("pk_tempo",),)),
    "dim_fornecedor": Table(
        "pk_fornecedor bigint!; cnpj string!; razao_social string!; data_abertura date; capital_social decimal(18,2); cnae_principal string; cnae_descricao string; logradouro string; municipio string; uf string; cep string; situacao string; score_risco smallint; faixa_risco string; qtd_alertas smallint; max_severidade string; total_contratos int; valor_total decimal(18,2); qtd_funcionarios int; atualizado_em timestamp_ntz",
        (("pk_fornecedor",), ("cnpj",)),
        defaults={"score_risco": 0, "faixa_risco": "Baixo", "qtd_alertas": 0, "total_contratos": 0, "valor_total": 0},
    ),
    "dim_orgao": Table("pk_orgao bigint!; codigo string!; nome string!; sigla string; poder string; esfera string; uf string", (("pk_orgao",), ("codigo",))),
    "dim_socio": Table(
        "pk_socio bigint!; cpf_hmac string; nome string!; qualificacao string; is_servidor_publico boolean; orgao_lotacao string; is_sancionado boolean; qtd_empresas_governo int",
        (("pk_socio",),),
        defaults={"is_servidor_publico": False, "is_sancionado": False, "qtd_empresas_governo": 0},
        names={"nome": "nome_socio", "qualificacao": "qualificacao_socio"},
    ),
    "dim_modalidade": Table("pk_modalidade bigint!; codigo string!; descricao string!", (("pk_modalidade",), ("codigo",))),
    "dim_candidato": Table("pk_candidato bigint!; nome string!; cpf_hmac string; partido string; cargo string; uf string; ano_eleicao smallint", (("pk_candidato",),)),
    "bridge_fornecedor_socio": Table("fk_fornecedor bigint!; fk_socio bigint!; data_entrada date; data_saida date; percentual_capital decimal(5,2)", (("fk_fornecedor", "fk_socio"),), {"fk_fornecedor": "dim_fornecedor", "fk_socio": "dim_socio"}),
    "fato_contrato": Table(
        "pk_contrato bigint!; fk_fornecedor bigint; fk_orgao bigint; fk_tempo bigint; fk_modalidade bigint; cnpj_fornecedor string; codigo_orgao string; nome_orgao string; modalidade_nome string; valor decimal(18,2)!; objeto string; num_licitacao string; data_assinatura date; data_vigencia date",
        (("pk_contrato",),),
        {"fk_fornecedor": "dim_fornecedor", "fk_orgao": "dim_orgao", "fk_tempo": "dim_tempo", "fk_modalidade": "dim_modalidade"},
    ),
    "fato_doacao": Table(
        "pk_doacao bigint!; fk_fornecedor bigint; fk_socio bigint; fk_candidato bigint; fk_tempo bigint; ano_eleicao smallint!; cnpj_doador string; cpf_doador string; nome_doador string; nome_candidato string; partido_candidato string; cargo_candidato string; uf_candidato string; tipo_recurso string; valor decimal(18,2)!; data_receita date",
        (("pk_doacao",),),
        {"fk_fornecedor": "dim_fornecedor", "fk_socio": "dim_socio", "fk_candidato": "dim_candidato", "fk_tempo": "dim_tempo"},
        names={"partido_candidato": "partido", "cargo_candidato": "cargo", "uf_candidato": "uf"},
    ),
    "fato_score_detalhe": Table("pk_score_detalhe bigint!; fk_fornecedor bigint!; indicador string!; peso smallint!; descricao string; evidencia string; calculado_em timestamp_ntz", (("pk_score_detalhe",),), {"fk_fornecedor": "dim_fornecedor"}),
    "fato_alerta_critico": Table("pk_alerta bigint!; fk_fornecedor bigint!; fk_socio bigint; tipo_alerta string!; severidade string!; descricao string!; evidencia string!; detectado_em timestamp_ntz", (("pk_alerta",),), {"fk_fornecedor": "dim_fornecedor"}),
    "dim_sancao": Table("pk_sancao bigint!; fk_fornecedor bigint; cnpj string; razao_social string; tipo_sancao string!; orgao_sancionador string; motivo string; data_inicio date!; data_fim date", (("pk_sancao",),), {"fk_fornecedor": "dim_fornecedor"}),
}


class Violations(Exception):
    """Rules that a load breaks: ``rows`` of ``check``."""

    def __init__(self, rows: list):
        super().__init__("; ".join(f"{r.tabela}.{r.coluna}: {r.regra}, {r.n} rows, such as {r.exemplo}" for r in rows))
        self.rows = rows


def _delivered(df: DataFrame, table: Table, name: str) -> str | None:
    """The delivered column for a declared one, by its own name or the run's."""
    return next((c for c in (name, table.names.get(name)) if c in df.columns), None)


def _declared(df: DataFrame, name: str) -> DataFrame:
    """The delivered columns that the table declares, as they are."""
    every = [_delivered(df, TABLES[name], c) for c, _, _ in TABLES[name].fields()]
    return df.select(*dict.fromkeys(f"`{c}`" for c in every if c))


def conform(df: DataFrame, name: str) -> DataFrame:
    """Just the declared columns, by name and typed; what is not delivered has its default or is null."""
    table, out = TABLES[name], []
    for c, kind, _ in table.fields():
        own = _delivered(df, table, c)
        out.append((F.col(f"`{own}`").try_cast(kind) if own else F.lit(table.defaults.get(c)).cast(kind)).alias(c))
    return df.select(*out)


def _cells(df: DataFrame, name: str) -> DataFrame:
    """tabela, regra, coluna, n, exemplo of values that are null or of another type, in one aggregation of the table."""
    table, sums, rules = TABLES[name], [], []
    for c, kind, needed in table.fields():
        own = _delivered(df, table, c)
        raw = F.col(f"`{own}`") if own else F.lit(table.defaults.get(c)).cast(kind)
        if own:
            wrong = raw.isNotNull() & raw.try_cast(kind).isNull()
            rules.append(("tipo", c))
            sums.append(F.struct(F.count_if(wrong).alias("n"), F.min(F.when(wrong, raw.cast("string"))).alias("exemplo")))
        if needed:
            rules.append(("nulo", c))
            sums.append(F.struct(F.count_if(raw.isNull()).alias("n"), F.lit(None).cast("string").alias("exemplo")))
    one = df.agg(F.array(*[F.struct(F.lit(r).alias("regra"), F.lit(c).alias("coluna"), s.alias("x")) for (r, c), s in zip(rules, sums, strict=True)]).alias("r"))
    return one.select(F.explode("r").alias("r")).select(F.lit(name).alias("tabela"), "r.regra", "r.coluna", "r.x.n", "r.x.exemplo")


def _text(cols: tuple[str, ...]):
    return F.concat_ws(",", *(F.col(c).cast("string") for c in cols))


def _keys(df: DataFrame, name: str) -> list[DataFrame]:
    """Rows beyond the first of each key; a key with a null is not compared."""
    out = []
    for i, cols in enumerate(TABLES[name].unique):
        again = df.dropna(subset=list(cols)).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
        one = again.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"), F.min(_text(cols)).alias("exemplo"))
        out.append(one.select(F.lit(name).alias("tabela"), F.lit("unico" if i else "chave").alias("regra"), F.lit(",".join(cols)).alias("coluna"), "n", "exemplo"))
    return out


def _refs(df: DataFrame, name: str, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """References to rows that are not there; one to a table that is not loaded is not checked."""
    out = []
    for c, other in TABLES[name].refs.items():
        if other in tables:
            key = TABLES[other].unique[0][0]
            lost = df.select(c).dropna().join(tables[other].select(F.col(key).alias(c)), c, "left_anti")
            out.append(lost.agg(F.count("*").alias("n"), F.min(F.col(c).cast("string")).alias("exemplo")).select(F.lit(name).alias("tabela"), F.lit("referencia").alias("regra"), F.lit(c).alias("coluna"), "n", "exemplo"))
    return out


def check(tables: dict[str, DataFrame]) -> DataFrame:
    """tabela, regra (tipo, nulo, chave, unico, referencia), coluna, n, exemplo of every broken rule: an aggregation a table
    for values, one a key, and an anti-join a reference."""
    typed = {n: conform(df, n) for n, df in tables.items()}
    parts = [p for n, df in tables.items() for p in (_cells(df, n), *_keys(typed[n], n), *_refs(typed[n], n, typed))]
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def load(spark: SparkSession, tables: dict[str, DataFrame], out: str, layout: dict | None = None, keep: int | None = None) -> str:
    """Check the tables, then publish them as declared. They are written once before, so that what is checked is what is
    published; a broken rule raises ``Violations``, and the current version stays."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise KeyError(f"not in the schema: {sorted(unknown)}")
    written = {n: durable.materialise(_declared(df, n), f"load-{n}") for n, df in tables.items()}
    try:
        bad = check(written).orderBy("tabela", "regra", "coluna").collect()  # at most a row for each rule
        if bad:
            raise Violations(bad)
        return publish.publish(spark, {n: conform(df, n) for n, df in written.items()}, out, layout, keep)
    finally:
        for df in written.values():
            durable.discard(df)
