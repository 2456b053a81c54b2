"""The declared schema, lasting keys, and what layouts spare."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentinela import layout, publish, schema
from sentinela.operators import core, dimensions
from sentinela.plans import run
from tests.test_sources import staging

STAR = ["dim_tempo", "dim_fornecedor", "dim_orgao", "dim_socio", "dim_modalidade", "dim_candidato", "bridge_fornecedor_socio", "fato_contrato", "fato_doacao", "fato_score_detalhe", "fato_alerta_critico", "dim_sancao"]


def orgaos(spark, rows):
    return spark.createDataFrame(rows, "pk_orgao long, codigo string, nome string, extra int")


def test_conform_by_name(spark):
    df = spark.createDataFrame([("1", "12.5", "x", 7)], "pk_fornecedor string, capital_social string, razao_social string, cnpj_basico int").withColumn("cnpj", F.lit("c"))
    out = schema.conform(df, "dim_fornecedor")
    assert [f.name for f in out.schema.fields] == [c for c, _, _ in schema.TABLES["dim_fornecedor"].fields()]
    r = out.first()
    assert (r.pk_fornecedor, str(r.capital_social), r.score_risco, r.faixa_risco, r.uf) == (1, "12.50", 0, "Baixo", None)
    assert schema.conform(spark.createDataFrame([(1, "ana")], "pk_socio long, nome_socio string"), "dim_socio").first().nome == "ana"


def test_each_violation(spark):
    own = spark.createDataFrame([(1, "c1", "A"), (1, "c2", "B"), (2, "c2", None), (None, "c3", "C")], "pk_fornecedor long, cnpj string, razao_social string")
    facts = spark.createDataFrame([(1, 1, "5", "x"), (2, 9, "x7", None), (3, None, None, None), (4, 8, "1", "2020-01-01")], "pk_contrato long, fk_fornecedor long, valor string, data_assinatura string")
    got = {(r.tabela, r.regra, r.coluna): (r.n, r.exemplo) for r in schema.check({"dim_fornecedor": own, "fato_contrato": facts}).collect()}
    assert got == {
        ("dim_fornecedor", "nulo", "pk_fornecedor"): (1, None),
        ("dim_fornecedor", "nulo", "razao_social"): (1, None),
        ("dim_fornecedor", "chave", "pk_fornecedor"): (1, "1"),
        ("dim_fornecedor", "unico", "cnpj"): (1, "c2"),
        ("fato_contrato", "tipo", "valor"): (1, "x7"),
        ("fato_contrato", "nulo", "valor"): (1, None),
        ("fato_contrato", "tipo", "data_assinatura"): (1, "x"),
        ("fato_contrato", "referencia", "fk_fornecedor"): (2, "8"),
    }


def test_nothing_is_published_when_a_rule_is_broken(spark, tmp_path):
    out = str(tmp_path / "w")
    first = schema.load(spark, {"dim_orgao": orgaos(spark, [(1, "a", "A", 0)])}, out)
    with pytest.raises(schema.Violations) as e:
        schema.load(spark, {"dim_orgao": orgaos(spark, [(1, "a", "A", 0), (1, "b", None, 0)])}, out)
    assert [(r.regra, r.coluna, r.n) for r in e.value.rows] == [("chave", "pk_orgao", 1), ("nulo", "nome", 1)]
    assert publish.current(spark, out).endswith(first) and len(list((tmp_path / "w").glob("v-*"))) == 1
    with pytest.raises(KeyError):
        schema.load(spark, {"nope": spark.range(1)}, out)
    empty = schema.load(spark, {"dim_orgao": orgaos(spark, [])}, out, keep=1)
    assert publish.published(spark, out)["dim_orgao"].count() == 0 and [p.name for p in (tmp_path / "w").glob("v-*")] == [empty]


def test_keys_stay(spark):
    of = lambda rows: spark.createDataFrame(rows, "codigo string, nome string")
    first = dimensions.keyed(of([("b", "B"), ("d", "D"), (None, "N")]), ["codigo"], "pk")
    assert sorted(tuple(r) for r in first.select("pk", "codigo").collect()) == [(1, None), (2, "b"), (3, "d")]
    second = dimensions.keyed(of([("a", "A"), ("d", "D2"), (None, "N2"), ("c", "C")]), ["codigo"], "pk", first)
    assert sorted(tuple(r) for r in second.select("pk", "codigo", "nome").collect()) == [(1, None, "N2"), (2, "b", "B"), (3, "d", "D2"), (4, "a", "A"), (5, "c", "C")]
    third = dimensions.keyed(of([]), ["codigo"], "pk", second)
    assert third.count() == 5


def test_calendar(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 15),), (dt.date(2024, 1, 15),), (None,), (dt.date(2023, 12, 31),)], "d date")
    got = sorted(tuple(r) for r in dimensions.days([days]).collect())
    assert got == [(20231231, dt.date(2023, 12, 31), 2023, 12, 4, 2, 7, "Dezembro"), (20240115, dt.date(2024, 1, 15), 2024, 1, 1, 1, 1, "Janeiro")]
    assert dimensions.days([days.limit(0)], dimensions.days([days])).count() == 2


def test_a_whole_run_is_loaded(spark, tmp_path):
    tables = staging(spark, tmp_path)
    out = str(tmp_path / "w")
    built = run.build(tables, "2024-02-01", "salt")
    schema.load(spark, {n: built[n] for n in STAR}, out, layout.LAYOUT)
    now = publish.published(spark, out, layout.LAYOUT)
    assert sorted(now) == sorted(STAR) and now["bridge_fornecedor_socio"].count() == 3 and now["dim_modalidade"].first().codigo == "8"
    keys = {(r.codigo, r.pk_modalidade) for r in now["dim_modalidade"].collect()}
    more = tables["contratos"].withColumns({"modalidade_codigo": F.lit("1"), "codigo_orgao": F.lit("777"), "num_licitacao": F.concat(F.lit("N"), F.col("num_licitacao")), "pk_contrato": F.col("pk_contrato") + 100})
    again = run.build({**tables, "contratos": tables["contratos"].unionByName(more)}, "2024-02-01", "salt", previous=now)
    schema.load(spark, {n: again[n] for n in STAR}, out, layout.LAYOUT)
    later = publish.published(spark, out, layout.LAYOUT)
    assert keys < {(r.codigo, r.pk_modalidade) for r in later["dim_modalidade"].collect()}
    assert [r.codigo for r in later["dim_orgao"].collect()] == ["777"] and later["fato_contrato"].filter("fk_orgao is not null and fk_tempo is not null").count() > 0
    assert later["fato_doacao"].first().fk_tempo == 20220901


def test_lookups_skip_row_groups(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Alto", "Baixo", "Medio", None]), rng.choice("ABCDEFGH"), rng.randint(0, 100), f"{rng.randrange(10**8):08d}") for i in range(40_000)]
    df = spark.createDataFrame(rows, "pk long, faixa string, uf string, score int, cnpj string")
    path = str(tmp_path / "t")
    layout.write_clustered(df, path, layout.Clustered(("faixa", "uf", "score"), ("cnpj",), 10_000, 8_192))
    t = spark.read.parquet(path)
    assert t.count() == len(rows)
    for where, most in ((f"cnpj = '{rows[77][4]}'", 0.1), ("faixa = 'Alto' and uf = 'C'", 0.25), ("score > 98", 0.5)):
        hit = t.filter(where)
        assert layout.scanned_rows(hit) <= most * len(rows)
        assert sorted(r.pk for r in hit.collect()) == sorted(r.pk for r in df.filter(where).collect())


def exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_buckets_take_no_exchange(spark, tmp_path):
    own = spark.range(1, 200).select(F.col("id").alias("pk_fornecedor"), F.col("id").cast("string").alias("nome"))
    facts = spark.range(20_000).select(F.col("id").alias("pk"), (F.col("id") % 199 + 1).alias("fk_fornecedor"), F.col("id").cast("decimal(18,2)").alias("valor"), F.lit(dt.date(2020, 1, 1)).alias("data_assinatura"))
    how = [layout.Bucketed("fk_fornecedor", 8, ("data_assinatura",)), layout.Bucketed("pk_fornecedor", 8)]
    for df, name, h in ((facts, "f", how[0]), (own, "o", how[1])):
        layout.write_bucketed(df, str(tmp_path / name), h)
    f, o = layout.read_bucketed(spark, str(tmp_path / "f"), how[0]), layout.read_bucketed(spark, str(tmp_path / "o"), how[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lambda a, b: core.per_supplier(a).join(b, F.col("fk_fornecedor") == F.col("pk_fornecedor"))
        assert exchanges(plan(facts, own)) >= 2 and exchanges(plan(f, o)) == 0
        same = lambda df: sorted(map(str, df.select("nome", "total", "n_contratos").collect()))
        assert same(plan(facts, own)) == same(plan(f, o))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
