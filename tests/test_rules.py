import ast
import datetime as dt
from decimal import Decimal as D
from pathlib import Path

from sentinela.operators import alerts, core, graph, score

SUP = "pk_fornecedor long, cnpj string, cnpj_basico string, razao_social string, capital_social decimal(18,2), data_abertura date, logradouro string, cnae_principal string, qtd_funcionarios long"
CON = "fk_fornecedor long, fk_orgao long, num_licitacao string, valor decimal(18,2), data_assinatura date, objeto_categoria string"
d = dt.date


def suppliers(spark, *rows):
    full = [(r[0], f"{r[0]:08d}000100", str(r[0]), f"E{r[0]}", *r[1:]) for r in rows]
    return spark.createDataFrame(full, SUP)


def test_low_capital_bounds(spark):
    s = suppliers(spark, (1, D("9999.99"), None, None, None, None), (2, D(10000), None, None, None, None), (3, None, None, None, None, None))
    c = spark.createDataFrame([(i, 1, None, D(100000), None, None) for i in (1, 2, 3)], CON)
    assert score.low_capital(s, c).count() == 0
    assert [r.fk_fornecedor for r in score.low_capital(s, c, "online").collect()] == [1]


def test_growth_variants(spark):
    s = suppliers(spark, (1, None, None, None, None, None))
    rows = [(1, 1, None, D(v), d(y, 5, 1), None) for y, v in ((2018, 10000), (2019, 60000), (2020, 50000), (2021, 250000))]
    c = spark.createDataFrame(rows, CON)
    assert "2020 e 2021" in score.sudden_growth(s, c).first()["descricao"]
    assert "2020 e 2021" in score.sudden_growth(s, c, "online").first()["descricao"]


def test_exclusive_ignores_unknown_buyers(spark):
    s = suppliers(spark, (1, None, None, None, None, None), (2, None, None, None, None, None))
    c = spark.createDataFrame([(1, None, None, D(1), None, None), (2, 5, None, D(1), None, None)], CON)
    assert [r.fk_fornecedor for r in score.exclusive_buyer(s, c).collect()] == [2]


def test_sanction_day(spark):
    sc = "fk_fornecedor long, cnpj_basico string, data_fim date"
    s = suppliers(spark, (1, None, None, None, None, None))
    c = spark.createDataFrame([(1, 1, None, D(1), None, None)], CON)
    x = spark.createDataFrame([(1, "1", d(2024, 2, 1))], sc)
    assert score.past_sanction(s, x, "2024-02-01").count() == 1
    assert alerts.sanctioned_contracting(s, c, x, "2024-02-01").count() == 0
    assert alerts.sanctioned_contracting(s, c, x, "2024-02-01", inclusive=True).count() == 1


def test_bid_rotation(spark):
    s = suppliers(spark, *[(i, None, None, None, None, None) for i in (1, 2, 3)])
    p = spark.createDataFrame([("1", "ANA"), ("2", "ANA"), ("3", "BIA")], "cnpj_basico string, nome_socio string")
    bids = [(f, 1, f"L{k}", D(1), None, None) for f, n in ((1, 3), (2, 3), (3, 3)) for k in range(n)]
    got = alerts.bid_rotation(s, p, spark.createDataFrame(bids, CON)).collect()
    assert sorted(r.fk_fornecedor for r in got) == [1, 2] and got[0].evidencia.endswith("=3")
    assert alerts.bid_rotation(s, p, spark.createDataFrame([b for b in bids if b[2] != "L2"], CON)).count() == 0


def test_front_company(spark):
    s = suppliers(spark, (1, D(500), d(2020, 1, 1), None, None, None))
    p = spark.createDataFrame([("1", "ANA", False, 3)], "cnpj_basico string, nome_socio string, is_servidor_publico boolean, qtd_empresas_governo long")
    c = spark.createDataFrame([(1, 1, None, D(1), d(2020, 12, 1), None)], CON)
    assert alerts.front_company(s, p, c).count() == 1
    assert alerts.front_company(s, p, spark.createDataFrame([(1, 1, None, D(1), d(2021, 1, 1), None)], CON)).count() == 0


def test_keep_first_null_keys_and_merge(spark):
    x = spark.createDataFrame([(1, None), (2, None), (3, "a")], "i long, k string")
    assert sorted(r.i for r in core.keep_first(x, ["k"], ["i"]).collect()) == [1, 3]
    y = spark.createDataFrame([(9, "a", 1)], "i long, k string, z int")
    assert sorted(r.i for r in core.merge_first([x, y], ["k"], ["i"]).collect()) == [1, 3]


def test_number_rows_and_empty(spark):
    x = spark.createDataFrame([(i,) for i in range(100)], "k long")
    assert all(r.pk == r.k + 1 for r in core.number_rows(x.repartition(7), "pk", ["k"]).collect())
    none = suppliers(spark).limit(0)
    c = spark.createDataFrame([], CON)
    assert score.low_capital(none, c).count() == 0 and score.shared_address(none).count() == 0


def test_graph_degree_cap(spark):
    s = suppliers(spark, *[(i, None, None, None, None, None) for i in range(1, 6)])
    p = spark.createDataFrame([(str(i), "ANA") for i in range(1, 6)], "cnpj_basico string, nome_socio string")
    assert graph.edges(s, p).filter("tipo = 'socio_compartilhado'").count() == 10
    assert graph.edges(s, p, most_degree=4).filter("tipo = 'socio_compartilhado'").count() == 0


def test_score_and_alerts_are_independent():
    root = Path(score.__file__).parent
    for one, other in (("score", "alerts"), ("alerts", "score")):
        for node in ast.walk(ast.parse((root / f"{one}.py").read_text())):
            names = [a.name for a in node.names] + [getattr(node, "module", "") or ""] if isinstance(node, (ast.Import, ast.ImportFrom)) else []
            assert not any(other in n for n in names)
