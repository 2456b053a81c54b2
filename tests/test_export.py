import datetime as dt
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sentinela.plans import export

SUPPLIER = "pk_fornecedor long, cnpj string, razao_social string, data_abertura date, capital_social decimal(18,2), cnae_principal string, linha string"


def make(spark, hot=0):
    contracts = spark.range(hot).select(F.lit(1).cast("long").alias("fk_fornecedor"), F.lit("10.00").cast("decimal(18,2)").alias("valor"), F.lit(dt.date(2020, 1, 2)).alias("data_assinatura"), F.lit("equal").alias("objeto"), F.col("id").alias("pk_contrato"))
    few = spark.createDataFrame([(2, None, None, None, None, "x"), (2, None, dt.date(2021, 3, 4), "é,\n", 7, "x"), (2, None, dt.date(2021, 3, 4), "é,\n", 7, "x"), (9, None, None, "nobody's", 8, "x"), (None, None, None, "null key", 9, "x")], "fk_fornecedor long, valor decimal(18,2), data_assinatura date, objeto string, pk_contrato long, cnpj string")
    return SimpleNamespace(
        suppliers=spark.createDataFrame([(1, "A1", "Acme", dt.date(2019, 1, 1), None, "4120", "clash"), (2, "B2", None, None, None, None, "clash")], SUPPLIER),
        scores=spark.createDataFrame([(1, "LOW", 10, "d", "clash")], "fk_fornecedor long, indicador string, peso int, descricao string, linha string"),
        alerts=spark.createDataFrame([], "fk_fornecedor long, tipo_alerta string, severidade string, descricao string"),
        contracts=contracts.unionByName(few.drop("cnpj")) if hot else few,
        partners=spark.createDataFrame([(1, "ANA", True, None, 3)], "fk_fornecedor long, nome_socio string, is_servidor_publico boolean, orgao_lotacao string, pk_socio long"),
    )


def test_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = export.lines(make(spark))
    export.write(rows, path, 3)
    assert [tuple(r)[1:4] for r in export.read(spark, path, "A1").collect()] == [(0, "DADOS CADASTRAIS", x) for x in ("CAPITAL", "CNAE,4120", "CNPJ,A1", "Capital Social,", "Data Abertura,2019-01-01", "Razao Social,Acme")[1:]] + [(1, "SCORE DE RISCO", "LOW,10,d"), (4, "SOCIOS", "ANA,true,")]
    assert [(r.ordem, r.linha, r.chave) for r in export.read(spark, path, "B2").collect()][5:] == [(3, ",,", None), (3, ",2021-03-04,é,\n", 7), (3, ",2021-03-04,é,\n", 7)]
    assert sorted(map(str, export.read(spark, path).collect())) == sorted(map(str, rows.collect()))


def test_a_hot_supplier_spans_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = export.lines(make(spark, 20_000))
    assert "collect_list" not in rows._jdf.queryExecution().toString()
    export.write(rows, path, 8)
    ranges, sizes = [], []
    for f in sorted((tmp_path / "out").glob("*.parquet")):
        t = pq.read_table(f).to_pylist()
        keys = [(r["cnpj"], r["ordem"], r["linha"], -1 if r["chave"] is None else r["chave"]) for r in t]
        assert keys == sorted(keys)
        ranges.append((keys[0], keys[-1]))
        sizes.append(len(keys))
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:])), "files follow each other"
    assert sum(sizes) == rows.count() and max(sizes) < sum(sizes) / 4, "equal lines of one supplier are split"
    assert sum(b[0] == "B2" or a[0] == "B2" for a, b in ranges) <= 2
    assert export.read(spark, path, "B2").count() == 8


def test_no_rows(spark, tmp_path):
    t = make(spark)
    none = SimpleNamespace(**{k: v.limit(0) for k, v in vars(t).items()})
    export.write(export.lines(none), str(tmp_path / "none"), 4)
    assert export.read(spark, str(tmp_path / "none")).count() == 0
    some = SimpleNamespace(**{**vars(none), "suppliers": t.suppliers})
    assert export.lines(some).groupBy("cnpj", "ordem").count().count() == 2
