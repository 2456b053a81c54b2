import datetime as dt
import json

import pytest

from sentinela import publish, sources, streaming
from sentinela.plans import run


def put(path, text, encoding="latin1"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def staging(spark, tmp):
    files = {
        "empresas": sources.companies(spark, put(tmp / "e.csv", '12345678;"ACME ""SA""";2062;49;1000,00;01;\n99;BETA;2062;49;NULL;01;\n99;BETA 2;2062;49;1;01;x;extra\n')),
        "qsa": sources.partners(spark, put(tmp / "q.csv", "12345678;2;ana silva ;***222333**;49;20200115;;;;;\n00000099;2;ANA SILVA;***222333**;49;2020;;;;;\n;2;X;;;;;;;;\n")),
        "sancoes": sources.sanctions(spark, put(tmp / "s.csv", '"CPF OU CNPJ DO SANCIONADO";"RAZÃO SOCIAL - CADASTRO RECEITA";"NOME DO SANCIONADO";"DATA INÍCIO SANÇÃO";"DATA FINAL SANÇÃO"\n12.345.678/0001-00;;Acme;01/02/2020;\n'), "CEIS"),
        "servidores": sources.servants(spark, put(tmp / "v.csv", "NOME;CPF;CARGO_DESCRICAO;ORGAO_LOTACAO\nAna Silva;***.222.333-**;Analista;MEC\n")),
        "doacoes": sources.donations(spark, [put(tmp / "d.csv", "AA_ELEICAO;NR_CPF_CNPJ_DOADOR;VR_RECEITA;DT_RECEITA\n2022;12345678000100;25000,00;01/09/2022\n2022;12345678901;-1;x\n"), "x_brasil.csv"]),
        "contratos": sources.contracts_json(spark, put(tmp / "c.json", json.dumps({"data": [{"numeroContratoEmpenho": f"L{i}", "niFornecedor": "12.345.678/0001-00", "valorInicial": 300000.5, "dataAssinatura": "2021-03-04", "dataVigenciaFim": "", "dataVigencia": "2022-01-01", "categoriaProcesso": {"id": 8, "nome": "Obras"}} for i in (1, 1, 2)]}), "utf8")),
        "rais": sources.headcount(spark, put(tmp / "r.csv", "CNPJ_BASICO;QTD_VINC_ATIVOS;PORTE\n12345678;0;MICRO\n12345678;-3;X\n;5;Y\n")),
        "comprasnet": sources.comprasnet(spark, put(tmp / "k.csv", "fonecedor_cnpj_cpf_idgener,licitacao_numero,vigencia_fim,valor_global,data_assinatura\n12345678000100,L9,2022-01-01,10.5,2021-01-01\n", "utf8")),
        "qsa_diffs": sources.ownership_diffs(spark, put(tmp / "j.csv", "CNPJ_BASICO;NOME_SOCIO;DATA_ENTRADA;DATA_SAIDA\n99;bia;20200101;20210101\n")),
    }
    return {k: sources.SOURCES[k][1](v) for k, v in files.items()}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return staging(spark, tmp_path_factory.mktemp("raw"))


def test_parse_and_validate(tables):
    e = {r.cnpj_basico: r for r in tables["empresas"].collect()}
    assert e["12345678"].razao_social == 'ACME "SA"' and str(e["12345678"].capital_social) == "1000.00" and e["12345678"].cnpj == "12.345.678/0001-00"
    assert e["00000099"].capital_social is None and sorted(r.pk_fornecedor for r in e.values()) == [1, 2]
    q = tables["qsa"].collect()
    assert len(q) == 2 and q[0].nome_socio == "ANA SILVA" and {r.data_entrada for r in q} == {dt.date(2020, 1, 15), None}
    assert tables["sancoes"].first().razao_social == "Acme" and tables["doacoes"].count() == 1
    c = tables["contratos"].collect()
    assert len(c) == 2 and c[0].cnpj_fornecedor == "12345678000100" and c[0].data_vigencia == dt.date(2022, 1, 1) and c[0].modalidade_codigo == "8"
    assert [(r.qtd_funcionarios, r.porte_empresa) for r in tables["rais"].collect()] == [(0, "MICRO")]


def test_run_and_publish(spark, tables, tmp_path):
    assert publish.check_complete(tables) == []
    out = run.build(tables, "2024-02-01", "salt")
    version = publish.publish(spark, out, str(tmp_path / "w"))
    counts = {r.tabela: r.n for r in publish.table_counts(spark, str(tmp_path / "w"), list(out)).collect()}
    assert counts["dim_fornecedor"] == 2 and counts["fato_contrato"] == 3 and counts["fato_alerta_critico"] > 0
    kinds = {r.tipo_alerta for r in out["fato_alerta_critico"].collect()}
    assert {"SOCIO_SERVIDOR_PUBLICO", "EMPRESA_SANCIONADA_CONTRATANDO", "DOACAO_PARA_CONTRATANTE"} <= kinds
    with pytest.raises(Exception):
        publish.publish(spark, {"a": out["dim_sancao"], "b": out["dim_sancao"].selectExpr("raise_error('x') as x")}, str(tmp_path / "w"))
    assert publish.current(spark, str(tmp_path / "w")).endswith(version)


def test_a_failed_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    out, df = str(tmp_path / "w"), spark.range(2)
    first = publish.publish(spark, {"a": df}, out)
    point = publish._point

    def broken(spark, out, version):
        raise OSError("no rename")

    monkeypatch.setattr(publish, "_point", broken)
    with pytest.raises(OSError):
        publish.publish(spark, {"a": df}, out)
    assert publish.current(spark, out).endswith(first) and len(list((tmp_path / "w").glob("v-*"))) == 1
    monkeypatch.setattr(publish, "_point", point)
    second = publish.publish(spark, {"a": df.limit(1)}, out)
    assert publish.current(spark, out).endswith(second) and not list((tmp_path / "w").glob("_POINTER*"))
    assert publish.table_counts(spark, out, ["a"]).first().n == 1


def test_gate(tables):
    with pytest.raises(publish.Incomplete) as e:
        publish.check_complete({**tables, "qsa": tables["qsa"].limit(0), "doacoes": None})
    assert e.value.missing == ["qsa", "doacoes"]


def test_windows_and_stream(spark, tmp_path):
    assert sources.contracts_parquet(spark, str(tmp_path)).count() == 0
    row = spark.createDataFrame([("L", "1")], "num_licitacao string, cnpj_fornecedor string").selectExpr("num_licitacao", "cnpj_fornecedor", *[f"cast(null as string) {c}" for c in ("codigo_orgao", "nome_orgao", "poder_orgao", "esfera_orgao", "modalidade_nome", "modalidade_codigo")], "cast(5 as decimal(18,2)) valor", "'x' objeto", "date'2020-01-01' data_assinatura", "date'2020-01-01' data_vigencia")
    row.write.parquet(str(tmp_path / "in" / "window_1.parquet"))
    assert sources.contracts_parquet(spark, str(tmp_path / "in")).count() == 1
    for _ in range(2):
        streaming.take_in_contracts(spark, str(tmp_path / "in" / "window_1.parquet"), str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
