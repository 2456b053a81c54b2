import datetime as dt
import json

import pyarrow.parquet as pq
import pytest

from sentinela import sources
from sentinela.sources import windows

START = dt.date(2024, 1, 1)


def deliver(root, day, *pages):
    folder = root / f"mes={day:%Y-%m}"
    folder.mkdir(parents=True, exist_ok=True)
    lines = [f"{day.isoformat()}\t{p if isinstance(p, str) else json.dumps(p)}" for p in pages]
    (folder / f"{day.day}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")


def record(n, day, value="10.5"):
    return {"numeroContratoEmpenho": n, "niFornecedor": "12.345.678/0001-00", "valorInicial": value, "dataAssinatura": day.isoformat(), "objetoContrato": 'ção "x", [y] {z}'}


@pytest.fixture
def archive(tmp_path):
    root = tmp_path / "archive"
    for i in range(0, 130, 3):
        day = START + dt.timedelta(days=i)
        deliver(root, day, {"data": [record(f"A{i}", day), None], "totalPaginas": 2}, [record(f"B{i}", day, "1")])
    return root


def names(df):
    return sorted(r.num_licitacao for r in df.select("num_licitacao").collect())


def expected(last, first=0):
    return sorted(f"{k}{i}" for i in range(0, 130, 3) if first <= i <= last for k in "AB")


def test_windows_cover_each_day_once():
    for days in (1, 30, 31, 32, 62, 100):
        end = START + dt.timedelta(days=days - 1)
        found = windows.windows(START, end)
        assert [a + dt.timedelta(days=i) for a, b in found for i in range((b - a).days + 1)] == [START + dt.timedelta(days=i) for i in range(days)]
        assert len(windows.closed(START, end)) == days // 31
    assert windows.windows(START, START - dt.timedelta(days=1)) == []


def test_reads_every_page(spark, archive):
    end = START + dt.timedelta(days=129)
    found = windows.pages(spark, f"file://{archive}", START, end)
    assert found.rdd.getNumPartitions() == 5
    assert names(windows.contracts(found)) == expected(129)
    r = windows.contracts(found).filter("num_licitacao = 'A0'").first()
    assert (str(r.valor), r.data_assinatura, r.cnpj_fornecedor, r.objeto) == ("10.50", START, "12345678000100", 'ção "x", [y] {z}')


@pytest.mark.parametrize("first, last, parts", [(31, 39, 1), (30, 31, 2), (3, 3, 1), (62, 129, 3), (0, 1, 1), (-50, -1, 1), (129, 400, 1), (40, 31, 1)])
def test_days_choose_windows(spark, archive, first, last, parts):
    a, b = (START + dt.timedelta(days=i) for i in (first, last))
    found = windows.pages(spark, str(archive), START, START + dt.timedelta(days=129), a, b)
    assert names(windows.contracts(found)) == expected(last, first)
    assert found.rdd.getNumPartitions() == parts
    assert {r.janela for r in found.collect()} <= {x for x, _ in windows.windows(START, START + dt.timedelta(days=129))}


def test_a_condition_does_not_outlive_its_plan(spark, archive):
    found = windows.pages(spark, str(archive), START, START + dt.timedelta(days=129))
    assert found.filter("dia < '2024-01-03'").count() == 2
    assert found.count() == 88


def test_only_days_asked_for_are_opened(spark, archive):
    end = START + dt.timedelta(days=129)
    deliver(archive, START + dt.timedelta(days=1), "no JSON at all")
    assert names(windows.contracts(windows.pages(spark, str(archive), START, end, START + dt.timedelta(days=2)))) == expected(129, 2)
    with pytest.raises(Exception, match="(?i)malformed"):
        windows.contracts(windows.pages(spark, str(archive), START, end)).collect()


def test_finished_windows_are_not_read_again(spark, archive, tmp_path):
    out, end = str(tmp_path / "out"), START + dt.timedelta(days=129)
    assert windows.ingest(spark, str(archive), out, START, START + dt.timedelta(days=40)) == ["2024-01-01"]
    assert names(sources.contracts_parquet(spark, out)) == expected(30)
    before = pq.read_table(f"{out}/window_2024-01-01.parquet")
    deliver(archive, START, "no JSON at all")  # would fail if the first window were read again
    assert windows.ingest(spark, str(archive), out, START, end) == ["2024-02-01", "2024-03-03", "2024-04-03"]
    assert names(sources.contracts_parquet(spark, out)) == expected(123)  # the last window has not ended
    assert pq.read_table(f"{out}/window_2024-01-01.parquet").equals(before)
    assert windows.ingest(spark, str(archive), out, START, end) == []


def test_a_broken_run_keeps_whole_windows_only(spark, archive, tmp_path):
    out, end, bad = tmp_path / "out", START + dt.timedelta(days=129), START + dt.timedelta(days=64)
    kept = [record(f"C{i}", bad) for i in range(3)]
    deliver(archive, bad, kept, "no JSON at all")
    with pytest.raises(Exception):
        windows.ingest(spark, str(archive), str(out), START, end)
    left = windows.finished(str(out)) if out.exists() else set()
    assert "2024-03-03" not in left
    deliver(archive, bad, kept)
    assert set(windows.ingest(spark, str(archive), str(out), START, end)) == {"2024-01-01", "2024-02-01", "2024-03-03", "2024-04-03"} - left
    assert names(sources.contracts_parquet(spark, str(out))) == sorted(expected(123) + ["C0", "C1", "C2"])
    assert not [f for f in out.iterdir() if f.name.startswith(".2024")]


def test_rows_of_a_window_in_two_tasks_are_an_error(spark, archive, tmp_path):
    out = str(tmp_path / "out")
    spark.dataSource.register(windows.WindowSink)
    rows = windows.contracts(windows.pages(spark, str(archive), START, START + dt.timedelta(days=30))).drop("dia")
    with pytest.raises(Exception, match="several tasks"):
        rows.repartition(3).write.format("contract_windows").mode("append").option("path", out).save()
    assert windows.finished(out) == set()


def test_empty_archive(spark, tmp_path):
    assert windows.pages(spark, str(tmp_path / "none"), START, START).count() == 0
    assert windows.pages(spark, str(tmp_path / "none"), START, START - dt.timedelta(days=1)).count() == 0
    assert windows.ingest(spark, str(tmp_path / "none"), str(tmp_path / "out"), START, START + dt.timedelta(days=31)) == ["2024-01-01"]
    assert sources.contracts_parquet(spark, str(tmp_path / "out")).count() == 0
