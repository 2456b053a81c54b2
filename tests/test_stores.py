"""Partial totals, postings and pages: against brute force, and what they read."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentinela import layout, merge, pages, partials, postings, publish
from sentinela.operators import core


def deals(spark, rows):
    return spark.createDataFrame(rows, "pk_contrato long, fk_orgao long, fk_fornecedor long, data_assinatura date, valor decimal(18,2), objeto string")


def some_deals(seed, n=400):
    r = random.Random(seed)
    day = lambda: None if r.random() < 0.05 else dt.date(2020 + r.randrange(2), 1 + r.randrange(12), 1 + r.randrange(28))
    key = lambda: None if r.random() < 0.05 else r.choice([0, 1, 32768, 32769, 70_000, r.randrange(100_000)])
    money = lambda: None if r.random() < 0.05 else r.randrange(1000)
    return [(i, r.choice([1, 1, 1, 2, 3, None]), key(), day(), money(), "x") for i in range(n)]


def brute_totals(rows, orgao, first=None, last=None):
    month = lambda d: d and f"{d:%Y-%m}"
    own = [r for r in rows if r[1] == orgao and (not first or (r[3] and month(r[3]) >= first)) and (not last or (r[3] and month(r[3]) <= last))]
    return len(own), sum(r[4] or 0 for r in own), len({r[2] for r in own if r[2] is not None})


def test_partials(spark, tmp_path):
    from decimal import Decimal

    one, two = [[(*r[:4], None if r[4] is None else Decimal(r[4]), r[5]) for r in some_deals(s)] for s in (1, 2)]
    path = str(tmp_path / "p")
    partials.add(deals(spark, one), path, "one")
    stored = {f: f.stat().st_mtime_ns for f in (tmp_path / "p").rglob("*.parquet")}
    partials.add(deals(spark, two), path, "two")
    assert all(f.stat().st_mtime_ns == t for f, t in stored.items())  # nothing stored was touched
    agencies = spark.createDataFrame([(i, f"O{i}", "n") for i in (1, 2, 3, 4)], "pk_orgao long, codigo string, nome string")
    for span in ((), ("2020-06", "2021-03"), ("2021-01",), (None, "2020-02")):
        got = {r.codigo: (r.qtd_contratos, r.total_contratado, r.qtd_fornecedores) for r in partials.summary(partials.totals(spark, path, *span), agencies).collect()}
        assert got == {f"O{i}": brute_totals(one + two, i, *span) for i in (1, 2, 3, 4)}
    partials.add(deals(spark, two), path, "two")  # a lot again
    assert {r.fk_orgao: r.qtd_contratos for r in partials.totals(spark, path).collect()}[1] == brute_totals(one + two, 1)[0]
    partials.add(deals(spark, []), str(tmp_path / "none"), "x")


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    partials.add(deals(spark, [(i, 1, i, dt.date(2020, 1 + i % 12, 1), None, "x") for i in range(240)]), path, "a")
    assert layout.scanned_rows(partials.totals(spark, path, "2020-03", "2020-04")) == 2


def test_search(spark, tmp_path):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcÁé%_ 1") for _ in range(r.randrange(9)))
    rows = [(i, None if i % 41 == 0 else word().upper(), word()) for i in range(600)]
    df = spark.createDataFrame(rows, "pk long, nome string, doc string")
    path = str(tmp_path / "s")
    postings.build(df, "pk", ["nome", "doc"], path, per_file=300)
    texts = ["abc", "ABCÁ", "áé", "%_", "a%b", "", "zzz", "1_1a", "éab", "bc a"] + [x[2] for x in rows[:25]]
    for t in texts:
        want = sorted(k for k, n, d in rows if (n is not None and t.lower() in n.lower()) or t in d)
        assert sorted(x.pk for x in postings.search(df, "pk", {"nome": True, "doc": False}, path, t).collect()) == want, t


def test_search_reads_its_trigrams(spark, tmp_path):
    df = spark.range(20_000).select(F.col("id").alias("pk"), F.concat(F.lit("SUPPLIER "), F.substring(F.md5(F.col("id").cast("string")), 1, 8)).alias("nome"))
    path = str(tmp_path / "s")
    postings.build(df, "pk", ["nome"], path, per_file=10_000)
    every = spark.read.parquet(f"{path}/postings").count()
    text = df.first().nome[9:15]
    found = postings.candidates(spark, path, "nome", text)
    assert 1 <= found.count() < 20 and layout.scanned_rows(found) < every / 4


def test_empty_postings(spark, tmp_path):
    df = spark.createDataFrame([], "pk long, nome string")
    postings.build(df, "pk", ["nome"], str(tmp_path / "s"))
    assert postings.search(df, "pk", {"nome": True}, str(tmp_path / "s"), "abc").count() == 0


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_pages(spark, tmp_path, size):
    r = random.Random(2)
    rows = [(i, r.randrange(20), r.choice("abc")) for i in range(1000)]
    df, order, path = spark.createDataFrame(rows, "pk long, score int, nome string"), [("score", True), ("nome", False), ("pk", True)], str(tmp_path / "p")
    pages.write(df, path, order, rows=90)
    want = sorted(rows, key=lambda x: (-x[1], x[2], -x[0]))
    for number in (0, 1, 3, 999 // size, 1000 // size + 1):
        assert list(map(tuple, pages.page(spark, path, number, size).collect())) == want[number * size : (number + 1) * size]
    for at in (0, 5, 89, 500, 998, 999):
        key = (want[at][1], want[at][2], want[at][0])
        assert list(map(tuple, pages.after(spark, path, order, key, size).collect())) == want[at + 1 : at + 1 + size]


def test_page_reads_its_files(spark, tmp_path):
    df, order, path = spark.range(10_000).withColumnRenamed("id", "pk"), [("pk", False)], str(tmp_path / "p")
    pages.write(df, path, order, rows=1000)
    assert layout.scanned_rows(pages.page(spark, path, 50, 100)) <= 2500
    assert layout.scanned_rows(pages.after(spark, path, order, (7000,), 100)) <= 2500


def test_empty_pages(spark, tmp_path):
    df = spark.createDataFrame([], "pk long, nome string")
    pages.write(df, str(tmp_path / "p"), [("pk", False)])
    assert pages.page(spark, str(tmp_path / "p"), 0, 5).count() == 0 and pages.after(spark, str(tmp_path / "p"), [("pk", False)], (1,), 5).count() == 0


def numbers(spark, rows):
    return spark.createDataFrame(rows, "k long, s string, v int")


def some_numbers(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, *range(60)]), r.choice([None, "a", "b"]), r.randrange(1000)) for _ in range(n)]


@pytest.mark.parametrize("newest", [False, True])
def test_merge_equals_whole_merge(spark, tmp_path, newest):
    out, frames = str(tmp_path / "t"), [numbers(spark, some_numbers(s, n)) for s, n in ((1, 150), (2, 80), (3, 2), (4, 0))]
    for f in frames:
        merge.merge(f, out, ["k", "s"], ["v"], newest, buckets=8, files=2)
    want = core.merge_first(frames[::-1] if newest else frames, ["k", "s"], ["v"])
    assert sorted(map(str, merge.read(spark, out).collect())) == sorted(map(str, want.collect()))


def test_merge_writes_touched_buckets_only(spark, tmp_path):
    out = str(tmp_path / "t")
    merge.merge(numbers(spark, [(i, "a", i) for i in range(500)]), out, ["k", "s"], ["v"], buckets=16)
    before = merge.read(spark, out)
    stored = {f: f.stat().st_mtime_ns for f in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert len(merge.merge(numbers(spark, [(900, "a", 1), (7, "a", -1)]), out, ["k", "s"], ["v"], newest=True)) <= 2
    added = [f for f in (tmp_path / "t" / "data").rglob("*.parquet") if f not in stored]
    assert 1 <= len(added) <= 2 and all(f.stat().st_mtime_ns == t for f, t in stored.items())
    assert before.count() == 500 and before.filter("k = 7").first().v == 7  # its readers still have the old version
    now = merge.read(spark, out)
    assert now.count() == 501 and now.filter("k = 7").first().v == -1
    merge.retire(spark, out)
    assert merge.read(spark, out).count() == 501 and len(list((tmp_path / "t" / "data").rglob("*.parquet"))) <= 16
    assert len(list((tmp_path / "t").glob("v-*"))) == 1


def test_merge_columns_and_errors(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "t")
    merge.merge(numbers(spark, []), out, ["k"], ["v"], buckets=4)
    assert merge.read(spark, out).count() == 0
    merge.merge(numbers(spark, [(1, "a", 1)]), out, ["k"], ["v"])
    merge.merge(spark.createDataFrame([(2, "new")], "k long, more string"), out, ["k"], ["k"])
    assert sorted(map(tuple, merge.read(spark, out).collect())) == [(1, "a", 1, None), (2, None, None, "new")]
    with pytest.raises(ValueError, match="v"):
        merge.merge(spark.createDataFrame([(3, "x")], "k long, v string"), out, ["k"], ["k"])
    monkeypatch.setattr(publish, "_point", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        merge.merge(numbers(spark, [(1, "b", 0), (4, "b", 0)]), out, ["k"], ["v"], newest=True)
    assert merge.read(spark, out).count() == 2 and merge.read(spark, out).filter("k = 1").first().s == "a"


def test_rows_of_pages_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(500).mapInArrow(count, "id long")
    pages.write(rows, str(tmp_path / "p"), [("id", True)], rows=60)
    assert seen.value == 500
    assert [r.id for r in pages.page(spark, str(tmp_path / "p"), 2, 50).collect()] == list(range(399, 349, -1))
