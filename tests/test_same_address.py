"""All pairs of an address: the same pairs whatever the blocks, and not all in one task."""

from pyspark.sql import functions as F

from sentinela.operators import core


def suppliers(spark, counts):
    rows = [(f"{a}-{i:06d}", f"Rua {a}, 7" if a != "none" else "Rua sem numero") for a, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "cnpj string, logradouro string")


def test_pairs_are_those_of_brute_force(spark):
    counts = {"A": 7, "B": 2, "C": 1, "none": 3}
    want = {(f"{a}-{i:06d}", f"{a}-{j:06d}", f"RUA {a}|7") for a, n in counts.items() if a != "none" for i in range(n) for j in range(i + 1, n)}
    for block in (1, 2, 3, 1000):
        got = [tuple(r) for r in core.same_address(suppliers(spark, counts).union(suppliers(spark, {"B": 1})), block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert core.same_address(suppliers(spark, {"C": 1, "none": 3})).collect() == []


def test_one_address_is_met_in_several_tasks(spark):
    per = core.same_address(suppliers(spark, {"A": 3500})).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in per) == 3500 * 3499 // 2 and max(r.n for r in per) <= 0.6 * sum(r.n for r in per)
