"""Contracts are joined and grouped once for all indicators, and not at all for tables that are not made of them."""

from pyspark.sql import functions as F

from sentinela import star_queries
from sentinela.operators import core, score
from sentinela.plans.driver_map import Domain

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def sent(plan) -> list[int]:
    """Rows that each exchange of an executed plan has written, from the top."""
    name, below = plan.nodeName(), []
    if name == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif "QueryStage" in name:
        below = [plan.plan()]
    else:
        children = plan.children()
        below = [children.apply(i) for i in range(children.size())]
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
    return own + [x for p in below for x in sent(p)]


def test_indicators_need_the_yearly_aggregation_only(spark):
    d = Domain(spark, SF)
    by_year = core.yearly(d.contracts).cache()
    per = core.per_supplier(by_year)
    assert per.schema["total"].dataType == core.per_supplier(d.contracts).schema["total"].dataType
    assert rows(per) == rows(core.per_supplier(d.contracts).select(per.columns))
    got = score.all_indicators(d.suppliers, d.partners, None, d.sanctions, d.ref_date, yearly=by_year, per=per)
    assert rows(got) == rows(score.all_indicators(d.suppliers, d.partners, d.contracts, d.sanctions, d.ref_date))


def test_online_indicators_need_one_aggregation_only(spark):
    d = Domain(spark, SF)
    by_year = core.yearly(d.contracts, online=True).cache()
    got = score.all_indicators(d.suppliers, d.partners, None, d.sanctions, d.ref_date, "online", yearly=by_year, per=core.per_supplier(by_year))
    assert rows(got) == rows(score.all_indicators(d.suppliers, d.partners, d.contracts, d.sanctions, d.ref_date, "online"))
    assert rows(d.scores_online) == rows(got)
    assert "_yearly_online" in d.__dict__ and "_yearly" not in d.__dict__


def test_groups_of_a_supplier_meet_before_their_sums_are_sent(spark):
    """Every task reads contracts of all suppliers; without dealing each would send a sum for each group."""
    groups, tasks = 500, 8
    contracts = spark.range(0, groups * tasks, 1, tasks).select(
        (F.col("id") % groups).alias("fk_fornecedor"), F.lit(1).alias("fk_orgao"), F.lit(2).cast("decimal(18,2)").alias("valor"), F.lit("2020-01-02").cast("date").alias("data_assinatura"), F.lit("SAUDE").alias("objeto_categoria")
    )
    by_year = core.yearly(contracts)
    assert by_year.agg(F.count("*"), F.min("n_contratos"), F.max("total")).first()[:] == (groups, tasks, 2 * tasks)
    by_year.collect()
    assert sent(by_year._jdf.queryExecution().executedPlan()) == [groups, groups * tasks]


def test_one_supplier_with_nearly_all_contracts(spark):
    contracts = spark.range(20_000).select(F.when(F.col("id") < 19_990, 7).otherwise(F.col("id")).alias("fk_fornecedor"), F.col("id").alias("fk_orgao"), F.lit(None).cast("date").alias("data_assinatura"), F.lit(None).cast("string").alias("objeto_categoria"))
    got = {r.fk_fornecedor: r for r in core.yearly(contracts).collect()}
    assert len(got) == 11 and got[7].n_contratos == got[7].n_known_buyers == 19_990 and (got[7].buyer_least, got[7].buyer_most) == (0, 19_989)


def test_partners_are_loaded_without_contracts(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("contracts are numbered")

    monkeypatch.setattr(core, "number_rows", fail)
    tables = star_queries.star(Domain(spark, SF), ["dim_fornecedor", "dim_socio", "bridge_fornecedor_socio"])
    assert tables["bridge_fornecedor_socio"].count() == tables["dim_socio"].count() > 0
