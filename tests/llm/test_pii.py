"""Surrogates: plans stay as small as they are written."""

from sentinela.llm import pii


def test_patterns_are_not_multiplied_by_the_optimizer(spark, monkeypatch):
    """The scan for entities has its long patterns as often as they are written, not once for each use of what they find."""
    plans, write = {}, pii.C.materialise

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(pii.C, "materialise", seen)
    docs = spark.createDataFrame([(1, "Mary Smith, mail a@b.com"), (2, "x@y.com"), (3, "none"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    assert plans["entities"].count(pii.PATTERN) <= 6
    assert [got[i]._n_entities for i in (1, 2, 3, 4)] == [3, 1, 0, 0] and got[4].text is None
