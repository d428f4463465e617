"""The sweep does per line and condition only what depends on both."""

from corpusbench.operators import sweep as S
from corpusbench.plans.metric_queries import STRENGTH, sweep

SF = "/root/testdata/sf0.001"


def test_conditions_bring_their_constants(spark):
    rows = S.with_conditions(spark.range(2), ["a", "b"], strength={"a": 0.0, "b": 0.5}, tag={"a": "x", "b": "y"})
    assert sorted(map(tuple, rows.collect())) == [(i, c, s, t) for i in (0, 1) for c, s, t in (("a", 0.0, "x"), ("b", 0.5, "y"))]


def test_nothing_is_looked_up_or_rounded_as_a_decimal_per_condition(spark):
    plan = sweep(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lowered = plan[:plan.index("Generate")]
    assert "md5(" in lowered and "element_at" not in lowered and "round(" not in lowered


def test_scores_have_two_places(spark):
    rows = sweep(spark, SF)
    assert rows.where("prob < 0 or prob <> round(prob, 2)").isEmpty()
    assert {r[0] for r in rows.select("condition").distinct().collect()} == set(STRENGTH)
