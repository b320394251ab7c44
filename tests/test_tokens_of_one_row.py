"""Token statistics of keys of one and of several rows."""

from collections import Counter
from math import log2

from pyspark.sql import functions as F

from stagesignal.operators import texts
from stagesignal.plans import texts as plans


def _generated(plan):
    """Rows that the plan's explode made."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _generated(plan.executedPlan())
    if "QueryStage" in name:
        return _generated(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if name.startswith("Generate") else 0
    return own + sum(_generated(plan.children().apply(k)) for k in range(plan.children().size()))


def test_statistics_of_single_and_repeated_keys(spark):
    rows = [(1, list("abacab")), (2, ["x"]), (3, []), (4, None), (5, ["a", None, "a", None, None, "b"]), (6, ["a", "b"]), (6, ["b", "b", None]), (6, []), (7, []), (7, None), (None, ["a", "a", "b"])]
    want = {}
    for key in {k for k, _ in rows}:
        n = Counter(t for k, ts in rows if k == key for t in ts or ())
        m = sum(n.values())
        if m:
            want[key] = (round(-sum(c / m * log2(c / m) for c in n.values()), 6) + 0.0, round(len(n) / m, 6), m)
    df = spark.createDataFrame(rows, "k long, t array<string>")
    for toks in (F.col("t"), F.transform("t", lambda t: F.ascii(t))):
        assert {r["k"]: (round(r["entropy"], 6) + 0.0, round(r["ttr"], 6), r["tokens"]) for r in texts.token_statistics(df, ["k"], toks).collect()} == want


def test_a_key_of_one_row_is_counted_within_the_row(spark):
    out = texts.token_statistics(spark.createDataFrame([(k, list("abcdeabc")) for k in range(20)], "k long, t array<string>"), ["k"], F.col("t"))
    assert len(out.collect()) == 20 and _generated(out._jdf.queryExecution().executedPlan()) == 20


def test_only_the_counted_text_is_grouped(spark):
    rows, d = plans.views.view(spark, "/root/testdata/sf0.001", plans._BRIEFS), "/root/testdata/sf0.001"
    full = plans.views.view(spark, d, plans.FOUR)
    want = full.selectExpr("r", "b", "s is not null and w is not null as ok")
    assert rows.selectExpr("r", "b", "s and w as ok").exceptAll(want).isEmpty() and rows.count() == want.count() > 0
