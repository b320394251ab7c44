"""Members of candidate sets travel once."""

import random

from pyspark.sql import functions as F

from stagesignal.operators import candidates

SCHEMA = "set_id string, gt_userid string, userid string, tokens array<string>"


def _rows():
    draw = random.Random(6)
    tokens = lambda: sorted(draw.sample("abcdefgh", draw.choice([0, 1, 3, 5])))
    rows = [(f"s{s}", f"U{s}", f"U{s + k}", tokens()) for s in range(30) for k in range(draw.choice([1, 2, 3, 5]))]
    return [*rows, ("x", "U1", "U1", None), ("x", "U1", "U2", ["a"]), ("x", "U1", None, ["a"]), ("y", "U1", "U1", ["a", "b"]), ("y", "U1", "U1", ["b"]), ("y", "U1", "U2", ["b"]), (None, "U1", "U1", ["a"]), (None, "U1", "U2", ["a"])]


def _wanted(rows):
    sets = {}
    for s, gt, u, t in rows:
        if s is not None and u is not None:
            sets.setdefault((s, gt), []).append((u, t))
    for (s, gt), members in sets.items():
        near = lambda x, y: 0.0 if x is None or y is None or not (x or y) else len(set(x) & set(y)) / (len(x) + len(y) - len(set(x) & set(y)))
        found = {}
        for u, t in members:
            found.setdefault(u, []).extend(near(t, t2) for v, t2 in members if v != u)
        ranked = sorted(((-round(sum(js) / len(js), 6), u) for u, js in found.items() if js))
        if ranked:
            yield s, gt, ranked[0][1], -ranked[0][0], round(ranked[1][0] - ranked[0][0], 6) if len(ranked) > 1 else None, ranked[0][1] == gt


def test_centrality_is_that_of_all_pairs(spark):
    rows = _rows()
    want = sorted(_wanted(rows), key=str)
    assert len(want) > 15
    df = spark.createDataFrame(rows, SCHEMA)
    for given in (df, df.withColumn("tokens", F.transform("tokens", lambda t: F.xxhash64(t)))):
        assert sorted(map(tuple, candidates.centrality_prior(given).collect()), key=str) == want


def test_members_are_not_joined_with_themselves(spark):
    plan = candidates.centrality_prior(spark.createDataFrame(_rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
