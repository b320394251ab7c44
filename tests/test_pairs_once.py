"""Paired rows are joined once; counts and resamples read their sums."""

from stagesignal.operators import pairing


def test_paired_methods_read_sums(spark):
    rows = [(f"r{k}", s, k % 2, k % 3, (k * 7 + len(s)) % 5 > 1) for k in range(40) for s in ("plan", "write")]
    left = spark.createDataFrame(rows, "run_id string, stage string, seed long, taskid long, correct boolean")
    right = left.selectExpr("run_id", "stage", "CASE WHEN taskid < 2 THEN NOT correct END AS correct")
    out = pairing.paired_methods(left, {"other": right}, reps=50)
    assert "run_id" not in str(out._jdf.queryExecution().executedPlan().toString())
    got = {(r["scope"], r["stage"]): r for r in out.collect()}
    assert set(got) == {(c, s) for c in ("seed0", "seed1", "all") for s in ("plan", "write")}
    for (scope, stage), r in got.items():
        own = [x for x in rows if x[1] == stage and scope in (f"seed{x[2]}", "all")]
        known = [x for x in own if x[3] < 2]
        assert (r["n"], r["left_correct"], r["left_only"], r["right_only"], r["both"]) == (len(own), sum(x[4] for x in own), sum(x[4] for x in known), sum(not x[4] for x in known), 0)
        assert r["ci_low"] <= r["ci_high"]


def test_comparability_joins_once(spark):
    row = lambda run, stage, gt, c, o: (run, stage, gt, c, o)
    schema = "run_id string, stage string, gt_userid string, candidate_userids array<string>, shuffled_order array<string>"
    left = spark.createDataFrame([row("r1", "plan", "a", ["a", "b"], ["a", "b"]), row("r1", "write", "a", ["a", "b"], ["a", "b"]), row("r2", "plan", "a", ["a"], ["a"]), row("r3", "plan", "a", ["a"], ["a"])], schema)
    right = spark.createDataFrame([row("r1", "plan", "a", ["b", "a"], ["a", "b"]), row("r1", "write", "b", ["a"], ["b", "a"]), row("r2", "plan", "a", ["a"], ["a"]), row("r4", "write", "a", ["a"], ["a"])], schema)
    out = pairing.comparability(left, right)
    assert str(out._jdf.queryExecution().executedPlan().toString()).count("Join") == 1
    got = {r["scope"]: tuple(r)[1:] for r in out.collect()}
    assert got == {"plan": (1, 0, 2, 0, 2, 2, None, None, False), "write": (0, 1, 1, 1, 0, 0, None, None, False), "all": (1, 1, 3, 1, 2, 2, 4, 1, False)}
