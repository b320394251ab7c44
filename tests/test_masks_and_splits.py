"""Nested artifacts masked and put together again, projected profiles, baseline texts, disjoint samples."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from stagesignal.operators import candidates, profiles, texts

SOURCE = "struct<query: string, title: string, link: string, snippet: string>"
ARTIFACT = (f"run_id string, research_brief string, search_trace array<struct<topic_id: string, query: string, sources: array<{SOURCE}>, results: array<struct<title: string, snippet: string>>>>, "
            "compressed_research array<struct<topic_id: string, topic_text: string, compressed_research: string, summary: string>>, final_report string, other map<string, string>")


def artifact(run, name):
    source = (f"about {name}", f"{name} at home", f"https://{name}.example/", "nothing")
    return (run, f"A brief for {name}.", [("t1", f"what does {name} like", [source, None], [(f"{name}", None)]), ("t2", None, [], None)], [("t1", "x", f"{name} likes tea", None), ("t2", "y", None, f"summary of {name.upper()}")], None, {"k": name})


def test_nested_artifacts_are_masked_everywhere_and_put_together(spark):
    df = spark.createDataFrame([artifact("r1", "Ann Lee"), artifact("r2", "Bo Rye"), artifact("r3", "Cy")], ARTIFACT)
    sets = spark.createDataFrame([("r1", "s1"), ("r2", "s2"), ("r3", "none")], "run_id string, set_id string")
    phrases = spark.createDataFrame([("s1", ["Ann Lee", "tea"]), ("s2", ["Bo Rye"])], "set_id string, phrases array<string>")
    masked, audit = texts.mask_artifacts(df, sets, phrases)
    got = {r["run_id"]: r.asDict(True) for r in masked.collect()}
    assert got["r3"] == {r["run_id"]: r.asDict(True) for r in df.collect()}["r3"] and masked.schema.names == df.schema.names
    one = got["r1"]
    assert one["research_brief"] == "A brief for [MASKED]." and one["final_report"] is None and one["other"] == {"k": "Ann Lee"}
    first = one["search_trace"][0]
    assert first["query"] == "what does [MASKED] like" and first["sources"][1] is None and first["results"] == [{"title": "[MASKED]", "snippet": None}]
    assert first["sources"][0] == {"query": "about [MASKED]", "title": "[MASKED] at home", "link": "https://Ann Lee.example/", "snippet": "nothing"}
    assert [c["compressed_research"] or c["summary"] for c in one["compressed_research"]] == ["[MASKED] likes [MASKED]", "summary of [MASKED]"]
    counts = {(r["run_id"], r["stage"]): r["masked"] for r in audit.collect()}
    assert (counts["r1", "plan"], counts["r1", "search"], counts["r1", "compress"], counts["r2", "compress"], counts["r3", "plan"]) == (1, 4, 3, 2, 0)
    totals = {r["stage"]: (r["masked"], r["runs"], r["most_phrases"], r["phrase_lists"]) for r in texts.masking_totals(audit).collect()}
    assert totals["search"] == (8, 3, 2, 3)


def test_masks_are_those_of_all_patterns_in_turn():
    draw = random.Random(2)
    words = ["ann", "Ann", "lee", "tea", "masked", "[MASKED]", "of", "Kım", "kim", "Kim", "a.b"]
    for _ in range(400):
        text = "".join(draw.choice(words) + draw.choice([" ", "  ", "\n", "-", ""]) for _ in range(draw.randrange(12)))
        phrases = tuple({" ".join(draw.choice(words) for _ in range(draw.randint(1, 3))) for _ in range(draw.randrange(5))})
        want, n = text, 0
        for p in sorted(phrases, key=lambda p: (-len(p), p.lower())):
            want, k = re.compile(rf"(?<![A-Za-z0-9]){r'\s+'.join(map(re.escape, p.split()))}(?![A-Za-z0-9])", re.IGNORECASE).subn("[MASKED]", want)
            n += k
        assert texts._masked(text, phrases, "[MASKED]") == (want, n), (text, phrases)
    assert texts._masked("x", ("", "  "), "[MASKED]") == ("x", 0)


def test_projected_profiles(spark):
    body = {"userid": "U1", "Basic": {"Name": "Ann", "Age": 7, "Deep": {"Pets": ["a", {"Name": "b"}], "Taste": {"Tea": True}}}, "Tags": ["x", None], "Empty": {}}
    people = spark.createDataFrame([("U1", json.dumps(body))], "userid string, body string")
    shown = lambda c: json.loads(profiles.project_bodies(people, c, ["Name", "Age", "Pets"]).collect()[0]["body"])
    assert shown("full") == body
    assert shown("identity_only") == {"userid": "U1", "Basic": {"Name": "Ann", "Age": 7, "Deep": {"Pets": ["a", {"Name": "b"}]}}}
    assert shown("actionable_only") == {"userid": "U1", "Basic": {"Deep": {"Taste": {"Tea": True}}}, "Tags": ["x", None]}
    for bad in ('{"Name": "Ann"}', "[1]", "no json", None):
        with pytest.raises(Exception, match="actionable_only is empty"):
            profiles.project_bodies(spark.createDataFrame([("U1", bad)], "userid string, body string"), "actionable_only", ["Name"]).collect()
    with pytest.raises(ValueError):
        profiles.project_bodies(people, "some")


def test_stage_texts_of_baselines_and_views(spark):
    df = spark.createDataFrame([artifact("r1", "Ann")], ARTIFACT)
    got = {r["stage"]: r["text"] for r in texts.baseline_stage_text(df).collect()}
    assert got["search"] == "what does Ann like Ann  " and got["compress"] == "Ann likes tea summary of ANN"
    good = df.withColumn("search_trace", F.transform("search_trace", lambda q: q.withField("status", F.lit("ok"))))
    shown = texts.stage_text(good, "snippets").where("stage = 'search'").collect()[0]["text"]
    assert shown.split("\n")[0] == "Retrieved sources [t1]:" and shown.split("\n")[-1] == "Retrieved sources [t2]:" and "Query" not in shown


def test_findings_need_a_text(spark):
    rows = [("r1", [("t1", "first", " c "), ("t2", None, "d")]), ("r2", [])]
    df = spark.createDataFrame(rows, "run_id string, compressed_research array<struct<topic_id: string, topic_text: string, compressed_research: string>>")
    assert texts.findings_of_artifacts(df.where("run_id = 'r1'")).collect()[0]["text"] == "## first\n c\n\n## t2\nd"
    with pytest.raises(Exception, match="no findings: r2"):
        texts.findings_of_artifacts(df).collect()


def test_splits_are_disjoint_and_keep_the_shares(spark):
    rows = [(f"s{k % 3 if k % 5 else 0}", k) for k in range(600)]
    got = candidates.stratified_splits(spark.createDataFrame(rows, "s string, k long"), "s", "k", [("dev", 30), ("conf", 120)], 3, [("abl", "conf", 40)]).collect()
    again = candidates.stratified_splits(spark.createDataFrame(rows[::-1], "s string, k long").repartition(5), "s", "k", [("dev", 30), ("conf", 120)], 3, [("abl", "conf", 40)]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len({r["k"] for r in got}) == 150
    size = lambda keep: sum(map(keep, got))
    assert (size(lambda r: r["split"] == "dev"), size(lambda r: r["split"] == "conf"), size(lambda r: r["subset"] == "abl")) == (30, 120, 40)
    assert all(r["split"] == "conf" for r in got if r["subset"])
    share = sum(s == "s0" for s, _ in rows) / 600
    assert abs(size(lambda r: r["split"] == "conf" and r["s"] == "s0") - 120 * share) <= 1


def test_plans_need_sets_that_begin_with_their_truth(spark):
    people = spark.createDataFrame([(u, [("1", "c", "t")]) for u in "abc"], "userid string, items array<struct<id: string, category: string, text: string>>")
    plan = lambda c: candidates.run_plan(spark.createDataFrame([(1, "a", "q", c)], "id long, gt_userid string, question string, candidates array<string>"), people, (0, 1))
    assert [(r["userid"], r["is_gt"]) for r in plan(["a", "b", "c"]).where("seed = 0").orderBy("position").collect()] == [("a", True), ("b", False), ("c", False)]
    for bad in (["b", "a", "c"], ["a", "b", "b"]):
        with pytest.raises(Exception, match="begin with the truth: 1"):
            plan(bad).collect()


def test_masks_in_parts_of_a_batch(spark):
    """More rows than are Python strings at a time; rows without text or phrases among them."""
    n = 2 * texts.MASK_ROWS + 7
    rows = spark.range(n).coalesce(1).selectExpr("id", "CASE WHEN id % 11 = 0 THEN NULL ELSE concat('see Ann and ', id) END AS text", "CASE WHEN id % 5 = 0 THEN NULL ELSE array('ann') END AS phrases")
    got = {r["id"]: (r["text"], r["masked"]) for r in texts.mask_phrases(rows).collect()}
    assert got == {k: (None, 0) if k % 11 == 0 else (f"see Ann and {k}", 0) if k % 5 == 0 else (f"see [MASKED] and {k}", 1) for k in range(n)}
