"""Small inputs with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stagesignal.functions import scalars as S
from stagesignal.operators import candidates, matchers, metrics, overlap, pairing, profiles, quality, setjoin, stats, texts, trace, trajectory
from stagesignal.sources import io
from stagesignal.streaming import decisions

STAGES = ("plan", "search", "compress", "write")
COLUMNS = "run_id string, taskid long, domain string, seed long, gt_userid string, predicted_userid string, stage string, correct boolean, candidate_userids array<string>"


def matches(spark, runs, order=("U1", "U2", "U3")):
    """runs: {run id: "TFTT"}; the truth is U1."""
    rows = []
    for run, flags in runs.items():
        p = run.split("_")
        task, seed = int(p[1][4:]), int(p[3][4:])
        rows += [(run, task, f"d{task}", seed, "U1", "U1" if f == "T" else "U2", s, f == "T", list(order)) for s, f in zip(STAGES, flags)]
    return spark.createDataFrame(rows, COLUMNS).withColumn("shuffled_order", F.col("candidate_userids"))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


THREE = {"pilot_task1_User1_seed0": "TFTT", "pilot_task1_User2_seed0": "FFTT", "pilot_task2_User1_seed0": "TTTT"}
FLOWS = {"pilot_task1_A_seed0": "TFTT", "pilot_task1_B_seed0": "FFFT"}


def test_stage_accuracy_and_variance(spark):
    m = matches(spark, THREE)
    got = {r["stage"]: (r["correct"], r["n"], r["accuracy"]) for r in metrics.stage_accuracy(m).where("seed = 'all'").collect()}
    assert got == {"plan": (2, 3, 0.666667), "search": (1, 3, 0.333333), "compress": (3, 3, 1.0), "write": (3, 3, 1.0)}
    assert {r["sd"] for r in metrics.seed_variance(m).collect()} == {None}
    assert [(r["n_correct"], r["runs"]) for r in metrics.run_distribution(m).orderBy("n_correct").collect()] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 1)]


def test_mcnemar(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 5), (32, 1), (6, 31), (0, 4000)], "b long, c long")
    got = [r["p"] for r in df.select(stats.mcnemar_exact("b", "c").alias("p")).collect()]
    assert got[:3] == [1.0, 1.0, 0.0625] and got[3] == pytest.approx(8e-9, rel=0.1) and got[4] == pytest.approx(4.1e-5, rel=0.05) and 0 <= got[5] < 1e-300


def test_flows_and_recovery(spark):
    m = matches(spark, FLOWS)
    got = {(r["from_stage"], r["to_stage"]): (r["lost"], r["gained"]) for r in metrics.transition_flows(m).collect()}
    assert got == {("plan", "search"): (1, 0), ("search", "compress"): (0, 1), ("compress", "write"): (0, 1)}
    rec = {r["group"]: (r["runs"], r["right_at_write"]) for r in metrics.recovery_summary(m).collect()}
    assert rec == {"plan_ok_search_wrong": (1, 1), "search_wrong": (2, 2)}


def test_trajectory_retention(spark):
    got = one(trajectory.trajectory_retention(matches(spark, {"pilot_task1_A_seed0": "TFTT"}), reps=100))
    assert got == {"observed": True, "dip_low": -100.0, "dip_high": -100.0, "recovery_low": 100.0, "recovery_high": 100.0, "retained": 1.0}


def test_paired_conditions_and_comparability(spark):
    a, b = matches(spark, {"pilot_task1_A_seed0": "FTTT"}), matches(spark, {"pilot_task1_A_seed0": "TFTF"})
    got = {r["stage"]: r["difference"] for r in pairing.paired_conditions(b, a, how="strict").where("scope = 'all'").collect()}
    assert got == {"plan": 1.0, "search": -1.0, "compress": 0.0, "write": -1.0}
    with pytest.raises(ValueError):
        pairing.paired_conditions(a, b.where("stage <> 'plan'"), how="strict")
    same = one(pairing.comparability(a, b).where("scope = 'all'"))
    assert same["comparable"] and same["same_order"] == 4
    moved = one(pairing.comparability(a, matches(spark, {"pilot_task1_A_seed0": "TTTT"}, ("U2", "U1", "U3"))).where("scope = 'all'"))
    assert not moved["comparable"] and moved["same_set"] == 4 and moved["same_order"] == 0


def test_agreement(spark):
    def side(picks):
        return spark.createDataFrame([("r", s, p, p == "U2") for s, p in zip(STAGES, picks)], "run_id string, stage string, predicted_userid string, correct boolean")

    got = one(metrics.agreement(side(["U2", "U1", "U2", "U3"]), side(["U2", "U2", "U2", "U1"])).where("scope = 'all'"))
    assert (got["n"], got["observed"], got["both_correct"], got["left_only"], got["right_only"]) == (4, 0.5, 2, 0, 1)
    assert one(metrics.agreement(side(["a", "b", "a", "b"]), side(["a", "b", "a", "b"])).where("scope = 'all'"))["kappa"] == 1.0


def test_donor_following(spark):
    m = matches(spark, {f"pilot_task{t}_{u}_seed0": "FFFF" for t in (1, 2) for u in "ABC"})
    got = metrics.donor_following(m, m.select("run_id", F.lit("U2").alias("donor")).distinct(), m.where("taskid = 2").select("run_id"), reps=50).collect()
    assert {r["subset"]: r["n"] for r in got} == {"all": 6, "strict": 3}
    assert all((r["donor"], r["shell"], r["p_donor"], r["difference"], r["ci_low"], r["ci_high"]) == (r["n"], 0, 1.0, 1.0, 1.0, 1.0) for r in got)
    with pytest.raises(Exception, match="no candidate"):
        metrics.donor_following(m, m.select("run_id", F.lit("U9").alias("donor")).distinct()).collect()


def test_orders_are_those_of_run_and_stage(spark):
    import hashlib
    import random

    m = matches(spark, THREE, ("U1", "U2", "U3", "U4", "U5"))
    got = candidates.candidate_order(m, "mersenne", 42).collect()
    for r in got:
        wanted = list(r["candidate_userids"])
        random.Random(int(hashlib.sha256(f"42:{r['run_id']}:{r['stage']}".encode()).hexdigest()[:16], 16)).shuffle(wanted)
        assert r["shuffled_order"] == wanted
    assert len({tuple(r["shuffled_order"]) for r in got}) > 3
    stored = candidates.candidate_order(m)
    assert metrics.order_mismatches(stored).count() == 0
    assert {r["stage"] for r in metrics.order_mismatches(stored.withColumn("shuffled_order", F.when(F.col("stage") == "plan", F.reverse("shuffled_order")).otherwise(F.col("shuffled_order")))).collect()} == {"plan"}


def test_pairs_of_regenerated_runs_and_methods(spark):
    source = matches(spark, {"pilot_task1_A_seed0": "TFTT", "pilot_task1_B_seed0": "TTTT", "pilot_task2_C_seed1": "FFFF"})
    again = matches(spark, {"pilot_task1_A_seed0": "FFFF", "pilot_task1_B_seed0": "FFFT", "pilot_task2_C_seed1": "FFFT"})
    again = again.withColumn("run_id", F.regexp_replace("run_id", "^pilot", "ablation_nobrief")).withColumn("report_chars", F.when(F.col("run_id").contains("_A_"), 100).otherwise(5000))
    got = {r["subset"]: (r["n"], r["left_accuracy"], r["right_accuracy"], r["left_only"], r["right_only"]) for r in pairing.paired_regeneration(source, again, reps=50).collect()}
    assert got == {"all": (3, 0.666667, 0.666667, 1, 1), "short_report": (1, 1.0, 0.0, 1, 0), "plan_ok_search_wrong": (1, 1.0, 0.0, 1, 0)}
    assert {(r["id"], r["change"], r["short"]) for r in pairing.regeneration_changes(source, again).collect()} == {("pilot_task1_A_seed0", "lost", True), ("pilot_task2_C_seed1", "gained", False)}
    both = pairing.paired_methods(source, {"m": again.withColumn("run_id", F.regexp_replace("run_id", "^ablation_nobrief", "pilot"))}, reps=50)
    assert {r["scope"]: (r["n"], r["difference"]) for r in both.where("stage = 'write'").collect()} == {"seed0": (2, 0.5), "seed1": (1, -1.0), "all": (3, 0.0)}
    profile = {(r["recovered"], r["domain"]): (r["runs"], r["compress_accuracy"]) for r in metrics.recovery_profile(source).collect()}
    assert profile == {(True, "d1"): (1, 1.0), (True, "all"): (1, 1.0)} and [r["run_id"] for r in metrics.recovery_runs(source).collect()] == ["pilot_task1_A_seed0"]
    prior = spark.createDataFrame([(1, "U1", True), (2, "U1", False)], "taskid long, gt_userid string, prior_correct boolean")
    plan = {r["subset"]: r["value"] for r in metrics.prior_trajectory(source, prior, reps=20).where("measure = 'plan'").collect()}
    assert plan == {"all": 0.666667, "prior_right": 1.0, "prior_wrong": 0.0}


def test_audit_candidates(spark):
    m = matches(spark, {"pilot_task1_A_seed0": "TTTT"}, ("U1", "U6", "U7"))
    bad = pairing.audit_candidates(m, spark.createDataFrame([(1, "U1", ["U2", "U1", "U7"])], "taskid long, gt_userid string, expected array<string>"))
    assert one(bad)["problem"] == "mismatch"
    assert pairing.audit_candidates(m, spark.createDataFrame([(1, "U1", ["U7", "U6", "U1"])], "taskid long, gt_userid string, expected array<string>")).count() == 0


BODIES = [("P7", '{"Self": {"Who": {"Name": "Ruth Okafor", "Trade": "Baker"}}, "Taste": {"Food": {"Spice": "Mild", "Hours": "Early"}, "Music": ["Jazz"]}}'),
          ("P9", '{"Self": {"Who": {"Name": "Ivo Lind", "Trade": "Pilot"}}, "Taste": {"Food": {"Spice": "Hot", "Hours": "Late"}, "Music": ["Folk"]}}'), ("P11", None)]


def test_profiles(spark):
    leaves = profiles.profile_leaves(spark.createDataFrame(BODIES, "userid string, body string"))
    keys = ("Name", "Trade")
    part = lambda c: {r["value"] for r in profiles.project_profile(leaves, c, keys).where("userid = 'P7'").collect()}
    assert part("actionable_only") == {"P7", "Mild", "Early", "Jazz"} and part("identity_only") == {"P7", "Ruth Okafor", "Baker"}
    donors = spark.createDataFrame([("P7", "P9")], "userid string, donor string")
    mixed = profiles.compose_shuffled(leaves, donors, keys)
    assert {r["value"] for r in mixed.collect()} == {"P7", "Ruth Okafor", "Baker", "Hot", "Late", "Folk"} and profiles.conflicts(mixed).count() == 0
    text = {r["userid"]: r["text"] for r in profiles.profile_text(leaves, ["Self"]).collect()}
    assert text["P7"] == "=== Self ===\nWho > Name: Ruth Okafor\nWho > Trade: Baker"
    ring = profiles.cyclic_donor(spark.createDataFrame([(1, "P3", 1), (1, "P5", 2), (1, "P8", 3), (2, "Solo", 1)], "g long, u string, o long"), "g", "u", "o")
    assert {r["u"]: r["donor"] for r in ring.collect()} == {"P3": "P5", "P5": "P8", "P8": "P3", "Solo": None}


def test_audit_of_projections(spark):
    leaves = profiles.profile_leaves(spark.createDataFrame([*BODIES, ("P13", '{"Self": {"Who": {"Name": "No one"}}}')], "userid string, body string"))
    donors = spark.createDataFrame([("P7", "P9"), ("P9", "P9"), ("P13", "P7")], "userid string, donor string")
    got = {(r["condition"], r["userid"]): r for r in profiles.audit_projections(leaves, donors, ("Name", "Trade")).collect()}
    one_ = got["shuffled_actionable", "P7"]
    assert (one_["leaves"], one_["identity_keys"], one_["other_keys"], one_["identity_is_shells"], one_["actionable_is_donors"], one_["violations"]) == (5, ["Name", "Trade"], ["Hours", "Music", "Spice"], True, True, [])
    assert got["shuffled_actionable", "P9"]["violations"] == ["self donor"] and got["actionable_only", "P13"]["violations"] == ["empty profile"] and got["identity_only", "P7"]["violations"] == []
    assert profiles.audit_projections(leaves, donors, ("Name",)).where("condition = 'identity_only' and userid = 'P7'").collect()[0]["leaves"] == 1


def test_centrality_does_not_depend_on_order(spark):
    sets = [("s", "U1", u, t) for u, t in (("U1", list("abcd")), ("U2", list("abc")), ("U3", ["a"]))]
    for rows in (sets, sets[::-1]):
        assert one(candidates.centrality_prior(spark.createDataFrame(rows, "set_id string, gt_userid string, userid string, tokens array<string>")))["guess"] == "U2"


def test_hard_negatives_and_sets(spark):
    rows = [("User1", "d", ["a", "b", "c"]), ("User10", "d", ["a", "b", "x"]), ("User2", "d", ["a", "b", "y"]), ("User3", "d", ["z"]), ("User4", "d", ["w"]), ("Lone", "e", ["a"])]
    people = spark.createDataFrame(rows, "userid string, domain string, tokens array<string>")
    got = candidates.hard_negatives(people.where("userid in ('User1', 'Lone')"), people, 4)
    best = {t: [r["userid"] for r in got.where(F.col("target") == t).orderBy("rank").collect()] for t in ("User1", "Lone")}
    assert best == {"User1": ["User10", "User2", "User3", "User4"], "Lone": ["User1", "User10", "User2", "User3"]}
    sets = {r["n"]: r["candidates"] for r in candidates.candidate_sets(got.where("target = 'User1'")).collect()}
    assert sets[2] == sets[3][:2] == sets[5][:2] and len(set(sets[5])) == 5


def test_quotas(spark):
    got = candidates.largest_remainder(spark.createDataFrame([("a", 3), ("b", 3), ("c", 3)], "k string, n long"), "k", "n", 10)
    assert {r["k"]: r["quota"] for r in got.collect()} == {"a": 4, "b": 3, "c": 3}


def test_bm25_prefers_the_truth_on_ties(spark):
    d = spark.createDataFrame([("r", "plan", "cats and dogs", ["U1", "U2", "U3"]), ("r", "write", "nothing shared", ["U2", "U1", "U3"])], "run_id string, stage string, text string, candidate_userids array<string>")
    p = spark.createDataFrame([("U1", "birds"), ("U2", "cats cats dogs"), ("U3", "fish")], "userid string, text string")
    assert {r["stage"]: r["predicted_userid"] for r in matchers.match_bm25(d, p).collect()} == {"plan": "U2", "write": "U2"}


LINK = ("hotels", "Nice", "https://e.x/a", "e.x", 1, "good beds")
QUERIES = [("topic_001", "q1", "hotels", True, "ok", None, [LINK]), ("topic_001", "q2", "failing", True, "failed", None, [])]
LEDGER = {"input_tokens": 7, "output_tokens": 3, "total_tokens": 10, "token_usage_events": 1, "queries_requested": 2, "queries_attempted": 2, "queries_successful": 1, "queries_failed": 1, "queries_rejected": 0, "sources_selected": 1, "unique_sources": 1, "query_ledger_consistent": True, "source_ledger_consistent": True}
CONFIG = {"generation_seed": 1, "manifest_sha256": "a" * 64, "prompt_sha256": "b" * 64, "service_tier": "flex", "timeout_sec": 60, "models": {"m": "x"}}


def artifact(spark, **changes):
    row = {"schema_version": "dra_trace_v2", "run_id": "pilot_task1_A_seed0", "research_brief": "brief", "research_topics": [("topic_001", "first")], "execution_config": CONFIG, "search_trace": QUERIES,
           "compressed_research": [("topic_001", "first", "notes")], "final_report": "A" * 10_000, "token_ledger": LEDGER, "execution_error": None} | changes
    return spark.createDataFrame([row], io.ARTIFACT)


def test_stage_text(spark):
    a = artifact(spark)
    got = {r["stage"]: r["text"] for r in texts.stage_text(a).collect()}
    assert got["plan"] == "brief" and got["search"] == "Query [topic_001]: hotels\n  • Nice: good beds" and "topic_001" in got["compress"] and len(got["write"]) == 8000
    views = {v: {r["stage"]: r["text"] for r in texts.stage_text(a, v).collect()}["search"] for v in ("queries", "snippets")}
    assert "Nice" not in views["queries"] and "hotels" not in views["snippets"]
    assert {r["stage"]: r["text"] for r in texts.baseline_stage_text(a).collect()}["search"] == "hotels failing"


ERRORS = ("schema_errors", "completeness_errors", "ledger_errors")


@pytest.mark.parametrize("changes, wanted", [
    ({}, ([], [], [])),
    ({"final_report": None}, (["final_report: missing"], [], [])),
    ({"research_topics": [], "search_trace": [], "compressed_research": [], "token_ledger": LEDGER | dict.fromkeys(("queries_requested", "queries_attempted", "queries_successful", "queries_failed", "sources_selected", "unique_sources"), 0)},
     ([], ["research_topics: empty", "search_trace: empty"], [])),
    ({"search_trace": [(*QUERIES[0][:6], []), QUERIES[1]]}, ([], ["no successful source: topic_001"], ["sources_selected: 1 stated, 0 found", "unique_sources: 1 stated, 0 found"])),
    ({"compressed_research": [("topic_001", "first", "notes")] * 2}, ([], ["compressed_research: not one to one"], [])),
    ({"compressed_research": [("topic_009", "x", "")]}, (["0: compressed text empty"], ["compressed_research: not one to one"], [])),
    ({"final_report": "Error synthesizing research report: no"}, ([], ["final_report: empty or failed"], [])),
    ({"execution_config": CONFIG | {"service_tier": "gold", "prompt_sha256": "b"}}, (["service_tier: unknown", "prompt_sha256: no SHA-256"], [], [])),
    ({"search_trace": [QUERIES[0], ("topic_unmapped", "q1", "", None, "pending", None, None)], "token_ledger": LEDGER | {"queries_attempted": 1, "queries_failed": 0, "queries_rejected": 1}},
     (["1: query id missing or repeated", "1: query without text", "1: attempted: missing", "1: status not terminal", "1: sources: missing"], ["1: query of no topic"], [])),
    ({"search_trace": [(*QUERIES[0][:6], [("hotels", None, "https://e.x/a", "e.x", 0, "s")]), QUERIES[1]]}, (["0: source incomplete"], [], [])),
    ({"token_ledger": LEDGER | {"total_tokens": 11, "token_usage_events": 0, "queries_failed": 0, "query_ledger_consistent": False}},
     ([], [], ["queries_failed: 0 stated, 1 found", "total_tokens: not the sum", "token_usage_events: none", "query ledger: differs from the log"])),
    ({"token_ledger": LEDGER | {"input_tokens": None, "queries_failed": -1}}, ([], [], ["input_tokens: missing or negative", "queries_failed: missing or negative"])),
    ({"research_topics": [("topic_002", "b"), ("topic_001", "")]}, (["topics: not in order", "1: topic without text"], ["no successful source: topic_002", "compressed_research: not one to one"], [])),
])
def test_validation(spark, changes, wanted):
    got = one(trace.validate_artifacts(artifact(spark, **changes)))
    assert tuple(got[e] for e in ERRORS) == wanted
    assert got["schema_valid"] == (not wanted[0]) and got["success_criteria_met"] == (not any(wanted))


def test_trace_ledger(spark):
    ledger = one(trace.trace_ledger(artifact(spark)))
    assert (ledger["queries_attempted"], ledger["queries_successful"], ledger["queries_failed"], ledger["unique_sources"], ledger["complete"], ledger["query_ledger_consistent"]) == (2, 1, 1, 1, True, True)
    log = spark.createDataFrame([("pilot_task1_A_seed0", 2, 2, 1, 1, 1, 2)], "run_id string, queries_requested long, queries_attempted long, queries_successful long, queries_failed long, sources_selected long, unique_sources long")
    usage = spark.createDataFrame([("pilot_task1_A_seed0", 5, 6, 2)], "run_id string, input_tokens long, output_tokens long, token_usage_events long")
    got = one(trace.trace_ledger(artifact(spark, compressed_research=[]), log, usage))
    assert (got["query_ledger_consistent"], got["source_ledger_consistent"], got["total_tokens"], got["has_compressed_per_topic"], got["complete"]) == (True, False, 11, False, False)


def test_masking(spark):
    rows = spark.createDataFrame([("p", "Alice  Smith met alice and Malice in Paris.", ["Alice", "Alice Smith"])], "stage string, text string, phrases array<string>")
    got = texts.mask_phrases(rows)
    assert one(got) == {"stage": "p", "text": "[MASKED] met [MASKED] and Malice in Paris.", "masked": 2}
    assert one(texts.mask_entities(got, texts.phrase_tagger({"paris": "GPE"})))["text"] == "[MASKED] met [MASKED] and Malice in [GPE]."


def test_leakage(spark):
    t = spark.createDataFrame([(1, "x one two three four five six y. Another line")], "text_id long, text string")
    p = spark.createDataFrame([(7, "zero one two three four five six"), (8, "another LINE here")], "profile_id long, text string")
    assert [tuple(r) for r in texts.leakage_spans(t, p).collect()] == [(1, 7, 2, 6)]
    assert {(r["profile_id"], r["jaccard"]) for r in texts.leakage_sentences(t, p).collect()} == {(7, 0.666667), (8, 0.666667)}


def test_urls_and_stability(spark):
    df = spark.createDataFrame([("HTTP://Shop.Test/tea//#top",), ("https://shop.test/pot?size=2",), (None,), ("https://u:p@Tea.test",), ("https://tea.test/",), ("ftp://x",), ("no url/",)], "u string")
    assert [tuple(r) for r in df.select(S.normalize_url(F.col("u")), S.normalize_url(F.col("u"), "canonical")).collect()] == [
        ("http://shop.test/tea", "http://shop.test/tea//"), ("https://shop.test/pot?size=2", "https://shop.test/pot?size=2"), ("/", None), ("https://u:p@tea.test/", "https://tea.test/"), ("https://tea.test/", "https://tea.test/"), ("ftp://x/", None), ("no url", None)]
    rows = [(t, u, s, f"q {u}", f"https://e.com/{u}", True) for t in ("t1", "t2") for u in "abc" for s in (0, 1)]
    log = spark.createDataFrame(rows, "taskid string, userid string, seed long, query string, link string, attempted boolean")
    got = overlap.source_stability(log, log.select("taskid", "userid", "seed"), "urls")
    assert {(r["within"], r["between"], r["difference"]) for r in got.collect()} == {(1.0, 0.0, 1.0)}
    assert one(overlap.stability_means(got)) == {"tasks": 2, "within": 1.0, "between": 0.0, "difference": 1.0, "within_pairs": 6, "between_pairs": 12}
    for gap in ("taskid = 't1' and userid = 'a' and seed = 1", "taskid = 't1' and userid <> 'a'"):
        with pytest.raises(Exception, match="incomplete task: t1"):
            overlap.source_stability(log, log.where(f"not ({gap})").select("taskid", "userid", "seed"), "urls").collect()
    assert (one(overlap.stability_interval(got, 50))["ci_low"], one(overlap.stability_interval(got, 50))["ci_high"]) == (1.0, 1.0)


def test_free_text(spark):
    df = spark.createDataFrame([("## On tea\n\nA pot, well-warmed.\nThen leaves.\n\n* black\n* green\n* white\n", "Please send 650-3,400 words by noon.")], "t string, r string")
    got = one(df.select(S.text_metrics(F.col("t")).alias("m"), S.requested_word_range(F.col("r")).alias("w")))
    assert (got["m"]["words"], got["m"]["paragraphs"], got["m"]["headings"], got["m"]["bullets"]) == (10, 3, 1, 3) and tuple(got["w"]) == (650, 3400)
    j = lambda a, b, e: one(df.select(F.round(S.jaccard(S.tokens(F.lit(a)), S.tokens(F.lit(b)), e), 4).alias("j")))["j"]
    assert (j("red tea red cup", "tea pot lid", 0.0), j("", "", 0.0), j("", "", 1.0), j("", "", None)) == (0.2, 0.0, 1.0, None)


def test_caps_and_sources(spark):
    calls = [(k, f"c{c}", f"q{k}") for c, n in enumerate((5, 5, 5, 2)) for k in range(10 * c, 10 * c + n)]
    got = trace.admit_queries(spark.createDataFrame([(o, "r", c, q) for o, c, q in calls], "ord long, report_run string, call_id string, query string"), per_call=2)
    assert [r["n"] for r in got.where("attempted").groupBy("call_id").agg(F.count("*").alias("n")).orderBy("call_id").collect()] == [2, 2, 2, 1]
    many = spark.createDataFrame([(o, f"r{o}", "c", "q") for o in range(20)], "ord long, report_run string, call_id string, query string")
    assert trace.admit_queries(many, overall=1).where("attempted").count() == 1
    found = [("r", k, f"q{k}", [(f"t{i}", f"https://e.com/{k}/{i}", i, "s") for i in range(3)] if k < 6 else []) for k in range(7)]
    responses = spark.createDataFrame(found, "report_run string, query_sequence long, query string, organic array<struct<title: string, link: string, position: int, snippet: string>>")
    chosen = trace.select_sources(responses)
    codes = {r["query_sequence"]: r["failure_code"] for r in trace.query_outcomes(responses, chosen).collect()}
    assert chosen.count() == 15 and codes[4] is None and codes[5] == "no_new_sources" and codes[6] == "empty_organic"


def test_ledger_upsert(spark, tmp_path):
    upsert, schema = decisions.ledger_upsert(str(tmp_path)), "run_id string, version long, queries_attempted long, queries_successful long"
    for k, rows in enumerate([[("a", 1, 2, 1), ("b", 1, 7, 7)], [("a", 2, 3, 3)], [("a", 2, 3, 3)]]):
        upsert(spark.createDataFrame(rows, schema), min(k, 1))
    got = decisions.ledger(spark, str(tmp_path), 1)
    assert {(r["run_id"], r["version"]) for r in got.collect()} == {("a", 2), ("b", 1)} and trace.run_ledger(got).where("not consistent").count() == 0


def test_ledger_upsert_writes_only_the_parts_of_a_batch(spark, tmp_path):
    upsert, schema = decisions.ledger_upsert(str(tmp_path), parts=8), "run_id string, version long, n long"
    upsert(spark.createDataFrame([(f"r{k}", 1, k) for k in range(100)], schema), 0)
    upsert(spark.createDataFrame([("r5", 2, 500), ("new", 1, 7)], schema), 1)
    assert len(list((tmp_path / "data" / "batch=1").glob("part=*"))) <= 2
    got = {r["run_id"]: (r["version"], r["n"]) for r in decisions.ledger(spark, str(tmp_path), 1).collect()}
    assert got == {f"r{k}": (1, k) for k in range(100)} | {"r5": (2, 500), "new": (1, 7)}


def test_ledger_drops_what_no_kept_batch_names(spark, tmp_path):
    """Disk stays bounded over many batches, and readers of the last ones see what those left."""
    upsert, schema = decisions.ledger_upsert(str(tmp_path), parts=4, keep=2), "run_id string, version long, n long"
    state, seen = {}, {}
    for k in range(12):
        rows = [(f"r{(k * 3 + j) % 10}", k, k * j) for j in range(3)]
        upsert(spark.createDataFrame(rows, schema).coalesce(1), k)
        state |= {r: (v, n) for r, v, n in rows}
        seen[k] = dict(state)
        for past in (k, max(0, k - 1)):
            assert {r["run_id"]: (r["version"], r["n"]) for r in decisions.ledger(spark, str(tmp_path), past).collect()} == seen[past]
        assert len(list((tmp_path / "data").glob("batch=*/part=*"))) <= 3 * 4
    assert sorted(int(p.name[6:]) for p in (tmp_path / "manifest").glob("batch=*")) == [10, 11]


def test_quality_gate(spark):
    rows = [(True, True, [], [], None, None, 100, 1.0, 7, 6, 1, 9), (True, False, ["no source"], [], None, "", 90, 2.0, 7, 5, 2, 4), (None, True, ["x"], ["y"], "z", "crashed", 5, 1.0, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "schema_valid boolean, success_criteria_met boolean, completeness_errors array<string>, ledger_errors array<string>, execution_error string, error string, total_tokens long, elapsed_sec double, queries_attempted long, queries_successful long, queries_failed long, sources_selected long")
    s = quality.quality_summary(df, expected=4)
    got = one(s)
    assert (got["completed"], got["missing"], got["schema_valid"], got["success_met"], got["completeness_issues"], got["total_tokens"], got["queries_attempted"], got["queries_successful"]) == (2, 1, 2, 1, 1, 190, 14, 11)
    assert (got["error_runs"], got["sources_selected"], got["execution_errors"]) == (1, 13, 0)
    assert one(quality.quality_gate(s, 2))["reasons"] == ["completeness issues"] and one(quality.quality_gate(s, 2, 2))["passed"]


def test_readers(spark, tmp_path):
    (tmp_path / "a_match.json").write_text('[{"run_id": "pilot_task1_U_seed0", "stage": "plan", "correct": true}, {"run_id": "pilot_task1_U_seed0", "stage": "write", "correct": null}]')
    (tmp_path / "other.json").write_text('[{"run_id": "x", "stage": "nope"}]')
    got = io.read_matches(spark, str(tmp_path)).orderBy("stage").collect()
    assert [(r["stage"], r["correct"], r["taskid"], r["seed"]) for r in got] == [("plan", True, 1, 0), ("write", False, 1, 0)]
    with pytest.raises(ValueError, match="Unknown stage"):
        io.read_matches(spark, str(tmp_path), "other.json")
    (tmp_path / "b_match.json").write_text('[{"run_id": "pilot_task1_U_seed0", "stage": "plan", "correct": true}]')
    with pytest.raises(ValueError, match="Duplicate match records"):
        io.read_matches(spark, str(tmp_path))
    for name, run in (("batch_summary.json", "r0"), ("x_summary.json", "r1"), ("y_summary.json", None)):
        (tmp_path / name).write_text("[{" + (f'"run_id": "{run}", ' if run else "") + '"seed": 1}]')
    assert [r["run_id"] for r in io.read_run_summaries(spark, str(tmp_path)).collect()] == ["r1"]
    with pytest.raises(ValueError, match="does not parse"):
        (tmp_path / "z_artifacts.json").write_text('[{"run_id": "odd"}]')
        io.read_artifacts(spark, str(tmp_path))
    io.write_table(spark.createDataFrame([("a", [1, 2])], "k string, v array<long>"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).collect()[0]["v"] == "[1,2]"


def test_match_with(spark):
    import pandas as pd

    rows = spark.createDataFrame([("r", "plan", "U1", ["U2", "U1"], "B"), ("r", "write", "U1", ["U2", "U1"], "C")], "run_id string, stage string, gt_userid string, shuffled_order array<string>, hint string")
    got = matchers.match_with(rows, lambda b: pd.DataFrame({"predicted_label": b["hint"], "input_tokens": 1, "output_tokens": 2}))
    assert {r["stage"]: (r["predicted_userid"], r["correct"]) for r in got.collect()} == {"plan": ("U1", True), "write": ("UNKNOWN", False)}


def test_results_do_not_depend_on_partitions(spark):
    m = matches(spark, {f"pilot_task{t}_U{u}_seed{s}": "".join("TF"[(t * u + s + k) % 3 == 0] for k in range(4)) for t in range(1, 6) for u in range(3) for s in (0, 1)})
    runs = lambda df: sorted(map(str, pairing.paired_stages(df, reps=50).collect()))
    assert runs(m.coalesce(1)) == runs(m.repartition(8).orderBy(F.rand()))


def test_percentile_rules(spark):
    df = spark.createDataFrame([(float(x),) for x in range(100)], "v double")
    got = {(r, q): one(stats.percentile_rank(df, "v", q, r))["value"] for r in ("floor", "inner", "nearest") for q in (0.025, 0.975)}
    assert got == {("floor", 0.025): 2.0, ("floor", 0.975): 97.0, ("inner", 0.025): 2.0, ("inner", 0.975): 97.0, ("nearest", 0.025): 2.0, ("nearest", 0.975): 97.0}


def test_arrays_in_files_stay_small_and_groups_need_no_single_window(spark, tmp_path):
    import contextlib
    import io as text
    import json

    from stagesignal.operators import candidates
    from stagesignal.plans import files

    folder = files._arrays(spark.range(3000).selectExpr("id", "cast(id as string) as name"), str(tmp_path / "arrays"))
    found = [json.loads(p.read_text()) for p in (tmp_path / "arrays").glob("part-*") if p.stat().st_size]
    assert sorted(r["id"] for a in found for r in a) == list(range(3000)) and max(map(len, found)) < 200
    assert spark.read.schema("id long, name string").json(folder, multiLine=True).count() == 3000
    rows = spark.createDataFrame([(g, k) for g in range(6) for k in range(3 if g % 2 else 2)], "g long, k long")
    out = candidates.complete_groups(rows, "g", "k", 3, 7)
    assert sorted(map(tuple, out.collect())) == [(0, 0), *[(g, k) for g in (1, 3) for k in range(3)]]
    with contextlib.redirect_stdout(text.StringIO()) as plan:
        out.explain()
    assert "Window" not in plan.getvalue()


def test_entropy_of_arrays(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c", "a", "b"],), (["x"],), ([],)], "t array<string>")
    assert [round(r["e"], 6) for r in df.select(S.token_entropy(F.col("t")).alias("e")).collect()] == [1.459148, 0.0, 0.0]
    by = texts.token_statistics(df.limit(1).withColumn("k", F.lit(1)), ["k"], F.col("t"))
    assert (round(one(by)["entropy"], 6), one(by)["ttr"], one(by)["tokens"]) == (1.459148, 0.5, 6)


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": {"y": 1, "x": "é"}, "a": [2, 1]}',), ('{"a":[2,1],"b":{"x":"é","y":1}}',), ("not json",)], "j string")
    a, b, c = (r["h"] for r in df.select(S.canonical_json_hash(F.col("j")).alias("h")).collect())
    assert a == b and c is None


def test_samples_are_the_first_by_hash(spark):
    rows = spark.createDataFrame([("big", k) for k in range(3000)] + [("small", k) for k in range(30)], "s string, k long")
    got = candidates.stratified_sample(rows, "s", "k", 101, 5).collect()
    import hashlib

    first = lambda s, n, q: {(s, k) for k in sorted(range(n), key=lambda k: hashlib.sha256(f"5|{k}".encode()).hexdigest())[:q]}
    assert {tuple(r) for r in got} == first("big", 3000, 100) | first("small", 30, 1)


def test_leakage_with_a_small_limit_of_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(texts, "MOST_SENT", 0)
    monkeypatch.setattr(texts, "FREQUENT", 3)
    test_leakage(spark)


def test_hard_negatives_are_those_of_a_plain_search(spark, monkeypatch):
    """Ties, empty sets, tokens that all have, domains of one and two, samples and broadcasts of any size."""
    draw = random.Random(4)
    tokens = lambda: ["all"] * draw.randint(0, 1) + draw.sample([f"t{j}" for j in range(40)], draw.choice([0, 1, 3, 8, 8, 20]))
    people = [(f"User{k}", "lone" if k == 7 else "pair" if k in (8, 9) else f"d{k % 3}", tokens()) for k in range(120)]
    frame = spark.createDataFrame(people, "userid string, domain string, tokens array<string>")
    asked = [p for p in people if p[0].endswith(("5", "7", "8"))]

    def plain(k):
        for user, domain, own in asked:
            crowd = [p for p in people if p[0] != user and p[1] == domain]
            pool = crowd if len(crowd) >= 2 else [p for p in people if p[0] != user]
            score = lambda p: math.floor(len(set(own) & set(p[2])) / len(set(own) | set(p[2])) * 1e4 + 0.5) / 1e4 if own or p[2] else 0.0
            for rank, (j, other) in enumerate(sorted((-score(p), p[0]) for p in pool)[:k], 1):
                yield user, rank, other, -j + 0.0, len(crowd) < 2

    for k, sample, sent in ((1, 64, 10**6), (3, 4, 10**6), (5, 1, 0)):
        monkeypatch.setattr(setjoin, "MOST_SENT", sent)
        got = candidates.hard_negatives(frame.where(F.col("userid").isin([p[0] for p in asked])), frame, k, sample=sample)
        assert sorted((r["target"], r["rank"], r["userid"], r["jaccard"], r["fallback_pool"]) for r in got.collect()) == sorted(plain(k))


def test_set_join_has_one_plan_for_any_number_of_targets(spark):
    rows = [(f"User{k}", "d", [f"t{k % 5}", f"s{k % 7}", f"r{k}"]) for k in range(400)]
    people = spark.createDataFrame(rows, "userid string, domain string, tokens array<string>")
    few, many = (candidates.hard_negatives(people.where(c), people, 2)._jdf.queryExecution().analyzed().toString().count("Join") for c in ("userid = 'User1'", "true"))
    assert few == many


def test_frozen_sets(spark):
    sets = spark.createDataFrame([("a", 3, ["a", "b", "c"]), ("d", 3, ["d", "e", "f"]), ("a", 2, ["a", "b"])], "target string, n int, candidates array<string>")
    frozen = spark.createDataFrame([("a", ["a", "b", "c"]), ("d", ["d", "f", "e"]), ("g", ["g"])], "target string, frozen array<string>")
    assert {r["target"] for r in candidates.frozen_mismatches(sets, frozen).collect()} == {"d", "g"}


def test_mechanism_of_search(spark):
    trace_rows = [("r1", "Best books for tea", "https://www.amazon.com/x", True), ("r1", "best  BOOKS for tea", "https://arxiv.org/y", True), ("r1", "green pot", None, False), ("r2", "pot", "https://shop.example/z", True)]
    log = spark.createDataFrame(trace_rows, "run string, query string, link string, attempted boolean")
    rows = overlap.search_mechanism_rows(log)
    got = {r["run"]: r for r in rows.collect()}
    assert (got["r1"]["queries"], got["r1"]["unique_queries"], got["r1"]["hosts"], got["r1"]["generic_rate"], got["r1"]["category_entropy"], got["r2"]["category_entropy"]) == (3, 3, 2, 0.333333, 1.0, 0.0)
    told = {r["run"]: r for r in overlap.search_mechanism_rows(log, spark.createDataFrame([("r1", "tea pot tea pot"), ("r3", None)], "run string, text string")).collect()}
    assert told["r1"]["brief_entropy"] == 1.0 and (told["r3"]["queries"], told["r3"]["unique_ratio"], told["r3"]["entropy"]) == (0, 0.0, 0.0) and told["r2"]["type_token_ratio"] == 1.0
    buckets = spark.createDataFrame([("r1", "interests", ["tea", "pot", "lid", "cup"]), ("r2", "interests", ["pot"])], "run string, bucket string, tokens array<string>")
    briefs = spark.createDataFrame([("r1", "Tea, a pot and a cup.")], "run string, text string")
    kept = overlap.bucket_retention(log.where("attempted"), briefs, buckets)
    assert {(r["run"], r["brief"], r["query"], r["lost"]) for r in kept.collect()} == {("r1", 0.75, 0.25, 0.5), ("r2", 0.0, 1.0, -1.0)}
    outcomes = spark.createDataFrame([("r1", 1, 0, 1), ("r2", 1, 1, 1)], "run string, plan int, search int, write int")
    assert [r["run"] for r in overlap.recovery_cases(rows, kept, outcomes, "interests").collect()] == ["r1"]


def test_percentile_rank_of_skewed_numbers(spark):
    values = [0.0] * 500 + [1e12] + [float(k) / 7 for k in range(300)] + [-5.5] * 3
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ordered = sorted(values)
    for q in (0.0, 0.001, 0.3, 0.625, 0.9, 0.999):
        assert one(stats.percentile_rank(df, "v", q, "floor"))["value"] == ordered[min(int(q * len(ordered)), len(ordered) - 1)]
    assert one(stats.percentile_rank(df.limit(0), "v", 0.5, "floor"))["value"] is None


def test_places_beyond_the_brackets_are_found_by_narrowing(spark, monkeypatch):
    """A coarse sketch, few parts, and no counts at the driver."""
    draw = random.Random(8)
    values = [draw.choice([0.0, 1e9, draw.gauss(0, 1), draw.random() ** 9]) for _ in range(3000)]
    df, ordered, wanted = spark.createDataFrame([(v,) for v in values], "v double"), sorted(values), [(q, "floor") for q in (0.01, 0.5, 0.7, 0.99)]
    for held in (65_536, 0):
        monkeypatch.setattr(stats, "MOST_HELD", held)
        got = stats.percentile_ranks(df, "v", wanted, k=8, buckets=3).collect()
        assert [(r["q"], r["value"]) for r in got] == [(q, ordered[int(q * 3000)]) for q, _ in wanted]
    ranges = [{"low": 1.0, "high": 1.0, "c": 2}, {"low": 2.0, "high": 5.0, "c": 3}, {"low": 6.0, "high": 6.0, "c": 1}]
    assert [stats._walk(ranges, k) for k in range(6)] == [1.0, 1.0, None, None, None, 6.0]
    counted = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 5.0, 3), (6.0, 6.0, 1)], "low double, high double, c long")
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 5.0, 6.0)], "v double")
    assert [stats._place(counted, rows, k, 2) for k in range(5)] == [1.0, 2.0, 3.0, 5.0, 6.0]


def test_bootstrap_by_blocks(spark):
    """Blocks of clusters share each resample's draws: totals hold, intervals agree with those of one block, any partitioning."""
    sums = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("s"), F.lit(1).alias("c"), F.lit(None).cast("string").alias("g"))
    one_block, many = (stats.resamples(sums, "k", ["s", "c"], ["g"], 400, 5, block=b) for b in (4096, 100))
    again = stats.resamples(sums.repartition(7), "k", ["s", "c"], ["g"], 400, 5, block=100)
    rows = sorted(map(tuple, many.select("_rep", "s", "c").collect()))
    assert len(rows) == 400 and {c for _, _, c in rows} == {3000.0} and rows == sorted(map(tuple, again.select("_rep", "s", "c").collect()))
    ends = [one(stats.interval(r, F.col("s") / F.col("c"))) for r in (one_block, many)]
    assert abs(ends[0]["ci_low"] - ends[1]["ci_low"]) < 0.02 and abs(ends[0]["ci_high"] - ends[1]["ci_high"]) < 0.02
    assert abs((ends[1]["ci_high"] - ends[1]["ci_low"]) / (2 * 1.96 * 2 / 3000**0.5) - 1) < 0.15  # the spread of 0..6 is 2


def test_bootstrap_of_many_clusters(spark):
    sums = spark.range(100_000).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(2)).alias("s"), F.lit(1).alias("c"))
    got = one(stats.interval(stats.resamples(sums, "k", ["s", "c"], (), 200), F.col("s") / F.col("c")))
    assert 0.49 < got["ci_low"] < got["ci_high"] < 0.51


def test_trajectory_with_gaps(spark):
    """Runs that lack a stage are no wrong ones, and changes are over runs with both stages."""
    whole, gap = "pilot_task1_A_seed0", "pilot_task1_B_seed0"
    rows = matches(spark, {whole: "TTTT", gap: "TTTT"}).where(f"not (run_id = '{gap}' and stage = 'plan')")
    got = {r["measure"]: r["value"] for r in trajectory.trajectory_with_ci(rows, 20).collect()}
    assert got["plan"] == 1.0 and got["plan_to_search"] == 0.0 and got["recovery_rate"] is None
    kept = one(trajectory.trajectory_retention(rows, 20))
    assert (kept["observed"], kept["dip_low"], kept["retained"]) == (False, 0.0, 0.0)


def test_outcome_patterns(spark):
    runs = {"pilot_task1_A_seed0": "TTTF", "pilot_task1_B_seed0": "TTFT", "pilot_task1_C_seed0": "TFTT", "pilot_task1_D_seed0": "TFTF", "pilot_task1_E_seed0": "FTTT"}
    got = {r["run_id"][12]: r["pattern"] for r in metrics.outcome_pattern(matches(spark, runs)).collect()}
    assert got == {"A": "write_wrong_other", "B": "all_correct_prefix", "C": "recovered", "D": "non_recovered", "E": "write_correct_other"}


def test_judged_runs(spark):
    rows = [(k % 4, k % 2, k % 3 > 0, 1 + k % 5, 1 + k % 4, True, k % 2 == 0, None) for k in range(40)]
    df = spark.createDataFrame(rows, "taskid long, seed long, write_correct boolean, content_personalization long, presentation_personalization long, plan_correct boolean, search_correct boolean, compress_correct boolean")
    mean = lambda keep: sum((r[3] + r[4]) / 2 for r in rows if keep(r)) / sum(map(keep, rows))
    got, deltas = one(metrics.judge_summary(df, 50)), {r["scope"]: r for r in metrics.judge_deltas(df).collect()}
    assert abs(got["delta"] - (mean(lambda r: r[2]) - mean(lambda r: not r[2]))) < 1e-5 and got["ci_low"] <= got["delta"] <= got["ci_high"]
    assert set(deltas) == {"all", "seed=0", "seed=1", "stage=plan", "stage=search", "stage=write"} and deltas["stage=plan"]["delta"] is None and deltas["stage=plan"]["correct_n"] == 40


def test_markdown_and_word_ranges(spark):
    df = spark.createDataFrame([("  # Head\n    # code\n#no\n+ a\n1. b\n2) c\n - d\n\nit\u2019s a well-known-fact", w) for w in ("100\u2014200 Words", "100-200word", "1,000 \u2013 2,000-word", "100 to 200 words", "a 9-10 words list")], "t string, w string")
    got = df.select(S.text_metrics(F.col("t")).alias("m"), S.requested_word_range(F.col("w")).alias("r")).collect()
    assert [tuple(r["r"]) for r in got] == [(100, 200), (100, 200), (1000, 2000), (None, None), (9, 10)]
    assert (got[0]["m"]["headings"], got[0]["m"]["bullets"], got[0]["m"]["words"]) == (1, 4, 13)
