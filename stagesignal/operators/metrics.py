"""Aggregations over decisions: one row per run and stage with `correct`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STAGE_ORDER = ("plan", "search", "compress", "write")
ADJACENT = (("plan", "search"), ("search", "compress"), ("compress", "write"))


def hit(c: str | Column = "correct") -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


def rate(good: Column, n: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(good, n), digits)


def stage_accuracy(matches: DataFrame) -> DataFrame:
    """Per stage and seed, and seed `all`: correct, n, accuracy, in one pass."""
    both = matches.select("stage", F.explode(F.array(F.col("seed").cast("string"), F.lit("all"))).alias("seed"), hit().alias("h"))
    return both.groupBy("seed", "stage").agg(F.sum("h").alias("correct"), F.count("*").alias("n"), rate(F.sum("h"), F.count("*")).alias("accuracy"))


def accuracy_summary(matches: DataFrame, kind: str = "decisions", n_candidates: int = 3) -> DataFrame:
    """One row: accuracy per stage (4 digits) and its decisions, macro, chance 1/N, n (of the stage with most). kind
    `decisions`: macro over all decisions; `stages`: the mean of the rounded stage accuracies."""
    per = {s: F.round(F.avg(F.when(F.col("stage") == s, hit())), 4) for s in STAGE_ORDER}
    macro = F.round(F.avg(hit()), 4) if kind == "decisions" else F.round(sum(per.values(), F.lit(0.0)) / len(per), 4)
    counts = [F.count_if(F.col("stage") == s) for s in STAGE_ORDER]
    return matches.agg(*[c.alias(s) for s, c in per.items()], macro.alias("macro"), F.greatest(*counts).alias("n"), *[c.alias(f"n_{s}") for s, c in zip(STAGE_ORDER, counts)]).withColumn("chance", F.round(F.lit(1.0 / n_candidates), 6))


def usage_totals(matches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals of usage columns over the rows that have all of them."""
    has = F.lit(True)
    for c in columns:
        has = has & F.col(c).isNotNull()
    return matches.where(has).agg(F.count("*").alias("n_with_usage"), *[F.sum(c).alias(c) for c in columns])


def seed_variance(matches: DataFrame) -> DataFrame:
    """Per stage: mean, population sd (null for one seed), min and max of the seeds' accuracies, and the seeds."""
    per = matches.groupBy("stage", "seed").agg(F.avg(hit()).alias("a"))
    return per.groupBy("stage").agg(
        F.round(F.avg("a"), 6).alias("mean"), F.round(F.when(F.count("*") > 1, F.stddev_pop("a")), 6).alias("sd"),
        F.round(F.min("a"), 6).alias("lowest"), F.round(F.max("a"), 6).alias("highest"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.col("seed").cast("string")))).alias("seeds"))


def run_distribution(matches: DataFrame, stages: int = 4) -> DataFrame:
    """Runs by number of correct stages, 0 to stages, with their share."""
    runs = matches.groupBy("run_id").agg(F.sum(hit()).alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    every = matches.sparkSession.range(stages + 1).select(F.col("id").alias("n_correct"))
    filled = every.join(runs, F.col("n_correct") == F.col("k"), "left").select("n_correct", F.coalesce("c", F.lit(0)).alias("runs"))
    return filled.withColumn("fraction", rate(F.col("runs"), F.sum("runs").over(Window.partitionBy(F.lit(1)))))  # stages + 1 rows


def confusions(matches: DataFrame) -> DataFrame:
    return matches.where(~F.col("correct")).groupBy("gt_userid", "predicted_userid", "stage").agg(F.count("*").alias("errors"))


def quality_sensitivity(matches: DataFrame, summaries: DataFrame) -> DataFrame:
    """Stage accuracy under four inclusion policies; runs without a summary only count in all_matched."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    flags = summaries.select("run_id", "success_criteria_met", none("completeness_errors").alias("complete"), none("ledger_errors").alias("settled"))
    joined = matches.join(flags, "run_id", "left")
    policies = {"all_matched": F.lit(True), "success_criteria_met": F.col("success_criteria_met"), "no_completeness_errors": F.col("complete"), "no_ledger_errors": F.col("settled")}
    kept = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in policies.items()]))
    return joined.select("stage", hit().alias("h"), F.explode(kept).alias("policy")).groupBy("policy", "stage").agg(
        F.sum("h").alias("correct"), F.count("*").alias("n"), rate(F.sum("h"), F.count("*")).alias("accuracy"))


def domain_stage_accuracy(matches: DataFrame, unknown: str = "unknown") -> DataFrame:
    per = [e for s in STAGE_ORDER for e in (F.round(F.avg(F.when(F.col("stage") == s, hit())), 6).alias(s), F.count_if(F.col("stage") == s).alias(f"n_{s}"))]
    return matches.groupBy(F.coalesce("domain", F.lit(unknown)).alias("domain")).agg(*per, F.round(F.avg(hit()), 6).alias("macro"))


def pivoted(matches: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run with a 0/1 column per stage (null where the stage is missing): one shuffle, no self-join."""
    return matches.groupBy(*keys).agg(*[F.max(F.when(F.col("stage") == s, hit())).alias(s) for s in STAGE_ORDER])


def _deltas() -> list[Column]:
    return [F.round(F.col("search") - F.col("plan"), 6).alias("plan_to_search"), F.round(F.col("write") - F.col("search"), 6).alias("search_to_write")]


def candidate_size_sensitivity(matches: DataFrame) -> DataFrame:
    """matches with n_candidates: accuracy per N, chance, chance-normalised average, dip flag and two changes."""
    per = matches.groupBy("n_candidates").agg(*[F.round(F.avg(F.when(F.col("stage") == s, hit())), 6).alias(s) for s in STAGE_ORDER], F.avg(hit()).alias("a"))
    chance = 1.0 / F.col("n_candidates")
    return per.select("n_candidates", *STAGE_ORDER, F.round(chance, 6).alias("chance"), F.round("a", 6).alias("average"),
                      F.round(chance_normalized(F.col("a"), F.col("n_candidates")), 6).alias("normalized"),
                      ((F.col("search") < F.col("plan")) & (F.col("write") > F.col("search"))).alias("dip"), *_deltas())


def chance_normalized(accuracy: Column, n: Column) -> Column:
    return (accuracy - 1.0 / n) / (1.0 - 1.0 / n)


def protocol_trajectory(matches: DataFrame) -> DataFrame:
    """matches with protocol: stage accuracies and two changes per protocol; unequal stage counts are an error."""
    counts = [F.count_if(F.col("stage") == s) for s in STAGE_ORDER]
    per = matches.groupBy("protocol").agg(*[F.round(F.avg(F.when(F.col("stage") == s, hit())), 6).alias(s) for s in STAGE_ORDER], counts[0].alias("n"), F.greatest(*counts).alias("_hi"), F.least(*counts).alias("_lo"))
    ok = F.when(F.col("_hi") == F.col("_lo"), F.col("n")).otherwise(F.raise_error(F.lit("stage counts differ")).cast("long"))
    return per.select("protocol", *STAGE_ORDER, ok.alias("n"), *_deltas())


def attractor_rate(matches: DataFrame, label: str, by: Sequence[str] = ("stage",)) -> DataFrame:
    """How often label is predicted where it is not the truth."""
    drawn = (F.col("predicted_userid") == label).cast("int")
    return matches.where(F.col("gt_userid") != label).groupBy(*by).agg(F.count("*").alias("n"), F.sum(drawn).alias("predicted"), rate(F.sum(drawn), F.count("*")).alias("false_rate"))


def attractor_exposure(matches: DataFrame, label: str) -> DataFrame:
    """The same where label is among the candidates; also accuracy where label is the truth."""
    other = F.array_contains("candidate_userids", label) & (F.col("gt_userid") != label)
    drawn = F.col("predicted_userid") == label
    own = F.col("gt_userid") == label
    return matches.groupBy("stage").agg(
        F.count_if(other).alias("exposed"), F.count_if(other & drawn).alias("drawn"), rate(F.count_if(other & drawn), F.count_if(other)).alias("false_rate"),
        F.count_if(drawn).alias("predicted"), rate(F.count_if(own & F.col("correct")), F.count_if(own)).alias("own_accuracy"))


def transition_flows(matches: DataFrame) -> DataFrame:
    """Per adjacent stage pair: kept, lost, gained, never; net gain. Runs that lack either stage are left out."""
    runs = pivoted(matches)
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ADJACENT]))
    rows = runs.select(pair.alias("p")).select("p.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    count = lambda a, b: F.count_if((F.col("a") == a) & (F.col("b") == b))
    return rows.groupBy("from_stage", "to_stage").agg(count(1, 1).alias("kept"), count(1, 0).alias("lost"), count(0, 1).alias("gained"), count(0, 0).alias("never"),
                                                      F.sum(F.col("b") - F.col("a")).alias("net_gain"))


def recovery_summary(matches: DataFrame) -> DataFrame:
    """Runs lost at search (after a right plan, and at all), and how many are right again at compress and write."""
    runs = pivoted(matches)
    groups = {"plan_ok_search_wrong": (F.col("plan") == 1) & (F.col("search") == 0), "search_wrong": F.col("search") == 0}
    kinds = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in groups.items()])))
    return runs.select(kinds.alias("group"), "compress", "write").groupBy("group").agg(
        F.count("*").alias("runs"), F.sum("compress").alias("right_at_compress"), F.sum("write").alias("right_at_write"),
        rate(F.sum("write"), F.count("*")).alias("recovery_rate"))


def recovery_runs(matches: DataFrame) -> DataFrame:
    """The runs with a right plan and a wrong search, one row each: domain, recovered at write, right at compress."""
    runs = pivoted(matches, ("run_id", "domain")).where((F.col("plan") == 1) & (F.col("search") == 0))
    return runs.select("run_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce(F.col("write") == 1, F.lit(False)).alias("recovered"), F.coalesce("compress", F.lit(0)).alias("compress"))


def recovery_profile(matches: DataFrame) -> DataFrame:
    """Of those, the recovered and the others: runs and accuracy at compress, per domain and over all."""
    rows = recovery_runs(matches).select("recovered", F.explode(F.array("domain", F.lit("all"))).alias("domain"), "compress")
    return rows.groupBy("recovered", "domain").agg(F.count("*").alias("runs"), F.round(F.avg("compress"), 6).alias("compress_accuracy"))


def outcome_pattern(matches: DataFrame) -> DataFrame:
    """Per run: recovered or non_recovered (plan right, search wrong, write right or wrong), all_correct_prefix (plan, search
    and write right), or write_correct_other and write_wrong_other."""
    p, s, w = (F.col(x) == 1 for x in ("plan", "search", "write"))
    return pivoted(matches).select("run_id", F.when(p & ~s & w, "recovered").when(p & ~s & ~w, "non_recovered").when(p & s & w, "all_correct_prefix")
                                   .when(w, "write_correct_other").otherwise("write_wrong_other").alias("pattern"))


def prior_adjusted(matches: DataFrame, prior: DataFrame) -> DataFrame:
    """Stage accuracy over runs whose artifact-free guess (prior: taskid, gt_userid, prior_correct) is wrong, right, all."""
    joined = matches.join(prior, ["taskid", "gt_userid"])
    subset = F.explode(F.array(F.lit("all"), F.when(F.col("prior_correct"), "prior_right").otherwise("prior_wrong")))
    return joined.select(subset.alias("subset"), "stage", hit().alias("h")).groupBy("subset", "stage").agg(F.count("*").alias("n"), rate(F.sum("h"), F.count("*")).alias("accuracy"))


def prior_trajectory(matches: DataFrame, prior: DataFrame, reps: int = 5000, seed: int = 0) -> DataFrame:
    """The whole trajectory with intervals over the same three subsets of runs."""
    from stagesignal.operators.trajectory import trajectory_with_ci

    subset = F.explode(F.array(F.lit("all"), F.when(F.col("prior_correct"), "prior_right").otherwise("prior_wrong"))).alias("subset")
    joined = matches.join(prior, ["taskid", "gt_userid"]).select("run_id", "taskid", "stage", "correct", subset)
    return trajectory_with_ci(joined, reps, seed, ["subset"])


def donor_following(matches: DataFrame, donors: DataFrame, strict: DataFrame | None = None, cluster: str = "taskid", reps: int = 5000, seed: int = 0) -> DataFrame:
    """Per subset (all runs, and those of strict quality: run_id) and stage: predictions of the donor, of the shell and of
    others, their difference with the interval of unweighted task means, exact p. donors has run_id and donor. A donor or
    shell that is no candidate is an error."""
    from stagesignal.operators.stats import cluster_bootstrap_means, mcnemar_exact

    there = F.array_contains("candidate_userids", F.col("donor")) & F.array_contains("candidate_userids", F.col("gt_userid"))
    kind = F.when(~there, F.raise_error(F.concat(F.lit("shell or donor is no candidate: "), "run_id")).cast("string")).when(F.col("predicted_userid") == F.col("donor"), "d").when(F.col("predicted_userid") == F.col("gt_userid"), "s").otherwise("o")
    rows = matches.join(donors, "run_id").withColumn("k", kind).withColumn("subsets", F.array(F.lit("all")))
    if strict is not None:
        rows = rows.join(strict.select("run_id", F.lit("strict").alias("_s")).distinct(), "run_id", "left").withColumn("subsets", F.array_compact(F.array(F.lit("all"), F.col("_s"))))
    rows = rows.select(F.explode("subsets").alias("subset"), "stage", cluster, "k")
    per = rows.groupBy("subset", "stage").agg(
        *[F.count_if(F.col("k") == k).alias(n) for k, n in (("d", "donor"), ("s", "shell"), ("o", "other"))], F.count("*").alias("n"))
    per = per.select("*", rate(F.col("donor"), F.col("n")).alias("p_donor"), rate(F.col("shell"), F.col("n")).alias("p_shell"), rate(F.col("donor") - F.col("shell"), F.col("n")).alias("difference"),
                     F.round(mcnemar_exact(F.col("donor"), F.col("shell")), 6).alias("p"))
    value = (F.col("k") == "d").cast("int") - (F.col("k") == "s").cast("int")
    ends = cluster_bootstrap_means(rows, cluster, value, ["subset", "stage"], reps, seed).select("subset", "stage", "ci_low", "ci_high")
    return per.join(ends, ["subset", "stage"])


def order_mismatches(matches: DataFrame, method: str = "hash_sort", seed: int = 0) -> DataFrame:
    """Decisions whose stored shuffled_order is not the one that run, stage and seed give."""
    from stagesignal.operators.candidates import candidate_order

    again = candidate_order(matches.withColumnRenamed("shuffled_order", "stored_order"), method, seed)
    return again.where(~F.col("stored_order").eqNullSafe(F.col("shuffled_order"))).select("run_id", "stage", "stored_order", F.col("shuffled_order").alias("expected_order"))


def agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per stage and all: observed and expected agreement of predictions, Cohen's kappa, both accuracies, 2x2 counts."""
    r = right.select("run_id", "stage", F.col("predicted_userid").alias("pr"), hit().alias("hr"))
    joined = left.select("run_id", "stage", F.col("predicted_userid").alias("pl"), hit().alias("hl")).join(r, ["run_id", "stage"])
    rows = joined.select(F.explode(F.array(F.col("stage"), F.lit("all"))).alias("scope"), "pl", "pr", "hl", "hr")
    counts = rows.groupBy("scope").agg(
        F.count("*").alias("n"), F.count_if(F.col("pl") == F.col("pr")).alias("same"), F.sum("hl").alias("left_correct"), F.sum("hr").alias("right_correct"),
        F.sum(F.col("hl") * F.col("hr")).alias("both_correct"), F.sum(F.col("hl") * (1 - F.col("hr"))).alias("left_only"), F.sum((1 - F.col("hl")) * F.col("hr")).alias("right_only"))
    labels = rows.select("scope", F.explode(F.array(F.struct(F.col("pl").alias("label"), F.lit(1).alias("l"), F.lit(0).alias("r")), F.struct(F.col("pr").alias("label"), F.lit(0).alias("l"), F.lit(1).alias("r")))).alias("x"))
    margins = labels.groupBy("scope", "x.label").agg(F.sum("x.l").alias("l"), F.sum("x.r").alias("r")).groupBy("scope").agg(F.sum(F.col("l") * F.col("r")).alias("product"))
    observed, expected = F.col("same") / F.col("n"), F.col("product") / (F.col("n") * F.col("n"))
    kappa = F.when(expected == 1, F.lit(1.0)).otherwise(F.try_divide(observed - expected, 1 - expected))
    return counts.join(margins, "scope").select("scope", "n", F.round(observed, 6).alias("observed"), F.round(expected, 6).alias("expected"), F.round(kappa, 6).alias("kappa"),
                                                "left_correct", "right_correct", "both_correct", "left_only", "right_only")


def _judged() -> tuple[Column, Column, Column, Column]:
    a, b = F.col("content_personalization"), F.col("presentation_personalization")
    return a, b, (a + b) / 2, F.coalesce("write_correct", F.lit(False))


def judge_summary(rows: DataFrame, reps: int = 5000, seed: int = 0) -> DataFrame:
    """One row over judged runs (taskid, two scores, write_correct): mean scores, identical ones, correlation of the mean
    score with write_correct, and its mean over right less that over wrong writes with the interval over tasks."""
    from stagesignal.operators.stats import cluster_bootstrap_contrast

    a, b, mean, right = _judged()
    out = rows.agg(F.count("*").alias("n"), F.round(F.avg(a), 6).alias("content"), F.round(F.avg(b), 6).alias("presentation"), F.round(F.avg(mean), 6).alias("mean_personalization"),
                   F.count_if(a == b).alias("n_identical"), F.round(F.avg((a == b).cast("int")), 6).alias("identical"), F.round(F.corr(mean, right.cast("double")), 5).alias("pearson"))
    delta = cluster_bootstrap_contrast(rows.withColumn("_mean", mean).withColumn("_right", right), "taskid", F.col("_mean"), F.col("_right"), reps, seed)
    return out.crossJoin(delta.withColumnRenamed("difference", "delta"))  # one row each


def judge_means(rows: DataFrame, by: str) -> DataFrame:
    """Mean personalization per value of by (write_correct, pattern, seed)."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(_judged()[2]), 6).alias("mean_personalization"))


def judge_deltas(rows: DataFrame, stages: Sequence[str] = STAGE_ORDER) -> DataFrame:
    """Mean personalization of right less that of wrong runs: by write over all and per seed, and by each stage (columns
    <stage>_correct; runs without that stage are left out). Null where either side is empty."""
    _, _, mean, right = _judged()
    scopes = [F.struct(F.lit("all").alias("scope"), right.alias("right")), F.struct(F.concat(F.lit("seed="), F.col("seed").cast("string")).alias("scope"), right.alias("right"))]
    scopes += [F.struct(F.lit(f"stage={s}").alias("scope"), F.col(f"{s}_correct").alias("right")) for s in stages]
    long = rows.select(mean.alias("m"), F.explode(F.array(*scopes)).alias("x")).select("m", "x.*").where("right is not null")
    side = lambda r: F.avg(F.when(F.col("right") == r, F.col("m")))
    return long.groupBy("scope").agg(F.count_if("right").alias("correct_n"), F.count_if(~F.col("right")).alias("wrong_n"), F.round(side(True), 6).alias("correct_mean"), F.round(side(False), 6).alias("wrong_mean"), F.round(side(True) - side(False), 6).alias("delta"))


def score_distribution(rows: DataFrame, score: str) -> DataFrame:
    return rows.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
