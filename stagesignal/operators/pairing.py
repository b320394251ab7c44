"""Pairing of stages, conditions, methods, seeds and regenerated runs, and the audits that pairing needs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagesignal.operators.metrics import ADJACENT, hit, pivoted, rate
from stagesignal.operators.stats import cluster_bootstrap, interval, mcnemar_exact, resamples
from stagesignal.sources.io import settle


def _counts(a: str = "a", b: str = "b") -> list[Column]:
    x, y = F.col(a), F.col(b)
    return [F.count("*").alias("n"), F.sum(x).alias("left_correct"), F.sum(y).alias("right_correct"), F.sum(x * y).alias("both"),
            F.sum(x * (1 - y)).alias("left_only"), F.sum((1 - x) * y).alias("right_only")]


def _tested(counts: DataFrame) -> DataFrame:
    n, p = F.col("n"), F.round(mcnemar_exact(F.col("left_only"), F.col("right_only")), 6)
    return counts.withColumns({"left_accuracy": rate(F.col("left_correct"), n), "right_accuracy": rate(F.col("right_correct"), n),
                               "difference": rate(F.col("left_correct") - F.col("right_correct"), n), "p": p})


def _compared(rows: DataFrame, keys: list[str], cluster: str, reps: int, seed: int, scope: str | None = None) -> DataFrame:
    """Counts, exact p and the cluster interval of a - b, per keys; their `scope` is each value of the column scope, and all.
    rows are computed once: what follows needs only their sums per keys and cluster."""
    gap = F.col("a") - F.col("b")
    plain = [k for k in keys if k != "scope" or scope is None]
    sums = settle(rows.groupBy(*dict.fromkeys((*plain, cluster, *([scope] if scope else [])))).agg(*_counts(), F.sum(gap.cast("double")).alias("_s"), F.count(gap).alias("_c")))
    if scope:
        sums = sums.withColumn("scope", _scoped(scope))
    counted = [c for c in sums.columns if c in ("n", "left_correct", "right_correct", "both", "left_only", "right_only")]
    total = lambda names: [F.sum(c).alias(c) for c in names]
    ends = interval(resamples(sums.groupBy(*keys, cluster).agg(*total(("_s", "_c"))), cluster, ["_s", "_c"], keys, reps, seed), F.try_divide("_s", "_c"), keys)
    return _tested(sums.groupBy(*keys).agg(*total(counted))).join(ends, keys)


def _scoped(scope: str) -> Column:
    """Each value of scope, and all."""
    return F.explode(F.array(F.concat(F.lit(scope), F.col(scope).cast("string")), F.lit("all")))


def paired_stages(matches: DataFrame, reps: int = 5000, seed: int = 0) -> DataFrame:
    """Adjacent stages and search to write within each run: change, discordant counts, exact p, cluster interval."""
    pairs = (*ADJACENT, ("search", "write"))
    runs = pivoted(matches, ("run_id", "taskid"))
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))
    rows = runs.select("taskid", pair.alias("p")).select("taskid", "p.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    keys = ["from_stage", "to_stage"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("a") * (1 - F.col("b"))).alias("lost"), F.sum((1 - F.col("a")) * F.col("b")).alias("gained"))
    counts = counts.withColumn("p", F.round(mcnemar_exact(F.col("lost"), F.col("gained")), 6))
    return counts.join(cluster_bootstrap(rows, "taskid", F.col("b") - F.col("a"), keys, reps, seed).drop("n").withColumnRenamed("mean", "change"), keys)


def unpaired(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only, with the side."""
    a = left.select(*keys).join(right.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("left"))
    return a.union(right.select(*keys).join(left.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("right")))


def paired_conditions(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("run_id", "stage"), how: str = "common", scope: str = "seed", cluster: str = "taskid", reps: int = 5000, seed: int = 0) -> DataFrame:
    """Per stage and scope (each seed, and all): both accuracies, their difference with its cluster interval, discordant
    counts and exact p. how `strict`: an unpaired key is an error."""
    if how == "strict" and unpaired(left, right, keys).limit(1).count():
        raise ValueError("unpaired keys")
    b = right.select(*keys, hit().alias("b"))
    joined = left.select(*dict.fromkeys((*keys, "stage", scope, cluster)), hit().alias("a")).join(b, list(keys))
    return _compared(joined, ["scope", "stage"], cluster, reps, seed, scope)


def paired_methods(primary: DataFrame, others: dict[str, DataFrame], scope: str = "seed", cluster: str = "taskid", reps: int = 5000, seed: int = 0) -> DataFrame:
    """primary against each other method, per scope (each seed, and all) and stage; one join for all of them."""
    rest = None
    for name, df in others.items():
        part = df.select("run_id", "stage", F.lit(name).alias("method"), hit().alias("b"))
        rest = part if rest is None else rest.union(part)
    joined = primary.select("run_id", "stage", scope, cluster, hit().alias("a")).join(rest, ["run_id", "stage"])
    return _compared(joined, ["method", "scope", "stage"], cluster, reps, seed, scope)


def paired_seeds(matches: DataFrame, low: int = 0, high: int = 1, cluster: str = "taskid", reps: int = 5000, seed: int = 0) -> DataFrame:
    """Seed high against seed low on the base run, by conditional aggregation instead of a self-join."""
    base = F.regexp_replace("run_id", "_seed[0-9]+$", "")
    per = matches.where(F.col("seed").isin(low, high)).groupBy(base.alias("base"), "stage", cluster).agg(
        F.max(F.when(F.col("seed") == high, hit())).alias("a"), F.max(F.when(F.col("seed") == low, hit())).alias("b"))
    return _compared(per.where(F.col("a").isNotNull() & F.col("b").isNotNull()), ["stage"], cluster, reps, seed)


def _regenerated(source: DataFrame, regenerated: DataFrame, short: int) -> DataFrame:
    """Write stage of source (a) and regenerated (b) runs, paired on the canonical run id, with what the source run got
    right before and whether the new report is short."""
    from stagesignal.functions.scalars import canonical_run_id

    a = pivoted(source, ("run_id", "taskid")).select(canonical_run_id(F.col("run_id")).alias("id"), "taskid", "plan", "search", F.col("write").alias("a"))
    b = regenerated.where(F.col("stage") == "write").select(canonical_run_id(F.col("run_id")).alias("id"), hit().alias("b"), (F.col("report_chars") < short).alias("short"))
    return a.where("a is not null").join(b, "id").withColumn("lost_at_search", F.coalesce((F.col("plan") == 1) & (F.col("search") == 0), F.lit(False)))


def paired_regeneration(source: DataFrame, regenerated: DataFrame, short: int = 2000, reps: int = 5000, seed: int = 0) -> DataFrame:
    """Source against regenerated write stage (with report_chars), over all pairs, those with a short new report, and those
    whose source run had a right plan and a wrong search."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("short"), F.lit("short_report")), F.when(F.col("lost_at_search"), F.lit("plan_ok_search_wrong"))))
    rows = _regenerated(source, regenerated, short).select(F.explode(kinds).alias("subset"), "taskid", "a", "b")
    return _compared(rows, ["subset"], "taskid", reps, seed)


def regeneration_changes(source: DataFrame, regenerated: DataFrame, short: int = 2000) -> DataFrame:
    """The runs that regeneration lost or gained, one row each."""
    rows = _regenerated(source, regenerated, short).where(F.col("a") != F.col("b"))
    return rows.select("id", F.when(F.col("a") == 1, "lost").otherwise("gained").alias("change"), "short", "lost_at_search")


def comparability(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per stage and all: keys on one side only, truth mismatches, equal candidate sets, equal orders in which candidates were
    shown (shuffled_order), and over all also the runs, and those equal in every stage."""
    pick = lambda df, k: df.select("run_id", "stage", F.col("gt_userid").alias("gt" + k), F.array_sort("candidate_userids").alias("c" + k), F.col("shuffled_order").alias("o" + k), F.lit(True).alias("in" + k))
    both = pick(left, "a").join(pick(right, "b"), ["run_id", "stage"], "full_outer")
    there = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    flags = both.select("run_id", "stage", F.col("inb").isNull().alias("l"), F.col("ina").isNull().alias("r"), there.alias("p"), (there & ~F.col("gta").eqNullSafe(F.col("gtb"))).alias("t"),
                        (there & F.col("ca").eqNullSafe(F.col("cb"))).alias("s"), (there & F.col("oa").eqNullSafe(F.col("ob"))).alias("o"))
    names = {"l": "left_only", "r": "right_only", "p": "paired", "t": "truth_mismatches", "s": "same_set", "o": "same_order"}
    # A run's few stages meet once: its first row also counts the run, and what holds over all is the sum over stages.
    run = flags.groupBy("run_id").agg(F.every("o").alias("e"), F.collect_list(F.struct("stage", *names)).alias("x")).select("e", F.posexplode("x").alias("pos", "x")).select("e", "pos", "x.*")
    first = F.col("pos") == 0
    per = run.groupBy("stage").agg(*[F.count_if(F.col(k)).alias(n) for k, n in names.items()], F.count_if(first).alias("runs"), F.count_if(first & F.col("e")).alias("runs_same_order"))
    out = per.withColumn("scope", F.explode(F.array(F.col("stage"), F.lit("all")))).groupBy("scope").agg(*[F.sum(c).alias(c) for c in (*names.values(), "runs", "runs_same_order")])
    out = out.withColumns({c: F.when(F.col("scope") == "all", F.col(c)) for c in ("runs", "runs_same_order")})
    return out.withColumn("comparable", (F.col("left_only") + F.col("right_only") + F.col("truth_mismatches") == 0) & (F.col("same_set") == F.col("paired")) & (F.col("same_order") == F.col("paired")))


def audit_candidates(matches: DataFrame, experiments: DataFrame) -> DataFrame:
    """Runs whose recorded candidate set differs from the expected one (experiments: taskid, gt_userid, expected), or
    whose own rows disagree."""
    per = matches.groupBy("run_id", "taskid", "gt_userid").agg(F.count_distinct(F.array_sort("candidate_userids")).alias("sets"), F.min(F.array_sort("candidate_userids")).alias("recorded"))
    joined = per.join(experiments, ["taskid", "gt_userid"], "left")
    wrong = F.when(F.col("sets") > 1, "inconsistent").when(F.col("expected").isNull(), "no_experiment").when(F.col("recorded") != F.array_sort("expected"), "mismatch")
    return joined.withColumn("problem", wrong).where("problem is not null").select("run_id", "problem", F.concat_ws(",", "recorded").alias("recorded"), F.concat_ws(",", F.array_sort("expected")).alias("expected"))


def missing_units(expected: DataFrame, current: DataFrame, saved: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The expected grid with its value, a saved row winning over a current one, and whether it is missing."""
    rows = expected.join(saved.select(*keys, F.col(value).alias("_saved"), F.lit(True).alias("_s")), list(keys), "left").join(current.select(*keys, F.col(value).alias("_current"), F.lit(True).alias("_c")), list(keys), "left")
    return rows.select(*keys, F.when(F.col("_s"), F.col("_saved")).otherwise(F.col("_current")).alias(value), (F.col("_s").isNull() & F.col("_c").isNull()).alias("missing"))
