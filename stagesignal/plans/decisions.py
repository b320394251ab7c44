"""Queries over decisions and run summaries, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagesignal.operators import candidates, metrics, pairing, quality, stats, trajectory
from stagesignal.plans import views
from stagesignal.plans.registry import query
from stagesignal.plans.views import duck, matches, matches_sql

M = {v: duck(matches_sql(v)) for v in range(5)}
H = f"SELECT run_id, taskid, domain, seed, gt_userid, predicted_userid, stage, stage_index, candidate_userids, prompt_chars, correct, CAST(correct AS INT) AS h FROM ({M[0]})"
#: Resamples of every registered interval.
REPS = 5000
STAGE_SET = ("plan", "search", "compress", "write")
PIVOT = "SELECT run_id, any_value(taskid) AS taskid, any_value(domain) AS domain, " + ", ".join(f"max(h) FILTER (stage = '{s}') AS {s}" for s in STAGE_SET) + f" FROM ({H}) GROUP BY run_id"
#: Decisions with gaps: a stage missing in some runs, and one missing in a whole task.
_GAPS = "NOT (stage = 'plan' AND CAST(substr(gt_userid, 5) AS BIGINT) % 4 = 1) AND NOT (stage = 'search' AND CAST(substr(gt_userid, 5) AS BIGINT) % 5 = 2) AND NOT (stage = 'write' AND taskid = 7)"
HG = f"SELECT * FROM ({H}) WHERE {_GAPS}"
PIVOT_GAPS = "SELECT run_id, any_value(taskid) AS taskid, any_value(gt_userid) AS gt_userid, " + ", ".join(f"max(h) FILTER (stage = '{s}') AS {s}" for s in STAGE_SET) + f" FROM ({HG}) GROUP BY run_id"
PIVOT_GT = "SELECT run_id, any_value(taskid) AS taskid, any_value(gt_userid) AS gt_userid, " + ", ".join(f"max(h) FILTER (stage = '{s}') AS {s}" for s in STAGE_SET) + f" FROM ({H}) GROUP BY run_id"
#: Measures of a trajectory over sums: right rows and rows of each stage, changes and runs of each pair; lost at search l and recovered r.
VALUES = {"plan": "p / np", "search": "s / ns", "compress": "c / nc", "write": "w / nw", "plan_to_search": "ps / nps", "search_to_compress": "sc / nsc", "compress_to_write": "cw / ncw", "search_to_write": "sw / nsw"}
_PAIRED = (("ps", "search - plan"), ("sc", "compress - search"), ("cw", "write - compress"), ("sw", "write - search"))
SUMS = ", ".join([f"coalesce(sum({c}), 0) AS {k}, count({c}) AS n{k}" for k, c in (("p", "plan"), ("s", "search"), ("c", "compress"), ("w", "write"), *_PAIRED)]) + ", count_if(plan = 1 AND search = 0) AS l, count_if(plan = 1 AND search = 0 AND write = 1) AS r"
PARTS = ", ".join(f"sum {k}, sum n{k}" for k in ("p", "s", "c", "w", "ps", "sc", "cw", "sw"))


def summed(value: str) -> str:
    return re.sub(r"[a-z]+", lambda m: f"sum({m[0]})", value)


SUMMARY = duck(views.SUMMARIES)
MCNEMAR = """CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1),
  lambda k: exp(lgamma({b} + {c} + 1.0) - (CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1.0) END) - lgamma({b} + {c} - k + 1.0) - ({b} + {c}) * ln(2.0))))) END"""


def gappy(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).where(_GAPS.replace("substr(gt_userid, 5)", "substring(gt_userid, 5, 9)"))


def mcnemar(b: str, c: str) -> str:
    return f"round({MCNEMAR.format(b=b, c=c)}, 6)"


def _mixed(name: str, start: str) -> str:
    """32 bits mixed step by step; the last step is name and a 3."""
    step = lambda k, shift, factor: f"(xor({name}{k}, {name}{k} >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT"
    return f"({start}) & 4294967295::UBIGINT AS {name}0, {step(0, 16, 2246822507)} AS {name}1, {step(1, 13, 3266489909)} AS {name}2, xor({name}2, {name}2 >> 16) AS {name}3"


#: The draws of seed 0: that seed, the resample and the position, mixed in turn.
_MIXED = ", ".join((_mixed("a", "rep::UBIGINT * 2654435761::UBIGINT"), _mixed("b", "a3 + i::UBIGINT * 2246822519::UBIGINT")))


def resample_sql(rows: str, by: str, parts: str, reps: int) -> str:
    """Sums of the parts of rows (by, cluster, parts) in each resample."""
    names = [p.split()[-1] for p in parts.split(", ")]
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    using = f"AND c.{by} = d.{by}" if by else ""
    sums = ", ".join(f"sum(c.{n}) AS {n}" for n in names)
    dk = f"d.{by}, " if by else ""
    return f"""(WITH c AS (SELECT *, row_number() OVER ({part}ORDER BY cluster) - 1 AS k FROM ({rows})),
      t AS (SELECT {key}count(*) AS n FROM c {'GROUP BY ' + by if by else ''}),
      x AS (SELECT *, {_MIXED} FROM (SELECT {key}n, rep, unnest(range(0, n)) AS i FROM t, range(0, {reps}) AS r(rep))),
      d AS (SELECT *, CAST((b3 * n) >> 32 AS BIGINT) AS k FROM x)
    SELECT {dk}rep, {sums} FROM d JOIN c ON c.k = d.k {using} GROUP BY {dk}rep)"""


def bootstrap_sql(rows: str, by: str, parts: str, value: str, reps: int) -> str:
    """Interval of value over resamples of rows (by, cluster, parts)."""
    key = f"{by}, " if by else ""
    return f"""(SELECT {key}round(quantile_cont(CAST({value} AS DOUBLE), 0.025), 6) AS ci_low, round(quantile_cont(CAST({value} AS DOUBLE), 0.975), 6) AS ci_high FROM {resample_sql(rows, by, parts, reps)} {'GROUP BY ' + by if by else ''})"""


@query(f"SELECT coalesce(CAST(seed AS VARCHAR), 'all') AS seed, stage, CAST(sum(h) AS BIGINT) AS correct, count(*) AS n, round(avg(h), 6) AS accuracy FROM ({H}) GROUP BY GROUPING SETS ((seed, stage), (stage))")
def r061_stage_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stage_accuracy(matches(spark, d))


_PER = ", ".join(f"round(avg(h) FILTER (stage = '{s}'), 4) AS {s}" for s in STAGE_SET)


_COUNTS = ", ".join(f"count(*) FILTER (stage = '{s}') AS n_{s}" for s in STAGE_SET)


@query(f"""WITH p AS (SELECT {_PER}, round(avg(h), 4) AS all_macro, {_COUNTS} FROM ({HG})) SELECT kind, plan, search, compress, write, CASE WHEN kind = 'decisions' THEN all_macro ELSE round((plan + search + compress + write) / 4, 4) END AS macro,
 greatest(n_plan, n_search, n_compress, n_write) AS n, n_plan, n_search, n_compress, n_write, round(1.0 / 3, 6) AS chance FROM p, (VALUES ('decisions'), ('stages')) AS k(kind)""")
def r062_accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    m = gappy(spark, d)
    a, b = (metrics.accuracy_summary(m, k).withColumn("kind", F.lit(k)) for k in ("decisions", "stages"))
    return a.union(b)


@query(f"SELECT count(*) AS n_with_usage, CAST(sum(prompt_chars) AS BIGINT) AS prompt_chars FROM ({H}) WHERE prompt_chars >= 100")
def r062_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return metrics.usage_totals(matches(spark, d).withColumn("prompt_chars", F.when(F.col("prompt_chars") >= 100, F.col("prompt_chars"))), ["prompt_chars"])


@query(f"SELECT stage, round(avg(a), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_pop(a) END, 6) AS sd, round(min(a), 6) AS lowest, round(max(a), 6) AS highest, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds FROM (SELECT stage, seed, avg(h) AS a FROM ({H}) GROUP BY stage, seed) GROUP BY stage")
def r063_seed_variance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.seed_variance(matches(spark, d))


@query(f"SELECT n_correct, coalesce(c, 0) AS runs, round(coalesce(c, 0) / sum(coalesce(c, 0)) OVER (), 6) AS fraction FROM range(0, 5) AS r(n_correct) LEFT JOIN (SELECT k, count(*) AS c FROM (SELECT sum(h) AS k FROM ({H}) GROUP BY run_id) GROUP BY k) ON k = n_correct")
def r064_run_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.run_distribution(matches(spark, d))


@query(f"SELECT gt_userid, predicted_userid, stage, count(*) AS errors FROM ({H}) WHERE NOT correct GROUP BY ALL")
def r065_confusions(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusions(matches(spark, d))


@query(f"""WITH j AS (SELECT m.stage, m.h, s.run_id IS NOT NULL AS known, s.success_criteria_met, len(completeness_errors) AS c, len(ledger_errors) AS l FROM ({H}) m LEFT JOIN (SELECT * FROM ({SUMMARY}) WHERE taskid <> 3) s USING (run_id)),
p AS (SELECT 'all_matched' AS policy, stage, h FROM j UNION ALL SELECT 'success_criteria_met', stage, h FROM j WHERE success_criteria_met UNION ALL SELECT 'no_completeness_errors', stage, h FROM j WHERE known AND c = 0 UNION ALL SELECT 'no_ledger_errors', stage, h FROM j WHERE known AND l = 0)
SELECT policy, stage, CAST(sum(h) AS BIGINT) AS correct, count(*) AS n, round(avg(h), 6) AS accuracy FROM p GROUP BY policy, stage""")
def r066_quality_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quality_sensitivity(matches(spark, d), views.view(spark, d, views.SUMMARIES).where("taskid <> 3"))


@query("SELECT coalesce(domain, 'unknown') AS domain, " + ", ".join(f"round(avg(h) FILTER (stage = '{s}'), 6) AS {s}, count(*) FILTER (stage = '{s}') AS n_{s}" for s in STAGE_SET) + f", round(avg(h), 6) AS macro FROM ({H}) GROUP BY 1")
def r067_domain_stage_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.domain_stage_accuracy(matches(spark, d))


_SIZES = " UNION ALL ".join(f"SELECT {n} AS n_candidates, stage, CAST(correct AS INT) AS h FROM ({M[v]})" for n, v in ((2, 1), (3, 0), (5, 2)))
_PER6 = ", ".join(f"round(avg(h) FILTER (stage = '{s}'), 6) AS {s}" for s in STAGE_SET)


@query(f"""WITH p AS (SELECT n_candidates, {_PER6}, avg(h) AS a FROM ({_SIZES}) GROUP BY n_candidates)
SELECT n_candidates, plan, search, compress, write, round(1.0 / n_candidates, 6) AS chance, round(a, 6) AS average, round((a - 1.0 / n_candidates) / (1 - 1.0 / n_candidates), 6) AS normalized,
  search < plan AND write > search AS dip, round(search - plan, 6) AS plan_to_search, round(write - search, 6) AS search_to_write FROM p""")
def r068_candidate_size_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    parts = [matches(spark, d, v).withColumn("n_candidates", F.lit(n)) for n, v in ((2, 1), (3, 0), (5, 2))]
    return metrics.candidate_size_sensitivity(parts[0].union(parts[1]).union(parts[2]))


@query(f"""WITH p AS (SELECT protocol, {_PER6}, count(*) FILTER (stage = 'plan') AS n FROM (SELECT 'first' AS protocol, stage, CAST(correct AS INT) AS h FROM ({M[0]}) UNION ALL SELECT 'second', stage, CAST(correct AS INT) FROM ({M[1]})) GROUP BY protocol)
SELECT *, round(search - plan, 6) AS plan_to_search, round(write - search, 6) AS search_to_write FROM p""")
def r069_protocol_trajectory(spark: SparkSession, d: str) -> DataFrame:
    parts = [matches(spark, d, v).withColumn("protocol", F.lit(n)) for v, n in ((0, "first"), (1, "second"))]
    return metrics.protocol_trajectory(parts[0].union(parts[1]))


@query(f"SELECT stage, domain, count(*) AS n, CAST(sum(CAST(predicted_userid = 'User10' AS INT)) AS BIGINT) AS predicted, round(avg(CAST(predicted_userid = 'User10' AS INT)), 6) AS false_rate FROM ({H}) WHERE gt_userid <> 'User10' GROUP BY stage, domain")
def r070_attractor_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.attractor_rate(matches(spark, d), "User10", ("stage", "domain"))


@query(f"""WITH m AS (SELECT *, list_contains(candidate_userids, 'User10') AND gt_userid <> 'User10' AS o, predicted_userid = 'User10' AS x, gt_userid = 'User10' AS w FROM ({H}))
SELECT stage, count_if(o) AS exposed, count_if(o AND x) AS drawn, round(count_if(o AND x) / count_if(o), 6) AS false_rate, count_if(x) AS predicted, round(count_if(w AND correct) / count_if(w), 6) AS own_accuracy FROM m GROUP BY stage""")
def r071_attractor_exposure(spark: SparkSession, d: str) -> DataFrame:
    return metrics.attractor_exposure(matches(spark, d), "User10")


_LAG = f"SELECT run_id, taskid, stage AS to_stage, lag(stage) OVER w AS from_stage, lag(h) OVER w AS a, h AS b FROM ({H}) WINDOW w AS (PARTITION BY run_id ORDER BY stage_index)"


@query(f"SELECT from_stage, to_stage, count_if(a = 1 AND b = 1) AS kept, count_if(a = 1 AND b = 0) AS lost, count_if(a = 0 AND b = 1) AS gained, count_if(a = 0 AND b = 0) AS never, CAST(sum(b - a) AS BIGINT) AS net_gain FROM ({_LAG}) WHERE from_stage IS NOT NULL GROUP BY ALL")
def r072_transition_flows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.transition_flows(matches(spark, d))


@query(f"""WITH g AS (SELECT 'plan_ok_search_wrong' AS "group", * FROM ({PIVOT}) WHERE plan = 1 AND search = 0 UNION ALL SELECT 'search_wrong', * FROM ({PIVOT}) WHERE search = 0)
SELECT "group", count(*) AS runs, CAST(sum(compress) AS BIGINT) AS right_at_compress, CAST(sum(write) AS BIGINT) AS right_at_write, round(avg(write), 6) AS recovery_rate FROM g GROUP BY 1""")
def r073_recovery_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recovery_summary(matches(spark, d))


_LOST = f"SELECT run_id, domain, write = 1 AS recovered, compress FROM ({PIVOT}) WHERE plan = 1 AND search = 0"


@query(f"SELECT recovered, d AS domain, count(*) AS runs, round(avg(compress), 6) AS compress_accuracy FROM (SELECT recovered, compress, unnest([domain, 'all']) AS d FROM ({_LOST})) GROUP BY ALL")
def r074_recovery_profile(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recovery_profile(matches(spark, d))


@query(_LOST)
def r074_recovery_runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recovery_runs(matches(spark, d))


@query(f"""SELECT run_id, CASE WHEN plan = 1 AND search = 0 AND write = 1 THEN 'recovered' WHEN plan = 1 AND search = 0 AND write = 0 THEN 'non_recovered' WHEN plan = 1 AND search = 1 AND write = 1 THEN 'all_correct_prefix'
 WHEN write = 1 THEN 'write_correct_other' ELSE 'write_wrong_other' END AS pattern FROM ({PIVOT_GAPS})""")
def r075_outcome_pattern(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outcome_pattern(gappy(spark, d))


@query(f"""WITH p AS (SELECT DISTINCT taskid, gt_userid, (taskid + CAST(substr(gt_userid, 5) AS BIGINT)) % 2 = 0 AS good FROM ({H})), j AS (SELECT m.stage, m.h, p.good FROM ({H}) m JOIN p USING (taskid, gt_userid)),
s AS (SELECT 'all' AS subset, stage, h FROM j UNION ALL SELECT CASE WHEN good THEN 'prior_right' ELSE 'prior_wrong' END, stage, h FROM j) SELECT subset, stage, count(*) AS n, round(avg(h), 6) AS accuracy FROM s GROUP BY ALL""")
def r076_prior_adjusted(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    guess = ((F.col("taskid") + F.substring("gt_userid", 5, 9).cast("long")) % 2 == 0).alias("prior_correct")
    return metrics.prior_adjusted(m, m.select("taskid", "gt_userid", guess).distinct())


_SUBSETS = f"SELECT *, CASE WHEN (taskid + CAST(substr(gt_userid, 5) AS BIGINT)) % 2 = 0 THEN 'prior_right' ELSE 'prior_wrong' END AS part FROM ({PIVOT_GAPS})"
_PRIOR_SUMS = f"SELECT subset, taskid AS cluster, {SUMS} FROM (SELECT *, unnest(['all', part]) AS subset FROM ({_SUBSETS})) GROUP BY subset, taskid"


def _prior_measure(name: str, value: str) -> str:
    rows, parts = (f"SELECT * FROM ({_PRIOR_SUMS}) WHERE l > 0", "sum l, sum r") if name == "recovery_rate" else (_PRIOR_SUMS, PARTS)
    return f"SELECT p.subset, '{name}' AS measure, p.value, ci_low, ci_high FROM (SELECT subset, round({summed(value)}, 6) AS value FROM ({_PRIOR_SUMS}) GROUP BY subset) p JOIN {bootstrap_sql(rows, 'subset', parts, value, REPS)} b USING (subset)"


@query(" UNION ALL ".join(_prior_measure(k, v) for k, v in (VALUES | {"recovery_rate": "r / l"}).items()))
def r076_prior_trajectory(spark: SparkSession, d: str) -> DataFrame:
    m = gappy(spark, d)
    guess = ((F.col("taskid") + F.substring("gt_userid", 5, 9).cast("long")) % 2 == 0).alias("prior_correct")
    return metrics.prior_trajectory(m, m.select("taskid", "gt_userid", guess).distinct(), reps=REPS)


_FOLLOW = f"SELECT unnest(CASE WHEN taskid % 4 = 0 THEN ['all', 'strict'] ELSE ['all'] END) AS subset, stage, taskid, CASE WHEN predicted_userid = candidate_userids[2] THEN 'd' WHEN predicted_userid = gt_userid THEN 's' ELSE 'o' END AS k FROM ({H})"
_FOLLOW_MEANS = f"SELECT subset || '>' || stage AS pair, taskid AS cluster, avg(CAST(k = 'd' AS INT) - CAST(k = 's' AS INT)) AS s, 1 AS c FROM ({_FOLLOW}) GROUP BY ALL"


@query(f"""WITH c AS (SELECT subset, stage, count_if(k = 'd') AS donor, count_if(k = 's') AS shell, count_if(k = 'o') AS other, count(*) AS n FROM ({_FOLLOW}) GROUP BY ALL)
SELECT c.*, round(donor / n, 6) AS p_donor, round(shell / n, 6) AS p_shell, round((donor - shell) / n, 6) AS difference, {mcnemar('donor', 'shell')} AS p, ci_low, ci_high FROM c JOIN {bootstrap_sql(_FOLLOW_MEANS, 'pair', 'sum s, sum c', 's / c', REPS)} b ON b.pair = subset || '>' || stage""")
def r077_donor_following(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    donors = m.select("run_id", F.element_at("candidate_userids", 2).alias("donor")).distinct()
    return metrics.donor_following(m, donors, m.where("taskid % 4 = 0").select("run_id"), reps=REPS)


_ORDER = "string_agg(c, ',' ORDER BY sha256('0:' || run_id || ':' || stage || ':' || c))"


@query(f"""WITH o AS (SELECT run_id, stage, taskid, {_ORDER} AS e FROM (SELECT run_id, stage, taskid, unnest(candidate_userids) AS c FROM ({H})) GROUP BY ALL), s AS (SELECT *, CASE WHEN taskid % 6 = 1 THEN array_to_string(list_reverse(string_split(e, ',')), ',') ELSE e END AS g FROM o)
SELECT run_id, stage, g AS stored_order, e AS expected_order FROM s WHERE g <> e""")
def r077_order_mismatches(spark: SparkSession, d: str) -> DataFrame:
    from stagesignal.operators.candidates import candidate_order

    stored = candidate_order(matches(spark, d)).withColumn("shuffled_order", F.when(F.col("taskid") % 6 == 1, F.reverse("shuffled_order")).otherwise(F.col("shuffled_order")))
    return metrics.order_mismatches(stored).withColumns({c: F.concat_ws(",", c) for c in ("stored_order", "expected_order")})


@query(f"""WITH j AS (SELECT l.stage, l.predicted_userid AS pl, r.predicted_userid AS pr, CAST(l.correct AS INT) AS hl, CAST(r.correct AS INT) AS hr FROM ({M[0]}) l JOIN ({M[4]}) r USING (run_id, stage)),
a AS (SELECT stage AS scope, * FROM j UNION ALL SELECT 'all', * FROM j),
c AS (SELECT scope, count(*) AS n, count_if(pl = pr) AS same, CAST(sum(hl) AS BIGINT) AS left_correct, CAST(sum(hr) AS BIGINT) AS right_correct, CAST(sum(hl * hr) AS BIGINT) AS both_correct, CAST(sum(hl * (1 - hr)) AS BIGINT) AS left_only, CAST(sum((1 - hl) * hr) AS BIGINT) AS right_only FROM a GROUP BY scope),
x AS (SELECT scope, CAST(sum(nl * nr) AS BIGINT) AS product FROM (SELECT scope, pl AS label, count(*) AS nl FROM a GROUP BY ALL) JOIN (SELECT scope, pr AS label, count(*) AS nr FROM a GROUP BY ALL) USING (scope, label) GROUP BY scope)
SELECT scope, n, round(same / n, 6) AS observed, round(product / (n * n), 6) AS expected, round((same / n - product / (n * n)) / (1 - product / (n * n)), 6) AS kappa, left_correct, right_correct, both_correct, left_only, right_only FROM c JOIN x USING (scope)""")
def r078_agreement(spark: SparkSession, d: str) -> DataFrame:
    return metrics.agreement(matches(spark, d), matches(spark, d, 4))


JUDGE = """SELECT doc_id, doc_id % 40 AS taskid, doc_id % 2 AS seed, quality = 1 AS write_correct, n_chars % 5 + 1 AS content_personalization, (n_chars div 7) % 5 + 1 AS presentation_personalization,
  doc_id % 3 > 0 AS plan_correct, CASE WHEN doc_id % 7 > 0 THEN doc_id % 4 > 0 END AS search_correct, doc_id % 5 > 0 AS compress_correct, concat('pattern', doc_id % 3) AS pattern FROM documents JOIN labels USING (doc_id)"""
_J = f"SELECT *, (content_personalization + presentation_personalization) / 2 AS m, coalesce(write_correct, false) AS w FROM ({duck(JUDGE)})"
_SIDES = f"SELECT taskid AS cluster, coalesce(sum(m) FILTER (w), 0) AS ma, count(*) FILTER (w) AS ka, coalesce(sum(m) FILTER (NOT w), 0) AS mb, count(*) FILTER (NOT w) AS kb FROM ({_J}) GROUP BY taskid"


@query(f"""SELECT j.*, round(x.d, 6) AS delta, b.ci_low, b.ci_high FROM (SELECT count(*) AS n, round(avg(content_personalization), 6) AS content, round(avg(presentation_personalization), 6) AS presentation, round(avg(m), 6) AS mean_personalization, count_if(content_personalization = presentation_personalization) AS n_identical,
 round(avg(CAST(content_personalization = presentation_personalization AS INT)), 6) AS identical, round(corr(m, CAST(w AS INT)), 5) AS pearson FROM ({_J})) j, (SELECT avg(m) FILTER (w) - avg(m) FILTER (NOT w) AS d FROM ({_J})) x, {bootstrap_sql(_SIDES, '', 'sum ma, sum ka, sum mb, sum kb', 'ma / ka - mb / kb', REPS)} b""")
def r079_judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judge_summary(views.view(spark, d, JUDGE), reps=REPS)


@query(f"SELECT 'pattern' AS by, pattern AS value, count(*) AS n, round(avg(m), 6) AS mean_personalization FROM ({_J}) GROUP BY pattern UNION ALL SELECT 'write_correct', CAST(w AS VARCHAR), count(*), round(avg(m), 6) FROM ({_J}) GROUP BY w")
def r079_judge_means(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, JUDGE).withColumn("write_correct", F.coalesce("write_correct", F.lit(False)))
    parts = [metrics.judge_means(rows, by).withColumn("by", F.lit(by)).withColumnRenamed(by, "value").withColumn("value", F.col("value").cast("string")) for by in ("pattern", "write_correct")]
    return parts[0].unionByName(parts[1])


_SCOPED = f"SELECT 'all' AS scope, w AS r, m FROM ({_J}) UNION ALL SELECT 'seed=' || seed, w, m FROM ({_J}) UNION ALL " + " UNION ALL ".join(f"SELECT 'stage={s}', {s}_correct, m FROM ({_J}) WHERE {s}_correct IS NOT NULL" for s in STAGE_SET)


@query(f"SELECT scope, count_if(r) AS correct_n, count_if(NOT r) AS wrong_n, round(avg(m) FILTER (r), 6) AS correct_mean, round(avg(m) FILTER (NOT r), 6) AS wrong_mean, round(avg(m) FILTER (r) - avg(m) FILTER (NOT r), 6) AS delta FROM ({_SCOPED}) GROUP BY scope")
def r079_judge_deltas(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judge_deltas(views.view(spark, d, JUDGE))


@query(f"SELECT content_personalization AS score, count(*) AS n FROM ({duck(JUDGE)}) GROUP BY 1")
def r079_score_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score_distribution(views.view(spark, d, JUDGE), "content_personalization")


_PER_TASK = f"SELECT stage, taskid AS cluster, sum(h) AS s, count(*) AS c FROM ({H}) GROUP BY stage, taskid"


@query(f"SELECT p.stage, n, mean, ci_low, ci_high FROM (SELECT stage, count(*) AS n, round(avg(h), 6) AS mean FROM ({H}) GROUP BY stage) p JOIN {bootstrap_sql(_PER_TASK, 'stage', 'sum s, sum c', 's / c', REPS)} b USING (stage)")
def r083_cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_bootstrap(matches(spark, d), "taskid", metrics.hit(), ["stage"], reps=REPS)


_TASK_MEANS = f"SELECT stage, taskid AS cluster, avg(h) AS s, 1 AS c FROM ({H}) GROUP BY stage, taskid"


@query(f"SELECT p.stage, n, mean, ci_low, ci_high FROM (SELECT stage, count(*) AS n, round(avg(s), 6) AS mean FROM ({_TASK_MEANS}) GROUP BY stage) p JOIN {bootstrap_sql(_TASK_MEANS, 'stage', 'sum s, sum c', 's / c', REPS)} b USING (stage)")
def r084_cluster_bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_bootstrap_means(matches(spark, d), "taskid", metrics.hit(), ["stage"], reps=REPS)


_TWO = f"SELECT taskid AS cluster, coalesce(sum(h) FILTER (seed = 1), 0) AS s1, count(*) FILTER (seed = 1) AS n1, coalesce(sum(h) FILTER (seed = 0), 0) AS s0, count(*) FILTER (seed = 0) AS n0 FROM ({H}) GROUP BY taskid"


@query(f"SELECT round(sum(s1) / sum(n1) - sum(s0) / sum(n0), 6) AS difference, any_value(b.ci_low) AS ci_low, any_value(b.ci_high) AS ci_high FROM ({_TWO}), {bootstrap_sql(_TWO, '', 'sum s1, sum n1, sum s0, sum n0', 's1 / n1 - s0 / n0', REPS)} b")
def r085_cluster_bootstrap_contrast(spark: SparkSession, d: str) -> DataFrame:
    return stats.cluster_bootstrap_contrast(matches(spark, d), "taskid", metrics.hit(), F.col("seed") == 1, reps=REPS)


_STAGED = f"SELECT taskid AS cluster, {SUMS} FROM ({PIVOT_GAPS}) GROUP BY taskid"


def _staged_ci(value: str) -> str:
    return bootstrap_sql(_STAGED, "", PARTS, value, REPS)


@query(f"""SELECT (SELECT sum(s) / sum(ns) < sum(p) / sum(np) AND sum(w) / sum(nw) > sum(s) / sum(ns) FROM ({_STAGED})) AS observed, x.ci_low AS dip_low, x.ci_high AS dip_high, y.ci_low AS recovery_low, y.ci_high AS recovery_high, z.retained
FROM {_staged_ci('100 * (s / ns - p / np)')} x, {_staged_ci('100 * (w / nw - s / ns)')} y, (SELECT round(avg(CAST(coalesce(s / ns < p / np AND w / nw > s / ns, false) AS INT)), 6) AS retained FROM {resample_sql(_STAGED, '', PARTS, REPS)}) z""")
def r086_trajectory_retention(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.trajectory_retention(gappy(spark, d), reps=REPS)


def _staged(name: str, value: str) -> str:
    ends = bootstrap_sql(f"SELECT * FROM ({_STAGED}) WHERE l > 0", "", "sum l, sum r", value, REPS) if name == "recovery_rate" else _staged_ci(value)
    return f"SELECT '{name}' AS measure, (SELECT round({summed(value)}, 6) FROM ({_STAGED})) AS value, ci_low, ci_high FROM {ends}"


@query(" UNION ALL ".join(_staged(k, v) for k, v in (VALUES | {"recovery_rate": "r / l"}).items()))
def r087_trajectory_with_ci(spark: SparkSession, d: str) -> DataFrame:
    return trajectory.trajectory_with_ci(gappy(spark, d), reps=REPS)


@query("""WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS x, row_number() OVER (ORDER BY l_quantity) - 1 AS k, count(*) OVER () AS n FROM lineitem)
SELECT 'floor' AS rule, max(x) FILTER (k = CAST(floor(0.025 * n) AS BIGINT)) AS low, max(x) FILTER (k = CAST(floor(0.975 * n) AS BIGINT)) AS high FROM v
UNION ALL SELECT 'inner', max(x) FILTER (k = CAST(floor(0.025 * n) AS BIGINT)), max(x) FILTER (k = CAST(ceil(0.975 * n) AS BIGINT) - 1) FROM v
UNION ALL SELECT 'nearest', max(x) FILTER (k = CAST(round(0.025 * (n - 1)) AS BIGINT)), max(x) FILTER (k = CAST(round(0.975 * (n - 1)) AS BIGINT)) FROM v
UNION ALL SELECT 'linear', quantile_cont(x, 0.025), quantile_cont(x, 0.975) FROM v""")
def r088_percentile_ci(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_quantity")
    out = rows.agg(F.lit("linear").alias("rule"), F.percentile("l_quantity", 0.025).alias("low"), F.percentile("l_quantity", 0.975).alias("high"))
    ranks = stats.percentile_ranks(rows, "l_quantity", [(q, rule) for rule in ("floor", "inner", "nearest") for q in (0.025, 0.975)])
    return out.unionByName(ranks.groupBy("rule").agg(F.max(F.when(F.col("q") < 0.5, F.col("value"))).alias("low"), F.max(F.when(F.col("q") > 0.5, F.col("value"))).alias("high")))


_BC = f"SELECT taskid, domain, count_if(plan = 1 AND search = 0) AS b, count_if(plan = 0 AND search = 1) AS c FROM ({PIVOT}) GROUP BY ALL"


@query(f"SELECT taskid, b, c, {mcnemar('b', 'c')} AS p FROM ({_BC})")
def r089_mcnemar_exact(spark: SparkSession, d: str) -> DataFrame:
    runs = metrics.pivoted(matches(spark, d), ("run_id", "taskid"))
    per = runs.groupBy("taskid").agg(F.count_if((F.col("plan") == 1) & (F.col("search") == 0)).alias("b"), F.count_if((F.col("plan") == 0) & (F.col("search") == 1)).alias("c"))
    return per.withColumn("p", F.round(stats.mcnemar_exact("b", "c"), 6))


_ADJ = f"SELECT from_stage, to_stage, taskid, a, b FROM ({_LAG}) WHERE from_stage IS NOT NULL UNION ALL SELECT 'search', 'write', taskid, search, write FROM ({PIVOT})"
_ADJK = f"SELECT from_stage || '>' || to_stage AS pair, taskid AS cluster, sum(b - a) AS s, count(*) AS c FROM ({_ADJ}) GROUP BY ALL"


@query(f"""WITH k AS (SELECT from_stage, to_stage, count(*) AS n, CAST(sum(a * (1 - b)) AS BIGINT) AS lost, CAST(sum((1 - a) * b) AS BIGINT) AS gained, round(avg(b - a), 6) AS change FROM ({_ADJ}) GROUP BY ALL)
SELECT from_stage, to_stage, n, lost, gained, {mcnemar('lost', 'gained')} AS p, change, ci_low, ci_high FROM k JOIN {bootstrap_sql(_ADJK, 'pair', 'sum s, sum c', 's / c', REPS)} b ON b.pair = from_stage || '>' || to_stage""")
def r090_paired_stages(spark: SparkSession, d: str) -> DataFrame:
    return pairing.paired_stages(matches(spark, d), reps=REPS)


def _pair_sql(rows: str, keys: str, interval: bool = True) -> str:
    """rows(keys, cluster, a, b) compared per keys, with the cluster interval of a - b."""
    name = " || '>' || ".join(keys.split(", "))
    ends = bootstrap_sql(f"SELECT {name} AS pair, cluster, sum(a - b) AS s, count(*) AS c FROM ({rows}) GROUP BY ALL", "pair", "sum s, sum c", "s / c", REPS)
    return f"""WITH k AS (SELECT {keys}, count(*) AS n, CAST(sum(a) AS BIGINT) AS left_correct, CAST(sum(b) AS BIGINT) AS right_correct, CAST(sum(a * b) AS BIGINT) AS "both", CAST(sum(a * (1 - b)) AS BIGINT) AS left_only, CAST(sum((1 - a) * b) AS BIGINT) AS right_only FROM ({rows}) GROUP BY {keys})
SELECT k.*, round(left_correct / n, 6) AS left_accuracy, round(right_correct / n, 6) AS right_accuracy, round((left_correct - right_correct) / n, 6) AS difference, {mcnemar('left_only', 'right_only')} AS p{", ci_low, ci_high" if interval else ""} FROM k""" + (f" JOIN {ends} e ON e.pair = {name}" if interval else "")


_C01 = f"SELECT l.seed, l.stage, l.taskid AS cluster, CAST(l.correct AS INT) AS a, CAST(r.correct AS INT) AS b FROM ({M[0]}) l JOIN (SELECT * FROM ({M[1]}) WHERE taskid <> 7) r USING (run_id, stage)"


@query(_pair_sql(f"SELECT 'seed' || seed AS scope, stage, cluster, a, b FROM ({_C01}) UNION ALL SELECT 'all', stage, cluster, a, b FROM ({_C01})", "scope, stage"))
def r091_paired_conditions(spark: SparkSession, d: str) -> DataFrame:
    return pairing.paired_conditions(matches(spark, d), matches(spark, d, 1).where("taskid <> 7"), reps=REPS)


@query(f"SELECT run_id, stage, 'left' AS side FROM ({M[0]}) WHERE taskid = 7")
def r091_unpaired(spark: SparkSession, d: str) -> DataFrame:
    return pairing.unpaired(matches(spark, d), matches(spark, d, 1).where("taskid <> 7"), ["run_id", "stage"])


_METHODS = " UNION ALL ".join(f"SELECT '{n}' AS method, unnest(['seed' || l.seed, 'all']) AS scope, l.stage, l.taskid AS cluster, CAST(l.correct AS INT) AS a, CAST(r.correct AS INT) AS b FROM ({M[0]}) l JOIN ({M[v]}) r USING (run_id, stage)" for n, v in (("bm25", 3), ("embedding", 2), ("random", 4)))


@query(_pair_sql(_METHODS, "method, scope, stage"))
def r092_paired_methods(spark: SparkSession, d: str) -> DataFrame:
    return pairing.paired_methods(matches(spark, d), {"bm25": matches(spark, d, 3), "embedding": matches(spark, d, 2), "random": matches(spark, d, 4)}, reps=REPS)


@query(_pair_sql(f"SELECT a.stage, a.taskid AS cluster, a.h AS a, b.h AS b FROM ({H}) a JOIN ({H}) b ON regexp_replace(a.run_id, '_seed[0-9]+$', '') = regexp_replace(b.run_id, '_seed[0-9]+$', '') AND a.stage = b.stage AND a.seed = 1 AND b.seed = 0", "stage"))
def r093_paired_seeds(spark: SparkSession, d: str) -> DataFrame:
    return pairing.paired_seeds(matches(spark, d), reps=REPS)


_REGEN = f"SELECT l.run_id AS id, l.taskid AS cluster, l.write AS a, CAST(r.correct AS INT) AS b, r.prompt_chars * 10 < 2000 AS short, l.plan = 1 AND l.search = 0 AS lost_at_search FROM ({PIVOT}) l JOIN (SELECT * FROM ({M[1]}) WHERE stage = 'write') r USING (run_id)"


def _regenerated(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d, 1).withColumn("run_id", F.regexp_replace("run_id", "^pilot_", "ablation_no_brief_")).withColumn("report_chars", F.col("prompt_chars") * 10)


@query(_pair_sql(f"SELECT 'all' AS subset, cluster, a, b FROM ({_REGEN}) UNION ALL SELECT 'short_report', cluster, a, b FROM ({_REGEN}) WHERE short UNION ALL SELECT 'plan_ok_search_wrong', cluster, a, b FROM ({_REGEN}) WHERE lost_at_search", "subset"))
def r094_paired_regeneration(spark: SparkSession, d: str) -> DataFrame:
    return pairing.paired_regeneration(matches(spark, d), _regenerated(spark, d), reps=REPS)


@query(f"SELECT id, CASE WHEN a = 1 THEN 'lost' ELSE 'gained' END AS change, short, lost_at_search FROM ({_REGEN}) WHERE a <> b")
def r094_regeneration_changes(spark: SparkSession, d: str) -> DataFrame:
    return pairing.regeneration_changes(matches(spark, d), _regenerated(spark, d))


_SHOWN = "list_transform(list_sort(list_transform(candidate_userids, lambda c: struct_pack(h := sha256('0:' || run_id || ':' || stage || ':' || c), c := c))), lambda x: x.c)"
_OTHER = f"SELECT run_id, stage, gt_userid, CASE WHEN taskid % 7 = 0 THEN candidate_userids[1:2] ELSE list_reverse(candidate_userids) END AS c, CASE WHEN taskid % 3 = 0 OR stage = 'write' AND taskid % 5 = 0 THEN list_reverse({_SHOWN}) ELSE {_SHOWN} END AS o FROM ({M[1]}) WHERE taskid <> 11"


@query(f"""WITH j AS (SELECT run_id, stage, list_sort(l.candidate_userids) AS a, list_sort(r.c) AS b, l.gt_userid AS ga, r.gt_userid AS gb, l.o AS oa, r.o AS ob, l.run_id IS NOT NULL AS ina, r.run_id IS NOT NULL AS inb FROM (SELECT *, {_SHOWN} AS o FROM ({M[0]}) WHERE taskid <> 13) l FULL JOIN ({_OTHER}) r USING (run_id, stage)),
x AS (SELECT stage AS scope, * FROM j UNION ALL SELECT 'all', * FROM j),
k AS (SELECT scope, count_if(NOT inb) AS left_only, count_if(NOT ina) AS right_only, count_if(ina AND inb) AS paired, count_if(ina AND inb AND ga <> gb) AS truth_mismatches, count_if(ina AND inb AND a = b) AS same_set, count_if(ina AND inb AND oa = ob) AS same_order FROM x GROUP BY scope),
r AS (SELECT count(*) AS runs, count_if(e) AS runs_same_order FROM (SELECT run_id, bool_and(ina AND inb AND coalesce(oa = ob, false)) AS e FROM j GROUP BY run_id))
SELECT k.*, CASE WHEN scope = 'all' THEN runs END AS runs, CASE WHEN scope = 'all' THEN runs_same_order END AS runs_same_order, left_only + right_only + truth_mismatches = 0 AND same_set = paired AND same_order = paired AS comparable FROM k, r""")
def r095_comparability(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("taskid") % 7 == 0, F.slice("candidate_userids", 1, 2)).otherwise(F.reverse("candidate_userids"))
    left, right = (candidates.candidate_order(m) for m in (matches(spark, d).where("taskid <> 13"), matches(spark, d, 1).where("taskid <> 11")))
    turned = F.when(F.expr("taskid % 3 = 0 OR stage = 'write' AND taskid % 5 = 0"), F.reverse("shuffled_order")).otherwise(F.col("shuffled_order"))
    return pairing.comparability(left, right.withColumns({"candidate_userids": c, "shuffled_order": turned}))


_EXPECTED = f"SELECT DISTINCT taskid, gt_userid, CASE WHEN taskid = 5 THEN list_append(candidate_userids[1:2], 'User999') ELSE candidate_userids END AS e FROM ({M[0]}) WHERE taskid <> 9"


@query(f"""WITH r AS (SELECT run_id, any_value(taskid) AS taskid, any_value(gt_userid) AS gt_userid, count(DISTINCT list_sort(candidate_userids)) AS sets, min(list_sort(candidate_userids)) AS rec FROM ({M[0]}) GROUP BY run_id)
SELECT run_id, CASE WHEN sets > 1 THEN 'inconsistent' WHEN e IS NULL THEN 'no_experiment' ELSE 'mismatch' END AS problem, array_to_string(rec, ',') AS recorded, coalesce(array_to_string(list_sort(e), ','), '') AS expected FROM r LEFT JOIN ({_EXPECTED}) USING (taskid, gt_userid) WHERE sets > 1 OR e IS NULL OR rec <> list_sort(e)""")
def r096_audit_candidates(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    expected = F.when(F.col("taskid") == 5, F.array_append(F.slice("candidate_userids", 1, 2), F.lit("User999"))).otherwise(F.col("candidate_userids"))
    return pairing.audit_candidates(m, m.where("taskid <> 9").select("taskid", "gt_userid", expected.alias("expected")).distinct())


@query(f"SELECT e.run_id, CASE WHEN e.taskid % 2 = 0 THEN 'saved' WHEN e.taskid % 3 = 0 THEN 'current' END AS state, e.taskid % 2 <> 0 AND e.taskid % 3 <> 0 AS missing FROM ({duck(views.RUNS)}) e")
def r097_missing_units(spark: SparkSession, d: str) -> DataFrame:
    runs = views.view(spark, d, views.RUNS)
    part = lambda n, name: runs.where(F.col("taskid") % n == 0).select("run_id", F.lit(name).alias("state"))
    return pairing.missing_units(runs.select("run_id"), part(3, "current"), part(2, "saved"), ["run_id"], "state")


_DONE = "FILTER (schema_valid IS NOT NULL)"
_QS = f"""SELECT domain, count(*) {_DONE} AS completed, greatest(1600 - count(*), 0) AS missing, count_if(error <> '') AS error_runs, count_if(schema_valid) AS schema_valid, count_if(success_criteria_met AND schema_valid IS NOT NULL) AS success_met, count_if(len(completeness_errors) > 0 AND schema_valid IS NOT NULL) AS completeness_issues,
 count_if(len(ledger_errors) > 0 AND schema_valid IS NOT NULL) AS ledger_issues, count_if(execution_error IS NOT NULL AND schema_valid IS NOT NULL) AS execution_errors, {', '.join(f'CAST(coalesce(sum({c}) {_DONE}, 0) AS BIGINT) AS {c}' for c in ('total_tokens', 'elapsed_sec', 'queries_attempted', 'queries_successful', 'queries_failed', 'sources_selected'))} FROM ({SUMMARY}) GROUP BY domain"""


@query(_QS)
def r098_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_summary(views.view(spark, d, views.SUMMARIES), ["domain"], 1600)


@query(f"""WITH q AS ({_QS}), r AS (SELECT *, list_filter([CASE WHEN completed <> 1500 THEN 'run count' END, CASE WHEN schema_valid <> completed THEN 'schema' END, CASE WHEN completeness_issues > 2 THEN 'completeness issues' END, CASE WHEN ledger_issues <> 0 THEN 'ledger issues' END, CASE WHEN execution_errors <> 0 THEN 'execution errors' END], lambda x: x IS NOT NULL) AS reasons FROM q)
SELECT domain, array_to_string(reasons, ';') AS reasons, len(reasons) = 0 AS passed FROM r""")
def r099_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    summary = quality.quality_summary(views.view(spark, d, views.SUMMARIES), ["domain"], 1600)
    return quality.quality_gate(summary, 1500, 2).select("domain", F.concat_ws(";", "reasons").alias("reasons"), "passed")
