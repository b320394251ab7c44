"""Queries over nested profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagesignal.functions import scalars
from stagesignal.operators import profiles
from stagesignal.plans import views
from stagesignal.plans.registry import query
from stagesignal.plans.views import duck

BODIES = """SELECT concat('User', c_custkey) AS userid, c_custkey, c_nationkey, to_json(named_struct('Basic', named_struct('Name', c_name, 'Nation', n_name),
  'Likes', named_struct('Segment', c_mktsegment, 'Budget', CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING), 'Tags', array(n_name, c_mktsegment)))) AS body
FROM customer JOIN nation ON n_nationkey = c_nationkey"""
_PARTS = [("'userid'", "'userid'", "'User' || c_custkey"), ("'Basic>Name'", "'Name'", "c_name"), ("'Basic>Nation'", "'Nation'", "n_name"), ("'Likes>Segment'", "'Segment'", "c_mktsegment"),
          ("'Likes>Budget'", "'Budget'", "CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)"), ("'Likes>Tags'", "'Tags'", "n_name"), ("'Likes>Tags'", "'Tags'", "c_mktsegment")]
LEAVES = " UNION ALL ".join(f"SELECT 'User' || c_custkey AS userid, c_custkey, {k} AS pos, {p} AS path, {key} AS key, {v} AS value FROM customer JOIN nation ON n_nationkey = c_nationkey" for k, (p, key, v) in enumerate(_PARTS))
IDENTITY = "('Name', 'Nation')"
KEYS = ("Name", "Nation")


def leaves(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile_leaves(views.view(spark, d, BODIES))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("userid", "pos", F.concat_ws(">", "path").alias("path"), "key", "value")


@query("SELECT run_id, true AS valid, 'pilot' AS prefix, NULL::VARCHAR AS condition, CAST(taskid AS VARCHAR) AS taskid, userid, CAST(seed AS VARCHAR) AS seed FROM (" + duck(views.RUNS) + ") UNION ALL SELECT 'x' || run_id, false, NULL, NULL, NULL, NULL, NULL FROM (" + duck(views.RUNS) + ") WHERE taskid = 1 UNION ALL SELECT replace(run_id, 'pilot', 'ablation_no_brief'), true, 'ablation', 'no_brief', CAST(taskid AS VARCHAR), userid, CAST(seed AS VARCHAR) FROM (" + duck(views.RUNS) + ") WHERE taskid = 2")
def r010_parse_run_id(spark: SparkSession, d: str) -> DataFrame:
    runs = views.view(spark, d, views.RUNS).select("run_id", "taskid")
    odd = runs.where("taskid = 1").select(F.concat(F.lit("x"), "run_id").alias("run_id"), "taskid")
    other = runs.where("taskid = 2").select(F.replace("run_id", F.lit("pilot"), F.lit("ablation_no_brief")).alias("run_id"), "taskid")
    return runs.union(odd).union(other).select("run_id", scalars.parse_run_id(F.col("run_id")).alias("p")).select("run_id", "p.*").withColumns({c: F.col(c).cast("string") for c in ("taskid", "seed")})


@query("SELECT run_id AS canonical, count(*) AS n FROM (" + duck(views.RUNS) + ") GROUP BY 1")
def r011_canonical_run_id(spark: SparkSession, d: str) -> DataFrame:
    runs = views.view(spark, d, views.RUNS).select(F.when(F.col("seed") == 0, F.regexp_replace("run_id", "^pilot_", "ablation_other_brief_")).otherwise(F.col("run_id")).alias("r"))
    return runs.groupBy(scalars.canonical_run_id(F.col("r")).alias("canonical")).agg(F.count("*").alias("n"))


@query(f"SELECT userid, CAST(pos AS INTEGER) AS pos, path, key, value FROM ({LEAVES})")
def r012_profile_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _flat(leaves(spark, d))


@query(f"""WITH l AS (SELECT userid, pos, split_part(path, '>', 1) AS s, split_part(path, '>', 2) || ': ' || value AS line FROM ({LEAVES}) WHERE pos > 0), b AS (SELECT userid, s, '=== ' || s || ' ===' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS t FROM l GROUP BY userid, s)
SELECT userid, string_agg(t, chr(10) ORDER BY s DESC) AS text FROM b GROUP BY userid""")
def r013_profile_text(spark: SparkSession, d: str) -> DataFrame:
    return profiles.profile_text(leaves(spark, d), ["Likes", "Basic"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS condition, userid, path, value FROM ({LEAVES}) WHERE {w}" for c, w in (("full", "true"), ("actionable_only", f"key NOT IN {IDENTITY}"), ("identity_only", f"key IN {IDENTITY} OR key = 'userid'"))))
def r014_project_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = leaves(spark, d)
    parts = [profiles.project_profile(rows, c, KEYS).select(F.lit(c).alias("condition"), "userid", F.concat_ws(">", "path").alias("path"), "value") for c in ("full", "actionable_only", "identity_only")]
    return parts[0].union(parts[1]).union(parts[2])


_NESTED = """CASE k WHEN 'identity_only' THEN '"Basic":{"Name":"' || c_name || '","Nation":"' || n_name || '"}}' ELSE '"Likes":{"Segment":"' || c_mktsegment || '","Budget":"' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '","Tags":["' || n_name || '","' || c_mktsegment || '"]}}' END"""


@query(f"""SELECT k AS condition, 'User' || c_custkey AS userid, '{{"userid":"User' || c_custkey || '",' || {_NESTED} AS body FROM customer JOIN nation ON n_nationkey = c_nationkey, (VALUES ('identity_only'), ('actionable_only')) AS v(k)""")
def r014_project_bodies(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, BODIES).select("userid", "body")
    parts = [profiles.project_bodies(rows, c, KEYS).select(F.lit(c).alias("condition"), "userid", "body") for c in ("identity_only", "actionable_only")]
    return parts[0].union(parts[1])


_DONOR = "SELECT c_nationkey, 'User' || c_custkey AS userid, coalesce(lead('User' || c_custkey) OVER w, first_value('User' || c_custkey) OVER w) AS d FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)"


@query(f"SELECT c_nationkey, userid, CASE WHEN d <> userid THEN d END AS donor FROM ({_DONOR})")
def r015_cyclic_donor(spark: SparkSession, d: str) -> DataFrame:
    groups = views.view(spark, d, "SELECT c_custkey, c_nationkey, concat('User', c_custkey) AS userid FROM customer")
    return profiles.cyclic_donor(groups, "c_nationkey", "userid", "c_custkey").select("c_nationkey", "userid", "donor")


def _composed(spark: SparkSession, d: str) -> DataFrame:
    return profiles.compose_shuffled(leaves(spark, d), r015_cyclic_donor(spark, d).where("donor is not null"), KEYS)


_COMPOSED = f"SELECT userid, path, value FROM ({LEAVES}) WHERE key IN {IDENTITY} OR key = 'userid' UNION ALL SELECT g.userid, path, value FROM ({LEAVES}) l JOIN ({_DONOR}) g ON l.userid = g.d WHERE key NOT IN {IDENTITY} AND key <> 'userid'"


@query(_COMPOSED)
def r016_compose_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return _composed(spark, d).select("userid", F.concat_ws(">", "path").alias("path"), "value")


@query(f'SELECT userid, path, count(DISTINCT value) AS "values" FROM ({_COMPOSED}) GROUP BY userid, path HAVING count(DISTINCT value) > 1')
def r016_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return profiles.conflicts(_composed(spark, d))


@query(f"""SELECT userid, count(*) AS leaves, CAST(sum(length(value)) AS BIGINT) AS chars, count_if(key IN {IDENTITY}) AS identity_leaves, count_if(key NOT IN {IDENTITY} AND key <> 'userid') AS other_leaves,
 sha256(string_agg(path || '=' || value, chr(10) ORDER BY path || '=' || value)) AS projection_hash, '' AS violations FROM ({LEAVES}) GROUP BY userid""")
def r017_audit_profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.audit_profiles(leaves(spark, d), KEYS)


_LENT = f"SELECT g.userid, g.d AS donor, key, path, value FROM ({_DONOR}) g JOIN ({LEAVES}) l ON l.userid = g.d WHERE g.d <> g.userid AND key NOT IN {IDENTITY} AND key <> 'userid'"


@query(f"""WITH b AS (SELECT userid, key, value FROM ({LEAVES}) WHERE key <> 'userid'), g AS (SELECT userid, d AS donor FROM ({_DONOR}) WHERE d <> userid),
p AS (SELECT 'actionable_only' AS condition, userid, NULL AS donor, key, value FROM b WHERE key NOT IN {IDENTITY} UNION ALL SELECT 'identity_only', userid, NULL, key, value FROM b WHERE key IN {IDENTITY}
 UNION ALL SELECT 'shuffled_actionable', b.userid, donor, key, value FROM b JOIN g USING (userid) WHERE key IN {IDENTITY} UNION ALL SELECT 'shuffled_actionable', userid, donor, key, value FROM ({_LENT}))
SELECT condition, userid, donor, count(*) AS leaves, CAST(sum(length(value)) AS BIGINT) AS chars, coalesce(string_agg(DISTINCT key, ',' ORDER BY key) FILTER (key IN {IDENTITY}), '') AS identity_keys, coalesce(string_agg(DISTINCT key, ',' ORDER BY key) FILTER (key NOT IN {IDENTITY}), '') AS other_keys,
 CASE WHEN condition = 'shuffled_actionable' THEN true END AS identity_is_shells, CASE WHEN condition = 'shuffled_actionable' THEN true END AS actionable_is_donors, '' AS violations FROM p GROUP BY condition, userid, donor""")
def r017_audit_projections(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.audit_projections(leaves(spark, d), r015_cyclic_donor(spark, d).where("donor is not null"), KEYS)
    return out.withColumns({c: F.concat_ws(",", c) for c in ("identity_keys", "other_keys", "violations")})


@query(f"""WITH t AS (SELECT DISTINCT userid, CASE split_part(path, '>', 1) WHEN 'Basic' THEN 'who' WHEN 'Likes' THEN 'what' END AS bucket, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS t FROM ({LEAVES}))
SELECT userid, bucket, string_agg(t, ' ' ORDER BY t) AS tokens FROM t WHERE bucket IS NOT NULL GROUP BY ALL""")
def r018_feature_buckets(spark: SparkSession, d: str) -> DataFrame:
    out = profiles.feature_buckets(leaves(spark, d), {"who": ["Basic"], "what": ["Likes"]}, scalars.tokens(F.col("value")))
    return out.withColumn("tokens", F.concat_ws(" ", "tokens"))


@query(f"SELECT run_id, taskid FROM ({duck(views.RUNS)}) WHERE seed = 1 AND taskid IN (2, 7, 12, 22, 27)")
def r019_filter_split(spark: SparkSession, d: str) -> DataFrame:
    runs = views.view(spark, d, views.RUNS).select("run_id", "taskid")
    return profiles.filter_split(runs, 1, runs.where(F.col("taskid").isin(2, 7, 12, 22, 27)).select("taskid").distinct()).select("run_id", "taskid")
