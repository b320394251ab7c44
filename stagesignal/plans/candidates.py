"""Queries over candidate construction, matchers and source overlap, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagesignal.functions import scalars as S
from stagesignal.operators import candidates, matchers, overlap
from stagesignal.plans import views
from stagesignal.plans.decisions import M, bootstrap_sql
from stagesignal.plans.registry import query
from stagesignal.plans.texts import _CATEGORY
from stagesignal.plans.views import duck, matches

RUNS = duck(views.RUNS)
QUERIES = """SELECT (o_orderkey div 2) % 50 AS taskid, concat('User', (o_orderkey div 2) div 50 % 40) AS userid, concat('domain', ((o_orderkey div 2) % 50) % 10) AS domain,
  CASE WHEN o_orderkey % 2000 = 1 THEN '' ELSE o_orderpriority END AS query, CASE WHEN (o_orderkey div 2) % 50 = 21 AND o_orderkey % 3 = 0 THEN NULL ELSE 'task' END AS task FROM (SELECT o_orderkey - o_orderkey % 4 * (o_orderkey % 3) AS o_orderkey, o_orderpriority FROM orders) AS o"""
_OWN = "SELECT DISTINCT 'User' || (o_custkey % 39) AS userid FROM orders"


@query(f"""WITH q AS (SELECT taskid, userid, count(*) AS n, count_if(coalesce(query, '') = '' OR coalesce(task, '') = '' OR coalesce(domain, '') = '') AS blank FROM ({duck(QUERIES)}) GROUP BY ALL), p AS (SELECT q.*, o.userid IS NOT NULL AS own FROM q LEFT JOIN ({_OWN}) o USING (userid)),
t AS (SELECT taskid, sum(blank) AS blank, flatten(list(list_transform(range(1, n), lambda i: 'dup_' || userid) ORDER BY 'dup_' || userid) FILTER (n > 1)) AS dups, count_if(own) AS kept FROM p GROUP BY taskid)
SELECT taskid, kept AS kept_users, array_to_string(list_concat(CASE WHEN blank > 0 THEN ['empty_field'] ELSE [] END, coalesce(dups, []), CASE WHEN kept < 3 THEN ['insufficient_actionable_personas'] ELSE [] END), ',') AS reasons,
 blank = 0 AND dups IS NULL AND kept >= 3 AS eligible FROM t""")
def r045_eligible_tasks(spark: SparkSession, d: str) -> DataFrame:
    owners = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("User"), (F.col("o_custkey") % 39).cast("string")).alias("userid"))
    return candidates.eligible_tasks(views.view(spark, d, QUERIES), owners)


def _quota(rows: str, key: str, weight: str, total: int) -> str:
    return f"""(WITH s AS (SELECT {key}, {weight} * {total} / sum({weight}) OVER () AS share FROM ({rows})), f AS (SELECT {key}, CAST(floor(share) AS BIGINT) AS lo, round(share - floor(share), 12) AS rest FROM s),
 g AS (SELECT *, row_number() OVER (ORDER BY rest DESC, {key}) AS place, {total} - sum(lo) OVER () AS missing FROM f) SELECT {key}, lo + CASE WHEN place <= missing THEN 1 ELSE 0 END AS quota FROM g)"""


_BY_NATION = "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey"


@query(f"SELECT * FROM {_quota(_BY_NATION, 'c_nationkey', 'n', 137)}")
def r046_largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    sizes = spark.read.parquet(f"{d}/customer.parquet").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return candidates.largest_remainder(sizes, "c_nationkey", "n", 137)


@query(f"SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('5|' || c_custkey)) AS k FROM customer) JOIN {_quota(_BY_NATION, 'c_nationkey', 'n', 137)} USING (c_nationkey) WHERE k <= quota")
def r047_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return candidates.stratified_sample(spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 137, 5)


_DEV = _quota(_BY_NATION, "c_nationkey", "n", 20)
_REST = f"SELECT c_nationkey, n - quota AS n FROM ({_BY_NATION}) JOIN {_DEV} USING (c_nationkey)"
_CONF = _quota(_REST, "c_nationkey", "n", 60)
_ABL = _quota(f"SELECT c_nationkey, quota AS n FROM {_CONF}", "c_nationkey", "n", 15)


@query(f"""WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('5|' || c_custkey)) AS k FROM customer),
q AS (SELECT c_nationkey, d.quota AS d, c.quota AS c, a.quota AS a FROM {_DEV} d JOIN {_CONF} c USING (c_nationkey) JOIN {_ABL} a USING (c_nationkey))
SELECT c_nationkey, c_custkey, CASE WHEN k <= d THEN 'dev' ELSE 'confirmatory' END AS split, CASE WHEN k > d AND k <= d + a THEN 'ablation' END AS subset FROM r JOIN q USING (c_nationkey) WHERE k <= d + c""")
def r047_stratified_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", "c_custkey")
    return candidates.stratified_splits(rows, "c_nationkey", "c_custkey", [("dev", 20), ("confirmatory", 60)], 5, [("ablation", "confirmatory", 15)])


@query("SELECT c_nationkey, c_custkey, CAST(k AS INTEGER) AS place FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('5|' || c_nationkey || '|' || c_custkey)) AS k FROM customer) WHERE k <= 3")
def r048_pick_members(spark: SparkSession, d: str) -> DataFrame:
    return candidates.pick_members(spark.read.parquet(f"{d}/customer.parquet").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 3, 5)


_GROUPED = "SELECT o_custkey AS g, o_orderkey AS k FROM orders"


@query(f"""WITH r AS ({_GROUPED}), c AS (SELECT g, count(*) AS n FROM r GROUP BY g), w AS (SELECT g FROM (SELECT g, sum(n) OVER (ORDER BY g) AS upto FROM c WHERE n = 3) WHERE upto <= 100),
t AS (SELECT * FROM r WHERE g IN (SELECT g FROM w)) SELECT * FROM t UNION ALL (SELECT * FROM r WHERE g NOT IN (SELECT g FROM w) ORDER BY g, k LIMIT (SELECT greatest(0, 100 - count(*)) FROM t))""")
def r048_complete_groups(spark: SparkSession, d: str) -> DataFrame:
    return candidates.complete_groups(views.view(spark, d, _GROUPED), "g", "k", 3, 100)


@query("SELECT c_mktsegment, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('9|' || c_custkey)) AS k FROM customer WHERE c_custkey % 10 <> 0) WHERE k <= 50")
def r049_sample_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_mktsegment", "c_custkey")
    return candidates.sample_pool(rows, rows.where("c_custkey % 10 = 0"), "c_mktsegment", "c_custkey", 50, 9).select("c_mktsegment", "c_custkey")


_PROF = f"SELECT doc_id, userid, domain, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains([{', '.join(chr(39) + w + chr(39) for w in S.ACTIONABLE_STOP)}], t))) AS toks FROM ({duck(views.PROFILES)})"
#: The profiles that ask for negatives among all others.
_TARGETS = "SELECT userid FROM p WHERE doc_id % 100 = 0"


def _negatives(k: int) -> str:
    return f"""WITH p AS MATERIALIZED ({_PROF}), t AS ({_TARGETS}), s AS (SELECT a.userid AS target, b.userid, round(CASE WHEN len(list_distinct(list_concat(a.toks, b.toks))) = 0 THEN 0 ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) END, 4) AS jaccard, n - 1 < 2 AS fallback_pool
 FROM t JOIN p a USING (userid) JOIN (SELECT domain, count(*) AS n FROM p GROUP BY domain) c USING (domain) JOIN p b ON b.userid <> a.userid AND (b.domain = a.domain OR n - 1 < 2)),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY jaccard DESC, userid) AS rank FROM s)
SELECT target, CAST(rank AS INTEGER) AS rank, userid, jaccard, CASE WHEN jaccard >= 0.2 THEN 'hard_negative' ELSE 'nearest_fallback' END AS pool, fallback_pool FROM r WHERE rank <= {k}"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    toks = F.array_distinct(S.tokens(F.col("text"), "actionable"))
    return views.view(spark, d, views.PROFILES).select("doc_id", "userid", "domain", toks.alias("tokens"))


def _ranked(spark: SparkSession, d: str, k: int) -> DataFrame:
    profiles = _profiles(spark, d)
    return candidates.hard_negatives(profiles.where("doc_id % 100 = 0"), profiles.drop("doc_id"), k)


@query(_negatives(2))
def r050_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, 2)


@query(f"WITH r AS ({_negatives(4)}), l AS (SELECT target, list_prepend(target, list(userid ORDER BY rank)) AS c FROM r GROUP BY target) SELECT target, CAST(n AS INTEGER) AS n, array_to_string(c[1:n], ',') AS candidates FROM l, (VALUES (2), (3), (5)) AS s(n) WHERE len(c) >= n")
def r051_candidate_sets(spark: SparkSession, d: str) -> DataFrame:
    return candidates.candidate_sets(_ranked(spark, d, 4)).withColumn("candidates", F.concat_ws(",", "candidates"))


_FROZEN = f"SELECT target, CASE WHEN CAST(substr(target, 5) AS BIGINT) % 300 = 0 THEN [target, l[2], l[1]] ELSE list_prepend(target, l[1:2]) END AS frozen, list_prepend(target, l[1:2]) AS recomputed FROM (SELECT target, list(userid ORDER BY rank) AS l FROM ({_negatives(4)}) GROUP BY target)"


@query(f"SELECT target, array_to_string(recomputed, ',') AS recomputed, array_to_string(frozen, ',') AS frozen FROM ({_FROZEN}) WHERE recomputed <> frozen")
def r051_frozen_mismatches(spark: SparkSession, d: str) -> DataFrame:
    sets = candidates.candidate_sets(_ranked(spark, d, 4))
    c = F.col("candidates")
    frozen = sets.where("n = 3").select("target", F.when(F.expr("CAST(substr(target, 5) AS BIGINT) % 300 = 0"), F.array(c[0], c[2], c[1])).otherwise(c).alias("frozen"))
    return candidates.frozen_mismatches(sets, frozen).withColumns({n: F.concat_ws(",", n) for n in ("recomputed", "frozen")})


@query(f"SELECT run_id, array_to_string(CASE WHEN seed = 1 THEN ['User0', 'User1', 'User2'] ELSE [userid, 'User' || (unum + 1), 'User' || (unum + 2)] END, ',') AS candidates, seed = 0 OR unum <= 2 AS valid FROM ({RUNS})")
def r052_lookup_candidates(spark: SparkSession, d: str) -> DataFrame:
    runs = views.view(spark, d, views.RUNS)
    own = runs.where("seed = 0").select("taskid", F.col("userid").alias("gt_userid"), F.array(F.col("userid"), F.concat(F.lit("User"), (F.col("unum") + 1).cast("string")), F.concat(F.lit("User"), (F.col("unum") + 2).cast("string"))).alias("candidates"), F.array(F.lit("User0"), F.lit("User1"), F.lit("User2")).alias("group_users"))
    asked = runs.select("run_id", "taskid", "userid", F.when(F.col("seed") == 1, "shuffled_actionable").otherwise("full").alias("condition"))
    return candidates.lookup_candidates(asked, own).withColumn("candidates", F.concat_ws(",", "candidates"))


@query(f"SELECT run_id, stage, string_agg(c, ',' ORDER BY sha256('0:' || run_id || ':' || stage || ':' || c)) AS shuffled_order FROM (SELECT run_id, stage, unnest(candidate_userids) AS c FROM ({M[0]})) GROUP BY run_id, stage")
def r053_candidate_order(spark: SparkSession, d: str) -> DataFrame:
    return candidates.candidate_order(matches(spark, d)).select("run_id", "stage", F.concat_ws(",", "shuffled_order").alias("shuffled_order"))


@query()
def r053_candidate_order_mersenne(spark: SparkSession, d: str) -> DataFrame:
    return candidates.candidate_order(matches(spark, d), "mersenne").select("run_id", "stage", "shuffled_order")


_MEMBERS = f"SELECT doc_id AS set_id, 'User' || doc_id AS gt_userid, 'User' || u AS userid, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS toks FROM (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id + 2]) AS u FROM documents) s JOIN (SELECT doc_id AS k, text FROM documents) t ON t.k = s.u"


@query(f"""WITH m AS ({_MEMBERS}), j AS (SELECT a.set_id, a.gt_userid, a.userid, CASE WHEN len(list_distinct(list_concat(a.toks, b.toks))) = 0 THEN 0 ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) END AS j FROM m a JOIN m b USING (set_id) WHERE a.userid <> b.userid),
c AS (SELECT set_id, gt_userid, userid, round(avg(j), 6) AS centrality FROM j GROUP BY ALL), r AS (SELECT *, round(centrality - lead(centrality) OVER w, 6) AS margin, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY set_id ORDER BY centrality DESC, userid))
SELECT set_id, gt_userid, userid AS guess, centrality, margin, userid = gt_userid AS prior_correct FROM r WHERE k = 1""")
def r054_centrality_prior(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    sets = docs.select(F.col("doc_id").alias("set_id"), F.concat(F.lit("User"), F.col("doc_id").cast("string")).alias("gt_userid"), F.explode(F.array(*[F.col("doc_id") + k for k in range(3)])).alias("k"))
    toks = docs.select(F.col("doc_id").alias("k"), F.array_distinct(F.transform(S.tokens(F.col("text")), lambda t: F.xxhash64(t))).alias("tokens"))
    return candidates.centrality_prior(sets.join(toks, "k").select("set_id", "gt_userid", F.concat(F.lit("User"), F.col("k").cast("string")).alias("userid"), "tokens"))


_TURNS = "SELECT conv_id * 1000 + turn AS k, role, text FROM conversations"


@query(f"""SELECT 'pilot_task' || c.k || '_User' || (c.k + p) || '_seed' || s AS run_id, c.k AS id, 'User' || (c.k + p) AS userid, CAST(s AS INTEGER) AS seed, CAST(p AS INTEGER) AS position, p = 0 AS is_gt, sha256(c.text) AS prompt_hash,
 sha256('[{{"id":"' || i.k || '","category":"' || i.role || '","text":"t' || length(i.text) || '"}}]') AS profile_hash FROM ({_TURNS}) c, range(0, 3) AS a(p), range(0, 2) AS b(s) LEFT JOIN ({_TURNS}) i ON i.k = c.k + p""")
def r055_run_plan(spark: SparkSession, d: str) -> DataFrame:
    turns = views.view(spark, d, _TURNS)
    user = lambda n: F.concat(F.lit("User"), (F.col("k") + n).cast("string"))
    sets = turns.select(F.col("k").alias("id"), user(0).alias("gt_userid"), F.col("text").alias("question"), F.array(user(0), user(1), user(2)).alias("candidates"))
    item = F.struct(F.col("k").cast("string").alias("id"), F.col("role").alias("category"), F.concat(F.lit("t"), F.length("text").cast("string")).alias("text"), F.lit("secret").alias("rubric"))
    return candidates.run_plan(sets, turns.select(user(0).alias("userid"), F.array(item).alias("items")), (0, 1))


@query(f"SELECT run_id, stage, candidate_userids[CAST(('0x' || substr(sha256('0:' || run_id || ':' || stage), 1, 16))::UBIGINT % 3 AS INTEGER) + 1] AS predicted_userid FROM ({M[0]})")
def r056_match_random(spark: SparkSession, d: str) -> DataFrame:
    return matchers.match_random(matches(spark, d)).select("run_id", "stage", "predicted_userid")


_DEC = "SELECT doc_id, 'run' || (doc_id // 4) AS run_id, 's' || (doc_id % 4) AS stage, text FROM documents WHERE doc_id + 2 IN (SELECT doc_id FROM documents)"
_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda t: t <> '')"


@query(f"""WITH d AS ({_DEC}), c AS (SELECT doc_id AS set_id, p AS pos, doc_id + p AS u FROM d, range(0, 3) AS r(p)), k AS (SELECT doc_id AS u, {_TERMS.format('text')} AS t FROM documents),
l AS (SELECT u, len(t) AS dl FROM k), f AS (SELECT u, term, count(*) AS tf FROM (SELECT u, unnest(t) AS term FROM k) GROUP BY ALL), i AS (SELECT set_id, pos, u, term, tf FROM c JOIN f USING (u)),
e AS (SELECT set_id, term, ln(3 - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM i GROUP BY ALL), m AS (SELECT set_id, 0.25 * avg(idf) AS low FROM e GROUP BY set_id), a AS (SELECT set_id, avg(dl) AS avgdl FROM c JOIN l USING (u) GROUP BY set_id),
q AS (SELECT doc_id AS set_id, term, count(*) AS qtf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM d) GROUP BY ALL),
s AS (SELECT i.set_id, i.pos, round(sum(qtf * CASE WHEN idf < 0 THEN low ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM i JOIN q USING (set_id, term) JOIN e USING (set_id, term) JOIN m USING (set_id) JOIN a USING (set_id) JOIN l USING (u) GROUP BY ALL),
r AS (SELECT c.set_id, c.u, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY c.set_id ORDER BY coalesce(score, 0.0) DESC, c.pos) AS k FROM c LEFT JOIN s USING (set_id, pos))
SELECT d.run_id, d.stage, 'User' || u AS predicted_userid, round(score, 6) AS score FROM r JOIN d ON d.doc_id = r.set_id WHERE k = 1""")
def r057_match_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    user = lambda k: F.concat(F.lit("User"), (F.col("doc_id") + k).cast("string"))
    full = docs.join(docs.select((F.col("doc_id") - 2).alias("doc_id")), "doc_id", "left_semi")
    dec = full.select(F.concat(F.lit("run"), F.expr("doc_id div 4").cast("string")).alias("run_id"), F.concat(F.lit("s"), (F.col("doc_id") % 4).cast("string")).alias("stage"), "text", F.array(user(0), user(1), user(2)).alias("candidate_userids"))
    return matchers.match_bm25(dec, docs.select(user(0).alias("userid"), "text")).withColumn("score", F.round("score", 6))


_N = "(SELECT count(*) FROM embeddings)"


@query(f"""WITH c AS (SELECT q.vec_id, p, (q.vec_id + p) % {_N} AS u, q.embedding AS v FROM embeddings q, range(1, 4) AS r(p)), s AS (SELECT c.vec_id, p, u, round(list_dot_product(v::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 9) AS score FROM c JOIN embeddings e ON e.vec_id = c.u),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, p) AS k FROM s) SELECT 'run' || vec_id AS run_id, 'plan' AS stage, 'User' || u AS predicted_userid, round(score, 6) AS score FROM r WHERE k = 1""")
def r058_match_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    n = e.count()
    user = lambda k: F.concat(F.lit("User"), ((F.col("vec_id") + k) % n).cast("string"))
    dec = e.select(F.concat(F.lit("run"), F.col("vec_id").cast("string")).alias("run_id"), F.lit("plan").alias("stage"), F.col("embedding").alias("v"), F.array(user(1), user(2), user(3)).alias("candidate_userids"))
    return matchers.match_embedding(dec, e.select(user(0).alias("userid"), F.col("embedding").alias("w"))).withColumn("score", F.round("score", 6))


@query(f"""WITH o AS (SELECT run_id, stage, any_value(gt_userid) AS gt_userid, any_value(prompt_chars) AS n, list(c ORDER BY sha256('0:' || run_id || ':' || stage || ':' || c)) AS o FROM (SELECT *, unnest(candidate_userids) AS c FROM ({M[0]})) GROUP BY run_id, stage),
p AS (SELECT *, CASE WHEN n % 4 = 3 THEN 'UNKNOWN' ELSE o[CAST(n % 4 + 1 AS INTEGER)] END AS predicted_userid FROM o)
SELECT run_id, stage, gt_userid, n AS prompt_chars, array_to_string(o, ',') AS shuffled_order, ['A', 'B', 'C', 'Z'][CAST(n % 4 + 1 AS INTEGER)] AS predicted_label, n // 4 AS input_tokens, CAST(1 AS BIGINT) AS output_tokens, predicted_userid, predicted_userid = gt_userid AS correct FROM p""")
def r059_match_with(spark: SparkSession, d: str) -> DataFrame:
    import pandas as pd

    def choose(batch: pd.DataFrame) -> pd.DataFrame:  # stands in for a model: picks by the prompt's length
        return pd.DataFrame({"predicted_label": ["ABCZ"[n % 4] for n in batch["prompt_chars"]], "input_tokens": batch["prompt_chars"] // 4, "output_tokens": 1})

    rows = candidates.candidate_order(matches(spark, d)).select("run_id", "stage", "gt_userid", "prompt_chars", "shuffled_order")
    return matchers.match_with(rows, choose).withColumn("shuffled_order", F.concat_ws(",", "shuffled_order"))


_COS = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])))"


@query(f"""WITH v AS (SELECT 'domain' || (a.label % 3) AS domain, a.vec_id % 2 = 0 AS ok, {_COS.format('a.embedding', 'b.embedding')} AS pb, {_COS.format('a.embedding', 'c.embedding')} AS pq, {_COS.format('b.embedding', 'c.embedding')} AS bq FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % {_N} JOIN embeddings c ON c.vec_id = (a.vec_id + 2) % {_N}),
s AS (SELECT 'all' AS scope, * FROM v UNION ALL SELECT 'domain=' || domain, * FROM v UNION ALL SELECT 'search_correct=' || CAST(ok AS VARCHAR), * FROM v)
SELECT scope, count(*) AS n, round(avg(pb), 6) AS profile_brief, round(avg(pq), 6) AS profile_query, round(avg(bq), 6) AS brief_query, round(avg(pb) - avg(pq), 6) AS "drop" FROM s GROUP BY scope""")
def r060_semantic_retention(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    n = e.count()
    shifted = lambda k, name: e.select(((F.col("vec_id") - k + n) % n).alias("vec_id"), F.col("embedding").alias(name))
    rows = e.select("vec_id", F.concat(F.lit("domain"), (F.col("label") % 3).cast("string")).alias("domain"), (F.col("vec_id") % 2 == 0).alias("search_correct"), F.col("embedding").alias("profile"))
    return matchers.semantic_retention(rows.join(shifted(1, "brief"), "vec_id").join(shifted(2, "query"), "vec_id"))


TRACE = duck(views.TRACE)
_Q = "nullif(trim(regexp_replace(lower(query), '\\s+', ' ', 'g')), '')"
_U = "regexp_replace(lower(regexp_extract(link, '^([^:]+://[^/]*)', 1)) || regexp_extract(link, '^[^:]+://[^/]*([^#]*)', 1), '/+$', '')"
_HOSTS = "lower(regexp_extract(link, '^[^:]+://([^/]*)', 1))"
_NAMES = ("retail_books", "video", "encyclopedia", "academic", "forum", "course_platform", "gov", "blog", "other_web", "unknown")
_SHARES = ", ".join(f"round(avg(CAST({_CATEGORY} = '{c}' AS INT)), 6) AS share_{c}" for c in _NAMES)
_GEN = " OR ".join(f"contains(lower(query), '{p}')" for p in (
    "best books", "best practices", "how to", "what is", "overview of", "introduction to", "top 10", "isbn", "pdf", "course", "tutorial", "guide to",
    "list of", "vs ", "versus", "review of", "definition of", "examples of", "methods for", "strategies for", "techniques for", "workbook", "textbook", "syllabus"))
_STOPS = ", ".join(f"'{w}'" for w in (
    "a an the and or of in to for is are was were he she they his her their it this that with on at by from as has have had not but also been which who when where what how its be do does did "
    "i my me we our you your can will would should may into than then so if about more most other").split())
_PARTS = "list_filter([" + ", ".join(f"CASE WHEN share_{c} > 0 THEN greatest(1.0, round(100 * share_{c})) END" for c in _NAMES) + "], lambda x: x IS NOT NULL)"
# The brief of a run is the comment-like text of its order; its profile's buckets are the names and the brands of its parts.
_BRIEFS = "SELECT l_orderkey AS run, concat(p_name, ' ', p_type) AS text FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1"
_WORDS = f"SELECT run, w, count(*) AS n FROM (SELECT run, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM ({TRACE})) WHERE length(w) > 2 AND w NOT IN ({_STOPS}) GROUP BY ALL"
_MECH = f"""SELECT * EXCLUDE (c), round(log2(list_sum(c)) - list_sum(list_transform(c, lambda x: x * log2(x))) / list_sum(c), 5) + 0.0 AS category_entropy FROM (SELECT *, {_PARTS} AS c FROM (WITH x AS (SELECT run, query, trim(query) AS q, {_HOSTS} AS h FROM ({TRACE})), c AS ({_WORDS}),
s AS (SELECT run, sum(n) AS m, count(*) AS k FROM c GROUP BY run), e AS (SELECT run, round(-sum(n / m * log2(n / m)), 5) + 0.0 AS entropy, round(any_value(k) / any_value(m), 6) AS ttr, any_value(k) AS k, CAST(any_value(m) AS BIGINT) AS m FROM c JOIN s USING (run) GROUP BY run),
j AS (SELECT run, w, count(*) AS n FROM (SELECT run, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM ({_BRIEFS})) WHERE length(w) > 2 AND w NOT IN ({_STOPS}) GROUP BY ALL),
g AS (SELECT run, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 5) + 0.0 AS bits FROM j GROUP BY run)
SELECT x.run, count(*) AS queries, count(DISTINCT q) AS unique_queries, round(count(DISTINCT q) / count(*), 6) AS unique_ratio, CAST(sum(length(query)) AS BIGINT) AS chars, round(avg(length(query)), 6) AS mean_query_chars, round(avg(CAST({_GEN} AS INT)), 6) AS generic_rate, count(DISTINCT h) AS hosts, {_SHARES},
 coalesce(any_value(entropy), 0.0) AS entropy, coalesce(any_value(ttr), 0.0) AS type_token_ratio, coalesce(any_value(k), 0) AS unique_tokens, coalesce(any_value(m), 0) AS token_count, coalesce(any_value(bits), 0.0) AS brief_entropy FROM x LEFT JOIN e USING (run) LEFT JOIN g USING (run) GROUP BY x.run))"""


def _mechanism(spark: SparkSession, d: str) -> DataFrame:
    return overlap.search_mechanism_rows(views.view(spark, d, views.TRACE), views.view(spark, d, _BRIEFS))


@query(_MECH)
def r080_search_mechanism_rows(spark: SparkSession, d: str) -> DataFrame:
    return _mechanism(spark, d)


def _right(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 3 == 0).alias("search_correct"))


_LESS = ", ".join(f"round(avg({c}) FILTER (run % 3 = 0) - avg({c}) FILTER (run % 3 <> 0), 4) AS {c}" for c in overlap.SUMMED)


@query(f"""WITH r AS ({_MECH}), s AS (SELECT 'all' AS scope, * FROM r UNION ALL SELECT CASE WHEN run % 3 = 0 THEN 'search_correct' ELSE 'search_wrong' END, * FROM r)
SELECT scope, count(*) AS runs, {', '.join(f'round(avg({c}), 4) AS {c}' for c in overlap.SUMMED)} FROM s GROUP BY scope UNION ALL SELECT 'right_less_wrong', count(*), {_LESS} FROM r""")
def r080_search_mechanism_summary(spark: SparkSession, d: str) -> DataFrame:
    return overlap.search_mechanism_summary(_mechanism(spark, d), _right(spark, d))


@query(f"SELECT run, queries, hosts FROM ({_MECH}) ORDER BY hosts DESC, run LIMIT 5")
def r080_top_cases(spark: SparkSession, d: str) -> DataFrame:
    return overlap.top_cases(_mechanism(spark, d), "hosts").select("run", "queries", "hosts")


_BUCKETS = "SELECT l_orderkey AS run, 'identity' AS bucket, p_name AS value FROM lineitem JOIN part ON p_partkey = l_partkey UNION ALL SELECT l_orderkey, 'interests', concat(p_type, ' ', p_brand) FROM lineitem JOIN part ON p_partkey = l_partkey"
_SEARCHED = lambda text, rows: f"SELECT DISTINCT run, t FROM (SELECT run, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS t FROM ({rows})) WHERE length(t) > 2 AND t NOT IN ({_STOPS})"
_RETENTION = f"""WITH w AS (SELECT DISTINCT run, bucket, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS t FROM ({_BUCKETS})), b AS ({_SEARCHED('text', _BRIEFS)}), q AS ({_SEARCHED('query', f'SELECT run, query FROM ({TRACE})')})
SELECT w.run, bucket, count(*) AS tokens, round(count(b.t) / count(*), 6) AS brief, round(count(q.t) / count(*), 6) AS query, round((count(b.t) - count(q.t)) / count(*), 6) AS lost FROM w LEFT JOIN b ON b.run = w.run AND b.t = w.t LEFT JOIN q ON q.run = w.run AND q.t = w.t GROUP BY w.run, bucket"""


def _retention(spark: SparkSession, d: str) -> DataFrame:
    buckets = views.view(spark, d, _BUCKETS).select("run", "bucket", S.tokens(F.col("value")).alias("tokens"))
    return overlap.bucket_retention(views.view(spark, d, views.TRACE).select("run", "query"), views.view(spark, d, _BRIEFS), buckets)


@query(_RETENTION)
def r080_bucket_retention(spark: SparkSession, d: str) -> DataFrame:
    return _retention(spark, d)


@query(f"SELECT scope, bucket, count(*) AS runs, round(avg(brief), 4) AS brief, round(avg(query), 4) AS query, round(avg(lost), 4) AS lost FROM (SELECT *, unnest(['all', CASE WHEN run % 3 = 0 THEN 'search_correct' ELSE 'search_wrong' END]) AS scope FROM ({_RETENTION})) GROUP BY ALL")
def r080_bucket_summary(spark: SparkSession, d: str) -> DataFrame:
    return overlap.bucket_summary(_retention(spark, d), _right(spark, d))


_REASONED = "CASE stage WHEN 'plan' THEN 'Clearly Candidate A, only it.' WHEN 'search' THEN 'Perhaps Candidate A or candidate B; it might be B.' ELSE concat('Candidate C after ', prompt_chars) END"


@query(f"SELECT stage, count(*) AS n, round(avg(CASE stage WHEN 'plan' THEN 2.5 WHEN 'search' THEN -1.0 ELSE 0.5 END), 6) AS certainty, round(avg(CASE stage WHEN 'plan' THEN 1 ELSE 0 END), 6) AS has_strong, round(avg(CASE stage WHEN 'search' THEN 1 ELSE 0 END), 6) AS has_hedge, round(avg(CASE stage WHEN 'search' THEN 2 ELSE 1 END), 6) AS named, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({M[0]}) GROUP BY stage")
def r080_certainty_by_stage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.certainty_by_stage(matches(spark, d).withColumn("reasoning", F.expr(_REASONED)))


_OUT = "SELECT o_orderkey AS run, CAST(o_custkey % 3 > 0 AS INT) AS plan, CAST(o_custkey % 5 > 2 AS INT) AS search, CAST(o_custkey % 7 > 1 AS INT) AS write FROM orders"


@query(f"SELECT m.run, generic_rate, coalesce(lost, 0.0) AS lost, mean_query_chars FROM ({_MECH}) m JOIN ({_OUT}) o USING (run) LEFT JOIN (SELECT run, lost FROM ({_RETENTION}) WHERE bucket = 'identity') r USING (run) WHERE plan = 1 AND search = 0 AND write = 1 ORDER BY generic_rate DESC, lost DESC, mean_query_chars DESC, m.run LIMIT 5")
def r080_recovery_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = _mechanism(spark, d)
    return overlap.recovery_cases(rows, _retention(spark, d), views.view(spark, d, _OUT), "identity")


def _stable(item: str) -> str:
    return f"""WITH u AS (SELECT DISTINCT 'task' || (o_orderkey // 2 // 3) AS taskid, 'User' || (o_orderkey // 2 % 3) AS userid, o_orderkey % 2 AS seed FROM orders), i AS (SELECT taskid, userid, seed, list(DISTINCT {item}) AS s FROM ({TRACE}) WHERE attempted GROUP BY ALL), f AS (SELECT u.*, coalesce(s, []) AS s FROM u LEFT JOIN i USING (taskid, userid, seed)),
p AS (SELECT taskid, a.userid = b.userid AS same, CASE WHEN len(a.s) + len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END AS j FROM f a JOIN f b USING (taskid) WHERE (a.userid = b.userid AND a.seed < b.seed) OR (a.userid < b.userid AND a.seed = b.seed))
SELECT taskid, round(avg(j) FILTER (same), 6) AS within, round(avg(j) FILTER (NOT same), 6) AS between, round(avg(j) FILTER (same) - avg(j) FILTER (NOT same), 6) AS difference, count_if(same) AS within_pairs, count_if(NOT same) AS between_pairs FROM p GROUP BY taskid"""


def _stability(spark: SparkSession, d: str, kind: str) -> DataFrame:
    units = views.view(spark, d, "SELECT DISTINCT concat('task', o_orderkey div 2 div 3) AS taskid, concat('User', o_orderkey div 2 % 3) AS userid, o_orderkey % 2 AS seed FROM orders")
    return overlap.source_stability(views.view(spark, d, views.TRACE), units, kind)


@query(_stable(_U).replace("AS between,", 'AS "between",'))
def r081_source_stability(spark: SparkSession, d: str) -> DataFrame:
    return _stability(spark, d, "urls")


@query(_stable(_Q).replace("AS between,", 'AS "between",'))
def r081_query_stability(spark: SparkSession, d: str) -> DataFrame:
    return _stability(spark, d, "queries")


_PER_TASK = _stable(_U).replace("AS between,", 'AS "between",')
_GAPS = f"SELECT taskid AS cluster, difference AS s, 1 AS c FROM ({_PER_TASK})"


@query(f"""SELECT count(*) AS tasks, round(avg(within), 6) AS within, round(avg("between"), 6) AS "between", round(avg(difference), 6) AS difference, CAST(sum(within_pairs) AS BIGINT) AS within_pairs, CAST(sum(between_pairs) AS BIGINT) AS between_pairs FROM ({_PER_TASK})""")
def r081_stability_means(spark: SparkSession, d: str) -> DataFrame:
    return overlap.stability_means(_stability(spark, d, "urls"))


@query(f"SELECT p.n, p.mean, b.ci_low, b.ci_high FROM (SELECT count(*) AS n, round(avg(s), 6) AS mean FROM ({_GAPS})) p, {bootstrap_sql(_GAPS, '', 'sum s, sum c', 's / c', 300)} b")
def r081_stability_interval(spark: SparkSession, d: str) -> DataFrame:
    """300 resamples: the SQL has a row for each of them and task."""
    return overlap.stability_interval(_stability(spark, d, "urls"), 300)


@query(f"""WITH i AS (SELECT DISTINCT taskid, userid, {_U} AS url FROM ({TRACE}) WHERE attempted), m AS (SELECT taskid, count(DISTINCT userid) AS members, count(*) AS total FROM i GROUP BY taskid), k AS (SELECT taskid, url, count(*) AS k FROM i GROUP BY ALL)
SELECT taskid, members, count(*) AS "union", count_if(k = 1) AS single, count_if(k = members) AS common, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS pairwise_shared, round(count_if(k = 1) / count(*), 6) AS unique_fraction, round(any_value(total) / any_value(members), 6) AS mean_per_member,
 round(CASE WHEN members > 1 THEN 2 * sum(k * (k - 1) // 2) / ((members - 1) * any_value(total)) END, 6) AS mean_overlap, round(CASE WHEN members > 1 THEN 1 - 2 * sum(k * (k - 1) // 2) / ((members - 1) * any_value(total)) END, 6) AS mean_apart FROM k JOIN m USING (taskid) GROUP BY taskid, members""")
def r082_source_diversity(spark: SparkSession, d: str) -> DataFrame:
    return overlap.source_diversity(views.view(spark, d, views.TRACE))
