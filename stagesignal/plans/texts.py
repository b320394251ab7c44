"""Queries over texts, URLs, masking and leakage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagesignal.functions import scalars as S
from stagesignal.operators import texts
from stagesignal.plans import views
from stagesignal.plans.profiles import BODIES, LEAVES, leaves
from stagesignal.plans.registry import query
from stagesignal.plans.views import duck

FOUR = "SELECT doc_id div 4 AS r, " + ", ".join(f"max(CASE WHEN doc_id % 4 = {k} THEN text END) AS {n}" for k, n in enumerate("bscw")) + " FROM documents GROUP BY doc_id div 4"
_SOURCE = "named_struct('query', s, 'title', concat('Title {0} ', length(s)), 'link', concat('https://a.example/', r), 'domain', 'a.example', 'rank', 1, 'snippet', s)"
ARTIFACTS = f"""SELECT concat('pilot_task', r, '_User1_seed0') AS run_id, r, b AS research_brief, w AS final_report,
  array(named_struct('topic_id', 'topic_001', 'query_id', 'q1', 'query', s, 'attempted', true, 'status', CASE WHEN r % 5 = 0 THEN 'failed' ELSE 'ok' END, 'sources', array({_SOURCE.format(1)}, {_SOURCE.format(2)})),
        named_struct('topic_id', 'topic_002', 'query_id', 'q2', 'query', concat('about ', s), 'attempted', true, 'status', 'success', 'sources', array({_SOURCE.format(3)}))) AS search_trace,
  array(named_struct('topic_id', 'topic_001', 'topic_text', 'first', 'compressed_research', c)) AS compressed_research
FROM ({FOUR}) WHERE s IS NOT NULL"""
_F = f"SELECT * FROM ({duck(FOUR)}) WHERE s IS NOT NULL"
_LINE = "chr(10) || '  • Title {0} ' || length(s) || ': ' || left(s, 200)"
_SEARCH = f"CASE WHEN r % 5 = 0 THEN '' ELSE 'Query [topic_001]: ' || s || {_LINE.format(1)} || {_LINE.format(2)} || chr(10) END || 'Query [topic_002]: about ' || s || {_LINE.format(3)}"
_ID = "'pilot_task' || r || '_User1_seed0' AS run_id"
_STAGES = lambda search, compress: f"SELECT {_ID}, 'plan' AS stage, b AS text FROM ({_F}) UNION ALL SELECT {_ID}, 'search', {search} FROM ({_F}) UNION ALL SELECT {_ID}, 'compress', {compress} FROM ({_F}) UNION ALL SELECT {_ID}, 'write', w FROM ({_F})"
_DIGEST = "run_id, stage, length(text) AS chars, md5(text) AS digest"


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, ARTIFACTS)


def _digest(df: DataFrame) -> DataFrame:
    return df.select("run_id", "stage", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


_CAPPED = "SELECT run_id, stage, left(text, CASE stage WHEN 'plan' THEN 4000 WHEN 'search' THEN 3500 WHEN 'compress' THEN 6000 ELSE 8000 END) AS text"


@query(f"SELECT {_DIGEST} FROM ({_CAPPED} FROM ({_STAGES(_SEARCH, chr(39) + '## topic_001' + chr(39) + ' || chr(10) || coalesce(c, ' + chr(39) * 2 + ')')}) WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')")
def r020_stage_text(spark: SparkSession, d: str) -> DataFrame:
    return _digest(texts.stage_text(artifacts(spark, d)))


@query(f"SELECT {_DIGEST} FROM ({_STAGES("s || ' about ' || s", 'c')}) WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def r021_baseline_stage_text(spark: SparkSession, d: str) -> DataFrame:
    return _digest(texts.baseline_stage_text(artifacts(spark, d)))


@query(f"""SELECT 'run' || doc_id AS run_id, stage, CASE stage WHEN 'search' THEN md5('Retrieved sources [topic_001]:' || chr(10) || '  • ' || substr(t, 11, 50) || ': ' || substr(t, 1, 200) || chr(10) || '  • The: ' || substr(t, 51, 200)) ELSE md5(substr(t, 1, 60) || ' ' || substr(t, 61, 60)) END AS digest
FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g') AS t FROM documents WHERE text IS NOT NULL), (VALUES ('search'), ('baseline')) AS v(stage) WHERE stage = 'search' OR trim(substr(t, 1, 120)) <> ''""")
def r020_search_views(spark: SparkSession, d: str) -> DataFrame:
    """Result lines without queries, and the baselines' queries without results, of artifacts with one successful query; blank texts are dropped."""
    rows = views.view(spark, d, _NEST)
    good = rows.withColumn("search_trace", F.transform("search_trace", lambda q, i: q.withField("status", F.when(i == 0, "ok").otherwise("failed"))))
    told = texts.stage_text(good, "snippets").where("stage = 'search'").select("run_id", "stage", F.md5("text").alias("digest"))
    return told.unionByName(texts.baseline_stage_text(rows).where("stage = 'search'").select("run_id", F.lit("baseline").alias("stage"), F.md5("text").alias("digest")))


@query("SELECT doc_id, md5(left(text, 500)) AS prefix, md5(CASE WHEN length(text) <= 500 THEN text ELSE left(text, 375) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(text, 125) END) AS head_tail FROM documents")
def r022_truncate_text(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", *[F.md5(S.truncate_text(F.col("text"), 500, m)).alias(m) for m in ("prefix", "head_tail")])


_PROMPTS = f"SELECT x.run_id, x.stage, 1200 + any_value(length(x.text)) + sum(coalesce(p.chars, 0)) AS chars FROM (SELECT run_id, stage, text, unnest(['User' || r, 'User' || (r + 1), 'User' || (r + 2)]) AS userid FROM (SELECT *, CAST(regexp_extract(run_id, 'task([0-9]+)', 1) AS BIGINT) AS r FROM ({_STAGES("s || ' about ' || s", 'c')}) WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')) x LEFT JOIN (SELECT userid, sum(length(value)) AS chars FROM ({LEAVES}) GROUP BY userid) p USING (userid) GROUP BY x.run_id, x.stage"


@query(f"SELECT stage, count(*) AS calls, CAST(sum(chars) AS BIGINT) AS chars, CAST(max(chars) AS BIGINT) AS longest FROM ({_PROMPTS}) GROUP BY stage")
def r023_estimate_prompts(spark: SparkSession, d: str) -> DataFrame:
    task = F.regexp_extract("run_id", "task([0-9]+)", 1).cast("long")
    decisions = texts.baseline_stage_text(artifacts(spark, d)).withColumn("candidate_userids", F.array(*[F.concat(F.lit("User"), (task + k).cast("string")) for k in range(3)]))
    return texts.estimate_prompts(decisions, leaves(spark, d).groupBy("userid").agg(F.sum(F.length("value")).alias("chars")))


@query(f"SELECT {_ID}, md5('## first' || chr(10) || coalesce(c, '')) AS digest FROM ({_F})")
def r024_findings_text(spark: SparkSession, d: str) -> DataFrame:
    return artifacts(spark, d).select("run_id", F.md5(texts.findings_text()).alias("digest"))


_SET = "SELECT DISTINCT 'set' || (c_custkey % 40) AS set_id, userid FROM"
_PHRASES = f"""SELECT set_id, string_agg(p, '|' ORDER BY -length(p), low) AS phrases FROM (SELECT 'set' || (c_custkey % 40) AS set_id, lower(trim(p)) AS low, min(trim(p)) AS p FROM (
 SELECT c_custkey, key, unnest(list_concat([value], CASE WHEN key = 'Name' THEN string_split(value, ' ') ELSE [] END, regexp_split_to_array(value, '\\s*[.;]\\s*'))) AS p FROM ({LEAVES}) WHERE key IN ('Name', 'Nation', 'Segment'))
 WHERE length(trim(p)) >= 3 AND (len(string_split(trim(p), ' ')) >= 2 OR key = 'Name') GROUP BY 1, 2) GROUP BY set_id"""


def phrases(spark: SparkSession, d: str) -> DataFrame:
    rows = leaves(spark, d)
    sets = views.view(spark, d, BODIES).select(F.concat(F.lit("set"), (F.col("c_custkey") % 40).cast("string")).alias("set_id"), "userid")
    return texts.identity_phrases(rows.where(F.col("key").isin("Name", "Nation", "Segment")), sets)


@query(_PHRASES)
def r025_identity_phrases(spark: SparkSession, d: str) -> DataFrame:
    return phrases(spark, d).withColumn("phrases", F.concat_ws("|", "phrases"))


MASKED = ("in the", "of the", "the")
_ONE = "regexp_replace({0}, '(?i)\\b({1})\\b', '[M]', 'g')"
_COUNT = "len(regexp_extract_all({0}, '(?i)\\b({1})\\b'))"
_PLAIN = "(SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g') AS t FROM documents)"


@query(f"""WITH a AS (SELECT doc_id, {_ONE.format('t', 'in +the')} AS u, {_COUNT.format('t', 'in +the')} AS n FROM {_PLAIN}), b AS (SELECT doc_id, {_ONE.format('u', 'of +the')} AS u, n + {_COUNT.format('u', 'of +the')} AS n FROM a)
SELECT doc_id, md5({_ONE.format('u', 'the')}) AS digest, CAST(n + {_COUNT.format('u', 'the')} AS BIGINT) AS masked FROM b""")
def r026_mask_phrases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace("text", "[^A-Za-z0-9 ]", " ").alias("text"), F.array(*map(F.lit, MASKED)).alias("phrases"))
    return texts.mask_phrases(rows, "[M]").select("doc_id", F.md5("text").alias("digest"), "masked")


_BODY = """'{"Basic":{"Name":"' || c_name || '","Nation":"' || n_name || '"},"Likes":{"Segment":"' || c_mktsegment || '","Budget":"' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '","Tags":["' || n_name || '","' || c_mktsegment || '"]}}'"""


@query(f"SELECT 'User' || c_custkey AS userid, md5(replace({_BODY}, n_name, '[GPE]')) AS digest, CAST((length({_BODY}) - length(replace({_BODY}, n_name, ''))) // length(n_name) AS BIGINT) AS entities FROM customer JOIN nation ON n_nationkey = c_nationkey")
def r027_mask_entities(spark: SparkSession, d: str) -> DataFrame:
    names = {r["n_name"]: "GPE" for r in spark.read.parquet(f"{d}/nation.parquet").collect()}  # 25 rows in any size
    bodies = views.view(spark, d, BODIES).select("userid", F.col("body").alias("text"))
    return texts.mask_entities(bodies, texts.phrase_tagger(names)).select("userid", F.md5("text").alias("digest"), "entities")


#: Each document as a nested artifact: brief, two queries of two sources, two compressed texts, report.
_NEST = """SELECT concat('run', doc_id) AS run_id, concat('set', doc_id % 3) AS set_id, t AS research_brief,
  array(named_struct('topic_id', 'topic_001', 'query', substring(t, 1, 60), 'sources', array(named_struct('query', substring(t, 1, 60), 'title', substring(t, 11, 50), 'link', 'l1', 'snippet', substring(t, 1, 200)), named_struct('query', 'in the end', 'title', 'The', 'link', 'the', 'snippet', substring(t, 51, 200)))),
    named_struct('topic_id', 'the topic', 'query', substring(t, 61, 60), 'sources', array())) AS search_trace,
  array(named_struct('topic_id', 'topic_001', 'compressed_research', substring(t, 21, 300)), named_struct('topic_id', 'topic_002', 'compressed_research', CAST(NULL AS STRING))) AS compressed_research, concat(t, ' of  the ', t) AS final_report
  FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 ]', ' ') AS t FROM documents WHERE text IS NOT NULL) AS d"""
_SETS = {"set0": ("the", "in the", "of the"), "set1": ("an", "the"), "set2": ()}
_PARTS_OF = [("plan", "t"), ("search", "substr(t, 1, 60)"), ("search", "substr(t, 11, 50)"), ("search", "substr(t, 1, 200)"), ("search", "'in the end'"), ("search", "'The'"), ("search", "substr(t, 51, 200)"), ("search", "substr(t, 61, 60)"), ("compress", "substr(t, 21, 300)"), ("write", "t || ' of  the ' || t")]
_FIELDS = f"SELECT doc_id, CAST(i AS INT) AS i, stage, doc_id % 3 AS s, x FROM (SELECT doc_id, unnest([{', '.join(f'struct_pack(i := {i}, stage := {chr(39)}{st}{chr(39)}, x := {x})' for i, (st, x) in enumerate(_PARTS_OF))}], recursive := true) FROM {_PLAIN} WHERE t IS NOT NULL)"
_STEPS = f"""f AS ({_FIELDS}), a AS (SELECT *, CASE s WHEN 0 THEN {_ONE.format('x', 'in +the').replace('[M]', '[MASKED]')} WHEN 1 THEN {_ONE.format('x', 'the').replace('[M]', '[MASKED]')} ELSE x END AS x1, CASE s WHEN 0 THEN {_COUNT.format('x', 'in +the')} WHEN 1 THEN {_COUNT.format('x', 'the')} ELSE 0 END AS n1 FROM f),
b AS (SELECT *, CASE s WHEN 0 THEN {_ONE.format('x1', 'of +the').replace('[M]', '[MASKED]')} WHEN 1 THEN {_ONE.format('x1', 'an').replace('[M]', '[MASKED]')} ELSE x1 END AS x2, CASE s WHEN 0 THEN {_COUNT.format('x1', 'of +the')} WHEN 1 THEN {_COUNT.format('x1', 'an')} ELSE 0 END AS n2 FROM a),
c AS (SELECT *, CASE s WHEN 0 THEN {_ONE.format('x2', 'the').replace('[M]', '[MASKED]')} ELSE x2 END AS x3, n1 + n2 + CASE s WHEN 0 THEN {_COUNT.format('x2', 'the')} ELSE 0 END AS n FROM b)"""


def _mask_all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = views.view(spark, d, _NEST)
    lists = spark.createDataFrame([(k, list(v)) for k, v in _SETS.items()], "set_id string, phrases array<string>")
    return texts.mask_artifacts(rows.drop("set_id"), rows.select("run_id", "set_id"), lists)


@query(f"""WITH {_STEPS}, g AS (SELECT doc_id, list(x3 ORDER BY i) AS m FROM c GROUP BY doc_id) SELECT 'run' || doc_id AS run_id, md5(array_to_string(m, '|')) AS digest, 'l1,the' AS links, 'the topic' AS topic, CAST(2 AS INTEGER) AS notes FROM g""")
def r028_mask_artifacts(spark: SparkSession, d: str) -> DataFrame:
    s, c = F.col("search_trace"), F.col("compressed_research")
    source = lambda j: [s[0]["sources"][j][x] for x in ("query", "title", "snippet")]
    told = ["research_brief", *source(0), *source(1), s[1]["query"], c[0]["compressed_research"], "final_report"]
    same = F.when(s[0]["query"] == s[0]["sources"][0]["query"], F.concat_ws("|", *told))  # both are one text
    links = F.concat_ws(",", F.transform(s[0]["sources"], lambda x: x["link"]))
    return _mask_all(spark, d)[0].select("run_id", F.md5(same).alias("digest"), links.alias("links"), s[1]["topic_id"].alias("topic"), F.size(c).alias("notes"))


@query(f"""WITH {_STEPS}, u AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE i = 1) SELECT stage, CAST(sum(n) AS BIGINT) AS masked, CAST(0 AS BIGINT) AS entities, count(DISTINCT doc_id) AS runs, CAST(3 AS INTEGER) AS most_phrases, CAST(3 AS BIGINT) AS phrase_lists FROM u GROUP BY stage""")
def r028_masking_totals(spark: SparkSession, d: str) -> DataFrame:
    return texts.masking_totals(_mask_all(spark, d)[1])


_GRAMS = """SELECT {0} AS id, i AS pos, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT {0}, t, unnest(range(1, len(t) - 3)) AS i FROM (SELECT {0}, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM {1}) WHERE len(t) >= 5)"""


@query(f"""WITH h AS (SELECT DISTINCT a.id AS text_id, b.id AS profile_id, a.pos FROM ({_GRAMS.format('doc_id', 'documents')}) a JOIN ({_GRAMS.format('item_id', 'benchmark')}) b USING (g)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY text_id, profile_id ORDER BY pos) AS island FROM h) SELECT text_id, profile_id, CAST(min(pos) AS INTEGER) AS start, count(*) + 4 AS tokens FROM i GROUP BY text_id, profile_id, island""")
def r029_leakage_spans(spark: SparkSession, d: str) -> DataFrame:
    return texts.leakage_spans(*_leak(spark, d))


def _leak(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text"), spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("profile_id"), "text"))


_SENT = "SELECT id, s - 1 AS s, t FROM (SELECT id, s, list_distinct(regexp_extract_all(lower(p[s]), '[a-z0-9]+')) AS t FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS s FROM (SELECT {0} AS id, regexp_split_to_array(text, '[.!?\\n]+') AS p FROM {1}))) WHERE len(t) > 0"


@query(f"""WITH a AS (SELECT *, unnest(t) AS w FROM ({_SENT.format('doc_id', 'documents')})), b AS (SELECT *, unnest(t) AS w FROM ({_SENT.format('item_id', 'benchmark')})),
j AS (SELECT a.id AS text_id, a.s AS text_id_s, b.id AS profile_id, b.s AS profile_id_s, count(*) AS n, any_value(len(a.t)) AS x, any_value(len(b.t)) AS y FROM a JOIN b USING (w) GROUP BY ALL)
SELECT text_id, CAST(text_id_s AS INTEGER) AS text_id_s, profile_id, CAST(profile_id_s AS INTEGER) AS profile_id_s, round(n / (x + y - n), 6) AS jaccard FROM j WHERE n / (x + y - n) >= 0.5""")
def r030_leakage_sentences(spark: SparkSession, d: str) -> DataFrame:
    return texts.leakage_sentences(*_leak(spark, d))


# The stop lists once more, as literals of the SQL: a wrong list in the library shows.
_LISTS = {k: ", ".join(f"'{w}'" for w in v.split()) for k, v in {
    "a": "a an the and or of in to for is are was were he she they his her their it this that with on at by from as has have had not but also been which who when where what how its be do does did",
    "i": "a an the and or of in to for is are was were he she they his her their it this that"}.items()}
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_ACT = f"list_filter({_TOK}, lambda t: length(t) > 2 AND NOT list_contains([{_LISTS['a']}], t))"


@query(f"""SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS plain, md5(array_to_string({_ACT}, ' ')) AS actionable, CAST(len(list_filter({_TOK}, lambda t: NOT list_contains([{_LISTS['i']}], t))) AS INTEGER) AS item,
 CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)?')) AS INTEGER) AS words FROM documents""")
def r031_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(S.tokens(t)).alias("plain"), F.md5(F.concat_ws(" ", S.tokens(t, "actionable"))).alias("actionable"), F.size(S.tokens(t, "item")).alias("item"), F.size(S.tokens(t, "words")).alias("words"))


#: FOUR with nothing of the second and fourth text but whether it is there.
_BRIEFS = "SELECT doc_id div 4 AS r, max(CASE WHEN doc_id % 4 = 0 THEN text END) AS b, max(doc_id % 4 = 1 AND text IS NOT NULL) AS s, max(doc_id % 4 = 3 AND text IS NOT NULL) AS w FROM documents GROUP BY doc_id div 4"
_AB = f"SELECT r, regexp_extract_all(lower(b), '[a-z0-9]+') AS x, regexp_extract_all(lower(w), '[a-z0-9]+') AS y FROM ({_F}) WHERE w IS NOT NULL"
_J = "CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN {0} ELSE len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(list_concat(x, y))) END"


@query(f"SELECT r, round({_J.format('0.0')}, 4) AS zero, round({_J.format('1.0')}, 6) AS one FROM ({_AB})")
def r032_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a, b = (S.tokens(F.col(c)) for c in "bw")
    return views.view(spark, d, FOUR).where("s is not null and w is not null").select("r", S.jaccard(a, b, 0.0, 4).alias("zero"), F.round(S.jaccard(a, b, 1.0), 6).alias("one"))


@query(f"""WITH t AS (SELECT r, unnest(x) AS w FROM ({_AB})), c AS (SELECT r, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT r, sum(n) AS m, count(*) AS k FROM c GROUP BY r)
SELECT r, round(-sum(n / m * log2(n / m)), 5) AS entropy, round(any_value(k) / any_value(m), 6) AS ttr FROM c JOIN s USING (r) GROUP BY r""")
def r033_token_entropy(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, _BRIEFS).where("s and w")
    return texts.token_statistics(rows, ["r"], S.tokens(F.col("b"))).select("r", F.round("entropy", 5).alias("entropy"), F.round("ttr", 6).alias("ttr"))


@query("""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), c AS (SELECT conv_id, turn, w, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT conv_id, turn, sum(n) AS m FROM c GROUP BY ALL)
SELECT x.conv_id, x.turn, round(coalesce(e, 0.0), 5) AS entropy FROM conversations x LEFT JOIN (SELECT conv_id, turn, -sum(n / m * log2(n / m)) AS e FROM c JOIN s USING (conv_id, turn) GROUP BY ALL) USING (conv_id, turn)""")
def r033_token_entropy_of_arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", F.round(S.token_entropy(S.tokens(F.col("text"))) + 0.0, 5).alias("entropy"))


@query(f"SELECT r, round(CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(list_distinct(x), list_distinct(y))) / len(list_distinct(x)) END, 6) AS retained FROM ({_AB})")
def r034_retention(spark: SparkSession, d: str) -> DataFrame:
    a, b = (S.tokens(F.col(c)) for c in "bw")
    return views.view(spark, d, FOUR).where("s is not null and w is not null").select("r", F.round(S.retention(a, b), 6).alias("retained"))


@query("SELECT conv_id, turn, md5(nullif(trim(regexp_replace(lower('  ' || text || chr(10)), '\\s+', ' ', 'g')), '')) AS digest FROM conversations")
def r035_normalize_query(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.md5(S.normalize_query(F.concat(F.lit("  "), "text", F.lit("\n")))).alias("digest"))


_URL = "'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?'"
_P = lambda k: f"regexp_extract(url, {_URL}, {k})"


#: Pages' addresses, with slashes at their ends, without a path, and text that is none.
_ODD = "SELECT page_id, url FROM pages UNION ALL SELECT -page_id - 1, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^[^/]*//[^/]*', 0) WHEN 1 THEN concat(url, '//') WHEN 2 THEN concat('no url ', page_id, '/') ELSE '' END FROM pages"
_BARE = lambda p: f"coalesce(nullif(regexp_replace({p}, '/+$', ''), ''), '/')"


@query(f"""SELECT page_id, CASE WHEN contains(url, '://') THEN lower({_P(1)}) || '://' || lower({_P(2)}) || {_BARE(_P(3))} || {_P(4)} ELSE {_BARE('url')} END AS stability,
 CASE WHEN contains(url, '://') THEN lower({_P(1)}) || '://' || lower({_P(2)}) || CASE WHEN {_P(3)} = '' THEN '/' ELSE {_P(3)} END || {_P(4)} END AS canonical FROM ({_ODD})""")
def r036_normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, _ODD).select("page_id", *[S.normalize_url(F.col("url"), s).alias(s) for s in ("stability", "canonical")])


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_CATEGORY = "CASE WHEN h = '' THEN 'unknown' " + " ".join(f"WHEN {' OR '.join(f'contains(h, {chr(39)}{x}{chr(39)})' for x in parts.split())} THEN '{n}'" for n, parts in (
    ("retail_books", "amazon dangdang book goodreads isbn"), ("video", "youtube bilibili vimeo"), ("encyclopedia", "wikipedia wiki"), ("academic", "edu ac. arxiv springer ieee acm.org nih.gov pubmed"), ("forum", "reddit zhihu quora stackoverflow"),
    ("course_platform", "coursera udemy edx skillshare khan"), ("gov", "gov who.int cdc.gov"), ("blog", "medium.com blog substack"))) + " ELSE 'other_web' END"


@query(f"SELECT category, count(*) AS pages, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM (SELECT {_CATEGORY} AS category FROM (SELECT {_HOST} AS h FROM pages)) GROUP BY category")
def r037_url_category(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    out = spark.read.parquet(f"{d}/pages.parquet").withColumn("host", S.url_host(F.col("url"))).groupBy(S.url_category(F.col("host")).alias("category")).agg(F.count("*").alias("pages"))
    return out.withColumn("fraction", F.round(F.col("pages") / F.sum("pages").over(Window.partitionBy(F.lit(1))), 6))  # ten categories


_PHRASE_LIST = ("best books", "best practices", "how to", "what is", "overview of", "introduction to", "top 10", "isbn", "pdf", "course", "tutorial", "guide to", "list of", "vs ", "versus", "review of", "definition of", "examples of", "methods for", "strategies for", "techniques for", "workbook", "textbook", "syllabus")


@query("SELECT role, round(avg(CAST(" + " OR ".join(f"contains(lower(text), '{p}')" for p in _PHRASE_LIST) + " AS INT)), 6) AS generic FROM (SELECT role, CASE WHEN turn % 3 = 0 THEN 'How to ' || text ELSE text END AS text FROM conversations) GROUP BY role")
def r038_generic_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("How to "), "text")).otherwise(F.col("text"))
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy("role").agg(F.round(F.avg(S.is_generic(text).cast("int")), 6).alias("generic"))


_REASON = "SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' Clearly Candidate A, only it.' WHEN 1 THEN ' Perhaps Candidate A or candidate B; might be Candidate A.' ELSE '' END AS x FROM conversations"
_N = lambda p: f"len(regexp_extract_all(x, '(?i)\\b(?:{p})\\b'))"


_SURE = "only|perfectly|clearly|unambiguously|definitively|strongest|aligns perfectly|no other|exclusive|unmistakably|obviously|most closely|best match|sole|decisively"
_UNSURE = "might|could|possibly|perhaps|unclear|ambiguous|either|both|somewhat|partially|suggests?|appears?|seems?|less clear|harder to|not definitive|no single"


@query(f"WITH r AS (SELECT conv_id, turn, {_N(_SURE)} AS strong, {_N(_UNSURE)} AS hedged, len(list_distinct(regexp_extract_all(x, '(?i)Candidate\\s+[ABC]'))) AS named FROM ({_REASON})) SELECT conv_id, turn, CAST(strong AS INTEGER) AS strong, CAST(hedged AS INTEGER) AS hedged, CAST(named AS INTEGER) AS named, strong > 0 AS has_strong, hedged > 0 AS has_hedge, CAST(strong - 0.5 * hedged + CASE WHEN named <= 1 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM r")
def r039_certainty_proxy(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("turn") % 3 == 0, " Clearly Candidate A, only it.").when(F.col("turn") % 3 == 1, " Perhaps Candidate A or candidate B; might be Candidate A.").otherwise("")
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    out = rows.select("conv_id", "turn", S.certainty_proxy(F.concat("text", more)).alias("c")).select("conv_id", "turn", "c.*")
    return out.withColumn("score", F.col("score").cast("double"))


#: Each text with headings and bullets of all kinds around it.
_FRAME = ("  # ", "\n\n- https://a.example/x\n+ b\n 1. c\n2) d\n    # no\n#no\nit’s a well-known-fact\n")
_T = f"(SELECT doc_id, '{_FRAME[0]}' || text || '{_FRAME[1]}' AS t FROM documents)"


@query(f"""WITH l AS (SELECT doc_id, t, regexp_split_to_array(t, '\\n') AS lines FROM {_T}) SELECT doc_id, octet_length(encode(t)) AS bytes, length(t) AS chars, len(regexp_extract_all(t, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)?')) AS words, len(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g')) <> '')) AS paragraphs,
 len(list_filter(lines, lambda x: regexp_matches(x, '^\\s{{0,3}}#{{1,6}}\\s'))) AS headings, len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*([-*+]|\\d+[.)])\\s+'))) AS bullets, len(regexp_extract_all(t, 'https?://\\S+')) AS urls FROM l""")
def r040_text_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet")
    return rows.select("doc_id", S.text_metrics(F.concat(F.lit(_FRAME[0]), "text", F.lit(_FRAME[1]))).alias("m")).select("doc_id", "m.*")


_ASKED = """SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN concat('Write 1,', 100 + o_custkey % 900, ' – 2,', 100 + o_custkey % 900, '-word reports.') WHEN 1 THEN concat(1100 + o_custkey % 900, '—', 2100 + o_custkey % 900, ' Words, please')
  WHEN 2 THEN concat('about ', 1100 + o_custkey % 900, '-', 2100 + o_custkey % 900, 'word text') WHEN 3 THEN concat(1100 + o_custkey % 900, ' to ', 2100, ' words') ELSE concat('1-2 pages, then ', 1100 + o_custkey % 900, ' - ', 2100 + o_custkey % 900, ' WORD') END AS prompt FROM orders"""


@query(f"""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 3 THEN 1100 + o_custkey % 900 END AS lo, CASE WHEN o_orderkey % 5 <> 3 THEN 2100 + o_custkey % 900 END AS hi FROM orders)
SELECT o_orderkey, lo AS min_words, hi AS max_words, 1500 + o_orderkey BETWEEN lo AND hi AS inside FROM r""")
def r041_requested_word_range(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, _ASKED).select("o_orderkey", S.requested_word_range(F.col("prompt")).alias("r"))
    return rows.select("o_orderkey", "r.*", S.within_range(1500 + F.col("o_orderkey"), F.col("r")).alias("inside"))


@query("""SELECT count(*) AS samples, min(w) AS minimum, max(w) AS maximum, round(avg(w), 1) AS mean, count_if(w BETWEEN 100 AND 400) AS within, count_if(lang IS NULL) = 0 AS all_hashed FROM (SELECT len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''’-][A-Za-z0-9]+)?')) AS w, lang FROM documents)""")
def r041_sample_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/documents.parquet").select("text", F.struct(F.lit(100).cast("long").alias("min_words"), F.lit(400).cast("long").alias("max_words")).alias("bounds"), F.when(F.col("lang").isNotNull(), F.sha2("text", 256)).alias("digest"))
    return S.sample_summary(rows)


@query("SELECT sha256(text) AS digest, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def r042_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").groupBy(S.content_hash(F.col("text")).alias("digest")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


_SORTED = """'{"Basic":{"Name":"' || c_name || '","Nation":"' || n_name || '"},"Likes":{"Budget":"' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || '","Segment":"' || c_mktsegment || '","Tags":["' || n_name || '","' || c_mktsegment || '"]}}'"""


@query(f"SELECT 'User' || c_custkey AS userid, sha256({_SORTED}) AS canonical, sha256('Plan for ' || c_name || chr(10) || chr(10) || '=== Profile ===' || chr(10) || {_BODY}) AS prompt FROM customer JOIN nation ON n_nationkey = c_nationkey")
def r042_profile_hashes(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    name = F.get_json_object("body", "$.Basic.Name")
    return views.view(spark, d, BODIES).select("userid", S.canonical_json_hash(body).alias("canonical"), S.content_hash(texts.embed_profile(F.concat(F.lit("Plan for "), name), body)).alias("prompt"))


@query(f"SELECT run_id, ('0x' || substr(sha256(run_id), 1, 16))::UBIGINT::VARCHAR AS seed0, xor(('0x' || substr(sha256(run_id), 1, 16))::UBIGINT, 42::UBIGINT)::VARCHAR AS seed42 FROM ({duck(views.RUNS)})")
def r043_stable_seed(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.RUNS).select("run_id", S.hash64(F.col("run_id")).cast("string").alias("seed0"), S.hash64(F.col("run_id"), 42).cast("string").alias("seed42"))


@query("SELECT l_quantity, count(*) AS n, CASE WHEN l_quantity / 100 >= 0.2 THEN 'hard_negative' ELSE 'nearest_fallback' END AS pool, round((l_quantity / 100 - 1 / 3) / (1 - 1 / 3), 6) AS normalized FROM lineitem GROUP BY l_quantity")
def r044_pool_label(spark: SparkSession, d: str) -> DataFrame:
    from stagesignal.operators.metrics import chance_normalized

    x = F.col("l_quantity") / 100
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_quantity").agg(F.count("*").alias("n")).select("l_quantity", "n", S.pool_label(x).alias("pool"), F.round(chance_normalized(x, F.lit(3.0)), 6).alias("normalized"))
