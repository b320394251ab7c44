"""Queries over event logs and artifacts, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagesignal.operators import trace
from stagesignal.plans import views
from stagesignal.plans.registry import query
from stagesignal.plans.texts import _F, _ID, FOUR
from stagesignal.plans.views import duck
from stagesignal.sources import io
from stagesignal.streaming import decisions

#: transformWithState keeps its state in RocksDB.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS = """SELECT event_id AS ord, ts, concat('e', event_id) AS id, concat('run', user_id % 20) AS report_run,
  CASE WHEN event_id % 17 > 0 THEN concat(user_id, '-', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 6) END AS call_id,
  CASE event_type WHEN 'view' THEN 'tool_start' WHEN 'click' THEN 'tool_end' WHEN 'error' THEN 'tool_error' WHEN 'purchase' THEN 'model_end' ELSE 'chain_start' END AS event,
  CASE WHEN event_type NOT IN ('view', 'click', 'error', 'purchase') THEN concat('topic ', CAST(floor(value) AS BIGINT) % 5) END AS topic_text,
  CASE WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN array(concat('tea ', event_id % 7)) WHEN 1 THEN array(concat('tea ', event_id % 7), concat('pot ', event_id % 3))
    WHEN 2 THEN array(concat('tea ', event_id % 7), concat('tea ', event_id % 7)) ELSE array(concat('pot ', event_id % 3), 'lone', concat('cup ', event_id)) END END AS queries,
  CASE WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN concat(chr(123), '"queries":[', chr(123), '"query":"told","attempted":true,"status":"ok","failure_code":null,"sources":[', chr(123), '"title":"T","link":"https://o.example/","rank":1', chr(125), ']', chr(125), ',', chr(123), '"query":null,"attempted":false,"status":"odd","failure_code":"c"', chr(125), ']', chr(125))
    WHEN 1 THEN concat(chr(123), '"other":1', chr(125)) ELSE 'plain text' END END AS output,
  CASE WHEN event_id % 3 = 1 THEN CAST(floor(value * 10) AS BIGINT) WHEN event_id % 3 = 2 AND event_id % 5 = 0 THEN CAST(0 AS BIGINT) END AS input_tokens, CASE WHEN event_id % 3 = 1 THEN event_id % 50 END AS output_tokens,
  CASE WHEN event_id % 3 = 2 THEN CAST(floor(value * 7) AS BIGINT) END AS prompt_tokens, CASE WHEN event_id % 3 = 2 THEN event_id % 40 END AS completion_tokens,
  array(concat('e', event_id - 40), concat('e', event_id - 20), concat('e', event_id + 1)) AS parent_ids, concat('topic_00', CAST(1 + user_id % 3 AS INT)) AS topic_id, event_id % 3 AS kind, value FROM events"""
#: What the search adapter logged of those calls, when they began.
LOG = """SELECT event_id AS ord, event_id * 2 AS query_sequence, concat('run', user_id % 20) AS report_run, ts, concat('tea ', event_id % 7) AS query, event_id % 4 > 0 AS attempted, CASE WHEN event_id % 5 = 0 THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'empty_organic' END AS failure_code, CASE WHEN event_id % 5 > 0 THEN concat('https://s.example/', event_id) END AS link FROM events WHERE event_type = 'view' AND event_id % 4 < 3 AND event_id % 9 > 0
  UNION ALL SELECT event_id AS ord, event_id * 2 + 1 AS query_sequence, concat('run', user_id % 20) AS report_run, ts, concat('pot ', event_id % 3) AS query, true AS attempted, 'ok' AS status, CAST(NULL AS STRING) AS failure_code, concat('https://p.example/', event_id) AS link
  FROM events WHERE event_type = 'view' AND event_id % 4 = 1 AND event_id % 11 > 0"""
E = duck(EVENTS)


def events(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, EVENTS)


# Artifacts with all their parts. The number of a run decides which one is wrong: none in runs 0 and 1 of each 20.
TRACED = f"""SELECT CASE WHEN r % 20 = 2 THEN 'dra_trace_v1' ELSE 'dra_trace_v2' END AS schema_version, run_id, r, CASE WHEN r % 20 = 3 THEN '' WHEN r % 20 = 4 THEN NULL ELSE 'A brief.' END AS research_brief,
  CASE WHEN r % 20 = 5 THEN array() WHEN r % 20 = 6 THEN array(named_struct('topic_id', 'topic_002', 'topic_text', 'x'), named_struct('topic_id', 'topic_001', 'topic_text', ''))
    ELSE array(named_struct('topic_id', 'topic_001', 'topic_text', 'x'), named_struct('topic_id', 'topic_002', 'topic_text', 'y')) END AS research_topics,
  array(named_struct('topic_id', 'topic_001', 'query_id', 'q1', 'query', s, 'attempted', true, 'status', CASE WHEN r % 20 = 7 THEN 'pending' ELSE 'ok' END, 'failure_code', NULL, 'sources', array({{0}})),
    named_struct('topic_id', CASE WHEN r % 20 = 8 THEN 'topic_unmapped' WHEN r % 20 = 9 THEN 'topic_007' ELSE 'topic_002' END, 'query_id', CASE WHEN r % 20 = 10 THEN 'q1' ELSE 'q2' END, 'query', 'second', 'attempted', true, 'status', 'ok', 'failure_code', NULL, 'sources', CASE WHEN r % 20 = 11 THEN array() ELSE array({{0}}) END),
    named_struct('topic_id', 'topic_002', 'query_id', 'q3', 'query', 'third', 'attempted', r % 20 <> 1, 'status', 'failed', 'failure_code', 'cap', 'sources', array())) AS search_trace,
  CASE WHEN r % 20 = 12 THEN array(named_struct('topic_id', 'topic_001', 'topic_text', 'x', 'compressed_research', 'c'), named_struct('topic_id', 'topic_001', 'topic_text', 'x', 'compressed_research', ''))
    ELSE array(named_struct('topic_id', 'topic_001', 'topic_text', 'x', 'compressed_research', 'c'), named_struct('topic_id', 'topic_002', 'topic_text', 'y', 'compressed_research', 'd')) END AS compressed_research,
  CASE WHEN r % 20 = 13 THEN concat('Error generating final report: ', r) WHEN r % 20 = 14 THEN '' ELSE 'A report.' END AS final_report,
  named_struct('generation_seed', 1, 'manifest_sha256', sha2('m', 256), 'prompt_sha256', CASE WHEN r % 20 = 2 THEN 'x' ELSE sha2('p', 256) END, 'service_tier', 'flex', 'timeout_sec', CASE WHEN r % 20 = 15 THEN 0 ELSE 60 END, 'models', map('a', 'b')) AS execution_config,
  named_struct('input_tokens', CASE WHEN r % 20 = 16 THEN -1 ELSE 10 END, 'output_tokens', 5, 'total_tokens', CASE WHEN r % 20 = 17 THEN 16 ELSE 15 END, 'token_usage_events', CASE WHEN r % 20 = 17 THEN 0 ELSE 2 END, 'queries_requested', 3, 'queries_attempted', CASE WHEN r % 20 = 1 THEN 2 ELSE 3 END,
    'queries_successful', CASE WHEN r % 20 IN (7, 18) THEN 1 ELSE 2 END, 'queries_failed', CASE WHEN r % 20 = 1 THEN 0 WHEN r % 20 = 7 THEN 2 ELSE 1 END, 'queries_rejected', CASE WHEN r % 20 = 1 THEN 1 ELSE 0 END, 'sources_selected', CASE WHEN r % 20 = 11 THEN 1 ELSE 2 END, 'unique_sources', 1,
    'query_ledger_consistent', r % 20 <> 19, 'source_ledger_consistent', true) AS token_ledger
FROM (SELECT concat('pilot_task', r, '_User1_seed0') AS run_id, r, s FROM ({FOUR}) AS f WHERE s IS NOT NULL AND s <> '') AS t"""
_SOURCED = "named_struct('query', s, 'title', 't', 'link', concat('https://a.example/', r), 'domain', 'a.example', 'rank', 1, 'snippet', 'n')"
TRACED = TRACED.format(_SOURCED)
_RUNS = f"SELECT r % 20 AS k, {_ID} FROM ({_F}) WHERE s <> ''"
_ERRORS = {
    2: ("schema_version: unsupported;prompt_sha256: no SHA-256", "", ""), 3: ("", "research_brief: empty", ""), 4: ("research_brief: missing", "", ""),
    5: ("0: unknown topic;1: unknown topic;2: unknown topic", "research_topics: empty;compressed_research: not one to one", ""), 6: ("topics: not in order;1: topic without text", "", ""),
    7: ("0: status not terminal", "no successful source: topic_001", ""), 8: ("", "1: query of no topic;no successful source: topic_002", ""), 9: ("1: unknown topic", "no successful source: topic_002", ""),
    10: ("1: query id missing or repeated", "", ""), 11: ("", "no successful source: topic_002", ""), 12: ("1: compressed text empty", "compressed_research: not one to one", ""),
    13: ("", "final_report: empty or failed", ""), 14: ("", "final_report: empty or failed", ""), 15: ("timeout_sec: not positive", "", ""), 16: ("", "", "input_tokens: missing or negative"),
    17: ("", "", "total_tokens: not the sum;token_usage_events: none"), 18: ("", "", "queries_successful: 1 stated, 2 found"), 19: ("", "", "query ledger: differs from the log"),
}
_MESSAGE = [f"CASE k {' '.join(f'WHEN {k} THEN {chr(39)}{v[i]}{chr(39)}' for k, v in _ERRORS.items())} ELSE '' END" for i in range(3)]


@query(f"SELECT run_id, {_MESSAGE[0]} AS schema_errors, {_MESSAGE[1]} AS completeness_errors, {_MESSAGE[2]} AS ledger_errors, k NOT IN (2, 4, 5, 6, 7, 9, 10, 12, 15) AS schema_valid, k < 2 AS success_criteria_met FROM ({_RUNS})")
def r100_validate_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return trace.validate_artifacts(views.view(spark, d, TRACED)).withColumns({c: F.concat_ws(";", c) for c in ("schema_errors", "completeness_errors", "ledger_errors")})


@query(f"""WITH e AS ({E}), t AS (SELECT report_run, topic_text, 'topic_' || lpad(CAST(row_number() OVER (PARTITION BY report_run ORDER BY min(ord)) AS VARCHAR), 3, '0') AS tid FROM e WHERE topic_text IS NOT NULL GROUP BY report_run, topic_text),
o AS (SELECT e.*, tid FROM e LEFT JOIN t USING (report_run, topic_text)), p AS (SELECT report_run, id, unnest(parent_ids) AS parent, unnest(range(0, 3)) AS pos FROM o WHERE tid IS NULL), n AS (SELECT p.report_run, p.id, arg_max(o.tid, pos) AS lent FROM p JOIN o ON o.report_run = p.report_run AND o.id = p.parent AND o.tid IS NOT NULL GROUP BY ALL)
SELECT o.report_run, o.ord, o.id, coalesce(tid, lent, 'topic_unmapped') AS topic_id FROM o LEFT JOIN n USING (report_run, id)""")
def r102_assign_topics(spark: SparkSession, d: str) -> DataFrame:
    return trace.assign_topics(events(spark, d))


#: Uses of a text are walked one after the other, as records are claimed.
_CALLS = f"""WITH RECURSIVE c AS (SELECT * EXCLUDE (call_id), coalesce(call_id, '') AS call_id, sum(CAST(event = 'tool_start' AS INT)) OVER (PARTITION BY report_run, coalesce(call_id, '') ORDER BY ord) AS call FROM ({E}) WHERE event IN ('tool_start', 'tool_end', 'tool_error')),
s AS (SELECT report_run, call_id, call, ord AS start, topic_id, unnest(queries) AS query, unnest(range(len(queries))) AS pos FROM c WHERE event = 'tool_start'),
o AS (SELECT *, topic_id || printf('_query_%03d', row_number() OVER (PARTITION BY report_run, topic_id ORDER BY start, pos)) AS query_id FROM s),
d AS (SELECT o.*, t.ord AS tm, t.event = 'tool_end' AS ended, t.output FROM o LEFT JOIN (SELECT * FROM c WHERE event <> 'tool_start' AND call > 0) t USING (report_run, call_id, call)),
l AS (SELECT *, row_number() OVER (PARTITION BY report_run, query ORDER BY query_sequence) AS taken FROM ({duck(LOG)})),
u AS (SELECT d.report_run, d.query, d.tm, d.pos, row_number() OVER (PARTITION BY d.report_run, d.query ORDER BY d.tm, d.pos) AS i, count(l.ord) AS there FROM d LEFT JOIN l ON l.report_run = d.report_run AND l.query = d.query AND l.ord <= d.tm WHERE ended GROUP BY d.report_run, d.query, d.tm, d.pos),
w AS (SELECT report_run, query, i, tm, pos, CAST(there > 0 AS INT) AS n, there > 0 AS got FROM u WHERE i = 1 UNION ALL SELECT u.report_run, u.query, u.i, u.tm, u.pos, w.n + CAST(u.there > w.n AS INT), u.there > w.n FROM w JOIN u ON u.report_run = w.report_run AND u.query = w.query AND u.i = w.i + 1),
m AS (SELECT d.*, l.taken IS NOT NULL AS has, l.attempted AS a, l.status AS st, l.failure_code AS f, l.link FROM d LEFT JOIN (SELECT report_run, query, tm, pos, n AS taken FROM w WHERE got) g USING (report_run, query, tm, pos) LEFT JOIN l USING (report_run, query, taken)),
z AS (SELECT *, NOT bool_or(has) OVER (PARTITION BY report_run, call_id, call, tm) AND output LIKE '{{"queries"%' AS told, row_number() OVER (PARTITION BY report_run, call_id, call, pos ORDER BY tm DESC NULLS LAST) AS last FROM m)
SELECT report_run, call_id, query_id, topic_id, CASE WHEN ended AND told AND pos = 0 THEN 'told' ELSE query END AS query, CASE WHEN ended AND told AND pos = 1 THEN false WHEN ended AND has THEN a ELSE true END AS attempted,
 CASE WHEN ended AND (has AND st = 'ok' OR told AND pos = 0) THEN 'ok' ELSE 'failure' END AS status,
 CASE WHEN tm IS NULL THEN 'trace_incomplete_tool_call' WHEN NOT ended THEN 'tool_execution_error' WHEN told THEN CASE pos WHEN 0 THEN NULL WHEN 1 THEN 'c' ELSE 'trace_missing_query_result' END WHEN has THEN f ELSE 'trace_missing_query_result' END AS failure_code,
 CASE WHEN ended AND has AND link IS NOT NULL THEN link WHEN ended AND told AND pos = 0 THEN 'https://o.example/' ELSE '' END AS links FROM z WHERE last = 1"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    source = F.struct(F.lit(None).cast("string").alias("query"), F.lit("t").alias("title"), "link", F.lit("s.example").alias("domain"), F.lit(1).alias("rank"), F.lit("n").alias("snippet"))
    return views.view(spark, d, LOG).withColumn("sources", F.when(F.col("link").isNull(), F.array().cast("array<struct<query: string, title: string, link: string, domain: string, rank: int, snippet: string>>")).otherwise(F.array(source)))


def _linked(calls: DataFrame) -> DataFrame:
    return calls.select("report_run", "call_id", "query_id", "topic_id", "query", "attempted", "status", "failure_code", F.concat_ws(",", F.transform("sources", lambda s: s["link"])).alias("links"))


@query(_CALLS)
def r103_pair_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return _linked(trace.pair_tool_calls(events(spark, d), _log(spark, d)))


_FIRST_USE = f"""SELECT report_run, call_id, arg_min(coalesce(nullif(input_tokens, 0), prompt_tokens, 0), ord) AS i, arg_min(coalesce(nullif(output_tokens, 0), completion_tokens, 0), ord) AS o FROM ({E})
 WHERE event = 'model_end' AND call_id IS NOT NULL AND NOT (input_tokens IS NULL AND output_tokens IS NULL AND prompt_tokens IS NULL AND completion_tokens IS NULL) GROUP BY ALL"""


@query(f"SELECT report_run, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) AS token_usage_events, CAST(sum(i + o) AS BIGINT) AS total_tokens FROM ({_FIRST_USE}) GROUP BY report_run")
def r104_token_ledger(spark: SparkSession, d: str) -> DataFrame:
    return trace.token_ledger(events(spark, d))


_SLOTS = """SELECT report_run, ord, CASE kind WHEN 0 THEN 'brief' WHEN 1 THEN concat('compressed ', topic_id) ELSE 'report' END AS slot, CASE WHEN ord % 10 = 0 THEN ' ' WHEN ord % 7 < 2 THEN concat('Error generating final report: ', ord) WHEN ord % 7 = 2 THEN concat(' Error synthesizing research report: ', ord)
  WHEN ord % 7 = 3 THEN concat('Error bars ', ord) ELSE concat(' text ', ord, ' ') END AS text, ord % 6 = 2 AND report_run NOT IN ('run3', 'run4') AS is_final FROM (""" + EVENTS + ") AS e WHERE event = 'model_end'"
_GOOD = f"SELECT *, trim(text) AS t FROM ({duck(_SLOTS)}) WHERE trim(text) <> ''"


@query(f"""WITH g AS ({_GOOD}), r AS (SELECT * FROM g WHERE slot = 'report' AND NOT starts_with(t, 'Error generating final report:') AND NOT starts_with(t, 'Error synthesizing research report:'))
SELECT report_run, slot, arg_max(t, ord) AS text FROM g WHERE slot = 'brief' OR slot LIKE 'compressed%' AND NOT starts_with(text, 'Error generating final report:') AND NOT starts_with(text, 'Error synthesizing research report:') GROUP BY ALL
UNION ALL SELECT report_run, slot, coalesce(arg_max(t, ord) FILTER (is_final), arg_min(t, ord)) AS text FROM r GROUP BY ALL""")
def r105_capture_latest(spark: SparkSession, d: str) -> DataFrame:
    return trace.capture_latest(views.view(spark, d, _SLOTS))


# What the search adapter logged of those runs (one query too many in runs 3 of each 7, none of runs 5), and their model usage.
_LOGGED = f"""SELECT concat('pilot_task', r, '_User1_seed0') AS run_id, 3 + CASE WHEN r % 7 = 3 THEN 1 ELSE 0 END AS queries_requested, CASE WHEN r % 20 = 1 THEN 2 ELSE 3 END AS queries_attempted, CASE WHEN r % 20 = 7 THEN 1 ELSE 2 END AS queries_successful,
  CASE WHEN r % 20 = 1 THEN 0 WHEN r % 20 = 7 THEN 2 ELSE 1 END AS queries_failed, CASE WHEN r % 20 = 11 THEN 1 ELSE 2 END AS sources_selected, CASE WHEN r % 7 = 4 THEN 2 ELSE 1 END AS unique_sources FROM ({FOUR}) AS f WHERE s IS NOT NULL AND r % 7 <> 5"""
_USAGE = f"SELECT concat('pilot_task', r, '_User1_seed0') AS run_id, r AS input_tokens, length(s) AS output_tokens, 2 AS token_usage_events FROM ({FOUR}) AS f WHERE s IS NOT NULL AND r % 3 > 0"


@query(f"""WITH a AS (SELECT r, r % 20 AS k, {_ID}, CASE WHEN r % 3 > 0 THEN r ELSE 0 END AS i, CASE WHEN r % 3 > 0 THEN length(s) ELSE 0 END AS o FROM ({_F}) WHERE s <> ''),
f AS (SELECT *, k NOT IN (3, 4) AS has_brief, k <> 5 AS has_topics, k NOT IN (5, 7, 8, 9, 11) AS has_query_and_source, k NOT IN (5, 12) AS has_compressed_per_topic, k NOT IN (13, 14) AS has_report FROM a)
SELECT run_id, CAST(3 AS BIGINT) AS queries_requested, CAST(CASE WHEN k = 1 THEN 2 ELSE 3 END AS BIGINT) AS queries_attempted, CAST(CASE WHEN k = 7 THEN 1 ELSE 2 END AS BIGINT) AS queries_successful, CAST(CASE k WHEN 1 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS BIGINT) AS queries_failed,
 CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS BIGINT) AS queries_rejected, CAST(CASE WHEN k = 11 THEN 1 ELSE 2 END AS BIGINT) AS sources_selected, CAST(1 AS BIGINT) AS unique_sources, has_brief, has_topics, has_query_and_source, has_compressed_per_topic, has_report,
 has_brief AND has_topics AND has_query_and_source AND has_compressed_per_topic AND has_report AS complete, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(CASE WHEN r % 3 > 0 THEN 2 ELSE 0 END AS BIGINT) AS token_usage_events, CAST(i + o AS BIGINT) AS total_tokens,
 r % 7 NOT IN (3, 5) AS query_ledger_consistent, r % 7 NOT IN (4, 5) AS source_ledger_consistent FROM f""")
def r106_trace_ledger(spark: SparkSession, d: str) -> DataFrame:
    return trace.trace_ledger(views.view(spark, d, TRACED), views.view(spark, d, _LOGGED), views.view(spark, d, _USAGE))


RESPONSES = """SELECT concat('run', l_orderkey div 4) AS report_run, l_orderkey * 10 + l_linenumber AS query_sequence, collect_list(named_struct('title', concat(' ', p_name), 'link', CASE WHEN l_partkey % 13 = 0 THEN 'ftp://x.example/' WHEN l_partkey % 17 = 0 THEN NULL
    ELSE concat('HTTPS://u@Shop', l_suppkey % 5, '.Example.COM/p', l_partkey % 9, '/#s') END, 'position', CAST(l_partkey % 4 AS INT), 'snippet', concat(p_brand, ' '))) AS organic, min(p_name) AS query
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber"""


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Results in one order; a query of a single result whose number ends in 1 has none, one in 2 no list."""
    rows = views.view(spark, d, RESPONSES).withColumn("organic", F.sort_array(F.transform("organic", lambda o: F.struct(F.coalesce(o["link"], F.lit("")).alias("l"), o["title"].alias("t"), o["position"].alias("p"), o["snippet"].alias("s"), o.alias("o")))))
    rows = rows.withColumn("organic", F.transform("organic", lambda x: x["o"]))
    single, end = F.size("organic") == 1, F.col("query_sequence") % 10
    return rows.withColumn("organic", F.when(single & (end == 1), F.slice("organic", 1, 0)).when(single & (end == 2), F.lit(None)).otherwise(F.col("organic")))


_LINK = "CASE WHEN l_partkey % 13 = 0 THEN 'ftp://x.example/' WHEN l_partkey % 17 = 0 THEN '' ELSE 'HTTPS://u@Shop' || (l_suppkey % 5) || '.Example.COM/p' || (l_partkey % 9) || '/#s' END"
_ITEM = f"struct_pack(l := {_LINK}, t := ' ' || p_name, p := l_partkey % 4, s := p_brand || ' ')"
_ORG = f"""SELECT 'run' || (l_orderkey // 4) AS report_run, l_orderkey * 10 + l_linenumber AS query_sequence, l_linenumber AS e, min(p_name) AS query, list({_ITEM} ORDER BY {_ITEM}) AS o FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber"""
_SELECTED = f"""WITH o AS (SELECT report_run, query_sequence, query, CASE WHEN len(o) = 1 AND e = 1 THEN [] WHEN len(o) = 1 AND e = 2 THEN NULL ELSE o END AS o FROM ({_ORG})), x AS (SELECT report_run, query_sequence, query, unnest(o) AS i, unnest(range(0, len(o))) AS pos FROM o),
u AS (SELECT *, 'https://' || lower(regexp_extract(i.l, '@([^/]*)', 1)) || regexp_extract(i.l, '^[^:]+://[^/]*([^#]*)', 1) AS link FROM x WHERE pos < 3 AND starts_with(i.l, 'HTTPS')), f AS (SELECT *, row_number() OVER (PARTITION BY report_run, link ORDER BY query_sequence, pos) AS k FROM u),
g AS (SELECT *, row_number() OVER (PARTITION BY report_run ORDER BY query_sequence, pos) AS source FROM f WHERE k = 1)"""


@query(f"{_SELECTED} SELECT report_run, query_sequence, CAST(pos AS INTEGER) AS pos, query, trim(i.t) AS title, link, regexp_extract(link, '//([^/]*)', 1) AS domain, CAST(CASE WHEN i.p >= 1 THEN i.p ELSE pos + 1 END AS INTEGER) AS rank, trim(i.s) AS snippet, CAST(source AS INTEGER) AS source FROM g WHERE source <= 15")
def r107_select_sources(spark: SparkSession, d: str) -> DataFrame:
    return trace.select_sources(_responses(spark, d))


@query(f"""{_SELECTED}, n AS (SELECT report_run, query_sequence, count(*) AS n FROM g WHERE source <= 15 GROUP BY ALL) SELECT report_run, query_sequence, coalesce(n, 0) AS sources,
 CASE WHEN o IS NULL OR len(o) = 0 THEN 'empty_organic' WHEN len(list_filter(o[1:3], lambda i: starts_with(i.l, 'HTTPS'))) = 0 THEN 'malformed_organic' WHEN n IS NULL THEN 'no_new_sources' END AS failure_code FROM o LEFT JOIN n USING (report_run, query_sequence)""")
def r107_query_outcomes(spark: SparkSession, d: str) -> DataFrame:
    responses = io.settle(_responses(spark, d))  # read by both, made once
    return trace.query_outcomes(responses, trace.select_sources(responses))


#: Calls of three requests, of which some have one arrival number.
REQUESTS = "SELECT CASE WHEN event_id % 7 = 2 THEN event_id - 1 ELSE event_id END AS ord, event_id AS pos, concat('run', event_id div 11 % 900) AS report_run, concat('call', event_id div 3) AS call_id, CASE WHEN event_id % 13 = 0 THEN '  ' ELSE event_type END AS query FROM events"
#: Calls are walked one after the other, with what each run has had so far.
_ADMIT = f"""WITH RECURSIVE q AS (SELECT *, trim(query) <> '' AS v FROM ({duck(REQUESTS)})), i AS (SELECT *, CASE WHEN v THEN row_number() OVER (PARTITION BY report_run, call_id, v ORDER BY ord, pos) END AS k FROM q),
c AS (SELECT report_run, call_id, least(count(*), 2) AS few, row_number() OVER (ORDER BY min(ord), call_id, report_run) AS n FROM i WHERE v GROUP BY report_run, call_id),
w AS (SELECT CAST(0 AS BIGINT) AS n, '' AS report_run, '' AS call_id, CAST(0 AS BIGINT) AS asked, CAST(0 AS BIGINT) AS granted, CAST(0 AS BIGINT) AS total, MAP {{'': CAST(0 AS BIGINT)}} AS had
 UNION ALL SELECT n, report_run, call_id, asked, granted, total + granted, map_concat(had, MAP {{report_run: coalesce(had[report_run], 0) + granted}}) FROM
 (SELECT *, least(asked, 2400 - total) AS granted FROM (SELECT c.n, c.report_run, c.call_id, least(c.few, 7 - coalesce(w.had[c.report_run], 0)) AS asked, w.total, w.had FROM w JOIN c ON c.n = w.n + 1)))
SELECT ord, report_run, call_id, coalesce(v AND k <= granted, false) AS attempted, CASE WHEN NOT v THEN 'invalid_query' WHEN k > asked THEN 'report_query_cap_exceeded' WHEN k > granted THEN 'global_query_cap_exceeded' END AS failure_code FROM i LEFT JOIN (SELECT report_run, call_id, asked, granted FROM w WHERE n > 0) USING (report_run, call_id)"""


@query(_ADMIT)
def r108_admit_queries(spark: SparkSession, d: str) -> DataFrame:
    return trace.admit_queries(views.view(spark, d, REQUESTS), per_call=2)


@query(f"SELECT report_run, call_id, count(*) AS queries, count(failure_code) AS failed, CASE WHEN count(failure_code) = 0 THEN 'ok' WHEN count(failure_code) < count(*) THEN 'partial_failure' ELSE 'failure' END AS status FROM ({_ADMIT}) GROUP BY ALL")
def r109_call_status(spark: SparkSession, d: str) -> DataFrame:
    return trace.call_status(trace.admit_queries(views.view(spark, d, REQUESTS), per_call=2))


_USED = "SELECT event_id AS ord, concat('run', user_id % 20) AS report_run, concat(event_type, event_id % 40) AS query FROM events"
_LOG = "SELECT event_id * 3 AS query_sequence, concat('run', user_id % 20) AS report_run, concat(event_type, event_id % 40) AS query, CASE WHEN value > 5 THEN 'ok' ELSE 'failed' END AS status FROM events WHERE event_id % 9 > 0"


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY report_run, query ORDER BY ord) AS k FROM ({_USED})), l AS (SELECT *, row_number() OVER (PARTITION BY report_run, query ORDER BY query_sequence) AS k FROM ({_LOG}))
SELECT report_run, ord, query, CAST(query_sequence AS VARCHAR) AS query_sequence, status FROM t LEFT JOIN l USING (report_run, query, k)""")
def r110_match_search_log(spark: SparkSession, d: str) -> DataFrame:
    out = trace.match_search_log(views.view(spark, d, _USED), views.view(spark, d, _LOG))
    return out.withColumn("query_sequence", F.col("query_sequence").cast("string"))


SNAPSHOTS = "SELECT concat('run', user_id) AS run_id, event_id AS version, event_id % 9 AS queries_attempted, event_id % 8 AS queries_successful FROM events"


@query(f"SELECT *, queries_successful >= 0 AND queries_successful <= queries_attempted AND queries_attempted <= 7 AS consistent FROM (SELECT run_id, max(version) AS version, arg_max(queries_attempted, version) AS queries_attempted, arg_max(queries_successful, version) AS queries_successful FROM ({SNAPSHOTS}) GROUP BY run_id)")
def r111_run_ledger(spark: SparkSession, d: str) -> DataFrame:
    return trace.run_ledger(views.view(spark, d, SNAPSHOTS))


@query(f"SELECT *, queries_successful >= 0 AND queries_successful <= queries_attempted AND queries_attempted <= 7 AS consistent FROM (SELECT run_id, max(version) AS version, arg_max(queries_attempted, version) AS queries_attempted, arg_max(queries_successful, version) AS queries_successful FROM ({SNAPSHOTS}) GROUP BY run_id)")
def r111_stream_run_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots in four steps, each a batch or more, with a restart between them; superseded parts are removed."""
    rows = views.view(spark, d, SNAPSHOTS)
    folder, most = f"{io.shared_folder(spark)}/ledger-{uuid.uuid4().hex}", rows.agg(F.max("version")).first()[0]
    for k in (2, 0, 3, 1):  # later versions may come first
        rows.where(F.floor(F.col("version") * 4 / (most + 1)) == k).write.parquet(f"{folder}/in/step={k}")
        last = decisions.run_ledger_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/step=*"), folder, parts=8, keep=2)
    return trace.run_ledger(decisions.ledger(spark, folder, last).select(*rows.columns))


_STAGED = "SELECT *, CASE event_type WHEN 'view' THEN 'plan' WHEN 'click' THEN 'search' WHEN 'error' THEN 'compress' ELSE 'write' END AS stage FROM events"


def _parts(rows: DataFrame, folder: str, n: int = 3, **last: object) -> Iterator[DataFrame]:
    """The stream of a table that grows in n steps of time, one for each step; at the end comes a row of a later time, which
    moves the watermark past all others. Going on with the same folder, a stream starts where it ended."""
    spark, at = rows.sparkSession, F.unix_seconds("ts")
    first, end = rows.agg(F.min(at), F.max(at)).first()
    step = (end - first) // n + 1
    late = spark.range(1).select(*[F.lit(last.get(c)).cast(t).alias(c) if c != "ts" else F.timestamp_seconds(F.lit(end + 90 * 86_400)).alias(c) for c, t in rows.dtypes])
    for k in range(n + 1):
        part = rows.where((at >= first + k * step) & (at < first + (k + 1) * step)) if k < n else late
        part.write.mode("overwrite").parquet(f"{folder}/step={k}")
        yield spark.readStream.schema(rows.schema).parquet(f"{folder}/step=*")


def _streamed(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str, **last: object) -> DataFrame:
    """What a stream over rows gave out, all batches, with a restart after each step."""
    folder, held = f"{io.shared_folder(spark)}/stream-{uuid.uuid4().hex}", spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        for stream in _parts(rows, f"{folder}/in", **last):
            out = decisions.run_to_files(build(stream), mode, folder)
    finally:
        spark.conf.set(STORE, held)
    return out


@query(f"SELECT stage, count(*) AS n, CAST(sum(CAST(user_id % 3 > 0 AS INT)) AS BIGINT) AS correct FROM (SELECT DISTINCT ON (user_id, stage) * FROM ({_STAGED})) GROUP BY stage")
def r112_stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of decisions in three steps; duplicates meet within the watermark."""
    rows = views.view(spark, d, _STAGED).select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), "stage", (F.col("user_id") % 3 > 0).alias("correct"), F.col("ts").cast("timestamp").alias("ts"))
    out = _streamed(spark, rows, lambda s: decisions.running_accuracy(s, "60 days"), "complete", stage="none")
    return out.where("stage <> 'none'").groupBy("stage").agg(F.max_by("n", "batch").alias("n"), F.max_by("correct", "batch").alias("correct"))


@query(f"""SELECT report_run, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) AS token_usage_events FROM (SELECT report_run, call_id, arg_min(coalesce(input_tokens, 0), ord) AS i, arg_min(coalesce(output_tokens, 0), ord) AS o FROM ({E})
 WHERE event = 'model_end' AND call_id IS NOT NULL AND NOT (input_tokens IS NULL AND output_tokens IS NULL) GROUP BY ALL) GROUP BY report_run""")
def r104_stream_model_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Calls have several events each: the first with usage counts. Steps keep their order, and so does each in one partition."""
    rows = events(spark, d).where("event = 'model_end'").select("report_run", "call_id", "event", "ord", F.col("ts").cast("timestamp").alias("ts"), "input_tokens", "output_tokens")
    first = rows.where("input_tokens is not null or output_tokens is not null").groupBy("report_run", "call_id").agg(F.min("ord").alias("first"))
    again = rows.join(first, ["report_run", "call_id"]).withColumns({c: F.when(F.col("ord") > F.col("first"), F.first(c).over(Window.partitionBy("report_run", "call_id").orderBy(F.col("ord") != F.col("first")))).otherwise(F.col(c)) for c in ("input_tokens", "output_tokens")})
    rows = rows.where("call_id is null").unionByName(again.drop("first"))
    out = _streamed(spark, rows, lambda s: decisions.model_tokens(s, "60 days"), "update", event="none")
    return out.groupBy("report_run").agg(*[F.max_by(c, "batch").alias(c) for c in ("input_tokens", "output_tokens", "token_usage_events")])


@query(_CALLS)
def r103_stream_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """The run log and the search log as one stream, in three steps; the rows are those of the batch, open calls included."""
    kinds = "record struct<query: string, attempted: boolean, status: string, failure_code: string, sources: array<struct<query: string, title: string, link: string, domain: string, rank: int, snippet: string>>>"
    told = events(spark, d).where(F.col("event").isin("tool_start", "tool_end", "tool_error")).select("report_run", "ord", "ts", "event", "call_id", "topic_id", "queries", "output", F.lit(None).cast(kinds.split(" ", 1)[1]).alias("record"))
    logged = _log(spark, d).select("report_run", "ord", "ts", F.lit("search_record").alias("event"), F.struct("query", "attempted", "status", "failure_code", "sources").alias("record"))
    rows = told.unionByName(logged, allowMissingColumns=True).withColumn("ts", F.col("ts").cast("timestamp"))
    return _linked(decisions.latest_calls(_streamed(spark, rows, lambda s: decisions.stream_tool_calls(s, idle="60 days"), "append", report_run="none", event="none", ord=0)))
