"""Run-log shaped views of the driver's tables, as SQL that Spark and (by `duck`) DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RUNS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderkey % 2 AS seed, (o_orderkey div 2) % 50 AS taskid,
  (o_orderkey div 2) div 50 AS unum, concat('User', (o_orderkey div 2) div 50) AS userid, concat('domain', ((o_orderkey div 2) % 50) % 10) AS domain,
  concat('pilot_task', (o_orderkey div 2) % 50, '_User', (o_orderkey div 2) div 50, '_seed', o_orderkey % 2) AS run_id
FROM orders"""

STAGES = "(VALUES (0, 'plan', 80), (1, 'search', 55), (2, 'compress', 59), (3, 'write', 80)) AS s(stage_index, stage, pct)"


def matches_sql(v: int = 0) -> str:
    """Decisions of condition or method v: one row per run and stage."""
    right = f"((o_custkey * 31 + o_orderkey * 17 + stage_index * 7919 + {v} * 104729) % 100) < pct"
    return f"""
SELECT run_id, taskid, domain, seed, userid AS gt_userid, stage_index, stage, {right} AS correct,
  CASE WHEN {right} THEN userid ELSE concat('User', unum + 1 + o_custkey % 2) END AS predicted_userid,
  array(userid, concat('User', unum + 1), concat('User', unum + 2)) AS candidate_userids, (o_custkey * 7 + stage_index) % 500 AS prompt_chars
FROM ({RUNS}) AS r CROSS JOIN {STAGES}"""


SUMMARIES = f"""
SELECT r.run_id, r.taskid, r.userid AS gt_userid, r.domain, r.seed, CASE WHEN o_orderkey % 89 > 0 THEN o_orderstatus <> 'P' END AS schema_valid, o_orderpriority <> '1-URGENT' AS success_criteria_met,
  CASE WHEN o_orderpriority = '2-HIGH' THEN array('no source') ELSE array() END AS completeness_errors,
  CASE WHEN o_orderstatus = 'P' THEN array('bad key') ELSE array() END AS schema_errors,
  CASE WHEN o_orderkey % 11 = 0 THEN array('sum') ELSE array() END AS ledger_errors,
  CASE WHEN o_orderkey % 97 = 0 THEN 'timeout' END AS execution_error, CASE WHEN o_orderkey % 89 = 0 THEN 'crashed' WHEN o_orderkey % 83 = 0 THEN '' END AS error, coalesce(ok, 0) * 2 AS sources_selected,
  coalesce(n, 0) AS queries_attempted, coalesce(ok, 0) AS queries_successful, coalesce(n, 0) - coalesce(ok, 0) AS queries_failed,
  coalesce(tokens, 0) AS total_tokens, coalesce(secs, 0) AS elapsed_sec
FROM ({RUNS}) AS r LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS ok, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens,
    CAST(sum(CAST(l_partkey AS BIGINT)) AS BIGINT) AS secs
  FROM lineitem GROUP BY l_orderkey) AS l ON l.l_orderkey = r.o_orderkey"""

#: Exactly three users per task, as the overlap analyses need.
TRACE = """
SELECT concat('task', l_orderkey div 2 div 3) AS taskid, concat('User', l_orderkey div 2 % 3) AS userid, l_orderkey % 2 AS seed, l_orderkey AS run,
  concat(p_name, ' ', p_brand) AS query, concat('HTTPS://Shop', l_suppkey % 17, '.Example.COM/p', l_partkey % 50, '/#s') AS link,
  l_returnflag <> 'N' AS attempted, CASE WHEN l_returnflag <> 'N' AND l_linestatus = 'F' THEN 'ok' ELSE 'failed' END AS status,
  l_linenumber AS rank, l_partkey, l_suppkey, l_extendedprice
FROM lineitem JOIN part ON p_partkey = l_partkey"""

PROFILES = "SELECT doc_id, concat('User', doc_id) AS userid, concat(source, '/', lang) AS domain, text FROM documents"


def duck(sql: str) -> str:
    return re.sub(r"\barray\(", "list_value(", sql.replace(" div ", " // "))


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view's rows over the tables in sf_dir."""
    names = {t for t in ("orders", "lineitem", "part", "documents", "customer", "nation", "region", "supplier", "events", "benchmark", "labels", "pages", "conversations", "embeddings") if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    for t in names:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def matches(spark: SparkSession, sf_dir: str, v: int = 0) -> DataFrame:
    return view(spark, sf_dir, matches_sql(v))
