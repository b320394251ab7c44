"""Queries over files: tables are written in the formats of run logs and read back. With their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagesignal.operators import quality
from stagesignal.plans import views
from stagesignal.plans.profiles import BODIES
from stagesignal.plans.registry import query
from stagesignal.plans.texts import artifacts
from stagesignal.plans.views import duck, matches, matches_sql
from stagesignal.sources import io

#: Files that a task writes.
FILES = 500
#: Decisions or items of an array file: about 1 MB.
ROWS = 5000


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base}/stagesignal-{uuid.uuid4().hex}"


def _json(df: DataFrame, folder: str) -> str:
    df.write.json(folder)
    return folder


@query("SELECT 'User' || c_custkey AS userid FROM customer JOIN nation ON n_nationkey = c_nationkey")
def r001_read_profiles(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    rows = views.view(spark, d, BODIES).select(F.concat(F.lit('{"userid":"'), "userid", F.lit('",'), F.expr("substring(body, 2)")).alias("value"))
    rows.union(spark.createDataFrame([(" ",)], "value string")).write.text(folder)
    return io.read_profiles(spark, folder).select("userid")


_QUERIES = "SELECT o_orderkey AS id, o_orderkey % 50 AS taskid, concat('User', o_custkey) AS userid, 'd' AS domain, o_orderstatus AS task, o_orderpriority AS query, CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language FROM orders"


@query(f"SELECT * FROM ({_QUERIES}) WHERE language IS NULL OR language = 'en'")
def r002_read_queries(spark: SparkSession, d: str) -> DataFrame:
    return io.read_queries(spark, _json(views.view(spark, d, _QUERIES), _folder(spark)))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS question, c_mktsegment AS category, CAST(1 AS INTEGER) AS items FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0")
def r003_read_profile_items(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, "SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END AS question, c_mktsegment AS category, CASE WHEN c_custkey % 5 > 0 THEN array(named_struct('id', c_name, 'category', 'x', 'text', 'y')) ELSE array() END AS profile FROM customer")
    return io.read_profile_items(spark, _arrays(rows, _folder(spark), ROWS)).select("id", "question", "category", F.size("profile").alias("items"))


def _arrays(rows: DataFrame, folder: str, per_file: int = 100) -> str:
    """Files that hold JSON arrays, one per per_file rows or so, as the logs do. Each file costs a writer and every reader some
    10 ms whatever it holds, so small rows go many to a file."""
    parts = max(1, -(-rows.count() // per_file))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(parts))).repartition("_part")
    packed = dealt.groupBy("_part").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    packed.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return folder


@query(f"SELECT run_id, stage, correct, taskid, seed, predicted_userid FROM ({duck(matches_sql(0))})")
def r004_read_matches(spark: SparkSession, d: str) -> DataFrame:
    rows = matches(spark, d).select("run_id", "stage", "gt_userid", "predicted_userid", "correct", "candidate_userids")
    return io.read_matches(spark, _arrays(rows, _folder(spark), ROWS), "*").select("run_id", "stage", "correct", "taskid", "seed", "predicted_userid")


@query("SELECT 'pilot_task' || (doc_id // 4) || '_User1_seed0' AS run_id, CAST(2 AS INTEGER) AS queries FROM documents GROUP BY doc_id // 4 HAVING max(CASE WHEN doc_id % 4 = 1 THEN text END) IS NOT NULL")
def r005_read_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return io.read_artifacts(spark, _arrays(artifacts(spark, d).drop("r"), _folder(spark)), "*").select("run_id", F.size("search_trace").alias("queries"))


_SUMMED = f"SELECT run_id, schema_valid, total_tokens FROM ({duck(views.SUMMARIES)})"


@query(_SUMMED)
def r006_read_run_summaries(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    ledger = F.struct("total_tokens", F.col("elapsed_sec").cast("double").alias("elapsed_sec"), "queries_attempted", "queries_successful", "queries_failed").alias("token_ledger")
    rows = views.view(spark, d, views.SUMMARIES).select("run_id", "taskid", "domain", "gt_userid", "seed", "schema_valid", ledger)
    rows.union(rows.limit(1).withColumn("run_id", F.lit(None).cast("string"))).write.json(folder)
    read = spark.read.schema(io.SUMMARY).json(folder)
    return io.named_runs(read).select("run_id", "schema_valid", F.col("token_ledger.total_tokens").alias("total_tokens"))


@query("SELECT 'run' || (conv_id // 4) AS report_run, conv_id * 10 + turn AS query_sequence, role AS query, CASE WHEN turn % 3 > 0 THEN '0' END AS pos, CASE WHEN turn % 3 > 0 THEN 'https://a.example/' || conv_id END AS link FROM conversations")
def r007_read_search_responses(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, "SELECT concat('run', conv_id div 4) AS report_run, conv_id * 10 + turn AS query_sequence, role AS query, named_struct('organic', CASE WHEN turn % 3 > 0 THEN array(named_struct('title', role, 'link', concat('https://a.example/', conv_id), 'position', 1, 'snippet', 's')) ELSE array() END) AS response FROM conversations")
    return io.read_search_responses(spark, _json(rows, _folder(spark))).select("report_run", "query_sequence", "query", F.col("pos").cast("string").alias("pos"), "link")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def r008_write_table(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    io.write_table(spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), folder, "csv")
    return spark.read.schema("l_returnflag string, l_linestatus string, n long").csv(folder, header=True)


@query(f"SELECT run_id, stage FROM ({duck(matches_sql(0))}) WHERE taskid % 2 = 1")
def r009_pending(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d).select("run_id", "stage", "taskid")
    return io.pending(m.select("run_id", "stage"), m.where("taskid % 2 = 0"), ["run_id", "stage"])


@query("""SELECT 'runs/s' || (o_custkey % 5) || '_seed' || (o_orderkey % 2) AS folder, CAST(o_orderkey % 2 AS VARCHAR) AS seed, CASE o_orderkey % 3 WHEN 0 THEN 'artifact' WHEN 1 THEN 'match' ELSE 'other' END AS kind, count(*) AS files, CAST(sum(o_custkey) AS BIGINT) AS bytes FROM orders GROUP BY ALL""")
def r101_run_inventory(spark: SparkSession, d: str) -> DataFrame:
    return quality.run_inventory(views.view(spark, d, "SELECT concat('runs/s', o_custkey % 5, '_seed', o_orderkey % 2, '/', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '_artifacts.json' WHEN 1 THEN '_match.json' ELSE '.txt' END) AS path, o_custkey AS length FROM orders"))


@query("SELECT 'supplier-' || s_suppkey AS name, CAST(octet_length(encode(s_name)) + 1 AS BIGINT) AS length, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def r042_file_inventory(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark)
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_name", F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("name"))
    tasks = max(1, -(-rows.count() // FILES))
    # Each file costs its task some 10 ms whatever it holds: tasks write alike many, and move them in place themselves.
    rows.repartition(tasks, "name").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("name").text(folder)
    files = io.file_inventory(spark, folder).where("length > 0")
    return files.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "length", "sha256")
