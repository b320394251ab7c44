"""Readers of run logs and profiles, the result writer, and resume."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagesignal.functions.scalars import RUN_ID, parse_run_id

STAGES = ("plan", "search", "compress", "write")
QUERY = "id bigint, taskid bigint, userid string, domain string, task string, query string, language string"
ITEM = "id string, question string, category string, profile array<struct<id: string, category: string, text: string>>"
MATCH = ("run_id string, stage string, gt_userid string, predicted_userid string, correct boolean, candidate_userids array<string>, shuffled_order array<string>, method string, "
         "prompt_chars bigint, input_tokens bigint, output_tokens bigint, total_tokens bigint")
SOURCE = "struct<query: string, title: string, link: string, domain: string, rank: int, snippet: string>"
CONFIG = "struct<generation_seed: bigint, manifest_sha256: string, prompt_sha256: string, service_tier: string, timeout_sec: bigint, models: map<string, string>>"
LEDGER = ("struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, token_usage_events: bigint, queries_requested: bigint, queries_attempted: bigint, queries_successful: bigint, queries_failed: bigint, "
          "queries_rejected: bigint, sources_selected: bigint, unique_sources: bigint, query_ledger_consistent: boolean, source_ledger_consistent: boolean>")
ARTIFACT = (f"schema_version string, run_id string, research_brief string, research_topics array<struct<topic_id: string, topic_text: string>>, execution_config {CONFIG}, search_trace array<struct<topic_id: string, query_id: string, query: string, attempted: boolean, status: string, failure_code: string, sources: array<{SOURCE}>>>, "
            "compressed_research array<struct<topic_id: string, topic_text: string, compressed_research: string>>, "
            f"final_report string, token_ledger {LEDGER}, execution_error string")
RESPONSE = "report_run string, query_sequence bigint, query string, response struct<organic: array<struct<title: string, link: string, position: int, snippet: string>>>"
SUMMARY = ("run_id string, taskid bigint, domain string, gt_userid string, seed bigint, schema_valid boolean, success_criteria_met boolean, completeness_errors array<string>, schema_errors array<string>, "
           "ledger_errors array<string>, execution_error string, token_ledger struct<total_tokens: bigint, elapsed_sec: double, queries_attempted: bigint, queries_successful: bigint, queries_failed: bigint>")


def _refuse(bad: DataFrame, message: str) -> None:
    first = bad.limit(1).collect()
    if first:
        raise ValueError(f"{message}: {first[0].asDict()}")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """userid, body (JSON text) of a JSON-lines file; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.get_json_object("value", "$.userid").alias("userid"), F.col("value").alias("body"))


def read_queries(spark: SparkSession, path: str, language: str = "en") -> DataFrame:
    return spark.read.schema(QUERY).json(path).where(F.col("language").isNull() | (F.col("language") == language))


def read_profile_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON arrays with a question and a profile; a repeated id is an error."""
    items = spark.read.schema(ITEM).json(path, multiLine=True).where((F.trim(F.coalesce("question", F.lit(""))) != "") & (F.size("profile") >= 1))
    _refuse(items.groupBy("id").count().where("count > 1"), "Duplicate item ids")
    return items


def read_matches(spark: SparkSession, path: str, glob: str = "*_match.json") -> DataFrame:
    """Decisions of a directory of JSON arrays with task and seed from the run id; unknown stages, run ids that do not parse and duplicates
    are errors, in this order. One pass over the files checks all three."""
    rows = spark.read.schema(MATCH).option("pathGlobFilter", glob).json(path, multiLine=True)
    unknown, odd = ~F.col("stage").isin(*STAGES), ~F.coalesce(F.col("run_id").rlike(RUN_ID), F.lit(False))
    fault = F.when(unknown, 0).when(odd, 1).when(F.col("count") > 1, 2)
    first = rows.groupBy("run_id", "stage").count().withColumn("fault", fault).where("fault is not null").orderBy("fault").limit(1).collect()
    if first:
        raise ValueError(f"{('Unknown stage', 'Run id does not parse', 'Duplicate match records')[first[0]['fault']]}: {first[0].asDict()}")
    parsed = parse_run_id(F.col("run_id"))
    return rows.withColumn("correct", F.coalesce("correct", F.lit(False))).withColumn("taskid", parsed["taskid"]).withColumn("seed", parsed["seed"])


def read_artifacts(spark: SparkSession, path: str, glob: str = "*_artifacts.json") -> DataFrame:
    rows = spark.read.schema(ARTIFACT).option("pathGlobFilter", glob).json(path, multiLine=True)
    _refuse(rows.where(~F.coalesce(F.col("run_id").rlike(RUN_ID), F.lit(False))).select("run_id"), "Run id does not parse")
    _refuse(rows.groupBy("run_id").count().where("count > 1"), "Duplicate artifacts")
    return rows


def read_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per-run summaries; batch files and rows without a run id are skipped."""
    return named_runs(spark.read.schema(SUMMARY).option("pathGlobFilter", "*_summary.json").json(path, multiLine=True))


def named_runs(rows: DataFrame) -> DataFrame:
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.where(~name.startswith("batch_") & F.col("run_id").isNotNull())


def read_search_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per organic result, and one with nulls for a query without any."""
    rows = spark.read.schema(RESPONSE).json(path)
    return rows.select("report_run", "query_sequence", "query", F.posexplode_outer("response.organic").alias("pos", "o")).select("report_run", "query_sequence", "query", "pos", "o.title", "o.link", "o.snippet")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A result table as csv (with header; arrays as JSON text), json or parquet."""
    if fmt == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units without output yet."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of all files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all machines share (spark.checkpoint.dir). Only a local session gets one of its own where
    none is named."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df by way of the shared checkpoint folder: lineage ends there, so it is computed once and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
