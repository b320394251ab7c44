"""Quality gates over run summaries and file inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_summary(runs: DataFrame, by: Sequence[str] = (), expected: int | None = None) -> DataFrame:
    """Counts of valid, complete, clean and failed runs and sums of the ledger, in one pass. A run is completed if
    schema_valid says anything; the rest of the counts and the sums are over those, but for error_runs (with an error)."""
    done = F.col("schema_valid").isNotNull()
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    missing = F.greatest(F.lit(expected) - F.count("*"), F.lit(0)) if expected is not None else F.count_if(F.col("missing"))
    return runs.groupBy(*by).agg(
        F.count_if(done).alias("completed"), *([missing.alias("missing")] if expected is not None or "missing" in runs.columns else []),
        F.count_if(F.coalesce("error", F.lit("")) != "" if "error" in runs.columns else F.lit(False)).alias("error_runs"), F.count_if(F.col("schema_valid")).alias("schema_valid"), F.count_if(done & F.col("success_criteria_met")).alias("success_met"),
        F.count_if(done & some("completeness_errors")).alias("completeness_issues"), F.count_if(done & some("ledger_errors")).alias("ledger_issues"),
        F.count_if(done & F.col("execution_error").isNotNull()).alias("execution_errors"),
        *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c) for c in ("total_tokens", "elapsed_sec", "queries_attempted", "queries_successful", "queries_failed", "sources_selected")])


def quality_gate(summary: DataFrame, expected: int, most_issues: int = 0) -> DataFrame:
    """Adds the failed checks of each summary row and whether it passes. most_issues: completeness issues allowed."""
    checks: dict[str, Column] = {
        "run count": F.col("completed") == expected, "schema": F.col("schema_valid") == F.col("completed"),
        "completeness issues": F.col("completeness_issues") <= most_issues, "ledger issues": F.col("ledger_issues") == 0, "execution errors": F.col("execution_errors") == 0}
    reasons = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return summary.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def run_inventory(files: DataFrame) -> DataFrame:
    """files(path, length): artifacts, summaries and match files per directory and seed, with their bytes."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike("_artifacts\\.json$"), "artifact").when(name.rlike("_match\\.json$"), "match").when(name.rlike("_summary\\.json$"), "summary").otherwise("other")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    seed = F.regexp_extract("path", "_seed([0-9]+)", 1)
    return files.groupBy(folder.alias("folder"), seed.alias("seed"), kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
