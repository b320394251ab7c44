"""Whole-trajectory bootstraps: all stages resampled together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagesignal.operators.metrics import STAGE_ORDER, pivoted
from stagesignal.operators.stats import interval, resamples


PAIRS = (("plan", "search"), ("search", "compress"), ("compress", "write"), ("search", "write"))


def _sums(matches: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Per task, of each stage the right rows and the rows, of each pair the changes and the runs that have both."""
    lost = (F.col("plan") == 1) & (F.col("search") == 0)
    aggs = {s: F.coalesce(F.sum(s), F.lit(0)) for s in STAGE_ORDER} | {f"n_{s}": F.count(s) for s in STAGE_ORDER}
    for a, b in PAIRS:
        change = F.col(b) - F.col(a)
        aggs |= {f"{a}_{b}": F.coalesce(F.sum(change), F.lit(0)), f"n_{a}_{b}": F.count(change)}
    aggs |= {"lost": F.count_if(lost), "recovered": F.count_if(lost & (F.col("write") == 1))}
    return pivoted(matches, (*by, "run_id", "taskid")).groupBy(*by, "taskid").agg(*[c.alias(k) for k, c in aggs.items()]), list(aggs)


def _share(stage: str) -> Column:
    return F.try_divide(stage, f"n_{stage}")


def trajectory_retention(matches: DataFrame, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Whether search dips and write recovers, the share of resamples in which both hold, and intervals in points. Accuracies
    are over the rows that a stage has."""
    sums, parts = _sums(matches)
    drawn = resamples(sums, "taskid", parts, (), reps, seed)
    holds = (_share("search") < _share("plan")) & (_share("write") > _share("search"))
    out = sums.agg(*[F.sum(p).alias(p) for p in parts]).select(holds.alias("observed"))
    for name, a, b in (("dip", "plan", "search"), ("recovery", "search", "write")):
        ends = interval(drawn, 100 * (_share(b) - _share(a)))
        out = out.crossJoin(ends.toDF(f"{name}_low", f"{name}_high"))  # one row each
    return out.crossJoin(drawn.agg(F.round(F.avg(F.coalesce(holds, F.lit(False)).cast("int")), 6).alias("retained")))


def trajectory_with_ci(matches: DataFrame, reps: int = 1000, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Stage accuracies over the rows there are, four changes over the runs that have both stages, and the recovery rate of
    lost runs (over the tasks that have any), each with an interval, per value of by."""
    sums, parts = _sums(matches, by)
    values = {s: _share(s) for s in STAGE_ORDER} | {f"{a}_to_{b}": F.try_divide(f"{a}_{b}", f"n_{a}_{b}") for a, b in PAIRS}
    rate = {"recovery_rate": F.try_divide("recovered", "lost")}
    long = lambda df, values: df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("value")) for k, v in values.items()])).alias("x")).select(*by, "x.*")
    point = long(sums.groupBy(*by).agg(*[F.sum(p).alias(p) for p in parts]), values | rate).withColumn("value", F.round("value", 6))
    drawn = long(resamples(sums, "taskid", parts, by, reps, seed), values).unionByName(long(resamples(sums.where("lost > 0"), "taskid", ["lost", "recovered"], by, reps, seed), rate))
    keys = [*by, "measure"]
    return point.join(interval(drawn, F.col("value"), keys), keys, "left")
