"""Cluster bootstraps, percentile rules and the exact McNemar test.

A bootstrap never touches rows: they are first summed per cluster, and each resample adds up cluster sums. Clusters lie in
blocks of a bounded number; a task counts how often each resample draws each cluster of its block and multiplies the
counts with the sums, so resamples times clusters never exist as rows. Draws are counter-based (a hash of seed, block,
resample and position), so results do not depend on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagesignal.sources.io import settle


#: Clusters of a block, about; draws counted at once; counts of values that the driver may hold.
BLOCK, AT_ONCE, MOST_HELD = 4096, 1 << 20, 65_536
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    """Well mixed 32 bits of 32 bits."""
    h = h & _LOW
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & _LOW
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & _LOW
    return h ^ (h >> np.uint64(16))


def draws(seed: int, block: int, rep: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """The cluster of the block's n that position i of resample rep takes."""
    base = _mix(np.array([seed * 0x9E3779B1 + block], dtype=np.uint64))
    h = _mix(_mix(base + rep.astype(np.uint64) * np.uint64(0x9E3779B1)) + i.astype(np.uint64) * np.uint64(0x85EBCA77))
    return ((h * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _shares(seed: int, levels: int, block: int, path: list[dict], totals: np.ndarray) -> np.ndarray:
    """How many of each resample's draws fall into the block. Down a binary tree of blocks, each node splits what it has by
    a binomial draw of its own stream, the same in every task that passes it."""
    for level, step in enumerate(path):
        node = np.random.Generator(np.random.Philox(key=np.array([seed, level << 48 | block >> (levels - level)], dtype=np.uint64)))
        left = node.binomial(totals, step["left"] / step["total"])
        totals = totals - left if block >> (levels - level - 1) & 1 else left
    return totals


def _resample(by: list[str], cluster: str, parts: list[str], reps: int, seed: int, levels: int, table: pa.Table) -> pa.Table:
    table = table.take(pc.sort_indices(table, sort_keys=[(cluster, "ascending")], null_placement="at_start"))
    block, m = table["_block"][0].as_py(), table.num_rows
    values = np.stack([table[p].cast(pa.float64()).fill_null(0.0).to_numpy() for p in parts], axis=1)
    totals = np.full(reps, table["_n"][0].as_py(), dtype=np.int64)
    totals = _shares(seed, levels, block, table["_path"][0].as_py(), totals) if levels else totals
    sums, at = np.zeros((reps, len(parts))), 0
    while at < reps:
        end = at + max(1, min(int(np.searchsorted(np.cumsum(totals[at:]), AT_ONCE)), AT_ONCE // m))
        n = totals[at:end]
        rep = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        counts = np.bincount(rep * m + draws(seed, block, rep + at, i, m), minlength=len(n) * m).reshape(len(n), m)
        sums[at : at + len(n)] = counts.astype(np.float64) @ values
        at += len(n)
    first = table.slice(0, 1)
    keys = [pa.repeat(first[c][0], reps) for c in by]
    return pa.Table.from_arrays([*keys, pa.array(np.arange(reps), pa.int32()), *(pa.array(c) for c in sums.T)], names=[*by, "_rep", *parts])


def _paths(rows: DataFrame, levels: int) -> DataFrame:
    """For each group's block the steps down the tree: clusters below the node, and below its left child."""
    sizes = rows.groupBy("_g", "_block").agg(F.count("*").alias("c"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    node = lambda depth: F.floor(F.col("_block") / F.pow(F.lit(2), F.lit(levels) - depth)).cast("long")
    totals = sizes.select("_g", "c", "_block", level).groupBy("_g", "level", node(F.col("level")).alias("node")).agg(F.sum("c").alias("total"))
    steps = sizes.select("_g", "_block", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).withColumn("node", node(F.col("level")))
    left = totals.select("_g", (F.col("level") - 1).alias("level"), (F.col("node") / 2).alias("half"), F.col("total").alias("left")).where("half = floor(half)").withColumn("node", F.col("half").cast("long")).drop("half")
    found = steps.join(totals, ["_g", "level", "node"]).join(left, ["_g", "level", "node"], "left")
    return found.groupBy("_g", "_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", F.coalesce("left", F.lit(0)).alias("left"), "total"))), lambda s: F.struct(s["left"].alias("left"), s["total"].alias("total"))).alias("_path"))


def resamples(sums: DataFrame, cluster: str, parts: Sequence[str], by: Sequence[str] = (), reps: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """by, _rep and the sums of parts in each resample. sums has one row per by and cluster."""
    by, parts = list(by), list(parts)
    rows = settle(sums.select(*by, cluster, *parts, (F.to_json(F.struct(*by)) if by else F.lit("")).alias("_g")))
    sizes = settle(rows.groupBy("_g").agg(F.count("*").alias("_n")))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(most / block))) if most else 0
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(cluster), F.lit(1 << levels)))
    dealt = rows.join(sizes, "_g")
    if levels:
        dealt = dealt.join(_paths(rows, levels), ["_g", "_block"])
    schema = T.StructType([*[f for c in by for f in sums.schema if f.name == c], T.StructField("_rep", T.IntegerType()), *[T.StructField(p, T.DoubleType()) for p in parts]])
    out = dealt.groupBy("_g", "_block").applyInArrow(lambda t: _resample(by, cluster, parts, reps, seed, levels, t), schema)
    return out.groupBy(*by, "_rep").agg(*[F.sum(p).alias(p) for p in parts]) if levels else out


def interval(df: DataFrame, value: Column, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Percentile interval (linear rule) of value over resamples, null ones left out."""
    tail = (1 - level) / 2
    return df.withColumn("_v", value).groupBy(*by).agg(
        F.round(F.percentile("_v", tail), 6).alias("ci_low"), F.round(F.percentile("_v", 1 - tail), 6).alias("ci_high"))


def cluster_bootstrap(df: DataFrame, cluster: str, value: Column, by: Sequence[str] = (), reps: int = 1000, seed: int = 0) -> DataFrame:
    """Mean of value with a percentile interval over clusters drawn with replacement, rows pooled."""
    sums = df.groupBy(*by, cluster).agg(F.sum(value.cast("double")).alias("_s"), F.count(value).alias("_c"))
    point = sums.groupBy(*by).agg(F.sum("_c").alias("n"), F.round(F.sum("_s") / F.sum("_c"), 6).alias("mean"))
    ends = interval(resamples(sums, cluster, ["_s", "_c"], by, reps, seed), F.col("_s") / F.col("_c"), by)
    return point.join(ends, list(by)) if by else point.crossJoin(ends)  # one row each


def cluster_bootstrap_means(df: DataFrame, cluster: str, value: Column, by: Sequence[str] = (), reps: int = 1000, seed: int = 0) -> DataFrame:
    """As cluster_bootstrap, but of unweighted cluster means."""
    means = df.groupBy(*by, cluster).agg(F.avg(value.cast("double")).alias("_mean"))
    return cluster_bootstrap(means, cluster, F.col("_mean"), by, reps, seed)


def cluster_bootstrap_contrast(df: DataFrame, cluster: str, value: Column, group: Column, reps: int = 1000, seed: int = 0) -> DataFrame:
    """Difference of the mean of value between group and not group inside each resample; one-sided resamples are skipped."""
    v = value.cast("double")
    sums = df.groupBy(cluster).agg(*[F.sum(F.when(g, x)).alias(n) for g, k in ((group, "1"), (~group, "0")) for x, n in ((v, "_s" + k), (F.lit(1), "_n" + k))]).na.fill(0)
    diff = F.try_divide("_s1", "_n1") - F.try_divide("_s0", "_n0")
    point = sums.agg(*[F.sum(c).alias(c) for c in ("_s1", "_n1", "_s0", "_n0")]).select(F.round(diff, 6).alias("difference"))
    return point.crossJoin(interval(resamples(sums, cluster, ["_s1", "_n1", "_s0", "_n0"], (), reps, seed), diff))


def percentile_ranks(df: DataFrame, value: str, wanted: Sequence[tuple[float, str]], k: int = 4096, buckets: int = 4096) -> DataFrame:
    """Order statistics, a row each of wanted: q, rule, value. Rule `floor` takes floor(q*n), `nearest` round(q*(n-1)),
    `inner` floor for q < 1/2 and ceil - 1 above. Null without numbers.

    The source is read twice, however many are wanted: a mergeable quantile sketch brackets all the places, and one pass
    counts what lies between the brackets and each value inside them. Only those counts are looked into further, by narrowing
    each range; rows are never put in order."""
    spark, rows = df.sparkSession, df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, sketch = rows.agg(F.count("*"), F.kll_sketch_agg_double("v", F.lit(k))).first()
    place = {"floor": lambda q: math.floor(q * n), "nearest": lambda q: math.floor(q * (n - 1) + 0.5), "inner": lambda q: math.floor(q * n) if q < 0.5 else math.ceil(q * n) - 1}
    at = [min(max(place[rule](q), 0), n - 1) for q, rule in wanted]
    kind = df.schema[value].dataType
    if not n:
        return spark.createDataFrame([(q, rule, None) for q, rule in wanted], "q double, rule string, value double").withColumn("value", F.col("value").cast(kind))
    slack = 8.0 / k  # several times the sketch's error
    ends = sorted({min(max(x / n + d, 0.0), 1.0) for x in at for d in (-slack, slack)})
    held = spark.createDataFrame([(bytearray(sketch),)], "s binary").select(F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, ends)))).first()[0]
    cuts, spans = dict(zip(ends, held)), []
    for low, high in sorted((cuts[min(max(x / n - slack, 0.0), 1.0)], cuts[min(max(x / n + slack, 0.0), 1.0)]) for x in at):
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    inside = F.lit(False)
    for low, high in spans:
        inside = inside | F.col("v").between(low, high)
    below = sum((F.when(F.col("v") > high, 1).otherwise(0) for _, high in spans), F.lit(0))
    counted = settle(rows.groupBy(below.alias("part"), inside.alias("inside"), F.when(inside, F.col("v")).alias("x")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high")))
    few = counted.select("low", "high", "c").orderBy("low").limit(MOST_HELD + 1).collect()
    found = [_place(counted, rows, x, buckets) for x in at] if len(few) > MOST_HELD else [_walk(few, x) for x in at]
    found = [_place(counted, rows, x, buckets) if v is None else v for v, x in zip(found, at)]
    return spark.createDataFrame([(q, rule, v) for (q, rule), v in zip(wanted, found)], "q double, rule string, value double").withColumn("value", F.col("value").cast(kind))


def _walk(few: list, at: int) -> float | None:
    """The at-th number where all counts are at hand; None if it lies in a range between brackets."""
    for r in few:
        if at < r["c"]:
            return r["low"] if r["low"] == r["high"] else None
        at -= r["c"]
    return None


def _place(counted: DataFrame, rows: DataFrame, at: int, buckets: int) -> float:
    """The at-th number: counted has values (low = high) and ranges between them with their counts, rows all values. Only if
    a sketch missed and the place lies in a range, that range of the rows is looked into."""
    first, last = counted.agg(F.min("low"), F.max("low")).first()
    while True:
        if first == last:
            end = counted.where(F.col("low") == first).agg(F.max("high")).first()[0]
            if end == first:
                return first
            counted, last = rows.where(F.col("v").between(first, end)).select(F.col("v").alias("low"), F.col("v").alias("high"), F.lit(1).alias("c")), end
        part = F.least(F.floor((F.col("low") - first) / (last - first) * buckets), F.lit(buckets - 1))
        found = counted.where(F.col("low").between(first, last)).groupBy(part.alias("b")).agg(F.sum("c").alias("c"), F.min("low").alias("first"), F.max("low").alias("last"))
        for r in sorted(found.collect()):  # a row per part at most
            if at < r["c"]:
                break
            at -= r["c"]
        first, last = r["first"], r["last"]


def percentile_rank(df: DataFrame, value: str, q: float, rule: str) -> DataFrame:
    """One order statistic."""
    return percentile_ranks(df, value, [(q, rule)]).select("value")


def _mcnemar(b: int, c: int) -> float:
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    i = np.arange(1, k + 1, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i))]) - n * np.log(2.0)
    top = logs.max()
    return float(min(1.0, 2.0 * np.exp(top) * np.exp(logs - top).sum()))


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Two-sided exact binomial p of discordant counts b and c; 1 when there are none. For aggregated rows."""
    return pd.Series([_mcnemar(int(x), int(y)) for x, y in zip(b, c)], index=b.index, dtype="float64")
