"""Mixing sources to target weights.

Efraimidis-Spirakis sampling: each document draws u in (0, 1) from its id and gets the exponential key
-ln(u) / weight, its weight being its text quality. A source whose target is e times its size plus a rest is
taken e times whole; then documents are taken in order of their keys until the rest is met. The order is never
sorted in one task: keys are dealt into buckets, bucket sums are prefix-summed, and only the documents of the one
bucket in which the rest is met are put in order.

Defined cases: a null text has size 0; null is a source of its own, the last; rows that share an id share one draw
and are taken together, each counted; a source without words has target 0; an empty table gives an empty result.
Columns of the input other than those named are ignored by `mix` and kept by `mixed_rows`.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stagesignal.llm.common import cut, small, uniform

#: Bytes that count against a text's quality: symbols and digits.
SYMBOLS = b"#$%&*|<>{}[]\\/^~_=+@0123456789"


@F.pandas_udf(T.StructType([T.StructField("size", T.LongType()), T.StructField("weight", T.DoubleType())]))
def measured(texts: pd.Series) -> pd.DataFrame:
    """Words of each text, and its quality weight: 1 for plain prose, less for every symbol and digit, 0.05 at least."""
    sizes, weights = [], []
    for text in texts:
        raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
        sizes.append(len(raw.split()))
        odd = len(raw) - len(raw.translate(None, SYMBOLS))
        weights.append(max(0.05, 1.0 - 3.0 * odd / max(len(raw), 1)))
    return pd.DataFrame({"size": sizes, "weight": weights})


def _key(id_col: Column, weight: Column, seed: int) -> Column:
    return -F.log(uniform(F.lit(seed), id_col)) / weight


def _bucket(key: Column, buckets: int) -> Column:
    return F.least(F.floor(key / (key + 1) * buckets), F.lit(buckets - 1)).cast("int")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds _rank: the place of each source by code point, null last. Ranged over partitions, not sorted in one."""
    order = [F.col("_source").isNull(), F.col("_source")]
    dealt = cut(sources.repartitionByRange(8, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # 8 rows at most
    before, total = {}, 0
    for part in sorted(counts):
        before[part], total = total, total + counts[part]
    start = F.lit(0).cast("long")
    for part, n in before.items():
        start = F.when(F.col("_part") == part, F.lit(n).cast("long")).otherwise(start)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_rank", place + start).drop("_part")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources(_source, _size) with _target: share of all sizes dealt by weight, stopped at cap times a source's
    size, the excess dealt again until no source is above. Each round sees one row of sums."""
    ranked = _ranked(sources)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int") + 1)
    ranked = cut(ranked.withColumn("_weight", weight).withColumn("_most", cap * F.col("_size")))
    first = ranked.agg(F.sum("_size").alias("size"), F.sum("_weight").alias("w")).first()
    budget = share * (first["size"] or 0)
    level, full = budget / first["w"] if first["w"] else 0.0, -1
    while True:
        above = F.lit(level) * F.col("_weight") >= F.col("_most")
        r = ranked.agg(
            F.count_if(above).alias("n"), F.sum(F.when(above, F.col("_most"))).alias("kept"),
            F.sum(F.when(~above, F.col("_weight"))).alias("w"),
        ).first()
        if r["n"] == full or not r["w"]:
            break
        level, full = (budget - (r["kept"] or 0.0)) / r["w"], r["n"]
    return ranked.select("_source", "_size", F.least(F.lit(level) * F.col("_weight"), F.col("_most")).alias("_target"))


def plan(base: DataFrame, weights: Sequence[float], share: float, cap: float, buckets: int) -> tuple[DataFrame, int]:
    """One row per source of base(_id, _source, _size, _key): its size and target, the whole epochs, and the last
    key and id that the rest takes. Also the number of sources."""
    sources = targets(base.groupBy("_source").agg(F.sum("_size").alias("_size")), weights, share, cap)
    epochs = F.when(F.col("_size") > 0, F.floor(F.col("_target") / F.col("_size"))).otherwise(0).cast("long")
    sources = cut(sources.withColumn("_epochs", epochs).withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_size")))
    n = sources.count()
    to_plan = small(sources.select(F.col("_source").alias("_s"), "_rest"), n)
    sums = base.groupBy("_source", _bucket(F.col("_key"), buckets).alias("_b")).agg(F.sum("_size").alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_b"))
    cross = (
        sums.withColumn("_upto", upto).join(to_plan, F.col("_source").eqNullSafe(F.col("_s")))
        .where((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_sum") < F.col("_rest")))
        .select("_s", F.col("_b").alias("_cross"), (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_left"))
    )
    cross = cut(cross)
    within = (
        base.join(small(cross, n), F.col("_source").eqNullSafe(F.col("_s")) & (_bucket(F.col("_key"), buckets) == F.col("_cross")))
        .groupBy("_source", "_left", "_key", "_id").agg(F.sum("_size").alias("_sum"))
    )
    end = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_key", F.col("_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    last = (
        within.withColumn("_mid", end - F.col("_sum") / 2).where(F.col("_mid") < F.col("_left"))
        .groupBy(F.col("_source").alias("_l")).agg(F.max(F.struct("_key", "_id")).alias("_last"))
    )
    out = (
        sources.join(cross, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s", "_left")
        .join(last, F.col("_source").eqNullSafe(F.col("_l")), "left").drop("_l")
    )
    return cut(out.withColumnRenamed("_source", "_s").withColumnRenamed("_size", "_source_size")), n


def _copies(buckets: int) -> Column:
    """Times that a row with _key and _id is taken, by its source's plan."""
    b = _bucket(F.col("_key"), buckets)
    more = (b < F.col("_cross")) | ((b == F.col("_cross")) & (F.struct("_key", "_id") <= F.col("_last")))
    return F.col("_epochs") + F.coalesce(more, F.lit(False)).cast("long")


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), measured(F.col(text_col)).alias("_m"), *more)
    key = _key(F.col("_id"), F.col("_m.weight"), seed)
    return rows.select("_id", "_source", F.col("_m.size").alias("_size"), key.alias("_key"), *[F.col("_row")] * bool(more))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """Per row: id, size (words), source_size, target (of its source) and taken (words that the mix takes of it)."""
    base = cut(_base(docs, id_col, text_col, source_col, seed))
    by_source, n = plan(base, weights, share, cap, buckets)
    return base.join(small(by_source, n), F.col("_source").eqNullSafe(F.col("_s"))).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * _copies(buckets)).alias("taken"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
               weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, buckets: int = 4096) -> DataFrame:
    """The rows of the mix themselves, all columns kept, each as often as it is taken. Texts are read twice rather
    than shuffled."""
    by_source, n = plan(cut(_base(docs, id_col, text_col, source_col, seed)), weights, share, cap, buckets)
    rows = _base(docs, id_col, text_col, source_col, seed, F.struct("*").alias("_row"))
    taken = rows.join(small(by_source, n), F.col("_source").eqNullSafe(F.col("_s"))).select("_row", _copies(buckets).alias("_n"))
    return taken.where("_n > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("_one")).select("_row.*")
