"""Candidate construction: eligibility, quotas, sampling, hard negatives, orders and run plans."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stagesignal.functions.scalars import hash64, pool_label
from stagesignal.operators import setjoin
from stagesignal.sources.io import settle

#: The pool of all domains; that of one has a name with "=" in front.
EVERY = "*"


def hash_order(seed: int, *keys: Column) -> Column:
    """A seeded order that only the keys' values decide."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def eligible_tasks(queries: DataFrame, owners: DataFrame, least: int = 3) -> DataFrame:
    """queries(taskid, userid, domain, task, query), owners(userid): who has an actionable token. Per task: kept users, reasons
    (empty_field, dup_<user>, insufficient_actionable_personas) and whether it is eligible: without any reason."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    empty = blank("domain") | blank("task") | blank("userid") | blank("query")
    per = queries.groupBy("taskid", F.coalesce("userid", F.lit("")).alias("userid")).agg(F.count("*").alias("n"), F.count_if(empty).alias("blank"))
    per = per.join(owners.select("userid", F.lit(True).alias("own")).distinct(), "userid", "left")
    dups = F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.concat(F.lit("dup_"), "userid"), (F.col("n") - 1).cast("int")))))  # each time but the first
    out = per.groupBy("taskid").agg(F.sum("blank").alias("blank"), dups.alias("dups"), F.count_if(F.col("own")).alias("kept"))
    reasons = F.concat(F.when(F.col("blank") > 0, F.array(F.lit("empty_field"))).otherwise(F.array()), F.col("dups"), F.when(F.col("kept") < least, F.array(F.lit("insufficient_actionable_personas"))).otherwise(F.array()))
    return out.select("taskid", F.col("kept").alias("kept_users"), F.concat_ws(",", reasons).alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Integer quotas that add up to total; leftover units go to the largest remainders, ties by key. One row per stratum."""
    every = Window.partitionBy(F.lit(1))
    share = F.col(weight) * F.lit(total) / F.sum(weight).over(every)
    rows = weights.withColumn("_floor", F.floor(share)).withColumn("_rest", F.round(share - F.floor(share), 12))
    left = F.lit(total) - F.sum("_floor").over(every)
    place = F.row_number().over(every.orderBy(F.desc("_rest"), key))
    return rows.withColumn("_left", left).withColumn("_place", place).select(key, (F.col("_floor") + (F.col("_place") <= F.col("_left")).cast("long")).alias("quota"))


def _first(rows: DataFrame, by: list[str], order: Column, quota: DataFrame) -> DataFrame:
    """The first rows of each group by a hexadecimal hash, as many as quota(by, quota) says. Groups are never put in order
    whole: hashes are dealt into 4,096 ranges, and only the range in which the quota is met is ranked."""
    keyed = rows.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, 3))
    sums = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    cuts = sums.withColumn("_before", before).join(quota, by).where(F.col("_before") < F.col("quota")).select(*by, "_range", (F.col("quota") - F.col("_before")).alias("_left"), "_n")
    met = keyed.join(cuts, [*by, "_range"])
    whole = met.where("_n <= _left").drop("_order", "_range", "_left", "_n")
    place = F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_order"))
    part = met.where("_n > _left").withColumn("_place", place).where("_place <= _left").drop("_order", "_range", "_left", "_n", "_place")
    return whole.union(part)


def stratified_sample(rows: DataFrame, stratum: str, key: str, total: int, seed: int) -> DataFrame:
    """A sample of about total rows, quotas by stratum size, in seeded hash order within each."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    return _first(rows, [stratum], hash_order(seed, F.col(key)), largest_remainder(sizes, stratum, "_size", total))


def stratified_splits(rows: DataFrame, stratum: str, key: str, splits: Sequence[tuple[str, int]], seed: int, subsets: Sequence[tuple[str, str, int]] = ()) -> DataFrame:
    """Disjoint samples (name, total) from one order of each stratum, with split; each has quotas by what the ones before it
    left of the strata. subsets (name, split, total) are samples of a split with quotas by its own: subset, or null. Splits are
    ranges of ranks, so the rows are ranked once, and only as many as are asked for."""
    quotas = rows.groupBy(stratum).agg(F.count("*").alias("_left"))
    for name, total in splits:
        quota = largest_remainder(quotas.select(stratum, "_left"), stratum, "_left", total).withColumnRenamed("quota", f"_q_{name}")
        quotas = settle(quotas.join(quota, stratum).withColumn("_left", F.col("_left") - F.col(f"_q_{name}")))  # a row per stratum
    for name, of, total in subsets:
        quota = largest_remainder(quotas.select(stratum, f"_q_{of}"), stratum, f"_q_{of}", total).withColumnRenamed("quota", f"_s_{name}")
        quotas = quotas.join(quota, stratum)
    quotas = settle(quotas)
    order = hash_order(seed, F.col(key))
    taken = _first(rows, [stratum], order, quotas.select(stratum, sum((F.col(f"_q_{name}") for name, _ in splits), F.lit(0)).alias("quota")))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    ranked = taken.withColumn("_at", place).join(quotas, stratum)
    start, end, split, subset = {}, F.lit(0), F.lit(None), F.lit(None)
    for name, _ in splits:
        start[name] = end
        end = end + F.col(f"_q_{name}")
        split = F.coalesce(split, F.when(F.col("_at") <= end, name))
    for name, of, _ in subsets:
        subset = F.coalesce(subset, F.when((F.col("_at") > start[of]) & (F.col("_at") <= start[of] + F.col(f"_s_{name}")), name))
    return ranked.select(*rows.columns, split.alias("split"), subset.alias("subset"))


def pick_members(groups: DataFrame, group: str, member: str, k: int, seed: int) -> DataFrame:
    """k members of each group in seeded hash order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(group), F.col(member))))
    return groups.withColumn("place", place).where(F.col("place") <= k)


def complete_groups(rows: DataFrame, group: str, key: str, size: int, total: int) -> DataFrame:
    """Whole groups of exactly size, in order, while they fit into total; then single rows of other groups fill up."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    whole = counts.where(F.col("_n") == size).orderBy(group).limit(max(0, total // size)).select(group)
    taken = rows.join(whole, group, "left_semi")
    rest = rows.join(whole, group, "left_anti").orderBy(group, key).limit(max(0, total - taken.count()))
    return taken.union(rest)


def sample_pool(rows: DataFrame, chosen: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows per category that were not chosen."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, F.col(key))))
    return rows.join(chosen.select(key), key, "left_anti").withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def hard_negatives(targets: DataFrame, profiles: DataFrame, k: int = 2, fallback_below: int = 2, sample: int = setjoin.SAMPLE) -> DataFrame:
    """The k profiles of a target's domain with the highest token Jaccard (rounded to 4, ties by id as text), by a top-k
    set join in blocks.

    targets(userid) are a set of queries among profiles(userid, domain, tokens: a set). Domains with fewer than
    fallback_below others draw on all domains; profiles that share no token rank last, by id."""
    profiles = settle(profiles.select("userid", "domain", "tokens"))
    crowd = profiles.groupBy("domain").agg(F.count("*").alias("crowd"))
    wide = F.col("crowd") - 1 < fallback_below
    asked = targets.select("userid").distinct().join(profiles, "userid").join(crowd, "domain").select(F.col("userid").alias("target"), F.when(wide, EVERY).otherwise(F.concat(F.lit("="), "domain")).alias("pool"), "tokens", wide.alias("fallback_pool"))
    members = profiles.select(F.concat(F.lit("="), "domain").alias("pool"), "userid", "tokens")
    if not asked.where("fallback_pool").isEmpty():
        members = members.unionByName(profiles.select(F.lit(EVERY).alias("pool"), "userid", "tokens"))
    near = setjoin.nearest_sets(asked, members, k, sample)
    return near.join(asked.select("target", "fallback_pool"), "target").select("target", "rank", "userid", "jaccard", pool_label(F.col("jaccard")).alias("pool"), "fallback_pool")


def candidate_sets(ranked: DataFrame, sizes: Sequence[int] = (2, 3, 5)) -> DataFrame:
    """Nested prefixes of one ranking: the target first, then its negatives. ranked(target, rank, userid)."""
    listed = ranked.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "userid"))).alias("r"))
    every = F.concat(F.array("target"), F.transform("r", lambda x: x["userid"]))
    return listed.select("target", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"), every.alias("e")).select("target", "n", F.slice("e", 1, F.col("n")).alias("candidates")).where(F.size("candidates") == F.col("n"))


def frozen_mismatches(sets: DataFrame, frozen: DataFrame, n: int = 3) -> DataFrame:
    """Targets whose set of n, made anew, is not the frozen one (target, frozen), or that lack either. Order counts."""
    again = sets.where(F.col("n") == n).select("target", F.col("candidates").alias("recomputed"))
    return again.join(frozen, "target", "full_outer").where(~F.col("recomputed").eqNullSafe(F.col("frozen"))).select("target", "recomputed", "frozen")


def lookup_candidates(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Each run's candidate set: that of its truth, or for shuffled_actionable runs the task group; valid: three different
    ones with the truth. runs(run_id, taskid, userid, condition), experiments(taskid, gt_userid, candidates, group_users)."""
    joined = runs.join(experiments, (runs["taskid"] == experiments["taskid"]) & (runs["userid"] == experiments["gt_userid"]), "left").drop(experiments["taskid"])
    chosen = F.when(F.col("condition") == "shuffled_actionable", F.col("group_users")).otherwise(F.col("candidates"))
    valid = (F.size(F.array_distinct(chosen)) == 3) & F.array_contains(chosen, F.col("userid"))
    return joined.select("run_id", chosen.alias("candidates"), F.coalesce(valid, F.lit(False)).alias("valid"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _mersenne(keys: pd.Series, candidates: pd.Series) -> pd.Series:
    out = []
    for key, c in zip(keys, candidates):
        c = list(c)
        random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big")).shuffle(c)
        out.append(c)
    return pd.Series(out)


def candidate_order(decisions: DataFrame, method: str = "hash_sort", seed: int = 0) -> DataFrame:
    """Adds shuffled_order, one order per run and stage. `hash_sort` stays in Spark; `mersenne` is the order of Python's
    generator seeded with the first 64 bits of the key's SHA-256."""
    key = F.concat_ws(":", F.lit(str(seed)), "run_id", "stage")
    if method == "mersenne":
        return decisions.withColumn("shuffled_order", _mersenne(key, F.col("candidate_userids")))
    keyed = F.transform("candidate_userids", lambda c: F.struct(F.sha2(F.concat_ws(":", key, c), 256).alias("h"), c.alias("c")))
    return decisions.withColumn("shuffled_order", F.transform(F.array_sort(keyed), lambda x: x["c"]))


def centrality_prior(members: DataFrame) -> DataFrame:
    """The artifact-free guess: the candidate with the highest mean Jaccard to the others of its set, ties by id.
    members(set_id, gt_userid, userid, tokens); sets are small. Each member travels once, with its tokens as 64-bit hashes
    (tokens that are hashes already stay as they are), and its set is compared where it meets."""
    hashed = isinstance(members.schema["tokens"].dataType.elementType, T.LongType)
    toks = F.col("tokens") if hashed else F.transform("tokens", lambda t: F.xxhash64(t))
    met = members.where("set_id is not null").groupBy("set_id").agg(F.collect_list(F.struct("gt_userid", "userid", toks.alias("tokens"))).alias("m"))

    def near(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x["tokens"], y["tokens"]))
        return F.coalesce(F.try_divide(shared, F.size(x["tokens"]) + F.size(y["tokens"]) - shared), F.lit(0.0))

    others = lambda x: F.transform(F.filter("m", lambda y: x["userid"] != y["userid"]), lambda y: near(x, y))
    pairs = met.select("set_id", F.explode(F.transform("m", lambda x: F.struct(x["gt_userid"].alias("gt_userid"), x["userid"].alias("userid"), others(x).alias("js")))).alias("p"))
    mean = pairs.select("set_id", "p.gt_userid", "p.userid", F.explode("p.js").alias("j")).groupBy("set_id", "gt_userid", "userid").agg(F.round(F.avg("j"), 6).alias("centrality"))
    w = Window.partitionBy("set_id").orderBy(F.desc("centrality"), "userid")
    ranked = mean.withColumn("place", F.row_number().over(w)).withColumn("margin", F.round(F.col("centrality") - F.lead("centrality").over(w), 6))
    return ranked.where("place = 1").select("set_id", "gt_userid", F.col("userid").alias("guess"), "centrality", "margin", (F.col("userid") == F.col("gt_userid")).alias("prior_correct"))


def run_plan(sets: DataFrame, profiles: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Every query with every candidate and seed: run id, position, whether it is the truth, hashes of prompt and profile.
    sets(id, gt_userid, question, candidates), profiles(userid, items): items are reduced to id, category and text first. A set
    with a candidate twice, or that does not begin with its truth, is an error."""
    good = (F.size(F.array_distinct("candidates")) == F.size("candidates")) & F.coalesce(F.try_element_at("candidates", F.lit(1)) == F.col("gt_userid"), F.lit(False))
    checked = F.when(good, F.col("candidates")).otherwise(F.raise_error(F.concat(F.lit("candidates repeat or do not begin with the truth: "), F.col("id").cast("string"))).cast(sets.schema["candidates"].dataType))
    rows = sets.withColumn("candidates", checked).select("id", "gt_userid", "question", F.posexplode("candidates").alias("position", "userid"), F.lit(list(seeds)).alias("seeds"))
    rows = rows.select("id", "gt_userid", "question", "position", "userid", F.explode("seeds").alias("seed"))
    plain = F.to_json(F.transform("items", lambda i: F.struct(i["id"].alias("id"), i["category"].alias("category"), i["text"].alias("text"))))
    joined = rows.join(profiles.select("userid", F.sha2(plain, 256).alias("profile_hash")), "userid", "left")
    run_id = F.concat(F.lit("pilot_task"), "id", F.lit("_"), "userid", F.lit("_seed"), "seed")
    return joined.select(run_id.alias("run_id"), "id", "userid", "seed", "position", (F.col("userid") == F.col("gt_userid")).alias("is_gt"), F.sha2("question", 256).alias("prompt_hash"), "profile_hash")


def stable_seed(namespace: Column, base: int = 0) -> Column:
    return hash64(namespace, base)
