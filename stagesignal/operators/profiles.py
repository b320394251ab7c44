"""Nested user profiles as a long table of leaves, and what is made from them.

leaves(userid, path array<string>, key string, value string): one row per leaf, in profile order by `pos`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Leaf names that identify a person.
IDENTITY_KEYS = (
    "Name", "Age", "Gender", "Permanent Residence", "Hometown", "Educational Background", "Occupation", "Family Members and Relationships", "Pets",
    "Parental Expectations", "Environmental Influence", "Living Environment", "Hometown Memories",
)


def _walk(value, path: tuple[str, ...], skip: frozenset[str], lists_are_leaves: bool) -> Iterator[tuple[list[str], str, str]]:
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in skip:
                yield from _walk(v, (*path, k), skip, lists_are_leaves)
    elif isinstance(value, list) and not lists_are_leaves:
        for v in value:
            yield from _walk(v, path, skip, lists_are_leaves)
    elif value is not None:
        yield list(path), path[-1] if path else "", value if isinstance(value, str) else json.dumps(value)


def profile_leaves(profiles: DataFrame, skip_keys: Sequence[str] = (), include_id: bool = True, lists_are_leaves: bool = False) -> DataFrame:
    """profiles(userid, body as JSON) of any depth -> leaves. A skipped key drops its subtree. include_id: the id is a leaf too.
    A body that is no JSON object has no leaves of its own."""
    skip = frozenset(skip_keys)

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for user, body in zip(batch["userid"], batch["body"]):
                try:
                    value = json.loads(body) if isinstance(body, str) else {}
                except ValueError:
                    value = {}
                head = [(["userid"], "userid", user)] if include_id and isinstance(user, str) else []
                for pos, leaf in enumerate([*head, *_walk(value, (), skip, lists_are_leaves)]):
                    rows.append((user, pos, *leaf))
            yield pd.DataFrame(rows, columns=["userid", "pos", "path", "key", "value"]).astype({"pos": "int32"})

    return profiles.select("userid", "body").mapInPandas(flat, "userid string, pos int, path array<string>, key string, value string")


def profile_text(leaves: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Chosen top-level sections as text: "=== Section ===" and a "Key > Key: value" line per leaf, sections as listed, one line after the other."""
    section = F.element_at("path", 1)
    order = F.array_position(F.array(*[F.lit(s) for s in sections]), section)
    label = F.concat_ws(" > ", F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))
    rows = leaves.where(section.isin(list(sections))).select("userid", order.alias("o"), "pos", section.alias("s"), F.concat(F.when(label == "", section).otherwise(label), F.lit(": "), F.col("value")).alias("line"))
    parts = rows.groupBy("userid", "o", "s").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])).alias("text"))
    block = F.concat(F.lit("=== "), F.col("s"), F.lit(" ===\n"), F.col("text"))
    return parts.groupBy("userid").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("o", block.alias("b")))), lambda x: x["b"])).alias("text"))


def project_profile(leaves: DataFrame, condition: str, identity_keys: Sequence[str] = IDENTITY_KEYS) -> DataFrame:
    """`full`, `actionable_only` (no identity leaves) or `identity_only` (those and the id)."""
    own = F.col("key").isin(list(identity_keys))
    keep = {"full": F.lit(True), "actionable_only": ~own, "identity_only": own | (F.col("key") == "userid")}[condition]
    return leaves.where(keep)


def _projected(value: dict, own: frozenset[str], keep: bool) -> dict:
    out = {}
    for key, child in value.items():
        if isinstance(child, dict):
            if inner := _projected(child, own, keep):
                out[key] = inner
        elif (key in own) == keep:
            out[key] = child
    return out


def project_bodies(profiles: DataFrame, condition: str, identity_keys: Sequence[str] = IDENTITY_KEYS) -> DataFrame:
    """profiles(userid, body as JSON) with the nested profile of a projection as body, the id first: `full`,
    `actionable_only` or `identity_only`. A list is one leaf, kept or left out whole, and branches without leaves vanish. A
    projection of which nothing is left, or a body that is no JSON object, is an error. No row moves."""
    own = frozenset(identity_keys)

    @F.pandas_udf("string")
    def projected(user: pd.Series, body: pd.Series) -> pd.Series:
        out = []
        for u, b in zip(user, body):
            try:
                value = json.loads(b) if isinstance(b, str) else None
            except ValueError:
                value = None
            if isinstance(value, dict) and condition != "full":
                value = _projected({k: v for k, v in value.items() if k != "userid"}, own, condition == "identity_only")
            out.append(json.dumps({"userid": u, **{k: v for k, v in value.items() if k != "userid"}}, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) and (value or condition == "full") else None)
        return pd.Series(out, dtype="object")

    if condition not in ("full", "actionable_only", "identity_only"):
        raise ValueError(f"unknown condition: {condition}")
    rows = profiles.withColumn("body", projected("userid", "body"))
    return rows.withColumn("body", F.coalesce("body", F.raise_error(F.concat(F.lit(f"{condition} is empty: "), F.col("userid"))).cast("string")))


def cyclic_donor(groups: DataFrame, group: str, member: str, order: str) -> DataFrame:
    """Adds donor: the next member of the group, the first after the last; null in a group of one."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.first(member).over(w)
    donor = F.coalesce(F.lead(member).over(w), first)
    return groups.withColumn("donor", F.when(donor != F.col(member), donor))


def compose_shuffled(leaves: DataFrame, donors: DataFrame, identity_keys: Sequence[str] = IDENTITY_KEYS) -> DataFrame:
    """The shell's identity leaves with the donor's actionable ones, under the shell's id; donors(userid, donor)."""
    own = project_profile(leaves, "identity_only", identity_keys).join(donors.select("userid"), "userid", "left_semi")
    lent = project_profile(leaves, "actionable_only", identity_keys).where("key <> 'userid'").withColumnRenamed("userid", "donor")
    lent = lent.join(donors.select("userid", "donor"), "donor").select("userid", "pos", "path", "key", "value")
    return own.select("userid", "pos", "path", "key", "value").union(lent)


def conflicts(leaves: DataFrame) -> DataFrame:
    """Paths that hold different values in one composed profile."""
    return leaves.groupBy("userid", F.concat_ws(">", "path").alias("path")).agg(F.count_distinct("value").alias("values")).where("values > 1")


def audit_profiles(leaves: DataFrame, identity_keys: Sequence[str] = IDENTITY_KEYS) -> DataFrame:
    """Per profile: leaves, characters, identity and other leaves, a hash of its sorted leaves, violations."""
    own = F.col("key").isin(list(identity_keys))
    line = F.concat(F.concat_ws(">", "path"), F.lit("="), F.col("value"))
    out = leaves.groupBy("userid").agg(
        F.count("*").alias("leaves"), F.sum(F.length("value")).alias("chars"), F.count_if(own).alias("identity_leaves"), F.count_if(~own & (F.col("key") != "userid")).alias("other_leaves"),
        F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("projection_hash"))
    problems = F.array_compact(F.array(F.when(F.col("identity_leaves") == 0, "no identity"), F.when(F.col("other_leaves") == 0, "nothing actionable")))
    return out.withColumn("violations", F.concat_ws(";", problems))


def audit_projections(leaves: DataFrame, donors: DataFrame, identity_keys: Sequence[str] = IDENTITY_KEYS) -> DataFrame:
    """The audit of all three projections: one row per condition and profile, shuffled_actionable for those of
    donors(userid, donor). Leaves and characters without the id, the identity and other keys present, for shuffled ones
    whether the identity part is the shell's and the actionable part the donor's (by hash of the sorted leaves), and the
    violations found."""
    line = F.concat(F.concat_ws(">", "path"), F.lit("="), F.col("value"))
    body = leaves.where("key <> 'userid'")
    own = F.col("key").isin(list(identity_keys))
    digest = lambda keep: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.when(keep, line)))), 256)
    keys = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("key"))))

    def facts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("userid").agg(F.count("*").alias("leaves"), F.sum(F.length("value")).alias("chars"), keys(own).alias("identity_keys"), keys(~own).alias("other_keys"), digest(own).alias("_own"), digest(~own).alias("_other"))

    everyone = body.select("userid").distinct()
    plain = None
    for condition in ("actionable_only", "identity_only"):
        part = everyone.join(facts(project_profile(body, condition, identity_keys)), "userid", "left").withColumn("condition", F.lit(condition)).withColumns({"donor": F.lit(None).cast("string"), "identity_is_shells": F.lit(None).cast("boolean"), "actionable_is_donors": F.lit(None).cast("boolean")})
        plain = part if plain is None else plain.unionByName(part)
    source = facts(body).select("userid", "_own", "_other")
    mixed = donors.select("userid", "donor").join(facts(compose_shuffled(leaves, donors, identity_keys).where("key <> 'userid'")), "userid", "left").withColumn("condition", F.lit("shuffled_actionable"))
    nothing = F.sha2(F.lit(""), 256)
    mixed = mixed.join(source.select("userid", F.col("_own").alias("_shell")), "userid", "left").join(source.select(F.col("userid").alias("donor"), F.col("_other").alias("_lent")), "donor", "left")
    mixed = mixed.withColumns({"identity_is_shells": F.coalesce("_own", nothing) == F.coalesce("_shell", nothing), "actionable_is_donors": F.coalesce("_other", nothing) == F.coalesce("_lent", nothing)})
    rows = plain.unionByName(mixed.drop("_shell", "_lent")).drop("_own", "_other")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"leaves": F.coalesce("leaves", F.lit(0)), "chars": F.coalesce("chars", F.lit(0)), "identity_keys": F.coalesce("identity_keys", empty), "other_keys": F.coalesce("other_keys", empty)})
    found = F.array_compact(F.array(
        F.when((F.col("condition") == "actionable_only") & (F.size("identity_keys") > 0), "identity leakage"), F.when((F.col("condition") == "identity_only") & (F.size("other_keys") > 0), "actionable leakage"),
        F.when(F.col("leaves") == 0, "empty profile"), F.when(F.col("userid") == F.col("donor"), "self donor"),
        F.when(~F.col("identity_is_shells"), "identity is not the shell's"), F.when(~F.col("actionable_is_donors"), "actionable part is not the donor's")))
    return rows.withColumn("violations", found)


def feature_buckets(leaves: DataFrame, buckets: dict[str, Sequence[str]], tokens: Column) -> DataFrame:
    """Per user and bucket (bucket -> top-level sections): the different tokens of its leaves, in order."""
    bucket = F.lit(None).cast("string")
    for name, sections in buckets.items():
        bucket = F.when(F.element_at("path", 1).isin(list(sections)), name).otherwise(bucket)
    rows = leaves.select("userid", bucket.alias("bucket"), F.explode(tokens).alias("t")).where("bucket is not null")
    return rows.groupBy("userid", "bucket").agg(F.array_sort(F.collect_set("t")).alias("tokens"))


def filter_split(rows: DataFrame, seed: int | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """Rows of one seed (by the run id's suffix) and of the tasks of a split."""
    out = rows if seed is None else rows.where(F.col("run_id").endswith(f"_seed{seed}"))
    return out if tasks is None else out.join(tasks.select("taskid"), "taskid", "left_semi")
