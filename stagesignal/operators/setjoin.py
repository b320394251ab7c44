"""Exact top-k set join in blocks: the most similar members of a target's pool by token Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagesignal.sources.io import settle

#: Members of a block that give its targets their first thresholds; frequent tokens that are multiplied; rows of a block.
SAMPLE, FREQUENT, MOST_SENT = 64, 512, 8192
#: Targets and members that are compared at once.
ROWS, CHUNK = 512, 1024


def jaccard(a: Column, b: Column) -> Column:
    """Rounded to four digits; 0 of two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    return F.round(F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0)), 4)


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays as all their values and the arrays' starts."""
    lists = table[name].combine_chunks()
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)


def _shared(own: np.ndarray, owner: np.ndarray, n: int, met: np.ndarray, holder: np.ndarray, m: int) -> np.ndarray:
    """How many values each of n sets (value, set) shares with each of m others: the frequent values by a multiplication, the
    others through the sets that hold each."""
    vocabulary, at, held = np.unique(own, return_inverse=True, return_counts=True)
    if not len(vocabulary):
        return np.zeros((n, m), np.int64)
    place = np.minimum(np.searchsorted(vocabulary, met), len(vocabulary) - 1)
    there = vocabulary[place] == met
    place, holder = place[there], holder[there]
    often = np.full(len(vocabulary), -1)
    top = np.argsort(-held, kind="stable")[:FREQUENT]
    often[top] = np.arange(len(top))
    a, b = np.zeros((n, len(top)), np.float32), np.zeros((len(top), m), np.float32)
    mine, theirs = often[at] >= 0, often[place] >= 0
    a[owner[mine], often[at[mine]]] = 1
    b[often[place[theirs]], holder[theirs]] = 1
    out = np.rint(a @ b).astype(np.int64)
    at, owner, place, holder = at[~mine], owner[~mine], place[~theirs], holder[~theirs]
    order = np.argsort(at, kind="stable")
    start = np.searchsorted(at[order], np.arange(len(vocabulary) + 1))
    times = (start[1:] - start[:-1])[place]
    first = np.repeat(start[place] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) if len(times) else np.zeros(0, np.int64)
    sets = owner[order[first + np.arange(times.sum())]] if len(first) else first
    return out + np.bincount(sets * m + np.repeat(holder, times), minlength=n * m).reshape(n, m)


def _block(k: int, sample: int):
    """The k best members of a block for each target of a block."""

    def best(targets: pa.Table, members: pa.Table) -> pa.Table:
        found: list[tuple[str, str, float]] = []
        names, ids = targets["target"].to_pylist(), members["userid"].to_pylist()
        if names and ids:
            place = {u: r for r, u in enumerate(sorted(ids))}
            rank = np.array([place[u] for u in ids])
            listed = np.array(sorted(ids), dtype=object)
            (own, own_at), (met, met_at) = _lists(targets, "tokens"), _lists(members, "tokens")
            size = np.diff(met_at)
            by_size = np.argsort(size, kind="stable")
            first = by_size[:: max(1, len(by_size) // sample)]
            rest = by_size[~np.isin(by_size, first)]
            chunks = [first[i : i + CHUNK] for i in range(0, len(first), CHUNK)] + [rest[i : i + CHUNK] for i in range(0, len(rest), CHUNK)]
            parts = [(size[c], np.concatenate([met[met_at[j] : met_at[j + 1]] for j in c]), np.repeat(np.arange(len(c)), size[c]), rank[c]) for c in chunks]
            for begin in range(0, len(names), ROWS):
                end = min(begin + ROWS, len(names))
                wanted = np.diff(own_at[begin : end + 1])
                values, owner = own[own_at[begin] : own_at[end]], np.repeat(np.arange(end - begin), wanted)
                self = np.array([place.get(u, -1) for u in names[begin:end]])
                keys = np.full((end - begin, k), -1, np.int64)  # similarity times 10,000, then the earlier id
                for sizes, theirs, holder, ranks in parts:
                    bound = np.minimum(wanted, sizes.max()) / np.maximum(np.maximum(wanted, sizes.min()), 1)
                    bound[(wanted == 0) & (sizes.min() == 0)] = 0
                    asked = np.flatnonzero(bound * 10_000 + 1 >= keys.min(axis=1) >> 32)
                    if not len(asked):
                        continue
                    line = np.full(end - begin, -1)
                    line[asked] = np.arange(len(asked))
                    kept = line[owner] >= 0
                    shared = _shared(values[kept], line[owner[kept]], len(asked), theirs, holder, len(sizes))
                    union = np.maximum(wanted[asked][:, None] + sizes[None, :] - shared, 1)
                    score = (20_000 * shared + union) // (2 * union)  # rounded half up
                    key = (score << 32) + (2**32 - 1 - ranks)[None, :]
                    key[ranks[None, :] == self[asked][:, None]] = -1
                    every = np.concatenate([keys[asked], key], axis=1)
                    keys[asked] = np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
                for t, row in enumerate(keys):
                    found += [(names[begin + t], listed[2**32 - 1 - (x & (2**32 - 1))], (x >> 32) / 10_000) for x in row.tolist() if x >= 0]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table({"target": pa.array(columns[0], pa.string()), "userid": pa.array(columns[1], pa.string()), "jaccard": pa.array(columns[2], pa.float64())})

    return best


def nearest_sets(targets: DataFrame, members: DataFrame, k: int, sample: int = SAMPLE) -> DataFrame:
    """target, userid, jaccard, rank of the k members of the target's pool with the highest Jaccard (rounded to 4, ties by id as text).

    targets(target, pool, tokens) and members(pool, userid, tokens) hold sets; a target is no member for itself. Each pool's
    targets and members are dealt into blocks of about MOST_SENT rows, and each block of targets meets each of members once:
    tokens travel as 64-bit hashes; what two sets share is counted for CHUNK members at once, the frequent tokens by a
    multiplication, the rare ones through the targets that hold them. The first `sample` members of a block, of all sizes,
    give each target a threshold; members whose size alone rules them out are not compared. The work is that of all
    pairs of a pool, memory that of a block, and the plan has the same size for any input."""
    hashes = F.transform(F.coalesce("tokens", F.array()), lambda t: F.xxhash64(t)).alias("tokens")
    members, targets = settle(members.select("pool", "userid", hashes)), settle(targets.select("target", "pool", hashes))
    count = lambda df, name: df.groupBy("pool").agg(F.ceil(F.count("*") / max(MOST_SENT, 1)).cast("int").alias(name))
    blocks = settle(count(targets, "n_targets").join(count(members, "n_members"), "pool"))
    dealt = lambda df, key, own, other, mine, theirs: df.join(blocks, "pool").select("*", F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(theirs))
    a = dealt(targets, "target", "n_targets", "n_members", "a", "b").select("pool", "a", "b", "target", "tokens")
    b = dealt(members, "userid", "n_members", "n_targets", "b", "a").select("pool", "a", "b", "userid", "tokens")
    near = a.groupBy("pool", "a", "b").cogroup(b.groupBy("pool", "a", "b")).applyInArrow(_block(k, sample), "target string, userid string, jaccard double")
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("jaccard"), "userid"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
