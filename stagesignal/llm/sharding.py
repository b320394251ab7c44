"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A row's text hashes to a point of the ring; the arc up to the next virtual node belongs to that node's shard. Every
shard has a fixed load bound, the bounds adding up to the rows, at most one apart. A shard first takes the rows of
its own arcs, in ring order, up to its bound; the rows beyond continue clockwise to the next shard with room. So
counts are at most one apart, and only overflowing rows leave the shard that the plain ring gives them.

The driver only sees the count of each arc (shards * nodes of them). A row's place within its arc comes from dealing
arcs into parts of bounded size, so that a text with a third of all rows is ranked by many tasks.

Defined cases: a null text has size 1, a null crc and a ring point of its own; rows with one text lie on one point
and share a shard unless it overflows; repeated rows are told apart by nothing and get different slots; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stagesignal.llm.common import cut


#: Parts that arcs are dealt into, about, in a table of any size.
MOST_PARTS = 65_536


def ring(shards: int, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of all virtual nodes, and the shard of each."""
    points = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(shards) for v in range(nodes)]
    points.sort()
    return np.array([p for p, _ in points]), np.array([s for _, s in points])


def bounded(counts: np.ndarray, owner: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, slot of the first): which places of each arc go to which shard."""
    total = int(counts.sum())
    room = np.full(shards, total // shards)
    room[: total % shards] += 1
    out: list[tuple[int, int, int, int, int]] = []
    used, left = np.zeros(shards, dtype=np.int64), []
    for arc in np.flatnonzero(counts):
        s = owner[arc]
        n = int(min(counts[arc], room[s] - used[s]))
        if n:
            out.append((int(arc), 0, n, int(s), int(used[s])))
            used[s] += n
        if n < counts[arc]:
            left.append((int(arc), n))
    for arc, start in left:
        step = arc
        while start < counts[arc]:
            step = (step + 1) % len(owner)
            s = owner[step]
            n = int(min(counts[arc] - start, room[s] - used[s]))
            if n:
                out.append((arc, start, start + n, int(s), int(used[s])))
                used[s], start = used[s] + n, start + n
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shards: int = 16, nodes: int = 128, part_rows: int = 128) -> DataFrame:
    """Per row: id, size, text_crc32, law ("rows"), shard, slot, grown_shard (null), and home_shard (by the plain ring)."""
    spark = docs.sparkSession
    points, owner = ring(shards, nodes)

    @F.pandas_udf(T.IntegerType())
    def arc_of(point: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, point.to_numpy(), side="left") % len(points), index=point.index)

    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(text).cast("long").alias("_crc"), arc_of(F.xxhash64(text)).alias("_arc"),
    )
    base = cut(base)
    counts = np.zeros(len(points), dtype=np.int64)
    for r in base.groupBy("_arc").count().collect():  # shards * nodes rows at most
        counts[r["_arc"]] = r["count"]
    size = max(part_rows, int(counts.sum()) // MOST_PARTS)
    arcs = pd.DataFrame({"_a": np.arange(len(points)), "_parts": -(-counts // size), "_home": owner})
    arcs = spark.createDataFrame(arcs, "_a int, _parts long, _home int")
    rows = base.join(F.broadcast(arcs), F.col("_arc") == F.col("_a"))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id", "_crc"), "_parts"))
    sums = rows.groupBy("_arc", "_part").count()
    before = F.sum("count").over(Window.partitionBy("_arc").orderBy("_part")) - F.col("count")
    sums = sums.select(F.col("_arc").alias("_a2"), F.col("_part").alias("_p2"), before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_arc", "_part").orderBy("_id", "_crc", "_size")) - 1
    placed = rows.withColumn("_within", within).join(sums, (F.col("_arc") == F.col("_a2")) & (F.col("_part") == F.col("_p2")))
    placed = placed.withColumn("_place", F.col("_before") + F.col("_within"))
    runs = spark.createDataFrame(bounded(counts, owner, shards), "_a3 int, _from long, _to long, _shard int, _slot long")
    inside = (F.col("_arc") == F.col("_a3")) & (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))
    return placed.join(F.broadcast(runs), inside).select(  # at most shards * (nodes + 1) runs
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), (F.col("_slot") + F.col("_place") - F.col("_from")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("_home").alias("home_shard"),
    )
