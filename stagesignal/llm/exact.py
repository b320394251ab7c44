"""Exact deduplication by an extendible-hash index on shared files.

Each text, white space folded, hashes to a 64-bit key. The directory starts with one entry; while a bucket holds
more distinct keys than its capacity it is split by its next key bit, and the directory doubles when the bucket is
as deep as the directory is. A bucket is a range of keys with one owner task, which walks its entries in key order,
chains the different texts of one key and compares their bytes. The index (key, chain place, SHA-256, smallest id,
copies) is written to the shared checkpoint folder, and rows look themselves up in it. Copies within an input
partition are folded before the shuffle, so a text with a third of all rows costs an owner one entry per partition.

The directory's depth follows the number of distinct keys, up to 2 ** MOST_DEPTH entries; from then on buckets hold more
keys, which lengthens an owner's walk, not its memory. A row finds its entry of the index by a join in which the rows of
frequent texts stay where they are.

Defined cases: a null text counts as empty; ids are of any type that has an order, a null id sorts after all others; of
rows that repeat both id and text one stays; an empty table gives an empty result. Other columns are ignored by
`duplicates` and kept by `unique_rows`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagesignal.llm.common import SPACES, cut, group_join

#: The directory never has more than 2 ** MOST_DEPTH entries, so it may be broadcast.
MOST_DEPTH = 20
#: Bytes of text that a task holds while it folds the copies of its input partition.
FOLD_BYTES = 24_000_000


def folded(text: Column) -> Column:
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def directory(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Bucket number of each directory entry, from the distinct keys under each prefix of the deepest directory.
    A bucket at full depth may exceed its capacity: its owner then has a longer walk, nothing is dropped."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    full, depth = len(counts), 0
    entries = np.array([[0, 0]])  # per entry: its bucket's first prefix and local depth
    while True:
        width = full >> entries[:, 1]
        over = (sums[np.minimum(entries[:, 0] + width, full)] - sums[entries[:, 0]] > capacity) & (width > 1)
        if not over.any():
            break
        if (entries[over, 1] == depth).any():  # the directory doubles
            entries, over, depth = np.repeat(entries, 2, axis=0), np.repeat(over, 2), depth + 1
        place = np.arange(len(entries)) * (full >> depth)
        half = (full >> entries[:, 1]) >> 1
        upper = over & (place >= entries[:, 0] + half)
        entries[upper, 0] += half[upper]
        entries[over, 1] += 1
    return np.unique(entries[:, 0], return_inverse=True)[1]


def _entries(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], schema=pa.schema(schema))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a partition as one entry; flushed when the texts held grow large."""
    held: dict[str, list] = {}
    size, kind = 0, pa.null()

    def out() -> pa.RecordBatch:
        columns = [[e[0] for e in held.values()], list(held), [e[1] for e in held.values()], [e[2] for e in held.values()]]
        return _entries([("_key", pa.int64()), ("_text", pa.string()), ("_least", kind), ("_n", pa.int64())], columns)

    for batch in batches:
        kind = batch.schema.field("_id").type
        for key, text, i in zip(batch["_key"].to_pylist(), batch["_text"].to_pylist(), batch["_id"].to_pylist()):
            if (e := held.get(text)) is None:
                held[text] = [key, i, 1]
                size += 4 * len(text)
                if size > FOLD_BYTES:
                    yield out()
                    held, size = {}, 0
            else:
                e[1], e[2] = _least(e[1], i), e[2] + 1
    if held:
        yield out()


def _least(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else min(a, b)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks entries in key order; the chain of a key holds its different texts."""
    now, chain, kind = None, [], pa.null()

    def rows() -> list[tuple]:
        return [(now, k, hashlib.sha256(text).hexdigest(), least, n) for k, (text, least, n) in enumerate(chain)]

    def out(done: list[tuple]) -> pa.RecordBatch:
        return _entries([("_key", pa.int64()), ("_chain", pa.int32()), ("_sha", pa.string()), ("_least", kind), ("_copies", pa.int64())], list(zip(*done)) or [()] * 5)

    for batch in batches:
        kind = batch.schema.field("_least").type
        done: list[tuple] = []
        for key, text, least, n in zip(*[batch[c].to_pylist() for c in ("_key", "_text", "_least", "_n")]):
            if key != now:
                done += rows()
                now, chain = key, []
            raw = text.encode("utf-8", "replace")
            for e in chain:
                if e[0] == raw:
                    e[1], e[2] = _least(e[1], least), e[2] + n
                    break
            else:
                chain.append([raw, least, n])
        yield out(done)
    if chain:
        yield out(rows())


def index(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """The index of all texts of docs; keys has the key of every row."""
    spark = docs.sparkSession
    about = keys.agg(F.approx_count_distinct("_key")).first()[0]
    bits = min(MOST_DEPTH, (about // capacity).bit_length() + 4)
    counts = np.zeros(1 << bits, dtype=np.int64)
    prefix = F.shiftrightunsigned(F.col("_key"), 64 - bits)
    under = keys.select("_key").distinct().groupBy(prefix.alias("p")).count().toPandas()  # 2 ** MOST_DEPTH rows at most
    counts[under["p"].to_numpy()] = under["count"]
    owner = directory(counts, max(capacity, 2 * about >> bits))
    depth = len(owner).bit_length() - 1
    entries = spark.createDataFrame(pd.DataFrame({"_entry": np.arange(len(owner)), "_bucket": owner}), "_entry long, _bucket long")
    kind = docs.schema[id_col].dataType.simpleString()
    local = docs.select(F.col(id_col).alias("_id"), folded(F.col(text_col)).alias("_text")).withColumn("_key", F.xxhash64("_text"))
    local = local.mapInArrow(_fold, f"_key long, _text string, _least {kind}, _n long")
    entry = F.shiftrightunsigned(F.col("_key"), 64 - depth) if depth else F.lit(0).cast("long")
    owned = (
        local.withColumn("_entry", entry).join(F.broadcast(entries), "_entry")
        .repartition("_bucket").sortWithinPartitions("_bucket", "_key")
    )
    return cut(owned.select("_key", "_text", "_least", "_n").mapInArrow(_own, f"_key long, _chain int, _sha string, _least {kind}, _copies long"))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), folded(F.col(text_col)).alias("_text"))
    return rows.select("_id", F.xxhash64("_text").alias("_key"), F.sha2("_text", 256).alias("_sha"))


def _decided(docs: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """One row per different (id, text): how often it is there, its group's smallest id and size."""
    keys = cut(_keys(docs, id_col, text_col))
    found = index(docs, keys, id_col, text_col, capacity)
    rows = cut(keys.groupBy("_id", "_key", "_sha").agg(F.count("*").alias("_n")))
    return group_join(rows, found, ["_key", "_sha"], "_copies", found.agg(F.sum("_copies")).first()[0] or 0)


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 512) -> DataFrame:
    """Per row: id, keep_id, group_size, kept and text_sha256, and its index key and chain place."""
    rows = _decided(docs, id_col, text_col, capacity)
    one = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"))
    return one.select(
        F.col("_id").alias(id_col), F.col("_least").alias("keep_id"), F.col("_copies").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_least")) & (F.col("_i") == 1)).alias("kept"), F.col("_sha").alias("text_sha256"),
        F.col("_key").alias("index_key"), F.col("_chain").alias("chain_place"),
    )


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = 512) -> DataFrame:
    """The rows that stay, with all their columns. Texts are not shuffled when few rows go."""
    rows = cut(_decided(docs, id_col, text_col, capacity))
    gone = rows.where(~F.col("_id").eqNullSafe(F.col("_least"))).select("_id", "_sha")
    sha = F.sha2(folded(F.col(text_col)), 256)
    held = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), sha.alias("_h"))
    held = held.join(gone, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_sha")), "left_anti")
    if rows.where("_n > 1").where(F.col("_id").eqNullSafe(F.col("_least"))).limit(1).count():
        held = held.dropDuplicates(["_i", "_h"])
    return held.select("_row.*")
