"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: 64-bit SimHash over 4-word shingles hashed with XXH64, computed in numpy for a batch of texts at once.
Links: all different fingerprints are put in the order of their population counts (one count for each byte of the
fingerprint), packed into blocks, and blocks are compared pairwise with exclusive-or and bit counts, in tiles. The
sum over bytes of the gap between two ranges of population counts is a lower bound of the Hamming distance, so block
pairs and tile pairs for which it exceeds the radius are skipped; nothing else is. A task returns a spanning forest
of the links that it finds, never all pairs of a group, and components follow by star steps.

Defined cases: a null text is an empty one; a text without words has fingerprint 0 and is linked like any other; a
text of fewer than four words is one shingle; copies and repeated rows share a fingerprint; a null id is never the
smallest unless all are null; an empty table gives an empty result. Rows are told apart by id and text, so two texts
under one id, or any under null ids, are decided each on its own. Ids are of any type that has an order. Other columns are
kept by `distinct_rows` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagesignal.llm.common import cut, group_join
from stagesignal.llm.components import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Bytes of text hashed at once.
BATCH_BYTES = 1 << 20
#: Rows of a tile and of a block. The driver sees a block's ranges of population counts: 16 bytes for 8,192 fingerprints.
TILE, BLOCK = 256, 8192
#: Block pairs of a task, and tasks at most.
PAIRS, MOST_TASKS = 4, 50_000
#: Tile pairs whose bounds a task holds at once.
MOST_GAPS = 1 << 22
#: Constants of the XXH64 hash (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
LOW_BITS = np.uint64(0x0101010101010101)
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIR = pa.schema([("i", pa.int64()), ("j", pa.int64())])
BLOCKS = pa.schema([("block", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()), ("prints", pa.binary())])


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: bytes, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each slice of data, all slices in step."""
    raw = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    four = np.ndarray((len(raw) - 3,), dtype="<u4", buffer=raw, strides=(1,))
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        h = np.full(len(start), s + P5, dtype=np.uint64)
        at = start.astype(np.int64)
        stripes = length >> 5
        if (wide := np.flatnonzero(stripes)).size:
            p, left = at[wide].copy(), stripes[wide].copy()
            v = np.empty((4, wide.size), dtype=np.uint64)
            v[0], v[1], v[2], v[3] = s + P1 + P2, s + P2, s, s - P1
            on = np.arange(wide.size)
            while on.size:
                q = p[on]
                for k in range(4):
                    v[k, on] = _turn(v[k, on] + eight[q + 8 * k] * P2, 31) * P1
                p[on] += 32
                left[on] -= 1
                on = on[left[on] > 0]
            x = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for k in range(4):
                x = (x ^ (_turn(v[k] * P2, 31) * P1)) * P1 + P4
            h[wide], at[wide] = x, p
        h += length.astype(np.uint64)
        rest = length & 31
        for k in range(3):
            on = np.flatnonzero((rest >> 3) > k)
            if on.size:
                h[on] = _turn(h[on] ^ (_turn(eight[at[on]] * P2, 31) * P1), 27) * P1 + P4
                at[on] += 8
        on = np.flatnonzero(rest & 4)
        if on.size:
            h[on] = _turn(h[on] ^ (four[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
            at[on] += 4
        for k in range(3):
            on = np.flatnonzero((rest & 3) > k)
            if on.size:
                h[on] = _turn(h[on] ^ (raw[at[on]].astype(np.uint64) * P5), 11) * P1
                at[on] += 1
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        h ^= h >> np.uint64(32)
    return h


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The SimHash of each run of hashes (sizes > 0): a bit is set if it is in over half of the run."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Runs are cut into pieces of 255 at most, whose counts fit a byte each.
    pieces = (sizes + 254) // 255
    owner = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[owner] + 255 * nth
    begins = np.cumsum(pieces) - pieces
    out = np.zeros(len(sizes), dtype=np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & LOW_BITS, starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begins, axis=0)
        for byte in range(8):
            out |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + b)
    return out


def fingerprints(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """The fingerprint of each whole text."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    for i, text in enumerate(texts):
        found = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
        if found:
            held.append((i, found))
            size += len(text)
        if size >= BATCH_BYTES:
            _print(held, words, out)
            held, size = [], 0
    if held:
        _print(held, words, out)
    return out


def _print(held: list[tuple[int, list[bytes]]], words: int, out: np.ndarray) -> None:
    n = np.array([len(w) for _, w in held])
    lengths = np.fromiter((len(x) for _, w in held for x in w), dtype=np.int64, count=int(n.sum()))
    data = b" ".join(x for _, w in held for x in w)
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    sizes = np.maximum(n - words + 1, 1)
    base = np.repeat(np.cumsum(n) - n, sizes)
    nth = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = base + nth
    last = first + np.repeat(np.minimum(n, words), sizes) - 1
    start, length = begins[first], ends[last] - begins[first]
    short = length <= 512
    hashes = np.empty(len(start), dtype=np.uint64)
    hashes[short] = xxh64(data, start[short], length[short])
    for k in np.flatnonzero(~short):
        hashes[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + length[k]], SEED)
    out[[i for i, _ in held]] = majority(hashes, sizes)


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(fingerprints(texts.tolist()).view(np.int64), index=texts.index)


def _counts(prints: np.ndarray) -> np.ndarray:
    """Population count of each byte."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

    def out(x: np.ndarray) -> pa.RecordBatch:
        c = _counts(x)
        row = [[(part << 32) + seq], [c.min(axis=0).tobytes()], [c.max(axis=0).tobytes()], [x.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, BLOCKS.types)], schema=BLOCKS)

    for batch in batches:
        held.append(batch["_print"].to_numpy(zero_copy_only=False).view(np.uint64))
        n += len(held[-1])
        while n >= BLOCK:
            x = np.concatenate(held)
            yield out(x[:BLOCK])
            held, n, seq = [x[BLOCK:]], n - BLOCK, seq + 1
    if n:
        yield out(np.concatenate(held))


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Least Hamming distance that the ranges of byte population counts leave open, for all pairs."""
    out = np.zeros((len(lo_a), len(lo_b)), dtype=np.int16)
    for k in range(lo_a.shape[1]):
        out += np.maximum(0, np.maximum(lo_a[:, None, k] - hi_b[None, :, k], lo_b[None, :, k] - hi_a[:, None, k]))
    return out


def _near(ends: list[np.ndarray], radius: int) -> Iterator[tuple[int, int]]:
    """Tile pairs that may hold a link, some rows of tiles at a time, so that memory stays bounded for any block."""
    lo_a, hi_a, lo_b, hi_b = ends
    step = max(1, MOST_GAPS // max(1, len(lo_b)))
    for k in range(0, len(lo_a), step):
        i, j = np.nonzero(_gap(lo_a[k : k + step], hi_a[k : k + step], lo_b, hi_b) <= radius)
        yield from zip(i + k, j)


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within a (b is None) or between a and b."""
    same = b is None
    b = a if same else b
    names = a if same else np.concatenate([a, b])
    root = np.arange(len(names))
    shift = 0 if same else len(a)
    tiles_a, tiles_b = np.arange(0, len(a), TILE), np.arange(0, len(b), TILE)
    ca, cb = _counts(a).astype(np.int16), _counts(b).astype(np.int16)
    ends = [np.minimum.reduceat(ca, tiles_a), np.maximum.reduceat(ca, tiles_a), np.minimum.reduceat(cb, tiles_b), np.maximum.reduceat(cb, tiles_b)]
    forest: list[tuple[int, int]] = []
    members: dict[int, list[int]] = {}
    for i, j in _near(ends, radius):
        if same and j < i:
            continue
        x, y = a[tiles_a[i] : tiles_a[i] + TILE], b[tiles_b[j] : tiles_b[j] + TILE]
        r, c = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
        r, c = r + tiles_a[i], c + tiles_b[j] + shift
        while (open_ := np.flatnonzero(root[r] != root[c])).size:
            # Of the pairs still apart, one for each row and each column; then again.
            r, c = r[open_], c[open_]
            for k in np.union1d(np.unique(r, return_index=True)[1], np.unique(c, return_index=True)[1]):
                u, v = root[r[k]], root[c[k]]
                if u != v:
                    forest.append((int(names[r[k]].astype(np.int64)), int(names[c[k]].astype(np.int64))))
                    few, many = sorted((members.pop(u, [u]), members.pop(v, [v])), key=len)
                    name = root[many[0]]
                    root[few] = name
                    many.extend(few)
                    members[name] = many
    return forest


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = (np.frombuffer(batch[c][k].as_py(), dtype=np.uint64) for c in ("pa", "pb"))
            found = linked(a, None if batch["i"][k].as_py() == batch["j"][k].as_py() else b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*found) if found else ((), ()))], schema=LINKS)


class _Ends:
    """The ranges of population counts of all blocks, and each block's partners: those that its own range may link to."""

    def __init__(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.ids, self.lo, self.hi = ids, lo, hi

    def pairs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch["id"].to_pylist():
                j = k + np.flatnonzero(_gap(self.lo[k : k + 1], self.hi[k : k + 1], self.lo[k:], self.hi[k:])[0] <= RADIUS)
                i = np.full(len(j), k)
                i, j = np.where((i + j) % 2, j, i), np.where((i + j) % 2, i, j)  # so that each block has its share of pairs on either side
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.ids[j])], schema=PAIR)


def links(prints: DataFrame) -> DataFrame:
    """prints(_print): different fingerprints -> a, b: a spanning forest of each pair of blocks."""
    spark = prints.sparkSession
    order = sum((F.shiftleft(F.bit_count(F.col("_print").bitwiseAND(F.lit((0xFF << 8 * k) - (1 << 64) * (k == 7)).cast("long"))).cast("long"), 4 * k) for k in range(8)), F.lit(0))
    ranged = prints.withColumn("_order", order)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    ranged = ranged.repartitionByRange(parts, "_order", "_print").sortWithinPartitions("_order", "_print").select("_print")
    blocks = cut(ranged.mapInArrow(_pack, "block long, lo binary, hi binary, prints binary"))
    ends = blocks.select("block", "lo", "hi").toPandas()
    if ends.empty:
        return spark.createDataFrame([], "a long, b long")
    shared = spark.sparkContext.broadcast(_Ends(ends["block"].to_numpy(), *(np.frombuffer(b"".join(ends[c]), dtype=np.uint8).reshape(-1, 8).astype(np.int16) for c in ("lo", "hi"))))
    pairs = cut(spark.range(len(ends)).mapInArrow(lambda it: shared.value.pairs(it), "i long, j long"))
    tasks = min(MOST_TASKS, -(-pairs.count() // PAIRS))
    work = (
        pairs.join(blocks.select(F.col("block").alias("i"), F.col("prints").alias("pa")), "i")
        .join(blocks.select(F.col("block").alias("j"), F.col("prints").alias("pb")), "j")
    )
    return work.repartition(tasks, "i", "j").mapInArrow(_compare, "a long, b long")


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: _id, _sha (of the text) and _print."""
    text = F.col(text_col)
    return cut(docs.select(F.col(id_col).alias("_id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("_sha"), fingerprint(text).alias("_print")))


def _order() -> Column:
    """Order of the rows of a component: null ids last, then by id, fingerprint and text."""
    return F.struct(F.col("_id").isNull().alias("_none"), "_id", "_print", "_sha")


def _components(base: DataFrame) -> tuple[DataFrame, int]:
    """_print, _first, _rows: each different fingerprint, the first row of its component and its own rows; and all rows."""
    prints = cut(base.groupBy("_print").agg(F.min(_order()).alias("_least"), F.count("*").alias("_rows")))
    nodes = components(links(prints.select("_print")))
    members = cut(nodes.join(prints, F.col("node") == F.col("_print")).select("_print", "root", "_least"))
    least = cut(members.groupBy("root").agg(F.min("_least").alias("_group"), F.count("*").alias("_n")))
    joined = group_join(members.select("_print", "root"), least, ["root"], "_n", members.count()).select("_print", "_group")
    known = prints.join(joined, "_print", "left").select("_print", F.coalesce("_group", "_least").alias("_first"), "_rows")
    return cut(known), base.count()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and component_id (the smallest id reachable)."""
    base = _prints(docs, id_col, text_col)
    found, n = _components(base)
    return group_join(base.select("_id", "_print"), found, ["_print"], "_rows", n).select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), F.col("_first._id").alias("component_id")
    )


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns: the first by id (nulls last), fingerprint and text. Of rows equal in id
    and text one stays."""
    base = _prints(docs, id_col, text_col)
    found, n = _components(base)
    rows = cut(group_join(cut(base.groupBy("_id", "_sha", "_print").agg(F.count("*").alias("_n"))), found, ["_print"], "_rows", n))
    first = _order().eqNullSafe(F.col("_first"))
    gone = rows.where(~first).select(F.col("_id").alias("_gone"), F.col("_sha").alias("_gone_sha"))
    held = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_h"))
    held = held.join(gone, F.col("_i").eqNullSafe(F.col("_gone")) & (F.col("_h") == F.col("_gone_sha")), "left_anti")
    if rows.where("_n > 1").where(first).limit(1).count():
        held = held.dropDuplicates(["_i", "_h"])
    return held.select("_row.*")
