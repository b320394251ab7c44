"""Hard negatives by a vertical scan of columnar dimensions with shrinking bounds.

Vectors become integers and are dealt into slices of a bounded number of rows; anchors are dealt into parts, and each pair
of a slice and a part is one group. A task keeps its slice by dimension, in tiles sorted by label. For each anchor it
reads a tile's dimensions in the order of the anchor's descending magnitude, some at a time, and adds up partial scores.
What the dimensions not yet read can still add lies between the sums of their least and greatest contributions (by the
tile's minimum and maximum per dimension), so every row's score is known to an interval that only shrinks; rows that
cannot come into the result leave the bitmap of candidates, and later dimensions are read for the rest alone. What
remains after the last dimension has its exact score.

This is done twice. First each anchor's best rows of its own label are found: a row goes when its upper bound is below the
k-th best lower bound. Then each positive opens a window of scores: a row of another label goes when its interval
meets no window, or lies below as many rows of each window as are wanted. Each task yields a few rows per anchor and
window, and one grouping picks among those.

Defined cases: rows with a null id or label, a null, empty, or non-finite vector, or one whose length is not the commonest (the
longer of two as common) take no part; components that leave the range in which sums fit 64 bits after scaling are held to its
ends; ids and labels are whole numbers. Every row for which the condition holds is an anchor of its own, also among
rows that repeat an id, and every other row may be its positive or negative; equal scores go to the smaller id. An anchor
without other rows of its label yields nothing, nor does a positive with an empty window (as with a score below 0, or a table with
one label); an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagesignal.llm.common import cut

#: Rows that travel together; most rows of a slice and anchors of a part; rows of a tile; dimensions read at a time, first and later.
CHUNK, SLICE, PART, TILE, FIRST, STEP = 1024, 65_536, 32_768, 4096, 24, 8
ROWS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("label", pa.int64()), ("v", pa.binary())])
DEALT = pa.schema([("s", pa.int32()), ("r", pa.int32()), ("w", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("labels", pa.binary()), ("vs", pa.binary())])
POSITIVES = pa.schema([("row", pa.int64()), ("anchor_id", pa.int64()), ("positive_row", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVES = pa.schema([("row", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int' if f.type == pa.int32() else 'long'}" for f in schema)


def _integers(width: int, scale: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = float(int((2.0**62 / width) ** 0.5))
    for batch in batches:
        on, out = [], []
        for k, v in enumerate(batch["v"].to_numpy(zero_copy_only=False)):
            if v is not None and len(v) == width:
                x = np.array(v, dtype=np.float64)
                if np.isfinite(x).all():
                    on.append(k)
                    out.append(np.clip(np.floor(scale * x), -most, most).astype(np.int64).tobytes())
        rest = batch.select(["id", "row", "label"]).take(pa.array(on, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out, pa.binary())], schema=ROWS)


def _deal(slices: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows, dealt to the slices in turn, once for each part of the anchors; numbers in as few bytes as hold them."""
    turn = TaskContext.get().partitionId()
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            some = batch.slice(at, CHUNK)
            v = np.frombuffer(b"".join(some["v"].to_pylist()), dtype=np.int64)
            kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)
            packed = [np.dtype(kind).itemsize, *(some[c].to_numpy().tobytes() for c in ("id", "row", "label")), v.astype(kind).tobytes()]
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array([x] * parts, t) for x, t in zip([turn % slices], [pa.int32()])] + [pa.array(range(parts), pa.int32())] + [pa.array([x] * parts, t) for x, t in zip(packed, DEALT.types[2:])], schema=DEALT)


class _Tile:
    """Rows sorted by label, one array per dimension, with each dimension's minimum and maximum."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, v: np.ndarray):
        self.ids, self.rows, self.labels = ids, rows, labels
        self.columns = np.ascontiguousarray(v.T)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, q: np.ndarray, on: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """The rows of on (places in the tile) that keep never rules out, and their scores. keep(partial, low, high) tells
        which rows stay, if their scores lie between partial + low and partial + high."""
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.least, q * self.most])
        low, high = (np.concatenate([np.cumsum(x[order][::-1])[::-1], [0]]) for x in (ends.min(axis=0), ends.max(axis=0)))
        partial, at = np.zeros(len(on), dtype=q.dtype), 0
        while at < len(q) and len(on):
            end = min(len(q), at + (STEP if at else FIRST))
            dims = order[at:end]
            block = self.columns[dims] if len(on) == self.columns.shape[1] else self.columns[dims[:, None], on[None, :]]
            partial += q[dims] @ block
            stay = keep(partial, low[end], high[end])
            if not stay.all():
                on, partial = on[stay], partial[stay]
            at = end
        return on, partial


def _tiles(data: pa.Table, width: int, kind: type) -> Iterator[_Tile]:
    ids, rows, labels = (np.frombuffer(b"".join(data[c].to_pylist()), dtype=np.int64) for c in ("ids", "rows", "labels"))
    v = np.concatenate([np.frombuffer(x, dtype=f"i{w}").reshape(-1, width) for w, x in zip(data["w"].to_pylist(), data["vs"].to_pylist())])
    order = np.lexsort((rows, labels))
    for at in range(0, len(order), TILE):
        on = order[at : at + TILE]
        yield _Tile(ids[on], rows[on], labels[on], v[on].astype(kind))


def _kind(data: pa.Table, v: np.ndarray, width: int) -> type:
    """Floats where all sums are exact whole numbers below 2^53, else 64-bit integers."""
    most = max((np.abs(np.frombuffer(x, dtype=f"i{w}").astype(np.float64)).max(initial=0) for w, x in zip(data["w"].to_pylist(), data["vs"].to_pylist())), default=0)
    return np.float64 if most * float(np.abs(v).max(initial=0)) * width < 2.0**53 else np.int64


def _best(held: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """The first k of both by descending score and ascending id: rows of score, id, row."""
    both = np.concatenate([held, new], axis=1)
    return both[:, np.lexsort((both[2], both[1], -both[0]))[:k]]


def _positives(width: int, k: int, data: pa.Table, anchors: pa.Table) -> pa.Table:
    if not data.num_rows or not anchors.num_rows:
        return POSITIVES.empty_table()
    v = np.frombuffer(b"".join(anchors["v"].to_pylist()), dtype=np.int64).reshape(-1, width)
    kind = _kind(data, v, width)
    label, own = anchors["label"].to_numpy(), anchors["row"].to_numpy()
    best = [np.zeros((3, 0), dtype=np.int64)] * len(v)
    by_label = np.argsort(label, kind="stable")
    for tile in _tiles(data, width, kind):
        a, b = np.searchsorted(label[by_label], tile.labels[0], "left"), np.searchsorted(label[by_label], tile.labels[-1], "right")
        for n in by_label[a:b]:
            on = np.arange(np.searchsorted(tile.labels, label[n], "left"), np.searchsorted(tile.labels, label[n], "right"))
            on = on[tile.rows[on] != own[n]]

            def keep(partial: np.ndarray, low: float, high: float, held: np.ndarray = best[n]) -> np.ndarray:
                least = held[0, k - 1] if held.shape[1] == k else None
                if len(partial) > k:
                    sure = np.partition(partial, len(partial) - k)[len(partial) - k] + low
                    least = sure if least is None else max(least, sure)
                return partial + high >= least if least is not None else np.ones(len(partial), dtype=bool)

            on, score = tile.scan(v[n].astype(kind), on, keep)
            best[n] = _best(best[n], np.stack([score.astype(np.int64), tile.ids[on], tile.rows[on]]), k)
    found = [np.concatenate([[np.full(x.shape[1], own[n]), np.full(x.shape[1], a)], x[[2, 1, 0]]]) for n, (x, a) in enumerate(zip(best, anchors["id"].to_pylist()))]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(found, axis=1)], schema=POSITIVES)


def _negatives(width: int, k: int, data: pa.Table, anchors: pa.Table) -> pa.Table:
    """anchors: with the list windows of (place, positive_id, positive_score, low, high)."""
    if not data.num_rows or not anchors.num_rows:
        return NEGATIVES.empty_table()
    v = np.frombuffer(b"".join(anchors["v"].to_pylist()), dtype=np.int64).reshape(-1, width)
    kind = _kind(data, v, width)
    label, own, windows = anchors["label"].to_numpy(), anchors["row"].to_numpy(), anchors["windows"].to_pylist()
    best = [[np.zeros((3, 0), dtype=np.int64) for _ in w] for w in windows]
    for tile in _tiles(data, width, kind):
        for n, asked in enumerate(windows):
            a, b = np.searchsorted(tile.labels, label[n], "left"), np.searchsorted(tile.labels, label[n], "right")
            on = np.concatenate([np.arange(a), np.arange(b, len(tile.labels))])
            lows = [max(w["low"], int(x[0, -1])) if x.shape[1] == k else w["low"] for w, x in zip(asked, best[n])]

            def keep(partial: np.ndarray, low: float, high: float, asked: list = asked, lows: list = lows) -> np.ndarray:
                stay = np.zeros(len(partial), dtype=bool)
                for w, least in zip(asked, lows):
                    sure = partial[(partial + low >= w["low"]) & (partial + high <= w["high"])]  # surely in the window
                    if len(sure) >= k:
                        least = max(least, np.partition(sure, len(sure) - k)[len(sure) - k] + low)
                    stay |= (partial + high >= least) & (partial + low <= w["high"])
                return stay

            on, score = tile.scan(v[n].astype(kind), on, keep)
            score = score.astype(np.int64)
            for j, (w, least) in enumerate(zip(asked, lows)):
                inside = (score >= least) & (score <= w["high"])
                if inside.any():
                    best[n][j] = _best(best[n][j], np.stack([score[inside], tile.ids[on[inside]], tile.rows[on[inside]]]), k)
    out: list[list] = [[] for _ in NEGATIVES]
    for n, (asked, name) in enumerate(zip(windows, anchors["id"].to_pylist())):
        for w, x in zip(asked, best[n]):
            for score, found, _ in x.T.tolist():
                for column, value in zip(out, (own[n], name, w["place"], w["positive_id"], w["positive_score"], found, score)):
                    column.append(value)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, NEGATIVES.types)], schema=NEGATIVES)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", *, scale: float = 256.0,
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, slice_rows: int | None = None, part_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows for which the condition
    on id_col holds) and each of its best rows of the same label, the best rows of other labels whose score is from low
    to high percent of the positive's."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).where("id is not null and label is not null")
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if common is None:
        return empty
    width = common["n"]
    data = cut(rows.mapInArrow(lambda it: _integers(width, scale, it), _ddl(ROWS)))
    asked = data.withColumnRenamed("id", id_col).where(anchor).withColumnRenamed(id_col, "id")
    n, n_asked = data.count(), asked.count()
    if not n_asked:
        return empty
    slices = -(-n // (slice_rows or min(SLICE, max(TILE, n // 32))))
    parts = -(-n_asked // (part_rows or min(PART, max(512, n_asked // 4))))
    dealt = data.mapInArrow(lambda it: _deal(slices, parts, it), _ddl(DEALT)).groupBy("s", "r")

    def met(anchors: DataFrame, solve, schema: pa.Schema) -> DataFrame:
        sent = anchors.withColumns({"s": F.explode(F.sequence(F.lit(0), F.lit(slices - 1))), "r": F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")})
        return dealt.cogroup(sent.groupBy("s", "r")).applyInArrow(lambda a, b: solve(width, a, b), _ddl(schema))

    first = met(asked, lambda width, a, b: _positives(width, positives, a, b), POSITIVES)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id", "positive_row"))
    best = first.withColumn("place", place).where(F.col("place") <= positives)
    percent = lambda p: F.col("positive_score").cast("decimal(20,0)") * F.lit(p) / F.lit(100)
    # 100 * score from low to high times the positive's: whole numbers, rounded inwards.
    opened = best.withColumns({"low": F.ceil(percent(low)).cast("long"), "high": F.floor(percent(high)).cast("long")}).where("low <= high")
    windows = cut(opened.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score", "low", "high"))).alias("windows")))
    second = met(asked.join(windows, "row"), lambda width, a, b: _negatives(width, negatives, a, b), NEGATIVES)
    place = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return second.withColumn("rank", place).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
