"""Exact top-k inner-product search by a Voronoi kNN join.

Vectors become integers. A bounded number of pivots is drawn; each query belongs to its nearest pivot, and a group's
summary is its radius s. For a data vector p and a group with pivot c, every query's score lies within
c.p - s|p| and c.p + s|p|. The (k+1)-th largest lower bound over different rows is the group's bound; data whose upper
bound is below it cannot be among any of its queries' k best and is not sent there. Groups that need most of the data
anyway are joined into one, so that it is sent once. Each group's data is dealt into slices and its queries into parts,
both of bounded size (a group may hold a third of all queries); each slice is solved locally with numpy for each part,
and the slices' best are merged. Vectors travel as the smallest integers that hold them.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do those whose
length is not the commonest one (the longer of two as common), nor those with a null id; ids are whole numbers. Every
row for which the condition holds is a query of its own, also among rows that repeat an id, and every other row is a
candidate; ties go to the smaller id; an empty table gives an empty result. Other columns are ignored.
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

#: Data rows that travel together, rows of a slice, queries of a part, and queries scored at once.
CHUNK, SLICE, PART, QUERIES = 1024, 32_768, 65_536, 128
VECTORS = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("v", pa.binary())])
BOUNDS = pa.schema([("g", pa.int32()), ("row", pa.int64()), ("least", pa.float64())])
COUNTS = pa.schema([("g", pa.int32()), ("n", pa.int64())])
NEEDED = pa.schema([("g", pa.int32()), ("s", pa.int32()), ("r", pa.int32()), ("w", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("vs", pa.binary())])
BEST = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _integers(width: int, scale: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, out = [], [], []
        for i, r, v in zip(batch["id"].to_pylist(), batch["row"].to_pylist(), batch["v"].to_numpy(zero_copy_only=False)):
            if i is None or v is None or len(v) != width:
                continue
            x = np.array(v, dtype=np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                rows.append(r)
                out.append(np.floor(scale * x).astype(np.int64).tobytes())
        yield _batch(VECTORS, ids, rows, out)


def _packed(v: np.ndarray) -> tuple[int, bytes]:
    """Bytes per number, and the numbers in as few bytes as hold them all."""
    lo, hi = int(v.min(initial=0)), int(v.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
    return np.dtype(kind).itemsize, v.astype(kind).tobytes()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64).reshape(-1, width)


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (v * v).sum(axis=1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(axis=1)[None, :]
    g = d.argmin(axis=1)
    return g, np.sqrt(np.maximum(d[np.arange(len(v)), g], 0.0))


def _slack(x: np.ndarray) -> np.ndarray:
    """Room for rounding in the bounds."""
    return 1.0 + 1e-9 * np.abs(x)


class _Bounds:
    """The pivots of the groups that have queries, their radii, and (later) their bounds: bounded arrays."""

    def __init__(self, groups: np.ndarray, pivots: np.ndarray, radii: np.ndarray, bound: np.ndarray | None = None):
        self.groups, self.pivots, self.radii, self.bound = groups, pivots, radii, bound

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid = v @ self.pivots.T
        room = np.sqrt((v * v).sum(axis=1))[:, None] * self.radii[None, :]
        return mid - room - _slack(room), mid + room + _slack(room)

    def lower(self, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k largest lower bounds of different rows, per group, in this partition."""
        best = [(np.zeros(0, dtype=np.int64), np.zeros(0))] * len(self.groups)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch["row"].to_numpy()
            least, _ = self.of(_matrix(batch["v"], self.pivots.shape[1]).astype(np.float64))
            for g, held in enumerate(best):
                names, x = np.concatenate([held[0], rows]), np.concatenate([held[1], least[:, g]])
                top = np.argsort(-x, kind="stable")[:k]
                best[g] = names[top], x[top]
        for g, (names, x) in zip(self.groups, best):
            yield _batch(BOUNDS, np.full(len(names), g), names, x)

    def wanted(self, v: np.ndarray) -> np.ndarray:
        """Which rows each group needs."""
        return self.of(v.astype(np.float64))[1] >= self.bound

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(self.groups), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                n += self.wanted(_matrix(batch["v"], self.pivots.shape[1])).sum(axis=0)
        yield _batch(COUNTS, self.groups, n)

    def needed(self, joined: np.ndarray, slices: dict[int, int], parts: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of the data that each joined group needs, dealt to its slices in turn, once for each part of its queries."""
        turn = TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, row, v = batch["id"].to_numpy(), batch["row"].to_numpy(), _matrix(batch["v"], self.pivots.shape[1])
            wanted = self.wanted(v)
            for group in np.unique(joined).tolist():
                on = np.flatnonzero(wanted[:, joined == group].any(axis=1))
                for k in range(0, len(on), CHUNK):
                    at = on[k : k + CHUNK]
                    turn += 1
                    n = parts[group]
                    w, vs = _packed(v[at])
                    yield _batch(NEEDED, [group] * n, [turn % slices[group]] * n, range(n), [w] * n, [ids[at].tobytes()] * n, [row[at].tobytes()] * n, [vs] * n)


def _solve(k: int, width: int, data: pa.Table, queries: pa.Table) -> pa.Table:
    if not data.num_rows or not queries.num_rows:
        return BEST.empty_table()
    ids, rows = (np.frombuffer(b"".join(data[c].to_pylist()), dtype=np.int64) for c in ("ids", "rows"))
    v = np.concatenate([np.frombuffer(x, dtype=f"i{w}") for w, x in zip(data["w"].to_pylist(), data["vs"].to_pylist())]).reshape(-1, width).astype(np.int64)
    asked, own, names = _matrix(queries["v"], width), queries["row"].to_numpy(), queries["id"].to_numpy()
    whole = float(np.abs(v).max(initial=0)) * float(np.abs(asked).max(initial=0)) * width < 2.0**53
    kind = np.float64 if whole else np.int64  # as floats the sums are exact whole numbers
    right, out = v.astype(kind).T, []
    for at in range(0, len(asked), QUERIES):
        scores = (asked[at : at + QUERIES].astype(kind) @ right).astype(np.int64)
        for q, score in enumerate(scores, at):
            on = np.flatnonzero(rows != own[q])
            if len(on) > k:
                on = on[score[on] >= np.partition(score[on], len(on) - k)[len(on) - k]]
            on = on[np.lexsort((rows[on], ids[on], -score[on]))[:k]]
            out.append(np.stack([np.full(len(on), own[q]), np.full(len(on), names[q]), ids[on], score[on]]))
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(out, axis=1)], schema=BEST)


def top_k(vectors: DataFrame, asked: Column, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 10,
          scale: float = 1024.0, pivots: int = 32, part: int = PART) -> DataFrame:
    """For each row of vectors for which asked (a condition on id_col) holds: query_id, rank, vec_id, score of its k best."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vec_col).alias("v"))
    common = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if common is None:
        return empty
    width = common["n"]
    data = cut(rows.mapInArrow(lambda it: _integers(width, scale, it), "id long, row long, v binary"))
    drawn = data.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).toPandas()  # a bounded number
    if drawn.empty:
        return empty
    centres = np.frombuffer(b"".join(drawn["v"]), dtype=np.int64).reshape(-1, width).astype(np.float64)
    queries = data.withColumnRenamed("id", id_col).where(asked).select(F.col(id_col).alias("id"), "row", "v")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g, far = _nearest(_matrix(batch["v"], width).astype(np.float64), centres)
                yield pa.RecordBatch.from_arrays([batch["id"], batch["row"], batch["v"], pa.array(g, pa.int32()), pa.array(far)], names=["id", "row", "v", "g", "far"])

    queries = cut(queries.mapInArrow(grouped, "id long, row long, v binary, g int, far double"))
    found = queries.groupBy("g").agg(F.max("far").alias("far"), F.count("*").alias("n")).orderBy("g").toPandas()  # a row per pivot at most
    if found.empty:
        return empty
    bounds = _Bounds(found["g"].to_numpy(), centres[found["g"].to_numpy()], found["far"].to_numpy() * (1 + 1e-9) + 1e-3)
    lower = data.mapInArrow(lambda it: bounds.lower(k + 1, it), "g int, row long, least double")
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("least"), "row"))
    kept = lower.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("g").agg(F.min("least").alias("least"), F.count("*").alias("n")).collect()
    least = {r["g"]: r["least"] if r["n"] == k + 1 else -np.inf for r in kept}
    bounds.bound = np.array([least.get(int(g), -np.inf) for g in bounds.groups])
    total = data.count()
    counted = data.mapInArrow(bounds.count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas().set_index("g")["n"]
    needs = np.array([int(counted[g]) for g in bounds.groups])
    joined = np.where(2 * needs >= total, -1, bounds.groups)  # group -1: those that need most of the data
    need = {int(g): total if g == -1 else int(needs[joined == g][0]) for g in np.unique(joined)}
    slices = {g: max(1, -(-n // SLICE)) for g, n in need.items()}
    parts = {g: -(-int(found["n"][joined == g].sum()) // part) for g in need}
    needed = data.mapInArrow(lambda it: bounds.needed(joined, slices, parts, it), "g int, s int, r int, w int, ids binary, rows binary, vs binary")
    pick = lambda table, key: F.create_map(*[F.lit(int(x)) for e in table.items() for x in e])[key]
    sent = queries.withColumn("g", pick(dict(zip(bounds.groups, joined)), F.col("g")).cast("int"))
    slice_ = F.explode(F.sequence(F.lit(0), (pick(slices, F.col("g")) - 1).cast("int")))
    sent = sent.select("g", slice_.alias("s"), F.pmod(F.xxhash64("row"), pick(parts, F.col("g"))).cast("int").alias("r"), "id", "row", "v")
    best = needed.groupBy("g", "s", "r").cogroup(sent.groupBy("g", "s", "r")).applyInArrow(
        lambda a, b: _solve(k, width, a, b), "row long, query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
