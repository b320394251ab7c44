"""Ranked lexical search by dense blocked multiplication.

Items (the queries) are taken in blocks of a bounded number of terms. For each block every document is cut into words once
and becomes its length and the counts of the block's terms; document frequencies, the number of documents and their total
length are counted over all of them. Items then form tiles, each with a compact vocabulary of its own; a task turns a tile
of documents into a dense matrix of impacts over that vocabulary and multiplies it with the tile's matrix of weights in
float64. Weights and impacts are whole numbers and the vocabulary is cut so that no partial sum reaches 2^53, so every sum is
exact; partial sums are added as 64-bit integers. Each task keeps the k best per item, all ties at the last place
included until ids decide, and one grouping per item, first within parts of the tasks' results, picks among those.

Defined cases: a null text has no term (neither item nor document); only documents with a score above 0 are returned, so an
item without known terms returns nothing, and neither do empty tables; equal scores go to the smaller id, a null id comes
last; rows that repeat an id are documents, or items, of their own; other columns are ignored; ids are whole numbers. Texts of any
length are cut into words piece by piece.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stagesignal.llm.common import cut

#: Terms of a block of items; items of a tile and columns of its vocabulary at once; documents of a tile; bytes cut at once.
BLOCK_TERMS, ITEMS, COLUMNS, DOCS, PIECE = 262_144, 256, 4096, 512, 1 << 20
#: No impact is larger, and no partial sum may reach the second number.
MOST_IMPACT, EXACT = 1_000_000, 1 << 53
#: What is no ASCII letter, digit or non-ASCII byte separates words; A-Z become a-z.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORDS = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])
HITS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("terms", pa.binary()), ("tf", pa.binary())])
COUNTS = pa.schema([("term", pa.int32()), ("df", pa.int64())])
BEST = pa.schema([("key", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def word_counts(text: bytes | None) -> Counter:
    """How often each word occurs in a text in UTF-8."""
    found, raw, at = Counter(), (text or b"").translate(FOLD), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [sorted(word_counts(t)) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["key"], batch["item_id"], pa.array(terms, pa.list_(pa.binary()))], schema=WORDS)


def _hits(vocabulary: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = vocabulary.value
    for batch in batches:
        n, terms, tf = [], [], []
        for text in batch["text"].to_pylist():
            counts = word_counts(text)
            n.append(counts.total())
            held = [(known[w], c) for w, c in counts.items() if w in known]
            terms.append(np.array([t for t, _ in held], dtype=np.int32).tobytes())
            tf.append(np.array([c for _, c in held], dtype=np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], schema=HITS)


def _frequencies(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(size, dtype=np.int64)
    for batch in batches:
        df += np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), dtype=np.int32), minlength=size)
    on = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(df[on])], schema=COUNTS)


def vocabulary_parts(weights: np.ndarray, columns: int = COLUMNS, exact: int = EXACT) -> list[tuple[int, int]]:
    """Ranges of columns, each narrow enough and with partial sums below the bound whatever the impacts are."""
    most, parts, at, total = weights.max(axis=0, initial=0), [], 0, 0
    for c, w in enumerate(most.tolist()):
        if c > at and (c - at == columns or (total + w) * MOST_IMPACT >= exact):
            parts.append((at, c))
            at, total = c, 0
        total += w
    return [*parts, (at, len(most))] if len(most) else []


class _Tile:
    """Some items with their compact vocabulary (columns of a dense matrix of weights) and the best documents so far."""

    def __init__(self, keys: np.ndarray, items: np.ndarray, lists: list[np.ndarray], w: np.ndarray, k: int):
        self.keys, self.items, self.k = keys, items, k
        self.terms = np.unique(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.int64)
        weights = np.zeros((len(keys), len(self.terms)), dtype=np.int64)
        for row, terms in enumerate(lists):
            weights[row, np.searchsorted(self.terms, terms)] = w[terms]
        self.parts, self.weights = vocabulary_parts(weights), weights.astype(np.float64)
        self.column = np.full(len(w), -1, dtype=np.int64)
        self.column[self.terms] = np.arange(len(self.terms))
        self.least = np.ones(len(keys), dtype=np.int64)
        self.best = np.zeros((4, 0), dtype=np.int64)  # item, score, null id, id

    def scores(self, docs: int, row: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        total, column = np.zeros((docs, len(self.keys)), dtype=np.int64), self.column[term]
        for a, b in self.parts:
            on = (column >= a) & (column < b)
            tile = np.zeros((docs, b - a))
            tile[row[on], column[on] - a] = impact[on]
            total += (tile @ self.weights[:, a:b].T).astype(np.int64)
        return total

    def add(self, ids: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        """Keeps the k best per item; scores equal to the last of them stay in play until ids decide."""
        doc, item = np.nonzero(scores >= self.least)
        rows = np.concatenate([self.best, np.stack([item, scores[doc, item], null[doc], ids[doc]])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        starts = np.searchsorted(rows[0], np.arange(len(self.keys)))
        place = np.arange(rows.shape[1]) - starts[rows[0]]
        self.best = rows[:, place < self.k]
        full = rows[:, place == self.k - 1]
        self.least[full[0]] = full[1]


class _Search:
    def __init__(self, keys: list[int], items: list[int | None], lists: list[np.ndarray], w: np.ndarray, docs: int, words: int, k: int):
        self.keys, self.items, self.lists, self.w, self.docs, self.words, self.k = keys, items, lists, w, docs, words, k

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [_Tile(np.array(self.keys[i : i + ITEMS]), np.arange(i, min(i + ITEMS, len(self.keys))), self.lists[i : i + ITEMS], self.w, self.k) for i in range(0, len(self.keys), ITEMS)]
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                held = part["terms"].to_pylist()
                row = np.repeat(np.arange(len(held)), [len(x) // 4 for x in held])
                term, tf = (np.frombuffer(b"".join(x), dtype=np.int32).astype(np.int64) for x in (held, part["tf"].to_pylist()))
                m = 10 + 90 * part["n"].to_numpy() * self.docs // self.words
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
                ids, null = part["id"].fill_null(0).to_numpy(), part["id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                for tile in tiles:
                    tile.add(ids, null, tile.scores(len(held), row, term, impact))
        for tile in tiles:
            item, score, null, doc = tile.best
            names = [self.items[i] for i in tile.items[item].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(tile.keys[item], pa.int64()), pa.array(names, pa.int64()), pa.array(doc, mask=null == 1), pa.array(score)], schema=BEST)


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", *,
           k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents that score highest for each item."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.monotonically_increasing_id().alias("key"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    asked = cut(asked.mapInArrow(_item_words, "key long, item_id long, terms array<binary>").where(F.size("terms") > 0))
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, found = -(-n_terms // block_terms), []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key").collect()  # a bounded number of terms
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        lists = [np.array([vocabulary[bytes(t)] for t in r["terms"]], dtype=np.int64) for r in rows]
        shared = spark.sparkContext.broadcast(vocabulary)
        hits = cut(texts.mapInArrow(lambda it, v=shared: _hits(v, it), "id long, n long, terms binary, tf binary"))
        total = hits.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words")).first()
        if not total["docs"] or not rows:
            continue
        size = len(vocabulary)
        counted = hits.mapInArrow(lambda it, n=size: _frequencies(n, it), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(size, dtype=np.int64)
        for r in counted.collect():  # a row per term of the block at most
            df[r["term"]] = r["df"]
        w = np.floor(1000.0 * np.log((2 * total["docs"] + 2) / (2 * df + 1))).astype(np.int64)
        plan = spark.sparkContext.broadcast(_Search([r["key"] for r in rows], [r["item_id"] for r in rows], lists, w, total["docs"], total["words"], k))
        found.append(hits.mapInArrow(lambda it, p=plan: p.value.run(it), "key long, item_id long, doc_id long, score long"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    parts = _first(best.withColumn("part", F.spark_partition_id() % 64), k, "key", "part").drop("rank")
    return _first(parts, k, "key").select("item_id", "rank", "doc_id", "score")
