"""Removal of passages that earlier documents have, by suffix arrays made in two stages.

Texts travel in blocks of some MB, compressed. Every window of `length` bytes names its seed, the gram with the least hash in
it; windows with the same seed that follow one another form a segment (a window's seed depends on its bytes alone, so equal windows
have equal seeds, wherever they stand). A first round finds the seeds that more than one document has, by 32 bits of
their hashes within buckets of bounded size: too many may be found, never too few. Segments of those seeds, each text once a block
with its least document, go to the bucket of their seed. A seed with very many segments sends its windows one by one
instead, each to the bucket of its own bytes, so no seed fills a task.

A bucket sorts the suffixes of its segments (down to `length` bytes) in two stages: those smaller than their successors
directly, word by word among what is still equal; the others by scanning the buckets of first bytes in ascending order,
each entry placing the suffix before it. Adjacent common prefixes then tell which windows are equal, the least document of
each class is known, and each block gets back which windows of its segments an earlier document has.

Defined cases: a null text is empty; order is that of the ids, a null id comes last; of rows with equal ids none is
earlier than the other; texts shorter than `length` stay whole, as do windows that only repeat within their own document;
matches never cross documents; an empty table gives an empty result; other columns are ignored. A single text of any
length is one block and handled in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagesignal.llm.common import cut

#: Bytes of text in a block; windows looked at together; seeds of a bucket; bytes of segments of a bucket; occurrences of a hot seed.
BLOCK, PIECE, SEEDS, SEGMENTS, HOT = 4 << 20, 1 << 19, 1 << 20, 2 << 20, 16_384
#: A segment's windows are bits of one 32-bit number. Seeds per byte of text, as expected.
WINDOWS, DENSITY = 32, 1 / 16
LAST = np.iinfo(np.int64).max
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lens", pa.binary()), ("text", pa.binary())])
ASKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("times", pa.binary())])
SHARED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("hot", pa.binary()), ("bytes", pa.int64())])
#: Segments of a block for a bucket, numbered from first on: their numbers of windows, least documents and bytes, compressed.
SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("size", pa.int64()), ("load", pa.binary())])
FOUND = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("mask", pa.binary())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'long'}" for f in schema)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else schema.empty_table()


def _blocks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, held, ids, total = TaskContext.get().partitionId() << 32, [], [], 0

    def packed() -> pa.RecordBatch:
        raw = b"".join(held)
        null = np.array([i is None for i in ids])
        order = np.array([LAST if i is None else i for i in ids], dtype=np.int64)
        row = (number, order.tobytes(), null.tobytes(), np.array([len(x) for x in held], dtype=np.int64).tobytes(), pa.compress(raw, codec="zstd", asbytes=True))
        return _table(BLOCKS, [row]).to_batches()[0]

    for batch in batches:
        for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
            text = text or b""
            if held and total + len(text) > size:
                yield packed()
                number, held, ids, total = number + 1, [], [], 0
            held.append(text)
            ids.append(i)
            total += len(text)
    if held:
        yield packed()


class _Block:
    def __init__(self, row: dict):
        self.number = row["block"]
        self.order, self.lens = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "lens"))
        self.null = np.frombuffer(row["nulls"], dtype=bool)
        self.text = pa.decompress(row["text"], decompressed_size=int(self.lens.sum()), codec="zstd", asbytes=True) if self.lens.sum() else b""
        self.ends = np.cumsum(self.lens)


def _words(raw: np.ndarray, at: int | np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on (or from every place, moved by at)."""
    if isinstance(at, int):
        return np.ndarray((len(raw) - 7 - at,), dtype=kind, buffer=raw, strides=(1,), offset=at)
    return np.ndarray((len(raw) - 7,), dtype=kind, buffer=raw, strides=(1,))[at]


def _offsets(n: int) -> list[int]:
    """Where words of eight bytes start that together cover n bytes."""
    return [*range(0, n - 7, 8), *([n - 8] if n % 8 else [])]


def _hashes(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[-1]), dtype=np.uint64)
    for k, w in enumerate(words):
        h ^= w[: len(h)] * MIX[k % 4]
        h ^= h >> np.uint64(32)
        h *= MIX[(k + 1) % 4]
    h ^= h >> np.uint64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def segments(text: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows, seed's hash and document of each segment."""
    gram, out = max(8, 2 * length // 5), []
    for at in range(0, len(text) - length + 1, PIECE):
        raw = np.frombuffer(text[at : at + PIECE + length - 1], dtype=np.uint8)
        n = len(raw) - length + 1
        key = _least(_hashes([_words(raw, o) for o in _offsets(gram)]), length - gram + 1)[:n]
        place = np.arange(at, at + n)
        a, b = np.searchsorted(ends, [at, at + n - 1], side="right")
        doc = np.repeat(np.arange(a, b + 1), np.diff(np.append(at, np.minimum(ends[a : b + 1], at + n))))
        whole = place + length <= ends[doc]
        new = np.ones(n, dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(new)
        run = place - place[start][np.cumsum(new) - 1]
        start = np.flatnonzero(run % WINDOWS == 0)  # longer runs are cut
        count = np.diff(np.append(start, n))
        on = whole[start]
        out.append((place[start][on], count[on], key[start][on], doc[start][on]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.int64))


def _split(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _ranges(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_values)]):
        if b > a:
            yield int(sorted_values[a]), a, b


def _ask(length: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's seeds by bucket, and how often it has them (doubled, and one more if two of its documents do)."""
    for batch in batches:
        for row in batch.to_pylist():
            block = _Block(row)
            _, _, key, doc = segments(block.text, block.ends, length)
            if not len(key):
                continue
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
            times = (np.minimum(np.diff(np.append(first, len(key))), 32_767) * 2 + several).astype(np.uint16)
            bucket, low = _split(key[first], buckets)
            order = np.argsort(bucket, kind="stable")
            low, times = low[order], times[order]
            rows = [(k, block.number, low[a:b].tobytes(), times[a:b].tobytes()) for k, a, b in _ranges(bucket[order])]
            yield from _table(ASKED, rows).to_batches()


def _shared(length: int, hot: int, asked: pa.Table) -> pa.Table:
    """Of a bucket's seeds those that several documents have, for each block, whether they are hot, and about how many bytes the block will send."""
    parts = [np.frombuffer(x, dtype=np.uint32) for x in asked["keys"].to_pylist()]
    key, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    times = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in asked["times"].to_pylist()]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, row, times = key[order], row[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    several = (np.diff(np.append(first, len(key))) > 1) | (np.maximum.reduceat(times & 1, first) == 1)
    many = np.add.reduceat(times >> 1, first) > hot
    on = np.flatnonzero(several[group])
    on = on[np.argsort(row[on], kind="stable")]
    cost = np.where(many[group], (times >> 1) * 16 * length, np.minimum(times >> 1, 4) * (length + 14))
    blocks, bucket = asked["block"].to_pylist(), asked["bucket"][0].as_py()
    return _table(SHARED, [(blocks[r], bucket, key[on[a:b]].tobytes(), many[group[on[a:b]]].tobytes(), int(cost[on[a:b]].sum())) for r, a, b in _ranges(row[on])])


class _Entries:
    """A block's segments of shared seeds, each text once, numbered in the order of the buckets that they go to."""

    def __init__(self, length: int, buckets: int, last: int, block: _Block, shared: list[dict]):
        known = np.concatenate([np.uint64(r["bucket"]) << np.uint64(32) | np.frombuffer(r["keys"], dtype=np.uint32).astype(np.uint64) for r in shared])
        hot = np.concatenate([np.frombuffer(r["hot"], dtype=bool) for r in shared])
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        start, count, key, doc = segments(block.text, block.ends, length)
        bucket, low = _split(key, buckets)
        name = bucket.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
        at = np.minimum(np.searchsorted(known, name), len(known) - 1)
        on = known[at] == name
        start, count, key, doc, much = start[on], count[on], key[on], doc[on], hot[at][on]
        if much.any():  # each window of a hot seed goes by its own bytes
            n = count[much]
            ones = np.repeat(start[much], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            raw = np.frombuffer(block.text, dtype=np.uint8)
            start, count, doc = np.append(start[~much], ones), np.append(count[~much], np.ones(len(ones), dtype=np.int64)), np.append(doc[~much], np.repeat(doc[much], n))
            key = np.append(key[~much], _hashes([_words(raw, ones + o) for o in _offsets(length)]))
        found: dict[bytes, int] = {}
        text = block.text
        entry = np.fromiter((found.setdefault(text[s:e], len(found)) for s, e in zip(start.tolist(), (start + count + length - 1).tolist())), dtype=np.int64, count=len(start))
        first = np.zeros(len(found), dtype=np.int64)
        first[entry[::-1]] = np.arange(len(entry))[::-1]
        to = (key[first] % np.uint64(last)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        new = np.empty(len(by), dtype=np.int64)
        new[by] = np.arange(len(by))
        self.to, self.windows, self.texts, self.by = to[by], count[first][by], list(found), by
        self.entry, self.start, self.count = new[entry], start, count
        order = block.order[doc]
        self.least = np.full(len(by), LAST, dtype=np.int64)
        np.minimum.at(self.least, self.entry, order)
        self.later = order > self.least[self.entry]  # an earlier document of this block has the whole segment


def _send(length: int, buckets: int, last: int, blocks: pa.Table, shared: pa.Table) -> pa.Table:
    if not blocks.num_rows or not shared.num_rows:
        return SENT.empty_table()
    block, rows = _Block(blocks.to_pylist()[0]), []
    entries = _Entries(length, buckets, last, block, shared.to_pylist())
    for k, a, b in _ranges(entries.to):
        load = b"".join([entries.windows[a:b].astype(np.uint8).tobytes(), entries.least[a:b].tobytes(), *(entries.texts[i] for i in entries.by[a:b].tolist())])
        rows.append((k, block.number, a, b - a, len(load), pa.compress(load, codec="zstd", asbytes=True)))
    return _table(SENT, rows)


def _sorted_directly(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first `length` bytes, word by word among those that are still equal."""
    rank, out = np.zeros(len(at), dtype=np.int64), at.copy()
    live = np.arange(len(at))  # places in out that are not yet settled; equal ranks stand together
    for offset in _offsets(length):
        if not len(live):
            break
        word = _words(raw, out[live] + offset, ">u8").astype(np.uint64)
        order = np.lexsort((word, rank[live])) if offset else np.argsort(word, kind="stable")
        out[live], word = out[live][order], word[order]
        new = np.ones(len(live), dtype=bool)
        new[1:] = (word[1:] != word[:-1]) | (rank[live][1:] != rank[live][:-1])
        rank[live] = live[np.flatnonzero(new)][np.cumsum(new) - 1]
        alone = new & np.append(new[1:], True)
        live = live[~alone]
    return out


def suffix_order(raw: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted suffixes of raw (a mask over its places; `length` + 8 bytes follow the last) in the order of their first
    `length` bytes, in two stages. Suffixes that the second stage needs are sorted too and left out at the end."""
    n = len(wanted)
    places = np.arange(n)
    differ = np.flatnonzero(raw[: n - 1] != raw[1:n]) if n > 1 else np.zeros(0, dtype=np.int64)
    ahead = np.append(differ, n - 1)[np.searchsorted(differ, places)]  # the end of each run of one byte
    smaller = (ahead < n - 1) & (raw[ahead] < raw[np.minimum(ahead + 1, n - 1)])  # than its successor; the last suffix is not
    used, more = wanted.copy(), np.flatnonzero(wanted & ~smaller) + 1
    while len(more):  # a suffix that is placed needs its successor
        more = more[more < n]
        more = more[~used[more]]
        used[more] = True
        more = more[~smaller[more]] + 1
    direct = _sorted_directly(raw, np.flatnonzero(used & smaller), length)
    cuts = np.searchsorted(raw[direct], np.arange(257))
    coming: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and used[n - 1]:
        coming[raw[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        def hand(found: np.ndarray, c: int = c) -> np.ndarray:
            """Places the suffixes before those found, if they are greater; returns those in this very bucket."""
            before = found[found > 0] - 1
            before = before[used[before] & ~smaller[before]]
            byte = raw[before]
            by = np.argsort(byte, kind="stable")
            for b, x, y in _ranges(byte[by]):
                if b > c:
                    coming[b].append(before[by[x:y]])
            return before[byte == c]

        queue = np.concatenate(coming[c]) if coming[c] else np.zeros(0, dtype=np.int64)
        while len(queue):
            out.append(queue)
            queue = hand(queue)
        if cuts[c + 1] > cuts[c]:
            out.append(direct[cuts[c] : cuts[c + 1]])
            hand(out[-1])
    found = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return found[wanted[found]]


def common_prefixes(raw: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, `length` at most; 0 for the first."""
    lcp = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    for offset in _offsets(length):
        word = _words(raw, order[live] + offset, ">u8").astype(np.uint64) ^ _words(raw, order[live - 1] + offset, ">u8").astype(np.uint64)
        same = word == 0
        ended = live[~same]
        bits = np.frexp((word[~same] >> np.uint64(11)).astype(np.float64))[1] + 11  # position of the highest bit, if above the eleventh
        low = word[~same] < np.uint64(1 << 11)
        bits[low] = np.frexp(word[~same][low].astype(np.float64))[1]
        lcp[ended] = np.minimum(offset + (64 - bits) // 8, length)
        live = live[same]
    lcp[live] = length
    return lcp


def _resolve(length: int, sent: pa.Table) -> pa.Table:
    """For each block's segments of this bucket: which of their windows an earlier document has."""
    distinct: dict[bytes, int] = {}
    at, order = [], []
    for row in sent.to_pylist():
        n, load = row["n"], pa.decompress(row["load"], decompressed_size=row["size"], codec="zstd", asbytes=True)
        ends = 9 * n + np.cumsum(np.frombuffer(load, dtype=np.uint8, count=n).astype(np.int64) + length - 1)
        at.append(np.fromiter((distinct.setdefault(load[a:b], len(distinct)) for a, b in zip([9 * n, *ends.tolist()], ends.tolist())), dtype=np.int64, count=n))
        order.append(np.frombuffer(load, dtype=np.int64, count=n, offset=n))
    at, order = np.concatenate(at), np.concatenate(order)
    least = np.full(len(distinct), LAST, dtype=np.int64)
    np.minimum.at(least, at, order)
    lens = np.array([len(x) for x in distinct])
    raw = np.frombuffer(b"".join(distinct) + bytes(length + 8), dtype=np.uint8)
    segment = np.repeat(np.arange(len(lens)), lens)
    inside = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    sa = suffix_order(raw, inside + length <= lens[segment], length)
    new = common_prefixes(raw, sa, length) < length
    earliest = np.minimum.reduceat(least[segment[sa]], np.flatnonzero(new))[np.cumsum(new) - 1]
    held = np.full((len(lens), WINDOWS), LAST, dtype=np.int64)
    held[segment[sa], inside[sa]] = earliest
    mask = np.packbits(held[at] < order[:, None], axis=1, bitorder="little").view("<u4")[:, 0]
    ends = np.cumsum(sent["n"].to_numpy())
    return _table(FOUND, [(block, first, mask[a:b].tobytes()) for block, first, a, b in zip(sent["block"].to_pylist(), sent["first"].to_pylist(), [0, *ends.tolist()], ends.tolist()) if mask[a:b].any()])


def _cut_out(length: int, buckets: int, last: int, blocks: pa.Table, marks: pa.Table) -> pa.Table:
    if not blocks.num_rows:
        return RESULT.empty_table()
    block = _Block(blocks.to_pylist()[0])
    size, rows = len(block.text), marks.to_pylist()
    shared = [r for r in rows if r["mask"] is None]
    gone = np.zeros(size, dtype=bool)
    if shared:
        entries = _Entries(length, buckets, last, block, shared)
        masks = np.zeros(len(entries.to), dtype=np.uint64)
        for r in rows:
            if r["mask"] is not None:
                masks[r["first"] : r["first"] + len(r["mask"]) // 4] = np.frombuffer(r["mask"], dtype=np.uint32)
        mask = np.where(entries.later, (np.uint64(1) << entries.count.astype(np.uint64)) - np.uint64(1), masks[entries.entry]).astype("<u4")
        which, window = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
        at = entries.start[which] + window
        change = np.bincount(at, minlength=size + 1) - np.bincount(at + length, minlength=size + 1)
        gone = np.cumsum(change[:size]) > 0
    starts = block.ends - block.lens
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    opens[starts[block.lens > 0]] |= gone[starts[block.lens > 0]]
    removed, spans = (np.diff(np.append(0, np.append(0, np.cumsum(x))[block.ends])) for x in (gone, opens))
    raw = np.frombuffer(block.text, dtype=np.uint8)
    shas = [hashlib.sha256((raw[a:b][~gone[a:b]] if n else raw[a:b]).tobytes()).hexdigest() for a, b, n in zip(starts.tolist(), block.ends.tolist(), removed.tolist())]
    return pa.Table.from_arrays([pa.array(block.order, mask=block.null), pa.array(block.lens), pa.array(removed), pa.array(spans), pa.array(shas)], schema=RESULT)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 50, block: int = BLOCK, hot: int = HOT, bucket_bytes: int = SEGMENTS) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 after removal of each byte covered by a string of
    `length` (16 at least) bytes that also starts in a document with a smaller id."""
    if length < 16:
        raise ValueError("length must be 16 at least")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    blocks = cut(rows.mapInArrow(lambda it: _blocks(block, it), _ddl(BLOCKS)))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(size * DENSITY) // SEEDS + 1
    asked = blocks.mapInArrow(lambda it: _ask(length, buckets, it), _ddl(ASKED))
    shared = cut(asked.groupBy("bucket").applyInArrow(lambda t: _shared(length, hot, t), _ddl(SHARED)))
    last = (shared.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes + 1
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda a, b: _send(length, buckets, last, a, b), _ddl(SENT))
    found = sent.groupBy("bucket").applyInArrow(lambda t: _resolve(length, t), _ddl(FOUND))
    marks = shared.unionByName(found, allowMissingColumns=True)
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lambda a, b: _cut_out(length, buckets, last, a, b), _ddl(RESULT))
