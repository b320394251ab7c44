"""Lexical search, suffix arrays and hard negatives against plain loops, with odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagesignal.llm import lexical, negatives, repeats

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain_search(docs, items, k):
    lists = [(i, terms(t)) for i, t in docs]
    lists = [(i, t) for i, t in lists if t]
    n_docs, words = len(lists), sum(len(t) for _, t in lists)
    df = {}
    for _, t in lists:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, t in lists:
            m = 100 - 90 + (90 * len(t) * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in set(terms(text)) if w in df)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block_terms"), [(3, 262_144), (10, 7)])
def test_lexical_search(spark, k, block_terms):
    draw = random.Random(k)
    words = ["tea", "Tea", "Ünder", "ünder", "x1", "1", "cup's", "pot", "a-b", "中文", "_", "lid"]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(words) for _ in range(n))
    docs = [(k, text(draw.choice([1, 3, 8, 30]))) for k in range(60)] + [(7, "tea pot"), (7, "tea pot"), (None, "tea pot"), (90, None), (91, ""), (92, " .,; "), (93, "word " * 5000 + "lid")]
    items = [(k, text(draw.choice([1, 4]))) for k in range(12)] + [(3, "tea"), (50, None), (51, ""), (52, "unknown"), (None, "pot pot POT")]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, key string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    got = lexical.search(frame, asked, k=k, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, k)
    empty = frame.where("false")
    assert lexical.search(empty, asked).count() == 0 and lexical.search(frame, asked.where("false")).count() == 0


def test_vocabulary_parts_keep_sums_exact():
    weights = np.random.default_rng(1).integers(0, 25_000, (5, 900))
    parts = lexical.vocabulary_parts(weights, columns=100, exact=10**12)
    assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == 900
    assert all(weights.max(axis=0)[a:b].sum() * lexical.MOST_IMPACT < 10**12 and b - a <= 100 for a, b in parts)
    assert lexical.vocabulary_parts(np.zeros((3, 0), dtype=np.int64)) == []


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 10)
    text = "some words that are longer than one piece " * 9
    assert dict(lexical.word_counts(text.encode())) == {w.encode(): text.split().count(w) for w in text.split()}


def plain_removal(docs, n):
    """Windows of n bytes and the least id that has them, by a dictionary."""
    rows = [(i, (t or "").encode()) for i, t in docs]
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, b in rows:
        for k in range(len(b) - n + 1):
            w = b[k : k + n]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - n + 1):
            if first[b[k : k + n]] < order(i):
                gone[k : k + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "block", "hot", "bucket"), [(50, 4 << 20, 16_384, 1 << 20), (20, 2000, 3, 500), (16, 300, 0, 100), (33, 5000, 10**6, 300)])
def test_repeated_passages(spark, length, block, hot, bucket):
    draw = random.Random(length)
    letters = "ab é中\x00"
    text = lambda n: "".join(draw.choice(letters if draw.random() < 0.5 else "xyzw ") for _ in range(n))
    shared = [text(n) for n in (60, 90, 200, length)]
    docs = [(draw.randrange(40), text(draw.randrange(120)) + draw.choice([*shared, ""]) + text(draw.randrange(30)) + draw.choice([*shared, ""])) for _ in range(90)]
    docs += [(41, "a" * 300), (42, "a" * 120), (5, "a" * (length - 1)), (None, shared[1]), (None, shared[1] + "q"), (43, shared[2]), (43, shared[2]), (44, None), (45, ""), (46, "é" * 100), (47, "é" * 77 + "n"), (48, "ab" * 90), (49, "b" + "ab" * 60)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, block int, ids string").repartition(3)
    got = repeats.removed(frame, length=length, block=block, hot=hot, bucket_bytes=bucket)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_removal(docs, length)
    assert repeats.removed(frame.where("false"), length=length).count() == 0


@pytest.mark.parametrize("letters", ["a", "ab", "abc\x00", "the quick brown fox"])
def test_suffixes_are_sorted_in_two_stages(letters):
    draw, length = random.Random(len(letters)), 24
    for n in (1, 2, 30, 400):
        text = "".join(draw.choice(letters) for _ in range(n)).encode()
        raw = np.frombuffer(text + bytes(length + 8), dtype=np.uint8)
        for share in (1.0, 0.3):
            wanted = np.array([draw.random() < share for _ in range(n)])
            order = repeats.suffix_order(raw, wanted, length)
            assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
            heads = [text[i : i + length] for i in order]
            whole = [h for h in heads if len(h) == length]
            assert whole == sorted(whole)
            common = repeats.common_prefixes(raw, order, length)
            for a, b, c in zip(order, order[1:], common[1:]):
                x, y = (bytes(raw[i : i + length]) for i in (a, b))
                assert c == next((k for k in range(length) if x[k] != y[k]), length)


def plain_negatives(rows, positives, count, low, high):
    ok = [(i, k, label, [math.floor(256 * x) for x in v]) for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and len(v) == 6 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, k, label, v in ok:
        if i % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for j, m, other, w in ok if m != k)
        for s, j, _, other in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and low * -s <= 100 * -x[0] <= high * -s][:count]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("slice_rows", "part_rows"), [(None, None), (7, 3)])
def test_hard_negatives(spark, slice_rows, part_rows, monkeypatch):
    monkeypatch.setattr(negatives, "TILE", 16)
    monkeypatch.setattr(negatives, "FIRST", 2)
    monkeypatch.setattr(negatives, "STEP", 1)
    draw = random.Random(3)
    rows = [(draw.randrange(70), [draw.choice([0.0, 0.25, 0.5, 1.0, -1.0, draw.random()]) for _ in range(6)], draw.choice([0, 0, 0, 1, 2])) for _ in range(150)]
    rows += [(10, [1.0] * 6, 0), (10, [1.0] * 6, 0), (11, [1.0] * 6, 1), (15, [0.0] * 6, 7), (20, [0.0] * 6, 7), (25, None, 1), (30, [1.0] * 5, 1), (35, [1.0] * 5 + [None], 1), (40, [float("nan")] + [1.0] * 5, 1), (45, [float("inf")] + [1.0] * 5, 0), (None, [1.0] * 6, 1), (50, [1.0] * 6, None), (55, [], 1)]
    frame = spark.createDataFrame([(i, v, label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, s int, row string").repartition(4)
    got = negatives.mine(frame, F.col("vec_id") % 5 == 0, positives=4, negatives=3, low=40, high=90, slice_rows=slice_rows, part_rows=part_rows)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, 4, 3, 40, 90)
    none = lambda df: negatives.mine(df, F.col("vec_id") % 5 == 0).count()
    assert none(frame.where("false")) == 0 and none(frame.where("label = 0")) == 0 and none(frame.where("vec_id = 5").limit(1)) == 0


def test_huge_components_do_not_wrap(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 1.0], 0), (2, [6e29, 1.0], 1), (3, [-1e30, 0.0], 1)]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0).collect()
    assert all(r["positive_score"] > 0 for r in got)
