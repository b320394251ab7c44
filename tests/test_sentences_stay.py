"""Sentences of texts meet those of profiles where they are read."""

import random
import re

from stagesignal.operators import texts


def _tables(spark):
    draw = random.Random(4)
    words = [f"w{k}" for k in range(9)] + ["The", "of"] * 3
    line = lambda: " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 5, 8])))
    text = lambda: draw.choice(".!?\n").join(line() for _ in range(3))
    rows = lambda n: [(k, text()) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "...")]
    return rows(25), rows(12), lambda a, b: (spark.createDataFrame(a, "text_id long, text string"), spark.createDataFrame(b, "profile_id long, text string"))


def test_sentence_pairs_are_those_of_all_pairs(spark, monkeypatch):
    a, b, tables = _tables(spark)
    sets = lambda rows: [(k, s, set(re.findall("[a-z0-9]+", part.lower()))) for k, t in rows if t is not None for s, part in enumerate(re.split(r"[.!?\n]+", t))]
    for least in (0.5, 0.7):
        want = sorted((i, s, j, r, round(len(x & y) / len(x | y), 6)) for i, s, x in sets(a) for j, r, y in sets(b) if x and y and len(x & y) >= least * len(x | y))
        assert len(want) > 20
        for most in (2_000_000, 0):
            monkeypatch.setattr(texts, "MOST_SENT", most)
            assert sorted(map(tuple, texts.leakage_sentences(*tables(a, b), least).collect())) == want


def test_texts_are_read_once_and_do_not_travel(spark):
    a, b, tables = _tables(spark)
    plan = texts.leakage_sentences(*tables(a, b))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
