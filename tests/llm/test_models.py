"""Scores of the language model and the toxicity model against plain loops over their subwords and terms."""

import math

import numpy as np

from stagesignal.llm import langid, toxicity

TEXTS = [f"{a} {b} {a} the house {k}" for k, (a, b) in enumerate([("über", "straße"), ("the", "garden"), ("mañana", "niño"), ("où", "garçon")] * 12)]
LANGS = ["de", "en", "es", "fr"] * 12


def plain_logits(model, raw):
    """Every gram of one to three bytes, one after the other."""
    total, n = np.zeros(len(model.langs)), 0
    for at in range(len(raw)):
        code = 0
        for size in range(1, 4):
            if at + size > len(raw):
                break
            code = (code * 257 + raw[at + size - 1] + 1) % 2**32
            total += model.table[((code * 2654435761) % 2**32) >> 18]
            n += 1
    return total / n + model.bias


def test_language_scores_are_those_of_a_plain_loop():
    model = langid.train(TEXTS, LANGS, epochs=3)
    for text in [*TEXTS[:20], *["ü", "a b", "Über die Straße " * 40], *[t[::-1] for t in TEXTS[:27]]]:
        raw = langid.letters(text)
        x = plain_logits(model, raw)
        p = [math.exp(v / model.temperature) for v in x - x.max()]
        got = langid.pd.Series([text])
        row = model.predict(got).iloc[0]
        assert row["lang"] == model.langs[int(np.argmax(p))] and abs(row["score"] - max(p) / sum(p)) < 1e-9
        windows = langid.window_logits(model, raw)
        for start, length in ((0, len(raw)), (0, 3), (max(0, len(raw) - 3), 3), (len(raw) // 2, min(5, len(raw) - len(raw) // 2))):
            assert np.allclose(windows(np.array([start]), length)[0], plain_logits(model, raw[start : start + length]), atol=1e-9)


def test_toxicity_scores_are_those_of_all_pairs():
    """Each pair of terms one after the other."""
    draw = np.random.default_rng(1)
    words = ["you", "fool", "group", "kind", "tea", "pot", "lid", "cup", "red", "blue"]
    texts = [" ".join(draw.choice(words, 6)) for _ in range(120)]
    model = toxicity.train(texts, [int("fool" in t and "group" in t) for t in texts], steps=2000)
    assert len(model.known)
    for text in [*texts[:50], "", None, "unknown words only", "fool " * 500 + "group"]:
        on = [int(np.searchsorted(model.known, t)) for t in toxicity.terms(text) if t in set(model.known.tolist())]
        z = model.w0 + sum(model.w[k] for k in on)
        z += sum(float(np.dot(model.v[a], model.v[b])) for n, a in enumerate(on) for b in on[n + 1 :])
        want = 1 / (1 + math.exp(-min(30, max(-30, model.slope * z + model.offset))))
        assert abs(model.score(text) - want) < 1e-9
