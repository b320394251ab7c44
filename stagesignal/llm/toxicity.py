"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a lower-cased text and the first five and seven bytes of longer words, hashed to 32 bits; a beginning
that a text has 2, 3, 5 or 8 times gives a further term for each of these numbers. On a bounded labelled sample the terms
that say most about the label are kept (by chi-square, counted in Spark), and a factorization machine

    w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)

over those present is trained by AdaGrad on the logistic loss: a pair such as insult and group mention has a weight
of its own, beyond the sum of the two. A visit to a text leaves out a tenth of its terms at random, so that a text with few
of the telling terms is known too. Scores are calibrated by a slope and offset fitted on rows held out of the sample.

Bounds (parameters): about `per_label` rows of each label, of those the ones of at most `most_chars` characters, long ones
too: a long text meets many terms by chance, which short ones alone would not teach. The driver gets the kept terms (KEPT
at most) and which of them each sampled row has, two bytes each. Every row is scored from its whole text.

Defined cases: null and empty texts score as a text without known terms; repeated rows and copies score equally; rows
without a label are scored, not learned from; without rows of both labels all scores are the share of label 1 (0.0
without labels); an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagesignal.llm.common import cut
from stagesignal.llm.langid import LETTERS

FACTORS, KEPT, HEADS = 8, 4096, (5, 7)
#: Times that the beginning of a word occurs in a text, each a term of its own.
TIMES = (2, 3, 5, 8)
#: Least chi-square of a term that is kept, and texts that have it.
LEAST_CHI, LEAST_TEXTS = 10.0, 3
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of a text handled at once.
PIECE = 1 << 20
#: Every CHECKth row of a sample of LEAST_ROWS or more is held out for calibration.
CHECK, LEAST_ROWS = 6, 60
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for a window of n (PIECE and a few at most)."""
    size = 1 << max(10, n.bit_length())
    if size not in _POWERS:
        _POWERS[size] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, x, dtype=np.uint64))]) for x in (BASE, INVERSE))
    return _POWERS[size]


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)


def terms(text: str | None) -> np.ndarray:
    """Hashes of a text's different terms, by rolling sums over its bytes: no word is handled alone, unless it is longer
    than a piece."""
    if not isinstance(text, str):
        return np.zeros(0, dtype=np.uint32)
    raw = text.lower().encode("utf-8", "replace").translate(LETTERS)
    words: list[np.ndarray] = []
    heads: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in HEADS}
    at = 0
    with np.errstate(over="ignore"):
        while at < len(raw):
            end = min(at + PIECE, len(raw))
            if end < len(raw) and raw[end] != 32:  # pieces end at a space
                end = raw.rfind(b" ", at + 1, end)
            if end > at:
                _piece(raw[at:end], words, heads)
            else:
                at += raw[at] == 32
                end = raw.find(b" ", at + PIECE)
                end = len(raw) if end < 0 else end
                _long_word(raw, at, end, words, heads)
            at = end
        found = [_mixed(np.concatenate(words), 1)] if words else []
        for n, seen in heads.items():
            if seen:
                values, of = np.unique(np.concatenate([v for v, _ in seen]), return_inverse=True)
                count = np.bincount(of, np.concatenate([c for _, c in seen]))
                found += [_mixed(values, n), *(_mixed(values[count >= k], n + 16 * k) for k in TIMES)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint32)


def _piece(raw: bytes, words: list[np.ndarray], heads: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> None:
    """Adds the words and beginnings of a piece of whole words."""
    b = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    inside = b != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])])
    words.append(np.unique((sums[stop] - sums[start]) * down[start]))
    for n in heads:
        at = start[stop - start > n]
        heads[n].append(np.unique((sums[at + n] - sums[at]) * down[at], return_counts=True))


def _long_word(raw: bytes, start: int, stop: int, words: list[np.ndarray], heads: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> None:
    """Adds a word longer than a piece, summed part by part."""
    def part(a: int, b: int) -> np.uint64:
        return ((np.frombuffer(raw[a:b], dtype=np.uint8).astype(np.uint64) + np.uint64(1)) * _powers(b - a)[0][: b - a]).sum(dtype=np.uint64)

    total = 0
    for a in range(start, stop, PIECE):
        total += int(part(a, min(a + PIECE, stop))) * pow(int(BASE), a - start, 1 << 64)
    words.append(np.array([total % (1 << 64)], dtype=np.uint64))
    for n in heads:
        heads[n].append((np.array([part(start, start + n)], dtype=np.uint64), np.array([1])))


@dataclass
class Model:
    known: np.ndarray  # sorted term hashes
    w0: float
    w: np.ndarray
    v: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, on: np.ndarray) -> float:
        v = self.v[on]
        return float(self.w0 + self.w[on].sum() + 0.5 * ((v.sum(axis=0) ** 2) - (v**2).sum(axis=0)).sum())

    def score(self, text: str | None) -> float:
        z = self.slope * self.raw(places(self.known, terms(text))) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def chi_square(n1, n0, p1, p0, greatest):
    """How far a term that n1 of p1 texts of label 1 and n0 of p0 others have is from saying nothing. Numbers or columns."""
    expected = (n1 + n0) * p1 / (p1 + p0)
    return (n1 - expected) * (n1 - expected) / greatest(expected * p0 / (p1 + p0) * (1 - (n1 + n0) / (p1 + p0 + 1)))


def train(texts: list[str | None], labels: list[int], **settings: float) -> Model:
    """From texts at hand, as `fit` does from tables."""
    found, y = [terms(t) for t in texts], np.array(labels, dtype=np.float64)
    held = _held(np.arange(len(y)), len(y))
    learn = np.flatnonzero(~held)
    every = np.concatenate([found[r] for r in learn]) if len(learn) else np.zeros(0, dtype=np.uint32)
    known, at = np.unique(every, return_inverse=True)
    of = np.repeat(y[learn], [len(found[r]) for r in learn])
    n1, n0 = np.bincount(at, of, len(known)), np.bincount(at, 1 - of, len(known))
    chi = chi_square(n1, n0, y[learn].sum(), (1 - y[learn]).sum(), lambda x: np.maximum(x, 1e-9)) if len(learn) else n1
    keep = np.flatnonzero((n1 + n0 >= LEAST_TEXTS) & (chi > LEAST_CHI))
    known = np.sort(known[keep[np.lexsort((known[keep], -chi[keep]))[:KEPT]]])
    return learned(known, [places(known, f) for f in found], y, held, **settings)


def _held(numbers: np.ndarray, n: int) -> np.ndarray:
    return (numbers % CHECK == CHECK - 1) & (n >= LEAST_ROWS)


def places(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where the terms found are among the (sorted) known ones."""
    if not len(known):
        return np.zeros(0, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return at[known[at] == found]


def learned(known: np.ndarray, rows: list[np.ndarray], y: np.ndarray, held: np.ndarray, *, prior: float | None = None, steps: int = 80_000, rate: float = 0.1, decay: float = 1e-4, left_out: float = 0.1, seed: int = 3) -> Model:
    """From the places of each text's known terms. prior: the share of label 1 among all labelled rows; rows are weighted
    to it. held: the rows for calibration."""
    share = float(y.mean()) if len(y) else 0.0
    prior = share if prior is None else prior
    if share in (0.0, 1.0):
        return Model(np.zeros(0, dtype=np.uint32), -30.0 if not share else float(np.log(share / max(1 - share, 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))
    learn, check = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(y))
    rng = np.random.default_rng(seed)
    model = Model(known, float(np.log(prior / (1 - prior))), np.zeros(len(known)), rng.normal(0, 0.05, (len(known), FACTORS)))
    gw, gv, g0 = np.full(len(known), 1e-2), np.full((len(known), FACTORS), 1e-2), 1e-2
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    for _ in range(min(40, -(-steps // len(learn)))):
        for r in rng.permutation(learn):
            on = rows[r][rng.random(len(rows[r])) >= left_out]
            total = model.v[on].sum(axis=0)
            z = model.w0 + model.w[on].sum() + 0.5 * ((total**2).sum() - (model.v[on] ** 2).sum())
            g = weight[r] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r])
            dw, dv = g + decay * model.w[on], g * (total - model.v[on]) + decay * model.v[on]
            gw[on] += dw**2
            gv[on] += dv**2
            g0 += g * g
            model.w[on] -= rate * dw / np.sqrt(gw[on])
            model.v[on] -= rate * dv / np.sqrt(gv[on])
            model.w0 -= rate * g / np.sqrt(g0)
    z = np.array([model.raw(rows[r]) for r in check])
    slope, offset = 1.0, 0.0
    for _ in range(200):  # Platt scaling with smoothed labels
        t = np.where(y[check] == 1, 0.999, 0.001)
        g = weight[check] * (1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30))) - t)
        slope, offset = max(0.2, slope - 0.1 * float((g * z).mean()) / max(1.0, float((z * z).mean()))), offset - 0.5 * float(g.mean())
    model.slope, model.offset = slope, offset
    return model


def draw(labels: DataFrame, label_col: str, id_col: str, per_label: int) -> tuple[DataFrame, float | None]:
    """A bounded sample of rows labelled 0 or 1, about per_label of each by a hash of the id, and the share of label 1
    among all of them."""
    usable = labels.where(F.col(label_col).isin(0, 1))
    counts = {r[0]: r["count"] for r in usable.groupBy(label_col).count().collect()}
    share = F.lit(-1.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == label, F.lit(min(1.0, per_label / n))).otherwise(share)
    drawn = (F.pmod(F.xxhash64(F.lit("toxicity"), id_col), F.lit(1 << 30)) / (1 << 30)) < share
    return usable.where(drawn).limit(4 * per_label), counts.get(1, 0) / sum(counts.values()) if counts else None


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", *, labels: DataFrame | None = None, per_label: int = 6000, most_chars: int = 200_000, **settings: float) -> Model:
    """Learns from labelled texts; with labels, from the texts of labelled whose ids labels has. The sample is drawn from
    the labels alone, so that only its ids (a bounded number) meet the texts, by broadcast."""
    rows, prior = draw(labelled if labels is None else labels, label_col, id_col, per_label)
    if labels is not None:
        rows = labelled.select(id_col, text_col).join(F.broadcast(rows.select(id_col, label_col)), id_col)
    rows = rows.where(F.length(F.coalesce(text_col, F.lit(""))) <= most_chars)
    number = F.pmod(F.xxhash64(F.lit("calibration"), id_col), F.lit(CHECK)).alias("number")
    rows = cut(rows.select(F.col(id_col).alias("id"), number, F.col(label_col).cast("int").alias("label"), _packed(F.col(text_col)).alias("terms")))
    size = rows.count()
    counts = rows.where((F.col("number") != CHECK - 1) | F.lit(size < LEAST_ROWS)).mapInPandas(_counted, "term long, n1 long, n0 long")
    counts = counts.groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sizes = {r["label"]: r["n"] for r in rows.where((F.col("number") != CHECK - 1) | F.lit(size < LEAST_ROWS)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    chi = chi_square(F.col("n1"), F.col("n0"), float(sizes.get(1, 0)), float(sizes.get(0, 0)), lambda x: F.greatest(x, F.lit(1e-9))) if sizes else F.lit(0.0)
    kept = counts.withColumn("chi", chi).where((F.col("n1") + F.col("n0") >= LEAST_TEXTS) & (F.col("chi") > LEAST_CHI)).orderBy(F.desc("chi"), "term").limit(KEPT)
    known = np.sort(kept.select("term").toPandas()["term"].to_numpy().astype(np.uint32))

    @F.pandas_udf(T.BinaryType())
    def placed(found: pd.Series) -> pd.Series:
        return pd.Series([places(known, np.frombuffer(t, dtype=np.uint32)).astype(np.uint16).tobytes() for t in found], index=found.index, dtype=object)

    got = rows.select("id", "number", "label", placed("terms").alias("places")).toPandas().sort_values(["id", "places"], ignore_index=True)
    at = [np.frombuffer(p, dtype=np.uint16).astype(np.int64) for p in got["places"]]
    return learned(known, at, got["label"].to_numpy(dtype=np.float64), _held(got["number"].to_numpy(), len(got)), prior=prior, **settings)


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([terms(t).tobytes() for t in texts], index=texts.index, dtype=object)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of either label per term, a batch at a time."""
    for batch in batches:
        parts = {k: np.unique(np.concatenate([np.zeros(0, dtype=np.uint32), *(np.frombuffer(t, dtype=np.uint32) for t in batch.loc[batch["label"] == k, "terms"])]), return_counts=True) for k in (0, 1)}
        yield pd.concat([pd.DataFrame({"term": v.astype(np.int64), "n1": c * k, "n0": c * (1 - k)}) for k, (v, c) in parts.items()])


def scorer(model: Model, df: DataFrame):
    """A column function: text -> score. The model (a bounded table) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([shared.value.score(t) for t in texts], index=texts.index, dtype="float64")

    return scored
