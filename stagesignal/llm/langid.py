"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 1- to 3-byte grams of a lower-cased text in which ASCII other than letters is a space. Each hashes to
a row of an embedding table; a text is the average of its rows, and a linear layer with softmax gives the languages.
Embeddings and layer are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled
rows. Scores are calibrated by a temperature fitted on rows held out of that sample, and a text is rejected when its
score, or the share of its 3-byte grams that training has seen, is below what nearly all held-out texts of its length
reach: both bounds come from the sample's texts and windows of them alone, one pair for each power of two of the length.
At prediction the two linear maps are multiplied into one table.

Bounds (parameters): about `per_lang` rows for each of the `most_langs` commonest labels, none over `most_chars`
characters and about `all_chars` in all; whole texts otherwise, and always whole texts at prediction.

Defined cases: a text that is null or has no letter is `und` with score 0 and is rejected; a text of any length is
predicted from all of it; copies and repeated rows get equal predictions; without labelled rows every text is `und`;
an empty table gives an empty result. Other columns are kept by `accepted_rows` and ignored by `identify`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
GRAMS, BUCKETS, DIM = 3, 1 << 14, 16
#: Hash table of the 3-byte grams seen, large enough that few unseen ones share a place with a seen one.
TRIGRAMS = 1 << 20
#: Windows of held-out texts scored for each length, about; shares of seen grams are taken from 16 times as many.
WINDOWS = 4000
PIECE = 1 << 20
#: ASCII letters in lower case, bytes of other characters as they are, all else a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-cased letters of a text. Runs of spaces count as one."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" "


def subwords(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of letters and how often each occurs."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + GRAMS - 1], dtype=np.uint8).astype(np.uint32)
        code = np.zeros(len(b), dtype=np.uint32)
        for n in range(GRAMS):
            code = code[: len(b) - n] * np.uint32(257) + b[n:] + np.uint32(1)
            own = code[:PIECE]
            counts += np.bincount((own * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    on = np.flatnonzero(counts)
    return on, counts[on]


def trigrams(raw: bytes) -> Iterator[np.ndarray]:
    """Places of all 3-byte grams of letters in a table of TRIGRAMS, some at a time."""
    for at in range(0, len(raw) - 2, PIECE):
        b = np.frombuffer(raw[at : at + PIECE + 2], dtype=np.uint8).astype(np.uint32)
        code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        yield (code * np.uint32(2654435761)) >> np.uint32(12)


def band(raw: bytes) -> int:
    """The power of two of the number of 3-byte grams."""
    return max(1, len(raw) - 2).bit_length() - 1


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs: embeddings times layer
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # TRIGRAMS: whether training had such 3-byte grams
    least: np.ndarray = field(default_factory=lambda: np.zeros(1))  # by band of length: scores below it are rejected
    familiar: np.ndarray = field(default_factory=lambda: np.zeros(1))  # and shares of seen 3-byte grams below it

    def logits(self, raw: bytes) -> tuple[np.ndarray, float]:
        on, n = subwords(raw)
        n = n / n.sum()
        known = sum(int(self.seen[t].sum()) for t in trigrams(raw))
        return n @ self.table[on] + self.bias, known / max(1, len(raw) - 2)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if not self.langs or not isinstance(text, str) or not any(c.isalpha() for c in text):
                rows.append((UNKNOWN, 0.0, False))
                continue
            raw = letters(text)
            x, known = self.logits(raw)
            p = np.exp((x - x.max()) / self.temperature)
            k = int(p.argmax())
            score = float(p[k] / p.sum())
            at = min(band(raw), len(self.least) - 1)
            rows.append((self.langs[k], score, score >= self.least[at] and known >= self.familiar[at]))
        return pd.DataFrame(rows, columns=["lang", "score", "accepted"]).astype({"score": "float64", "accepted": "bool"})


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def spans(n: int, each: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(band, starts, length) of a text of n 3-byte grams: windows for every lower band, and the whole of it."""
    top = max(1, n).bit_length() - 1
    for k in range(top):
        size = 1 << k
        yield k, np.linspace(0, n - size, min(each, n >> k)).astype(int), size
    yield top, np.zeros(1, dtype=int), n


def bounds(values: list[list[float]], rejected: float) -> np.ndarray:
    """What all but the rejected share reaches in each band. A band with too few values to tell takes the bound of the
    one below, and none is stricter than a longer one: short texts are hard, not foreign."""
    told = [k for k, v in enumerate(values) if len(v) * rejected >= 1]
    if not told:
        return np.full(1, min((x for v in values for x in v), default=0.0))
    out = np.array([np.quantile(values[k], rejected) if k in told else np.inf for k in range(told[-1] + 1)])
    return np.minimum.accumulate(out[::-1])[::-1]


def window_logits(model: Model, raw: bytes) -> Callable[[np.ndarray, int], np.ndarray]:
    """The logits of a text's windows, from running sums of what its subwords add: (starts, length) -> a row each."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    code, sums = np.zeros(len(b), dtype=np.uint32), []
    for n in range(GRAMS):
        code = code[: len(b) - n] * np.uint32(257) + b[n:] + np.uint32(1)
        sums.append(np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(model.table[(code * np.uint32(2654435761)) >> np.uint32(18)], axis=0)]))

    def logits(starts: np.ndarray, length: int) -> np.ndarray:
        ends = [np.minimum(starts + max(0, length - n), len(x) - 1) for n, x in enumerate(sums)]
        total = sum(e - np.minimum(starts, e) for e in ends)
        return sum(x[e] - x[np.minimum(starts, e)] for x, e in zip(sums, ends)) / np.maximum(total, 1)[:, None] + model.bias

    return logits


def train(texts: list[str], labels: list[str], *, epochs: int = 12, rate: float = 4.0, batch: int = 32, seed: int = 5, rejected: float = 0.001) -> Model:
    """Stochastic gradient descent on embeddings and layer; every eighth text is held out for calibration."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, np.zeros(BUCKETS, dtype=bool))
    rng = np.random.default_rng(seed)
    raws = [letters(t) for t in texts]
    grams = [subwords(t) for t in raws]
    y = np.array([langs.index(x) for x in labels])
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), dtype=np.float32)
    held = np.arange(len(texts)) % 8 == 7
    learn = np.flatnonzero(~held)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
        for k, r in enumerate(rows):
            on, n = grams[r]
            x[k, on] = n / n.sum()
        return x

    steps, step = epochs * -(-len(learn) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            x = dense(rows)
            h = x @ emb
            p = _softmax(h @ layer + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= rate * (1 - step / steps) / len(rows)
            back = p @ layer.T
            layer -= h.T @ p
            bias -= p.sum(axis=0)
            on = np.flatnonzero(x.any(axis=0))
            emb[on] -= x[:, on].T @ back
            step += 1
    codes = [np.concatenate([np.zeros(0, dtype=np.uint32), *trigrams(raw)]) for raw in raws]
    times = np.zeros(TRIGRAMS, dtype=np.int64)
    for c in codes:
        times[np.unique(c)] += 1
    model = Model(langs, (emb @ layer).astype(np.float64), bias.astype(np.float64), 1.0, times >= 2)
    check = np.flatnonzero(held) if held.any() else learn
    z = np.array([model.logits(raws[r])[0] for r in check])
    losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean() for t in np.geomspace(0.1, 4, 25)}
    model.temperature = float(min(losses, key=lambda t: (losses[t], t)))
    scores, shares = ([[] for _ in range(64)] for _ in range(2))
    for r in check:
        logits = window_logits(model, raws[r])
        for k, starts, size in spans(len(codes[r]), -(-WINDOWS // len(check))):
            scores[k].extend(_softmax(logits(starts, size + 2) / model.temperature).max(axis=1))
    for c in codes:
        # Seen in two texts besides its own, so that every text is as one held out.
        upto = np.concatenate([[0], np.cumsum(times[c] >= 3)])
        for k, starts, size in spans(len(c), -(-16 * WINDOWS // len(codes))):
            shares[k].extend((upto[starts + size] - upto[starts]) / max(1, size))
    model.least, model.familiar = bounds(scores, rejected), bounds(shares, rejected)
    return model


def sample(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, *, per_lang: int = 600, most_langs: int = 100, most_chars: int = 20_000, all_chars: int = 40_000_000) -> pd.DataFrame:
    """A bounded sample of labelled rows, about per_lang of each language, by a hash of the id."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= most_chars))
    counts = usable.groupBy(lang_col).agg(F.count("*").alias("count"), F.sum(F.length(text_col)).alias("chars")).orderBy(F.desc("count"), lang_col).limit(most_langs).collect()
    if not counts:
        return pd.DataFrame({"id": [], "text": [], "lang": []})
    share = F.lit(-1.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r[0], F.lit(min(1.0, per_lang / r["count"], all_chars / len(counts) / max(1, r["chars"])))).otherwise(share)
    drawn = (F.pmod(F.xxhash64(F.lit("langid"), id_col), F.lit(1 << 30)) / (1 << 30)) < share
    rows = usable.where(drawn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return rows.limit(2 * per_lang * len(counts)).toPandas().sort_values(["id", "text"], ignore_index=True)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", **bounds: int) -> Model:
    rows = sample(labelled, text_col, lang_col, id_col, **bounds)
    return train(rows["text"].tolist(), rows["lang"].tolist())


def predictor(model: Model, df: DataFrame):
    """A column function: text -> struct(lang, score, accepted). The model (a bounded table) is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]))
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield shared.value.predict(texts)

    return predicted


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold. A null id is held out."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(folds)) == fold, F.lit(True))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    return predictor(model, docs)(F.col(text_col))


def accepted_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is not rejected, all columns kept."""
    return docs.select(F.struct("*").alias("_row"), identify(docs, model, text_col).alias("_p")).where("_p.accepted").select("_row.*")
