"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and kinds, model type, byte fallback and normaliser
settings. From it a tokenizers backend is built: the normaliser (compiled character map, extra spaces, dummy prefix,
escape of the space to the metaspace marker), and a unigram model from the scores, or for BPE models the merges that
the scores imply, either with byte fallback. Batches are encoded multithreaded.

Where no piece holds a marker after another character, no token can cross a word's start, so words are encoded on
their own: each different word of a worker's recent batches once. Each is also encoded by the sentencepiece library
and the two are compared (parity). Models without that property are encoded and compared text by text. Character maps go
by grapheme clusters here and by prefixes there: a text with a combining mark may lack parity under such a model.

Defined cases: a null text has null ids and no tokens, and null parity and round trip; an empty text has no tokens;
round_trip is whether decoding gives the normalised text back, marker characters in the text being read as spaces;
copies and repeated rows encode alike; ids are of any type; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"
#: Kinds of pieces and model types in the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words that a worker remembers, and bytes of text per output batch.
WORDS, BATCH_BYTES = 400_000, 1 << 21
#: Words per string handed to a library, and threads of a worker.
GROUP, THREADS = 400, 2
#: What an unknown piece decodes to (fixed value).
UNKNOWN_TEXT = " ⁇ "


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; values stay integers or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    raw: bytes
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    unknown: int = 0


def parse(raw: bytes) -> Model:
    model = Model(raw)
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            if kind == UNKNOWN:
                model.unknown = len(model.pieces)
            model.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return model


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges of a BPE model: every split of a piece into two pieces, the best-scored pieces first."""
    known = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    out = []
    for piece, i in known.items():
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in known and right in known:
                out.append((-pieces[i][1], i, known[left], known[right], left, right))
    return [m[4:] for m in sorted(out)]


def normaliser(model: Model) -> normalizers.Normalizer:
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.squeeze and model.escape:  # marker characters of the text itself end like spaces
        steps.append(normalizers.Replace(Regex(rf"{MARK}+\z"), ""))
    return normalizers.Sequence(steps)


def backend(model: Model) -> Tokenizer:
    """The tokenizer. A unigram model holds the pieces that texts may match alone (place 0 is unknown text): control and
    byte pieces are no text, whatever a text spells. Its unknown text becomes bytes in `Coder.unigram`."""
    if model.kind == UNIGRAM:
        core = models.Unigram([("", 0.0), *((p, s) for p, s, kind in model.pieces if kind in (NORMAL, USER))], unk_id=0, byte_fallback=False)
    elif model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model.pieces), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    out = Tokenizer(core)
    out.normalizer = normaliser(model)
    if model.kind == BPE and by_word(model):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+$"), "isolated")
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    return out


def by_word(model: Model) -> bool:
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


class Coder:
    """Encodes and decodes texts; built once per worker from the model's bytes. Token ids travel as int32 bytes."""

    def __init__(self, raw: bytes):
        self.model = parse(raw)
        self.backend = backend(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.normal = self.backend.normalizer
        self.plain = not self.model.charsmap and not self.model.squeeze and self.model.escape and self.model.dummy_prefix
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$") if self.plain and self.model.kind == BPE and by_word(self.model) else None
        self.core = Tokenizer(self.backend.model)  # without normaliser: for words that are normalised already
        self.nul = self.core.token_to_id("<0x00>") if self.model.byte_fallback else None
        self.own = [self.model.unknown, *(k for k, (_, _, kind) in enumerate(self.model.pieces) if kind in (NORMAL, USER))]
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE} if self.model.byte_fallback else {}
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()  # known words for which the libraries differ
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else UNKNOWN_TEXT.encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]

    def words(self, text: str) -> list[str]:
        """The words of a text, each without its first marker."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[-1] != " ":
            return text.split(" ") if text[0] != " " else [w[1:] for w in self.split.findall(MARK + text.replace(" ", MARK))]
        return [w[1:] for w in self.split.findall(MARK + text.replace(" ", MARK))]

    def learn(self, new: list[str]) -> None:
        """Encodes words and compares with the other library. Plain words go to either many at a time: here a NUL,
        which never merges with others, stands between two; there a space, whose marker starts the next word."""
        together = [w for w in new if self.nul is not None and w and "\0" not in w and MARK not in w]
        parts = [together[k : k + GROUP] for k in range(0, len(together), GROUP)]
        mine = self.core.encode_batch_fast([MARK + f"\0{MARK}".join(part) for part in parts], add_special_tokens=False)
        theirs = self.other.encode([" ".join(part) for part in parts], num_threads=THREADS)
        unsure = []
        for part, e, b in zip(parts, mine, theirs):
            ids = np.array(e.ids, dtype=np.int32)
            cuts = np.flatnonzero(ids == self.nul)
            data, start = ids.tobytes(), 0
            for w, end in zip(part, [*(4 * cuts).tolist(), len(data)], strict=True):
                self.known[w] = data[start:end]
                start = end + 4
            if not np.array_equal(np.delete(ids, cuts), b):
                unsure += part
        rest = [w for w in new if w not in self.known]
        for w, e in zip(rest, self.core.encode_batch_fast([MARK + w for w in rest], add_special_tokens=False)):
            self.known[w] = np.array(e.ids, dtype=np.int32).tobytes()
        unsure += rest
        for w, b in zip(unsure, self.other.encode([w.replace(MARK, " ") for w in unsure], num_threads=THREADS)):
            # An empty text has no tokens there; as the last word it is a lone marker.
            if self.known[w] != np.array(b if w else [self.other.piece_to_id(MARK)], dtype=np.int32).tobytes():
                self.odd.add(w)

    def unigram(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts by a unigram model; unknown text becomes bytes where the model has those."""
        # A text of which nothing is left still has the dummy prefix, unless end spaces are dropped.
        bare = MARK if self.model.dummy_prefix and self.model.escape and not self.model.squeeze else ""
        normal = [(self.normal.normalize_str(t) or bare) if t else "" for t in texts]
        out = []
        for text, e in zip(normal, self.core.encode_batch(normal, add_special_tokens=False)):
            ids: list[int] = []
            for i, (a, b) in zip(e.ids, e.offsets):
                ids += [self.byte_ids[x] for x in text[a:b].encode()] if i == 0 and self.byte_ids else [self.own[i]]
            out.append(ids)
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Token ids of each text, and whether the sentencepiece library agrees."""
        if self.split is None:
            ids = self.unigram(texts) if self.model.kind == UNIGRAM else [e.ids if t else [] for e, t in zip(self.backend.encode_batch_fast(texts, add_special_tokens=False), texts)]
            return [np.array(x, dtype=np.int32).tobytes() for x in ids], [a == b for a, b in zip(ids, self.other.encode(texts))]
        if len(self.known) > WORDS:
            self.known.clear()
            self.odd.clear()
        split = [self.words(t) for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        self.learn(list({w for words, got in zip(split, found) for w, x in zip(words, got) if x is None}))
        ids = [b"".join([self.known[w] if x is None else x for w, x in zip(words, got)]) for words, got in zip(split, found)]
        return ids, [not self.odd or self.odd.isdisjoint(words) for words in split]

    def decode(self, ids: list[int]) -> str:
        parts = [self.bytes[i] for i in ids]
        if self.model.squeeze:  # no space comes first, but for that of an unknown piece
            for k, i in enumerate(ids):
                if i == self.model.unknown:
                    break
                parts[k] = parts[k].lstrip(b" ")
                if parts[k]:
                    break
        elif self.model.dummy_prefix and ids and ids[0] != self.model.unknown:
            parts[0] = parts[0].removeprefix(b" ")
        return b"".join(parts).decode("utf-8", "replace")

    def returns(self, text: str, ids: list[int]) -> bool:
        if self.plain:
            return self.decode(ids) == text.replace(MARK, " ")
        wanted = self.normal.normalize_str(text).replace(MARK, " ") if text else ""
        return self.decode(ids) == (wanted.lstrip(" ") if self.model.squeeze else wanted.removeprefix(" ") if self.model.dummy_prefix else wanted)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids, n_tokens, parity, round_trip. The driver reads model_file; executors get its bytes."""
    with open(model_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        coder = Coder(raw.value)
        for batch in batches:
            texts = batch["_text"].to_pylist()
            start = size = 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= BATCH_BYTES or k == len(texts) - 1:
                    yield _coded(coder, batch["_id"][start : k + 1], texts[start : k + 1])
                    start, size = k + 1, 0

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(coded, f"_id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, n_tokens long, parity boolean, round_trip boolean")
    return out.withColumnRenamed("_id", id_col)


def _coded(coder: Coder, row_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    there = [k for k, t in enumerate(texts) if t is not None]
    ids, same = coder.encode([texts[k] for k in there])
    n = np.zeros(len(texts), dtype=np.int64)
    n[there] = [len(x) // 4 for x in ids]
    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    flat = np.frombuffer(b"".join(ids), dtype=np.int32)
    null = np.ones(len(texts), dtype=bool)
    null[there] = False
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
    parity, trip = np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool)
    parity[there], trip[there] = same, [coder.returns(texts[k], np.frombuffer(x, dtype=np.int32).tolist()) for k, x in zip(there, ids)]
    flags = [pa.array(x, mask=null) for x in (parity, trip)]
    return pa.RecordBatch.from_arrays([row_ids, lists, pa.array(n), *flags], names=["_id", "ids", "n_tokens", "parity", "round_trip"])
