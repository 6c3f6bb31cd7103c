"""SentencePiece encoding and decoding (op 8) with an Aho-Corasick automaton over the pieces.

One pass over a text relaxes the best segmentation at each position: the automaton's output links give all pieces that
end there. For a unigram model the best is the highest sum of scores. A BPE model's scores are merge priorities whose
sums mean nothing, so there a piece extends the prefix before it only if merging would not join the two otherwise:
exactly one piece qualifies at each position, and the result equals the merge procedure's. (The question "would
merging the last piece and this one give just these two?" is answered once a pair and remembered.)

No piece of the model runs past the end of a word (checked on loading; otherwise texts aren't cut), so words are
encoded on their own and remembered. Tables of what is remembered have two generations: when the newer is full it
replaces the older, and what is still in use moves on, so memory is bounded and results don't depend on it. The model is read on the driver and shipped to the executors; its size is fixed.

Characters outside the vocabulary become bytes (or the unknown piece in models without bytes). Decoding inverts this;
``exact`` tells whether it gave the very text. It doesn't where the text itself holds U+2581, which the format uses for
spaces, or characters that a model without bytes lacks.

Defined results: null and empty text have no pieces and are exact; repeated rows give a row each; an empty table gives
an empty result; extra columns are ignored, whatever their names. Whole texts are encoded.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words, and pairs of pieces, that a generation of the tables holds; there are two generations of each.
CACHE = 500_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: (number, value)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = (8, i) if kind == 1 else (4, i) if kind == 5 else varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces with scores and types, and how text is prepared."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    dummy_prefix: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        squeeze, charsmap = True, b""
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                m.pieces.append(x[1].decode())
                m.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                m.types.append(x.get(3, NORMAL))
            elif number == 2:
                m.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(_fields(value))
                m.dummy_prefix, squeeze, charsmap = bool(x.get(3, 1)), bool(x.get(4, 1)), x.get(2, b"")
        if squeeze or charsmap:
            raise ValueError("only models that leave their text as it is can be decoded exactly")
        return m


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        usable = [(p, i) for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t in (NORMAL, USER)]
        self.ids = dict(usable)
        self.automaton = ahocorasick.Automaton()
        for p, i in usable:
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.chars = {c for p, _ in usable for c in p}
        self.single = {p for p, _ in usable if len(p) == 1}
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in usable)
        lines = "" if "\n" in self.chars else "\n"
        self.words = re.compile(f"{SPACE}*[^{SPACE}{lines}]+|{SPACE}+" + ("|\n+" if lines else "")) if cut else re.compile(".+", re.S)
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_before: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.pairs_before: dict[int, bool] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t in (CONTROL, UNUSED) else (" ⁇ " if t == UNKNOWN else p.replace(SPACE, " ")).encode() for p, t in zip(model.pieces, model.types, strict=True)]

    def merge(self, text: str) -> list[int]:
        """BPE by its definition, for a short text of known characters: join the best neighbours, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.model.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def _pair(self, key: int, made: Callable[[], bool]) -> bool:
        out = self.pairs.get(key)
        if out is None:
            out = self.pairs_before.get(key)
            if out is None:
                out = made()
            if len(self.pairs) >= CACHE:
                self.pairs_before, self.pairs = self.pairs, {}
            self.pairs[key] = out
        return out

    def stands(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two pieces apart."""
        return self._pair(left << 32 | right, lambda: self.merge(self.model.pieces[left] + self.model.pieces[right]) == [left, right])

    def stands_alone(self, i: int) -> bool:
        """Whether merging the piece's own text gives the piece (a few pieces can't be reached)."""
        return self._pair(-1 - i, lambda: self.merge(self.model.pieces[i]) == [i])

    def _lost(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    def _known_run(self, text: str) -> list[int]:
        """The segmentation of a text whose characters all are pieces."""
        n = len(text)
        last = [-1] * (n + 1)
        start = [0] * (n + 1)
        if self.model.kind == BPE:
            for end, (size, i) in self.automaton.iter(text):
                at = end + 1
                if last[at] < 0:
                    before = at - size
                    if (before == 0 and self.stands_alone(i)) or (before and last[before] >= 0 and self.stands(last[before], i)):
                        last[at], start[at] = i, before
        else:
            best = [0.0] + [float("-inf")] * n
            score = self.model.scores
            for end, (size, i) in self.automaton.iter(text):
                at, before = end + 1, end + 1 - size
                x = best[before] + score[i]
                if x > best[at]:
                    best[at], last[at], start[at] = x, i, before
        out = []
        while n:
            out.append(last[n])
            n = start[n]
        return out[::-1]

    def word(self, text: str) -> tuple[int, ...]:
        if all(map(self.single.__contains__, text)):
            return tuple(self._known_run(text))
        out: list[int] = []
        run = ""
        for c in text:
            if c in self.single:
                run += c
            else:
                out += self._known_run(run) if run else []
                out += self._lost(c)
                run = ""
        return tuple(out + (self._known_run(run) if run else []))

    def rest(self) -> None:
        """Between tasks a worker holds the newer generations only."""
        self.known_before, self.pairs_before = {}, {}

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        known = self.known
        for w in self.words.findall(text):
            ids = known.get(w)
            if ids is None:
                ids = self.known_before.get(w) or self.word(w)
                if len(w) <= 32:
                    if len(known) >= CACHE:
                        self.known_before, known = known, {}
                        self.known = known
                    known[w] = ids
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@cache
def _encoder(data: bytes) -> Encoder:
    return Encoder(Model.parse(data))


OUT = "doc_id long, n_tokens long, token_ids array<int>, exact boolean"
PART = 1 << 20


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """One row per document: its piece ids, their number, and whether decoding them gives the text."""
    with open(model_file or default_model(), "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data)

        def out() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), lists, pa.array(exact, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "exact"])

        for batch in batches:
            ids, counts, exact, flat = [], [], [], array("i")
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                t = t.as_py() or ""
                pieces = enc.encode(t)
                ids.append(d.as_py())
                counts.append(len(pieces))
                exact.append(enc.decode(pieces) == t)
                flat.extend(pieces)
                if len(flat) >= PART:
                    yield out()
                    ids, counts, exact, flat = [], [], [], array("i")
            yield out()
        enc.rest()

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(run, OUT)


def decode(encoded: DataFrame, ids: str = "token_ids", model_file: str | None = None) -> DataFrame:
    """``encoded`` with its texts, from the ids alone, as column ``text``."""
    with open(model_file or default_model(), "rb") as f:
        data = f.read()
    rest = [c for c in encoded.columns if c not in ("text", ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data)
        for batch in batches:
            texts = [enc.decode(x.as_py() or ()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*rest, "text"])

    kept = encoded.select(*[F.col(f"`{c}`") for c in rest])
    return encoded.select(F.col(ids), *[F.col(f"`{c}`") for c in rest]).mapInArrow(run, kept.withColumn("text", F.lit("")).schema)
