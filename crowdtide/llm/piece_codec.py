"""Encoding and decoding with a merge-type piece model, by a table of each prefix's last token.

Such a model starts from single characters and merges neighbours whose joined text is a piece, best score first and
leftmost among equals. Two facts make one pass enough. A sequence of pieces is the encoding of its text exactly if every
two neighbours are compatible, that is, if their joined text alone is encoded as those two. And each prefix of a text
has one encoding, so one last token. For every place the matches of an automaton over all pieces are tried; the one whose
start is a prefix with a compatible last token is that prefix's last token. Ids are then read backwards.

Compatibility is tested by taking both pieces apart, latest merge first, and looking for a merge across the border that
would have come earlier. Pieces of white space that all share one score are the exception, see ``Model``.

A text is cut where no piece of two or more characters reaches across, so frequent stretches are encoded once per
worker. The table of pieces is broadcast; its size is the model's. Texts stay in the task that holds their row.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import groupby
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from crowdtide.llm.arrays import chunks
from crowdtide.llm.registry import register, table

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES, BYTE_FALLBACK = 2, 35
#: Stretches a worker remembers in each of two generations, tested pairs it remembers, and the longest stretch it does.
STRETCHES, PAIRS, LONGEST = 1 << 19, 1 << 19, 64


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a message in the model file: numbers, floats and byte strings."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        elif kind == 2:
            size = number()
            at += size
            yield tag >> 3, data[at - size : at]
        else:
            size = 4 if kind == 5 else 8
            at += size
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at - size : at])[0]


class Model(NamedTuple):
    """What encoding and decoding need, numbered by order of merging: single characters, then pieces from the best score.

    Pieces that equal scores would leave unordered are allowed in one case: runs of ``SPACE``, all of the lowest score.
    Which two of them are compatible is found by merging them outright.
    """

    text: list[str]  # by rank
    ids: list[int]  # by rank
    first: list[int]  # parts of the last merge; a character is its own part
    second: list[int]
    spaces: frozenset[int]  # runs of SPACE with equal scores
    space_pairs: frozenset[tuple[int, int]]  # compatible ones
    byte_ids: list[int]
    end: int
    surface: list[bytes]  # by id: bytes that a token stands for
    control: list[bool]
    unknown: int
    prefix: bool  # a space is put before the text


def merge(parts: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge neighbours, best score first and leftmost among equals: what is left, and the last two that were merged."""
    parts, last = list(parts), None
    while options := [(score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]:
        i = -max(options)[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


def read_model(data: bytes) -> Model:
    pieces: list[tuple[str, float, int]] = []
    trainer: dict[int, object] = {}
    normalizer: dict[int, object] = {3: 1, 4: 1, 5: 1}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer.update(_fields(value))
    if trainer.get(3) != MERGES or not trainer.get(BYTE_FALLBACK) or trainer.get(24):
        raise ValueError("only merge models with byte fallback and leading spaces are supported")
    if normalizer.get(2) or normalizer[4] or not normalizer[5]:
        raise ValueError("only models that leave texts as they are, with spaces escaped, are supported")
    kinds = {k for _, _, k in pieces}
    if not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("models with user-defined or unused pieces are not supported")

    score = {t: s for t, s, k in pieces if k == NORMAL}
    number = {t: i for i, (t, _, k) in enumerate(pieces) if k == NORMAL}
    merged = [t for t in score if len(t) > 1]
    spaces = sorted((t for t in merged if not t.strip(SPACE)), key=len)
    if len({score[t] for t in spaces}) == len(spaces):
        spaces = []
    others = sorted(set(merged) - set(spaces), key=lambda t: -score[t])
    if len({score[t] for t in others}) < len(others) or (spaces and min(score[t] for t in others) <= max(score[t] for t in spaces)):
        raise ValueError("equal scores are supported only for runs of spaces, below all other scores")
    text = [t for t in score if len(t) == 1]
    rank = {t: i for i, t in enumerate(text)}
    first, second = list(range(len(text))), list(range(len(text)))
    for t in others + spaces:
        whole, parts = merge(list(t), score)
        if len(whole) > 1:
            continue  # no merging ends with this piece
        if parts[0] not in rank or parts[1] not in rank:
            raise ValueError("a piece is made of pieces that come later")
        rank[t] = len(text)
        first.append(rank[parts[0]])
        second.append(rank[parts[1]])
        text.append(t)
    runs = [t for t in [SPACE, *spaces] if t in rank] if spaces else []
    pairs = frozenset((rank[a], rank[b]) for a in runs for b in runs if merge(list(a + b), score)[0] == [a, b])
    byte_ids = [0] * 256
    surface = []
    for i, (t, _, k) in enumerate(pieces):
        if k == BYTE:
            byte_ids[int(t[1:-1], 16)] = i
        surface.append(bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else t.replace(SPACE, " ").encode())
    unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), -1)
    if unknown >= 0:
        surface[unknown] = trainer.get(44, " ⁇ ".encode())
    end = next((i for i, (t, _, k) in enumerate(pieces) if k == CONTROL and t == "</s>"), -1)
    control = [k == CONTROL for _, _, k in pieces]
    spaced = frozenset(rank[t] for t in runs)
    return Model(text, [number[t] for t in text], first, second, spaced, pairs, byte_ids, end, surface, control, unknown, bool(normalizer[3]))


class Encoder(dict):
    """Ids of stretches as bytes of 32-bit numbers; one that is not known is encoded and kept.

    When there is no room, what is known becomes the older generation, and the older one goes. Stretches met again come
    back from there, so frequent ones stay.
    """

    def __init__(self, model: Model):
        import ahocorasick

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for rank, text in enumerate(model.text):
            self.automaton.add_word(text, rank)
        self.automaton.make_automaton()
        self.size = len(model.text)
        self.merges = {a * self.size + b: c for c, (a, b) in enumerate(zip(model.first, model.second)) if a != c}
        self.lengths = list(map(len, model.text))
        self.pairs: dict[int, bool] = {}
        self.met = {pair for t in model.text for pair in map(add, t, t[1:])}
        self.cuts = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Stretches: spaces with what follows them; line ends and marks after letters apart if no merge takes them."""
        inner = {c for t in self.model.text if len(t) > 1 for c in t}
        if any(SPACE in t.lstrip(SPACE) for t in self.model.text):
            return re.compile("(?s).+")
        alone = "".join(c for c in "\n\t\r" if c not in inner)
        letter = re.compile("[^\\W\\d_]")
        taken = {pair[1] for pair in self.met if letter.match(pair)}
        marks = "".join(c for c in ".,;:!?" if c not in taken)
        word = f"{SPACE}*[^\\W\\d_]++(?![^{SPACE}{alone}{marks}])|" if marks else ""
        return re.compile(f"{word}{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            parts = self.parts(stretch)
            ids = b"".join(map(self.__getitem__, parts)) if len(parts) > 1 else array("i", self.encode_stretch(stretch)).tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= STRETCHES:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids

    def parts(self, stretch: str) -> list[str]:
        """A stretch cut between characters that are neighbours in no piece."""
        met, first, found = self.met, 0, []
        for i, pair in enumerate(map(add, stretch, stretch[1:]), 1):
            if pair not in met:
                found.append(stretch[first:i])
                first = i
        found.append(stretch[first:])
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joined text of two pieces is encoded as just these two; remembered in ``pairs``."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fits = self.pairs[a * self.size + b] = self._compatible(a, b)
        return fits

    def _compatible(self, a: int, b: int) -> bool:
        if a in self.model.spaces and b in self.model.spaces:
            return (a, b) in self.model.space_pairs
        merges, first, second, size = self.merges, self.model.first, self.model.second, self.size
        limit = size
        while True:
            across = merges.get(a * size + b)
            if across is not None and across < limit:
                return False
            # undo the later of the two merges; of equal ones the right one came later
            if a > b and second[a] != a:
                limit, a = a, second[a]
            elif first[b] != b:
                limit, b = b + 1, first[b]
            elif second[a] != a:
                limit, a = a, second[a]
            else:
                return True

    def encode_stretch(self, s: str) -> list[int]:
        """Ids of a text that nothing outside can merge with."""
        last = [-1] * (len(s) + 1)
        lengths, size, known, compatible = self.lengths, self.size, self.pairs.get, self.compatible
        for at, rank in self.automaton.iter(s):
            if last[at + 1] < 0:
                before = last[at + 1 - lengths[rank]]
                # no piece ends at a character that the model does not know, nor at the start
                if before < 0:
                    last[at + 1] = rank
                    continue
                fits = known(before * size + rank)
                if fits is None:
                    fits = compatible(before, rank)
                if fits:
                    last[at + 1] = rank
        ids, at = [], len(s)
        while at:
            rank = last[at]
            if rank >= 0:
                ids.append(self.model.ids[rank])
                at -= lengths[rank]
            else:
                at -= 1
                ids.extend(self.model.byte_ids[b] for b in reversed(s[at].encode()))
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text, without the end, as bytes of 32-bit numbers."""
        if not text:
            return b""
        text = text.replace(" ", SPACE)
        return b"".join(map(self.__getitem__, self.cuts.findall(SPACE + text if self.model.prefix else text)))


def _byte_by_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("piece_codec", _byte_by_byte)


def decode_ids(model: Model, ids: list[int]) -> str:
    """Text of a list of ids; control tokens are silent, broken byte sequences become one U+FFFD for each byte."""
    parts = [b""]
    for silent, some in groupby(ids, model.control.__getitem__):
        if not silent:
            parts.append(b"".join(map(model.surface.__getitem__, some)))
    if model.prefix:
        visible = next((i for i in ids if not model.control[i]), model.unknown)
        if visible != model.unknown and model.surface[visible][:1] == b" " and visible not in model.byte_ids:
            parts[1] = parts[1][1:]
    # bytes on both sides of a control token make no character together
    return "".join(part.decode("utf-8", "piece_codec") for part in parts)


_WORKER: dict[int, Encoder] = {}


def _load(spark: SparkSession, model_path: str | None) -> Model:
    with open(model_path or piece_bpe_path(), "rb") as f:
        return read_model(f.read())


def encode(docs: DataFrame, model_path: str | None = None, end: bool = True, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns but the text, and ``ids``: the tokens of the whole text, with an end token if asked for.

    Null and empty texts have no tokens but the end. Rows are handled one by one, so repeated rows and null keys stay as
    they are; an empty table gives an empty result. A column of the name of ``ids`` is replaced.
    """
    spark = docs.sparkSession
    model = _load(spark, model_path)
    shared = spark.sparkContext.broadcast(model)
    tail = np.array([model.end], np.int32).tobytes() if end else b""
    keep = [c for c in docs.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _WORKER:
            _WORKER.clear()
            _WORKER[id(model)] = Encoder(model)
        encoder = _WORKER[id(model)]
        for batch in batches:
            for part, _, _ in chunks(batch, text):
                rows = [encoder.encode(value.as_py() or "") + tail for value in part.column(text)]
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) // 4 for r in rows], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(offsets), values)], [*keep, ids])

    schema = docs.select(*keep).schema.add(ids, ArrayType(IntegerType()))
    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns, and ``text``: what the ids stand for. Null or empty ids give an empty text; unknown numbers fail."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_load(spark, model_path))
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [decode_ids(model, v.values.to_numpy(zero_copy_only=False).tolist() if v.is_valid else []) for v in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.large_string())], [*keep, text])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema.add(text, "string"))


@register("op11_piece_codec")
def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(table(spark, sf_dir, "documents", "doc_id", "text")))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
