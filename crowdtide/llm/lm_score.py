"""Language-model scores of texts: a byte model by logistic context mixing, and a word-count base.

Every task learns a mixing model over its share of the training texts. Counts add up over tasks, weights are averaged by
use, and the sum, a table of fixed size, is broadcast to score all texts.

The base needs the count of every training word, which grows with the corpus: the counts stay a stored table. The
``frequent`` most frequent short words are broadcast; only the other words of a text, a small share, are joined with the
table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.arrays import LOWER, SOLID, chunks
from crowdtide.llm.mixing import BLOCK, N_CELLS, PIECE, Block, Memo, Model
from crowdtide.llm.registry import register, table
from crowdtide.llm.toxicity import fold
from crowdtide.sources.storage import settle

#: Bytes of text whose words a task counts before it hands them on, and the longest word that is broadcast.
COUNTED, LONGEST = 1 << 22, 32
#: Cells of a model that are added up together; places in a range fit 16 bits.
RANGE = 1 << 16
#: The memo of this worker, kept from task to task.
_MEMO: dict[str, Memo] = {}


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on: small numbers leave planes of zeros, which shuffles compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def train(docs: DataFrame) -> Model:
    """The model of all texts of ``docs``.

    A task hands on its cells in ranges of ``RANGE``, those that are not zero only. Each range is added up by one task
    that holds one dense range at a time, so memory does not depend on the number of tasks that learned.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model().learn_all((data, offsets) for batch in batches for _, data, offsets in chunks(batch, "text", PIECE))
        if not model.used.any():
            return
        cells = model.cells()
        for part, start in enumerate(range(0, N_CELLS, RANGE)):
            own = cells[start : start + RANGE]
            live = np.flatnonzero(own.any(axis=1))
            if len(live):
                steps = np.diff(live, prepend=0).astype(np.uint16)
                row = (_planes(steps), _planes(own[live].astype(np.float32).reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], ["part", "place", "value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["part", "total"])

        now, total = None, np.zeros((RANGE, 2))
        for batch in batches:
            for part, place, value in zip(*(batch.column(c) for c in ("part", "place", "value")), strict=True):
                if part.as_py() != now:
                    if now is not None:
                        yield out()
                    now, total = part.as_py(), np.zeros((RANGE, 2))
                at = np.cumsum(_from_planes(place.as_py(), np.uint16), dtype=np.int64)
                total[at] += _from_planes(value.as_py(), np.float32).reshape(-1, 2)
        if now is not None:
            yield out()

    learned = docs.select("text").mapInArrow(learn, "part int, place binary, value binary")
    ranges = (N_CELLS + RANGE - 1) // RANGE
    sums = learned.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(add, "part int, total binary").collect()
    cells = np.zeros((ranges * RANGE, 2), np.float32)
    for r in sums:
        cells[r["part"] * RANGE : (r["part"] + 1) * RANGE] = np.frombuffer(r["total"], np.float32).reshape(-1, 2)
    return Model.of(cells[:N_CELLS])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, A-Z folded, with an empty token at the end of each text; and the index of each token's text."""
    solid = SOLID.take(data)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = solid[cuts]
    begins = np.flatnonzero(begins)
    before = np.zeros(len(data) + 1, np.int32)  # solid bytes before each place
    np.cumsum(solid, out=before[1:])
    after = np.searchsorted(begins, offsets[1:])  # words up to the end of each text
    starts = np.insert(before[begins], after, before[offsets[1:]])
    doc = np.repeat(np.arange(len(after)), np.diff(after, prepend=0) + 1)
    buffers = [None, pa.py_buffer(np.append(starts, before[-1:])), pa.py_buffer(LOWER.take(data[solid]))]
    return pa.Array.from_buffers(pa.string(), len(starts), buffers), doc


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n): how often each word of the texts occurs, A-Z folded; the empty token is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in chunks(batch, "text", COUNTED):
                token, n = tokens(data, offsets)[0].value_counts().flatten()
                yield pa.RecordBatch.from_arrays([token, n], ["token", "n"])

    return docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def score_texts(docs: DataFrame, parts: int = 7, held: int = 2, frequent: int = 1 << 16) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte.

    Learns from documents whose fold is not ``held``. score: log10 probability of the text's UTF-8 bytes and its end under
    the byte model; bits_per_byte is the same in bits, over bytes and end. base_score: sum of log10((c+1)/(N+V+1)) over words and end. Null and empty texts are an end alone.
    Texts count whole; repeated rows are scored alike and learned from each time; null ids count as empty text for the
    fold; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (fold("doc_id", parts) == held).alias("held_out"), "text")
    known = rows.where(~F.col("held_out"))
    vocabulary = settle(word_counts(known), "vocabulary")
    size = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, divisor = size["n"], size["n"] + size["v"] + 1
    top = vocabulary.where(F.octet_length("token") <= LONGEST).orderBy(F.desc("n"), "token").limit(frequent).toArrow()
    terms = np.log10((top.column("n").to_numpy() + 1) / divisor)
    frequent_words = top.column("token").to_pylist()
    shared, name = spark.sparkContext.broadcast((train(known), frequent_words, terms)), uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _MEMO:
            _MEMO.clear()  # before another model is loaded
        model, words, terms = shared.value
        memo = _MEMO.setdefault(name, Memo(model))
        words, terms = pa.array(words, pa.string()), np.append(terms, 0.0)
        for batch in batches:
            for part, data, offsets in chunks(batch, "text", BLOCK):
                token, doc = tokens(data, offsets)
                at = pc.fill_null(pc.index_in(token, words), len(words)).to_numpy()
                rare = at == len(words)
                count = lambda weights=None, doc=doc, n=part.num_rows: np.bincount(doc, weights, minlength=n)
                n_rare = count(rare).astype(np.int64)
                block = Block(data, offsets)
                total = np.bincount(block.doc, memo.log10(block)[block.which], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("row", "doc_id", "held_out")), pa.array(count(), pa.int64()), pa.array(count() - n_rare, pa.int64()),
                        pa.array(count(terms.take(at))), pa.array(total), pa.array(-total / math.log10(2) / (np.diff(offsets) + 1)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)).astype(np.int32)), token.filter(pa.array(rare))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "bits_per_byte", "rare"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, bits_per_byte double, rare array<string>"
    scored = settle(rows.mapInArrow(score, schema), "scored")
    rest = scored.select("row", F.explode("rare").alias("token")).groupBy("token", "row").agg(F.count("*").alias("times"))
    found = F.coalesce("n", F.lit(0))
    added = (
        rest.join(vocabulary, "token", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10((found + 1) / F.lit(float(divisor)))).alias("more"), F.sum(F.when(found > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    return scored.drop("rare").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )


@register("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents", "doc_id", "text"))
