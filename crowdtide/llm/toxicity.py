"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one or two words between them, hashed into ``2**BITS`` places.
The learner keeps a rate of its own for each place and an L1 penalty, so most weights stay exactly zero: the model is a
short list of (place, weight), at most ``2**BITS`` of them, that is broadcast to score all documents. Scoring looks at the
non-zero places only.

It learns from a bounded sample: the ``max_rows`` labelled documents with the smallest hash of their id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.arrays import STEP_VALUES, Words, chunks, lists, mix, per_doc, words
from crowdtide.llm.registry import register, table

BITS = 20


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def features(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, place) of every word, pair and skip pair, repeats included."""
    shift = np.uint64(64 - BITS)
    yield w.doc, (mix(w.key) >> shift).astype(np.int64)
    for gap in (1, 2, 3):
        if len(w.key) > gap:
            inside = np.flatnonzero(w.doc[:-gap] == w.doc[gap:])
            pair = w.key[inside] * STEP_VALUES[gap] + w.key[inside + gap] * STEP_VALUES[10 + gap]
            yield w.doc[inside], (mix(pair) >> shift).astype(np.int64)


def distinct_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) in order, each once; only places that ``wanted`` marks."""
    found = []
    for doc, place in features(words(data, offsets)):
        if wanted is not None:
            hit = np.flatnonzero(wanted[place])
            doc, place = doc[hit], place[hit]
        found.append((doc.astype(np.int64) << BITS) | place)
    both = np.sort(np.concatenate(found))
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return both >> BITS, both & ((1 << BITS) - 1)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0, epochs: int = 3) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, places and weights. One example: its distinct places, each of value 1. Order of the examples counts."""
    n_places = 1 << BITS
    z, n = np.zeros(n_places + 1), np.zeros(n_places + 1)
    l1s = np.full(n_places + 1, l1)
    l1s[n_places] = 0  # the bias is not shrunk

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * l1s[at]) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) <= l1s[at], 0.0, w)

    for _ in range(epochs):
        for places, label in zip(examples, labels, strict=True):
            at = np.append(places, n_places)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    live = np.flatnonzero(np.abs(z[:n_places]) > l1)
    w = weights(live)
    return float(weights(np.array([n_places]))[0]), live[w != 0], w[w != 0]


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 12000) -> tuple[float, np.ndarray, np.ndarray]:
    """Weights from at most ``max_rows`` labelled documents, those with the smallest hash of their id.

    Of several labels of an id the highest holds; null labels and ids are left out. Without any example the bias is 0.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                doc, place = distinct_features(data, offsets)
                cuts = per_doc(doc, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("turn"), part.column("toxic"), lists(place.astype(np.int32), cuts, pa.int32())], ["doc_id", "turn", "toxic", "places"])

    def train(group: pa.Table) -> pa.Table:
        group = group.sort_by([("turn", "ascending"), ("doc_id", "ascending")])
        examples = [v.values.to_numpy() for chunk in group.column("places").chunks for v in chunk]
        bias, places, w = ftrl(examples, group.column("toxic").to_numpy().astype(float))
        return pa.table({"place": np.append(places, -1).astype(np.int32), "weight": np.append(w, bias)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = rows.select("doc_id", F.xxhash64("doc_id").alias("turn"), "toxic", "text").mapInArrow(encode, f"doc_id {kind}, turn long, toxic int, places array<int>")
    model = encoded.groupBy(F.lit(1).alias("one")).applyInArrow(train, "place int, weight double").toPandas()
    if not len(model):
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    inside = model["place"] >= 0
    return float(model.loc[~inside, "weight"].iloc[0]), model.loc[inside, "place"].to_numpy(np.int64), model.loc[inside, "weight"].to_numpy()


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, parts: int = 5) -> DataFrame:
    """All columns of ``docs`` with held_out, score in 0..1 and predicted (1 if score >= 0.5).

    Learns from documents whose fold is not 0; only text enters a score. Null and empty texts score as the bias alone.
    Texts count whole whatever their length; repeated rows score alike; without labels every score is 0.5. An empty table
    gives an empty result. Columns of ``docs`` named like the added ones are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    names = docs.columns
    bias, places, weights = learn(docs.where(fold("doc_id", parts) != 0), labels, max_rows)
    model = docs.sparkSession.sparkContext.broadcast((bias, places, weights.astype(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, places, weights = model.value
        wanted, dense = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
        wanted[places], dense[places] = True, weights
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                doc, place = distinct_features(data, offsets, wanted)
                total = bias + np.bincount(doc, dense[place], minlength=part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                found = [part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *found], [*names, "held_out", "score", "predicted"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    held = (fold("doc_id", parts) == 0).alias("held_out")
    return docs.select("*", held).mapInArrow(score, f"{schema}held_out boolean, score double, predicted int")


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return scored(docs, labels).select("doc_id", "held_out", "score", "predicted")
