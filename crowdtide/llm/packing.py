"""Length buckets of least padding, filled with batches of a token budget.

Texts longer than ``max_len`` tokens become pieces of at most ``max_len``; no token is dropped. The global histogram of
piece lengths has ``max_len`` rows at most, so it may come to the driver, where dynamic programming picks the ``buckets``
upper bounds that minimise the padding of all pieces. Each piece is padded to the bound of its bucket, and a bucket's
pieces fill batches of ``budget`` tokens in order.

Places inside a bucket are numbered without sorting it in one task: stored pieces are dealt to a fixed number of slices,
numbered inside their slice, and shifted by the slice's offset, which comes from the small table of slice sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crowdtide.llm.arrays import SOLID, chunks, per_doc, words
from crowdtide.llm.registry import register, table
from crowdtide.sources.storage import settle


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """At most ``buckets`` ascending upper bounds of least total padding, and that padding.

    ``lengths`` ascend. cost[j] is the least padding of the lengths up to j with the buckets so far; the last bucket of
    a best solution starts no earlier for a later j, so each layer is filled by halving the range of starts.
    """
    n = len(lengths)
    if n == 0:
        return [], 0
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(lengths * counts)))

    def padding(start: np.ndarray, end: int) -> np.ndarray:
        """Of lengths start..end in one bucket."""
        return lengths[end] * (rows[end + 1] - rows[start]) - (tokens[end + 1] - tokens[start])

    cost = np.array([int(padding(np.int64(0), j)) for j in range(n)], dtype=np.int64)
    layers = []
    for _ in range(1, min(buckets, n)):
        best, start = cost.copy(), np.zeros(n, np.int64)
        stack = [(1, n - 1, 1, n - 1)]
        while stack:
            low, high, first, last = stack.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            starts = np.arange(first, min(mid, last) + 1)
            start[mid] = first
            if len(starts):
                total = cost[starts - 1] + padding(starts, mid)
                k = int(np.argmin(total))
                start[mid] = starts[k]
                best[mid] = total[k]
            stack += [(low, mid - 1, first, int(start[mid])), (mid + 1, high, int(start[mid]), last)]
        layers.append(start)
        cost = best
    bounds, end = [], n - 1
    for start in reversed(layers):
        bounds.append(int(lengths[end]))
        end = int(start[end]) - 1
        if end < 0:
            break
    if end >= 0:
        bounds.append(int(lengths[end]))
    return sorted(bounds), int(cost[n - 1])


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): words between ASCII white space, plus one end-of-text token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                cuts = per_doc(words(data, offsets, SOLID).doc, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(cuts) + 1)], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_tokens long")


def pack(lengths: DataFrame, buckets: int = 8, max_len: int = 2048, budget: int = 16384, slices: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket (its padded length), batch, place.

    ``lengths``: doc_id, n_tokens. Rows whose n_tokens is null or below 1 have nothing to pack and are left out. Repeated
    rows are packed each for itself, null ids too. Batches are numbered inside their bucket from 0; all but the last of a
    bucket hold as many pieces as the budget allows, at least one. An empty table gives an empty result.
    """
    pieces = lengths.where("n_tokens >= 1").select(
        "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / max_len).cast("int"))).alias("piece")
    )
    first = F.col("piece").cast("long") * max_len
    pieces = pieces.select("doc_id", "piece", first.alias("first_token"), F.least(F.col("n_tokens") - first, F.lit(max_len)).cast("long").alias("n_tokens"))
    pieces = settle(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = pieces.groupBy("n_tokens").count().toPandas().sort_values("n_tokens")
    bounds, _ = best_bounds(histogram["n_tokens"].to_numpy(np.int64), histogram["count"].to_numpy(np.int64), buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b)) for b in bounds]) if bounds else F.lit(0)
    placed = pieces.withColumn("bucket", bucket.cast("long")).withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    inside = Window.partitionBy("bucket", "slice").orderBy("row")
    sizes = placed.groupBy("bucket", "slice").count()
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("own", F.row_number().over(inside) - 1).join(offsets, ["bucket", "slice"])
    index, room = F.col("own") + F.col("offset"), F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    return numbered.select(
        "doc_id", F.col("piece").cast("long").alias("piece"), "first_token", "n_tokens", "bucket",
        F.floor(index / room).cast("long").alias("batch"), F.pmod(index, room).cast("long").alias("place"),
    )


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(word_lengths(table(spark, sf_dir, "documents", "doc_id", "text")))
