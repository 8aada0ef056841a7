"""Benchmark decontamination by greedy string tiling.

A test item and a document are compared by covering the item with tiles: the longest run of words both have, then the
longest run of what is left, and so on down to ``seed`` words. Tiles may lie anywhere in the document, so passages that
were cut up and reordered are found. Items covered to at least ``coverage`` are leaks.

Every tile holds a seed (``seed`` words) that both sides share, so only documents with shared seeds are looked at:

1. A bit table of fixed size, built from the seeds of all items, is broadcast. Each document keeps the stretches of words
   whose seeds are in the table; nearly all documents keep none. Texts are not moved.
2. Stretches' seeds are joined with the items' seeds. Counts per pair leave those with seeds enough to reach the coverage.
3. The pairs left are tiled, each in its own row, on word hashes.

Items of fewer than ``seed`` words hold no seed. They are matched as one whole run of words, found by a bit table of their
own and joined by their hash.

Identical items are compared once, as one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.arrays import STEP_VALUES, Words, chunks, grams, lists, mix, per_doc, words
from crowdtide.llm.registry import register, table
from crowdtide.sources.storage import settle

#: Size of the bit table: 2 MB whatever the benchmark.
TABLE_BITS = 24
_SHIFT = np.uint64(64 - TABLE_BITS)


# --- tiling -------------------------------------------------------------------


_BASE = 0x9E3779B97F4A7C15


def _windows(keys: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hash and start of every window of ``n`` unmarked words."""
    m = len(keys) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    one = np.ones(1, np.uint64)
    power, inverse = (np.multiply.accumulate(np.concatenate((one, np.full(len(keys), b, np.uint64)))) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    total = np.concatenate((one - one, np.cumsum(keys * power[:-1])))
    used = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(used[n:] == used[:m])
    return (total[at + n] - total[at]) * inverse[at], at


def _longest(item: np.ndarray, free_i: np.ndarray, doc: np.ndarray, free_d: np.ndarray, least: int, most: int) -> int:
    """Length of the longest unmarked match of ``least`` to ``most`` words, 0 if none. A match holds all shorter ones."""

    def shared(n: int) -> bool:
        return bool(np.isin(_windows(item, free_i, n)[0], _windows(doc, free_d, n)[0]).any())

    if most < least or not shared(least):
        return 0
    low, high = least, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if shared(mid) else (low, mid - 1)
    return low


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[int, int]:
    """Words of the item that tiles of at least ``least`` words cover, and the number of tiles.

    Ties go to the earliest place in the item, then in the document.
    """
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    covered = tiles = 0
    most = min(len(item), len(doc))
    while n := _longest(item, free_i, doc, free_d, least, most):
        (a, at_a), (b, at_b) = _windows(item, free_i, n), _windows(doc, free_d, n)
        hit = np.isin(b, a)
        places: dict[int, list[int]] = {}
        for h, p in zip(b[hit][::-1].tolist(), at_b[hit][::-1].tolist(), strict=True):
            places.setdefault(h, []).append(p)
        for h, i in zip(a.tolist(), at_a.tolist(), strict=True):
            queue = places.get(h, [])
            while queue and free_i[i : i + n].all():
                p = queue.pop()
                if free_d[p : p + n].all():
                    free_i[i : i + n] = free_d[p : p + n] = False
                    covered, tiles = covered + n, tiles + 1
        most = n - 1  # nothing of this length is left
    return covered, tiles


# --- jobs ---------------------------------------------------------------------


def _item_words(items: DataFrame, seed: int) -> DataFrame:
    """(item, words, seeds): word hashes of every distinct item of at least ``seed`` words; item: the least id of its class."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                w = words(data, offsets)
                g, at = grams(w, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item"), lists(w.key.view(np.int64), per_doc(w.doc, part.num_rows), pa.int64()), lists(g.view(np.int64), per_doc(w.doc[at], part.num_rows), pa.int64())],
                    ["item", "words", "seeds"],
                )

    coded = items.mapInArrow(encode, "item long, words array<long>, seeds array<long>").where(F.size("seeds") > 0)
    return coded.groupBy("words").agg(F.min("item").alias("item"), F.first("seeds").alias("seeds"))


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """Bit per leading ``TABLE_BITS`` bits of a seed: at most ``2**(TABLE_BITS-6)`` words leave the cluster."""
    place = F.shiftrightunsigned("seed", 64 - TABLE_BITS)
    rows = seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - TABLE_BITS}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _in_table(seeds: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = seeds >> _SHIFT
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _short_items(items: DataFrame, seed: int) -> DataFrame:
    """(item, n, run): length and hash of every distinct item of 1 to ``seed`` - 1 words; item: the least id of its class."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                w = words(data, offsets)
                sizes = np.diff(per_doc(w.doc, part.num_rows))
                for n in np.unique(sizes[(sizes > 0) & (sizes < seed)]).tolist():
                    g, at = grams(w, n)
                    own = sizes[w.doc[at]] == n
                    ids = part.column("item").take(pa.array(w.doc[at[own]]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(own.sum(), n, np.int32)), pa.array(g[own].view(np.int64))], ["item", "n", "run"])

    return items.mapInArrow(encode, "item long, n int, run long").groupBy("n", "run").agg(F.min("item").alias("item"))


def _short_leaks(docs: DataFrame, short: DataFrame) -> DataFrame | None:
    """Pairs of (doc, text) with the items of ``_short_items`` that occur in them whole; None if there are no such items."""
    sizes = sorted(r["n"] for r in short.select("n").distinct().collect())
    if not sizes:
        return None
    table_bits = docs.sparkSession.sparkContext.broadcast(_bit_table(short.select(F.col("run").alias("seed")).distinct()))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                w = words(data, offsets)
                for n in sizes:
                    g, at = grams(w, n)
                    hit = _in_table(g, table_bits.value)
                    found = np.unique(np.stack([w.doc[at[hit]].astype(np.int64), g[hit].view(np.int64)], axis=1), axis=0)
                    if len(found):
                        ids = part.column("doc").take(pa.array(found[:, 0]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(found), n, np.int32)), pa.array(found[:, 1])], ["doc", "n", "run"])

    size = F.col("n").cast("long")
    pairs = docs.mapInArrow(runs, "doc long, n int, run long").join(short, ["n", "run"]).select("doc", "item", "n").distinct()
    return pairs.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), size.alias("item_words"), size.alias("covered_words"), F.lit(1).cast("long").alias("tiles"), F.lit(1.0).alias("coverage")
    )


def leaks(docs: DataFrame, items: DataFrame, seed: int = 5, coverage: float = 0.5) -> DataFrame:
    """One row per leaking pair: doc_id, item_id, item_words, covered_words, tiles, coverage.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded. Null and empty texts match
    nothing; items of fewer than ``seed`` words match as a whole only. Identical items are reported under their least item_id; rows without an
    id are left out; rows that repeat a doc_id are one document whose stretches are taken together. Texts count whole.
    """
    spark = docs.sparkSession
    named = items.select(F.col("item_id").cast("long").alias("item"), "text").where("item IS NOT NULL")
    coded = settle(_item_words(named, seed), "items")
    seeds = coded.select("item", F.size("words").alias("n"), F.explode(F.array_distinct("seeds")).alias("seed"))
    table_bits = spark.sparkContext.broadcast(_bit_table(seeds.select("seed").distinct()))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table_bits.value
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                w = words(data, offsets)
                g, at = grams(w, seed)
                hit = np.flatnonzero(_in_table(g, bits))
                if not len(hit):
                    continue
                first = at[hit]
                inside = np.zeros(len(w.key) + 1, np.int32)
                np.add.at(inside, first, 1)
                np.add.at(inside, first + seed, -1)
                kept = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                # a word of its own between stretches, so that no tile crosses a gap
                gap = np.flatnonzero(np.diff(kept) > 1) + 1
                keys = np.insert(w.key[kept], gap, mix(kept[gap].astype(np.uint64) + STEP_VALUES[63]))
                owner = np.insert(w.doc[kept], gap, w.doc[kept[gap - 1]])
                have = np.unique(owner)
                doc_words = lists(keys.view(np.int64), np.append(np.searchsorted(owner, have), len(owner)), pa.int64())
                seed_doc = w.doc[first]
                doc_seeds = lists(g[hit].view(np.int64), np.append(np.searchsorted(seed_doc, have), len(seed_doc)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(have)), doc_words, doc_seeds], ["doc", "words", "seeds"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc IS NOT NULL")
    found = settle(rows.mapInArrow(stretches, "doc long, words array<long>, seeds array<long>"), "stretches")
    per_seed = found.select("doc", F.explode(F.array_distinct("seeds")).alias("seed"))
    enough = F.col("shared") * seed >= F.ceil(F.col("n") * F.lit(coverage) - 1e-9)
    spread = coded.select("item", F.explode("seeds").alias("seed")).groupBy("item", "seed").count().withColumnRenamed("count", "times")
    sizes = coded.select("item", F.size("words").alias("n"))
    pairs = per_seed.join(spread, "seed").groupBy("doc", "item").agg(F.sum("times").alias("shared")).join(sizes, "item").where(enough).select("doc", "item")
    ready = pairs.join(found.select("doc", F.col("words").alias("doc_words")), "doc").join(coded.select("item", F.col("words").alias("item_words")), "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, covered, tiles = [], [], []
            for d, i in zip(batch.column("doc_words"), batch.column("item_words"), strict=True):
                item = i.values.to_numpy().view(np.uint64)
                c, t = tile(item, d.values.to_numpy().view(np.uint64), seed)
                n.append(len(item))
                covered.append(c)
                tiles.append(t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("item"), pa.array(n, pa.int64()), pa.array(covered, pa.int64()), pa.array(tiles, pa.int64())],
                ["doc_id", "item_id", "item_words", "covered_words", "tiles"],
            )

    tiled = ready.select("doc", "item", "doc_words", "item_words").mapInArrow(compare, "doc_id long, item_id long, item_words long, covered_words long, tiles long")
    best = tiled.groupBy("doc_id", "item_id").agg(F.max(F.struct("covered_words", "tiles", "item_words")).alias("m"))
    share = F.col("m.covered_words") / F.col("m.item_words")
    out = best.where(share >= coverage - 1e-9).select("doc_id", "item_id", "m.item_words", "m.covered_words", "m.tiles", share.alias("coverage"))
    more = _short_leaks(rows, settle(_short_items(named, seed), "short"))
    return out if more is None else out.unionByName(more)


@register("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
