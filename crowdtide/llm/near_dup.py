"""Near-duplicate documents by DartMinHash signatures, banded, with exact verification.

1. Every text becomes the weighted set of its five-word shingles and a signature of ``bands`` x ``rows`` darts
   (``darts.signatures``). Copies of a text are represented by the least doc_id.
2. Representatives that agree in a whole band meet in a bucket. Each is compared with the bucket's least member only, so
   a bucket makes as many pairs as it has members; the pairs are verified on the full shingle sets.
3. Verified links give components. Buckets whose members now lie in one component are done, which settles groups of
   copies however large. The others are compared in full, in blocks of ``block`` members inside tasks: pairs of different
   components whose signatures agree well enough are verified there, and only links come out.
4. Links of both kinds give the classes.

Buckets and blocks have bounded groups; a bucket of very many members is cut into pairs of blocks. Shingle sets are made
again from the text for the few documents that share a bucket, rather than stored for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.arrays import STEP_VALUES, Words, chunks, grams, lists, mix, per_doc, words
from crowdtide.llm.components import connected
from crowdtide.llm.darts import signatures
from crowdtide.llm.registry import register, table
from crowdtide.sources.storage import settle


def shingles(w: Words, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every ``size``-word shingle in order of text; a shorter text is one shingle of all its words."""
    key, at = grams(w, size)
    doc = w.doc[at]
    cuts = per_doc(w.doc, n_docs)
    short = np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) < size))
    if len(short):
        whole = np.array([mix(np.sum(w.key[cuts[d] : cuts[d + 1]] * STEP_VALUES[: cuts[d + 1] - cuts[d]], keepdims=True) + np.uint64(1))[0] for d in short], np.uint64)
        key, doc = np.concatenate((key, whole)), np.concatenate((doc, short))
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
    return key, doc


def weighted(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, and how often each occurs."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return key[at], doc[at], np.diff(np.append(at, len(key)))


def _signed(docs: DataFrame, size: int, bands: int, rows: int, counted: bool) -> DataFrame:
    """(doc, words, n, seq_a, seq_b, sig, keys): signature and band keys of every row; seq: 128-bit hash of its words."""
    k = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                n = part.num_rows
                w = words(data, offsets)
                cuts = per_doc(w.doc, n)
                place = np.arange(len(w.key)) - cuts[w.doc]
                seq = []
                for salt in (3, 5):
                    turned = mix(w.key + np.uint64(salt) * STEP_VALUES[salt]) * mix(place.astype(np.uint64) + STEP_VALUES[salt + 1])
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(turned))))
                    seq.append((total[cuts[1:]] - total[cuts[:-1]]).view(np.int64))
                key, doc = shingles(w, n, size)
                if counted:
                    key, doc, weight = weighted(key, doc)
                else:
                    weight = np.ones(len(key))  # a repeated shingle throws the same darts again
                sig = signatures(key, weight.astype(float), per_doc(doc, n), k)
                band = mix((sig.reshape(n, bands, rows) * STEP_VALUES[:rows]).sum(axis=2) + np.arange(bands, dtype=np.uint64) * STEP_VALUES[63])
                short = (sig >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"), pa.array(np.diff(cuts)), pa.array(seq[0]), pa.array(seq[1]), pa.array([s.tobytes() for s in short], pa.binary()),
                        lists(band.reshape(-1).view(np.int64), np.arange(n + 1) * bands, pa.int64()),
                    ],
                    ["doc", "words", "seq_a", "seq_b", "sig", "keys"],
                )

    return docs.mapInArrow(sign, "doc long, words long, seq_a long, seq_b long, sig binary, keys array<long>")


def _sets(docs: DataFrame, size: int, counted: bool) -> DataFrame:
    """(doc, items, times): distinct shingles of every row as ascending 64-bit numbers, and how often each occurs.

    Both are packed arrays; ``times`` is there only if shingles are counted.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                key, doc, times = weighted(*shingles(words(data, offsets), part.num_rows, size))
                cuts = per_doc(doc, part.num_rows)

                def packed(values: np.ndarray) -> pa.Array:
                    return pa.array([values[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())  # noqa: B023

                columns = [part.column("doc"), packed(key)] + ([packed(times.astype(np.uint32))] if counted else [])
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc", "items", "times"] if counted else ["doc", "items"]
    return docs.mapInArrow(encode, "doc long, items binary" + ", times binary" * counted)


def _unpacked(column: pa.Array | pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in column.to_pylist()]


def similarity(a: np.ndarray, b: np.ndarray, a_times: np.ndarray | None = None, b_times: np.ndarray | None = None) -> float:
    """Jaccard similarity of two ascending (uint64) sets, weighted if times are given."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    hit = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, np.int64)
    if a_times is None or b_times is None:
        both, total = len(hit), len(a) + len(b)
    else:
        both, total = int(np.minimum(a_times[hit], b_times[at[hit]]).sum()), int(a_times.sum()) + int(b_times.sum())
    return both / (total - both) if total > both else 0.0


def _verified(pairs: DataFrame, sets: DataFrame, least: float, counted: bool) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    values = ["items", "times"] if counted else ["items"]
    left, right = (sets.select(F.col("doc").alias(side), *[F.col(v).alias(f"{side}_{v}") for v in values]) for side in "ab")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [_unpacked(batch.column(f"{side}_{v}"), kind) for v, kind in zip(values, (np.uint64, np.uint32), strict=False) for side in "ab"]
            keep = [similarity(*row) >= least - 1e-12 for row in zip(*given, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    columns = [f"{side}_{v}" for v in values for side in "ab"]
    return pairs.join(left, "a").join(right, "b").select("a", "b", *columns).mapInArrow(test, "a long, b long")


def _block_links(least: float, counted: bool, agree: int):
    """Links between members of a bucket that no link joins yet, for one pair of blocks."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc")
        n = group.num_rows
        sig = np.stack(_unpacked(group.column("sig"), np.uint32))
        items = _unpacked(group.column("items"), np.uint64)
        times = _unpacked(group.column("times"), np.uint32) if counted else None
        size = np.array([int(t.sum()) for t in times] if counted else [len(v) for v in items])
        own, doc, comp = (group.column(c).to_numpy() for c in ("own", "doc", "comp"))
        within = group.column("low")[0].as_py() == group.column("high")[0].as_py()
        parent = {c: c for c in comp.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        found = []
        for i in range(n):
            j = np.arange(i + 1, n)
            j = j[(comp[j] != comp[i]) & (np.minimum(size[j], size[i]) >= least * np.maximum(size[j], size[i]) - 1e-9)]
            if not within:
                j = j[own[j] != own[i]]
            j = j[(sig[j] == sig[i]).sum(axis=1) >= agree] if len(j) else j
            for x in j.tolist():
                a, b = root(int(comp[i])), root(int(comp[x]))
                if a != b and similarity(items[i], items[x], *((times[i], times[x]) if counted else ())) >= least - 1e-12:
                    parent[b] = a
                    found.append((doc[i], doc[x]))
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return compare


def near_duplicates(docs: DataFrame, least: float = 0.8, size: int = 5, bands: int = 24, rows: int = 4, block: int = 256, counted: bool = False) -> DataFrame:
    """One row per input row: doc_id, class_id (the least doc_id of its class), kept (doc_id is class_id).

    Two texts are linked if the sets of their ``size``-word shingles have a Jaccard similarity of at least ``least``;
    classes are the components of the links. Words are runs of ASCII letters, digits and non-ASCII characters, A-Z
    folded. ``counted`` weighs shingles by how often they occur; else each weighs 1. Texts of fewer words are one
    shingle; texts without a word, null or empty, are in a class of their own. Rows that repeat a doc_id are one document,
    in the least of its texts' classes; rows without an id get a null class and are kept. Other columns are ignored.

    Two texts of similarity s meet in a bucket with probability 1-(1-s**rows)**bands: at 0.8 all but 3 in a million. In
    buckets that links leave in several parts, pairs with far too few equal darts are not compared; that loses one pair
    of similarity 0.8 in some 10**10, so it adds nothing to those 3.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    sound = source.where("doc IS NOT NULL")
    signed = settle(_signed(sound, size, bands, rows, counted), "signatures")
    worded = signed.where("words > 0")
    reps = settle(worded.groupBy("seq_a", "seq_b").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig"), F.first("keys").alias("keys")), "texts")

    members = reps.select("doc", F.explode("keys").alias("key")).distinct()
    buckets = members.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = settle(members.join(buckets, "key"), "buckets")
    met = members.select("doc").distinct()
    sets = settle(_sets(sound.join(met, "doc", "left_semi"), size, counted), "sets")

    pairs = members.where("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()
    links = settle(_verified(pairs, sets, least, counted), "links")
    first = settle(connected(links), "components")

    placed = members.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "n", F.coalesce("least", "doc").alias("comp"))
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    opened = placed.join(open_keys, "key", "left_semi")
    n_blocks: Column = F.ceil(F.col("n") / block).cast("int")
    opened = opened.withColumn("own", F.pmod(F.xxhash64("doc"), n_blocks).cast("int"))
    carried = opened.join(reps.select("doc", "sig"), "doc").join(sets, "doc").withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    carried = carried.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    # at similarity ``least`` the number of equal darts falls below this once in some 10**10 pairs (binomial)
    k = bands * rows
    agree = int(k * least - 7 * (k * least * (1 - least)) ** 0.5)
    more = carried.groupBy("key", "low", "high").applyInArrow(_block_links(least, counted, agree), "a long, b long")
    classes = connected(links.unionByName(settle(more.distinct(), "links")))

    copies = worded.select("doc", "seq_a", "seq_b").join(reps.select("seq_a", "seq_b", F.col("doc").alias("node")), ["seq_a", "seq_b"])
    named = copies.join(classes, "node", "left").groupBy("doc").agg(F.min(F.coalesce("least", "node")).alias("class"))
    out = docs.select("doc_id", F.col("doc_id").cast("long").alias("doc")).join(named, "doc", "left")
    own = F.coalesce("class", "doc")
    return out.select("doc_id", own.alias("class_id"), F.coalesce(own == F.col("doc"), F.lit(True)).alias("kept"))


@register("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
