"""Line deduplication against levelled sorted runs of line hashes.

Documents come in batches of ascending id. A run is a table of line keys with the document that owns each, bucketed and
sorted by key, so that a batch meets it in a merge join which shuffles the batch alone. Each batch drops the lines whose
key a run already holds, settles the rest inside the batch, and stores its new keys as a run of level 0. When a level
has ``fanout`` runs they are compacted into one run of the next level, so a batch meets few runs however many came
before.

A key is a 128-bit hash of the line, so lines themselves are never shuffled for comparison. Counts per key are combined
before the shuffle, which keeps a line that a third of all documents share from filling one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.registry import register, table
from crowdtide.sources.storage import fresh_path, settle

SPACE = b" \t\n\x0b\f\r"
#: Owner of lines of documents without an id: after all others.
NO_ID = (1 << 63) - 1
#: Tasks that share the documents of one line.
SALTS = 16


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a lower-cased line without white space around it; None if it is too short to be compared."""
    line = line.strip(SPACE)
    if len(line) < min_chars or not line.isascii() and len(line.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def _line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    return [_key(line, min_chars) for line in (text or "").encode().lower().split(b"\n")]


def _split_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(doc, key): the keys of every document, each once."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, keys = [], []
            for i, value in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                own = set(_line_keys(value.as_py(), min_chars)) - {None}
                doc.extend([i] * len(own))
                keys.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(keys, pa.binary())], ["doc", "key"])

    return rows.mapInArrow(split, "doc long, key binary")


class _Runs:
    """Stored runs by level."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.tables: list[str] = []

    def write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        parts = rows.repartition(self.buckets, "key").sortWithinPartitions("key")
        parts.write.option("path", fresh_path(self.spark, name)).bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        self.tables.append(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name).where("fresh").select("key", "owner")

    def all(self) -> list[DataFrame]:
        return [self.read(name) for level in self.levels for name in level]

    def add(self, name: str) -> None:
        """Keep a run; compact a level that is full. Runs share no key, so a union is their merge."""
        level = 0
        self.levels[0].append(name)
        while len(self.levels[level]) >= self.fanout:
            merged = self.read(self.levels[level][0])
            for other in self.levels[level][1:]:
                merged = merged.unionByName(self.read(other))
            self.levels[level] = []
            level += 1
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(self.write(merged.withColumn("fresh", F.lit(True))))

    def forget(self) -> None:
        """Take the runs out of the catalog; their files go with the folder of the application."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def dropped_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = 10) -> DataFrame:
    """(doc, key): the keys each document loses to an earlier one. Documents without an id share one."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    lines = settle(_split_lines(rows, min_chars), "lines")
    edges = [None, *_bounds(docs, batches), None]
    runs = _Runs(spark, fanout)
    try:
        return _dropped_by_batch(spark, lines, edges, runs)
    finally:
        runs.forget()


def _bounds(docs: DataFrame, batches: int) -> list[int]:
    """Whole ids that cut the documents with an id into batches of about equal size."""
    if batches < 2:
        return []
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"))
    cuts = ids.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or ()))


def _dropped_by_batch(spark: SparkSession, lines: DataFrame, edges: list[int | None], runs: _Runs) -> DataFrame:
    dropped = None
    for low, high in zip(edges, edges[1:], strict=False):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("doc") > low)
        if high is not None:
            batch = batch.where(F.col("doc") <= high)
        keys = batch.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        known = None
        for i, run in enumerate(runs.all()):
            keys = keys.join(run.withColumnRenamed("owner", f"owner{i}"), "key", "left")
            known = F.col(f"owner{i}") if known is None else F.coalesce(known, F.col(f"owner{i}"))
        known = F.lit(None).cast("long") if known is None else known
        settled = keys.select(
            "key", F.coalesce(known, F.col("first")).alias("owner"), known.isNull().alias("fresh"),
            (known.isNotNull() | (F.col("first") != F.col("last"))).alias("repeated"),
        )
        name = runs.write(settled)
        # repeated keys go to SALTS places each, so that the documents of a very common line meet it in several tasks
        repeated = spark.table(name).where("repeated").select("key", "owner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = batch.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
        gone = settle(dealt.join(repeated, ["key", "salt"]).where(F.col("doc") != F.col("owner")).select("doc", "key"), "dropped_lines")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        runs.add(name)
    return dropped


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 3, min_chars: int = 10) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its repeated lines, and n_lines, n_dropped. Ids are whole numbers.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points found in two documents or more keep their lines in the smallest doc_id only, all of them there. Null
    text stays null and counts as one empty line; a document may end up empty. Rows that repeat a doc_id are the same
    document and lose the same lines; rows without an id count as one document after all others. Columns of ``docs`` named
    like the added ones are replaced.
    """
    cuts = dropped_lines(docs, batches, fanout, min_chars).distinct()
    by_doc = cuts.groupBy("doc").agg(F.collect_list("key").alias("_gone"))
    docs = docs.drop("n_lines", "n_dropped", "_doc", "_gone")
    names = docs.columns
    keyed = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    joined = keyed.join(by_doc.withColumnRenamed("doc", "_doc"), "_doc", "left").drop("_doc")

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, n_lines, n_dropped = [], [], []
            for value, gone in zip(batch.column("text"), batch.column("_gone"), strict=True):
                value, gone = value.as_py(), set(gone.as_py() or ())
                lines = (value or "").split("\n")
                kept = [x for x, k in zip(lines, _line_keys(value, min_chars), strict=True) if k not in gone] if gone else lines
                texts.append("\n".join(kept) if gone else value)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*[f"`{c}`" for c in names], "_gone").mapInArrow(rebuild, f"{schema}, n_lines long, n_dropped long")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, coalesce(o.owner <> k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@register("op2_line_dedup", ORACLE)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
