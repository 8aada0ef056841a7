"""Token counts by a two-tier lookup on the map side.

The lengths (in tokens) of the most frequent pre-tokens of the corpus are computed once and broadcast: at most
``frequent`` entries of at most ``LONGEST`` characters. Other pre-tokens are encoded where they are met and remembered
in a bounded cache of the worker. Pre-tokens are never shuffled: to find the frequent ones, each task sends the top of
its own counts only. Which entries are known affects speed, never results.

Text is cut by a pattern of the standard library where that provably gives the tokenizer's own pre-tokens (plain Latin
letters without superscripts or odd separators, no special string inside). Any other text goes whole to the tokenizer.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.arrays import chunks
from crowdtide.llm.registry import register, table

#: Longest pre-token that is remembered, in characters.
LONGEST = 48
#: Entries of a worker's cache beside the broadcast ones.
CACHED = 1 << 18
#: Pre-tokens a task counts at a time, and those it reports.
COUNTED, REPORTED = 1 << 17, 1 << 13

#: Byte-level pre-tokens, for text that PLAIN matches in full.
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
PLAIN = re.compile("[\x00-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ſ]*")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _plain_test(definition: str) -> Callable[[str], bool]:
    """True for texts that the pattern may cut."""
    special = [t["content"] for t in json.loads(definition).get("added_tokens") or []]
    inside = re.compile("|".join(map(re.escape, special))) if special else None
    return lambda text: PLAIN.fullmatch(text) is not None and not (inside and inside.search(text))


def _by_pattern(definition: str) -> bool:
    """Whether the tokenizer cuts text as PIECES does: byte level, own pattern, no normalizer, no added space."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not d.get("normalizer")


class Lengths(dict):
    """Tokens of each known pre-token; a miss is encoded and kept while there is room."""

    def __init__(self, definition: str, known: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(known)
        self.known = known
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, piece: str) -> int:
        n = self.encoded(piece)
        if len(piece) <= LONGEST:
            if len(self) >= len(self.known) + CACHED:
                self.clear()
                self.update(self.known)
            self[piece] = n
        return n

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))


_WORKER: dict[str, Lengths] = {}


def _frequent(docs: DataFrame, text: str, definition: str, n: int) -> list[str]:
    """The pre-tokens with the highest counts, from every task's own top counts."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, counts = _plain_test(definition), Counter()
        for batch in batches:
            for value in batch.column(text):
                value = value.as_py()
                if value and plain(value):
                    counts.update(PIECES.findall(value))
            if len(counts) > 2 * COUNTED:
                counts = Counter(dict(counts.most_common(COUNTED)))
        best = [(p, c) for p, c in counts.most_common(REPORTED) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([c for _, c in best], pa.int64())], ["piece", "n"])

    tops = docs.select(text).mapInArrow(top, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r["piece"] for r in tops.orderBy(F.desc("n"), "piece").limit(n).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, frequent: int = 1 << 15, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Texts of any length are encoded whole; repeated rows and null
    keys are returned as they come; an empty table gives an empty result; other columns are ignored.
    """
    import os

    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer_path or byte_bpe_path(), encoding="utf-8") as f:
        definition = f.read()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known: dict[str, int] = {}
    fast = _by_pattern(definition)
    if fast:
        pieces = _frequent(rows, "text", definition, frequent)
        tokenizer = Tokenizer.from_str(definition)
        known = {p: len(e) for p, e in zip(pieces, tokenizer.encode_batch(pieces, add_special_tokens=False), strict=True)}
    shared = spark.sparkContext.broadcast((definition, known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        definition, known = shared.value
        name = str(hash((definition, len(known), sum(known.values()))))
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Lengths(definition, known)
        lengths, plain = _WORKER[name], _plain_test(definition)
        of = lengths.__getitem__
        for batch in batches:
            for part, _, offsets in chunks(batch, "text"):
                n = np.zeros(part.num_rows, np.int64)
                for i, value in enumerate(part.column("text")):
                    value = value.as_py()
                    if value:
                        n[i] = sum(map(of, PIECES.findall(value))) if fast and plain(value) else lengths.encoded(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"]
                )

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


@register("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
