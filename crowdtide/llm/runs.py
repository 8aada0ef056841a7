"""Periodic runs of words inside texts, and texts with their repeats taken out.

A run is a stretch of words with smallest period q (words q apart are identical), at least ``length`` words and
``times`` periods long, that no neighbouring word extends. The words of a text get suffix ranks by doubling; the
neighbours' common prefixes give the tree of LCP intervals, which is walked bottom-up. Where the places of two children
meet in a node of depth l, two places i < j of different children with different left words are a maximal pair: their
l common words can be extended to neither side. With j - i <= l / (times - 1) the pair is a whole run from i, of period
j - i and l + j - i words, so nothing has to be extended. A run also shows up with multiples of its period; the least
one is kept.

Places of a node are kept in one order, and their left words tell the classes apart. All places within l / 2 of each
other lie at equal steps, and all but the first have the same left word (the one that the period gives). So a place is
held against the first place within reach before it, and against those after it only while classes differ: no pair
within a class is met, and the pairs found are at most the sum of the runs' exponents.

A text is handled by the task that holds its row; nothing is shuffled. Texts without any sequence of words that occurs
twice at the least length a pair can have are told by hashes, which can only let texts in, never keep one out.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.llm.arrays import STEP_VALUES, chunks, mix
from crowdtide.llm.registry import register, table

RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_LOW = np.uint64((1 << 20) - 1)


def least_match(length: int, times: int) -> int:
    """Fewest words that the two places of a pair have in common."""
    return min(max(length - q, (times - 1) * q) for q in range(1, length + 1))


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and the common prefix of each with the one before it (0 for the first)."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32) + 1]
    step = 1
    while int(ranks[-1].max()) < n:
        now = ranks[-1].astype(np.int64)
        after = np.zeros(n, np.int64)
        after[: n - step] = now[step:]
        ranks.append(np.unique(now * (n + 1) + after, return_inverse=True)[1].astype(np.int32) + 1)
        step *= 2
    order = np.empty(n, np.int64)
    order[ranks[-1] - 1] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        padded = np.append(ranks[k], 0)
        x, y = padded[np.minimum(a, n)], padded[np.minimum(b, n)]
        same = (x == y) & (x > 0)
        # equal ranks at step 2**k: that many words are equal, since no two suffixes end at the same place
        a += same << k
        b += same << k
    common[1:] = a - order[:-1]
    return order, common


def _meet(node: list, child: list[int], left: list[int], found: dict, length: int, times: int) -> None:
    """Join the places of a child to those of its node, and note the runs among pairs of the two."""
    depth, places = node
    if len(child) > len(places):
        child, places = places, child
    reach = depth // (times - 1)
    for x in child:
        at = bisect_left(places, x - reach)
        if at < len(places) and places[at] < x and left[places[at]] != left[x]:
            _note(found, places[at], x, depth, length)
        at = bisect_right(places, x)
        while at < len(places) and places[at] - x <= reach and left[places[at]] != left[x]:
            _note(found, x, places[at], depth, length)
            at += 1
    if len(child) > 64:
        places = sorted(places + child)
    else:
        for x in child:
            insort(places, x)
    node[1] = places


def _note(found: dict, i: int, j: int, depth: int, length: int) -> None:
    period = j - i
    if depth + period >= length:
        run = (i, depth + period)
        found[run] = min(period, found.get(run, period))


def find_runs(ids: np.ndarray, left: np.ndarray, length: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of texts laid end to end, in the order of start and period.

    ``ids`` numbers the words, with no number shared by two texts; ``left`` is the word before each, or for the first
    word of a text a number that no word has.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    found: dict[tuple[int, int], int] = {}
    if len(ids) > 1:
        order, common = suffix_order(ids)
        least = least_match(length, times)
        deep = np.flatnonzero(common >= least)
        lefts = left.tolist()
        for part in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []:
            stack: list[list] = []
            places = order[part[0] - 1 : part[-1] + 1].tolist()
            depths = common[part].tolist()
            for place, depth in zip(places, [*depths, 0], strict=True):
                child = [place]
                while stack and stack[-1][0] > depth:
                    node = stack.pop()
                    _meet(node, child, lefts, found, length, times)
                    child = node[1]
                if depth and stack and stack[-1][0] == depth:
                    _meet(stack[-1], child, lefts, found, length, times)
                elif depth:
                    stack.append([depth, child])
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _repeating(hashes: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Texts in which some ``least`` words in a row may occur twice."""
    n = len(hashes) - least + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    h, have, key = hashes, 1, np.zeros(n, np.uint64)
    taken = 0
    for bit in range(least.bit_length()):
        if least >> bit & 1:
            key = mix(key * STEP_VALUES[0] + h[taken : taken + n])
            taken += have
        if least >> bit + 1:
            h = mix(h[:-have] * STEP_VALUES[1] + h[have:] * STEP_VALUES[2])
            have *= 2
    inside = doc[:n] == doc[least - 1 :]
    of = doc[:n][inside].astype(np.uint64)
    key = np.sort(((key[inside] + mix(of)) & ~_LOW) | of)
    return np.unique((key[1:] & _LOW)[(key[1:] ^ key[:-1]) <= _LOW]).astype(np.int64)


def _runs_of(texts: list[list[bytes]], length: int, times: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as words."""
    sizes = [len(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    ids = np.empty(starts[-1], np.int64)
    base = 0
    for t, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        numbers: dict[bytes, int] = {}
        ids[a:b] = [numbers.setdefault(w, base + len(numbers)) for w in t]
        base += len(numbers)
    left = np.empty(len(ids), np.int64)
    left[1:] = ids[:-1]
    left[starts[:-1][np.array(sizes) > 0]] = -1
    result: list[list] = [[] for _ in texts]
    runs = find_runs(ids, left, length, times)
    for (i, n, q), k in zip(runs, np.searchsorted(starts, [r[0] for r in runs], side="right") - 1, strict=True):
        result[k].append((i - int(starts[k]), n, q))
    return result


def _without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    drop = np.zeros(len(words) + 1, np.int32)
    for i, n, q in runs:
        drop[i + q] += 1
        drop[i + n] -= 1
    return [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]


def periodic_runs(docs: DataFrame, length: int = 24, times: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, n_words, runs (start, length, period), collapsed.

    Words are what lies between ASCII white space. ``runs`` is ordered by start, then period; ``collapsed`` joins by one
    space the words that no run contains after its first period. Null, empty and white texts have no words, no runs and
    an empty ``collapsed``. Rows with the same or a null key are handled one by one; an empty table gives an empty
    result; other columns are ignored. A text is never cut: it takes about 12 bytes a word and doubling step.
    """
    least = least_match(length, times)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                data, cuts = data.tobytes(), offsets.tolist()
                words = [data[a:b].split() for a, b in zip(cuts, cuts[1:])]
                sizes = np.array([len(w) for w in words])
                hashes = np.fromiter((hash(w) for t in words for w in t), np.int64, sizes.sum()).view(np.uint64)
                at = _repeating(hashes, np.repeat(np.arange(len(words)), sizes), least).tolist()
                runs: list[list] = [[] for _ in words]
                for k, r in zip(at, _runs_of([words[k] for k in at], length, times), strict=True):
                    runs[k] = r
                kept = [b" ".join(_without_repeats(w, r) if r else w) for w, r in zip(words, runs, strict=True)]
                rows = [[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(sizes, pa.int64()), pa.array(rows, _RUN_TYPE), pa.array(kept, pa.large_binary()).cast(pa.large_string())],
                    [key, "n_words", "runs", "collapsed"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(find, f"`{key}` {kind}, n_words long, runs {RUNS}, collapsed string")


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first. Null without runs."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r.length * best.period > best.length * r.period, r).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents in which a tenth of the texts, told by their ids, repeat a stretch of words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    df = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    n = F.size("words")
    df = df.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = F.col("a")
    tail = F.transform("words", lambda w, i: F.when(i < place, w).otherwise(F.get("words", (place + (i - place) % F.col("p")).cast("int"))))
    return df.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents", "doc_id", "text"))).withColumn("best", greatest_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
