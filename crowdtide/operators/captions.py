"""Captions: neighbouring speech segments merged while the gap, the length and the sentence allow it.

The segments of all streams are sorted once into slices of about equal size, whatever stream they belong to. Each slice
is folded on its own; all that the next slice needs of it is the caption still open at its end. A slice with a cut
inside (a gap, a finished sentence, another stream) has the same open caption at its end whatever came before it. The
others are folded again from what the slice before them hands on, until nothing changes; since captions that start at
the same segment go on alike, the second round usually finds nothing new. No task holds more than one open caption
besides its rows, and no stream or unbroken run of speech is gathered anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.text import collapse_spaces
from crowdtide.sources.storage import settle

STREAM = ["session_id", "channel_id"]
CAPTION_END = re.compile(r"""[.!?]["')\]]?$""")


class Caption(NamedTuple):
    session_id: str | None
    channel_id: str | None
    start: int
    end: int
    text: str

    def closed_before(self, row: "Caption", max_gap: float) -> bool:
        """Whether no merging is possible, whatever the length."""
        return self[:2] != row[:2] or row.start - self.end > max_gap * 1e6 or CAPTION_END.search(self.text) is not None

    def merged(self, row: "Caption") -> "Caption":
        a, b = self.text, row.text
        text = a if a.endswith(b) else b if b.startswith(a) else f"{a} {b}"
        return self._replace(end=row.end, text=text)


CAPTION = "session_id string, channel_id string, `start` long, `end` long, `text` string"
_ROW = pa.schema([("session_id", pa.string()), ("channel_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
_SUMMARY = f"slice int, cut boolean, open struct<{', '.join(p.replace(' ', ':', 1) for p in CAPTION.split(', '))}>"


class Fold:
    """Captions of rows in order; ``closed`` takes those that are done."""

    def __init__(self, max_gap: float, max_length: int):
        self.max_gap, self.max_length = max_gap, max_length
        self.open: Caption | None = None
        self.closed: list[Caption] = []
        self.cut = False

    def add(self, row: Caption) -> None:
        if self.open is not None:
            if self.open.closed_before(row, self.max_gap):
                self.cut = True
            else:
                merged = self.open.merged(row)
                if len(merged.text) <= self.max_length:
                    self.open = merged
                    return
            self.closed.append(self.open)
        self.open = row


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, Caption]]:
    """(slice, handed on from the slice before, caption) in order."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("slice", "place", *_ROW.names)]
        for number, place, *values in zip(*columns, strict=True):
            yield number, place < 0, Caption(*values)


def _summaries(max_gap: float, max_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each slice hands on; ``cut`` tells whether that depends on what came before."""
        found: list[tuple[int, bool, Caption]] = []
        current, fold = None, Fold(max_gap, max_length)
        for number, carried, row in _slices(batches):
            if number != current:
                if current is not None:
                    found.append((current, fold.cut, fold.open))
                current, fold = number, Fold(max_gap, max_length)
            fold.add(row)
            if carried:
                fold.cut = False
            fold.closed.clear()
        if current is not None:
            found.append((current, fold.cut, fold.open))
        opened = pa.array([c._asdict() for _, _, c in found], pa.struct(list(_ROW)))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in found], pa.int32()), pa.array([c for _, c, _ in found], pa.bool_()), opened], ["slice", "cut", "open"])

    return run


def _blocks(max_gap: float, max_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Captions that end in a slice, those it took over included; the open one is left to the next slice."""
        current, fold = None, Fold(max_gap, max_length)
        for number, _, row in _slices(batches):
            if number != current:
                current, fold.open = number, None
            fold.add(row)
            if len(fold.closed) >= 10_000:
                yield pa.RecordBatch.from_pylist([c._asdict() for c in fold.closed], schema=_ROW)
                fold.closed.clear()
        yield pa.RecordBatch.from_pylist([c._asdict() for c in fold.closed], schema=_ROW)

    return run


def caption_blocks(segments: DataFrame, max_gap: float = 5.0, max_length: int = 145, slices: int | None = None) -> DataFrame:
    """STREAM, start, end, text of every caption. Blank segments take no part; a missing end is the start.

    A segment joins the open caption of its stream unless it starts more than ``max_gap`` seconds after the caption's
    end, the caption ends a sentence, or the joined text has more than ``max_length`` characters. A text that the caption
    ends with adds nothing, and one that starts with the caption replaces it. ``slices``: how many there are, by default
    as many as the session shuffles into.
    """
    text = collapse_spaces(F.coalesce("text", F.lit("")))
    start = F.unix_micros("segment_start")
    rows = segments.select(*STREAM, "segment_id", start.alias("start"), F.coalesce(F.unix_micros("segment_end"), start).alias("end"), text.alias("text")).where("text <> '' AND start IS NOT NULL")
    order = [*STREAM, "start", "segment_id"]
    cut = rows.repartitionByRange(slices, *order) if slices else rows.repartitionByRange(*order)
    # a row's place is its number within the slice; what is handed on goes before the first
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cut = settle(cut.sortWithinPartitions(*order).select(F.spark_partition_id().alias("slice"), number.alias("place"), *_ROW.names), "caption_rows")
    by_slice = Window.orderBy("slice")

    def with_carried(handed: DataFrame, own: DataFrame) -> DataFrame:
        """Rows of slices behind the caption handed to them, each slice in one task."""
        first = handed.where("carried IS NOT NULL").select("slice", F.lit(-1).cast("long").alias("place"), *[F.col(f"carried.{c}").alias(c) for c in _ROW.names])
        return own.unionByName(first).repartition("slice").sortWithinPartitions("slice", "place")

    # one row for each slice from here on
    done = settle(cut.repartition("slice").sortWithinPartitions("slice", "place").mapInArrow(_summaries(max_gap, max_length), _SUMMARY), "caption_ends")
    done = done.withColumn("carried", F.lit(None).cast(done.schema["open"].dataType))
    while True:
        now = settle(done.select("slice", "cut", "open", F.col("carried").alias("assumed"), F.lag("open").over(by_slice).alias("carried")), "caption_links")
        again = now.where(~F.col("cut") & ~F.col("carried").eqNullSafe(F.col("assumed"))).select("slice", "carried")
        if again.isEmpty():
            break
        own = cut.join(again.select("slice"), "slice", "left_semi")
        folded = with_carried(again, own).mapInArrow(_summaries(max_gap, max_length), _SUMMARY).select("slice", F.col("cut").alias("_cut"), F.col("open").alias("_open"))
        folded = settle(folded.join(again, "slice"), "caption_ends")
        done = now.join(folded.select("slice").distinct(), "slice", "left_anti").select("slice", "cut", "open", F.col("assumed").alias("carried"))
        # a slice that a cut at its border frees from what came before counts as open still: it may be folded once more
        done = done.unionByName(folded.select("slice", F.lit(False).alias("cut"), F.col("_open").alias("open"), "carried"))
    closed = with_carried(now, cut).mapInArrow(_blocks(max_gap, max_length), CAPTION)
    last = now.orderBy(F.desc("slice")).limit(1).select("open.*")
    both = closed.unionByName(last)
    return both.select(*STREAM, F.timestamp_micros("start").alias("start"), F.timestamp_micros("end").alias("end"), "text")
