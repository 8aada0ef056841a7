"""Structured Streaming versions of the window operators.

State is bounded by watermarks. Aggregations are chained (per user or text, then per window), as in the batch code,
because a stream cannot count distinct values otherwise; both levels carry the event-time window and are evicted by
the same watermark. Sinks are idempotent: a batch id may be replayed after a failure without changing the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from crowdtide.functions.lexicons import ReactionLexicon
from crowdtide.operators import transcripts, windows
from crowdtide.operators.intervals import STREAM, drop_superseded
from crowdtide.operators.series import transcript_reaction
from crowdtide.sources.storage import upsert

BUCKET = [*STREAM, "bucket_start", "bucket_end"]


def stream_chat_buckets(messages: DataFrame, seconds: int = 30, watermark: str = "30 seconds") -> DataFrame:
    """Final chat buckets, emitted once the watermark has passed their end. Late messages count while it has not."""
    return windows.chat_buckets(messages.withWatermark("timestamp", watermark), seconds)


def stream_reaction_windows(messages: DataFrame, seconds: int = 5, slide: int = 1, lex: ReactionLexicon | None = None, watermark: str = "30 seconds") -> DataFrame:
    """Scored sliding windows. Each message also feeds the window after its own, so the watermark sits on that time."""
    return windows.reaction_core(messages, seconds, slide, lex, watermark)


def stream_transcript_buckets(segments: DataFrame, seconds: int = 30, watermark: str = "60 seconds") -> DataFrame:
    """Session-relative buckets: the phase of the session start is taken off the time and added back at the end.

    ``segments`` carries audio_start, known when a session opens. Text is collected per bucket in time order.
    """
    span = seconds * 1_000_000
    phase = F.unix_micros("audio_start") % span
    shifted = segments.withColumns({"phase": phase, "ets": F.timestamp_micros(F.unix_micros("segment_start") - phase)})
    agg = (
        shifted.withWatermark("ets", watermark)
        .groupBy(*STREAM, "phase", F.window("ets", f"{seconds} seconds").alias("window"))
        .agg(
            transcripts.joined_text().alias("text"),
            F.max("segment_end").alias("audio_ended_at"),
            F.max("confidence").alias("transcript_confidence"),
            F.count("*").alias("segment_count"),
        )
    )

    def back(c: str):
        return F.timestamp_micros(F.unix_micros(c) + F.col("phase"))

    return agg.withColumns({"bucket_start": back("window.start"), "bucket_end": back("window.end")}).drop("window", "phase")


def stream_overlap_candidates(chat: DataFrame, transcripts: DataFrame, seconds: int = 30, watermark: str = "2 minutes") -> DataFrame:
    """Overlapping bucket pairs of two bucket streams; the interval condition lets both sides forget old rows."""
    c = chat.select(*STREAM, F.col("bucket_start").alias("c_start"), F.col("bucket_end").alias("c_end"), "chat_sentiment").withWatermark("c_start", watermark)
    t = transcripts.select(
        F.col("session_id").alias("t_session"), F.col("channel_id").alias("t_channel"), F.col("bucket_start").alias("t_start"), F.col("bucket_end").alias("t_end"), "sentiment_score"
    ).withWatermark("t_start", watermark)
    near = F.expr(
        f"session_id = t_session AND channel_id = t_channel AND t_start > c_start - INTERVAL {seconds} SECONDS AND t_start < c_start + INTERVAL {seconds} SECONDS"
    )
    return c.join(t, near).drop("t_session", "t_channel")


# --- sinks ------------------------------------------------------------------


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch becomes a partition of a parquet log, named after its id: writing it again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_log(spark: SparkSession, schema: StructType, path: str, upto: int | None = None) -> DataFrame:
    """The log with its batch ids, up to a batch."""
    rows = spark.read.schema(StructType([*schema, StructField("batch", LongType())])).parquet(path)
    return rows if upto is None else rows.where(F.col("batch") <= upto)


def latest_rows(log: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The newest version per key of a log."""
    rows = log.drop("batch")
    return upsert(rows.where(F.lit(False)), rows, keys, version)


class LevelledLog:
    """Newest versions per key, in runs of growing size.

    Batch n is run n of level 0, reduced to one row per key. Whenever ``fanout`` runs of a level are complete they are
    merged into one of the next level, so the batches so far are always covered by fewer than fanout runs of each level,
    named by the digits of their number. A read merges those instead of every version ever written, and a row is written
    once per level. A replayed batch writes the same runs again.
    """

    def __init__(self, spark: SparkSession, schema: StructType, path: str, keys: Sequence[str], version: str, fanout: int = 8):
        self.spark, self.schema, self.path, self.keys, self.version, self.fanout = spark, schema, path, keys, version, fanout

    def _run(self, level: int, number: int) -> str:
        return f"{self.path}/level={level}/run={number}"

    def _merged(self, runs: Sequence[tuple[int, int]]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*[self._run(*r) for r in runs])
        return latest_rows(rows, self.keys, self.version)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        latest_rows(batch, self.keys, self.version).write.mode("overwrite").parquet(self._run(0, batch_id))
        level, done = 0, batch_id + 1
        while done % self.fanout == 0:
            done //= self.fanout
            below = [(level, (done - 1) * self.fanout + i) for i in range(self.fanout)]
            level += 1
            self._merged(below).write.mode("overwrite").parquet(self._run(level, done - 1))

    def runs(self, batches: int) -> list[tuple[int, int]]:
        """The runs that cover the first batches, the largest first."""
        found, start = [], 0
        size, level = 1, 0
        while size * self.fanout <= batches:
            size, level = size * self.fanout, level + 1
        while start < batches:
            if start + size <= batches:
                found.append((level, start // size))
                start += size
            else:
                size, level = size // self.fanout, level - 1
        return found

    def batches(self) -> int:
        """How many batches there are, from the folders of level 0."""
        folder = StructType([StructField("run", LongType())])
        last = self.spark.read.schema(folder).parquet(f"{self.path}/level=0").agg(F.max("run")).first()[0]
        return 0 if last is None else last + 1

    def read(self, batches: int) -> DataFrame:
        runs = self.runs(batches)
        return self._merged(runs) if runs else self.spark.createDataFrame([], self.schema)


def run_to_end(df: DataFrame, path: str, sink: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> StreamingQuery:
    """Process everything available. ``path`` belongs to the query: its checkpoint lies below, and so does its table
    unless ``sink`` is given. A query started again with the same path goes on where the last one stopped."""
    writer = df.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).outputMode(mode)
    writer = writer.foreachBatch(sink) if sink is not None else writer.format("parquet").option("path", f"{path}/table")
    query = writer.start()
    query.awaitTermination()
    return query


def stream_upsert_latest(changes: DataFrame, path: str, keys: Sequence[str], version: str, fanout: int = 8) -> DataFrame:
    """Newest version per key of everything the stream has brought so far, in this and earlier runs."""
    spark = changes.sparkSession
    log = LevelledLog(spark, changes.schema, f"{path}/log", keys, version, fanout)
    last = [-1]

    def sink(batch: DataFrame, batch_id: int) -> None:
        log.append(batch, batch_id)
        last[0] = batch_id

    run_to_end(changes, path, sink)
    # without a new batch the folders tell how many there were
    return log.read(last[0] + 1 if last[0] >= 0 else log.batches())


def provisional_then_final(partials: DataFrame, committed: DataFrame, seconds: int = 30) -> DataFrame:
    """Partial speech windows no committed bucket covers yet; called per micro-batch."""
    live = transcript_reaction(partials)
    return drop_superseded(live, committed, STREAM, ("window_start", "window_end"), ("bucket_start", "bucket_end"), seconds)


def stream_provisional(feed: DataFrame, path: str, seconds: int = 30) -> DataFrame:
    """Partial speech windows of a stream until a committed bucket of the same stream covers them.

    ``feed``: struct columns partial and bucket, one of them null. Committed buckets and the scored partial windows that
    nothing covered when they came are kept in two logs by batch id below ``path``; what was covered later is left out
    when the result is read. A replayed batch reads the log up to itself and writes the same again.
    """
    spark = feed.sparkSession
    bucket, kept = f"{path}/committed", f"{path}/provisional"
    schema = feed.select("bucket.*").schema
    shown = provisional_then_final(spark.createDataFrame([], feed.select("partial.*").schema), spark.createDataFrame([], schema), seconds).schema

    def sink(batch: DataFrame, batch_id: int) -> None:
        log_sink(bucket)(batch.where("bucket IS NOT NULL").select("bucket.*"), batch_id)
        committed = read_log(spark, schema, bucket, batch_id).drop("batch")
        log_sink(kept)(provisional_then_final(batch.where("partial IS NOT NULL").select("partial.*"), committed, seconds), batch_id)

    run_to_end(feed, path, sink)
    committed = read_log(spark, schema, bucket).drop("batch")
    rows = read_log(spark, shown, kept).drop("batch")
    return drop_superseded(rows, committed, STREAM, ("window_start", "window_end"), ("bucket_start", "bucket_end"), seconds)


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped so far, from the query's progress reports."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in (p["stateOperators"] if isinstance(p, dict) else p.stateOperators))
