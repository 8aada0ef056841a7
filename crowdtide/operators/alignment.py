"""Alignment of chat buckets with transcript buckets, lagged pairs and label lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide.functions.numbers import clamp01
from crowdtide.functions.text import key_text, strip
from crowdtide.operators.intervals import STREAM, numbered, one_to_one, overlap_pairs


def relationship(delta: Column, converged: float = 0.15, split: float = 0.45) -> Column:
    size = F.abs(delta)
    return F.when(size < converged, "converged").when(size < split, "soft_split").otherwise("diverged")


def offset_relationship(delta: Column) -> Column:
    """The wider scale used when the transcript has been shifted by hand."""
    return F.when(delta.isNotNull(), relationship(delta, 0.2, 0.45))


def similarity(delta: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.abs(delta), F.lit(2.0)) / 2)


def _flag(ok: Column, yes: str, no: str) -> Column:
    return F.when(ok, yes).otherwise(no)


def with_alignment_quality(pairs: DataFrame, window_seconds: float) -> DataFrame:
    """Five-part quality score and four flags. Text length counts bytes without outer white space."""
    overlap = clamp01(F.col("overlap_us") / 1e6 / float(window_seconds))
    length = F.col("trimmed_bytes")
    n, conf = F.col("message_count"), F.col("transcript_confidence")
    quality = clamp01(
        overlap * 0.35
        + clamp01(n / 20.0) * 0.2
        + clamp01(F.col("sentiment_confidence")) * 0.15
        + clamp01(conf) * 0.2
        + clamp01(length / 240.0) * 0.1
    )
    flags = F.array(
        _flag(overlap >= 0.9, "good_overlap", "partial_overlap"),
        _flag(n >= 10, "enough_chat_volume", "low_chat_volume"),
        _flag(conf >= 0.7, "good_transcript_confidence", "low_transcript_confidence"),
        _flag(length >= 80, "enough_transcript_text", "short_transcript_text"),
    )
    return pairs.withColumns({"quality": quality, "quality_flags": flags})


def _chat_side(chat: DataFrame) -> DataFrame:
    return chat.select(
        *STREAM, F.col("bucket_start").alias("chat_bucket_start"), F.col("bucket_end").alias("chat_bucket_end"),
        "chat_sentiment", "sentiment_confidence", "message_count",
    )


def _speech_side(transcripts: DataFrame) -> DataFrame:
    """Only the lengths of the texts take part in the join, not the texts."""
    text = F.coalesce("text", F.lit(""))
    return transcripts.select(
        *STREAM, F.col("bucket_start").alias("transcript_bucket_start"), F.col("bucket_end").alias("transcript_bucket_end"),
        F.col("sentiment_score").alias("transcript_sentiment"), F.coalesce("transcript_confidence", F.lit(0.0)).alias("transcript_confidence"),
        F.octet_length(text).cast("long").alias("text_bytes"), F.octet_length(strip(text)).cast("long").alias("trimmed_bytes"),
    )


CHAT_RANGE = ("chat_bucket_start", "chat_bucket_end")
SPEECH_RANGE = ("transcript_bucket_start", "transcript_bucket_end")


def align(chat: DataFrame, transcripts: DataFrame, window_seconds: int = 30, chunk_windows: int = 1024) -> DataFrame:
    """One-to-one pairs of scored transcript buckets and chat buckets overlapping by at least half a window."""
    speech = numbered(_speech_side(transcripts).where(F.col("transcript_sentiment").isNotNull()), [*STREAM, *SPEECH_RANGE], "_speech")
    side = numbered(_chat_side(chat), [*STREAM, *CHAT_RANGE], "_chat")
    pairs = overlap_pairs(side, speech, STREAM, CHAT_RANGE, SPEECH_RANGE, window_seconds)
    candidates = pairs.where(F.col("overlap_us") * 2 >= window_seconds * 1_000_000).withColumn("usable", F.lit(True))
    matched = one_to_one(candidates, STREAM, (*SPEECH_RANGE, "_speech"), (*CHAT_RANGE, "_chat"), chunk_windows * window_seconds)
    delta = F.col("chat_sentiment") - F.col("transcript_sentiment")
    return with_alignment_quality(matched, window_seconds).select(
        *STREAM,
        F.greatest("chat_bucket_start", "transcript_bucket_start").alias("window_start"),
        F.least("chat_bucket_end", "transcript_bucket_end").alias("window_end"),
        *CHAT_RANGE,
        *SPEECH_RANGE,
        "chat_sentiment",
        F.col("sentiment_confidence").alias("chat_confidence"),
        F.col("message_count").alias("chat_message_count"),
        "transcript_sentiment",
        "transcript_confidence",
        F.col("text_bytes").alias("transcript_text_length"),
        delta.alias("delta"),
        similarity(delta).alias("similarity"),
        relationship(delta).alias("relationship"),
        F.floor(F.col("overlap_us") / 1_000_000).alias("overlap_seconds"),
        "quality",
        "quality_flags",
    )


DEFAULT_LAGS = (-60, -30, 0, 30, 60)


def lag_pairs(chat: DataFrame, transcripts: DataFrame, lags: Sequence[int] = DEFAULT_LAGS, width: int = 30) -> DataFrame:
    """Chat buckets shifted by each lag and matched one-to-one with transcripts.

    A transcript without a score takes part as a candidate; when it is the best match the chat bucket yields nothing.
    The lags are a handful of literals, exploded on the chat side.
    """
    shifted = numbered(_chat_side(chat), [*STREAM, *CHAT_RANGE], "_chat").withColumn("lag_seconds", F.explode(F.array(*[F.lit(int(x)) for x in lags])))
    shifted = shifted.withColumns({f"_{c}": F.timestamp_add("SECOND", F.col("lag_seconds"), F.col(c)) for c in CHAT_RANGE})
    moved = tuple(f"_{c}" for c in CHAT_RANGE)
    speech = numbered(_speech_side(transcripts), [*STREAM, *SPEECH_RANGE], "_speech")
    pairs = overlap_pairs(shifted, speech, STREAM, moved, SPEECH_RANGE, width)
    span = F.unix_micros(moved[1]) - F.unix_micros(moved[0])
    candidates = pairs.where(F.col("overlap_us") * 2 >= span).withColumn("usable", F.col("transcript_sentiment").isNotNull())
    matched = one_to_one(candidates, ["lag_seconds", *STREAM], (*moved, "_chat"), (*SPEECH_RANGE, "_speech"), 1024 * width)
    return matched.select(
        "lag_seconds", *STREAM, *CHAT_RANGE, *SPEECH_RANGE, "chat_sentiment", "transcript_sentiment",
        (F.col("chat_sentiment") - F.col("transcript_sentiment")).alias("delta"),
    )


LABEL_RANGE = ("label_start", "label_end")


def _labels(labels: DataFrame) -> DataFrame:
    return labels.select(
        "session_id", F.col("window_start").alias("label_start"), F.col("window_end").alias("label_end"), key_text(F.col("event_label")).alias("_label")
    )


def overlap_label(windows: DataFrame, labels: DataFrame, width: int = 30) -> DataFrame:
    """Windows with the first overlapping event label, ``none`` if only those overlap, else ''."""
    key = ["session_id", "window_start", "window_end"]
    named = _labels(labels).where(F.col("_label") != "")
    pairs = overlap_pairs(windows.select(*key).distinct(), named, ["session_id"], ("window_start", "window_end"), LABEL_RANGE, width)
    rank = F.struct((F.col("_label") == "none").alias("none"), *LABEL_RANGE)
    best = pairs.groupBy(*key).agg(F.min_by("_label", rank).alias("label"))
    return windows.join(best, key, "left").withColumn("label", F.coalesce("label", F.lit("")))


def gold_label(windows: DataFrame, labels: DataFrame, width: int = 30) -> DataFrame:
    """Reference label of a window: exact ranges before overlaps, events before ``none``, then by start."""
    key = ["session_id", "window_start", "window_end"]
    named = _labels(labels).withColumn("_label", F.when(F.col("_label") == "", "none").otherwise(F.col("_label")))
    pairs = overlap_pairs(windows.select(*key).distinct(), named, ["session_id"], ("window_start", "window_end"), LABEL_RANGE, width)
    exact = (F.col("label_start") == F.col("window_start")) & (F.col("label_end") == F.col("window_end"))
    rank = F.struct((~exact).alias("inexact"), (F.col("_label") == "none").alias("none"), *LABEL_RANGE)
    best = pairs.groupBy(*key).agg(F.min_by("_label", rank).alias("gold_label"))
    return windows.join(best, key, "left")
