"""Row filters and normalising projections (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide.functions.lexicons import EVENT_LABELS
from crowdtide.functions.text import bigrams, collapse_spaces, key_text, let, strip, unicode_tokens


def normalize_messages(messages: DataFrame) -> DataFrame:
    """Collapse white space; a missing language becomes ``other``."""
    return messages.withColumns(
        {
            "text": collapse_spaces(F.coalesce("text", F.lit(""))),
            "language": F.when(F.coalesce("language", F.lit("")) == "", "other").otherwise(F.col("language")),
        }
    )


def filter_messages(messages: DataFrame, min_length: int = 2) -> DataFrame:
    """Drop bots, empty messages, commands and too short text, keeping one-letter reactions and emotes."""
    text = strip(F.coalesce("text", F.lit("")))
    has_emotes = F.coalesce(F.size("emotes"), F.lit(0)) > 0
    short_ok = F.upper(text).isin("W", "L", "?")
    return messages.where(
        ~F.coalesce("is_bot_likely", F.lit(False))
        & ((text != "") | has_emotes)
        & ~text.startswith("!")
        & ((F.char_length(text) >= min_length) | short_ok | has_emotes)
    )


def clip_texts(messages: DataFrame, max_chars: int) -> DataFrame:
    """Strip, drop empty texts, cut and strip again."""
    text = strip(F.coalesce("text", F.lit("")))
    if max_chars > 0:
        text = strip(F.substring(text, 1, max_chars))
    return messages.withColumn("text", text).where(F.col("text") != "")


def drop_caption_noise(segments: DataFrame, min_confidence: float = 0.25, max_non_latin: float = 0.35) -> DataFrame:
    """Keep segments with text, enough confidence, mostly Latin letters and no repetition."""
    text = collapse_spaces(F.coalesce("text", F.lit("")))

    def latin_enough(t: Column) -> Column:
        letters = F.regexp_count(t, F.lit(r"\p{L}"))
        latin = F.regexp_count(t, F.lit(r"[\p{L}&&\p{IsLatin}]"))
        return ~F.coalesce(F.try_divide(letters - latin, letters) > max_non_latin, F.lit(False))

    def repetitive(w: Column) -> Column:
        pairs = bigrams(w)
        few = F.size(F.array_distinct(w)) <= 2
        return (F.size(w) >= 4) & (few | (F.size(F.array_distinct(pairs)) < F.size(w) - 1))

    return segments.where(
        ~F.coalesce(F.col("confidence") < min_confidence, F.lit(False))
        & let(text, lambda t: (t != "") & latin_enough(t) & ~let(unicode_tokens(t), repetitive))
    )


def bucket_reject_reason() -> Column:
    """First reason why a bucket is unusable, NULL when it is fine."""
    return (
        F.when(F.trim(F.coalesce("session_id", F.lit(""))) == "", "session_id is required")
        .when(F.col("bucket_start").isNull() | F.col("bucket_end").isNull(), "bucket_start and bucket_end are required")
        .when(F.col("bucket_end") <= F.col("bucket_start"), "bucket_end must be after bucket_start")
    )


def validate_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("reject_reason", bucket_reject_reason())


def transcript_gaps(transcript_buckets: DataFrame, max_confidence: float = 0.35) -> DataFrame:
    """Buckets with no text and low confidence."""
    confidence = F.coalesce("transcript_confidence", F.lit(0.0))
    return transcript_buckets.where((strip(F.coalesce("text", F.lit(""))) == "") & (confidence < max_confidence))


def label_validity(labels: DataFrame) -> DataFrame:
    """Normalised event label with a validity flag, and a correctness of NULL unless it is a known one."""
    event = key_text(F.col("event_label"))
    event = F.when(event == "", "none").otherwise(event)
    verdict = key_text(F.col("correctness"))
    return labels.withColumns(
        {
            "event_label": event,
            "label_valid": event.isin(*EVENT_LABELS),
            "correctness": F.when(verdict.isin("correct", "wrong", "uncertain"), verdict),
        }
    )


def prediction_distribution(
    df: DataFrame, scores: str = "scores", label: str = "label", confidence: str = "confidence"
) -> DataFrame:
    """Class scores as three shares summing to one; falls back to a one-hot of the label."""

    def canonical(name: Column) -> Column:
        name = F.lower(F.trim(name))
        return (
            F.when(name == "label_0", "negative")
            .when(name == "label_1", "neutral")
            .when(name == "label_2", "positive")
            .otherwise(name)
        )

    entries = F.coalesce(F.map_entries(scores), F.array().cast("array<struct<key:string,value:double>>"))

    def best(cls: str) -> Column:
        hits = F.filter(entries, lambda e: canonical(e["key"]) == cls)
        return F.coalesce(F.greatest(F.array_max(F.transform(hits, lambda e: e["value"])), F.lit(0.0)), F.lit(0.0))

    classes = ("positive", "neutral", "negative")
    name = canonical(F.coalesce(F.col(label), F.lit("neutral")))
    target = F.when(name.isin(*classes), name).otherwise("neutral")
    prepared = df.withColumns({f"_{c}": best(c) for c in classes}).withColumn("_total", sum(F.col(f"_{c}") for c in classes))
    out = {
        c: F.when(F.col("_total") > 0, F.try_divide(F.col(f"_{c}"), F.col("_total"))).otherwise(
            F.when((target == c) & (F.coalesce(F.col(confidence), F.lit(0.0)) >= 0), 1.0).otherwise(0.0)
        )
        for c in classes
    }
    return prepared.withColumns(out).drop(*[f"_{c}" for c in classes], "_total")


def backpressure_events(stream_events: DataFrame) -> DataFrame:
    """One metric row per overload report; stateless, so it runs on streams unchanged."""
    return stream_events.where(F.trim("status") == "backpressure").select(
        "session_id",
        F.lit("asr.backpressure_count").alias("name"),
        F.lit(1.0).alias("value"),
        F.lit("events").alias("unit"),
        F.col("timestamp").alias("recorded_at"),
        F.to_json(F.struct(F.lit("asr_backpressure").alias("reason"), "channel_id", "asr_latency_ms", "asr_interval_ms")).alias("meta"),
    )
