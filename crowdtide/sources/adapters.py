"""Domain tables derived from the generic star-schema parquet tables.

Each adapter is a narrow projection, so column pruning reaches the scan. All rows are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide.functions.numbers import clamp
from crowdtide.functions.text import sentiment_label

HOUR = 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The odd divisors keep means away from exact halves, where the summation order would decide the rounding.


def _k(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("double")


def messages_from_events(events: DataFrame) -> DataFrame:
    """Scored chat messages: one per event; a session is a day, a channel the parity of the user."""
    score = clamp((F.col("value") - 50) / 47, -1.0, 1.0)
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("channel_id"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"),
        F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("display_name"),
        F.col("event_type").alias("text"),
        F.when(F.col("event_type") == "purchase", F.array(F.lit("PogChamp")))
        .otherwise(F.array().cast("array<string>"))
        .alias("emotes"),
        F.array().cast("array<string>").alias("badges"),
        F.when(F.col("user_id") % 3 == 0, "").when(F.col("user_id") % 3 == 1, "en").otherwise("de").alias("language"),
        F.lit(False).alias("is_mod"),
        (F.col("user_id") % 50 == 0).alias("is_bot_likely"),
        score.alias("score"),
        ((_k() + 1) / 103).alias("confidence"),
        sentiment_label(score).alias("label"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from_events(table(spark, sf_dir, "events"))


def segments_from_events(events: DataFrame) -> DataFrame:
    """Speech segments with absolute times; the length follows the counter in ``props``."""
    start = F.col("ts").cast("timestamp")
    end = F.timestamp_add("SECOND", (_k() + 60).cast("int"), start)
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string")).alias("channel_id"),
        F.col("event_id").alias("segment_id"),
        start.alias("segment_start"),
        end.alias("segment_end"),
        F.concat_ws(" ", "event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("text"),
        ((_k() + 1) / 103).alias("confidence"),
        F.col("user_id").alias("speaker"),
        (_k() * 10).cast("long").alias("asr_latency_ms"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments_from_events(table(spark, sf_dir, "events"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages of one session each, twenty seconds apart."""
    conv = table(spark, sf_dir, "conversations")
    ts = F.timestamp_micros((F.col("conv_id") * 86400 + F.col("turn") * 20) * 1000000)
    return conv.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.col("role").alias("channel_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("message_id"),
        ts.alias("timestamp"),
        F.col("role").alias("username"),
        F.col("role").alias("display_name"),
        "text",
        F.col("turn").alias("turn"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
