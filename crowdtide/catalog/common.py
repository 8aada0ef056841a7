"""Shared pieces of the registered queries: result presentation and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtide.functions.lexicons import ReactionLexicon

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 9

# Words that occur in the event tables, so that the reaction formulas have something to find.
EVENT_WEIGHTS_POS = {"purchase": 1.0, "signup": 0.5}
EVENT_WEIGHTS_NEG = {"error": -1.0}
EVENT_LEXICON = ReactionLexicon(
    hype=("purchase", "signup"),
    phrases=("view",),
    confusion=("click",),
    frustration=("error",),
    valence={"purchase": 1.0, "signup": 0.5, "error": -1.0},
    target_stop_words=("view",),
)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its DuckDB counterpart when SQL can express it."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return present(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(x: Column) -> Column:
    scale = float(10**DIGITS)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale)


def present(df: DataFrame) -> DataFrame:
    """Flat, engine-neutral columns: epoch microseconds, rounded doubles, arrays as joined text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c.cast("double"))
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def rnd(expr: str) -> str:
    """The same rounding in SQL."""
    s = f"1e{DIGITS}"
    return f"(CASE WHEN ({expr}) = 0 THEN 0.0 ELSE sign({expr}) * floor(abs({expr}) * {s} + 0.5) / {s} END)"


def half_away(expr: str, digits: int = 3) -> str:
    s = f"1e{digits}"
    return f"(sign({expr}) * floor(abs({expr}) * {s} + 0.5) / {s})"


def clamp_sql(expr: str, low: float = 0, high: float = 1) -> str:
    return f"least(greatest({expr}, {float(low)}), {float(high)})"


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"

# Scored chat messages, as the message adapter builds them.
MSG = f"""msg AS (
  SELECT strftime(ts, '%Y-%m-%d') AS session_id, 'c' || CAST(user_id % 2 AS VARCHAR) AS channel_id,
         'm' || CAST(event_id AS VARCHAR) AS message_id, ts, 'user' || CAST(user_id AS VARCHAR) AS username,
         'User' || CAST(user_id AS VARCHAR) AS display_name, event_type AS text,
         CASE WHEN event_type = 'purchase' THEN ['PogChamp'] ELSE CAST([] AS VARCHAR[]) END AS emotes,
         CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'en' ELSE 'de' END AS language,
         user_id % 50 = 0 AS is_bot_likely, least(greatest((value - 50) / 47, -1), 1) AS score, ({K} + 1) / 103 AS confidence
  FROM events),
scored AS (
  SELECT *, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label,
         time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS bucket_end
  FROM msg)"""

# One-hour chat buckets.
BUCKETS = MSG + """,
buckets AS (
  SELECT session_id, channel_id, bucket_start, bucket_end, count(*) AS message_count,
         count(DISTINCT username) AS unique_chatters, avg(score) AS chat_sentiment, avg(confidence) AS sentiment_confidence,
         avg(CASE WHEN label = 'positive' THEN 1.0 ELSE 0.0 END) AS positive,
         avg(CASE WHEN label = 'neutral' THEN 1.0 ELSE 0.0 END) AS neutral,
         avg(CASE WHEN label = 'negative' THEN 1.0 ELSE 0.0 END) AS negative
  FROM scored GROUP BY ALL)"""

# Speech segments and one-hour transcript buckets counted from the first audio of a session and channel.
SEGMENTS = f"""seg AS (
  SELECT strftime(ts, '%Y-%m-%d') AS session_id, 'c' || CAST(user_id % 2 AS VARCHAR) AS channel_id, event_id AS segment_id,
         ts AS segment_start, ts + to_seconds(CAST({K} AS INTEGER) + 60) AS segment_end,
         event_type || ' u' || CAST(user_id AS VARCHAR) AS text, ({K} + 1) / 103 AS confidence, user_id AS speaker,
         CAST({K} * 10 AS BIGINT) AS asr_latency_ms
  FROM events),
segidx AS (
  SELECT s.*, a.audio_start,
         CAST(floor((epoch_us(segment_start) - epoch_us(a.audio_start)) / 3600e6) AS BIGINT) AS idx
  FROM seg s JOIN (SELECT session_id, channel_id, min(segment_start) AS audio_start FROM seg GROUP BY ALL) a
  USING (session_id, channel_id))"""

TBUCKETS = SEGMENTS + """,
tbuckets AS (
  SELECT session_id, channel_id, audio_start + to_seconds(idx * 3600) AS bucket_start,
         audio_start + to_seconds((idx + 1) * 3600) AS bucket_end,
         string_agg(text, ' ' ORDER BY segment_start, segment_id) AS text,
         min(segment_start) AS audio_started_at, max(segment_end) AS audio_ended_at,
         max(confidence) AS transcript_confidence,
         count(*) AS segment_count, arg_max(asr_latency_ms, (segment_start, segment_id)) AS asr_latency_ms,
         avg(confidence * 2 - 1) AS sentiment_score, avg(confidence) AS sentiment_confidence
  FROM segidx GROUP BY session_id, channel_id, audio_start, idx)"""

us = "epoch_us"
