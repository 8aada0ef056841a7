from datetime import datetime, timedelta, timezone

T0 = datetime(2026, 1, 1, 12, 0, 0, tzinfo=timezone.utc)

MESSAGE = (
    "session_id string, channel_id string, message_id string, timestamp timestamp, username string, display_name string, "
    "text string, emotes array<string>, language string, is_bot_likely boolean, score double, confidence double, label string"
)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def message(i, seconds, text, user="u", emotes=(), language="", bot=False, score=0.0, confidence=0.5, label=""):
    return ("s", "c", f"m{i}", at(seconds), user, "", text, list(emotes), language, bot, score, confidence, label)


def messages(spark, rows):
    return spark.createDataFrame(rows, MESSAGE)


def seconds(ts) -> float:
    return ts.replace(tzinfo=timezone.utc).timestamp() - T0.timestamp() if ts.tzinfo is None else (ts - T0).total_seconds()


def epoch(df, *cols):
    """Rows with timestamps as seconds after T0."""
    from pyspark.sql import functions as F

    return df.withColumns({c: (F.unix_micros(c) - int(T0.timestamp() * 1e6)) / 1e6 for c in cols})
