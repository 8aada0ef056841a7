"""Chat to events: the shortest useful chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdtide.functions.lexicons import CHAT_NEGATIVE, CHAT_POSITIVE
from crowdtide.functions.text import lexicon_sentiment
from crowdtide.operators import filters, signals, windows

def score_messages(messages: DataFrame, positive: dict[str, float], negative: dict[str, float]) -> DataFrame:
    """Replace the score columns by lexicon sentiment."""
    scored = messages.withColumn("_s", lexicon_sentiment(F.col("text"), F.col("emotes"), positive, negative))
    return scored.withColumns({c: F.col(f"_s.{c}") for c in ("score", "confidence", "label")}).drop("_s")


def lexicon_events(messages: DataFrame, seconds: int = 30, positive: dict[str, float] | None = None, negative: dict[str, float] | None = None) -> DataFrame:
    """Clean, score, bucket and report the events of every stream. Word scores: the chat lexicon unless given."""
    kept = filters.filter_messages(filters.normalize_messages(messages))
    scored = score_messages(kept, positive or CHAT_POSITIVE, negative or CHAT_NEGATIVE)
    return signals.signal_events(signals.signal_windows(windows.chat_buckets(scored, seconds)))
