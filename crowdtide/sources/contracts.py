"""Data-quality check of a table against a declared contract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """What a column may hold."""

    required: bool = False
    values: Sequence[str] | None = None
    minimum: float | None = None
    maximum: float | None = None


CHAT_BUCKET = {
    "session_id": Field(required=True),
    "channel_id": Field(required=True),
    "bucket_start": Field(required=True),
    "bucket_end": Field(required=True),
    "message_count": Field(required=True, minimum=0),
    "unique_chatters": Field(required=True, minimum=0),
    "chat_sentiment": Field(required=True, minimum=-1, maximum=1),
    "sentiment_confidence": Field(required=True, minimum=0, maximum=1),
    "positive": Field(required=True, minimum=0, maximum=1),
    "neutral": Field(required=True, minimum=0, maximum=1),
    "negative": Field(required=True, minimum=0, maximum=1),
}


def check_contract(table: DataFrame, contract: Mapping[str, Field], closed: bool = True) -> DataFrame:
    """Violations per rule: one aggregation over the table, one row per (column, rule)."""
    rules: list[tuple[str, str, Column]] = []
    never = F.lit(False)
    for name, f in contract.items():
        if name not in table.columns:
            rules.append((name, "required", F.lit(True) if f.required else never))
            continue
        c = F.col(name)
        if f.required:
            rules.append((name, "required", c.isNull()))
        if f.values is not None:
            rules.append((name, "enum", c.isNotNull() & ~c.isin(*f.values)))
        if f.minimum is not None:
            rules.append((name, "minimum", c < f.minimum))
        if f.maximum is not None:
            rules.append((name, "maximum", c > f.maximum))
    if closed:
        rules += [(name, "unknown_field", F.lit(True)) for name in table.columns if name not in contract]
    counts = table.agg(*[F.count_if(bad).alias(f"r{i}") for i, (_, _, bad) in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (n, r, _) in enumerate(rules)])
    return counts.select(F.inline(rows))
