"""Small tables for the tests of this folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list, first: int = 0) -> DataFrame:
    """Documents of the given texts; an item may also be (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def words(text: str | None) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text: str | None, n: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    if 0 < len(w) < n:
        return {tuple(w)}
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def sentence(rng, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))
