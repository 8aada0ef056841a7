"""Text expressions: tokens, term hits, ratios, lexicon sentiment.

Everything is a composition of built-in functions. Literal maps and arrays carry the small word lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from crowdtide.functions.lexicons import LABEL_CUTOFF
from crowdtide.functions.numbers import clamp, clamp01, ratio

SPACE = r"[\s\x{85}\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, even when the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bigrams(words: Column) -> Column:
    """Adjacent word pairs of an array, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def words_lit(words: Iterable[str]) -> Column:
    values = [F.lit(w) for w in words]
    return F.array(*values) if values else F.array().cast("array<string>")


def weights_lit(weights: Mapping[str, float]) -> Column:
    return F.create_map(*[F.lit(v) for kv in weights.items() for v in (kv[0], float(kv[1]))])


def null_if_blank(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def first_non_empty(*xs: Column) -> Column:
    return F.coalesce(*[F.when(x != "", x) for x in xs])


def key_text(x: Column) -> Column:
    """Lower-cased and trimmed, '' for NULL."""
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def unicode_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def term_hits(token_list: Column, terms: Iterable[str]) -> Column:
    """How many distinct terms of the list occur."""
    return F.size(F.array_intersect(token_list, words_lit(terms)))


def phrase_hits(text: Column, phrases: Iterable[str]) -> Column:
    padded = F.concat(F.lit(" "), collapse_spaces(F.lower(text)), F.lit(" "))
    return sum((padded.contains(f" {p} ").cast("int") for p in phrases), F.lit(0))


def uppercase_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
    return F.when(letters < 3, F.lit(0.0)).otherwise(ratio(upper, letters))


def punctuation_burst(text: Column) -> Column:
    return clamp01(F.regexp_count(text, F.lit("[!?]")) / F.lit(4.0))


def is_short_burst(text: Column) -> Column:
    return F.char_length(strip(text)).between(1, 12)


def valence(token_list: Column, weights: Mapping[str, float]) -> Column:
    """Mean weight of the distinct matched terms, NULL when none matches."""
    hits = F.array_intersect(token_list, words_lit(weights))
    table = weights_lit(weights)
    total = F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + table[t])
    return ratio(total, F.size(hits))


def sentiment_label(score: Column, given: Column | None = None) -> Column:
    derived = (
        F.when(score > LABEL_CUTOFF, "positive").when(score < -LABEL_CUTOFF, "negative").otherwise("neutral")
    )
    return derived if given is None else F.coalesce(first_non_empty(given), derived)


def _hit_weights(token_list: Column, weights: Mapping[str, float]) -> Column:
    """Weights of the tokens that have one. A hash set tells them first, so that the table is walked for hits only."""
    if not weights:
        return F.array().cast("array<double>")
    table = weights_lit(weights)
    return F.transform(F.filter(token_list, lambda t: t.isin(*weights)), lambda t: F.try_element_at(table, t))


def _scored(hit_values: Column, step: float, cap: float, idle_confidence: float) -> Column:
    n = F.size(hit_values)
    score = clamp(
        F.coalesce(ratio(F.aggregate(hit_values, F.lit(0.0), lambda a, v: a + v), n), F.lit(0.0)), -1.0, 1.0
    )
    confidence = F.when(n == 0, F.lit(idle_confidence)).otherwise(clamp(n * step + 0.35, 0.35, cap))
    return F.struct(score.alias("score"), confidence.alias("confidence"), sentiment_label(score).alias("label"))


def lexicon_sentiment(
    text: Column, emotes: Column, positive: Mapping[str, float], negative: Mapping[str, float]
) -> Column:
    """struct(score, confidence, label) of a chat message; every occurrence counts, emotes only positively."""
    hits = _hit_weights(tokens(text), {**negative, **positive})
    loud = F.transform(F.coalesce(emotes, F.array().cast("array<string>")), F.lower)
    return _scored(F.concat(hits, _hit_weights(loud, positive)), 0.12, 0.85, 0.25)


def lexicon_sentiment_speech(text: Column, weights: Mapping[str, float]) -> Column:
    """The same for speech, with its own word list and confidence cap."""
    return _scored(_hit_weights(tokens(text), weights), 0.10, 0.75, 0.25)


def lexicon_label(text: Column, weights: Mapping[str, float]) -> Column:
    """Label and confidence only; the magnitude is dropped and the score becomes the sign of the label."""
    return _scored(_hit_weights(tokens(text), weights), 0.10, 0.85, 0.45)


def label_value(label: Column) -> Column:
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)


def snippet(text: Column, limit: int) -> Column:
    """Collapsed white space, cut to limit - 3 characters plus dots when longer."""
    t = collapse_spaces(text)
    return F.when(F.char_length(t) > limit, F.concat(F.left(t, F.lit(limit - 3)), F.lit("..."))).otherwise(t)
