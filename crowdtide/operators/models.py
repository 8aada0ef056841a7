"""Pluggable scoring of texts, fallback, bucket sentiment and message samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.lexicons import LABEL_TERMS
from crowdtide.functions.numbers import ratio
from crowdtide.functions.text import label_value, lexicon_label
from crowdtide.operators.filters import prediction_distribution

BUCKET = ["session_id", "channel_id", "bucket_start", "bucket_end"]

Scorer = Callable[[list[str]], pd.DataFrame]
PREDICTION = "text string, label string, confidence double, scores map<string,double>"


def score_texts(texts: DataFrame, scorer: Scorer, column: str = "text", batch: int = 32) -> DataFrame:
    """Predictions of the distinct texts; the model sees each text once, in batches inside Arrow tasks.

    ``scorer`` maps a list of texts to a frame with label, confidence and scores in the same order.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame["text"].iloc[at : at + batch]
                out = scorer(part.tolist()).reset_index(drop=True)
                out["text"] = part.to_numpy()
                yield out[["text", "label", "confidence", "scores"]]

    return texts.select(F.col(column).alias("text")).distinct().mapInPandas(run, PREDICTION)


def lexicon_predictions(texts: DataFrame, column: str = "text", weights: Mapping[str, float] | None = None) -> DataFrame:
    """The built-in scorer: distinct texts through the word list, without Python."""
    s = lexicon_label(F.col("text"), weights or LABEL_TERMS)
    distinct = texts.select(F.col(column).alias("text")).distinct()
    return distinct.withColumn("s", s).select("text", "s.label", "s.confidence", F.lit(None).cast("map<string,double>").alias("scores"))


def with_fallback(predictions: DataFrame, fallback: DataFrame) -> DataFrame:
    """Model predictions, the local ones where the model gave none, with the origin in ``status``."""
    f = fallback.select("text", *[F.col(c).alias(f"_{c}") for c in ("label", "confidence", "scores")])
    j = f.join(predictions, "text", "left")
    ok = F.col("label").isNotNull()
    return j.select(
        "text",
        *[F.when(ok, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("label", "confidence", "scores")],
        F.when(ok, "model").otherwise("fallback").alias("status"),
    )


def bucket_sentiment(messages: DataFrame, predictions: DataFrame) -> DataFrame:
    """Sentiment of each bucket, weighted by how often a text occurs.

    Texts are counted per bucket before the join, so a text that makes up a third of the chat joins once per bucket.
    """
    counts = messages.groupBy(*BUCKET, "text").agg(F.count("*").alias("n"))
    p = prediction_distribution(predictions).select("text", "confidence", "positive", "neutral", "negative")
    joined = counts.where(F.trim("text") != "").join(p, "text")

    def mean(x: Column) -> Column:
        return ratio(F.sum(x * F.col("n")), F.sum("n"))

    scored = joined.groupBy(*BUCKET).agg(
        F.sum("n").alias("analyzed_count"),
        mean(F.col("positive") - F.col("negative")).alias("chat_sentiment"),
        mean(F.col("confidence")).alias("sentiment_confidence"),
        *[mean(F.col(c)).alias(c) for c in ("positive", "neutral", "negative")],
    )
    total = counts.groupBy(*BUCKET).agg(F.sum("n").alias("message_count"))
    out = total.join(scored, BUCKET, "left").withColumn("neutral", F.coalesce("neutral", F.lit(1.0)))
    return out.na.fill(0, ["analyzed_count"]).na.fill(0.0, ["chat_sentiment", "sentiment_confidence", "positive", "negative"])


#: A text is frequent if more than one row in this many has it, so at most as many texts are; places they are dealt to.
FREQUENT, PLACES = 1000, 64


def frequent_texts(rows: DataFrame, column: str = "text") -> list[int]:
    """Hashes of the texts that more than one row in ``FREQUENT`` has; at most ``FREQUENT`` numbers, whatever the input."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.xxhash64(column).alias("h")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # a single row beside the counts, as a scalar
    return sorted(r["h"] for r in counts.crossJoin(F.broadcast(total)).where(F.col("n") * FREQUENT > F.col("total")).select("h").collect())


def join_by_text(rows: DataFrame, table: DataFrame, column: str = "text") -> DataFrame:
    """Inner join on a text column, where ``table`` has each text once.

    Rows of frequent texts are dealt to ``PLACES`` places, and so is their one row of ``table``; the others join as they
    are. A text that half of all rows have then fills many tasks.
    """
    hot = F.xxhash64(column).isin(frequent_texts(rows, column)) if column in rows.columns else F.lit(False)
    names = [c for c in rows.columns if c != column]
    dealt = rows.withColumn("_place", F.when(hot, F.pmod(F.xxhash64(*names), F.lit(PLACES))).otherwise(0).cast("int"))
    every = F.when(hot, F.sequence(F.lit(0), F.lit(PLACES - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(table.withColumn("_place", F.explode(every)), [column, "_place"]).drop("_place")


def message_scores(messages: DataFrame, predictions: DataFrame) -> DataFrame:
    """Messages with label, confidence and sign-of-label score."""
    p = predictions.select("text", F.col("label").alias("_l"), F.col("confidence").alias("_c"))
    j = join_by_text(messages.drop("label", "confidence", "score"), p)
    return j.withColumns({"label": F.col("_l"), "confidence": F.col("_c"), "score": label_value(F.col("_l")) * F.col("_c")}).drop("_l", "_c")


def trace_sample(messages: DataFrame, n: int = 18) -> DataFrame:
    """At most n messages per bucket: the most confident of each label first, then the most confident rest."""
    quota = max(1, n // 3)
    per_label = Window.partitionBy(*BUCKET, "label").orderBy(F.desc("confidence"), "timestamp", "message_id")
    # a message beyond the n most confident of its label can never be chosen: this filter limits the ranking early
    near = messages.withColumn("_place", F.row_number().over(per_label)).where(F.col("_place") <= n)
    named = (F.col("_place") <= quota) & F.col("label").isin("positive", "neutral", "negative")
    w = Window.partitionBy(*BUCKET).orderBy((~named).cast("int"), F.desc("confidence"), "timestamp", "message_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("_place")


def peak_first_sample(messages: DataFrame, n: int = 32, peak_start: str | None = None, peak_end: str | None = None, slice_seconds: float = 1.0) -> DataFrame:
    """At most n messages per bucket for an expensive model: the peak window first, the rest evenly spaced.

    Messages are counted per slice of time. Which positions are wanted follows from the counts alone, and each falls into
    one slice, so messages only ever meet their slice: no task sorts or joins a whole bucket.
    """
    if peak_start is None or peak_end is None:
        marked = messages.withColumn("_peak", F.lit(False))
    else:
        inside = (F.col("timestamp") >= F.col(peak_start)) & (F.col("timestamp") < F.col(peak_end))
        marked = messages.withColumn("_peak", F.coalesce(inside, F.lit(False)))
    marked = marked.withColumn("_slice", F.floor(F.unix_micros("timestamp") / F.lit(slice_seconds * 1_000_000)))
    key = [*BUCKET, "_peak", "_slice"]
    counts = marked.groupBy(*key).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*BUCKET, "_peak")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bucket = Window.partitionBy(*BUCKET)
    slices = counts.withColumns({"_before": before, "_total": F.sum("_n").over(bucket), "_npeak": F.sum(F.when(F.col("_peak"), F.col("_n")).otherwise(0)).over(bucket)})
    peak_taken = F.least(F.col("_npeak"), F.lit(n))
    # the candidates for even spacing are all messages outside the chosen peak ones, in time order
    slots, m = F.lit(n) - peak_taken, F.col("_total") - peak_taken
    step = (m - 1) / F.when(slots > 1, slots - 1)
    none = F.array().cast("array<bigint>")
    spots = F.transform(F.sequence(F.lit(0), F.greatest(slots - 1, F.lit(0))), lambda i: F.rint(i * step).cast("long"))
    even = F.when(slots <= 0, none).when(slots == 1, F.array(F.floor(m / 2))).otherwise(spots)
    whole = (F.col("_total") <= n) | (~F.col("_peak") & (slots > 0) & (m <= slots))
    places = F.when(F.col("_peak"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("long"))).otherwise(even)
    here = F.filter(F.transform(places, lambda p: p - F.col("_before")), lambda p: (p >= 0) & (p < F.col("_n")))
    wanted = slices.select(*key, "_before", whole.alias("_whole"), here.alias("_places")).where(F.col("_whole") | (F.size("_places") > 0))
    inside = Window.partitionBy(*key).orderBy("timestamp", "message_id")
    met = marked.join(wanted, key).withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    chosen = met.where(F.col("_whole") | F.array_contains("_places", F.col("_at")))
    out = chosen.withColumns({"in_peak": F.col("_peak"), "position": F.col("_before") + F.col("_at")})
    return out.drop("_peak", "_slice", "_before", "_whole", "_places", "_at")
