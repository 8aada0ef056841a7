"""Time series per session: rates, gaps, trends, merged timelines and captions' quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.numbers import clamp, clamp01, mean_of_present, ratio
from crowdtide.functions.text import collapse_spaces, unicode_tokens, words_lit
from crowdtide.operators.alignment import offset_relationship

STREAM = ["session_id", "channel_id"]
BUCKET = [*STREAM, "bucket_start", "bucket_end"]


def keep_latest(table: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Newest n rows per key; the limit runs before the shuffle as a window group limit."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return table.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def forward_fill(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Clamp to [-1, 1], carry the last value forward, drop the leading gap."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(clamp(F.col(value), -1.0, 1.0), ignorenulls=True).over(w)
    return points.withColumn("filled", filled).where(F.col("filled").isNotNull())


def series_range_and_trend(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int | None = None) -> DataFrame:
    """Spread and first-to-last change of all filled points, or of the newest n; 0 with fewer than two."""
    filled = forward_fill(points if n is None else keep_latest(points, keys, order, n), keys, order, value)
    at = F.struct(*order)
    enough = F.count("*") > 1
    return filled.groupBy(*keys).agg(
        F.when(enough, F.max("filled") - F.min("filled")).otherwise(0.0).alias("value_range"),
        F.when(enough, F.max_by("filled", at) - F.min_by("filled", at)).otherwise(0.0).alias("value_trend"),
    )


def bucket_rate() -> Column:
    """Messages per minute of a bucket, rounded half up."""
    us = F.unix_micros("bucket_end") - F.unix_micros("bucket_start")
    seconds = F.when(us > 0, us / 1e6).otherwise(30.0)
    return F.floor(F.col("message_count") / seconds * 60 + 0.5)


def rate_trend(buckets: DataFrame) -> DataFrame:
    """Rate per bucket, percent change against the bucket before, and the peak rate of the stream."""
    w = Window.partitionBy(*STREAM).orderBy("bucket_start", "bucket_end")
    rated = buckets.withColumn("rate", bucket_rate())
    prev = F.lag("rate").over(w)
    change = F.when((F.col("rate") != 0) & (prev != 0), F.floor((F.col("rate") - prev) / prev * 100 + 0.5))
    return rated.withColumns({"trend_percent": change, "peak_rate": F.max("rate").over(Window.partitionBy(*STREAM))})


def merge_window_series(chat: DataFrame, transcripts: DataFrame, n: int | None = None) -> DataFrame:
    """Chat and transcript scores on one time line; the aggregate is the mean of what is present."""
    c = chat.select(*BUCKET, F.col("chat_sentiment").alias("chat"), F.col("message_count").alias("_m"))
    words = F.coalesce(F.col("word_count") if "word_count" in transcripts.columns else F.lit(None).cast("long"), F.size(F.filter(F.split(collapse_spaces("text"), " "), lambda t: t != "")).cast("long"))
    t = transcripts.where(F.col("sentiment_score").isNotNull()).select(*BUCKET, F.col("sentiment_score").alias("transcript"), words.alias("_w"))
    out = c.join(t, BUCKET, "full").select(
        *BUCKET,
        "chat",
        "transcript",
        mean_of_present(F.col("chat"), F.col("transcript")).alias("aggregate"),
        F.greatest(F.coalesce("_m", F.lit(0)), F.coalesce("_w", F.lit(0))).alias("messages"),
        F.when(F.col("chat").isNull(), "transcript").otherwise("chat").alias("source"),
    )
    return out if n is None else keep_latest(out, ["session_id"], ["bucket_start", "bucket_end", "channel_id"], n)


def caption_quality(segments: DataFrame, n: int | None = None) -> DataFrame:
    """Latency, confidence, emptiness and drop rate of each session, over all its segments or the newest n."""
    recent = segments if n is None else keep_latest(segments, ["session_id"], ["segment_start", "segment_id"], n)
    empty = collapse_spaces(F.coalesce("text", F.lit(""))) == ""
    latency = F.coalesce("pipeline_latency_ms", "asr_latency_ms")

    def disc(p: float, c: str) -> Column:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})").cast("double")

    def quality(key: str) -> Column:
        return F.coalesce(F.get_json_object("quality", f"$.{key}").try_cast("double"), F.lit(0.0))

    rows = recent.withColumns({"_lat": latency, "_conf": F.when(~empty, F.col("confidence"))})
    return rows.groupBy("session_id").agg(
        F.count("*").alias("segment_count"),
        disc(0.5, "_lat").alias("p50_latency_ms"),
        disc(0.95, "_lat").alias("p95_latency_ms"),
        disc(0.5, "_conf").alias("median_confidence"),
        ratio(F.count_if(empty), F.count("*")).alias("empty_rate"),
        ratio(F.sum(quality("dropped_low_confidence_count") + quality("dropped_repeat_count")), F.sum(quality("raw_segment_count"))).alias("drop_rate"),
    )


# --- timelines --------------------------------------------------------------


def timeline_points(signal: DataFrame, alignments: DataFrame, chat: DataFrame, transcripts: DataFrame, reactions: DataFrame) -> DataFrame:
    """Windows of a session's time line from its best source, plus the reaction windows.

    Signal windows before alignments before chat before transcripts, decided per session. Transcript-only sessions
    show no reaction windows.
    """
    cols = ["session_id", "channel_id", "window_start", "window_end"]

    def rows(df: DataFrame, source: str, p: int, start: str = "window_start", end: str = "window_end") -> DataFrame:
        return df.select("session_id", "channel_id", F.col(start).alias("window_start"), F.col(end).alias("window_end"), F.lit(source).alias("source"), F.lit(p).alias("_p"))

    b = ("bucket_start", "bucket_end")
    every = rows(signal, "signal", 0).unionByName(rows(alignments, "alignment", 1)).unionByName(rows(chat, "chat", 2, *b)).unionByName(rows(transcripts, "transcript", 3, *b))
    best = every.groupBy("session_id").agg(F.min("_p").alias("_best"))
    main = every.join(best, "session_id").where(F.col("_p") == F.col("_best"))
    extra = rows(reactions, "reaction", 4).join(best.where(F.col("_best") < 3), "session_id", "left_semi")
    return main.select(*cols, "source").unionByName(extra.select(*cols, "source"))


def timeline_values(points: DataFrame) -> DataFrame:
    """Score, delta, quality, message count and relationship of time-line points.

    ``points`` carries structs (NULL when absent): signal, alignment, chat, transcript, reaction, and offset_seconds.
    """
    moved = F.coalesce("offset_seconds", F.lit(0)) != 0
    chat, speech = F.col("chat.chat_sentiment"), F.col("transcript.sentiment_score")
    both = F.when(chat.isNotNull() & speech.isNotNull(), (chat + speech) / 2)

    def mean2(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2)

    is_reaction = F.col("reaction").isNotNull()
    own = F.coalesce("reaction.reaction_score", F.greatest("reaction.hype_score", "reaction.confusion_score", "reaction.frustration_score", "reaction.intensity_score"), "chat.peak_reaction_score")
    still = F.coalesce(
        F.col("signal.aggregate_sentiment"), mean2(F.col("signal.chat_sentiment"), F.col("signal.transcript_sentiment")),
        mean2(F.col("alignment.chat_sentiment"), F.col("alignment.transcript_sentiment")), chat, speech,
    )
    delta = F.when(moved, chat - speech).otherwise(F.coalesce(F.col("signal.alignment_delta"), F.col("alignment.delta"), chat - speech))
    sure = mean2(F.col("chat.sentiment_confidence"), F.col("transcript.sentiment_confidence"))
    quality = F.when(is_reaction, F.col("reaction.confidence")).when(moved, sure).otherwise(
        F.coalesce(F.col("signal.confidence"), F.col("signal.alignment_quality"), F.col("alignment.quality"), sure)
    )
    return points.withColumns(
        {
            "point_score": F.when(is_reaction, own).when(moved, F.coalesce(both, chat, speech)).otherwise(still),
            "point_delta": delta,
            "point_quality": quality,
            "point_messages": F.coalesce("reaction.message_count", "signal.message_count", "alignment.chat_message_count", "chat.message_count", F.lit(0)),
            "point_relationship": F.when(moved, offset_relationship(delta)).otherwise(F.coalesce("signal.relationship", "alignment.relationship")),
        }
    )


# --- partial speech ---------------------------------------------------------

# fixed values
PARTIAL_POSITIVE = ("amazing", "awesome", "best", "clutch", "great", "hype", "insane", "love", "nice", "perfect", "wow", "yes")
PARTIAL_NEGATIVE = ("awful", "bad", "broken", "hate", "lost", "no", "rough", "terrible", "ugh", "unlucky", "worse", "wrong")
PARTIAL_CONFUSION = ("confused", "how", "huh", "wait", "what", "where", "why")
PARTIAL_FRUSTRATION = ("angry", "annoying", "bad", "hate", "mad", "terrible", "ugh", "wrong")


def transcript_reaction(partials: DataFrame, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Reaction scores of partial speech text, from word lists and punctuation. Every occurrence counts."""
    text = collapse_spaces(F.coalesce("text", F.lit("")))
    rows = partials.withColumn("text", text).where(F.col("text") != "").withColumn("_w", unicode_tokens(F.col("text")))
    n = F.size("_w")

    def hits(words: Sequence[str]) -> Column:
        table = words_lit(words)
        return F.size(F.filter("_w", lambda t: F.array_contains(table, t)))

    rows = rows.withColumns({"_pos": hits(PARTIAL_POSITIVE), "_neg": hits(PARTIAL_NEGATIVE), "_conf": hits(PARTIAL_CONFUSION), "_frus": hits(PARTIAL_FRUSTRATION)})

    def share(c: str) -> Column:
        return F.when(n == 0, 0.0).otherwise(clamp01(F.col(c) / F.greatest(F.lit(3), n)))

    words = F.size(F.split("text", " "))
    marks, bangs = F.regexp_count("text", F.lit("[!?]")), F.regexp_count("text", F.lit("!"))
    given = F.col("sentiment_score") if "sentiment_score" in partials.columns else F.lit(None).cast("double")
    guess = F.when(n == 0, 0.0).otherwise(clamp((F.col("_pos") - F.col("_neg")) / F.greatest(F.col("_pos") + F.col("_neg"), F.lit(2)), -1.0, 1.0))
    rows = rows.withColumn("valence", F.coalesce(given, guess))
    v = F.col("valence")
    boost = F.least(F.lit(0.5), words / 34.0) + F.least(F.lit(0.24), marks * 0.06) + F.least(F.lit(0.2), F.abs(v) * 0.2)
    rows = rows.withColumn("intensity_score", clamp(boost + 0.08, 0.05, 1.0))
    i = F.col("intensity_score")
    seconds = F.greatest(F.lit(1.0), (F.unix_micros(end) - F.unix_micros(start)) / 1e6)
    kind = F.when((i >= 0.68) & (v >= 0.1), "voice_hype").when(v <= -0.25, "voice_frustration").when(v >= 0.25, "voice_positive").otherwise("voice_partial")
    return rows.withColumns(
        {
            "message_count": words.cast("long"),
            "messages_per_minute": F.floor(words / seconds * 60 + 0.5),
            "hype_score": clamp01(share("_pos") * 0.7 + i * 0.22 + F.least(F.lit(0.24), bangs * 0.08)),
            "confusion_score": share("_conf"),
            "frustration_score": share("_frus"),
            "reaction_type": kind,
            "source": F.lit("transcript"),
        }
    ).drop("_w", "_pos", "_neg", "_conf", "_frus")


def merge_committed_provisional(committed: DataFrame, provisional: DataFrame, n: int | None = None) -> DataFrame:
    """Final and still provisional windows of a session: all, or the newest n."""
    both = committed.withColumn("provisional", F.lit(False)).unionByName(provisional.withColumn("provisional", F.lit(True)), allowMissingColumns=True)
    return both if n is None else keep_latest(both, ["session_id"], ["window_start", "window_end", "channel_id"], n)


