"""Signal windows, detected events and ranked insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions import lexicons as lx
from crowdtide.functions.keys import insight_id, rfc3339
from crowdtide.functions.numbers import clamp01, positive_or_null, round_half_away
from crowdtide.functions.text import first_non_empty, snippet, strip
from crowdtide.operators.filters import transcript_gaps
from crowdtide.operators.intervals import STREAM, best_overlap
from crowdtide.operators.transcripts import bucket_target, transcript_target

BUCKET = [*STREAM, "bucket_start", "bucket_end"]

EVENT_TYPE = (
    "array<struct<type:string,severity:double,timestamp:timestamp,reaction_type:string,target_type:string,"
    "target_text:string,source:string,event_hint:string,text:string,confidence:double,evidence_ids:array<string>>>"
)

OPTIONAL = {
    "peak_reaction_score": "double",
    "peak_reaction_type": "string",
    "peak_target_type": "string",
    "peak_target_text": "string",
    "peak_confidence": "double",
    "peak_evidence_ids": "array<string>",
    "peak_window_start": "timestamp",
    "peak_window_end": "timestamp",
    "peak_time": "timestamp",
    "top_terms": "array<string>",
    "message_scores": "array<struct<message_id:string,text:string>>",
    "peak_evidence_messages": "array<struct<message_id:string,text:string>>",
    "subwindows": "array<struct<window_start:timestamp,window_end:timestamp,reaction_score:double,reaction_type:string,"
    "target_type:string,target_text:string,event_hint:string,confidence:double,evidence_ids:array<string>>>",
}


def with_optional(buckets: DataFrame) -> DataFrame:
    """Add the peak and evidence columns a plain bucket table lacks."""
    missing = {c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in buckets.columns}
    return buckets.withColumns(missing) if missing else buckets


def previous_sentiment(buckets: DataFrame) -> DataFrame:
    """Score of the bucket before, per stream. One row per bucket, so the series is bounded by its duration."""
    order = Window.partitionBy(*STREAM).orderBy("bucket_start", "bucket_end")
    return buckets.withColumn("previous_sentiment", F.lag("chat_sentiment").over(order))


def reaction_from_sentiment(score: Column) -> Column:
    return F.when(score >= lx.SPIKE_SENTIMENT, "hype").when(score <= -lx.SPIKE_SENTIMENT, "frustration").otherwise("neutral")


def context_hint(kind: Column, target: Column) -> Column:
    return F.when(kind == "", "").when(target == "", kind).otherwise(F.concat_ws(":", kind, target))


def peak_subwindow(subwindows: Column, start: Column, end: Column) -> Column:
    """The declared peak, else the best scored one with the later end."""
    declared = F.get(F.filter(subwindows, lambda s: (s["window_start"] == start) & (s["window_end"] == end)), F.lit(0))
    ranked = F.transform(
        subwindows, lambda s, i: F.struct(s["reaction_score"].alias("a"), s["window_end"].alias("b"), (-i).alias("c"), s.alias("s"))
    )
    return F.coalesce(declared, F.array_max(ranked)["s"])


def append_distinct(*lists: Column) -> Column:
    """Ordered union of id lists without blanks and repeats."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(x, empty) for x in lists])
    return F.array_distinct(F.filter(joined, lambda i: F.trim(i) != ""))


def _ids(messages: Column) -> Column:
    return F.transform(messages, lambda m: m["message_id"])


def evidence_ids(limit: int | None = None) -> Column:
    """Peak evidence first, then scored messages: all, or until there are ``limit`` ids (at least one when there is any)."""
    base = append_distinct(F.col("peak_evidence_ids"), F.col("_peak.evidence_ids"), _ids(F.col("peak_evidence_messages")))
    scored = append_distinct(_ids(F.col("message_scores")))
    if limit is None:
        return F.array_union(base, scored)
    room = F.greatest(F.lit(1), F.lit(limit) - F.size(base))
    return F.concat(base, F.slice(F.array_except(scored, base), F.lit(1), room))


def bucket_texts(buckets: DataFrame) -> DataFrame:
    """Texts of a bucket in evidence order: peak messages, scored messages, top terms."""

    def texts(c: str) -> Column:
        return F.coalesce(F.transform(c, lambda m: m["text"]), F.array().cast("array<string>"))

    terms = F.coalesce("top_terms", F.array().cast("array<string>"))
    every = F.concat(texts("peak_evidence_messages"), texts("message_scores"), terms)
    return with_optional(buckets).select(*BUCKET, F.posexplode(every).alias("pos", "text"))


def is_weak(kind: Column, confidence: Column) -> Column:
    return (kind == "neutral") | (confidence < lx.WEAK_CONFIDENCE)


def suppress_weak(df: DataFrame) -> DataFrame:
    """Neutral or unsure windows lose their target; unsure ones become neutral."""
    weak = is_weak(F.col("reaction_type"), F.col("confidence"))
    return df.withColumns(
        {
            "reaction_type": F.when(F.col("confidence") < lx.WEAK_CONFIDENCE, "neutral").otherwise(F.col("reaction_type")),
            "target_type": F.when(weak, "unknown").otherwise(first_non_empty(F.col("target_type"), F.lit("unknown"))),
            "target_text": F.when(weak, "").otherwise(F.col("target_text")),
        }
    )


def _event(kind: str, severity: Column, source: str) -> Column:
    reaction = {"hype_spike": F.lit("hype"), "frustration_spike": F.lit("frustration")}.get(
        kind, F.coalesce(first_non_empty(F.col("reaction_type")), reaction_from_sentiment(F.col("chat_sentiment")))
    )
    severity = clamp01(severity)
    quality, sure = F.col("alignment_quality"), F.col("sentiment_confidence")
    if source == "alignment":
        confidence = (
            F.when(quality.isNotNull() & (sure > 0), (quality + sure) / 2)
            .when(quality.isNotNull(), quality)
            .when(F.col("confidence") > 0, F.col("confidence"))
            .otherwise(severity)
        )
    else:
        confidence = F.when(sure > 0, sure).otherwise(severity)
    target = F.col("target_text")
    return F.struct(
        F.lit(kind).alias("type"),
        severity.alias("severity"),
        F.col("window_start").alias("timestamp"),
        reaction.alias("reaction_type"),
        first_non_empty(F.col("target_type"), F.lit("unknown")).alias("target_type"),
        target.alias("target_text"),
        F.lit(source).alias("source"),
        F.when(target == "", kind).otherwise(F.concat(F.lit(kind + ":"), target)).alias("event_hint"),
        (F.col("transcript_snippet") if source == "alignment" else F.lit("")).alias("text"),
        round_half_away(clamp01(confidence)).alias("confidence"),
        F.col("evidence_ids").alias("evidence_ids"),
    )


def detect_events() -> Column:
    """Up to four events of a window, in fixed order."""
    score, shift, delta = F.col("chat_sentiment"), F.col("chat_sentiment") - F.col("previous_sentiment"), F.col("alignment_delta")
    pos, neg = F.col("positive"), F.col("negative")
    found = F.array(
        F.when(F.abs(shift) >= lx.SHIFT_DELTA, _event("audience_shift", F.abs(shift) / 2, "chat")),
        F.when(
            (pos >= lx.SPIKE_RATIO) & (score >= lx.SPIKE_SENTIMENT),
            _event("hype_spike", (pos + F.greatest(score, F.lit(0.0))) / 2, "chat"),
        ),
        F.when(
            (neg >= lx.SPIKE_RATIO) & (score <= -lx.SPIKE_SENTIMENT),
            _event("frustration_spike", (neg + F.abs(F.least(score, F.lit(0.0)))) / 2, "chat"),
        ),
        F.when(F.abs(delta) >= lx.DIVERGENCE_DELTA, _event("content_audience_divergence", F.abs(delta) / 2, "alignment")),
    )
    return F.array_compact(found).cast(EVENT_TYPE)


def first_event(events: Column) -> Column:
    return F.coalesce(F.get(events, F.lit(0))["type"], F.lit(""))


def finalize(df: DataFrame) -> DataFrame:
    """Suppress weak context, detect events, derive the window's hint."""
    out = suppress_weak(df).withColumn("events", detect_events())
    kind, target = F.col("reaction_type"), F.col("target_text")
    hint = F.coalesce(F.get("events", F.lit(0))["event_hint"], context_hint(kind, target))
    return out.withColumns(
        {
            "first_event_type": first_event(F.col("events")),
            "event_hint": F.when(is_weak(kind, F.col("confidence")), "neutral").otherwise(hint),
        }
    )


def chat_windows(buckets: DataFrame) -> DataFrame:
    """Window fields of chat buckets before alignment."""
    full = previous_sentiment(with_optional(buckets)).withColumn(
        "_peak", peak_subwindow(F.col("subwindows"), F.col("peak_window_start"), F.col("peak_window_end"))
    )
    if {"peak_evidence_messages", "message_scores", "top_terms"} & set(buckets.columns):
        targets = bucket_target(bucket_texts(buckets), BUCKET)
        full = full.join(targets.withColumnRenamed("target_text", "_repeated"), BUCKET, "left")
    else:
        full = full.withColumn("_repeated", F.lit(None).cast("string"))
    score = F.col("chat_sentiment")
    return full.select(
        *STREAM,
        F.col("bucket_start").alias("window_start"),
        F.col("bucket_end").alias("window_end"),
        "message_count",
        F.col("unique_chatters"),
        "chat_sentiment",
        "sentiment_confidence",
        "positive",
        "neutral",
        "negative",
        "previous_sentiment",
        F.coalesce(first_non_empty(F.col("peak_reaction_type"), F.col("_peak.reaction_type")), reaction_from_sentiment(score)).alias("reaction_type"),
        F.coalesce(first_non_empty(F.col("_peak.target_type"), F.col("peak_target_type")), F.lit("unknown")).alias("target_type"),
        F.coalesce(first_non_empty(F.col("_peak.target_text"), F.col("peak_target_text"), F.col("_repeated")), F.lit("")).alias("target_text"),
        clamp01(F.coalesce(positive_or_null(F.col("peak_confidence")), positive_or_null(F.col("_peak.confidence")), F.col("sentiment_confidence"))).alias("confidence"),
        evidence_ids().alias("evidence_ids"),
    )


def alignment_windows(alignments: DataFrame) -> DataFrame:
    """Windows of sessions that have alignments but no chat buckets."""
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    return alignments.select(
        *STREAM,
        "window_start",
        "window_end",
        F.col("chat_message_count").alias("message_count"),
        F.lit(0).cast("long").alias("unique_chatters"),
        "chat_sentiment",
        F.col("chat_confidence").alias("sentiment_confidence"),
        zero.alias("positive"),
        zero.alias("neutral"),
        zero.alias("negative"),
        none.alias("previous_sentiment"),
        reaction_from_sentiment(F.col("chat_sentiment")).alias("reaction_type"),
        F.lit("unknown").alias("target_type"),
        F.lit("").alias("target_text"),
        clamp01((F.col("chat_confidence") + F.col("quality")) / 2).alias("confidence"),
        F.array().cast("array<string>").alias("evidence_ids"),
    )


SPEECH_KEY = [*STREAM, "transcript_bucket_start", "transcript_bucket_end"]


def transcript_context(alignments: DataFrame, transcripts: DataFrame, width: int = 30) -> DataFrame:
    """Snippet, repeated phrase and evidence id of the transcript bucket behind each alignment."""
    t = transcripts.select(*STREAM, F.col("bucket_start").alias("_ts"), F.col("bucket_end").alias("_te"), "text")
    ranges = alignments.select(*SPEECH_KEY).distinct()
    exact = (F.col("_ts") == F.col("transcript_bucket_start")) & (F.col("_te") == F.col("transcript_bucket_end"))
    hit = best_overlap(ranges, t, STREAM, SPEECH_KEY[2:], tuple(SPEECH_KEY[2:]), ("_ts", "_te"), width, ["_ts", "text"], exact)
    hit = hit.where(F.col("_ts").isNotNull()).withColumn("text", strip("text"))
    target = transcript_target(hit, SPEECH_KEY)
    return hit.join(target, SPEECH_KEY, "left").select(
        *SPEECH_KEY,
        snippet(F.col("text"), 180).alias("transcript_snippet"),
        F.col("target_text").alias("_speech_target"),
        F.concat(F.lit("transcript:"), rfc3339(F.col("_ts"))).alias("_speech_id"),
    )


ALIGNED = ["transcript_sentiment", "transcript_confidence", "alignment_delta", "alignment_quality", "similarity", "relationship", "quality_flags"]


def signal_windows(
    buckets: DataFrame,
    alignments: DataFrame | None = None,
    transcripts: DataFrame | None = None,
    width: int = 30,
    orphans: bool = True,
) -> DataFrame:
    """Scored windows with their events, chat enriched by alignment and transcript context.

    ``orphans``: also report alignments of sessions without any chat bucket. Alignments computed from these very
    buckets have none, so the branch can be switched off.
    """
    chat = chat_windows(buckets)
    if alignments is None:
        none = F.lit(None).cast("double")
        plain = chat.withColumns(
            {
                **{c: none for c in ALIGNED[:5]},
                "relationship": F.lit(""),
                "quality_flags": F.lit(None).cast("array<string>"),
                "aggregate_sentiment": none,
                "transcript_snippet": F.lit(""),
                "source": F.lit("chat"),
            }
        )
        return finalize(plain)

    side = alignments.select(
        *STREAM,
        F.struct(
            F.col("window_end").alias("_latest"), "chat_sentiment", "chat_confidence", "transcript_sentiment", "transcript_confidence",
            F.col("delta").alias("alignment_delta"), F.col("quality").alias("alignment_quality"), "similarity", "relationship",
            "quality_flags", *SPEECH_KEY[2:],
        ).alias("al"),
        F.col("chat_bucket_start").alias("_cs"), F.col("chat_bucket_end").alias("_ce"),
        "window_start", "window_end",
    )
    latest = side.groupBy(*STREAM, F.col("_cs").alias("window_start"), F.col("_ce").alias("window_end")).agg(F.max("al").alias("al"))
    with_chat = suppress_weak(chat).join(latest, [*STREAM, "window_start", "window_end"], "left")
    base = with_chat
    if orphans:
        lone = alignments.join(buckets.select("session_id").distinct(), "session_id", "left_anti")
        key = [*STREAM, "window_start", "window_end"]
        only = suppress_weak(alignment_windows(lone)).join(side.groupBy(*key).agg(F.max("al").alias("al")), key)
        base = base.unionByName(only)

    if transcripts is not None:
        ctx = transcript_context(alignments, transcripts, width)
        joined = base.withColumns({c: F.col(f"al.{c}") for c in SPEECH_KEY[2:]}).join(ctx, SPEECH_KEY, "left").drop(*SPEECH_KEY[2:])
    else:
        joined = base.withColumns({c: F.lit(None).cast("string") for c in ("transcript_snippet", "_speech_target", "_speech_id")})

    has = F.col("al").isNotNull()
    sure = F.coalesce(positive_or_null(F.col("sentiment_confidence")), positive_or_null(F.col("al.chat_confidence")), F.lit(0.0))
    q = F.col("al.alignment_quality")
    blended = clamp01(F.when(sure == 0, q).when(q == 0, sure).otherwise((sure + q) / 2))
    enriched = joined.withColumns(
        {
            **{c: F.col(f"al.{c}") for c in ALIGNED},
            "aggregate_sentiment": (F.col("al.chat_sentiment") + F.col("al.transcript_sentiment")) / 2,
            "source": F.when(has, "alignment").otherwise("chat"),
            "reaction_type": F.when(has & F.col("reaction_type").isin("", "neutral"), reaction_from_sentiment(F.col("al.chat_sentiment"))).otherwise(F.col("reaction_type")),
            "confidence": F.when(has, blended).otherwise(F.col("confidence")),
            "target_text": F.when(F.col("target_text") == "", F.coalesce("_speech_target", F.lit(""))).otherwise(F.col("target_text")),
            "evidence_ids": append_distinct(F.col("evidence_ids"), F.when(F.col("_speech_id").isNotNull(), F.array("_speech_id"))),
        }
    ).withColumns({"relationship": F.coalesce("relationship", F.lit("")), "transcript_snippet": F.coalesce("transcript_snippet", F.lit(""))})
    return finalize(enriched.drop("al", "_speech_target", "_speech_id"))


def signal_events(windows: DataFrame) -> DataFrame:
    """One row per detected event."""
    return windows.select(*STREAM, "window_start", "window_end", F.inline("events"))


# Titles and sentences of findings are output values: fixed.
TITLES = {
    "audience_shift": ("Audience sentiment shifted", "Chat sentiment changed sharply from the previous replay window."),
    "hype_spike": ("Audience hype spike", "Positive chat reaction exceeded the deterministic spike threshold."),
    "frustration_spike": ("Audience frustration spike", "Negative chat reaction exceeded the deterministic spike threshold."),
    "content_audience_divergence": ("Content and audience diverged", "Chat and transcript sentiment moved apart in this replay window."),
}


def insight_rank() -> Column:
    return round_half_away(F.col("severity") * 0.7 + F.col("confidence") * 0.3)


def _finding(kind: str, summary: str, value: Column) -> Column:
    return F.when(
        value.isNotNull(),
        F.struct(F.lit(kind).alias("type"), F.lit(summary).alias("summary"), F.col("window_start").alias("timestamp"), value.alias("value")),
    )


def event_insights(windows: DataFrame) -> DataFrame:
    """Findings from detected events, with title, confidence and evidence. The sentences are fixed values."""
    rows = windows.withColumn("event", F.explode("events"))
    kind = F.col("event.type")
    quality, sure = F.col("alignment_quality"), clamp01(F.coalesce("sentiment_confidence", F.lit(0.0)))
    confidence = F.when(quality.isNotNull(), clamp01((sure + quality) / 2)).otherwise(sure)
    confidence = F.when((confidence == 0) & F.col("transcript_confidence").isNotNull(), clamp01(F.col("transcript_confidence"))).otherwise(confidence)
    title = F.lit("Replay insight")
    text = F.lit("Deterministic replay analysis found a notable session signal.")
    for name, (head, body) in TITLES.items():
        title = F.when(kind == name, head).otherwise(title)
        text = F.when(kind == name, body).otherwise(text)
    related = F.concat(F.lit("Chat and transcript sentiment relationship is "), "relationship", F.lit(" in this replay window."))
    text = F.when((kind == "content_audience_divergence") & (F.col("relationship") != ""), related).otherwise(text)
    evidence = F.array_compact(
        F.array(
            _finding("chat_sentiment", "Chat sentiment in replay signal window.", F.col("chat_sentiment")),
            _finding("previous_chat_sentiment", "Previous chat sentiment for the same session and channel.", F.col("previous_sentiment")),
            _finding("transcript_sentiment", "Aligned transcript sentiment in replay window.", F.col("transcript_sentiment")),
            _finding("alignment_delta", "Difference between chat and transcript sentiment.", F.col("alignment_delta")),
        )
    )
    return rows.select(
        *STREAM, kind.alias("kind"), title.alias("title"), text.alias("description"), clamp01(F.col("event.severity")).alias("severity"),
        confidence.alias("confidence"), "window_start", "window_end", evidence.alias("evidence"),
    )


def gap_insights(transcripts: DataFrame) -> DataFrame:
    """Findings for buckets without usable speech. The sentences are fixed values."""
    gap = clamp01(1 - F.coalesce("transcript_confidence", F.lit(0.0)))
    rows = transcript_gaps(transcripts).withColumns({"window_start": F.col("bucket_start"), "window_end": F.col("bucket_end")})
    evidence = F.array(
        _finding("transcript_confidence", "Transcript confidence is below deterministic replay threshold.", F.coalesce("transcript_confidence", F.lit(0.0)))
    )
    return rows.select(
        *STREAM,
        F.lit("transcript_gap").alias("kind"),
        F.lit("Transcript evidence gap").alias("title"),
        F.lit("Replay transcript evidence is missing or too low-confidence for this window.").alias("description"),
        gap.alias("severity"),
        gap.alias("confidence"),
        "window_start",
        "window_end",
        evidence.alias("evidence"),
    )


def insights(windows: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    found = event_insights(windows)
    if transcripts is not None:
        found = found.unionByName(gap_insights(transcripts))
    ident = insight_id(F.col("session_id"), F.col("channel_id"), F.col("kind"), F.col("window_start"), F.col("window_end"), F.col("severity"))
    return found.withColumns({"insight_id": ident, "rank": insight_rank()})


def order_insights(found: DataFrame) -> DataFrame:
    """Position of each finding in its session: by time, severity, id."""
    w = Window.partitionBy("session_id").orderBy("window_start", F.desc("severity"), "insight_id")
    return found.withColumn("position", F.row_number().over(w))


def top_insights(found: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("rank"), "window_start", F.desc("severity"), "insight_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def insight_summary(found: DataFrame) -> DataFrame:
    """One row per session: counts, severities, the best of each kind and the top three."""

    def best_of(kind: str) -> Column:
        order = F.struct("rank", (-F.unix_micros("window_start")).alias("t"), "severity", F.col("insight_id").alias("i"))
        return F.max_by(F.when(F.col("kind") == kind, F.col("insight_id")), F.when(F.col("kind") == kind, order))

    top = F.struct("severity", "insight_id", "kind")
    lead = F.min_by(top, F.struct((-F.col("severity")).alias("s"), "insight_id"))
    # places among all findings and among the unsure ones come from the same sorted pass
    order = Window.partitionBy("session_id").orderBy(F.desc("rank"), "window_start", F.desc("severity"), "insight_id")
    unsure = (F.col("confidence") < 0.55) | (F.col("kind") == "transcript_gap")
    placed = found.withColumns(
        {
            "_place": F.row_number().over(order),
            "_unsure": F.sum(unsure.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )

    def ids(wanted: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(wanted, F.struct("_place", "insight_id")))), lambda s: s["insight_id"])

    out = placed.groupBy("session_id").agg(
        F.count("*").alias("insight_count"),
        F.count_if(F.col("severity") >= 0.7).alias("high_severity_count"),
        F.count_if(F.col("kind") != "transcript_gap").alias("event_count"),
        F.max("severity").alias("max_severity"),
        round_half_away(F.avg("severity")).alias("average_severity"),
        lead.alias("lead"),
        best_of("content_audience_divergence").alias("biggest_divergence"),
        best_of("hype_spike").alias("highest_hype"),
        best_of("frustration_spike").alias("highest_frustration"),
        ids(F.col("_place") <= 3).alias("top_moments"),
        ids(unsure & (F.col("_unsure") <= 3)).alias("low_confidence_flags"),
    )
    return out.withColumns({"primary_insight_kind": F.col("lead.kind"), "top_insight_id": F.col("lead.insight_id")}).drop("lead")
