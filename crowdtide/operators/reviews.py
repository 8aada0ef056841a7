"""Review windows, heuristic reviews and the queues built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtide.functions.keys import rfc3339
from crowdtide.functions.numbers import clamp01, ratio, round_half_away
from crowdtide.functions.text import collapse_spaces, first_non_empty, key_text, strip
from crowdtide.operators.alignment import gold_label
from crowdtide.operators.correlation import count_map
from crowdtide.operators.evaluation import reaction_event_time
from crowdtide.operators.intervals import best_overlap

WKEY = ["session_id", "source_window_type", "window_start", "window_end"]
EVIDENCE = "array<struct<id:string,source:string,timestamp:string,text:string>>"


def bround4(x: Column) -> Column:
    """Four digits, halves to even on the binary value."""
    return F.rint(x * 1e4) / 1e4


# --- windows under review ---------------------------------------------------


def review_windows(chat: DataFrame, alignments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Chat buckets, their reaction windows and alignments; transcripts only for sessions without chat.

    Distinct on session, type and range. ``bucket`` is the chat bucket behind the window, ``sub`` the reaction window.
    """
    plain = [f for f in chat.schema.fields if f.name != "subwindows"]
    bucket = F.struct(*[F.col(f.name) for f in plain])
    sub_type = chat.schema["subwindows"].dataType.elementType
    no_sub, no_bucket = F.lit(None).cast(sub_type), F.lit(None).cast(T.StructType(plain))
    base = chat.select("session_id", F.lit("chat_bucket_30s").alias("source_window_type"), F.col("bucket_start").alias("window_start"),
                       F.col("bucket_end").alias("window_end"), bucket.alias("bucket"), no_sub.alias("sub"))
    nested = chat.withColumn("s", F.explode("subwindows")).select(
        "session_id", F.lit("reaction_subwindow").alias("source_window_type"), F.coalesce("s.window_start", "bucket_start").alias("window_start"),
        F.coalesce("s.window_end", "bucket_end").alias("window_end"), bucket.alias("bucket"), F.col("s").alias("sub"),
    )

    def bare(df: DataFrame, kind: str, start: str, end: str) -> DataFrame:
        return df.select("session_id", F.lit(kind).alias("source_window_type"), F.col(start).alias("window_start"), F.col(end).alias("window_end"), no_bucket.alias("bucket"), no_sub.alias("sub"))

    speech = transcripts.join(chat.select("session_id").distinct(), "session_id", "left_anti")
    every = (
        base.unionByName(nested)
        .unionByName(bare(alignments, "alignment_bucket", "window_start", "window_end"))
        .unionByName(bare(speech, "transcript_bucket_30s", "bucket_start", "bucket_end"))
    )
    every = every.where(F.col("window_start").isNotNull() & F.col("window_end").isNotNull())
    w = Window.partitionBy(*WKEY).orderBy(F.col("bucket.bucket_start").asc_nulls_last(), F.col("sub.reaction_score").desc_nulls_last())
    return every.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def with_context(windows: DataFrame, chat: DataFrame, alignments: DataFrame, transcripts: DataFrame, width: int = 30) -> DataFrame:
    """Attach the transcript bucket, alignment and (for bare windows) chat bucket of largest overlap."""
    rng = ("window_start", "window_end")
    t = transcripts.select("session_id", F.col("bucket_start").alias("_ts"), F.col("bucket_end").alias("_te"),
                           F.struct("bucket_start", "text", "sentiment_score", "transcript_confidence").alias("transcript"))
    a = alignments.select("session_id", F.col("window_start").alias("_as"), F.col("window_end").alias("_ae"),
                          F.struct("window_start", "relationship", "delta", "similarity", "quality").alias("alignment"))
    plain = [c for c in chat.columns if c != "subwindows"]
    c = chat.select("session_id", F.col("bucket_start").alias("_cs"), F.col("bucket_end").alias("_ce"), F.struct(*plain).alias("_chat"))
    out = best_overlap(windows, t, ["session_id"], WKEY[1:], rng, ("_ts", "_te"), width, ["transcript"]).drop("overlap_us")
    out = best_overlap(out, a, ["session_id"], WKEY[1:], rng, ("_as", "_ae"), width, ["alignment"]).drop("overlap_us")
    out = best_overlap(out, c, ["session_id"], WKEY[1:], rng, ("_cs", "_ce"), width, ["_chat"]).drop("overlap_us")
    bare = F.col("source_window_type") == "alignment_bucket"
    return out.withColumn("bucket", F.when(bare, F.col("_chat")).otherwise(F.col("bucket"))).drop("_chat")


def event_for_words(text: Column) -> Column:
    """Event label hinted at by the words of a reaction and its hint."""
    t = F.lower(text)

    def any_of(*words: str) -> Column:
        hit = t.contains(words[0])
        for w in words[1:]:
            hit = hit | t.contains(w)
        return hit

    return (
        F.when(any_of("hype", "joy", "celebration", "clutch"), "hype_spike")
        .when(any_of("frustration", "anger", "negative", "fail"), "frustration_spike")
        .when(any_of("confusion", "surprise", "unclear", "why"), "audience_shift")
        .otherwise("none")
    )


def diverged(relationship: Column, delta: Column) -> Column:
    return (F.coalesce(F.trim(relationship), F.lit("")) == "diverged") | (F.abs(F.coalesce(delta, F.lit(0.0))) >= 0.45)


def suggest_label() -> Column:
    """Keyword, then divergence, then score thresholds. Needs bucket, sub, alignment, transcript."""
    blank = F.lit("")
    reaction = F.coalesce(first_non_empty(F.col("sub.reaction_type"), F.col("bucket.peak_reaction_type")), blank)
    hint = F.coalesce(first_non_empty(F.col("sub.event_hint"), F.col("bucket.peak_event_hint")), blank)
    worded = event_for_words(F.concat_ws(" ", F.trim(reaction), hint))
    chat, speech = F.coalesce("bucket.chat_sentiment", F.lit(0.0)), F.coalesce("transcript.sentiment_score", F.lit(0.0))
    score = F.coalesce(F.col("sub.reaction_score"), (chat + speech) / 2)
    return (
        F.when(worded != "none", worded)
        .when(diverged(F.col("alignment.relationship"), F.col("alignment.delta")), "content_audience_divergence")
        .when(score >= 0.35, "hype_spike")
        .when(score <= -0.35, "frustration_spike")
        .otherwise("none")
    )


def review_confidence(suggested: Column, gold: Column) -> Column:
    """Mean of the positive signals, moved by agreement with the gold label."""
    signals = F.filter(
        F.array(
            "sub.confidence", "sub.reaction_score", "bucket.peak_confidence", "bucket.sentiment_confidence", "alignment.quality", "transcript.transcript_confidence"
        ),
        lambda v: v > 0,
    )
    base = F.coalesce(ratio(F.aggregate(signals, F.lit(0.0), lambda a, v: a + v), F.size(signals)), F.lit(0.55))
    moved = (
        F.when(gold == suggested, F.least(F.lit(0.98), base + 0.08))
        .when(gold.isNotNull(), F.greatest(F.lit(0.2), base - 0.15))
        .when(suggested == "none", F.least(base, F.lit(0.72)))
        .otherwise(base)
    )
    return bround4(clamp01(moved))


def usefulness(suggested: Column) -> Column:
    volume = F.coalesce("bucket.message_count", F.lit(0))

    def positive(c: str) -> Column:
        return F.when(F.col(c) != 0, F.col(c))

    reaction = F.coalesce(positive("sub.reaction_score"), positive("bucket.peak_reaction_score"), F.lit(0.4))
    score = F.lit(0.25) + F.least(volume / 100, F.lit(0.25)) + reaction * 0.4 + F.coalesce(F.col("alignment.quality") * 0.1, F.lit(0.0))
    return F.when(suggested == "none", 0.08).otherwise(bround4(clamp01(score)))


def compact_text(text: Column, limit: int | None = None) -> Column:
    """White space collapsed; cut only where the caller asks for it."""
    t = collapse_spaces(text)
    return t if limit is None else F.when(F.char_length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit - 3))), F.lit("..."))).otherwise(t)


def _item(ident: Column, source: str, at: Column, text: Column) -> Column:
    return F.struct(ident.cast("string").alias("id"), F.lit(source).alias("source"), at.cast("string").alias("timestamp"), text.alias("text"))


def review_reason(suggested: Column, gold: Column) -> Column:
    """Why a label was suggested, in sentences of fixed wording."""
    verdict = F.concat(
        F.lit("suggested "), suggested, F.when(gold.isNotNull(), F.concat(F.lit(" against gold label "), gold)).otherwise(" with no human label on this exact window")
    )
    rel = F.coalesce("alignment.relationship", F.lit(""))
    speech = compact_text(F.coalesce("transcript.text", F.lit("")))
    parts = [
        F.when(F.col("bucket").isNotNull(), F.format_string("chat sentiment %.2f from %d messages", F.coalesce("bucket.chat_sentiment", F.lit(0.0)), F.coalesce("bucket.message_count", F.lit(0)))),
        F.when(F.col("sub").isNotNull(), F.format_string("%s subwindow score %.2f", F.coalesce("sub.reaction_type", F.lit("reaction")), F.coalesce("sub.reaction_score", F.lit(0.0)))),
        F.when(speech != "", F.concat(F.lit("transcript: "), speech)),
        F.when(F.col("alignment").isNotNull(), F.concat(F.lit("relationship "), rel, F.format_string(" with delta %.2f", F.coalesce("alignment.delta", F.lit(0.0))))),
    ]
    return F.concat_ws("; ", verdict, *parts)


def review_evidence(lists: Sequence[str]) -> Column:
    """Distinct items: messages of the bucket's ``lists``, reaction window, speech, alignment."""
    none = F.array().cast(EVIDENCE)
    empty = F.array().cast("array<struct<message_id:string,timestamp:timestamp,text:string>>")

    def slim(c: str) -> Column:
        return F.coalesce(F.transform(f"bucket.{c}", lambda m: F.struct(m["message_id"], m["timestamp"], m["text"])), empty)

    first = F.concat(empty, *[slim(c) for c in lists])
    messages = F.transform(first, lambda m: _item(m["message_id"], "chat", rfc3339(m["timestamp"]), compact_text(F.coalesce(m["text"], F.lit("")))))
    at = rfc3339(F.coalesce("sub.window_start", "window_start"))
    sub_text = F.format_string("%d messages; reaction_type=%s; score=%s", F.coalesce("sub.message_count", F.lit(0)), F.coalesce("sub.reaction_type", F.lit("")), F.coalesce("sub.reaction_score", F.lit(0.0)).cast("string"))
    sub = F.when(F.col("sub").isNotNull(), F.array(_item(F.lit("reaction_subwindow"), "reaction", at, sub_text)))
    t_at = rfc3339(F.col("transcript.bucket_start"))
    speech = F.when(
        strip(F.coalesce("transcript.text", F.lit(""))) != "",
        F.array(_item(F.concat(F.lit("transcript:"), t_at), "transcript", t_at, compact_text(F.col("transcript.text")))),
    )
    a_at = rfc3339(F.col("alignment.window_start"))
    a_text = F.concat(F.lit("relationship="), F.coalesce("alignment.relationship", F.lit("")), F.lit("; delta="), F.col("alignment.delta").cast("string"), F.lit("; quality="), F.col("alignment.quality").cast("string"))
    aligned = F.when(F.col("alignment").isNotNull(), F.array(_item(F.concat(F.lit("alignment:"), a_at), "alignment", a_at, a_text)))
    every = F.concat(messages, F.coalesce(sub, none), F.coalesce(speech, none), F.coalesce(aligned, none))
    kept = F.filter(every, lambda e: e["text"] != "")
    return F.transform(F.array(kept), _first_items)[0]


def _first_items(items: Column) -> Column:
    """First occurrence per (source, id, text). ``items`` is bound by a lambda, else every item would make all texts anew."""

    def key(e: Column) -> Column:
        return F.struct(e["source"], e["id"], e["text"])

    def among(keys: Column) -> Column:
        return F.filter(items, lambda e, i: F.array_position(keys, key(e)) == i + 1)

    return F.transform(F.array(F.transform(items, key)), among)[0]


def review_rows(contexts: DataFrame, labels: DataFrame, run_id: str = "run", width: int = 30, reviewer: str = "heuristic-agent-evaluator") -> DataFrame:
    """One review per window: suggestion, verdict against the gold label, confidence, reason and evidence."""
    judged = gold_label(contexts, labels, width).withColumn("suggested", suggest_label())
    s, g = F.col("suggested"), F.col("gold_label")
    lists = [c for c in ("message_scores", "peak_evidence_messages") if c in contexts.schema["bucket"].dataType.fieldNames()]
    predicted = F.when(F.col("alignment").isNotNull() & diverged(F.col("alignment.relationship"), F.col("alignment.delta")), "content_audience_divergence").otherwise(s)
    start = F.coalesce("sub.window_start", "bucket.peak_window_start", "window_start")
    blank = F.lit("")
    ident = F.concat_ws(":", F.lit(run_id), "session_id", "source_window_type", rfc3339(F.col("window_start")), rfc3339(F.col("window_end")))
    return judged.select(
        ident.alias("review_id"),
        F.lit(run_id).alias("run_id"),
        *WKEY,
        F.lit(reviewer).alias("reviewer"),
        F.lit("agent_reviewed").alias("status"),
        predicted.alias("predicted_event"),
        s.alias("suggested_event_label"),
        F.when(g.isNull(), "uncertain").when(s == g, "correct").otherwise("wrong").alias("correctness"),
        F.coalesce(first_non_empty(F.col("sub.reaction_type"), F.col("bucket.peak_reaction_type")), blank).alias("reaction_type"),
        F.coalesce(first_non_empty(F.col("sub.target_type"), F.col("bucket.peak_target_type")), F.lit("unknown")).alias("target_type"),
        F.coalesce(first_non_empty(F.col("sub.target_text"), F.col("bucket.peak_target_text")), blank).alias("target_text"),
        F.coalesce("alignment.relationship", blank).alias("divergence_type"),
        start.alias("event_start"),
        F.coalesce("bucket.peak_time", start).alias("event_peak"),
        review_confidence(s, g).alias("confidence"),
        usefulness(s).alias("streamer_usefulness"),
        review_reason(s, g).alias("reason"),
        review_evidence(lists).alias("evidence"),
        g.alias("reference_event_label"),
    )


def agent_review_metrics(reviews: DataFrame) -> DataFrame:
    """Hits, misses and scores against the gold labels, per session and (session NULL) overall; NULL when undefined.

    ``status`` tells whether there was any gold label to score against; the counts are sorted maps.
    """
    s, g = F.col("suggested_event_label"), F.col("reference_event_label")
    gold = g.isNotNull()
    hit = gold & (s == g) & (s != "none")
    suggested, verdict = F.coalesce(s, F.lit("none")), F.coalesce("correctness", F.lit("uncertain"))
    # one row per session and pair of values first, so that the maps come from counted values
    figures = {
        "review_count": F.lit(True), "evaluated_windows": gold, "true_positive": hit, "false_positive": gold & ~hit & (s != "none"), "false_negative": gold & ~hit & (g != "none"),
        **{c: F.col("correctness") == c for c in ("correct", "wrong", "uncertain")},
    }
    counted = reviews.groupBy("session_id", suggested.alias("_s"), verdict.alias("_v")).agg(
        *[F.count_if(c).alias(n) for n, c in figures.items()], F.sum("confidence").alias("_confidence"), F.count("confidence").alias("_rated")
    )
    sides = F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("_s").alias("v")), F.struct(F.lit("v").alias("side"), F.col("_v").alias("v"))))
    values = counted.select("session_id", sides.alias("x"), "review_count").groupBy("session_id", "x").agg(F.sum("review_count").alias("n"))

    def counts(side: str, name: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("x.side") == side, F.struct(F.col("x.v"), "n"))))).alias(name)

    maps = values.groupBy("session_id").agg(counts("s", "suggested_event_counts"), counts("v", "correctness_counts"))
    overall = values.groupBy("x").agg(F.sum("n").alias("n")).groupBy().agg(counts("s", "suggested_event_counts"), counts("v", "correctness_counts")).select(F.lit(None).cast("string").alias("session_id"), "*")
    out = counted.rollup("session_id").agg(*[F.sum(c).alias(c) for c in figures], bround4(ratio(F.sum("_confidence"), F.sum("_rated"))).alias("average_confidence"), F.grouping("session_id").alias("_all"))
    tp, fp, fn = (F.col(f"{c}") for c in ("true_positive", "false_positive", "false_negative"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    both = maps.withColumn("_all", F.lit(0)).unionByName(overall.withColumn("_all", F.lit(1))).withColumnRenamed("session_id", "_sid").withColumnRenamed("_all", "_top")
    out = out.join(both, F.col("session_id").eqNullSafe(F.col("_sid")) & (F.col("_all") == F.col("_top"))).drop("_sid", "_all", "_top")
    out = out.withColumns({"precision": bround4(p), "recall": bround4(r), "f1": bround4(F.try_divide(p * r * 2, p + r))})
    return out.withColumn("status", F.when(F.col("evaluated_windows") > 0, "computed_against_available_window_labels").otherwise("pending_human_labels"))


# --- quick scoring of stored sessions ---------------------------------------


def event_for_reaction(kind: Column) -> Column:
    k = key_text(kind)
    return (
        F.when(k.isin("hype", "joy", "celebration"), "hype_spike")
        .when(k.isin("frustration", "anger", "negative"), "frustration_spike")
        .when(k.isin("confusion", "surprise"), "audience_shift")
        .otherwise("none")
    )


def _second(at: str | Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _prescored() -> dict[str, Column]:
    """What all prescored rows have in common; texts are fixed values."""
    ident = F.concat_ws(":", F.lit("auto-prescore"), "session_id", "source_window_type", _second("window_start"), _second("window_end"))
    fixed = {"run_id": "auto-prescore", "reviewer": "auto-prescore-agent", "model": "heuristic-replay-prescore", "prompt_version": "stream-evaluation-v1", "status": "suggested", "correctness": "correct"}
    return {"review_id": ident, **{n: F.lit(v) for n, v in fixed.items()}}


def _peak_messages(contexts: DataFrame) -> Column:
    """Evidence items of the bucket's peak messages."""
    if "peak_evidence_messages" not in contexts.schema["bucket"].dataType.fieldNames():
        return F.array().cast(EVIDENCE)
    items = F.transform("bucket.peak_evidence_messages", lambda m: _item(m["message_id"], "chat", _second(m["timestamp"]), m["text"]))
    return F.coalesce(items, F.array().cast(EVIDENCE))


def _plain(ident: str, source: str, text: Column) -> Column:
    return _item(F.lit(ident), source, F.lit(None), text)


def prescore_buckets(contexts: DataFrame) -> DataFrame:
    """Heuristic review of whole chat buckets, with sentences of fixed wording. ``contexts``: windows with bucket, transcript and alignment."""
    b = contexts.where(F.col("source_window_type") == "chat_bucket_30s")
    score, peak, chat = F.col("bucket.peak_reaction_score"), F.col("bucket.peak_reaction_type"), F.col("bucket.chat_sentiment")
    strong = F.coalesce(score >= 0.35, F.lit(False))
    named = event_for_reaction(F.coalesce(peak, F.lit("")))
    label = (
        F.when(strong, F.when((named == "none") & (chat >= 0.35), "hype_spike").otherwise(named))
        .when(chat >= 0.35, "hype_spike")
        .when(chat <= -0.35, "frustration_spike")
        .otherwise("none")
    )
    sure = F.coalesce("bucket.sentiment_confidence", F.lit(0.0))
    confidence = F.when(strong, F.greatest(sure, F.coalesce("bucket.peak_confidence", F.lit(0.0)))).otherwise(sure)
    use = (
        F.when(strong, F.lit(0.35) + score * 0.6).when(chat >= 0.35, F.lit(0.25) + chat).when(chat <= -0.35, F.lit(0.25) - chat).otherwise(0.1)
    )
    b = b.withColumn("label", label)
    none = F.col("label") == "none"
    given = F.coalesce(peak, F.lit(""))
    reaction = F.when(strong | (given != ""), given).when(chat >= 0.35, "hype").when(chat <= -0.35, "frustration").otherwise(given)
    n = F.col("bucket.message_count")
    routine = F.format_string(
        "Chat appears routine for the full bucket: %d messages, sentiment %.2f, neutral ratio %.2f, and no strong reaction event requiring streamer attention.",
        n, chat, F.col("bucket.neutral"),
    )
    candidate = F.format_string(
        "Chat shows a %s candidate: %d messages, sentiment %.2f, peak reaction %s on %s.", F.col("label"), n, chat,
        F.coalesce(first_non_empty(peak), F.lit("unknown")), F.coalesce(first_non_empty(F.col("bucket.peak_target_text")), F.lit("unknown target")),
    )
    said = strip(F.coalesce("transcript.text", F.lit("")))
    speech = F.when(said != "", F.concat(F.lit(" Transcript context: "), said)).otherwise("")
    rel = F.when(F.col("alignment").isNotNull(), F.format_string(" Alignment relationship is %s with delta %.2f.", F.col("alignment.relationship"), F.col("alignment.delta"))).otherwise("")
    none_yet = F.array().cast(EVIDENCE)
    figures = F.format_string(
        "messages=%d, unique_chatters=%d, sentiment=%.2f, positive=%.2f, neutral=%.2f, negative=%.2f", n, "bucket.unique_chatters", chat, "bucket.positive", "bucket.neutral", "bucket.negative"
    )
    spoken = F.when(said != "", F.array(_plain("transcript_bucket", "transcript", said)))
    al = "alignment"
    matched = F.format_string("relationship=%s, delta=%.2f, similarity=%.2f, quality=%.2f", f"{al}.relationship", f"{al}.delta", f"{al}.similarity", f"{al}.quality")
    paired = F.when(F.col(al).isNotNull(), F.array(_plain("alignment", "alignment", matched)))
    evidence = F.concat(F.array(_plain("chat_bucket", "chat", figures)), _peak_messages(contexts), F.coalesce(spoken, none_yet), F.coalesce(paired, none_yet))
    return b.select(
        *WKEY,
        *[c.alias(k) for k, c in _prescored().items()],
        F.col("label").alias("predicted_event"),
        F.col("label").alias("suggested_event_label"),
        reaction.alias("reaction_type"),
        F.coalesce("bucket.peak_target_type", F.lit("")).alias("target_type"),
        F.coalesce("bucket.peak_target_text", F.lit("")).alias("target_text"),
        F.when(strong, F.col("bucket.peak_window_start")).alias("event_start"),
        F.when(strong, F.col("bucket.peak_time")).alias("event_peak"),
        clamp01(F.when(none, F.greatest(confidence, F.lit(0.75))).otherwise(confidence)).alias("confidence"),
        F.when(none, 0.08).otherwise(clamp01(use)).alias("streamer_usefulness"),
        F.when(none, routine).otherwise(F.concat(candidate, speech, rel)).alias("reason"),
        evidence.alias("evidence"),
    )


def prescore_subwindows(contexts: DataFrame) -> DataFrame:
    """Heuristic review of reaction windows, with sentences of fixed wording."""
    s = contexts.where(F.col("source_window_type") == "reaction_subwindow")
    score = F.coalesce("sub.reaction_score", F.lit(0.0))
    named = event_for_reaction(F.col("sub.reaction_type"))
    reason = F.format_string(
        'Short reaction window with %d messages, reaction score %.2f, hype %.2f, confusion %.2f, frustration %.2f, and event hint "%s".',
        "sub.message_count", "sub.reaction_score", "sub.hype_score", "sub.confusion_score", "sub.frustration_score", "sub.event_hint",
    )
    label = F.when((named == "none") & (score >= 0.35), "audience_shift").otherwise(named)
    # the peak messages that the window names, all of them if it names none
    named_ids = F.coalesce("sub.evidence_ids", F.array().cast("array<string>"))
    messages = F.filter(_peak_messages(contexts), lambda e: (F.size(named_ids) == 0) | F.array_contains(named_ids, e["id"]))
    hint, target = F.coalesce("sub.event_hint", F.lit("")), F.coalesce("sub.target_text", F.lit(""))
    own = _plain("subwindow", "reaction", F.format_string("reaction_score=%.2f, event_hint=%s, target=%s", score, hint, target))
    return s.select(
        *WKEY,
        *[c.alias(k) for k, c in _prescored().items()],
        label.alias("predicted_event"),
        label.alias("suggested_event_label"),
        F.col("sub.reaction_type").alias("reaction_type"),
        F.coalesce("sub.target_type", F.lit("")).alias("target_type"),
        target.alias("target_text"),
        F.col("sub.window_start").alias("event_start"),
        reaction_event_time(F.col("bucket.peak_time"), F.col("sub.window_start"), F.col("sub.window_end")).alias("event_peak"),
        clamp01(F.greatest(F.coalesce("sub.confidence", F.lit(0.0)), score)).alias("confidence"),
        clamp01(F.lit(0.35) + score * 0.6).alias("streamer_usefulness"),
        reason.alias("reason"),
        F.concat(messages, F.array(own)).alias("evidence"),
    )


def prescore_reviews(contexts: DataFrame) -> DataFrame:
    return prescore_buckets(contexts).unionByName(prescore_subwindows(contexts))


def merge_reviews(stored: DataFrame, generated: DataFrame) -> DataFrame:
    """Stored reviews win; their blank fields are filled from generated ones, and unmatched generated ones are added."""
    fill = ["reason", "confidence", "streamer_usefulness"]
    g = generated.select(*WKEY, F.struct(*[c for c in generated.columns if c not in WKEY]).alias("g"))
    s = stored.select(*WKEY, F.struct(*[c for c in stored.columns if c not in WKEY]).alias("s"))
    j = s.join(g, WKEY, "full")
    have = F.col("s").isNotNull()

    def merged(c: str) -> Column:
        mine, theirs = F.col(f"s.{c}"), F.col(f"g.{c}")
        if c not in fill:
            return F.when(have, mine).otherwise(theirs)
        kept = F.when(F.trim(mine) != "", mine) if c == "reason" else F.when(mine != 0, mine)
        return F.when(have, F.coalesce(kept, theirs, mine)).otherwise(theirs)

    cols = [c for c in stored.columns if c not in WKEY and c in generated.columns]
    return j.select(*WKEY, *[merged(c).alias(c) for c in cols], F.when(have, "stored").otherwise("generated").alias("origin"))


def best_review_per_window(reviews: DataFrame) -> DataFrame:
    """Most confident review per range and per range and source type."""
    rank = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("c"))
    key = ["session_id", "window_start", "window_end"]
    by_source = reviews.groupBy(*WKEY).agg(F.max_by("review_id", F.struct(rank.alias("r"), F.col("review_id"))).alias("best_for_source"), F.max(rank).alias("_c"))
    best = Window.partitionBy(*key)
    top = F.max(F.struct("_c", F.col("best_for_source"))).over(best)
    return by_source.select(*WKEY, "best_for_source", top["best_for_source"].alias("best_for_range"))


def review_queue_filter(windows: DataFrame, mode: str, labels: DataFrame | None = None, reviews: DataFrame | None = None, low_confidence: float = 0.65) -> DataFrame:
    """Windows of a review queue: all, unlabeled, detected, low_confidence or agent_suggested."""
    key = ["session_id", "window_start", "window_end"]
    if mode == "all":
        return windows
    if mode == "unlabeled":
        return windows.join(labels.select(*key).distinct(), key, "left_anti")
    if mode == "agent_suggested":
        return windows.join(reviews.select(*key).distinct(), key, "left_semi")
    if mode == "detected":
        return windows.where(F.coalesce("first_event_type", F.lit("")).isin("", "none") == F.lit(False))
    if mode == "low_confidence":
        return windows.where(F.col("confidence") < low_confidence)
    raise ValueError(f"unknown queue mode {mode}")


def label_tally(labels: DataFrame) -> DataFrame:
    right, wrong = F.count_if(F.col("correctness") == "correct"), F.count_if(F.col("correctness") == "wrong")
    return labels.groupBy("session_id").agg(
        F.count("*").alias("total"),
        right.alias("correct"),
        wrong.alias("wrong"),
        F.count_if(F.col("correctness") == "uncertain").alias("uncertain"),
        ratio(right, right + wrong).alias("correct_rate"),
    )


def queue_summary(windows: DataFrame, labels: DataFrame, queued: DataFrame) -> DataFrame:
    key = ["session_id", "window_start", "window_end"]
    flagged = windows.join(labels.select(*key).distinct().withColumn("_l", F.lit(True)), key, "left")
    out = flagged.groupBy("session_id").agg(F.count("*").alias("total"), F.count("_l").alias("labeled"))
    q = queued.groupBy("session_id").agg(F.count("*").alias("queued"))
    return out.join(q, "session_id", "left").na.fill(0, ["queued"]).withColumn("coverage", ratio(F.col("labeled"), F.col("total")))


def attach_human_labels(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """Scored messages with the human label of the same session and message."""
    h = labels.select("session_id", "message_id", F.col("label").alias("human_label"))
    return messages.join(h, ["session_id", "message_id"], "left")


def representative_messages(windows: DataFrame, messages: DataFrame, n: int = 5, width: int = 30) -> DataFrame:
    """The strongest messages of each window: its evidence ids when it has any, else those sent inside it."""
    from crowdtide.operators.intervals import points_in_windows

    key = ["session_id", "channel_id", "window_start", "window_end"]
    ids = windows.where(F.size("evidence_ids") > 0).select(*key, F.explode(F.array_distinct("evidence_ids")).alias("message_id"))
    cols = ["message_id", "timestamp", "score"]
    stream = ["session_id", "channel_id"]
    named = ids.join(messages.select(*stream, *cols), [*stream, "message_id"]).select(*key, *cols)
    open_windows = windows.where(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0).select(*key)
    timed = points_in_windows(open_windows, messages.select(*stream, *cols), stream, ("window_start", "window_end"), "timestamp", width)
    every = named.unionByName(timed.select(*key, *cols))
    w = Window.partitionBy(*key).orderBy(F.abs("score").desc(), "timestamp", "message_id")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def resolve_evidence(windows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Evidence ids as rows: the transcript text for ``transcript:<time>`` ids, a chat reference otherwise."""
    refs = windows.select("session_id", "channel_id", "window_start", "window_end", F.posexplode("evidence_ids").alias("pos", "evidence_id")).where(F.col("evidence_id") != "")
    speech = F.col("evidence_id").startswith("transcript:")
    at = F.when(speech, F.substring("evidence_id", 12, 64).try_cast("timestamp"))
    t = transcripts.select("session_id", "channel_id", F.col("bucket_start").alias("_at"), strip("text").alias("text"))
    j = refs.withColumn("_at", at).join(t, ["session_id", "channel_id", "_at"], "left")
    source = F.when(F.col("text").isNotNull(), "transcript").when(speech, "unknown").otherwise("chat")
    return j.select("session_id", "channel_id", "window_start", "window_end", "pos", "evidence_id", source.alias("source"), "text")


# --- manifests and word errors ----------------------------------------------


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9']+"), lambda w: w != "")


def speech_words(text: Column) -> Column:
    """Words reduced to letters and digits, empty ones dropped."""
    parts = F.split(collapse_spaces(F.lower(text)), " ")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: w != "")


def word_edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two word arrays.

    The distinct words of the pair become code points (from 256 on, without the surrogates), so the built-in distance of
    strings counts words. They are bound once per pair: an expression inside a lambda is worked out for every word.
    """

    def coded(given: Column, known: Column) -> Column:
        def point(w: Column) -> Column:
            n = F.array_position(known, w) + 255
            return F.lpad(F.hex(F.when(n < 0xD800, n).otherwise(n + 0x800)), 8, "0")

        return F.decode(F.unhex(F.array_join(F.transform(given, point), "")), "UTF-32")

    known = F.array(F.array_distinct(F.concat(left, right)))
    return F.transform(known, lambda k: F.levenshtein(coded(left, k), coded(right, k)))[0].cast("long")


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs dealt to all shuffle partitions: few bytes of text are much work, so sizes of files or joins don't tell it."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def word_error_rate(pairs: DataFrame, reference: str = "reference_text", hypothesis: str = "hypothesis") -> DataFrame:
    """Distance and rate per pair; the pairs are a table, so the work is spread over its rows."""
    w = spread(pairs).withColumns({"_r": words(F.col(reference)), "_h": words(F.col(hypothesis))})
    w = w.withColumn("word_distance", word_edit_distance(F.col("_r"), F.col("_h")))
    n = F.size("_r")
    rate = F.when(n == 0, F.when(F.size("_h") == 0, 0.0).otherwise(1.0)).otherwise(ratio(F.col("word_distance"), n))
    return w.withColumn("wer", rate).drop("_r", "_h")


def repair_change(pairs: DataFrame, live: str, final: str) -> DataFrame:
    """Added words and changed share of a repaired transcript."""
    w = spread(pairs).withColumns({"_l": speech_words(F.col(live)), "_f": speech_words(F.col(final))})
    w = w.withColumn("_d", word_edit_distance(F.col("_l"), F.col("_f")))
    longest = F.greatest(F.size("_l"), F.size("_f"))
    return w.withColumns(
        {
            "repair_added_words": F.greatest(F.lit(0), F.size("_f") - F.size("_l")).cast("long"),
            "repair_changed_ratio": F.coalesce(ratio(F.col("_d"), longest), F.lit(0.0)),
        }
    ).drop("_l", "_f", "_d")


def manifest_summary(records: DataFrame) -> DataFrame:
    """Per task: records, counts of the gold labels, outputs present, missing ids, accuracy.

    ``records``: task, example_id, gold, predicted, has_output. Manifests of speech also carry audio_available and
    reference_text; their summary tells how many recordings and reference texts there are.
    """
    both = (F.coalesce("gold", F.lit("")) != "") & (F.coalesce("predicted", F.lit("")) != "")
    right = F.count_if(both & (F.col("gold") == F.col("predicted")))
    speech = []
    if {"audio_available", "reference_text"} <= set(records.columns):
        there = F.coalesce("audio_available", F.lit(False))
        speech = [
            F.count_if(there).alias("audio_available"), F.count_if(~there).alias("audio_missing"),
            F.count_if(strip(F.coalesce("reference_text", F.lit(""))) != "").alias("reference_text_count"),
        ]
    out = records.groupBy("task").agg(
        F.count("*").alias("records"),
        F.count_if("has_output").alias("model_outputs_present"),
        F.count_if(~F.col("has_output")).alias("model_outputs_missing"),
        F.count_if(both).alias("evaluated_records"),
        round_half_away(ratio(right, F.count_if(both)), 4).alias("accuracy"),
        *speech,
    )
    ids = records.where(~F.col("has_output")).groupBy("task").agg(F.array_sort(F.collect_list("example_id")).alias("missing_examples"))
    status = F.when(F.col("evaluated_records") > 0, "computed").otherwise("pending_model_outputs")
    return out.join(ids, "task", "left").join(count_map(records, ["task"], "gold", "label_counts"), "task", "left").withColumn("status", status)


def manifest_confusion(records: DataFrame) -> DataFrame:
    both = (F.coalesce("gold", F.lit("")) != "") & (F.coalesce("predicted", F.lit("")) != "")
    return records.where(both).groupBy("task", "gold", "predicted").agg(F.count("*").alias("count"))
