"""Detections against human labels: confusion, precision, recall, F1, onset latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.lexicons import EVENT_LABELS
from crowdtide.functions.numbers import f1_of, ratio, ratio_or_zero, round_half_away
from crowdtide.functions.text import first_non_empty, key_text
from crowdtide.operators.filters import label_validity
from crowdtide.operators.signals import EVENT_TYPE

KEY = ["session_id", "window_start", "window_end"]


def reaction_event(kind: Column, score: Column, confidence: Column) -> Column:
    """Event type of a reaction window; '' when both score and confidence are weak."""
    k = key_text(kind)
    named = (
        F.when(k == "hype", "hype_spike")
        .when(k == "frustration", "frustration_spike")
        .when(k.isin("confusion", "surprise"), "audience_shift")
        .otherwise("")
    )
    return F.when((F.coalesce(score, F.lit(0.0)) < 0.35) & (F.coalesce(confidence, F.lit(0.0)) < 0.35), "").otherwise(named)


def reaction_event_time(peak: Column, start: Column, end: Column) -> Column:
    """The bucket's peak when it lies in the window, else the window end."""
    return F.when(peak.between(start, end), peak).otherwise(end)


def subwindow_windows(buckets: DataFrame) -> DataFrame:
    """Nested reaction windows as evaluation windows with at most one event."""
    s = buckets.withColumn("s", F.explode("subwindows")).where(F.col("s.window_start").isNotNull() & F.col("s.window_end").isNotNull())
    kind = reaction_event(F.col("s.reaction_type"), F.col("s.reaction_score"), F.col("s.confidence"))
    target = F.coalesce(first_non_empty(F.trim("s.target_type")), F.lit("unknown"))
    event = F.struct(
        kind.alias("type"), F.col("s.reaction_score").alias("severity"),
        reaction_event_time(F.col("peak_time"), F.col("s.window_start"), F.col("s.window_end")).alias("timestamp"), F.col("s.reaction_type"),
        target.alias("target_type"), F.col("s.target_text"), F.coalesce(first_non_empty(F.col("s.source")), F.lit("chat")).alias("source"),
        F.col("s.event_hint"), F.lit("").alias("text"), F.col("s.confidence"), F.col("s.evidence_ids"),
    )
    return s.select(
        "session_id", "channel_id", F.col("s.window_start").alias("window_start"), F.col("s.window_end").alias("window_end"), kind.alias("first_event_type"),
        F.when(kind != "", F.array(event)).otherwise(F.array()).cast(EVENT_TYPE).alias("events"), F.col("s.reaction_type").alias("reaction_type"),
        target.alias("target_type"), F.coalesce("s.target_text", F.lit("")).alias("target_text"),
    )


def evaluation_windows(signal_windows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Signal windows and nested reaction windows; on the same range the reaction window wins."""
    cols = ["session_id", "channel_id", "window_start", "window_end", "first_event_type", "events", "reaction_type", "target_type", "target_text"]
    both = signal_windows.select(*cols, F.lit(0).alias("_p")).unionByName(subwindow_windows(buckets).select(*cols, F.lit(1).alias("_p")))
    w = Window.partitionBy(*KEY).orderBy(F.desc("_p"), F.desc("channel_id"))
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_p")


def latest_label(labels: DataFrame) -> DataFrame:
    """Newest label per window by update, else creation time; a label without a time never replaces one with."""
    at = F.coalesce("updated_at", "created_at")
    pos = F.col("pos") if "pos" in labels.columns else F.coalesce("event_label", F.lit(""))
    w = Window.partitionBy(*KEY).orderBy(at.desc_nulls_last(), pos)
    named = labels.where((F.trim("session_id") != "") & F.col("window_start").isNotNull() & F.col("window_end").isNotNull())
    return named.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def _has_event(kind: Column) -> Column:
    return F.coalesce((F.col("first_event_type") == kind) | F.exists("events", lambda e: e["type"] == kind), F.lit(False))


def judge(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per labelled window with everything the metrics count."""
    w = windows.select(*KEY, F.struct("first_event_type", "events", "reaction_type", "target_type", "target_text").alias("w"))
    joined = label_validity(latest_label(labels)).withColumnsRenamed(
        {"reaction_type": "l_reaction", "target_type": "l_target_type", "target_text": "l_target_text"}
    ).join(w, KEY, "left")
    j = joined.withColumns(
        {
            "first_event_type": F.coalesce("w.first_event_type", F.lit("")),
            "events": F.col("w.events"),
            "matched": F.col("w").isNotNull(),
        }
    )
    first_listed = F.get(F.filter("events", lambda e: e["type"] != ""), F.lit(0))["type"]
    from_window = F.coalesce(first_non_empty(F.col("first_event_type")), first_listed, F.lit("none"))
    predicted = key_text(F.coalesce(first_non_empty(F.trim("predicted_event")), from_window))
    uncertain = F.coalesce(F.col("correctness") == "uncertain", F.lit(False))
    j = j.withColumns(
        {
            "actual": F.col("event_label"),
            "predicted": F.when(predicted == "", "none").otherwise(predicted),
            "outcome": F.when(~F.col("matched"), "unmatched").when(uncertain, "uncertain").when(~F.col("label_valid"), "invalid").otherwise("evaluated"),
        }
    )
    actual, pred = F.col("actual"), F.col("predicted")
    has, said = actual != "none", pred != "none"
    own = F.get(F.filter("events", lambda e: (key_text(e["type"]) == actual) & e["timestamp"].isNotNull()), F.lit(0))["timestamp"]
    predicted_at = F.coalesce(own, F.when(key_text(F.col("first_event_type")) == actual, F.col("window_start")))
    actual_at = F.coalesce("event_start", "event_peak", "window_start")

    def dim(c: str) -> Column:
        return key_text(F.col(c))

    event_reaction = F.get(F.filter(F.transform("events", lambda e: key_text(e["reaction_type"])), lambda r: r != ""), F.lit(0))
    said_reaction = F.coalesce(first_non_empty(dim("w.reaction_type")), event_reaction, F.lit("neutral"))

    def said_target(c: str) -> Column:
        listed = F.get(F.filter(F.transform("events", lambda e: key_text(e[c])), lambda t: t != ""), F.lit(0))
        return F.coalesce(first_non_empty(dim(f"w.{c}")), listed, F.lit(""))

    has_target = (dim("l_target_type") != "") | (dim("l_target_text") != "")
    target_ok = ((dim("l_target_type") == "") | (dim("l_target_type") == said_target("target_type"))) & (
        (dim("l_target_text") == "") | (dim("l_target_text") == said_target("target_text"))
    )
    d = dim("divergence_type")
    diverged = F.when(d.isin("diverged", "divergence", "content_audience_divergence"), True).when(
        d.isin("converged", "aligned", "none", "normal"), False
    ).otherwise(actual == "content_audience_divergence")
    return j.withColumns(
        {
            "tp": has & said & (actual == pred),
            "fp": said & (actual != pred),
            "fn": has & (actual != pred),
            "tn": ~has & ~said,
            "hype_hit": _has_event(F.lit("hype_spike")),
            "actual_hit": _has_event(actual),
            "has_peak": has & F.col("event_peak").isNotNull(),
            "onset_ms": F.when(
                has & (actual == pred), ((F.unix_micros(predicted_at) - F.unix_micros(actual_at)) / 1000).cast("long").cast("double")
            ),
            "reaction_actual": F.when(dim("l_reaction") != "", dim("l_reaction")),
            "reaction_predicted": said_reaction,
            "target_ok": F.when(has_target, target_ok),
            "divergence_ok": diverged == _has_event(F.lit("content_audience_divergence")),
        }
    )


def _evaluated(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("outcome") == "evaluated")


def event_confusion(judged: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(x) for x in EVENT_LABELS]), F.col("actual"))
    counts = _evaluated(judged).groupBy("session_id", "actual", "predicted").agg(F.count("*").alias("count"))
    return counts.withColumn("actual_rank", F.when(rank > 0, rank - 1).otherwise(len(EVENT_LABELS)))


def event_binary_counts(judged: DataFrame) -> DataFrame:
    return _evaluated(judged).groupBy("session_id").agg(
        *[F.count_if(c).alias(n) for n, c in (("true_positive", "tp"), ("false_positive", "fp"), ("false_negative", "fn"), ("true_negative", "tn"))]
    )


def with_precision_recall(counts: DataFrame) -> DataFrame:
    """Zero, not NULL, for an empty denominator; F1 from the rounded precision and recall."""
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return counts.withColumns({"precision": ratio_or_zero(tp, tp + fp), "recall": ratio_or_zero(tp, tp + fn)}).withColumn(
        "f1", f1_of(F.col("precision"), F.col("recall"))
    )


def class_metrics(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Support, predictions, hits and misses per session and class, from one unpivot."""
    sides = F.array(
        F.struct(F.col(actual).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")),
    )
    same = F.col(actual) == F.col(predicted)
    long = rows.select("session_id", same.alias("same"), F.explode(sides).alias("s"))
    counts = long.groupBy("session_id", F.col("s.label").alias("label")).agg(
        F.sum("s.a").alias("support"),
        F.sum("s.p").alias("predicted_count"),
        F.count_if((F.col("s.a") == 1) & F.col("same")).alias("true_positive"),
        F.count_if((F.col("s.p") == 1) & ~F.col("same")).alias("false_positive"),
        F.count_if((F.col("s.a") == 1) & ~F.col("same")).alias("false_negative"),
    )
    return with_precision_recall(counts)


def per_label_metrics(judged: DataFrame) -> DataFrame:
    """Metrics of the five known labels for every session, even unseen ones, plus any other label met."""
    ev = _evaluated(judged)
    found = class_metrics(ev, "actual", "predicted")
    known = judged.select("session_id").distinct().withColumn("label", F.explode(F.array(*[F.lit(x) for x in EVENT_LABELS])))
    zero = [c for c in found.columns if c not in ("session_id", "label")]
    return known.join(found, ["session_id", "label"], "full").na.fill(0, zero)


def macro_f1(metrics: DataFrame) -> DataFrame:
    seen = metrics.where((F.col("support") > 0) | (F.col("predicted_count") > 0))
    return seen.groupBy("session_id").agg(round_half_away(F.avg("f1"), 4).alias("macro_f1"))


def peak_recall(judged: DataFrame) -> DataFrame:
    ev = _evaluated(judged)
    hype = F.col("actual") == "hype_spike"
    out = ev.groupBy("session_id").agg(
        round_half_away(ratio(F.count_if(hype & F.col("hype_hit")), F.count_if(hype)), 4).alias("hype_peak_recall"),
        round_half_away(ratio(F.count_if(F.col("has_peak") & F.col("actual_hit")), F.count_if("has_peak")), 4).alias("_peak"),
    )
    return out.withColumn("peak_recall", F.coalesce("_peak", "hype_peak_recall")).drop("_peak")


def onset_latency(judged: DataFrame) -> DataFrame:
    return _evaluated(judged).groupBy("session_id").agg(round_half_away(F.avg("onset_ms"), 4).alias("onset_latency_ms"))


def dimension_accuracy(judged: DataFrame) -> DataFrame:
    same = F.col("reaction_actual") == F.col("reaction_predicted")
    return _evaluated(judged).groupBy("session_id").agg(
        round_half_away(F.avg(same.cast("int")), 4).alias("reaction_type_accuracy"),
        round_half_away(F.avg(F.col("target_ok").cast("int")), 4).alias("target_accuracy"),
        round_half_away(F.avg(F.col("divergence_ok").cast("int")), 4).alias("divergence_accuracy"),
    )


def reaction_type_f1(judged: DataFrame) -> DataFrame:
    rows = _evaluated(judged).where(F.col("reaction_actual").isNotNull())
    return macro_f1(class_metrics(rows, "reaction_actual", "reaction_predicted")).withColumnRenamed("macro_f1", "reaction_type_f1")


def session_evaluation(windows: DataFrame, labels: DataFrame) -> DataFrame:
    """All metrics of a session in one row, from a single aggregation over the judged labels."""
    judged = judge(windows, labels)
    ev = F.col("outcome") == "evaluated"
    hype = ev & (F.col("actual") == "hype_spike")
    peak = ev & F.col("has_peak")

    def outcome(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    def share(c: Column) -> Column:
        return round_half_away(F.avg(F.when(ev, c.cast("int"))), 4)

    agg = judged.groupBy("session_id").agg(
        F.count("*").alias("total_labeled_windows"),
        outcome("evaluated").alias("evaluated_windows"),
        outcome("unmatched").alias("unmatched_labels"),
        outcome("uncertain").alias("uncertain_labels"),
        outcome("invalid").alias("invalid_labels"),
        *[F.count_if(ev & F.col(c)).alias(n) for n, c in (("true_positive", "tp"), ("false_positive", "fp"), ("false_negative", "fn"), ("true_negative", "tn"))],
        F.count_if(ev & (F.col("actual") == "none") & (F.col("predicted") != "none")).alias("false_positives_normal_chat"),
        share(F.col("actual") == F.col("predicted")).alias("event_accuracy"),
        round_half_away(ratio(F.count_if(hype & F.col("hype_hit")), F.count_if(hype)), 4).alias("hype_peak_recall"),
        round_half_away(ratio(F.count_if(peak & F.col("actual_hit")), F.count_if(peak)), 4).alias("_peak"),
        round_half_away(F.avg(F.when(ev, F.col("onset_ms"))), 4).alias("onset_latency_ms"),
        share(F.col("reaction_actual") == F.col("reaction_predicted")).alias("reaction_type_accuracy"),
        share(F.col("target_ok")).alias("target_accuracy"),
        share(F.col("divergence_ok")).alias("divergence_accuracy"),
    )
    n = F.col("evaluated_windows")
    scored = with_precision_recall(agg)
    scored = scored.withColumns({f"event_{c}": F.when(n > 0, F.col(c)) for c in ("precision", "recall", "f1")}).drop("precision", "recall", "f1")
    totals = windows.select(*KEY).distinct().groupBy("session_id").agg(F.count("*").alias("total_windows"))
    out = totals.join(scored, "session_id", "full").join(reaction_type_f1(judged), "session_id", "left")
    counts = [c for c, t in out.dtypes if t in ("bigint", "int")]
    out = out.na.fill(0, counts)
    return out.withColumns(
        {
            "coverage": round_half_away(ratio(F.col("evaluated_windows"), F.col("total_windows")), 4),
            "peak_recall": F.coalesce("_peak", "hype_peak_recall"),
        }
    ).drop("_peak")


# --- baseline comparison ----------------------------------------------------

# metric, kind of rule, default tolerance: fixed values
RULES = (
    ("proof_label_coverage", "drop", 0.0), ("evaluation_coverage", "drop", 0.0), ("event_accuracy", "drop", 0.0),
    ("event_precision", "drop", 0.0), ("event_recall", "drop", 0.0), ("event_f1", "drop", 0.0), ("peak_recall", "drop", 0.0),
    ("hype_peak_recall", "drop", 0.0), ("onset_latency_ms", "increase", 0.0), ("reaction_type_f1", "drop", 0.0),
    ("reaction_type_accuracy", "drop", 0.0), ("target_accuracy", "drop", 0.0), ("target_extraction_accuracy", "drop", 0.0),
    ("divergence_accuracy", "drop", 0.0), ("transcript_bucket_coverage", "drop", 0.0), ("transcript_coverage", "drop", 0.0),
    ("transcript_audio_coverage", "drop", 0.0), ("transcript_empty_ratio", "increase", 0.0),
    ("transcript_repair_improvement", "drop", 0.0), ("transcript_repair_changed_ratio", "increase", 0.0),
    ("transcript_repair_added_words", "increase", 0.0), ("total_windows", "count", 0.0), ("total_labeled_windows", "count", 0.0),
    ("evaluated_windows", "count", 0.0), ("reaction_window_count", "count", 0.0), ("peak_reaction_count", "count", 0.0),
    ("transcript_word_count", "count", 0.0), ("alignment_count", "count", 0.0), ("matched_window_count", "count", 0.0),
    ("persistence_metric_count", "count", 0.0), ("unmatched_labels", "increase", 0.0), ("invalid_labels", "increase", 0.0),
    ("false_positives_normal_chat", "increase", 0.0), ("storage_write_failures", "increase", 0.0),
    ("storage_dropped_writes", "increase", 0.0), ("storage_queue_depth", "increase", 0.0),
    ("reaction_window_metric_count", "drop", 0.0), ("truncated_source_count", "flag", 0.0), ("partial", "flag", 0.0),
    ("latency_p95_ms.chat_analysis", "increase", 0.0), ("latency_p95_ms.transcript_sentiment", "increase", 0.0),
    ("latency_p95_ms.transcript_asr", "increase", 0.0), ("latency_p95_ms.transcript_pipeline", "increase", 0.0),
)
TOLERANCE = 1e-7


def compare_to_baseline(current: DataFrame, baseline: DataFrame, thresholds: dict[str, float] | None = None, rules=RULES) -> DataFrame:
    """Regressions of long-format metrics (session_id, name, value) against a baseline.

    A dropped or grown metric beyond its tolerance, a lower count, a missing metric or a missing session is a
    regression. The rules are a literal map, so only the two metric tables are joined.
    """
    limits = thresholds or {}
    kind = F.create_map(*[F.lit(v) for m, k, _ in rules for v in (m, k)])
    limit = F.create_map(*[F.lit(v) for m, _, d in rules for v in (m, float(limits.get(m, d)))])
    b = baseline.select("session_id", "name", F.col("value").alias("baseline"))
    c = current.select("session_id", "name", F.col("value").alias("current"))
    alive = current.select("session_id").distinct().withColumn("_alive", F.lit(True))
    gone = (
        baseline.select("session_id")
        .distinct()
        .join(alive, "session_id", "left_anti")
        .select("session_id", F.lit("session").alias("name"), *[F.lit(None).cast("double").alias(x) for x in ("baseline", "current", "threshold")], F.lit("missing_session").alias("reason"))
    )
    j = b.join(c, ["session_id", "name"], "left").join(alive, "session_id", "left_semi")
    j = j.withColumns({"kind": F.try_element_at(kind, F.col("name")), "threshold": F.try_element_at(limit, F.col("name"))})
    base, cur, tol = F.col("baseline"), F.col("current"), F.col("threshold") + TOLERANCE
    countlike = F.col("kind").isin("count", "flag")
    reason = (
        F.when(base.isNull() | F.col("kind").isNull(), None)
        .when((F.col("kind") == "count") & (base > 0) & (F.coalesce(cur, F.lit(0.0)) < base), "count_drop")
        .when((F.col("kind") == "flag") & (cur > base), "increase")
        .when(cur.isNull() & ~countlike, "missing")
        .when((F.col("kind") == "drop") & (base - cur > tol), "drop")
        .when((F.col("kind") == "increase") & (cur - base > tol), "increase")
    )
    found = j.withColumn("reason", reason).where(F.col("reason").isNotNull())
    return found.select("session_id", "name", "baseline", "current", "threshold", "reason").unionByName(gone)
