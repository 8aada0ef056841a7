"""Whole-session reports assembled from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide.functions.numbers import ratio, round_half_away
from crowdtide.operators import correlation, evaluation, proof, signals
from crowdtide.sources.storage import settle

STORAGE_METRICS = {
    "storage_write_failures": "storage.write_failures",
    "storage_dropped_writes": "storage.dropped_writes",
    "storage_queue_depth": "storage.queue_depth",
    "reaction_window_metric_count": "reaction_window.count",
}

SUMMARY = (
    "proof_label_coverage", "evaluation_coverage", "event_accuracy", "event_precision", "event_recall", "event_f1", "peak_recall",
    "hype_peak_recall", "onset_latency_ms", "reaction_type_accuracy", "reaction_type_f1", "target_accuracy", "target_extraction_accuracy",
    "divergence_accuracy", "false_positives_normal_chat", "total_windows", "total_labeled_windows", "evaluated_windows", "unmatched_labels",
    "uncertain_labels", "invalid_labels", "reaction_window_count", "peak_reaction_count", "transcript_bucket_coverage", "transcript_coverage",
    "transcript_audio_coverage", "transcript_empty_ratio", "transcript_word_count", "transcript_repair_added_words",
    "transcript_repair_changed_ratio", "transcript_repair_improvement", "alignment_count", "matched_window_count", "persistence_metric_count",
    *STORAGE_METRICS, "truncated_source_count", "partial",
    "latency_p95_ms.chat_analysis", "latency_p95_ms.transcript_asr", "latency_p95_ms.transcript_pipeline", "latency_p95_ms.transcript_sentiment",
)


def analyze_sessions(chat: DataFrame, transcripts: DataFrame, alignments: DataFrame, width: int = 30) -> DataFrame:
    """Signal windows of stored sessions."""
    return signals.signal_windows(chat, alignments, transcripts, width)


def session_report(
    sessions: DataFrame, chat: DataFrame, transcripts: DataFrame, alignments: DataFrame, labels: DataFrame, metrics: DataFrame, width: int = 30
) -> DataFrame:
    """One row of audit and evaluation metrics per session."""
    sid = "session_id"
    windows = evaluation.evaluation_windows(analyze_sessions(chat, transcripts, alignments, width), chat)
    judged = evaluation.session_evaluation(windows, labels).withColumnRenamed("coverage", "evaluation_coverage")
    audit = proof.session_proof(sessions, chat, transcripts, alignments, labels).drop("unmatched_labels")
    named = metrics.groupBy(sid, "name").agg(F.max_by("value", F.struct("recorded_at", "value")).alias("value"), F.count("*").alias("n"))
    stored = named.groupBy(sid).agg(
        F.sum("n").alias("persistence_metric_count"), *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(c) for c, n in STORAGE_METRICS.items()]
    )
    recorded = sessions.select(sid, F.col("transcript_bucket_count").alias("_recorded"))
    out = audit.join(judged, sid, "left").join(stored, sid, "left").join(recorded, sid, "left")
    loaded = F.col("loaded_transcript_bucket_count")

    def share(total: Column) -> Column:
        return round_half_away(ratio(loaded, F.when(total > 0, total)), 4)

    p95 = {f"latency_p95_ms.{n}": F.col(f"{n}_latency.p95") for n in proof.LATENCIES}
    wide = out.withColumns(
        {
            "proof_label_coverage": F.col("label_coverage"),
            "target_extraction_accuracy": F.col("target_accuracy"),
            "transcript_bucket_coverage": share(F.coalesce(F.when(F.col("_recorded") > 0, F.col("_recorded")), loaded)),
            "transcript_coverage": F.coalesce("transcript_audio_coverage", share(F.col("transcript_bucket_count"))),
            "transcript_repair_changed_ratio": F.col("transcript_average_repair_changed_ratio"),
            "alignment_count": F.col("loaded_alignment_count"),
            "matched_window_count": F.col("matched_windows"),
            "truncated_source_count": F.size("truncated_sources"),
            **p95,
        }
    )
    return wide.select(sid, "channel_id", *[F.col(f"`{c}`") for c in SUMMARY]).na.fill(0, ["persistence_metric_count", "reaction_window_count", "peak_reaction_count"])


def report_metrics(report: DataFrame) -> DataFrame:
    """The report as long-format (session_id, name, value) rows, ready for the baseline comparison."""
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in SUMMARY])
    return report.select("session_id", F.inline(items)).where(F.col("value").isNotNull())


def correlation_report(chat: DataFrame, transcripts: DataFrame, pairs: DataFrame, lagged: DataFrame, lags: Sequence[int], config: correlation.CohortConfig | None = None, sample: int = 10) -> DataFrame:
    """How chat and speech go together over all sessions, as one row of nested sections.

    ``pairs``: ``correlation.sentiment_pairs``, stored; ``lagged``: ``alignment.lag_pairs``, stored. Each section is one
    row, or one for each of the five cohorts, the lags and the sampled pairs, before it is put in.
    """
    cfg = config or correlation.CohortConfig()

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.first(F.struct(*df.columns)).alias(name))

    def many(df: DataFrame, name: str, *order: str) -> DataFrame:
        rest = [c for c in df.columns if c not in order]

        def place(x: Column) -> Column:
            return F.struct(*[x[c].alias(c) for c in order])

        # maps have no order, so the places alone are compared
        rows = F.collect_list(F.struct(*order, F.struct(*rest).alias("figures")))
        return df.agg(F.array_sort(rows, lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)).alias(name))

    heard = correlation.source_data_quality(transcripts).where("session_id IS NULL").drop("session_id")
    seen = chat.agg(F.count("*").alias("chat_bucket_count"))
    weak = correlation.pair_data_quality(pairs, cfg, by_session=False)
    people = chat.select("session_id").unionByName(transcripts.select("session_id")).agg(F.countDistinct("session_id").alias("session_count"))
    quality = people.crossJoin(seen).crossJoin(heard).crossJoin(weak)
    cohorts = settle(correlation.cohort_summary(pairs, (), cfg), "cohorts")
    by_lag = settle(correlation.lag_summary(lagged, lags), "by_lag")
    sampled = correlation.validation_sample(pairs, sample).select("sample_cohort", "place", "session_id", "channel_id", "window_start", "window_end", "delta", "quality")
    sections = [
        one(quality, "data_quality"),
        many(cohorts, "aggregate", "cohort"),
        one(correlation.compare_cohorts(cohorts), "comparison"),
        one(correlation.calibrate_threshold(pairs, (), cfg), "calibration"),
        many(by_lag.drop("best"), "lag_analysis", "lag_seconds"),
        by_lag.where("best").agg(F.first("lag_seconds").alias("best_lag")),
        one(correlation.negative_control(pairs, (), cfg.minimum_pairs), "negative_control"),
        many(sampled, "validation_sample", "sample_cohort", "place"),
    ]
    report = sections[0]
    for section in sections[1:]:
        report = report.crossJoin(section)  # single rows
    return report
