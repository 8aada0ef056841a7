"""Explicit schemas of the domain tables; nothing is inferred."""

from __future__ import annotations

CHAT_MESSAGE = (
    "session_id STRING, channel_id STRING, message_id STRING, timestamp TIMESTAMP, username STRING, display_name STRING, "
    "text STRING, emotes ARRAY<STRING>, badges ARRAY<STRING>, language STRING, is_mod BOOLEAN, is_bot_likely BOOLEAN"
)

SUBWINDOW = (
    "window_start TIMESTAMP, window_end TIMESTAMP, message_count BIGINT, reaction_score DOUBLE, hype_score DOUBLE, "
    "intensity_score DOUBLE, confusion_score DOUBLE, frustration_score DOUBLE, reaction_type STRING, target_type STRING, "
    "target_text STRING, source STRING, event_hint STRING, confidence DOUBLE, evidence_ids ARRAY<STRING>"
)

CHAT_BUCKET = (
    "session_id STRING, channel_id STRING, bucket_start TIMESTAMP, bucket_end TIMESTAMP, message_count BIGINT, "
    "unique_chatters BIGINT, chat_sentiment DOUBLE, sentiment_confidence DOUBLE, analyzed_count BIGINT, positive DOUBLE, "
    "neutral DOUBLE, negative DOUBLE, sentiment_model STRING, analysis_latency_ms BIGINT, analysis_status STRING, "
    "language_mix MAP<STRING,DOUBLE>, top_terms ARRAY<STRING>, top_emotes ARRAY<STRING>, "
    "message_scores ARRAY<STRUCT<message_id STRING, timestamp TIMESTAMP, username STRING, display_name STRING, text STRING, "
    "label STRING, confidence DOUBLE, sentiment_score DOUBLE, human_label STRING>>, "
    "peak_reaction_score DOUBLE, peak_reaction_type STRING, peak_target_type STRING, peak_target_text STRING, peak_source STRING, "
    "peak_event_hint STRING, peak_confidence DOUBLE, peak_evidence_ids ARRAY<STRING>, peak_time TIMESTAMP, "
    "peak_window_start TIMESTAMP, peak_window_end TIMESTAMP, "
    f"subwindows ARRAY<STRUCT<{SUBWINDOW}>>, "
    "peak_evidence_messages ARRAY<STRUCT<message_id STRING, timestamp TIMESTAMP, username STRING, display_name STRING, text STRING>>"
)

TRANSCRIPT_BUCKET = (
    "session_id STRING, channel_id STRING, bucket_start TIMESTAMP, bucket_end TIMESTAMP, audio_started_at TIMESTAMP, "
    "audio_ended_at TIMESTAMP, transcribed_at TIMESTAMP, text STRING, language STRING, transcript_confidence DOUBLE, "
    "transcript_status STRING, sentiment_score DOUBLE, sentiment_confidence DOUBLE, sentiment_label STRING, sentiment_model STRING, "
    "sentiment_status STRING, sentiment_latency_ms BIGINT, asr_latency_ms BIGINT, pipeline_latency_ms BIGINT, audio_seconds DOUBLE, "
    "segment_count BIGINT, word_count BIGINT, empty_ratio DOUBLE, repair_added_words BIGINT, repair_changed_ratio DOUBLE, "
    "segments ARRAY<STRUCT<start DOUBLE, end DOUBLE, text STRING, confidence DOUBLE, "
    "words ARRAY<STRUCT<start DOUBLE, end DOUBLE, text STRING, probability DOUBLE>>>>, quality STRING"
)

ALIGNMENT = (
    "session_id STRING, channel_id STRING, window_start TIMESTAMP, window_end TIMESTAMP, chat_bucket_start TIMESTAMP, "
    "chat_bucket_end TIMESTAMP, transcript_bucket_start TIMESTAMP, transcript_bucket_end TIMESTAMP, chat_sentiment DOUBLE, "
    "chat_confidence DOUBLE, chat_message_count BIGINT, transcript_sentiment DOUBLE, transcript_confidence DOUBLE, "
    "transcript_text_length BIGINT, delta DOUBLE, similarity DOUBLE, relationship STRING, overlap_seconds BIGINT, quality DOUBLE, "
    "quality_flags ARRAY<STRING>"
)

WINDOW_LABEL = (
    "session_id STRING, window_start TIMESTAMP, window_end TIMESTAMP, predicted_event STRING, predicted_relationship STRING, "
    "reaction_type STRING, target_type STRING, target_text STRING, divergence_type STRING, event_start TIMESTAMP, "
    "event_peak TIMESTAMP, correctness STRING, event_label STRING, notes STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)

AGENT_REVIEW = (
    "review_id STRING, run_id STRING, session_id STRING, window_start TIMESTAMP, window_end TIMESTAMP, source_window_type STRING, "
    "reviewer STRING, model STRING, prompt_version STRING, status STRING, predicted_event STRING, suggested_event_label STRING, "
    "correctness STRING, reaction_type STRING, target_type STRING, target_text STRING, divergence_type STRING, event_start TIMESTAMP, "
    "event_peak TIMESTAMP, confidence DOUBLE, streamer_usefulness DOUBLE, reason STRING, "
    "evidence ARRAY<STRUCT<id STRING, source STRING, timestamp STRING, text STRING, meta STRING>>, notes STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

HUMAN_LABEL = "session_id STRING, message_id STRING, label STRING, created_at TIMESTAMP"

SYSTEM_METRIC = "session_id STRING, name STRING, value DOUBLE, unit STRING, recorded_at TIMESTAMP, meta STRING"

SESSION = (
    "session_id STRING, channel_id STRING, twitch_stream_id STRING, status STRING, started_at TIMESTAMP, ended_at TIMESTAMP, "
    "stream_title STRING, stream_game STRING, stream_viewer_count BIGINT, chat_bucket_count BIGINT, transcript_bucket_count BIGINT, "
    "alignment_count BIGINT, label_count BIGINT"
)

REPLAY = (
    f"session STRUCT<{SESSION}>, chat_buckets ARRAY<STRUCT<{CHAT_BUCKET}>>, transcript_buckets ARRAY<STRUCT<{TRANSCRIPT_BUCKET}>>, "
    f"alignments ARRAY<STRUCT<{ALIGNMENT}>>, window_labels ARRAY<STRUCT<{WINDOW_LABEL}>>, agent_reviews ARRAY<STRUCT<{AGENT_REVIEW}>>, "
    f"system_metrics ARRAY<STRUCT<{SYSTEM_METRIC}>>, label_count BIGINT"
)

ENVELOPE = (
    "schema_version STRING, event_id STRING, event_type STRING, event_schema_version STRING, source STRING, session_id STRING, "
    "channel_id STRING, occurred_at TIMESTAMP, payload STRING"
)

SENTIMENT_LABEL = (
    "example_id STRING, session_id STRING, message_id STRING, timestamp TIMESTAMP, language STRING, text STRING, gold_label STRING, "
    "gold_score DOUBLE, model_output STRUCT<label STRING, score DOUBLE, confidence DOUBLE>"
)

ASR_MANIFEST = (
    "example_id STRING, session_id STRING, segment_start TIMESTAMP, segment_end TIMESTAMP, expected_duration_seconds DOUBLE, "
    "language STRING, audio_available BOOLEAN, reference_text STRING, model_output STRUCT<text STRING, confidence DOUBLE, asr_latency_ms BIGINT>"
)
