"""A small stored session, read from a document and carried through audit, evaluation and comparison."""

import json

import pytest
from pyspark.sql import functions as F

from crowdtide import schemas
from crowdtide.operators import evaluation, proof, reviews
from crowdtide.plans import reports
from crowdtide.sources import replays


def stamp(s):
    return f"2026-01-01T12:{s // 60:02d}:{s % 60:02d}Z"


def document():
    sub = {"window_start": stamp(40), "window_end": stamp(45), "message_count": 6, "reaction_score": 0.8, "reaction_type": "confusion",
           "target_type": "unknown", "target_text": "map swap", "source": "chat", "event_hint": "confusion:map swap", "confidence": 0.7, "evidence_ids": ["m7"]}

    def chat(start, score, pos, neg, **more):
        return {"session_id": "night", "channel_id": "ch", "bucket_start": stamp(start), "bucket_end": stamp(start + 30), "message_count": 20,
                "unique_chatters": 9, "chat_sentiment": score, "sentiment_confidence": 0.8, "positive": pos, "neutral": round(1 - pos - neg, 2),
                "negative": neg, "analysis_latency_ms": 20 + start, "analysis_status": "local", **more}

    def speech(start, score, **more):
        return {"session_id": "night", "channel_id": "ch", "bucket_start": stamp(start), "bucket_end": stamp(start + 30), "text": "the new map is here today",
                "transcript_confidence": 0.9, "sentiment_score": score, "sentiment_confidence": 0.7, "sentiment_status": "local", "audio_seconds": 24,
                "asr_latency_ms": 500 + start, "empty_ratio": 0.1, **more}

    def label(start, end, event, predicted="", **more):
        return {"session_id": "night", "window_start": stamp(start), "window_end": stamp(end), "event_label": event, "predicted_event": predicted, "correctness": "correct", **more}

    return {
        "session": {"channel_id": "ch", "status": "ended", "started_at": stamp(0), "chat_bucket_count": 4, "transcript_bucket_count": 2},
        "chat_buckets": [
            chat(0, 0.7, 0.8, 0.0),
            chat(30, 0.0, 0.2, 0.2, subwindows=[sub], peak_reaction_score=0.8, peak_reaction_type="confusion", peak_time=stamp(43), peak_confidence=0.7,
                 peak_window_start=stamp(40), peak_window_end=stamp(45)),
            chat(60, 0.05, 0.2, 0.2),
        ],
        "transcript_buckets": [speech(0, 0.6), speech(30, -0.1, transcript_status="final")],
        "alignments": [],
        "window_labels": [
            label(0, 30, "hype_spike", event_peak=stamp(4)),
            label(30, 60, "none", "audience_shift"),
            label(40, 45, "audience_shift", reaction_type="Confusion", target_text="Map Swap", event_start=stamp(41)),
            label(60, 90, "", reaction_type="neutral"),
            label(300, 330, "hype_spike"),
            label(60, 90, "none", updated_at=stamp(999)),
        ],
        "system_metrics": [{"session_id": "night", "name": "storage.queue_depth", "value": v, "unit": "writes", "recorded_at": stamp(v)} for v in (3, 5)],
    }


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("doc") / "sessions.json"
    path.write_text(json.dumps({"night": document()}, indent=1))
    return replays.replay_tables(replays.read_replays(spark, str(path)).cache())


@pytest.fixture(scope="module")
def report(tables):
    t = tables
    return reports.session_report(t["sessions"], t["chat_buckets"], t["transcript_buckets"], t["alignments"], t["window_labels"], t["system_metrics"]).cache()


def test_session_takes_the_map_key(tables):
    s = tables["sessions"].first()
    assert (s["session_id"], s["label_count"]) == ("night", 6)


def test_report(report):
    r = report.first()
    assert (r["total_windows"], r["total_labeled_windows"], r["evaluated_windows"], r["unmatched_labels"]) == (4, 5, 4, 1)
    # hype found, confusion found, one false alarm from the stored prediction, one quiet window
    assert (r["event_precision"], r["event_recall"], r["event_f1"], r["event_accuracy"]) == (0.6667, 1.0, 0.8, 0.75)
    assert (r["hype_peak_recall"], r["peak_recall"], r["false_positives_normal_chat"]) == (1.0, 1.0, 1)
    # hype starts 4 s before its peak, confusion peaks 2 s after its labelled start
    assert r["onset_latency_ms"] == -1000
    assert (r["reaction_type_accuracy"], r["target_accuracy"]) == (1.0, 1.0)
    assert (r["partial"], r["truncated_source_count"], r["transcript_audio_coverage"]) == (True, 1, 0.8)
    assert (r["transcript_word_count"], r["storage_queue_depth"], r["persistence_metric_count"]) == (12, 5.0, 2)
    assert (r["reaction_window_count"], r["peak_reaction_count"]) == (1, 1)
    assert r["latency_p95_ms.chat_analysis"] == 80 and r["latency_p95_ms.transcript_asr"] == 530


def test_every_known_label_is_reported(tables):
    w = evaluation.evaluation_windows(reports.analyze_sessions(tables["chat_buckets"], tables["transcript_buckets"], tables["alignments"]), tables["chat_buckets"])
    m = {r["label"]: r for r in evaluation.per_label_metrics(evaluation.judge(w, tables["window_labels"])).collect()}
    assert len(m) == 5 and m["frustration_spike"]["support"] == 0 and m["frustration_spike"]["f1"] == 0
    assert (m["audience_shift"]["true_positive"], m["audience_shift"]["false_positive"]) == (1, 1)


def test_same_report_has_no_regressions(report):
    m = reports.report_metrics(report)
    assert evaluation.compare_to_baseline(m, m).count() == 0


def test_regressions(spark):
    schema = "session_id string, name string, value double"
    base = spark.createDataFrame([("a", "event_f1", 0.9), ("a", "total_windows", 5.0), ("a", "onset_latency_ms", 100.0), ("a", "peak_recall", 1.0), ("b", "event_f1", 1.0)], schema)
    cur = spark.createDataFrame([("a", "event_f1", 0.85), ("a", "total_windows", 4.0), ("a", "onset_latency_ms", 100.0000000001)], schema)
    got = {(r["session_id"], r["name"]): r["reason"] for r in evaluation.compare_to_baseline(cur, base).collect()}
    assert got == {("a", "event_f1"): "drop", ("a", "total_windows"): "count_drop", ("a", "peak_recall"): "missing", ("b", "session"): "missing_session"}
    assert evaluation.compare_to_baseline(cur, base, {"event_f1": 0.1}).where("name = 'event_f1'").count() == 0


def test_proof_metrics_leave_out_missing_values(tables):
    t = tables
    p = proof.session_proof(t["sessions"], t["chat_buckets"], t["transcript_buckets"], t["alignments"], t["window_labels"])
    m = {r["name"]: r["value"] for r in proof.proof_to_metrics(p).where("speed IS NULL").collect()}
    assert m["replay_proof.bucket_count"] == 5 and m["replay_proof.transcript_empty_ratio"] == 0.1
    assert "replay_proof.transcript_repair_changed_ratio" not in m
    speeds = {r["speed"]: r["value"] for r in proof.proof_to_metrics(p).where("name = 'replay_proof.estimated_replay_seconds'").collect()}
    assert speeds == {1.0: 90.0, 5.0: 18.0, 10.0: 9.0}


def test_alignment_only_sessions_get_windows(spark):
    al = spark.createDataFrame(
        [("x", "c", 0, 30, 0.8, 0.9, 5, -0.2, 0.9, 100, 1.0, 0.5, "diverged", 30, 0.7)],
        "session_id string, channel_id string, a long, b long, chat_sentiment double, chat_confidence double, chat_message_count long, transcript_sentiment double, "
        "transcript_confidence double, transcript_text_length long, delta double, similarity double, relationship string, overlap_seconds long, quality double",
    )
    for c in ("window", "chat_bucket", "transcript_bucket"):
        al = al.withColumns({f"{c}_start": F.timestamp_seconds("a"), f"{c}_end": F.timestamp_seconds("b")})
    al = al.drop("a", "b").withColumn("quality_flags", F.array().cast("array<string>"))
    none = spark.createDataFrame([], schemas.CHAT_BUCKET)
    w = reports.analyze_sessions(none, spark.createDataFrame([], schemas.TRANSCRIPT_BUCKET), al).first()
    assert (w["source"], w["reaction_type"], w["first_event_type"]) == ("alignment", "hype", "content_audience_divergence")
    assert w["confidence"] == pytest.approx(0.8)


def test_duplicate_and_nameless_sessions_fail(spark):
    for docs in ([{"session": {"session_id": "a"}}, {"session": {"session_id": " a "}}], [{"session": {}}]):
        df = spark.createDataFrame([(json.dumps(docs),)], "value string")
        with pytest.raises(Exception, match="duplicate session|empty session"):
            replays.parse_replays(df).collect()


def test_manifest_rejects_non_objects(spark):
    df = spark.createDataFrame([('{"example_id": "a", "gold_label": "positive"}',), ("",)], "value string")
    assert replays.parse_manifest(df, schemas.SENTIMENT_LABEL).first()["gold_label"] == "positive"
    with pytest.raises(Exception, match="not a JSON object"):
        replays.parse_manifest(df.unionByName(spark.createDataFrame([("[1]",)], "value string")), schemas.SENTIMENT_LABEL).collect()


def test_word_errors(spark):
    rows = [("the cat sat", "the cat sat", 0, 0.0), ("the cat sat", "a cat sat down", 2, 2 / 3), ("", "x", 1, 1.0), ("", "", 0, 0.0), ("It's a b c", "b c it's a", 4, 1.0)]
    out = reviews.word_error_rate(spark.createDataFrame(rows, "reference_text string, hypothesis string, d long, w double")).collect()
    assert all((r["word_distance"], r["wer"]) == (r["d"], pytest.approx(r["w"])) for r in out)


def test_repair_change(spark):
    df = spark.createDataFrame([("so we go", "so, we now go!")], "live string, final string")
    r = reviews.repair_change(df, "live", "final").first()
    assert (r["repair_added_words"], r["repair_changed_ratio"]) == (1, 0.25)


def test_word_errors_number_words_once_and_spread_pairs(spark):
    rows = [(" ".join(f"w{(i * k) % 97}" for k in range(60)), " ".join(f"w{(i + k) % 89}" for k in range(50))) for i in range(40)]
    df = spark.createDataFrame(rows, "reference_text string, hypothesis string").coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for out in (reviews.word_error_rate(df), reviews.repair_change(df, "reference_text", "hypothesis")):
        # the words of a pair are not numbered again for every word, and one task does not get all pairs
        assert out._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1
        assert out.rdd.getNumPartitions() == n > 1


def test_review_evidence_is_made_once_per_row(tables):
    c, t, al = (tables[x].drop("pos") for x in ("chat_buckets", "transcript_buckets", "alignments"))
    ctx = reviews.with_context(reviews.review_windows(c, al, t), c, al, t)
    out = reviews.review_rows(ctx, tables["window_labels"])
    # an item's text inside the lambda that drops repeated items would be made again for every item
    assert out.select("evidence")._jdf.queryExecution().optimizedPlan().toString().count("; quality=") == 1
    assert all(len(e) == len({(x["source"], x["id"], x["text"]) for x in e}) for (e,) in out.select("evidence").collect())


def test_reviews(tables):
    c, t, al = (tables[x].drop("pos") for x in ("chat_buckets", "transcript_buckets", "alignments"))
    ctx = reviews.with_context(reviews.review_windows(c, al, t), c, al, t)
    rows = {(r["source_window_type"], r["window_start"].minute, r["window_start"].second): r for r in reviews.review_rows(ctx, tables["window_labels"]).collect()}
    assert len(rows) == 4
    sub = rows["reaction_subwindow", 0, 40]
    assert (sub["suggested_event_label"], sub["reference_event_label"], sub["correctness"]) == ("audience_shift", "audience_shift", "correct")
    # mean of 0.7, 0.8, 0.7, 0.8 and 0.9, raised for agreeing with the label
    assert sub["confidence"] == 0.86 and sub["streamer_usefulness"] == 0.77
    assert sub["reason"].startswith("suggested audience_shift against gold label audience_shift; chat sentiment 0.00 from 20 messages; confusion subwindow score 0.80")
    assert [e["source"] for e in sub["evidence"]] == ["reaction", "transcript"]
    pre = {(r["source_window_type"], r["window_start"].minute, r["window_start"].second): r for r in reviews.prescore_reviews(ctx).collect()}
    hype, quiet, burst = pre["chat_bucket_30s", 0, 0], pre["chat_bucket_30s", 1, 0], pre["reaction_subwindow", 0, 40]
    assert (hype["suggested_event_label"], hype["reaction_type"], hype["streamer_usefulness"]) == ("hype_spike", "hype", 0.95)
    assert (quiet["suggested_event_label"], quiet["confidence"], quiet["streamer_usefulness"]) == ("none", 0.8, 0.08)
    assert (burst["suggested_event_label"], burst["confidence"], burst["event_peak"].second) == ("audience_shift", 0.8, 43)
    assert hype["review_id"] == "auto-prescore:night:chat_bucket_30s:2026-01-01T12:00:00Z:2026-01-01T12:00:30Z"
    assert (burst["target_type"], burst["target_text"], burst["predicted_event"], burst["reviewer"]) == ("unknown", "map swap", "audience_shift", "auto-prescore-agent")
    assert [(e["id"], e["source"], e["text"]) for e in hype["evidence"]] == [
        ("chat_bucket", "chat", "messages=20, unique_chatters=9, sentiment=0.70, positive=0.80, neutral=0.20, negative=0.00"),
        ("transcript_bucket", "transcript", "the new map is here today"),
    ]
    assert [(e["id"], e["text"]) for e in burst["evidence"]] == [("subwindow", "reaction_score=0.80, event_hint=confusion:map swap, target=map swap")]


def test_prescored_evidence_names_the_peak_messages(tables):
    """A reaction window brings the peak messages it names; a bucket brings all, and its alignment."""
    c, t, al = (tables[x].drop("pos") for x in ("chat_buckets", "transcript_buckets", "alignments"))
    message = lambda i: F.struct(F.lit(i).alias("message_id"), F.lit("2026-01-01 12:00:41").cast("timestamp").alias("timestamp"), F.lit("u").alias("username"), F.lit("U").alias("display_name"), F.lit(f"text {i}").alias("text"))
    c = c.withColumn("peak_evidence_messages", F.when(F.size("subwindows") > 0, F.array(message("m7"), message("m8"))))
    ctx = reviews.with_context(reviews.review_windows(c, al, t), c, al, t)
    pre = {(r["source_window_type"], r["window_start"].second, r["window_start"].minute): r for r in reviews.prescore_reviews(ctx).collect()}
    assert [e["id"] for e in pre["reaction_subwindow", 40, 0]["evidence"]] == ["m7", "subwindow"]
    bucket = pre["chat_bucket_30s", 30, 0]["evidence"]
    assert [e["id"] for e in bucket] == ["chat_bucket", "m7", "m8", "transcript_bucket"]
    assert (bucket[1]["timestamp"], bucket[1]["text"]) == ("2026-01-01T12:00:41Z", "text m7")


def test_correlation_report_of_a_small_session(spark):
    """One row whose sections hold what the operators give on their own; pairs count under each reason of exclusion."""
    from crowdtide.operators import alignment, correlation
    from tests.test_alignment import chat, speech

    scores = [-0.5, 0.0, 0.5, 0.3, -0.2, 0.6]
    c = chat(spark, [("s", i * 30, i * 30 + 30, v) for i, v in enumerate(scores)])
    t = speech(spark, [("s", i * 30, i * 30 + 30, v / 2 + (0.9 if i == 3 else 0)) for i, v in enumerate(scores)])
    labels = spark.createDataFrame([], schemas.WINDOW_LABEL)
    cfg = correlation.CohortConfig()
    pairs = correlation.sentiment_pairs(alignment.align(c, t, 30), labels, cfg, 30)
    report = reports.correlation_report(c, t, pairs, alignment.lag_pairs(c, t), alignment.DEFAULT_LAGS, cfg, 2).collect()
    assert len(report) == 1
    r = report[0]
    assert (r["data_quality"]["session_count"], r["data_quality"]["chat_bucket_count"], r["data_quality"]["alignment_pair_count"]) == (1, 6, 6)
    assert r["data_quality"]["baseline_exclusion_counts"].get("detected_divergence") == 1
    assert {a["cohort"]: a["figures"]["pair_count"] for a in r["aggregate"]}["all_aligned"] == 6
    want = correlation.lag_summary(alignment.lag_pairs(c, t), alignment.DEFAULT_LAGS).where("best").first()["lag_seconds"]
    assert r["best_lag"] == want and len(r["lag_analysis"]) == 5
    assert r["calibration"]["baseline_pair_count"] == r["data_quality"]["baseline_pair_count"]
    assert {(v["sample_cohort"], v["place"]) for v in r["validation_sample"]} <= {("detected_divergence", 1), ("stable_baseline", 1), ("stable_baseline", 2)}
    empty = reports.correlation_report(c.limit(0), t.limit(0), pairs.limit(0), alignment.lag_pairs(c, t).limit(0), alignment.DEFAULT_LAGS, cfg).collect()
    assert len(empty) <= 1
