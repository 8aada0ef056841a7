import json
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from crowdtide.operators import captions, transcripts
from crowdtide.sources import chat_log, contracts, envelopes, storage
from tests.helpers import at, epoch

LINE = (
    "@badge-info=;badges=moderator/1,subscriber/12;display-name=Some\\sOne;emotes=25:6-10/x:90-95;id=abc;login=someone;"
    "mod=0;tmi-sent-ts=1767268800123 :someone!someone@host PRIVMSG #Channel :hello Kappa a:b : c"
)


def test_chat_line(spark):
    lines = [LINE, ":srv PING", "PRIVMSG", "@a=b :chatbot!x@y PRIVMSG #ch :hi", "@id= :u!x PRIVMSG #ch"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = chat_log.parse_chat_log(df, "s", received=F.lit(at(0))).collect()
    assert len(rows) == 3
    a, b, c = rows
    assert (a["channel_id"], a["message_id"], a["username"], a["display_name"]) == ("channel", "abc", "someone", "Some One")
    assert a["text"] == "hello Kappa a:b : c" and a["emotes"] == ["Kappa", "x"] and a["badges"] == ["moderator", "subscriber"] and a["is_mod"]
    assert b["is_bot_likely"] and b["message_id"].startswith("ch-chatbot-") and b["emotes"] == []
    assert c["text"] == ""


def test_envelope_round_trip_and_unknown_fields(spark):
    payload = '{"type":"chat_bucket","session_id":"s","channel_id":"c","bucket_start":"2026-01-01T12:00:00Z","bucket_end":"2026-01-01T12:00:30Z"}'
    made = envelopes.make_envelope(spark.createDataFrame([(payload,)], "payload string"), "chat_bucket", "svc")
    row = made.first()
    assert row["key"] == "chat_bucket:s:c:2026-01-01T12:00:00Z:2026-01-01T12:00:30Z" and len(row["event_id"]) == 32
    good = envelopes.decode_envelope(made.select("value"))
    assert envelopes.validate_envelope(good).first()["errors"] == []
    extra = json.loads(row["value"]) | {"surprise": 1}
    bad = spark.createDataFrame([(json.dumps(extra),), ("nope",)], "value string")
    errors = [r["decode_error"] for r in envelopes.decode_envelope(bad).collect()]
    assert "surprise" in errors[0] and "not a JSON object" in errors[1]


def test_upsert_policies(spark):
    schema = "k long, v long, status string, seen long, rank long, note string"
    old = spark.createDataFrame([(1, 1, "live", 10, 5, "first"), (2, 1, "live", 1, 1, "x")], schema)
    new = spark.createDataFrame([(1, 2, "final", 7, 9, " ")], schema)
    rules = {"seen": "greatest", "rank": "least", "note": "keep"}
    out = {r["k"]: r for r in storage.upsert(old, new, ["k"], "v", rules).collect()}
    assert tuple(out[1]) == (1, 2, "final", 10, 5, "first") and out[2]["status"] == "live"


def test_unchanged_rows_are_no_change(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k long, x string")
    assert sorted(r["k"] for r in storage.changed_rows(old, new, ["k"]).collect()) == [2, 3]


def test_contract_counts_violations(spark):
    df = spark.createDataFrame([("a", 2.0), (None, 0.5)], "session_id string, chat_sentiment double")
    rules = {"session_id": contracts.Field(required=True), "chat_sentiment": contracts.Field(maximum=1), "gone": contracts.Field(required=True)}
    got = {(r["field"], r["rule"]): r["violations"] for r in contracts.check_contract(df, rules).collect()}
    assert got == {("session_id", "required"): 1, ("chat_sentiment", "maximum"): 1, ("gone", "required"): 2}


def segs(spark, rows):
    return spark.createDataFrame([("s", "c", i, at(a), at(b), t, 0.5, 100) for i, (a, b, t) in enumerate(rows)],
                                 "session_id string, channel_id string, segment_id long, segment_start timestamp, segment_end timestamp, text string, confidence double, asr_latency_ms long")


def reference_captions(rows, gap=5, cap=145):
    blocks = []
    for a, b, t in rows:
        if blocks:
            last = blocks[-1]
            merged = last[2] if last[2].endswith(t) else t if t.startswith(last[2]) else f"{last[2]} {t}"
            closed = last[2].rstrip("\"')]")[-1:] in ".!?"
            if a - last[1] <= gap and len(merged) <= cap and not closed:
                blocks[-1] = (last[0], b, merged)
                continue
        blocks.append((a, b, t))
    return blocks


def test_caption_blocks(spark):
    rows = [(0, 2, "so the thing"), (2, 4, "so the thing is"), (4, 6, "is"), (6, 8, "done."), (9, 10, "next"), (30, 31, "later"), (31, 32, "x" * 100), (33, 34, "y" * 60), (35, 36, "z")]
    got = epoch(captions.caption_blocks(segs(spark, rows)), "start", "end").orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == reference_captions(rows)


@pytest.mark.parametrize("slices", [1, 3, 8, 40])
def test_captions_of_one_long_stream_in_slices(spark, slices):
    """All rows in one stream: long runs without any cut, texts that add nothing for whole slices, finished sentences."""
    rng = random.Random(slices)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice((1, 1, 1, 2)) if i % 150 else 20
        kind = i // 100
        text = "yeah" if kind == 1 else "w" * rng.randint(1, 30) + ("." if kind == 3 and rng.random() < 0.2 else "") if kind != 4 else f"{'ab ' * (i % 7)}ab"
        rows.append((t, t + rng.choice((0.5, 1)), text))
    got = epoch(captions.caption_blocks(segs(spark, rows).repartition(5), slices=slices), "start", "end").orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == reference_captions(rows)


def test_captions_of_nothing_and_of_blank_rows(spark):
    assert captions.caption_blocks(segs(spark, [(0, 1, " "), (1, 2, "")])).count() == 0
    got = captions.caption_blocks(segs(spark, [(0, 1, "a"), (1, 2, "  "), (2, 3, "b")])).collect()
    assert [r["text"] for r in got] == ["a b"]


def test_transcript_buckets_start_with_the_audio(spark):
    rows = [(7, 12, "one"), (36.9, 40, "two"), (37, 41, "three")]
    got = epoch(transcripts.transcript_buckets(segs(spark, rows), 30), "bucket_start", "audio_ended_at").orderBy("bucket_start").collect()
    assert [(r["bucket_start"], r["text"], r["audio_ended_at"]) for r in got] == [(7, "one two", 40), (37, "three", 41)]
    assert got[0]["segments"][1]["start"] == 29.9


def test_coverage_of_overlapping_segments(spark):
    rows = [("k", 0.0, 4.0, 10.0), ("k", 2.0, 5.0, 10.0), ("k", 8.0, 20.0, 10.0), ("k", -3.0, 1.0, 10.0), ("z", 5.0, 5.0, 10.0)]
    out = transcripts.interval_coverage(spark.createDataFrame(rows, "k string, s double, e double, n double"), ["k"], "s", "e", "n")
    assert {r["k"]: (r["covered_seconds"], round(r["empty_ratio"], 9)) for r in out.collect()} == {"k": (7.0, 0.3), "z": (0.0, 1.0)}


def test_transcript_target_prefers_phrases(spark):
    df = spark.createDataFrame([(1, "boss fight again boss fight, wow dragon dragon dragon"), (2, "dragon here dragon"), (3, "nothing repeats")], "id long, text string")
    out = {r["id"]: r["target_text"] for r in transcripts.transcript_target(df, ["id"]).collect()}
    assert out == {1: "boss fight", 2: "dragon", 3: ""}


def test_stored_tables_go_with_the_session(tmp_path):
    """They lie in one folder below the shared one, which ends with the application."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from crowdtide.sources import storage\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', '{tmp_path}').getOrCreate()\n"
        "assert storage.settle(s.range(3), 'numbers').count() == 3\n"
        "import glob\n"
        f"assert len(glob.glob('{tmp_path}/crowdtide-*/numbers-*')) == 1\n"
        "s.stop()\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert list(tmp_path.glob("crowdtide-*")) == []


def test_repeated_tags_and_raw_payloads(spark):
    line = "@id=first;display-name=A;id=second;mod=1;mod=0 :u!u@h PRIVMSG #c :hello"
    row = chat_log.parse_chat_log(spark.createDataFrame([(line,)], "value string"), "s").first()
    assert (row["message_id"], row["is_mod"]) == ("second", False)
    rows = spark.createDataFrame([('{"b": 1.50, "a": 2, "session_id": "s"}',), ("{broken",), (None,)], "payload string")
    made = envelopes.make_envelope(rows, "chat_bucket", "t").collect()
    assert len(made) == 1 and made[0]["value"].endswith(',"payload":{"b": 1.50, "a": 2, "session_id": "s"}}')
    assert sorted(str(r["payload"]) for r in envelopes.malformed_payloads(rows).collect()) == ["None", "{broken"]


def test_a_cluster_needs_a_shared_folder():
    assert storage.shared_base("/shared/x", "file:/home/w", "spark://h:7077") == "/shared/x"
    assert storage.shared_base(None, "file:/home/w", "local[4]") == "file:/home/w"
    assert storage.shared_base(None, "hdfs://n/w", "yarn") == "hdfs://n/w"
    for warehouse in ("file:/home/w", "/home/w", "file:///w/x"):
        with pytest.raises(ValueError):
            storage.shared_base("", warehouse, "yarn")
