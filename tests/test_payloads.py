import json

import pytest

from crowdtide.sources import payloads

MESSAGE = {"session_id": "s", "channel_id": "c", "message_id": "m", "timestamp": "2026-04-29T18:00:26Z", "username": "u", "text": "hi"}
BUCKET = {
    "type": "chat_bucket", "session_id": "s", "channel_id": "c", "bucket_start": "2026-04-29T18:00:00Z", "bucket_end": "2026-04-29T18:00:30.5+02:00", "message_count": 4, "unique_chatters": 3,
    "chat_sentiment": 0.5, "positive": 1, "neutral": 0, "negative": 0.0, "language_mix": {"en": 0.5, "other": 0.5}, "top_terms": ["a", "b"], "peak_time": None,
    "message_scores": [{"message_id": "m", "timestamp": "2026-04-29T18:00:26Z", "text": "t", "confidence": 0.9, "sentiment_score": -1}],
    "subwindows": [{"window_start": "2026-04-29T18:00:12Z", "window_end": "2026-04-29T18:00:17Z", "message_count": 2, "confidence": 0.4, "evidence_ids": ["m"]}],
}


def violations(spark, rows, schema, root=None):
    texts = [(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows]
    out = payloads.check_payloads(spark.createDataFrame(texts, "payload string"), schema, root)
    return {(r["path"], r["rule"]): r["violations"] for r in out.collect() if r["violations"]}


def test_good_payloads_pass(spark):
    assert violations(spark, [BUCKET, BUCKET], payloads.contract("chat_bucket")) == {}
    assert violations(spark, [MESSAGE, {**MESSAGE, "emotes": ["x"], "is_mod": True, "badges": None}], payloads.contract("chat_message")) == {}


def test_nested_violations_carry_their_path(spark):
    sub, score = BUCKET["subwindows"][0], BUCKET["message_scores"][0]
    rows = [
        {**BUCKET, "chat_sentiment": -1.5, "uncontracted": 1, "positive": 2},
        {k: v for k, v in BUCKET.items() if k != "positive"},
        {**BUCKET, "type": "bucket", "message_count": 2.5, "unique_chatters": -1, "bucket_start": "yesterday", "bucket_end": None},
        {**BUCKET, "language_mix": {"en": "much", "de": 0.1}, "top_terms": ["a", 5, None], "subwindows": {"a": 1}},
        {**BUCKET, "subwindows": [sub, {**sub, "confidence": 7, "odd": 1, "more": 2}, {**sub, "confidence": 8, "window_end": 9}], "message_scores": [{**score, "sentiment_score": 3}, score, "no object"]},
        "{broken", None, "5",
    ]
    assert violations(spark, rows, payloads.contract("chat_bucket")) == {
        ("$", "json"): 1, ("$", "type"): 1, ("$", "unknown_field"): 1, ("$.chat_sentiment", "minimum"): 1, ("$.positive", "maximum"): 1, ("$.positive", "required"): 1, ("$.type", "enum"): 1,
        ("$.message_count", "type"): 1, ("$.unique_chatters", "minimum"): 1, ("$.bucket_start", "format"): 1, ("$.bucket_end", "type"): 1, ("$.language_mix.*", "type"): 1,
        ("$.top_terms[]", "type"): 2, ("$.subwindows", "type"): 1, ("$.subwindows[].confidence", "maximum"): 2, ("$.subwindows[]", "unknown_field"): 2, ("$.subwindows[].window_end", "type"): 1,
        ("$.message_scores[].sentiment_score", "maximum"): 1, ("$.message_scores[]", "type"): 1,
    }


def test_a_document_with_references(spark, tmp_path):
    doc = {
        "$defs": {
            "Share": {"type": "number", "minimum": 0, "maximum": 1},
            "Word": {"type": "object", "additionalProperties": False, "required": ["text"], "properties": {"text": {"type": "string"}, "p": {"anyOf": [{"$ref": "#/$defs/Share"}, {"type": "null"}]}}},
            "Line": {"type": "object", "required": ["words"], "properties": {"kind": {"enum": ["a", "b"]}, "words": {"type": "array", "items": {"$ref": "#/$defs/Word"}}}},
            "Page": {"type": "object", "properties": {"lines": {"type": ["array", "null"], "items": {"$ref": "#/$defs/Line"}}}},
        }
    }
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    root = payloads.load_contract(str(path))
    rows = [
        {"lines": [{"words": [{"text": "x", "p": 1}, {"text": "y", "p": None}], "kind": "a"}, {"words": []}], "free": 1},
        {"lines": None},
        {"lines": [{"kind": "c", "words": [{"p": 3}, {"text": None, "extra": 1}]}, {}]},
    ]
    assert violations(spark, rows, root["$defs"]["Page"], root) == {
        ("$.lines[].kind", "enum"): 1, ("$.lines[].words", "required"): 1, ("$.lines[].words[].text", "required"): 1, ("$.lines[].words[].text", "type"): 1,
        ("$.lines[].words[].p", "maximum"): 1, ("$.lines[].words[]", "unknown_field"): 1,
    }


@pytest.mark.parametrize("name", payloads.PAYLOADS)
def test_every_contract_is_one_aggregation(spark, name):
    out = payloads.check_payloads(spark.createDataFrame([("{}",)], "payload string"), payloads.contract(name))
    rows = {(r["path"], r["rule"]): r["violations"] for r in out.collect()}
    required = payloads.contract(name)["required"]
    assert {p for (p, r), n in rows.items() if n} == {f"$.{c}" for c in required}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_empty_table(spark):
    assert violations(spark, [], payloads.contract("chat_message")) == {}
