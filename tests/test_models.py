import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdtide.operators import models
from tests.helpers import at, epoch, message, messages


def bucketed(spark, rows):
    return messages(spark, rows).withColumns({"bucket_start": F.lit(at(0)), "bucket_end": F.lit(at(3600))})


def test_even_sample_positions(spark):
    df = bucketed(spark, [message(i, i, "x") for i in range(20)])
    got = epoch(models.peak_first_sample(df, 5), "timestamp").collect()
    assert sorted(r["timestamp"] for r in got) == [0, 5, 10, 14, 19]


def test_peak_messages_come_first(spark):
    df = bucketed(spark, [message(i, i, "x") for i in range(10)]).withColumns({"ps": F.lit(at(4)), "pe": F.lit(at(7))})
    got = epoch(models.peak_first_sample(df, 5, "ps", "pe"), "timestamp").collect()
    assert len(got) == 5 and {4, 5, 6} <= {r["timestamp"] for r in got}
    assert {r["timestamp"] for r in got} == {0, 4, 5, 6, 9}


def test_single_slot_takes_peak_or_middle(spark):
    df = bucketed(spark, [message(i, i, "x") for i in range(7)]).withColumns({"ps": F.lit(at(4)), "pe": F.lit(at(7))})
    assert epoch(models.peak_first_sample(df, 1), "timestamp").first()["timestamp"] == 3
    assert epoch(models.peak_first_sample(df, 1, "ps", "pe"), "timestamp").first()["timestamp"] == 4


def test_class_scores_weigh_the_bucket(spark):
    df = bucketed(spark, [message(1, 1, "good"), message(2, 2, "good")])
    pred = spark.createDataFrame([("good", "positive", 0.7, {"positive": 0.7, "neutral": 0.2, "negative": 0.1})], models.PREDICTION)
    b = models.bucket_sentiment(df, pred).first()
    assert b["chat_sentiment"] == pytest.approx(0.60) and b["analyzed_count"] == 2


def test_blank_texts_are_neutral(spark):
    df = bucketed(spark, [message(1, 1, ""), message(2, 2, "   ")])
    b = models.bucket_sentiment(df, models.lexicon_predictions(df)).first()
    assert (b["neutral"], b["analyzed_count"], b["message_count"]) == (1.0, 0, 2)


def test_each_distinct_text_is_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(texts):
        seen.add(len(texts))
        return pd.DataFrame({"label": ["neutral"] * len(texts), "confidence": [0.5] * len(texts), "scores": [None] * len(texts)})

    df = messages(spark, [message(i, i, f"t{i % 3}") for i in range(30)])
    assert models.score_texts(df, scorer).count() == 3
    assert seen.value == 3


def test_fallback_fills_missing_predictions(spark):
    df = messages(spark, [message(1, 1, "love"), message(2, 2, "meh")])
    local = models.lexicon_predictions(df)
    model = local.where("text = 'meh'")
    assert {r["text"]: r["status"] for r in models.with_fallback(model, local).collect()} == {"love": "fallback", "meh": "model"}


def test_trace_sample_respects_label_quota(spark):
    rows = [message(i, i, "x", confidence=0.9 - i / 100, label="positive") for i in range(10)]
    rows += [message(20 + i, i, "x", confidence=0.1, label="negative") for i in range(3)]
    got = models.trace_sample(bucketed(spark, rows), 6).collect()
    labels = [r["label"] for r in got]
    assert labels.count("negative") == 2 and labels.count("positive") == 4


def test_a_text_of_half_of_all_messages_fills_many_tasks(spark):
    rows = [message(i, i, "same" if i % 2 else f"t{i}") for i in range(4000)] + [message(9999, 1, None)]
    df = messages(spark, rows).repartition(4)
    assert len(models.frequent_texts(df)) == 1
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        scored = models.message_scores(df, models.lexicon_predictions(df))
        tasks = scored.where("text = 'same'").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 4 and max(r["count"] for r in tasks) < 1000
        assert scored.count() == 4000 and scored.select("message_id").distinct().count() == 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def slow_sample(times, peak, n):
    """Positions by the rule: a bucket that fits goes whole; else the peak's first ones, the rest at even steps."""
    order = sorted(times)
    if len(order) <= n:
        return order
    inner = [t for t in order if peak[0] <= t < peak[1]]
    if n == 1:
        return [inner[0]] if inner else [order[len(order) // 2]]
    taken = inner[:n]
    rest = [t for t in order if t not in set(inner)] if len(inner) < n else []
    slots = n - len(taken)
    if slots <= 0:
        return taken
    if len(rest) <= slots:
        return sorted(taken + rest)
    if slots == 1:
        return sorted([*taken, rest[len(rest) // 2]])
    step = (len(rest) - 1) / (slots - 1)
    return sorted([*taken, *{rest[round(i * step)] for i in range(slots)}])


@pytest.mark.parametrize("width", [0.5, 7, 10_000])
def test_sample_equals_brute_force_whatever_the_slices(spark, width):
    rng = random.Random(4)
    buckets = {f"s{k}": [t / 4 for t in rng.sample(range(4000), rng.choice((3, 9, 40, 200)))] for k in range(12)}
    rows = [(s, *message(f"{s}-{i}", t, "x")[1:]) for s, ts in buckets.items() for i, t in enumerate(ts)]
    peak = (300, 420)
    df = messages(spark, rows).withColumns({"bucket_start": F.lit(at(0)), "bucket_end": F.lit(at(3600)), "ps": F.lit(at(peak[0])), "pe": F.lit(at(peak[1]))})
    for n in (1, 2, 5, 30):
        got = {}
        for r in epoch(models.peak_first_sample(df, n, "ps", "pe", width), "timestamp").collect():
            got.setdefault(r["session_id"], []).append(r["timestamp"])
        assert {s: sorted(v) for s, v in got.items()} == {s: slow_sample(ts, peak, n) for s, ts in buckets.items()}
