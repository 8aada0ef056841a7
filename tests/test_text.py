import pytest
from pyspark.sql import functions as F

from crowdtide.functions import lexicons, text
from crowdtide.functions.keys import hash_identity, rfc3339
from crowdtide.functions.numbers import round_half_away
from crowdtide.operators import filters
from tests.helpers import message, messages


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_filter_keeps_short_reactions_and_emotes(spark):
    rows = [("W", 0), ("l", 0), ("?", 0), ("x", 0), ("", 0), ("", 1), ("!cmd", 0), ("hi", 0), ("  ", 0)]
    df = messages(spark, [message(i, i, t, emotes=["Kappa"] * e) for i, (t, e) in enumerate(rows)])
    kept = {r["message_id"] for r in filters.filter_messages(df).collect()}
    assert kept == {"m0", "m1", "m2", "m5", "m7"}


def test_filter_drops_bots(spark):
    assert filters.filter_messages(messages(spark, [message(1, 0, "hello", bot=True)])).count() == 0


def test_clip_strips_again(spark):
    df = messages(spark, [message(1, 0, "great     clutch"), message(2, 0, "   ")])
    assert [r["text"] for r in filters.clip_texts(df, 10).collect()] == ["great"]


def test_normalize(spark):
    r = filters.normalize_messages(messages(spark, [message(1, 0, " a \t b\n")])).first()
    assert (r["text"], r["language"]) == ("a b", "other")


@pytest.mark.parametrize(
    "words, emotes, score, confidence, label",
    [
        ("love love hate", [], 1 / 3, 0.71, "positive"),
        ("nothing here", [], 0.0, 0.25, "neutral"),
        ("meh", ["PogChamp"], 0.9, 0.47, "positive"),
        ("awful bad sad terrible hate", [], -0.84, 0.85, "negative"),
    ],
)
def test_lexicon_sentiment(spark, words, emotes, score, confidence, label):
    c = text.lexicon_sentiment(F.lit(words), F.array(*[F.lit(e) for e in emotes]).cast("array<string>"), lexicons.CHAT_POSITIVE, lexicons.CHAT_NEGATIVE)
    got = one(spark, c)
    assert got["score"] == pytest.approx(score) and got["confidence"] == pytest.approx(confidence) and got["label"] == label


def test_label_lexicon_drops_magnitude(spark):
    got = one(spark, text.lexicon_label(F.lit("cool"), lexicons.LABEL_TERMS))
    assert got["label"] == "positive" and got["confidence"] == pytest.approx(0.45)


def test_rounding_uses_the_binary_product(spark):
    assert one(spark, round_half_away(F.lit(1.005), 2)) == 1.0
    assert one(spark, round_half_away(F.lit(-2.5), 0)) == -3.0


def test_keys(spark):
    ts = F.lit("2026-01-01 00:00:01.250000").cast("timestamp")
    assert one(spark, rfc3339(ts)) == "2026-01-01T00:00:01.25Z"
    assert one(spark, rfc3339(F.lit("2026-01-01 00:00:10").cast("timestamp"))) == "2026-01-01T00:00:10Z"
    assert one(spark, hash_identity("x", F.lit(None).cast("string"))) == one(spark, hash_identity("x", F.lit(" UNKNOWN ")))


def test_ratios(spark):
    assert one(spark, text.uppercase_ratio(F.lit("AB"))) == 0.0
    assert one(spark, text.uppercase_ratio(F.lit("ABcd"))) == 0.5
    assert one(spark, text.punctuation_burst(F.lit("!?!?!?"))) == 1.0
    assert one(spark, text.phrase_hits(F.lit("oh NO   way no"), ("no way",))) == 1


def test_caption_noise(spark):
    rows = [("fine words here today", 0.9), ("go go go go", 0.9), ("a b a b", 0.9), ("привет мир", 0.9), ("low", 0.1), ("ok", None)]
    df = spark.createDataFrame(rows, "text string, confidence double")
    assert [r["text"] for r in filters.drop_caption_noise(df).collect()] == ["fine words here today", "ok"]


def test_prediction_distribution(spark):
    rows = [({"LABEL_2": 0.6, "neutral": 0.2, "junk": 5.0, "negative": -1.0}, "positive", 0.6), (None, "odd", 0.3)]
    df = spark.createDataFrame(rows, "scores map<string,double>, label string, confidence double")
    a, b = filters.prediction_distribution(df).collect()
    assert (a["positive"], a["neutral"], a["negative"]) == pytest.approx((0.75, 0.25, 0.0))
    assert (b["positive"], b["neutral"], b["negative"]) == (0.0, 1.0, 0.0)
