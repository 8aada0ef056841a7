import random

import pytest
from pyspark.sql import functions as F

from crowdtide.operators import windows
from tests.helpers import T0, at, epoch, message, messages


def test_bucket_bounds_are_half_open(spark):
    df = messages(spark, [message(1, 29.999999, "a"), message(2, 30, "b"), message(3, 60, "c")])
    got = epoch(windows.with_bucket(df, 30), "bucket_start").orderBy("message_id").collect()
    assert [r["bucket_start"] for r in got] == [0, 30, 60]


def test_chat_bucket(spark):
    rows = [message(1, 1, "a", "u1", ["PogChamp"], score=0.8), message(2, 2, "b", "u2", ["PogChamp"], score=0.6), message(3, 3, "c", "u1", score=-0.4)]
    df = messages(spark, rows)
    b = windows.chat_buckets(df, 30).first()
    assert (b["message_count"], b["unique_chatters"]) == (3, 2)
    assert (b["chat_sentiment"], b["positive"], b["negative"]) == pytest.approx((1 / 3, 2 / 3, 1 / 3))
    assert windows.top_emotes(df, 30).first()["top_emotes"] == ["PogChamp"]


def test_top_terms_break_ties_by_word(spark):
    df = messages(spark, [message(1, 1, "zeta beta the ab beta"), message(2, 2, "zeta alpha")])
    assert windows.top_terms(df, 30, 2).first()["top_terms"] == ["beta", "zeta"]


def test_hype_burst(spark):
    texts = ["W", "NO WAY", "HOLY", "INSANE!!!", "LFG"]
    df = messages(spark, [message(i, i, t, f"user{i}") for i, t in enumerate(texts)])
    w = windows.reaction_windows(df, 5, 1).where(F.col("window_start") == F.lit(at(0))).first()
    assert w["reaction_type"] == "hype" and w["hype_score"] > 0.7
    assert (w["messages_per_minute"], w["unique_chatters"], w["message_count"]) == (60, 5, 5)


def test_shared_target(spark):
    df = messages(spark, [message(1, 1, "dragon fight was insane"), message(2, 2, "dragon steal no way")])
    w = windows.reaction_windows(df, 5, 1).where(F.col("window_start") == F.lit(at(0))).first()
    assert (w["target_text"], w["event_hint"]) == ("dragon", "hype:dragon")


def test_velocity_compares_with_the_window_before(spark):
    rows = [message(i, 2, "hello there friend", f"a{i}") for i in range(2)] + [message(10 + i, 7, "hello again friend", f"b{i}") for i in range(4)]
    agg = windows.velocity_and_spike(windows.reaction_features(windows.message_features(messages(spark, rows)), 5, 5), 5)
    w = agg.where(F.col("window_start") == F.lit(at(5))).first()
    assert (w["message_count"], w["previous_count"], w["previous_chatters"]) == (4, 2, 2)
    assert (w["velocity"], w["unique_spike"]) == (1.0, 1.0)


def test_peaks_reject_windows_across_the_edge(spark):
    df = messages(spark, [message(i, s, "INSANE clutch!!!", f"u{i}") for i, s in enumerate((10, 11, 28, 31, 32))])
    peaks = windows.attach_peaks(windows.chat_buckets(df, 30), windows.reaction_windows(df, 5, 1), 30)
    rows = epoch(peaks.select("bucket_start", F.explode("subwindows").alias("s")).select("bucket_start", "s.window_start", "s.window_end"), "bucket_start", "window_start", "window_end").collect()
    assert rows and all(r["bucket_start"] <= r["window_start"] and r["window_end"] <= r["bucket_start"] + 30 for r in rows)
    best = epoch(peaks, "bucket_start", "peak_time").where("bucket_start = 0").first()
    # every window scores full hype, so the latest end wins
    assert (best["peak_time"], best["peak_reaction_score"]) == (30, 1.0)


def test_input_order_does_not_matter(spark):
    rng = random.Random(5)
    words = ["W", "what", "bad throw", "no way", "dragon dance", "LFG!!", "huh???"]
    rows = [message(i, rng.random() * 60, rng.choice(words), f"u{rng.randrange(6)}", score=rng.uniform(-1, 1)) for i in range(120)]
    shuffled = rows[:]
    rng.shuffle(shuffled)

    def run(r):
        return [tuple(x) for x in windows.reaction_windows(messages(spark, r), 5, 1).orderBy(*windows.RWINDOW).collect()]

    assert run(rows) == run(shuffled)


def test_native_operators_have_no_python_or_cross_join(spark):
    df = messages(spark, [message(1, 1, "hi")])
    plan = windows.attach_peaks(windows.chat_buckets(df, 30), windows.reaction_windows(df, 5, 1), 30)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_evidence_messages_of_windows_and_peaks(spark):
    """The strongest five of a window; the peak's go to its bucket. Equal messages and missing ids stay messages of their own."""
    rows = [message(i, 10 + i * 0.1, "hello", f"u{i}") for i in range(9)] + [message(20, 12, "NO WAY insane", "v"), message(21, 13, "holy", "w"), message(21, 13, "holy", "w"), message(22, 14, "LFG", "x")]
    rows = [(*r[:2], "" if r[2] in ("m21", "m22") else r[2], *r[3:]) for r in rows]
    df = messages(spark, rows)
    w = windows.reaction_windows(df, 5, 1).where(F.col("window_start") == F.lit(at(10))).first()
    assert [m["text"] for m in w["evidence_messages"]] == ["LFG", "NO WAY insane", "holy", "holy", "hello"]
    assert w["evidence_ids"] == ["m20", "m0"]
    peaks = windows.attach_peaks(windows.chat_buckets(df, 30), windows.reaction_windows(df, 5, 1), 30).first()
    best = windows.reaction_windows(df, 5, 1).where(F.col("window_start") == F.lit(peaks["peak_window_start"])).first()
    assert peaks["peak_evidence_messages"] == best["evidence_messages"] != []
    quiet = windows.attach_peaks(windows.chat_buckets(df, 30), windows.reaction_windows(df, 5, 1).where("false"), 30).first()
    assert (quiet["peak_evidence_messages"], quiet["peak_evidence_ids"], quiet["peak_target_type"]) == ([], [], "unknown")


def test_panes_without_common_measure(spark):
    """Windows that leave gaps, and panes smaller than both lengths: the same as counting messages window by window."""
    rng = random.Random(2)
    rows = [message(i, rng.random() * 40, rng.choice(["W", "dragon fight", "dragon dance", "holy"]), f"u{i % 5}") for i in range(90)]
    for seconds, slide in ((6, 4), (3, 5)):
        got = epoch(windows.reaction_windows(messages(spark, rows), seconds, slide), "window_start").collect()
        starts = sorted({s for r in rows for s in range(-10, 45) if (T0.timestamp() + s) % slide == 0 and s <= (r[3] - T0).total_seconds() < s + seconds})
        assert sorted(r["window_start"] for r in got) == starts
        for r in got:
            inside = [x for x in rows if r["window_start"] <= (x[3] - T0).total_seconds() < r["window_start"] + seconds]
            assert r["message_count"] == len(inside) and len(r["evidence_messages"]) == min(5, len(inside))


def test_chatters_are_counted_without_a_row_per_window_and_chatter(spark):
    rnd = random.Random(11)
    sent = [(rnd.randrange(60), f"u{rnd.randrange(40)}" if i % 9 else "") for i in range(500)]
    rows = [message(i, second, f"t{i % 3}", user) for i, (second, user) in enumerate(sent)]
    feats = windows.message_features(messages(spark, rows).withColumn("display_name", F.lit("")), None)
    for seconds, slide in ((6, 2), (5, 3), (4, 10)):
        per_key = windows._expand_panes(windows._panes(feats, seconds, slide), seconds, slide)
        got = windows.reaction_features(feats, seconds, slide).collect()
        assert got and per_key.where("kind <> 'text'").count() <= 2 * (60 + 2 * seconds)

        def among(low, high):
            return len({u for at_, u in sent if low <= at_ < high and u})

        zero = at(0).replace(tzinfo=None)
        for r in got:
            low = round((r["window_start"] - zero).total_seconds())
            assert (r["unique_chatters"], r["previous_chatters"]) == (among(low, low + seconds), among(low - seconds, low))
