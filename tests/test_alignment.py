import random

import pytest
from pyspark.sql import functions as F

from crowdtide.operators import alignment, correlation, intervals, ranks
from tests.helpers import at, epoch

CHAT = "session_id string, channel_id string, bucket_start timestamp, bucket_end timestamp, message_count long, chat_sentiment double, sentiment_confidence double"
SPEECH = "session_id string, channel_id string, bucket_start timestamp, bucket_end timestamp, text string, transcript_confidence double, sentiment_score double"


def chat(spark, rows):
    return spark.createDataFrame([(s, "c", at(a), at(b), 12, v, 0.8) for s, a, b, v in rows], CHAT)


def speech(spark, rows):
    return spark.createDataFrame([(s, "c", at(a), at(b), "words " * 20, 0.9, v) for s, a, b, v in rows], SPEECH)


def test_single_pair(spark):
    r = alignment.align(chat(spark, [("s", 0, 30, 0.2)]), speech(spark, [("s", 1, 31, 0.8)]), 30).first()
    assert (r["overlap_seconds"], r["relationship"]) == (29, "diverged") and r["delta"] < 0
    assert r["quality_flags"] == ["good_overlap", "enough_chat_volume", "good_transcript_confidence", "enough_transcript_text"]


def test_one_chat_bucket_serves_once(spark):
    assert alignment.align(chat(spark, [("s", 0, 30, 0.2)]), speech(spark, [("s", 0, 30, 0.1), ("s", 0.5, 30, 0.3)]), 30).count() == 1


def test_exactly_half_counts(spark):
    assert alignment.align(chat(spark, [("s", 0, 60, 0.1)]), speech(spark, [("s", 30, 90, 0.1)]), 60).count() == 1
    assert alignment.align(chat(spark, [("s", 0, 60, 0.1)]), speech(spark, [("s", 31, 91, 0.1)]), 60).count() == 0


def greedy(chats, speeches, window):
    used, out = set(), set()
    for t in sorted(speeches):
        best, over = None, 0
        for c in sorted(chats):
            if c in used:
                continue
            o = min(c[1], t[1]) - max(c[0], t[0])
            if o > over:
                best, over = c, o
        if best is not None and over >= window / 2:
            used.add(best)
            out.add((best[0], t[0]))
    return out


@pytest.mark.parametrize("chunk", [100, 1024])
def test_matches_sequential_greedy(spark, chunk):
    rng = random.Random(11)
    cases, chats, speeches = {}, [], []
    for n in range(40):
        cs = {(s, s + rng.choice((20, 30, 40, 60))) for s in rng.sample(range(0, 300, 5), 12)}
        ts = {(s, s + rng.choice((20, 30, 45))) for s in rng.sample(range(0, 300, 5), 12)}
        cases[f"s{n}"] = greedy(cs, ts, 30)
        chats += [(f"s{n}", a, b, 0.1) for a, b in cs]
        speeches += [(f"s{n}", a, b, 0.1) for a, b in ts]
    # a long chain: every transcript bucket covers exactly half of two chat buckets
    cs, ts = {(i * 30, i * 30 + 30) for i in range(1, 400)}, {(i * 30 + 15, i * 30 + 45) for i in range(400)}
    cases["chain"] = greedy(cs, ts, 30)
    chats += [("chain", a, b, 0.1) for a, b in cs]
    speeches += [("chain", a, b, 0.1) for a, b in ts]
    got = epoch(alignment.align(chat(spark, chats), speech(spark, speeches), 30, chunk), "chat_bucket_start", "transcript_bucket_start")
    found = {k: set() for k in cases}
    for r in got.collect():
        found[r["session_id"]].add((r["chat_bucket_start"], r["transcript_bucket_start"]))
    assert found == cases


def test_dense_item_series_stay_in_their_stretches(spark, tmp_path, monkeypatch):
    """Many items shared across every border: the result is the sequential one, and no task sees two stretches."""
    seen = tmp_path / "stretches"
    seen.mkdir()
    build = intervals._match_stretch

    def watched(keys):
        run = build(keys)

        def record(pdf, entry):
            import uuid

            (seen / uuid.uuid4().hex).write_text(",".join(map(str, sorted(set(pdf["chunk"])))))
            return run(pdf, entry)

        return record

    monkeypatch.setattr(intervals, "_match_stretch", watched)
    cs = {(i, i + 60) for i in range(0, 300, 2)}
    ts = {(i, i + 40) for i in range(0, 280, 7)}
    got = epoch(alignment.align(chat(spark, [("s", a, b, 0.1) for a, b in cs]), speech(spark, [("s", a, b, 0.1) for a, b in ts]), 30, 2), "chat_bucket_start", "transcript_bucket_start")
    assert {(r["chat_bucket_start"], r["transcript_bucket_start"]) for r in got.collect()} == greedy(cs, ts, 30)
    stretches = [f.read_text() for f in seen.iterdir()]
    assert len(set(stretches)) == 5 and all(s.count(",") == 0 for s in stretches)


def test_repeated_ranges_take_a_bucket_each(spark):
    c, t = chat(spark, [("s", 0, 30, 0.1), ("s", 5, 35, 0.2)]), speech(spark, [("s", 0, 30, 0.3), ("s", 0, 30, 0.4)])
    got = epoch(alignment.align(c, t, 30), "chat_bucket_start").collect()
    assert sorted(r["chat_bucket_start"] for r in got) == [0, 5] and {r["transcript_sentiment"] for r in got} == {0.3, 0.4}


def test_unscored_transcript_blocks_a_lag_pair(spark):
    c = chat(spark, [("s", 0, 30, 0.5), ("s", 30, 60, 0.5)])
    t = speech(spark, [("s", 0, 30, None), ("s", 30, 60, 0.2)])
    rows = epoch(alignment.lag_pairs(c, t, [0]), "chat_bucket_start").collect()
    assert [(r["chat_bucket_start"], r["transcript_sentiment"]) for r in rows] == [(30, 0.2)]


def test_best_lag_is_found(spark):
    scores = [-0.5, 0.0, 0.5, 0.3, -0.2]
    c = chat(spark, [("s", i * 30, i * 30 + 30, v) for i, v in enumerate(scores)])
    t = speech(spark, [("s", i * 30 + 30, i * 30 + 60, v) for i, v in enumerate(scores)])
    out = correlation.lag_summary(alignment.lag_pairs(c, t), alignment.DEFAULT_LAGS)
    assert [r["lag_seconds"] for r in out.where("best").collect()] == [30]


def test_overlap_pairs_brute_force(spark):
    rng = random.Random(3)
    a = [(i, s, s + rng.randint(1, 200)) for i, s in enumerate(rng.sample(range(2000), 60))]
    b = [(i, s, s + rng.randint(1, 200)) for i, s in enumerate(rng.sample(range(2000), 60))]
    left = spark.createDataFrame([("s", i, at(x), at(y)) for i, x, y in a], "session_id string, a long, ls timestamp, le timestamp")
    right = spark.createDataFrame([("s", i, at(x), at(y)) for i, x, y in b], "session_id string, b long, rs timestamp, re timestamp")
    got = [(r["a"], r["b"], r["overlap_us"]) for r in intervals.overlap_pairs(left, right, ["session_id"], ("ls", "le"), ("rs", "re"), 30).collect()]
    want = [(i, j, (min(y, q) - max(x, p)) * 1_000_000) for i, x, y in a for j, p, q in b if min(y, q) > max(x, p)]
    assert sorted(got) == sorted(want)
    plan = intervals.overlap_pairs(left, right, ["session_id"], ("ls", "le"), ("rs", "re"), 30)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_falls_back_to_the_closest_midpoint(spark):
    left = spark.createDataFrame([("s", at(100), at(110)), ("s", at(0), at(10))], "session_id string, ws timestamp, we timestamp")
    right = spark.createDataFrame([("s", 1, at(50), at(60)), ("s", 2, at(140), at(150)), ("s", 3, at(5), at(9))], "session_id string, b long, rs timestamp, re timestamp")
    out = intervals.nearest_window(left, right, ["session_id"], ["ws"], ("ws", "we"), ("rs", "re"), 30, ["b"])
    assert {r["ws"]: r["b"] for r in epoch(out, "ws").collect()} == {100: 2, 0: 3}


@pytest.mark.parametrize("width", [20, 300])
def test_nearest_window_equals_brute_force(spark, width):
    rng = random.Random(width)
    ranges = lambda n: [(s, i, a, a + rng.choice((2, 4, 10))) for s in "st" for i, a in enumerate(rng.choices(range(0, 3000, 2), k=n))]
    lefts, rights = ranges(60), [*ranges(25), ("s", 90, 6000, 6010), ("s", 91, 6000, 6010)]
    wanted = {(s, i): rng.choice((None, None, a)) for s, i, a, _ in rights}
    names = [*wanted.values()]
    left = spark.createDataFrame([(s, i, at(a), at(b), rng.choice(names)) for s, i, a, b in lefts], "session_id string, a long, ls timestamp, le timestamp, name long")
    right = spark.createDataFrame([(s, i, at(a), at(b), wanted[s, i]) for s, i, a, b in rights], "session_id string, b long, rs timestamp, re timestamp, called long")
    name = {(r["session_id"], r["a"]): r["name"] for r in left.collect()}

    def best(s, i, a, b, shift, exact):
        a, b = a + shift, b + shift
        found = [(t, j, p, q) for t, j, p, q in rights if t == s]
        same = [j for t, j, p, q in found if name[s, i] is not None and wanted[t, j] == name[s, i]]
        overlap = lambda p, q: max(0, min(b, q) - max(a, p))
        near = min(found, key=lambda x: (-overlap(*x[2:]), abs((a + b) - sum(x[2:])) if overlap(*x[2:]) == 0 else 0, sum(x[2:]) if overlap(*x[2:]) == 0 else x[2], x[3] if overlap(*x[2:]) else 0, x[1]))
        return (min(same) if exact and same else near[1]), overlap(*near[2:])

    for shift, exact in ((0, None), (0, ("name", "called")), (-45, ("name", "called"))):
        out = intervals.nearest_window(left, right, ["session_id"], ["a"], ("ls", "le"), ("rs", "re"), width, ["b"], shift, exact)
        got = {(r["session_id"], r["a"]): (r["b"], r["overlap_us"] // 1_000_000) for r in out.collect()}
        want = {(s, i): best(s, i, a, b, shift, exact and shift == 0) for s, i, a, b in lefts}
        differing = {k for k in want if got[k] != want[k]}
        # equal overlap and start and end: any of the rows
        assert all(got[k][1] == want[k][1] > 0 for k in differing) and len(differing) < 8


def test_nearest_window_without_any_row(spark):
    left = spark.createDataFrame([("s", at(0), at(10))], "session_id string, ws timestamp, we timestamp")
    right = spark.createDataFrame([], "session_id string, b long, rs timestamp, re timestamp")
    assert [r["b"] for r in intervals.nearest_window(left, right, ["session_id"], ["ws"], ("ws", "we"), ("rs", "re"), 30, ["b"]).collect()] == [None]


def test_nearest_window_sorts_slices_only(spark):
    """The windows over rows are partitioned by slice; only the one-row-per-slice tables are ordered by stream."""
    left = spark.createDataFrame([("s", at(0), at(10))], "session_id string, ws timestamp, we timestamp")
    right = spark.createDataFrame([("s", 1, at(5), at(9))], "session_id string, b long, rs timestamp, re timestamp")
    near = intervals._nearest_points(left.select("session_id", "ws", F.lit(1.0).alias("_m")), right.select("session_id", F.lit(2.0).alias("_m"), F.struct(F.lit(2.0).alias("m"), "b").alias("_row")), ["session_id"], ["session_id", "ws"], 30)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "+- Window [" in line or line.startswith("Window [")]
    over_rows = [w for w in windows if "_is_right" in w]
    assert over_rows and all("_slice" in w.split("windowspecdefinition(")[1].split("ASC")[0].split("DESC")[0] for w in over_rows)


def test_pearson_and_spearman(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 10.0, 1.0), ("b", 30.0, 3.0), ("b", 20.0, 2.0), ("k", 1.0, 5.0), ("k", 1.0, 6.0), ("k", 1.0, 7.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    out = {r["g"]: r for r in correlation.correlations(df, ["g"], 3, "x", ["y"]).collect()}
    assert (out["a"]["pearson"], out["b"]["spearman"]) == (1.0, 1.0)
    assert (out["k"]["pearson"], out["k"]["correlation_status"]) == (None, "constant_series")


def test_quantile_interpolates(spark):
    df = spark.createDataFrame([("g", x / 10) for x in range(1, 6)], "g string, v double")
    assert ranks.quantiles(df, ["g"], "v", {"q": 0.95}).first()["q"] == pytest.approx(0.48)


def test_ranks_with_ties_and_one_hot_value(spark):
    values = [0.5] * 50 + [0.1, 0.9, 0.501, 0.501]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = {r["v"]: r["r"] for r in ranks.average_rank(df, ["g"], "v", "r").distinct().collect()}
    assert got == {0.1: 1.0, 0.5: 26.5, 0.501: 52.5, 0.9: 54.0}


def test_positions_do_not_depend_on_slices(spark):
    df = spark.createDataFrame([("g", at(x), f"m{i:03d}") for i, x in enumerate([5, 1, 1, 9, 3, 3.5, 100])], "g string, ts timestamp, id string")
    for width in (0.5, 10, 1000):
        out = ranks.row_positions(df, ["g"], "ts", "id", width).orderBy("pos").collect()
        assert [r["id"] for r in out] == ["m001", "m002", "m004", "m005", "m000", "m003", "m006"]
        assert {r["size"] for r in out} == {7}


def test_rotation(spark):
    df = spark.createDataFrame([("s", "c", at(i), at(i + 1), float(i)) for i in range(5)] + [("one", "c", at(0), at(1), 9.0)], "session_id string, channel_id string, window_start timestamp, window_end timestamp, transcript_sentiment double")
    out = correlation.rotate_within_session(df).orderBy("session_id", "window_start")
    assert [r["shuffled"] for r in out.where(F.col("session_id") == "s").collect()] == [2.0, 3.0, 4.0, 0.0, 1.0]
    assert out.where(F.col("session_id") == "one").first()["effective"] is False
