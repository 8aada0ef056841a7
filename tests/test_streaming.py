import random

from pyspark.sql import functions as F

from crowdtide.operators import windows
from crowdtide.streaming import pipelines as live
from tests.helpers import MESSAGE, at, message, messages


def feed(spark, tmp_path, *batches):
    """One file per batch, read one per trigger, in order."""
    for i, rows in enumerate(batches):
        messages(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", 1).parquet(*[str(tmp_path / "in/*")])


CLOSING = message(999, 100000, "end", "z")


def result(spark, out, path):
    return spark.read.schema(out.schema).parquet(f"{path}/table")


def test_buckets_equal_the_batch(spark, tmp_path):
    rows = [message(i, i * 2, f"t{i % 4}", f"u{i % 5}", score=(i % 7) / 7) for i in range(60)]
    stream = feed(spark, tmp_path, rows[:30], rows[30:], [CLOSING])
    out = live.stream_chat_buckets(stream, 30)
    path = str(tmp_path / "query")
    live.run_to_end(out, path)
    want = windows.chat_buckets(messages(spark, rows), 30)
    got = result(spark, out, path).where(F.col("bucket_start") < F.lit(at(90000)))
    cols = ["bucket_start", "message_count", "unique_chatters"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_reaction_windows_equal_the_batch(spark, tmp_path):
    words = ["W", "what??", "no way", "dragon", "bad throw"]
    rows = [message(i, i * 0.7, words[i % 5], f"u{i % 3}") for i in range(50)]
    stream = feed(spark, tmp_path, rows[:20], rows[20:], [CLOSING])
    out = live.stream_reaction_windows(stream, 5, 1)
    path = str(tmp_path / "query")
    live.run_to_end(out, path)
    got = result(spark, out, path).where(F.col("window_start") < F.lit(at(90000)))
    want = windows.reaction_windows(messages(spark, rows), 5, 1)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_stream_state_has_no_row_per_message_or_chatter(spark, tmp_path):
    rnd = random.Random(3)
    words = ["W", "what??", "no way", "dragon", "bad throw", "LET'S GO!!!"]
    rows = [message(i if i % 50 else 0, rnd.randrange(4000) / 1000, words[rnd.randrange(6)], f"u{rnd.randrange(900)}") for i in range(3000)]
    rows += rows[:4]
    stream = feed(spark, tmp_path, rows[:1500], rows[1500:], [CLOSING])
    out = live.stream_reaction_windows(stream, 5, 1)
    path = str(tmp_path / "query")
    query = live.run_to_end(out, path)
    got = result(spark, out, path).where(F.col("window_start") < F.lit(at(90000)))
    want = windows.reaction_windows(messages(spark, rows), 5, 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    kept = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert kept < len(rows)


def test_late_messages_count_within_the_watermark_only(spark, tmp_path):
    first = [message(1, 10, "a", "u1"), message(2, 70, "b", "u2")]
    # 45 s behind is inside the one-minute delay
    second = [message(3, 25, "late", "u3"), message(4, 400, "c", "u4")]
    third = [message(6, 410, "d", "u4")]
    fourth = [message(5, 20, "too late", "u5")]
    stream = feed(spark, tmp_path, first, second, third, fourth, [CLOSING])
    out = live.stream_chat_buckets(stream, 30, "60 seconds")
    path = str(tmp_path / "query")
    query = live.run_to_end(out, path)
    got = {r["bucket_start"]: r["message_count"] for r in result(spark, out, path).collect()}
    assert got[at(0).replace(tzinfo=None)] == 2
    assert live.late_rows(query) >= 1


def test_upserts_go_on_after_a_restart(spark, tmp_path):
    schema = "k string, x string, version long"
    source, path = str(tmp_path / "in"), str(tmp_path / "query")

    def run():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        return {r["k"]: r["x"] for r in live.stream_upsert_latest(rows, path, ["k"], "version").collect()}

    spark.createDataFrame([("a", "old", 1), ("b", "b", 1)], schema).coalesce(1).write.parquet(source)
    assert run() == {"a": "old", "b": "b"}
    spark.createDataFrame([("a", "new", 2), ("b", "stale", 0), ("c", "c", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == run() == {"a": "new", "b": "b", "c": "c"}
    # a batch that is written again replaces itself
    again = spark.createDataFrame([("a", "new", 2), ("b", "stale", 0), ("c", "c", 1)], schema)
    live.LevelledLog(spark, again.schema, f"{path}/log", ["k"], "version").append(again, 1)
    assert run() == {"a": "new", "b": "b", "c": "c"}


def test_alignment_goes_on_after_a_restart(spark, tmp_path):
    from crowdtide.operators import alignment
    from crowdtide.streaming import alignment as sliced
    from tests.test_alignment import chat, speech

    c = chat(spark, [("s", 0, 30, 0.1), ("s", 30, 60, 0.2), ("t", 0, 30, 0.3)])
    t = speech(spark, [("s", 10, 40, 0.5), ("t", 0, 30, 0.4)])
    later = speech(spark, [("s", 0, 30, 0.6)])
    source, path = str(tmp_path / "in"), str(tmp_path / "query")

    def rows(kind, name, df):
        return df.select(F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("version"), F.struct(*df.columns).alias(name))

    feed = rows("chat", "chat", c).unionByName(rows("transcript", "speech", t), allowMissingColumns=True)

    def run():
        stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = sliced.stream_align(stream, path, 30, 2)
        return sorted((r["session_id"], r["chat_bucket_start"], r["transcript_bucket_start"]) for r in out.collect())

    def want(speeches):
        return sorted((r["session_id"], r["chat_bucket_start"], r["transcript_bucket_start"]) for r in alignment.align(c, speeches, 30).collect())

    feed.coalesce(1).write.parquet(source)
    assert run() == want(t)
    more = rows("chat", "chat", c.limit(0)).unionByName(rows("transcript", "speech", later), allowMissingColumns=True)
    more.select(*feed.columns).coalesce(1).write.mode("append").parquet(source)
    assert run() == want(t.unionByName(later)) != want(t)


WINDOWS = "session_id string, channel_id string, window_start timestamp, window_end timestamp, message_count long, reaction_type string"


def window_rows(seconds, session="s"):
    return [(session, "c", at(x - 5), at(x), int(x), "hype") for x in seconds]


def test_retention_keeps_the_last_minutes_in_state(spark, tmp_path):
    """Three hundred and ten windows a second apart, five minutes kept; the query is stopped and goes on between files."""
    from crowdtide.streaming import retention

    source, path = str(tmp_path / "in"), str(tmp_path / "query")

    def bring(rows):
        spark.createDataFrame(rows, WINDOWS).coalesce(1).write.mode("append").parquet(source)

    def run():
        feed = spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", 1).parquet(source)
        return retention.stream_retention(feed, path, 5, "60 seconds")

    def kept(session):
        return sorted(r["message_count"] for r in run().where(F.col("session_id") == session).collect())

    bring(window_rows(range(1, 200)))
    bring(window_rows([50, 60], "quiet"))
    assert kept("s") == list(range(1, 200))
    # a late window, one that comes again, and one that is too old by the time it comes
    bring([("s", "c", at(150.5), at(155.5), 1555, "late"), ("s", "c", at(194), at(199), 1990, "again")])
    bring(window_rows(range(200, 311)))
    bring(window_rows([400], "other"))
    want = [*range(10, 156), 1555, *range(156, 199), 1990, *range(200, 311)]
    assert kept("s") == sorted(want) and len(want) == 302
    # the quiet stream keeps what is recent by its own clock
    assert kept("quiet") == [50, 60]
    bring(window_rows([700, 1000]))
    bring(window_rows([5000], "other"))
    bring(window_rows([5200], "other"))
    assert kept("s") == [700, 1000]
    assert kept("other") == [5000, 5200]
    assert run().count() == 6  # two of each session: the state holds nothing else
    changes = spark.read.schema(retention.CHANGE).parquet(f"{path}/table")
    gone = changes.where("session_id = 's' AND NOT kept")
    assert gone.count() == 311 and gone.select("start", "stop").distinct().count() == 311
    row = run().where("message_count = 700").first()
    assert (row["reaction_type"], row["window_end"]) == ("hype", at(700).replace(tzinfo=None))


def test_a_batch_realigns_the_slices_it_touches(spark, tmp_path):
    """A long session in slices of four windows: contested chains across borders, late and updated buckets. The result is that
    of aligning everything, and a batch that touches one slice reads and writes that one and its neighbours."""
    from crowdtide.operators import alignment
    from crowdtide.streaming import alignment as sliced
    from tests.test_alignment import chat, speech

    rng = random.Random(8)
    chats = [("s", i * 30, i * 30 + 30, 0.1) for i in range(80)] + [("long", i * 30, i * 30 + 30, 0.2) for i in range(1, 40)]
    speeches = [("s", a, a + rng.choice((30, 45)), 0.4) for a in range(5, 2400, 40)] + [("long", i * 30 + 15, i * 30 + 45, 0.3) for i in range(40)]
    late = [speeches.pop(i) for i in (50, 30, 10)]
    source, path = str(tmp_path / "in"), str(tmp_path / "query")
    schema = None

    def rows(kind, name, df):
        return df.select(F.lit(kind).alias("kind"), F.lit(1).cast("long").alias("version"), F.struct(*df.columns).alias(name))

    def bring(cs, ts):
        nonlocal schema
        feed = rows("chat", "chat", chat(spark, cs)).unionByName(rows("transcript", "speech", speech(spark, ts)), allowMissingColumns=True)
        schema = feed.schema
        feed.coalesce(1).write.mode("append").parquet(source)

    def got():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = sliced.stream_align(stream, path, 30, 4)
        return sorted((r["session_id"], r["chat_bucket_start"], r["transcript_bucket_start"], r["quality"]) for r in out.collect())

    def want(cs, ts):
        return sorted((r["session_id"], r["chat_bucket_start"], r["transcript_bucket_start"], r["quality"]) for r in alignment.align(chat(spark, cs), speech(spark, ts), 30).collect())

    bring(chats[1::2], speeches)
    bring(chats[::2], [])
    assert got() == want(chats, speeches)
    bring([], late[:1])
    bring([], late[1:])
    assert got() == want(chats, speeches + late)
    state = sliced.SlicedAlignment(spark, schema, path, 30, 4)
    touched = spark.read.parquet(f"{path}/touched/batch=2")
    places = [tuple(r) for r in touched.select("session_id", "slice").distinct().collect()]
    assert 1 <= len(places) <= 2 and {p[0] for p in places} == {late[0][0]}
    around = touched.select("session_id", "channel_id", F.explode(F.array(F.col("slice") - 1, F.col("slice"), F.col("slice") + 1)).alias("slice"))
    whole = spark.read.parquet(f"{path}/log").count()
    assert 0 < state.read(around, 9).count() < whole / 5
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")  # plans print filters in full
    filters = [x.split("DataFilters")[0] for x in state.read(around, 9)._jdf.queryExecution().sparkPlan().toString().replace("PushedFilters", "DataFilters").split("PartitionFilters: ")[1:]]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert any("slice#" in f and "part#" in f for f in filters)
    assert spark.read.parquet(f"{path}/aligned/batch=2").count() < len(want(chats, speeches)) / 5


def test_levelled_log_reads_few_runs(spark, tmp_path):
    """Fourteen batches at a fanout of three: a read meets the runs named by the digits of 14, whose rows are one per key."""
    schema = "k long, x string, version long"
    log = live.LevelledLog(spark, spark.createDataFrame([], schema).schema, str(tmp_path / "log"), ["k"], "version", 3)
    rng, want = random.Random(1), {}
    for n in range(14):
        rows = [(rng.randrange(6), f"{n}-{i}", rng.randrange(100) * 100 + n * 7 + i) for i in range(5)]
        for k, x, v in rows:
            want[k] = max(want.get(k, (-1, "")), (v, x))
        log.append(spark.createDataFrame(rows, schema), n)
    assert log.runs(14) == [(2, 0), (1, 3), (0, 12), (0, 13)] and log.batches() == 14
    assert {r["k"]: (r["version"], r["x"]) for r in log.read(14).collect()} == want
    assert {len(log.runs(n)) for n in range(1, 200)} == set(range(1, 10))
    assert all(sum(3**level for level, _ in log.runs(n)) == n for n in range(200))
    level_two = spark.read.parquet(f"{tmp_path}/log/level=2")
    assert level_two.count() == level_two.select("k").distinct().count() <= 6
    log.append(spark.createDataFrame([(0, "again", 10**6)], schema), 8)
    assert {r["k"]: r["x"] for r in log.read(14).collect()}[0] == "again"


def test_late_feed_is_cut_into_files_and_batches(spark, tmp_path):
    import glob

    import duckdb

    from crowdtide.catalog import ORACLES, QUERIES
    from crowdtide.sources.storage import work_dir

    day = 86_400_000_000
    ts = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("id") * 7919 % 400_000) * F.lit(10 * day // 400_000))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("view", "click", "error")]), (F.col("id") % 3 + 1).cast("int"))
    spark.range(400_000).select(
        F.col("id").alias("event_id"), ts.cast("timestamp_ntz").alias("ts"), (F.col("id") * 31 % 5000).alias("user_id"), kinds.alias("event_type"),
        (F.col("id") % 100).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    before = set(glob.glob(f"{work_dir(spark).removeprefix('file:')}/late-feed-*"))
    got = sorted(map(tuple, QUERIES["late_data"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(db.sql(ORACLES["late_data"]).fetchall())
    (feed,) = set(glob.glob(f"{work_dir(spark).removeprefix('file:')}/late-feed-*")) - before
    sizes = [spark.read.parquet(f).count() for f in glob.glob(f"{feed}/*.parquet")]
    assert sum(sizes) == 400_001 and max(sizes) < 50_000
