"""Streaming queries: the driver tables played through Structured Streaming, checked against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.chat import FULL_RW, REACT, SLIDE, W, WKEY, _RW_COLS, shown
from crowdtide.catalog.common import BUCKETS, EVENT_LEXICON, MSG, SEGMENTS, TBUCKETS, register, rnd, us
from crowdtide.catalog.timeline import ALIGN, KEY, STREAM, chat, speech
from crowdtide.catalog.workflow import payloads
from crowdtide.operators import transcripts, windows
from crowdtide.sources import adapters, envelopes
from crowdtide.sources.storage import fresh_path, settle
from crowdtide.streaming import pipelines as live
from crowdtide.streaming import retention
from crowdtide.streaming.alignment import stream_align

HOUR = adapters.HOUR


def event_stream(spark, sf):
    """The event table as a stream, followed by one far-future row that lets every real window close."""
    schema = adapters.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = fresh_path(spark, "closing")
    spark.range(1).select(
        F.lit(-1).cast("long").alias("event_id"), F.to_timestamp_ntz(F.lit("2100-01-01 00:00:00")).alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).write.parquet(path)
    return rows.unionByName(spark.readStream.schema(schema).parquet(path))


def played(out, name):
    """The table a stream has written when all its input is read."""
    path = fresh_path(out.sparkSession, name)
    live.run_to_end(out, path)
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/table")


def stored_stream(df, name, per_trigger=None):
    """A result written to files and played back as a stream."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(path)


def fed(rows, parts, last, name, least=2000):
    """The rows of each condition as a batch of a stream, in order, and then those of ``last`` as one more.

    Every part is written as the same number of files, which is what a batch reads, so that no task writes or reads a
    whole part. Files hold ``least`` rows or more on average, hence none is empty and left out.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    files = max(1, min(rows.agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)]).first()) // least)
    for p in parts:
        rows.where(p).select(last.columns).repartition(files).write.mode("append").parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(last.schema).option("maxFilesPerTrigger", files).parquet(path)


REAL = "session_id <> '2100-01-01'"


@register(
    "stream_chat_buckets",
    f"""WITH {BUCKETS} SELECT {KEY}, message_count, unique_chatters, {rnd("chat_sentiment")} AS chat_sentiment, {rnd("positive")} AS positive, {rnd("negative")} AS negative FROM buckets""",
)
def _(spark, sf):
    out = live.stream_chat_buckets(adapters.messages_from_events(event_stream(spark, sf)), HOUR, "1 hour")
    return played(out, "chat-buckets").where(REAL).select(*windows.BUCKET, "message_count", "unique_chatters", "chat_sentiment", "positive", "negative")


@register(
    "stream_reaction_windows",
    f"""WITH {FULL_RW} SELECT {WKEY}, message_count, unique_chatters, {_RW_COLS}, reaction_type, {rnd("confidence")} AS confidence, 'unknown' AS target_type, target_text,
        'chat' AS source, event_hint, evidence_ids, evidence_messages FROM full_rw""",
)
def _(spark, sf):
    out = live.stream_reaction_windows(adapters.messages_from_events(event_stream(spark, sf)), W, SLIDE, EVENT_LEXICON, "1 hour")
    return played(out, "reaction-windows").where(REAL).withColumn("evidence_messages", shown("evidence_messages"))


@register(
    "stream_transcript_buckets",
    f"""WITH {TBUCKETS}, said AS (SELECT session_id, channel_id, audio_start + to_seconds(idx * 3600) AS bucket_start, string_agg(text, ' ' ORDER BY segment_start, segment_id) FILTER (text NOT LIKE 'view%') AS said FROM segidx GROUP BY session_id, channel_id, audio_start, idx)
        SELECT {KEY}, coalesce(said, '') AS text, {us}(audio_ended_at) AS audio_ended_at, {rnd("transcript_confidence")} AS transcript_confidence, segment_count FROM tbuckets JOIN said USING (session_id, channel_id, bucket_start)""",
)
def _(spark, sf):
    """Segments of views are blank, the others have white space around them."""
    starts = transcripts.session_start(adapters.segments(spark, sf))
    segs = adapters.segments_from_events(event_stream(spark, sf)).join(starts, STREAM, "left")
    segs = segs.withColumn("audio_start", F.coalesce("audio_start", "segment_start"))
    segs = segs.withColumn("text", F.when(F.col("text").startswith("view"), "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("  "))))
    out = live.stream_transcript_buckets(segs, HOUR, "2 hours")
    return played(out, "transcript-buckets").where(REAL).select(*windows.BUCKET, "text", "audio_ended_at", "transcript_confidence", "segment_count")


@register(
    "stream_upsert_latest",
    f"""WITH {MSG} SELECT username, arg_max(text, CAST(substr(message_id, 2) AS BIGINT)) AS text, max(CAST(substr(message_id, 2) AS BIGINT)) AS version FROM msg GROUP BY 1""",
)
def _(spark, sf):
    rows = stored_stream(adapters.table(spark, sf, "events").repartition(4, "event_type"), "changes", 1)
    m = adapters.messages_from_events(rows)
    changes = m.select("username", "text", F.substring("message_id", 2, 20).cast("long").alias("version"))
    return live.stream_upsert_latest(changes, fresh_path(spark, "latest"), ["username"], "version")


@register(
    "stream_align",
    f"""WITH {ALIGN} SELECT {WKEY}, {us}(chat_bucket_start) AS chat_bucket_start, {us}(transcript_bucket_start) AS transcript_bucket_start, {rnd("delta")} AS delta, relationship FROM al""",
)
def _(spark, sf):
    c, t = chat(spark, sf), speech(spark, sf).drop("segments")
    one = c.select(F.lit("chat").alias("kind"), F.lit(1).cast("long").alias("version"), F.struct(*c.columns).alias("chat"))
    two = t.select(F.lit("transcript").alias("kind"), F.lit(1).cast("long").alias("version"), F.struct(*t.columns).alias("speech"))
    both = one.unionByName(two, allowMissingColumns=True).repartition(3, F.coalesce("chat.bucket_start", "speech.bucket_start"))
    out = stream_align(stored_stream(both, "feed", 2), fresh_path(spark, "live-align"), HOUR)
    return out.select(*windows.RWINDOW, "chat_bucket_start", "transcript_bucket_start", "delta", "relationship")


@register(
    "stream_overlap_candidates",
    f"""WITH {ALIGN} SELECT session_id, channel_id, {us}(chat_bucket_start) AS c_start, {us}(transcript_bucket_start) AS t_start FROM pairs""",
)
def _(spark, sf):
    c, t = stored_stream(chat(spark, sf), "chat"), stored_stream(speech(spark, sf).drop("segments"), "speech")
    out = live.stream_overlap_candidates(c, t, HOUR, "2 hours")
    return played(out, "candidates").select(*STREAM, "c_start", "t_start")


@register(
    "stream_provisional_then_final",
    f"""WITH {BUCKETS}, {SEGMENTS} SELECT segment_id FROM seg s WHERE NOT EXISTS (SELECT 1 FROM buckets b WHERE b.session_id = s.session_id AND b.channel_id = s.channel_id
          AND b.bucket_start <= s.segment_start AND s.segment_end <= b.bucket_end)""",
)
def _(spark, sf):
    """Partial windows and committed buckets come mixed, in three batches."""
    partials = adapters.segments(spark, sf).withColumnsRenamed({"segment_start": "window_start", "segment_end": "window_end"})
    committed = chat(spark, sf).select(*windows.BUCKET)
    one = partials.select(F.struct(*partials.columns).alias("partial"))
    two = committed.select(F.struct(*committed.columns).alias("bucket"))
    both = one.unionByName(two, allowMissingColumns=True).repartition(3, F.coalesce("partial.window_start", "bucket.bucket_start"))
    return live.stream_provisional(stored_stream(both, "feed", 1), fresh_path(spark, "provisional"), HOUR).select("segment_id")


@register(
    "late_data",
    f"""WITH {BUCKETS}, n AS (SELECT max(ts) - INTERVAL 12 HOUR AS cut FROM msg), l AS (SELECT *, CAST(substr(message_id, 2) AS BIGINT) % 4 = 0 AS late FROM scored, n),
        o AS (SELECT *, (SELECT max(ts) FROM l WHERE NOT late AND ts < cut) - INTERVAL 1 DAY AS bound FROM l)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, {us}(bucket_end) AS bucket_end, count(*) AS message_count FROM o WHERE NOT late OR bucket_end > bound GROUP BY ALL""",
)
def _(spark, sf):
    """A quarter of all messages comes in a third batch, after the others: those of windows that the watermark of the
    first batch has closed by then are dropped, the rest still count."""
    m = adapters.messages(spark, sf)
    late = F.substring("message_id", 2, 20).cast("long") % 4 == 0
    newest = m.agg(F.max("timestamp").alias("newest"))
    timed = settle(m.withColumn("late", late).crossJoin(newest).withColumn("recent", F.col("timestamp") >= F.col("newest") - F.expr("INTERVAL 12 HOURS")), "timed")
    closing = timed.limit(1).withColumns({"session_id": F.lit("2100-01-01"), "timestamp": F.col("newest") + F.expr("INTERVAL 3650 DAYS")})
    feed = fed(timed, [F.expr("NOT late AND NOT recent"), F.expr("NOT late AND recent"), F.expr("late")], closing.select(m.columns), "late-feed")
    return played(live.stream_chat_buckets(feed, HOUR, "1 day"), "late-buckets").where(REAL).select(*windows.BUCKET, "message_count")


@register(
    "stream_retention",
    f"""WITH {REACT}, n AS (SELECT session_id, channel_id, max(window_end) AS newest FROM rw GROUP BY ALL) SELECT {WKEY}, message_count FROM rw JOIN n USING (session_id, channel_id) WHERE window_end >= newest - INTERVAL 60 MINUTE""",
)
def _(spark, sf):
    """Windows arrive in four batches by time, and then one of the far future, which lets every timer run."""
    found = settle(windows.reaction_core(adapters.messages(spark, sf), W, SLIDE, EVENT_LEXICON).select(*windows.RWINDOW, "message_count"), "windows")
    micros = F.unix_micros("window_end")
    low, high = found.agg(F.min(micros), F.max(micros)).first()
    part = F.least(F.lit(3), F.floor((micros - F.lit(low)) * 4 / F.lit(max(high - low, 1))))
    closing = F.to_timestamp(F.lit("2100-01-01 01:00:00"))
    last = spark.range(1).select(F.lit("2100-01-01").alias("session_id"), F.lit("c0").alias("channel_id"), closing.alias("window_start"), closing.alias("window_end"), F.lit(1).cast("long").alias("message_count"))
    feed = fed(found, [part == i for i in range(4)], last, "window-feed")
    return retention.stream_retention(feed, fresh_path(spark, "retention"), 60, "1 hour").where(REAL).select(*windows.RWINDOW, "message_count")


@register(
    "stream_event_log",
    f"""WITH {BUCKETS} SELECT session_id, channel_id, 'chat_bucket' AS event_type, count(*) AS n FROM buckets GROUP BY ALL""",
)
def _(spark, sf):
    path = fresh_path(spark, "event-log")
    envelopes.make_envelope(payloads(spark, sf), "chat_bucket", "tests").select("value").write.text(path)
    decoded = envelopes.validate_envelope(envelopes.decode_envelope(envelopes.read_event_files(spark, path)).where("decode_error IS NULL"))
    good, _ = envelopes.split_valid(decoded)
    return played(good, "events").groupBy("session_id", "channel_id", "event_type").agg(F.count("*").alias("n"))
