"""Speech, interval joins, alignment, signal windows and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.common import BUCKETS, EVENT_WEIGHTS_NEG, EVENT_WEIGHTS_POS, MSG, SEGMENTS, TBUCKETS, clamp_sql, half_away, register, rnd, us
from crowdtide.functions import keys
from crowdtide.operators import alignment, captions, filters, intervals, signals, transcripts, windows
from crowdtide.sources import adapters
from crowdtide.sources.storage import settle

HOUR = adapters.HOUR
STREAM = intervals.STREAM
KEY = f"session_id, channel_id, {us}(bucket_start) AS bucket_start, {us}(bucket_end) AS bucket_end"
WKEY = f"session_id, channel_id, {us}(window_start) AS window_start, {us}(window_end) AS window_end"


def chat(spark, sf):
    return windows.chat_buckets(adapters.messages(spark, sf), HOUR)


def speech(spark, sf):
    """Transcript buckets with the recognised confidence turned into a sentiment score."""
    segs = adapters.segments(spark, sf)
    scored = transcripts.transcript_buckets(segs, HOUR)
    mean = F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["confidence"]) / F.size("segments")
    return scored.withColumns({"sentiment_score": mean * 2 - 1, "sentiment_confidence": mean})


# --- speech -----------------------------------------------------------------


@register(
    "transcript_buckets",
    f"""WITH {TBUCKETS} SELECT {KEY}, text, {us}(audio_started_at) AS audio_started_at, {us}(audio_ended_at) AS audio_ended_at,
        {rnd("transcript_confidence")} AS transcript_confidence, segment_count, asr_latency_ms, segments FROM tbuckets JOIN (
          SELECT session_id, channel_id, bucket_start, string_agg(CAST(s AS VARCHAR) || ' ' || CAST(e AS VARCHAR) || ' ' || text || ' ' || c, '|' ORDER BY s, e, text, c) AS segments FROM (
            SELECT session_id, channel_id, audio_start + to_seconds(idx * 3600) AS bucket_start, epoch_us(segment_start) - epoch_us(audio_start) - idx * 3600000000 AS s,
              epoch_us(segment_end) - epoch_us(audio_start) - idx * 3600000000 AS e, text, CAST(CAST(floor(confidence * 1e6 + 0.5) AS BIGINT) AS VARCHAR) AS c FROM segidx) GROUP BY ALL) USING (session_id, channel_id, bucket_start)""",
)
def _(spark, sf):
    def micros(c):
        return F.rint(c * 1e6).cast("long").cast("string")

    found = transcripts.transcript_buckets(adapters.segments(spark, sf), HOUR)
    confidence = lambda s: F.floor(s["confidence"] * 1e6 + 0.5).cast("string")
    return found.withColumn("segments", F.transform("segments", lambda s: F.concat_ws(" ", micros(s["start"]), micros(s["end"]), s["text"], confidence(s))))


@register(
    "transcript_buckets_chunked",
    f"""WITH {SEGMENTS} SELECT session_id, channel_id, {us}(audio_start + to_seconds(idx * 3600)) AS bucket_start,
        CAST(sum(asr_latency_ms) AS BIGINT) AS asr_latency_ms FROM segidx GROUP BY session_id, channel_id, audio_start, idx""",
)
def _(spark, sf):
    out = transcripts.transcript_buckets(adapters.segments(spark, sf), HOUR, latency="sum")
    return out.select(*STREAM, "bucket_start", "asr_latency_ms")


@register(
    "interval_coverage",
    f"""WITH {SEGMENTS}, c AS (
          SELECT session_id, channel_id, idx, greatest(0, least((epoch_us(segment_start) - epoch_us(audio_start)) / 1e6 - idx * 3600, 3600.0)) AS lo,
                 greatest(0, least((epoch_us(segment_end) - epoch_us(audio_start)) / 1e6 - idx * 3600, 3600.0)) AS hi FROM segidx),
        m AS (SELECT *, max(hi) OVER (PARTITION BY session_id, channel_id, idx ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE hi > lo),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, channel_id, idx ORDER BY lo, hi) AS island FROM m),
        s AS (SELECT session_id, channel_id, idx, island, max(hi) - min(lo) AS span FROM i GROUP BY ALL)
        SELECT session_id, channel_id, idx, CAST(3600 AS DOUBLE) AS audio_seconds, {rnd("sum(span)")} AS covered_seconds, {rnd("1 - sum(span) / 3600")} AS empty_ratio
        FROM s GROUP BY session_id, channel_id, idx""",
)
def _(spark, sf):
    segs = adapters.segments(spark, sf)
    rel = segs.join(transcripts.session_start(segs), STREAM).withColumn("idx", transcripts.bucket_index(HOUR))

    def offset(c):
        return (F.unix_micros(c) - F.unix_micros("audio_start")) / 1e6 - F.col("idx") * HOUR

    rel = rel.withColumns({"s": offset("segment_start"), "e": offset("segment_end"), "length": F.lit(float(HOUR))})
    return transcripts.interval_coverage(rel, [*STREAM, "idx"], "s", "e", "length")


@register(
    "transcript_status",
    """SELECT event_id, CASE WHEN s IN ('pending', 'queued') THEN 'repairing' WHEN s = 'completed' THEN 'final' WHEN s = 'failed' THEN 'degraded'
          WHEN s = 'no_audio' THEN CASE WHEN event_type = 'click' THEN 'degraded' ELSE 'final' END
          WHEN user_id % 2 = 0 THEN 'final' ELSE 'live' END AS status
       FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'no_audio' ELSE '' END AS s FROM events)""",
)
def _(spark, sf):
    ev = adapters.table(spark, sf, "events")
    t = F.col("event_type")
    s = F.when(t == "purchase", "Completed").when(t == "error", "failed").when(t == "signup", "queued").when(t == "click", "no_audio").otherwise("")
    text = F.when(t == "click", "").otherwise(t)
    return ev.select("event_id", transcripts.transcript_status(s, text, F.col("user_id") % 2 == 0).alias("status"))


@register(
    "backfill_transcript",
    f"""WITH {SEGMENTS} SELECT segment_id, {rnd("CASE WHEN k <> 0 THEN k ELSE (epoch_us(segment_end) - epoch_us(segment_start)) / 1e6 END")} AS audio_seconds,
          CAST(CASE WHEN k <> 0 THEN k ELSE 1 END AS BIGINT) AS segment_count, CAST(2 AS BIGINT) AS word_count, {rnd("0.0")} AS empty_ratio,
          CAST(k AS BIGINT) AS repair_added_words, {rnd("k / 200.0")} AS repair_changed_ratio, CASE WHEN k < 50 THEN 'final' ELSE 'repairing' END AS transcript_status
        FROM (SELECT *, round(confidence * 103 - 1) AS k FROM seg)""",
)
def _(spark, sf):
    k = F.round(F.col("confidence") * 103 - 1).cast("int")
    quality = F.to_json(
        F.struct(
            k.alias("audio_coverage_seconds"), k.alias("raw_segment_count"), k.alias("repair_added_words"), (k / 200.0).alias("repair_changed_ratio"),
            F.when(k < 50, "completed").otherwise("queued").alias("repair_status"),
        )
    )
    zero = F.lit(0.0)
    segs = adapters.segments(spark, sf).select(
        "segment_id", "text", F.col("segment_start").alias("audio_started_at"), F.col("segment_end").alias("audio_ended_at"), quality.alias("quality"),
        F.array(F.lit(1)).alias("segments"), zero.alias("audio_seconds"), F.lit(0).alias("segment_count"), F.lit(0).alias("word_count"), zero.alias("empty_ratio"),
        F.lit(0).alias("repair_added_words"), zero.alias("repair_changed_ratio"), F.lit("").alias("transcript_status"),
    )
    return transcripts.backfill_transcript(segs).select(
        "segment_id", "audio_seconds", "segment_count", "word_count", "empty_ratio", "repair_added_words", "repair_changed_ratio", "transcript_status"
    )


def _repeat_sql(item: str) -> str:
    return f"SELECT doc_id, arg_min(item, (-n, pos)) AS {item} FROM (SELECT doc_id, item, count(*) AS n, min(pos) AS pos FROM"


@register(
    "transcript_target",
    f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN
           ('the','and','for','you','that','this','with','was','are','but','what','wait','huh','why','how','wow','holy','bad','not','now')) AS t FROM documents),
        p AS ({_repeat_sql("phrase")} (SELECT doc_id, unnest([t[i] || ' ' || t[i + 1] for i in range(1, len(t))]) AS item, unnest(range(1, len(t))) AS pos FROM w) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
        u AS ({_repeat_sql("term")} (SELECT doc_id, unnest(t) AS item, unnest(range(1, len(t) + 1)) AS pos FROM w) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
        SELECT d.doc_id, coalesce(phrase, term, '') AS target_text FROM documents d LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id)""",
)
def _(spark, sf):
    return transcripts.transcript_target(adapters.documents(spark, sf).select("doc_id", "text"), ["doc_id"])


@register(
    "bucket_target",
    f"""WITH w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS item,
             unnest(range(len(string_split_regex(lower(text), '[^a-z0-9]+')))) AS i FROM conversations),
        c AS (SELECT conv_id, item, count(*) AS n, min((turn, i)) AS pos FROM w WHERE length(item) >= 3 AND item NOT IN
           ('the','and','for','you','that','this','with','was','are','but','what','wait','huh','why','how','wow','holy','bad','not','now') GROUP BY ALL HAVING count(*) >= 2)
        SELECT CAST(conv_id AS VARCHAR) AS session_id, arg_min(item, (-n, pos)) AS target_text FROM c GROUP BY 1""",
)
def _(spark, sf):
    texts = adapters.turns(spark, sf).select("session_id", F.col("turn").alias("pos"), "text")
    return transcripts.bucket_target(texts, ["session_id"])


@register(
    "neighbour_context",
    f"""WITH {TBUCKETS} SELECT {KEY}, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM tbuckets
        WINDOW w AS (PARTITION BY session_id ORDER BY bucket_start, bucket_end, channel_id)""",
)
def _(spark, sf):
    out = transcripts.neighbour_context(transcripts.transcript_buckets(adapters.segments(spark, sf), HOUR))
    return out.select(*windows.BUCKET, "previous_text", "next_text")


@register(
    "caption_blocks",
    f"""WITH RECURSIVE {SEGMENTS},
        n AS (SELECT session_id, channel_id, segment_start, segment_end, text AS t, row_number() OVER w AS rn, coalesce((epoch_us(segment_start) - epoch_us(lag(segment_end) OVER w)) / 1e6 > 600, true) AS far
          FROM seg WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY segment_start, segment_id)),
        f AS (SELECT session_id, channel_id, rn, segment_start AS s, segment_end AS e, t AS text, true AS opened FROM n WHERE rn = 1
          UNION ALL SELECT session_id, channel_id, rn, CASE WHEN own THEN segment_start ELSE s END, segment_end, CASE WHEN own THEN t ELSE merged END, own FROM (
            SELECT *, far OR length(merged) > 145 AS own FROM (
              SELECT n.*, f.s, CASE WHEN ends_with(f.text, n.t) THEN f.text WHEN starts_with(n.t, f.text) THEN n.t ELSE f.text || ' ' || n.t END AS merged
              FROM f JOIN n ON n.session_id = f.session_id AND n.channel_id = f.channel_id AND n.rn = f.rn + 1))),
        b AS (SELECT *, coalesce(lead(opened) OVER (PARTITION BY session_id, channel_id ORDER BY rn), true) AS last FROM f)
        SELECT session_id, channel_id, {us}(s) AS start, {us}(e) AS "end", text FROM b WHERE last""",
)
def _(spark, sf):
    return captions.caption_blocks(adapters.segments(spark, sf), max_gap=600)


# --- intervals --------------------------------------------------------------

OVER = "greatest(0, least(epoch_us(a.{e}), epoch_us(b.{f})) - greatest(epoch_us(a.{s}), epoch_us(b.{t})))"


@register(
    "overlap_seconds",
    f"""WITH {BUCKETS}, {TBUCKETS}
        SELECT a.session_id, a.channel_id, {us}(a.bucket_start) AS chat_bucket_start, {us}(b.bucket_start) AS transcript_bucket_start,
               {rnd(OVER.format(s="bucket_start", e="bucket_end", t="bucket_start", f="bucket_end") + " / 1e6")} AS overlap_seconds
        FROM buckets a JOIN tbuckets b USING (session_id, channel_id) WHERE a.bucket_start < b.bucket_end AND b.bucket_start < a.bucket_end""",
)
def _(spark, sf):
    c = chat(spark, sf).select(*STREAM, F.col("bucket_start").alias("chat_bucket_start"), F.col("bucket_end").alias("ce"))
    t = speech(spark, sf).select(*STREAM, F.col("bucket_start").alias("transcript_bucket_start"), F.col("bucket_end").alias("te"))
    pairs = intervals.overlap_pairs(c, t, STREAM, ("chat_bucket_start", "ce"), ("transcript_bucket_start", "te"), HOUR)
    over = keys.overlap_seconds(F.col("chat_bucket_start"), F.col("ce"), F.col("transcript_bucket_start"), F.col("te"))
    return pairs.select(*STREAM, "chat_bucket_start", "transcript_bucket_start", over.alias("overlap_seconds"))


_BEST = f"""{BUCKETS}, {TBUCKETS},
cand AS (SELECT a.session_id, a.channel_id, a.bucket_start, b.bucket_start AS ts, b.bucket_end AS te, b.text,
           epoch_us(least(a.bucket_end, b.bucket_end)) - epoch_us(greatest(a.bucket_start, b.bucket_start)) AS o
         FROM buckets a JOIN tbuckets b USING (session_id, channel_id) WHERE a.bucket_start < b.bucket_end AND b.bucket_start < a.bucket_end)"""


@register(
    "best_overlap",
    f"""WITH {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY o DESC, ts) AS rn FROM cand)
        SELECT a.session_id, a.channel_id, {us}(a.bucket_start) AS bucket_start, {us}(r.ts) AS transcript_bucket_start, r.o AS overlap_us
        FROM buckets a LEFT JOIN r ON r.session_id = a.session_id AND r.channel_id = a.channel_id AND r.bucket_start = a.bucket_start AND rn = 1""",
)
def _(spark, sf):
    t = speech(spark, sf).select(*STREAM, F.col("bucket_start").alias("transcript_bucket_start"), F.col("bucket_end").alias("te"))
    out = intervals.best_overlap(
        chat(spark, sf), t, STREAM, ["bucket_start"], ("bucket_start", "bucket_end"), ("transcript_bucket_start", "te"), HOUR, ["transcript_bucket_start"]
    )
    return out.select(*STREAM, "bucket_start", "transcript_bucket_start", "overlap_us")


@register(
    "exact_or_overlap",
    f"""WITH {_BEST}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start
             ORDER BY (epoch_us(ts) // 3600000000 = epoch_us(bucket_start) // 3600000000) DESC, o DESC, ts) AS rn FROM cand)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, {us}(ts) AS transcript_bucket_start, o AS overlap_us FROM r WHERE rn = 1""",
)
def _(spark, sf):
    t = speech(spark, sf).select(*STREAM, F.col("bucket_start").alias("transcript_bucket_start"), F.col("bucket_end").alias("te"))
    same = F.date_trunc("hour", F.col("transcript_bucket_start")) == F.col("bucket_start")
    out = intervals.best_overlap(
        chat(spark, sf), t, STREAM, ["bucket_start"], ("bucket_start", "bucket_end"), ("transcript_bucket_start", "te"), HOUR, ["transcript_bucket_start"], same
    )
    return out.where(F.col("overlap_us").isNotNull()).select(*STREAM, "bucket_start", "transcript_bucket_start", "overlap_us")


@register(
    "nearest_window",
    f"""WITH {BUCKETS}, {TBUCKETS},
        l AS (SELECT session_id, channel_id, bucket_start, bucket_start + INTERVAL 90 SECOND AS ls, bucket_start + INTERVAL 150 SECOND AS le FROM buckets),
        t AS (SELECT session_id, channel_id, bucket_start AS ts, bucket_start + INTERVAL 5 MINUTE AS te FROM tbuckets),
        c AS (SELECT l.session_id, l.channel_id, l.bucket_start, t.ts,
                greatest(0, least(epoch_us(le), epoch_us(te)) - greatest(epoch_us(ls), epoch_us(ts))) AS o,
                abs((epoch_us(ls) + epoch_us(le)) / 2 - (epoch_us(ts) + epoch_us(te)) / 2) AS d
              FROM l JOIN t ON l.session_id = t.session_id AND l.channel_id = t.channel_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY CASE WHEN o > 0 THEN o ELSE -d END DESC, ts) AS rn FROM c)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, {us}(ts) AS transcript_bucket_start, CAST(o AS BIGINT) AS overlap_us FROM r WHERE rn = 1""",
)
def _(spark, sf):
    c = chat(spark, sf).withColumn("bucket_end", F.col("bucket_start") + F.expr("INTERVAL 60 SECONDS"))
    t = speech(spark, sf).select(
        *STREAM, F.col("bucket_start").alias("transcript_bucket_start"), (F.col("bucket_start") + F.expr("INTERVAL 5 MINUTES")).alias("te")
    )
    out = intervals.nearest_window(
        c, t, STREAM, ["bucket_start"], ("bucket_start", "bucket_end"), ("transcript_bucket_start", "te"), HOUR, ["transcript_bucket_start"], 90.2
    )
    return out.select(*STREAM, "bucket_start", "transcript_bucket_start", "overlap_us")


@register(
    "nearest_window_exact",
    f"""WITH {BUCKETS}, {TBUCKETS},
        l AS (SELECT session_id, channel_id, bucket_start, bucket_start AS ls, bucket_start + INTERVAL 60 SECOND AS le, CASE WHEN message_count % 3 = 0 THEN bucket_start + INTERVAL 2 HOUR END AS hint FROM buckets),
        t AS (SELECT session_id, channel_id, bucket_start AS ts, bucket_start + INTERVAL 5 MINUTE AS te, date_trunc('hour', bucket_start) AS name FROM tbuckets),
        c AS (SELECT l.session_id, l.channel_id, l.bucket_start, t.ts, coalesce(hint = name, false) AS same,
                greatest(0, least(epoch_us(le), epoch_us(te)) - greatest(epoch_us(ls), epoch_us(ts))) AS o,
                abs((epoch_us(ls) + epoch_us(le)) / 2 - (epoch_us(ts) + epoch_us(te)) / 2) AS d
              FROM l JOIN t ON l.session_id = t.session_id AND l.channel_id = t.channel_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY same DESC, CASE WHEN o > 0 THEN o ELSE -d END DESC, ts) AS rn FROM c)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, {us}(ts) AS transcript_bucket_start FROM r WHERE rn = 1""",
)
def _(spark, sf):
    """A third of the chat buckets name the transcript bucket two hours on, which wins where it exists."""
    c = chat(spark, sf).withColumn("bucket_end", F.col("bucket_start") + F.expr("INTERVAL 60 SECONDS"))
    c = c.withColumn("hint", F.when(F.col("message_count") % 3 == 0, F.col("bucket_start") + F.expr("INTERVAL 2 HOURS")))
    t = speech(spark, sf).select(
        *STREAM, F.col("bucket_start").alias("transcript_bucket_start"), (F.col("bucket_start") + F.expr("INTERVAL 5 MINUTES")).alias("te"), F.date_trunc("hour", "bucket_start").alias("name")
    )
    out = intervals.nearest_window(
        c, t, STREAM, ["bucket_start"], ("bucket_start", "bucket_end"), ("transcript_bucket_start", "te"), HOUR, ["transcript_bucket_start"], exact=("hint", "name")
    )
    return out.select(*STREAM, "bucket_start", "transcript_bucket_start")


@register(
    "drop_superseded",
    f"""WITH {BUCKETS}, {SEGMENTS} SELECT segment_id FROM seg s WHERE NOT EXISTS (
          SELECT 1 FROM buckets b WHERE b.session_id = s.session_id AND b.channel_id = s.channel_id
             AND b.bucket_start <= s.segment_start AND s.segment_end <= b.bucket_end)""",
)
def _(spark, sf):
    committed = chat(spark, sf)
    segs = adapters.segments(spark, sf)
    out = intervals.drop_superseded(segs, committed, STREAM, ("segment_start", "segment_end"), ("bucket_start", "bucket_end"), HOUR)
    return out.select("segment_id")


@register(
    "events_in_window",
    f"""WITH {SEGMENTS}, e AS (SELECT session_id, channel_id, CASE WHEN text LIKE 'click%' THEN NULL ELSE segment_start END AS t_at FROM seg),
        n AS (SELECT session_id, channel_id, count(*) AS untimed FROM e WHERE t_at IS NULL GROUP BY ALL)
        SELECT s.segment_id, (SELECT count(*) FROM e WHERE e.session_id = s.session_id AND e.channel_id = s.channel_id AND e.t_at BETWEEN s.segment_start AND s.segment_end)
               + coalesce(n.untimed, 0) AS event_count FROM seg s LEFT JOIN n USING (session_id, channel_id)""",
)
def _(spark, sf):
    segs = adapters.segments(spark, sf)
    at = F.when(~F.col("text").startswith("click"), F.col("segment_start"))
    out = intervals.events_in_window(segs, segs.select(*STREAM, at.alias("at")), STREAM, ("segment_start", "segment_end"), "at", 60)
    return out.select("segment_id", "event_count")


# --- alignment --------------------------------------------------------------

# Equal one-hour windows never contest a partner unless they are offset by exactly half, so plain ranking is enough here.
ALIGN = f"""{_BEST},
pairs AS (SELECT a.session_id, a.channel_id, a.bucket_start AS chat_bucket_start, a.bucket_end AS chat_bucket_end, b.bucket_start AS transcript_bucket_start,
            b.bucket_end AS transcript_bucket_end, greatest(a.bucket_start, b.bucket_start) AS window_start, least(a.bucket_end, b.bucket_end) AS window_end,
            a.chat_sentiment, a.sentiment_confidence AS chat_confidence, a.message_count AS chat_message_count, b.sentiment_score AS transcript_sentiment,
            b.transcript_confidence, b.text, a.chat_sentiment - b.sentiment_score AS delta,
            (epoch_us(least(a.bucket_end, b.bucket_end)) - epoch_us(greatest(a.bucket_start, b.bucket_start))) / 1e6 AS o
          FROM buckets a JOIN tbuckets b USING (session_id, channel_id) WHERE a.bucket_start < b.bucket_end AND b.bucket_start < a.bucket_end),
al AS (SELECT *, greatest(0, 1 - least(abs(delta), 2) / 2) AS similarity,
         CASE WHEN abs(delta) < 0.15 THEN 'converged' WHEN abs(delta) < 0.45 THEN 'soft_split' ELSE 'diverged' END AS relationship, strlen(text) AS len,
         {clamp_sql("least(o / 3600, 1) * 0.35 + least(chat_message_count / 20.0, 1) * 0.2 + least(chat_confidence, 1) * 0.15 + least(transcript_confidence, 1) * 0.2 + least(strlen(trim(text)) / 240.0, 1) * 0.1")} AS quality
       FROM pairs WHERE o >= 1800)"""


@register(
    "align",
    f"""WITH {ALIGN} SELECT {WKEY}, {us}(chat_bucket_start) AS chat_bucket_start, {us}(transcript_bucket_start) AS transcript_bucket_start, {rnd("delta")} AS delta,
        {rnd("similarity")} AS similarity, relationship, CAST(floor(o) AS BIGINT) AS overlap_seconds, len AS transcript_text_length, chat_message_count, {rnd("quality")} AS quality,
        CASE WHEN o / 3600 >= 0.9 THEN 'good_overlap' ELSE 'partial_overlap' END || '|' || CASE WHEN chat_message_count >= 10 THEN 'enough_chat_volume' ELSE 'low_chat_volume' END
        || '|' || CASE WHEN transcript_confidence >= 0.7 THEN 'good_transcript_confidence' ELSE 'low_transcript_confidence' END
        || '|' || CASE WHEN len >= 80 THEN 'enough_transcript_text' ELSE 'short_transcript_text' END AS quality_flags FROM al""",
)
def _(spark, sf):
    return alignment.align(chat(spark, sf), speech(spark, sf), HOUR).select(
        *windows.RWINDOW, "chat_bucket_start", "transcript_bucket_start", "delta", "similarity", "relationship", "overlap_seconds",
        "transcript_text_length", "chat_message_count", "quality", "quality_flags",
    )


LAGS = (-3600, 0, 3600)


@register(
    "lag_pairs",
    f"""WITH {BUCKETS}, {TBUCKETS}, lag(l) AS (VALUES (-3600), (0), (3600)),
        p AS (SELECT l, a.session_id, a.channel_id, a.bucket_start AS cs, b.bucket_start AS ts, a.chat_sentiment, b.sentiment_score,
                epoch_us(least(a.bucket_end + to_seconds(l), b.bucket_end)) - epoch_us(greatest(a.bucket_start + to_seconds(l), b.bucket_start)) AS o
              FROM buckets a, lag, tbuckets b WHERE a.session_id = b.session_id AND a.channel_id = b.channel_id)
        SELECT CAST(l AS BIGINT) AS lag_seconds, session_id, channel_id, {us}(cs) AS chat_bucket_start, {us}(ts) AS transcript_bucket_start,
               {rnd("chat_sentiment - sentiment_score")} AS delta FROM p WHERE o >= 1800e6""",
)
def _(spark, sf):
    out = alignment.lag_pairs(chat(spark, sf), speech(spark, sf), LAGS, HOUR)
    return out.select("lag_seconds", *STREAM, "chat_bucket_start", "transcript_bucket_start", "delta")


# Two half-hour labels per chat bucket with alternating content serve as window labels.
LABELS = """lab AS (
  SELECT session_id, bucket_start - INTERVAL 10 MINUTE AS label_start, bucket_start + INTERVAL 20 MINUTE AS label_end,
         CASE WHEN chat_sentiment < -0.5 THEN ' Frustration_Spike' WHEN chat_sentiment < -0.4 THEN '' ELSE 'none' END AS event_label FROM buckets
  UNION ALL
  SELECT session_id, bucket_start, bucket_end, CASE WHEN message_count > 7 THEN 'hype_spike' WHEN message_count > 5 THEN 'none' ELSE '' END FROM buckets)"""


def window_labels(b):
    s = F.col("chat_sentiment")
    first = b.select(
        "session_id",
        (F.col("bucket_start") - F.expr("INTERVAL 10 MINUTES")).alias("window_start"),
        (F.col("bucket_start") + F.expr("INTERVAL 20 MINUTES")).alias("window_end"),
        F.when(s < -0.5, " Frustration_Spike").when(s < -0.4, "").otherwise("none").alias("event_label"),
    )
    n = F.col("message_count")
    second = b.select(
        "session_id",
        F.col("bucket_start").alias("window_start"),
        F.col("bucket_end").alias("window_end"),
        F.when(n > 7, "hype_spike").when(n > 5, "none").otherwise("").alias("event_label"),
    )
    return first.unionByName(second)


@register(
    "overlap_label",
    f"""WITH {ALIGN}, {LABELS}, c AS (SELECT a.session_id, a.channel_id, a.window_start, a.window_end, lower(trim(event_label)) AS l, label_start, label_end
          FROM al a JOIN lab ON lab.session_id = a.session_id AND a.window_start < label_end AND label_start < a.window_end AND trim(event_label) <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, window_start, window_end ORDER BY l = 'none', label_start, label_end, l) AS rn FROM c)
        SELECT a.session_id, a.channel_id, {us}(a.window_start) AS window_start, {us}(a.window_end) AS window_end, coalesce(r.l, '') AS label
        FROM al a LEFT JOIN r ON r.session_id = a.session_id AND r.channel_id = a.channel_id AND r.window_start = a.window_start AND r.window_end = a.window_end AND rn = 1""",
)
def _(spark, sf):
    al = alignment.align(chat(spark, sf), speech(spark, sf), HOUR)
    return alignment.overlap_label(al, window_labels(chat(spark, sf)), HOUR).select(*windows.RWINDOW, "label")


@register(
    "gold_label",
    f"""WITH {BUCKETS}, {LABELS}, c AS (SELECT a.session_id, a.channel_id, a.bucket_start, a.bucket_end, CASE WHEN trim(event_label) = '' THEN 'none' ELSE lower(trim(event_label)) END AS l,
             label_start, label_end, a.bucket_start = label_start AND a.bucket_end = label_end AS exact
          FROM buckets a JOIN lab ON lab.session_id = a.session_id AND a.bucket_start < label_end AND label_start < a.bucket_end),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY NOT exact, l = 'none', label_start, label_end, l) AS rn FROM c)
        SELECT {KEY.replace("bucket_", "bucket_")}, l AS gold_label FROM r WHERE rn = 1""",
)
def _(spark, sf):
    b = chat(spark, sf).select(*STREAM, F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end"))
    out = alignment.gold_label(b, window_labels(chat(spark, sf)), HOUR)
    return out.select(*STREAM, F.col("window_start").alias("bucket_start"), F.col("window_end").alias("bucket_end"), "gold_label")


# --- signals ----------------------------------------------------------------

SIGNAL = f"""{ALIGN},
sw0 AS (SELECT b.*, lag(chat_sentiment) OVER (PARTITION BY session_id, channel_id ORDER BY bucket_start, bucket_end) AS previous_sentiment FROM buckets b),
sw AS (SELECT s.*, a.delta AS alignment_delta, a.quality AS alignment_quality, a.relationship, a.transcript_sentiment, a.transcript_confidence AS tconf,
         CASE WHEN a.quality IS NULL THEN s.sentiment_confidence WHEN s.sentiment_confidence = 0 THEN a.quality ELSE (s.sentiment_confidence + a.quality) / 2 END AS confidence
       FROM sw0 s LEFT JOIN al a ON a.session_id = s.session_id AND a.channel_id = s.channel_id AND a.chat_bucket_start = s.bucket_start),
sx AS (SELECT *, CASE WHEN confidence < 0.35 THEN 'neutral' WHEN chat_sentiment >= 0.35 THEN 'hype' WHEN chat_sentiment <= -0.35 THEN 'frustration' ELSE 'neutral' END AS reaction_type FROM sw),
evs AS (
  SELECT *, 'audience_shift' AS type, 1 AS ord, least(abs(chat_sentiment - previous_sentiment) / 2, 1) AS severity FROM sx WHERE abs(chat_sentiment - previous_sentiment) >= 0.45
  UNION ALL SELECT *, 'hype_spike', 2, least((positive + greatest(chat_sentiment, 0)) / 2, 1) FROM sx WHERE positive >= 0.55 AND chat_sentiment >= 0.35
  UNION ALL SELECT *, 'frustration_spike', 3, least((negative + abs(least(chat_sentiment, 0))) / 2, 1) FROM sx WHERE negative >= 0.55 AND chat_sentiment <= -0.35
  UNION ALL SELECT *, 'content_audience_divergence', 4, least(abs(alignment_delta) / 2, 1) FROM sx WHERE abs(alignment_delta) >= 0.45)"""


def signal(spark, sf):
    buckets = settle(chat(spark, sf), "chat")
    al = alignment.align(buckets, speech(spark, sf), HOUR)
    return signals.signal_windows(buckets, al, orphans=False)


@register(
    "detected_events",
    f"""WITH {MSG}, kept AS (SELECT *, CASE WHEN text IN ('purchase', 'signup', 'error') THEN 1 ELSE 0 END + CASE WHEN text = 'purchase' THEN 1 ELSE 0 END AS hits,
            CASE text WHEN 'purchase' THEN 1.9 WHEN 'signup' THEN 0.5 WHEN 'error' THEN -1.0 ELSE 0 END AS total FROM scored WHERE NOT is_bot_likely),
        lx AS (SELECT session_id, channel_id, bucket_start, bucket_end, username, CASE WHEN hits = 0 THEN 0 ELSE total / hits END AS s,
                 CASE WHEN hits = 0 THEN 0.25 ELSE 0.35 + hits * 0.12 END AS c FROM kept),
        b AS (SELECT session_id, channel_id, bucket_start, bucket_end, avg(s) AS chat_sentiment, avg(c) AS conf, avg(CASE WHEN s > 0.15 THEN 1.0 ELSE 0 END) AS positive,
                 avg(CASE WHEN s < -0.15 THEN 1.0 ELSE 0 END) AS negative FROM lx GROUP BY ALL),
        p AS (SELECT *, lag(chat_sentiment) OVER (PARTITION BY session_id, channel_id ORDER BY bucket_start, bucket_end) AS prev FROM b),
        e AS (SELECT *, 'audience_shift' AS type, abs(chat_sentiment - prev) / 2 AS severity FROM p WHERE abs(chat_sentiment - prev) >= 0.45
          UNION ALL SELECT *, 'hype_spike', (positive + chat_sentiment) / 2 FROM p WHERE positive >= 0.55 AND chat_sentiment >= 0.35
          UNION ALL SELECT *, 'frustration_spike', (negative - chat_sentiment) / 2 FROM p WHERE negative >= 0.55 AND chat_sentiment <= -0.35)
        SELECT session_id, channel_id, {us}(bucket_start) AS window_start, {us}(bucket_end) AS window_end, type, {rnd("least(severity, 1)")} AS severity,
          CASE type WHEN 'hype_spike' THEN 'hype' WHEN 'frustration_spike' THEN 'frustration' ELSE CASE WHEN conf < 0.35 THEN 'neutral' WHEN chat_sentiment >= 0.35 THEN 'hype'
            WHEN chat_sentiment <= -0.35 THEN 'frustration' ELSE 'neutral' END END AS reaction_type FROM e""",
)
def _(spark, sf):
    from crowdtide.plans.live import lexicon_events

    return lexicon_events(adapters.messages(spark, sf), HOUR, {**EVENT_WEIGHTS_POS, "pogchamp": 0.9}, EVENT_WEIGHTS_NEG).select(*windows.RWINDOW, "type", "severity", "reaction_type")


@register(
    "previous_sentiment",
    f"""WITH {BUCKETS} SELECT {KEY}, {rnd("chat_sentiment")} AS chat_sentiment,
        {rnd("lag(chat_sentiment) OVER (PARTITION BY session_id, channel_id ORDER BY bucket_start, bucket_end)")} AS previous_sentiment FROM buckets""",
)
def _(spark, sf):
    return signals.previous_sentiment(chat(spark, sf)).select(*windows.BUCKET, "chat_sentiment", "previous_sentiment")


@register(
    "signal_windows",
    f"""WITH {SIGNAL} SELECT session_id, channel_id, {us}(bucket_start) AS window_start, message_count, {rnd("alignment_delta")} AS alignment_delta,
        {rnd("confidence")} AS confidence, reaction_type, coalesce(relationship, '') AS relationship, {rnd("(chat_sentiment + transcript_sentiment) / 2")} AS aggregate_sentiment,
        coalesce((SELECT arg_min(type, ord) FROM evs e WHERE e.session_id = sx.session_id AND e.channel_id = sx.channel_id AND e.bucket_start = sx.bucket_start), '') AS first_event_type,
        CASE WHEN alignment_delta IS NULL THEN 'chat' ELSE 'alignment' END AS source,
        CASE WHEN reaction_type = 'neutral' OR confidence < 0.35 THEN 'neutral' ELSE coalesce((SELECT arg_min(type, ord) FROM evs e WHERE e.session_id = sx.session_id AND e.channel_id = sx.channel_id AND e.bucket_start = sx.bucket_start), reaction_type) END AS event_hint
        FROM sx""",
)
def _(spark, sf):
    return signal(spark, sf).select(
        *STREAM, "window_start", "message_count", "alignment_delta", "confidence", "reaction_type", "relationship", "aggregate_sentiment", "first_event_type", "source", "event_hint"
    )


@register(
    "signal_events",
    f"""WITH {SIGNAL} SELECT session_id, channel_id, {us}(bucket_start) AS window_start, {us}(bucket_end) AS window_end, type, {rnd("severity")} AS severity,
        CASE type WHEN 'hype_spike' THEN 'hype' WHEN 'frustration_spike' THEN 'frustration' ELSE reaction_type END AS reaction_type,
        CASE WHEN type = 'content_audience_divergence' THEN 'alignment' ELSE 'chat' END AS source,
        {rnd(half_away("CASE WHEN type = 'content_audience_divergence' THEN CASE WHEN sentiment_confidence > 0 THEN (alignment_quality + sentiment_confidence) / 2 ELSE alignment_quality END WHEN sentiment_confidence > 0 THEN sentiment_confidence ELSE severity END"))} AS confidence,
        'unknown' AS target_type, '' AS target_text, type AS event_hint, '' AS text, '' AS evidence_ids FROM evs""",
)
def _(spark, sf):
    context = ["target_type", "target_text", "event_hint", "text", "evidence_ids"]
    return signals.signal_events(signal(spark, sf)).select(*windows.RWINDOW, "type", "severity", "reaction_type", "source", "confidence", *context)


@register(
    "transcript_gaps",
    f"""WITH {SEGMENTS}, g AS (SELECT segment_id, CASE WHEN text LIKE 'view%' THEN '  ' ELSE text END AS t, confidence FROM seg)
        SELECT segment_id, {rnd("confidence")} AS transcript_confidence FROM g WHERE trim(t) = '' AND confidence < 0.35""",
)
def _(spark, sf):
    segs = adapters.segments(spark, sf).select(
        "segment_id", F.when(F.col("text").startswith("view"), "  ").otherwise(F.col("text")).alias("text"), F.col("confidence").alias("transcript_confidence")
    )
    return filters.transcript_gaps(segs).select("segment_id", "transcript_confidence")


_TS = r"regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z'"
_TITLE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{head}'" for k, (head, _) in signals.TITLES.items()) + " END"
_TEXT = "CASE WHEN type = 'content_audience_divergence' AND relationship <> '' THEN 'Chat and transcript sentiment relationship is ' || relationship || ' in this replay window.' " + " ".join(
    f"WHEN type = '{k}' THEN '{body}'" for k, (_, body) in signals.TITLES.items()
) + " END"
_VALUES = {"chat_sentiment": "chat_sentiment", "previous_chat_sentiment": "previous_sentiment", "transcript_sentiment": "transcript_sentiment", "alignment_delta": "alignment_delta"}
INSIGHT = f"""{SIGNAL},
ins AS (SELECT session_id, channel_id, type AS kind, bucket_start AS window_start, bucket_end AS window_end, severity,
          CASE WHEN alignment_quality IS NULL THEN sentiment_confidence ELSE (sentiment_confidence + alignment_quality) / 2 END AS confidence, {_TITLE} AS title, {_TEXT} AS description,
          concat_ws('|', {", ".join(f"'{n} ' || CAST(CAST(floor({c} * 1e6 + 0.5) AS BIGINT) AS VARCHAR)" for n, c in _VALUES.items())}) AS evidence,
          'ins_' || left(sha1(session_id || '|' || channel_id || '|' || type || '|' || {_TS.format(c="bucket_start")} || '|' || {_TS.format(c="bucket_end")} || '|' || printf('%.3f', {half_away("severity")})), 16) AS insight_id
        FROM evs),
inr AS (SELECT *, {half_away("severity * 0.7 + confidence * 0.3")} AS rank FROM ins)"""


@register(
    "insights",
    f"""WITH {INSIGHT} SELECT {WKEY}, insight_id, kind, {rnd("severity")} AS severity, {rnd("confidence")} AS confidence, {rnd("rank")} AS rank, title, description, evidence,
        row_number() OVER (PARTITION BY session_id ORDER BY window_start, severity DESC, insight_id) AS position FROM inr""",
)
def _(spark, sf):
    found = signals.order_insights(signals.insights(signal(spark, sf)))
    shown = F.transform("evidence", lambda e: F.concat_ws(" ", e["type"], F.floor(e["value"] * 1e6 + 0.5).cast("string")))
    return found.select(*windows.RWINDOW, "insight_id", "kind", "severity", "confidence", "rank", "title", "description", shown.alias("evidence"), "position")


@register(
    "top_insights",
    f"""WITH {INSIGHT}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank DESC, window_start, severity DESC, insight_id) AS place FROM inr)
        SELECT session_id, place, insight_id, {rnd("rank")} AS rank FROM r WHERE place <= 3""",
)
def _(spark, sf):
    return signals.top_insights(signals.insights(signal(spark, sf))).select("session_id", "place", "insight_id", "rank")


_BEST_OF = {"biggest_divergence": "content_audience_divergence", "highest_hype": "hype_spike", "highest_frustration": "frustration_spike"}


@register(
    "insight_summary",
    f"""WITH {INSIGHT}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank DESC, window_start, severity DESC, insight_id) AS place FROM inr),
        lc AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank DESC, window_start, severity DESC, insight_id) AS place FROM inr WHERE confidence < 0.55)
        SELECT * EXCLUDE (lcf), coalesce(lcf, '') AS low_confidence_flags FROM (SELECT session_id, count(*) AS insight_count, count(*) FILTER (severity >= 0.7) AS high_severity_count, {rnd("max(severity)")} AS max_severity,
          {rnd(half_away("avg(severity)"))} AS average_severity, arg_min(kind, (-severity, insight_id)) AS primary_insight_kind, arg_min(insight_id, (-severity, insight_id)) AS top_insight_id,
          string_agg(insight_id, '|' ORDER BY place) FILTER (place <= 3) AS top_moments, count(*) AS event_count,
          {", ".join(f"arg_max(insight_id, (rank, -epoch_us(window_start), severity, insight_id)) FILTER (kind = '{k}') AS {n}" for n, k in _BEST_OF.items())},
          (SELECT string_agg(insight_id, '|' ORDER BY place) FROM lc WHERE lc.session_id = r.session_id AND place <= 3) AS lcf FROM r GROUP BY session_id)""",
)
def _(spark, sf):
    return signals.insight_summary(signals.insights(signal(spark, sf))).select(
        "session_id", "insight_count", "high_severity_count", "event_count", "max_severity", "average_severity", "primary_insight_kind", "top_insight_id", *_BEST_OF, "top_moments", "low_confidence_flags"
    )
