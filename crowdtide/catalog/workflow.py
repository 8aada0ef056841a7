"""Reviews, series, models, event log and storage."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import functions as F

from crowdtide.catalog.audit import aligned, stored
from crowdtide.catalog.chat import SLIDE, W
from crowdtide.catalog.common import BUCKETS, EVENT_LEXICON, MSG, SEGMENTS, TBUCKETS, half_away, register, rnd, us
from crowdtide.catalog.timeline import ALIGN, KEY, LABELS, SIGNAL, STREAM, chat, signal, speech, window_labels
from crowdtide.operators import filters, models, reviews, series, signals, windows
from crowdtide.operators.alignment import offset_relationship
from crowdtide.sources import adapters, chat_log, contracts, envelopes, replays, storage
from crowdtide.sources import payloads as payload_contracts
from crowdtide.sources.storage import settle

HOUR = adapters.HOUR

# --- series -----------------------------------------------------------------


@register(
    "keep_latest",
    f"""WITH {BUCKETS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bucket_start DESC, channel_id DESC) AS rn FROM buckets) SELECT {KEY} FROM r WHERE rn <= 20""",
)
def _(spark, sf):
    return series.keep_latest(chat(spark, sf), ["session_id"], ["bucket_start", "channel_id"], 20).select(*windows.BUCKET)


GAPPY = f"""gp AS (SELECT session_id, channel_id, bucket_start, CASE WHEN message_count % 3 <> 0 THEN chat_sentiment * 2 END AS v FROM buckets)"""
FILLED = f"""fl AS (SELECT session_id, channel_id, bucket_start, last_value(CASE WHEN v IS NOT NULL THEN least(greatest(v, -1), 1) END IGNORE NULLS) OVER (PARTITION BY session_id, channel_id ORDER BY bucket_start ROWS UNBOUNDED PRECEDING) AS filled FROM {{src}})"""


def gappy(spark, sf):
    return chat(spark, sf).select(*STREAM, "bucket_start", F.when(F.col("message_count") % 3 != 0, F.col("chat_sentiment") * 2).alias("v"))


@register("forward_fill", f"WITH {BUCKETS}, {GAPPY}, {FILLED.format(src='gp')} SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, {rnd('filled')} AS filled FROM fl WHERE filled IS NOT NULL")
def _(spark, sf):
    return series.forward_fill(gappy(spark, sf), STREAM, ["bucket_start"], "v").drop("v")


@register(
    "series_range_and_trend",
    f"""WITH {BUCKETS}, {GAPPY}, g8 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id ORDER BY bucket_start DESC) AS rn FROM gp) WHERE rn <= 8), {FILLED.format(src='g8')}
        SELECT session_id, channel_id, {rnd("CASE WHEN count(*) > 1 THEN max(filled) - min(filled) ELSE 0 END")} AS value_range, {rnd("CASE WHEN count(*) > 1 THEN arg_max(filled, bucket_start) - arg_min(filled, bucket_start) ELSE 0 END")} AS value_trend
        FROM fl WHERE filled IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    return series.series_range_and_trend(gappy(spark, sf), STREAM, ["bucket_start"], "v", 8)


@register(
    "rate_trend",
    f"""WITH {BUCKETS}, r AS (SELECT *, floor(message_count * 100 / 3600.0 * 60 + 0.5) AS rate FROM buckets), l AS (SELECT *, lag(rate) OVER (PARTITION BY session_id, channel_id ORDER BY bucket_start) AS prev FROM r)
        SELECT {KEY}, CAST(rate AS BIGINT) AS rate, CAST(CASE WHEN rate <> 0 AND prev <> 0 THEN floor((rate - prev) / prev * 100 + 0.5) END AS BIGINT) AS trend_percent,
          CAST(max(rate) OVER (PARTITION BY session_id, channel_id) AS BIGINT) AS peak_rate FROM l""",
)
def _(spark, sf):
    scaled = chat(spark, sf).withColumn("message_count", F.col("message_count") * 100)
    return series.rate_trend(scaled).select(*windows.BUCKET, "rate", "trend_percent", "peak_rate")


@register(
    "merge_window_series",
    f"""WITH {BUCKETS}, {TBUCKETS}, t AS (SELECT session_id, channel_id, date_trunc('hour', bucket_start) AS bucket_start, date_trunc('hour', bucket_start) + INTERVAL 1 HOUR AS bucket_end, any_value(sentiment_score) AS s, any_value(segment_count * 2) AS w
            FROM tbuckets GROUP BY ALL)
        SELECT {KEY}, {rnd("b.chat_sentiment")} AS chat, {rnd("t.s")} AS transcript, {rnd("CASE WHEN b.chat_sentiment IS NULL THEN t.s WHEN t.s IS NULL THEN b.chat_sentiment ELSE (b.chat_sentiment + t.s) / 2 END")} AS aggregate,
          CAST(greatest(coalesce(message_count, 0), coalesce(w, 0)) AS BIGINT) AS messages, CASE WHEN b.chat_sentiment IS NULL THEN 'transcript' ELSE 'chat' END AS source
        FROM buckets b FULL JOIN t USING (session_id, channel_id, bucket_start, bucket_end)""",
)
def _(spark, sf):
    t = speech(spark, sf).withColumn("bucket_start", F.date_trunc("hour", "bucket_start"))
    return series.merge_window_series(chat(spark, sf), t.withColumn("bucket_end", F.col("bucket_start") + F.expr("INTERVAL 1 HOUR")))


@register(
    "caption_quality",
    f"""WITH {SEGMENTS}, s AS (SELECT *, text LIKE 'view%' AS e FROM seg)
        SELECT session_id, count(*) AS segment_count, CAST(quantile_disc(asr_latency_ms, 0.5) AS DOUBLE) AS p50_latency_ms, CAST(quantile_disc(asr_latency_ms, 0.95) AS DOUBLE) AS p95_latency_ms,
          {rnd("quantile_disc(CASE WHEN NOT e THEN confidence END, 0.5)")} AS median_confidence, {rnd("count(*) FILTER (e) / count(*)")} AS empty_rate, {rnd("sum(1.0) / sum(5.0)")} AS drop_rate FROM s GROUP BY 1""",
)
def _(spark, sf):
    s = adapters.segments(spark, sf).withColumns(
        {
            "text": F.when(F.col("text").startswith("view"), " ").otherwise(F.col("text")),
            "pipeline_latency_ms": F.lit(None).cast("long"),
            "quality": F.lit('{"raw_segment_count": 5, "dropped_repeat_count": 1}'),
        }
    )
    return series.caption_quality(s)


@register(
    "timeline_points",
    f"""WITH {SIGNAL}, raw AS (SELECT session_id, channel_id, bucket_start AS s, bucket_end AS e, 0 AS p FROM sx UNION ALL SELECT session_id, channel_id, window_start, window_end, 1 FROM al
          UNION ALL SELECT session_id, channel_id, bucket_start, bucket_end, 2 FROM buckets UNION ALL SELECT session_id, channel_id, bucket_start, bucket_end, 3 FROM tbuckets),
        a AS (SELECT * REPLACE (greatest(p, CAST(right(session_id, 2) AS INTEGER) % 4) AS p) FROM raw),
        b AS (SELECT session_id, min(p) AS best FROM a GROUP BY 1)
        SELECT session_id, channel_id, {us}(s) AS window_start, {us}(e) AS window_end, CASE p WHEN 0 THEN 'signal' WHEN 1 THEN 'alignment' WHEN 2 THEN 'chat' ELSE 'transcript' END AS source FROM a JOIN b USING (session_id) WHERE p = best
        UNION ALL SELECT session_id, channel_id, {us}(bucket_start), {us}(bucket_end), 'reaction' FROM buckets JOIN b USING (session_id) WHERE best < 3""",
)
def _(spark, sf):
    """Every row of the four tables is in one of the four inputs; the day of a session tells the best source it has."""
    c, t, al = stored(spark, sf)
    b = ("bucket_start", "bucket_end")
    ranges = [(signals.signal_windows(c, al, orphans=False), ("window_start", "window_end")), (al, ("window_start", "window_end")), (c, b), (t, b)]
    best = F.substring("session_id", 9, 2).cast("int") % 4
    rows = [
        df.select(*STREAM, F.col(s).alias("window_start"), F.col(e).alias("window_end"), F.greatest(F.lit(i), best).alias("p")) for i, (df, (s, e)) in enumerate(ranges)
    ]
    every = settle(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]), "sources")
    named = [every.where(F.col("p") == i) for i in range(4)]
    named[2:] = [df.withColumnsRenamed({"window_start": "bucket_start", "window_end": "bucket_end"}) for df in named[2:]]
    return series.timeline_points(*named, c.select(*STREAM, F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end")))


@register(
    "timeline_value",
    f"""WITH {ALIGN}, m AS (SELECT *, hour(window_start) % 3 = 0 AS moved, chat_sentiment - transcript_sentiment AS d FROM al)
        SELECT session_id, channel_id, {us}(window_start) AS window_start, {rnd("(chat_sentiment + transcript_sentiment) / 2")} AS point_score, {rnd("d")} AS point_delta,
          {rnd("CASE WHEN moved THEN (chat_confidence + transcript_confidence) / 2 ELSE quality END")} AS point_quality, chat_message_count AS point_messages,
          CASE WHEN moved THEN CASE WHEN abs(d) >= 0.45 THEN 'diverged' WHEN abs(d) >= 0.2 THEN 'soft_split' ELSE 'converged' END ELSE relationship END AS point_relationship FROM m""",
)
def _(spark, sf):
    al = aligned(spark, sf)
    none = F.lit(None)
    sig = none.cast("struct<aggregate_sentiment:double,chat_sentiment:double,transcript_sentiment:double,alignment_delta:double,confidence:double,alignment_quality:double,message_count:bigint,relationship:string>")
    rea = none.cast("struct<reaction_score:double,hype_score:double,confusion_score:double,frustration_score:double,intensity_score:double,confidence:double,message_count:bigint>")
    pts = al.select(
        *STREAM, "window_start", sig.alias("signal"), rea.alias("reaction"), F.struct("chat_sentiment", "transcript_sentiment", "delta", "quality", "chat_message_count", "relationship").alias("alignment"),
        F.struct("chat_sentiment", F.col("chat_confidence").alias("sentiment_confidence"), none.cast("double").alias("peak_reaction_score"), F.col("chat_message_count").alias("message_count")).alias("chat"),
        F.struct(F.col("transcript_sentiment").alias("sentiment_score"), F.col("transcript_confidence").alias("sentiment_confidence")).alias("transcript"),
        F.when(F.hour("window_start") % 3 == 0, 30).otherwise(0).alias("offset_seconds"),
    )
    return series.timeline_values(pts).select(*STREAM, "window_start", "point_score", "point_delta", "point_quality", "point_messages", "point_relationship")


@register(
    "relationship",
    """SELECT l_orderkey, l_linenumber, CASE WHEN d < 0.15 THEN 'converged' WHEN d < 0.45 THEN 'soft_split' ELSE 'diverged' END AS stored_scale,
              CASE WHEN d < 0.2 THEN 'converged' WHEN d < 0.45 THEN 'soft_split' ELSE 'diverged' END AS offset_scale FROM (SELECT *, abs(l_quantity / 50 - 0.5) AS d FROM lineitem)""",
)
def _(spark, sf):
    from crowdtide.operators.alignment import relationship

    d = F.col("l_quantity") / 50 - 0.5
    return adapters.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", relationship(d).alias("stored_scale"), offset_relationship(d).alias("offset_scale"))


@register(
    "transcript_reaction",
    rf"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations),
        w AS (SELECT message_id, t, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS w FROM t WHERE t <> ''),
        h AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: x IN ('amazing','awesome','best','clutch','great','hype','insane','love','nice','perfect','wow','yes'))) AS pos,
                len(list_filter(w, lambda x: x IN ('awful','bad','broken','hate','lost','no','rough','terrible','ugh','unlucky','worse','wrong'))) AS neg,
                len(list_filter(w, lambda x: x IN ('confused','how','huh','wait','what','where','why'))) AS cf, len(list_filter(w, lambda x: x IN ('angry','annoying','bad','hate','mad','terrible','ugh','wrong'))) AS fr,
                len(string_split(t, ' ')) AS words, len(regexp_extract_all(t, '[!?]')) AS marks, len(regexp_extract_all(t, '!')) AS bangs FROM w),
        v AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE least(greatest((pos - neg) / greatest(pos + neg, 2), -1), 1) END AS val FROM h),
        i AS (SELECT *, least(greatest(0.08 + (least(0.5, words / 34.0) + least(0.24, marks * 0.06) + least(0.2, abs(val) * 0.2)), 0.05), 1) AS inten FROM v)
        SELECT message_id, {rnd("val")} AS valence, {rnd("inten")} AS intensity_score, {rnd("least(CASE WHEN n = 0 THEN 0 ELSE least(pos / greatest(3, n), 1) END * 0.7 + inten * 0.22 + least(0.24, bangs * 0.08), 1)")} AS hype_score,
          {rnd("CASE WHEN n = 0 THEN 0.0 ELSE least(cf / greatest(3, n), 1) END")} AS confusion_score, {rnd("CASE WHEN n = 0 THEN 0.0 ELSE least(fr / greatest(3, n), 1) END")} AS frustration_score,
          CAST(words AS BIGINT) AS message_count, CAST(floor(words / 20.0 * 60 + 0.5) AS BIGINT) AS messages_per_minute,
          CASE WHEN inten >= 0.68 AND val >= 0.1 THEN 'voice_hype' WHEN val <= -0.25 THEN 'voice_frustration' WHEN val >= 0.25 THEN 'voice_positive' ELSE 'voice_partial' END AS reaction_type FROM i""",
)
def _(spark, sf):
    t = adapters.turns(spark, sf).select("message_id", "text", F.col("timestamp").alias("window_start"), (F.col("timestamp") + F.expr("INTERVAL 20 SECONDS")).alias("window_end"))
    return series.transcript_reaction(t).select("message_id", "valence", "intensity_score", "hype_score", "confusion_score", "frustration_score", "message_count", "messages_per_minute", "reaction_type")


@register(
    "merge_committed_provisional",
    f"""WITH {BUCKETS}, {SEGMENTS}, a AS (SELECT session_id, channel_id, bucket_start AS s, bucket_end AS e, 0 AS provisional FROM buckets UNION ALL SELECT session_id, channel_id, segment_start, segment_end, 1 FROM seg)
        SELECT session_id, channel_id, {us}(s) AS window_start, {us}(e) AS window_end, CAST(provisional AS BIGINT) AS provisional FROM a""",
)
def _(spark, sf):
    done = chat(spark, sf).select(*STREAM, F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end"))
    live = adapters.segments(spark, sf).select(*STREAM, F.col("segment_start").alias("window_start"), F.col("segment_end").alias("window_end"))
    return series.merge_committed_provisional(done, live)


# --- reviews ----------------------------------------------------------------


def nested(spark, sf):
    """Four-hour buckets with their reaction windows, as a store holds them."""
    msgs = adapters.messages(spark, sf)
    rw = windows.reaction_windows(msgs, W, SLIDE, EVENT_LEXICON)
    return settle(windows.attach_peaks(windows.chat_buckets(msgs, 4 * HOUR), rw, 4 * HOUR), "nested")


def contexts(spark, sf):
    _, t, al = stored(spark, sf)
    b = nested(spark, sf)
    return settle(reviews.with_context(reviews.review_windows(b, al, t), b, al, t, 4 * HOUR), "contexts")


@register(
    "review_windows",
    f"""WITH {ALIGN}, ch AS (SELECT * FROM buckets WHERE CAST(right(session_id, 2) AS INTEGER) % 2 = 0), sp AS (SELECT session_id, bucket_start, bucket_end FROM tbuckets
            UNION ALL SELECT session_id, bucket_start, bucket_end FROM buckets WHERE CAST(right(session_id, 2) AS INTEGER) % 2 = 1),
        a AS (SELECT DISTINCT session_id, 'chat_bucket_30s' AS k, bucket_start AS s, bucket_end AS e FROM ch UNION SELECT session_id, 'reaction_subwindow', bucket_start, bucket_start + INTERVAL 10 MINUTE FROM ch
          UNION SELECT session_id, 'alignment_bucket', window_start, window_end FROM al UNION SELECT session_id, 'transcript_bucket_30s', bucket_start, bucket_end FROM sp WHERE session_id NOT IN (SELECT session_id FROM ch))
        SELECT session_id, k AS source_window_type, {us}(s) AS window_start, {us}(e) AS window_end FROM a""",
)
def _(spark, sf):
    """Buckets of odd days go in as speech, so that those sessions have none of chat; every bucket is in one input."""
    c, t, al = stored(spark, sf)
    sub = F.struct(F.col("bucket_start").alias("window_start"), (F.col("bucket_start") + F.expr("INTERVAL 10 MINUTES")).alias("window_end"), F.col("positive").alias("reaction_score"))
    even = F.substring("session_id", 9, 2).cast("int") % 2 == 0
    spoken = t.select(*windows.BUCKET).unionByName(c.where(~even).select(*windows.BUCKET))
    return reviews.review_windows(c.where(even).withColumn("subwindows", F.array(sub)), al, spoken).select("session_id", "source_window_type", "window_start", "window_end")


@register("review_rows")
def _(spark, sf):
    return reviews.review_rows(contexts(spark, sf), window_labels(chat(spark, sf)), "run", HOUR)


@register(
    "suggest_label",
    f"""WITH {ALIGN}, x AS (SELECT *, hour(window_start) AS h FROM al)
        SELECT session_id, channel_id, {us}(window_start) AS window_start, CASE WHEN h % 4 = 1 THEN 'hype_spike' WHEN h % 4 = 2 THEN 'audience_shift' WHEN relationship = 'diverged' OR abs(delta) >= 0.45 THEN 'content_audience_divergence'
          WHEN (chat_sentiment + transcript_sentiment) / 2 >= 0.35 THEN 'hype_spike' WHEN (chat_sentiment + transcript_sentiment) / 2 <= -0.35 THEN 'frustration_spike' ELSE 'none' END AS suggested,
          {rnd("floor(least(greatest((chat_confidence + quality + transcript_confidence) / 3, 0), 1) * 1e4 + 0.5) / 1e4")} AS confidence FROM x""",
)
def _(spark, sf):
    al = aligned(spark, sf)
    none = F.lit(None)
    h = F.hour("window_start") % 4
    pts = al.select(
        *STREAM, "window_start", none.cast("struct<reaction_type:string,event_hint:string,reaction_score:double,confidence:double>").alias("sub"),
        F.struct(F.when(h == 1, "Clutch").otherwise("").alias("peak_reaction_type"), F.when(h == 2, "x:surprise").otherwise("").alias("peak_event_hint"), "chat_sentiment", none.cast("double").alias("peak_confidence"), F.col("chat_confidence").alias("sentiment_confidence")).alias("bucket"),
        F.struct(F.col("transcript_sentiment").alias("sentiment_score"), "transcript_confidence").alias("transcript"), F.struct("relationship", "delta", "quality").alias("alignment"),
    )
    s = reviews.suggest_label()
    return pts.select(*STREAM, "window_start", s.alias("suggested"), reviews.review_confidence(F.lit("x"), F.lit(None).cast("string")).alias("confidence"))


REVIEWS = f"""rv AS (SELECT session_id, channel_id, bucket_start AS s, bucket_end AS e, CASE WHEN chat_sentiment > 0 THEN 'hype_spike' WHEN chat_sentiment < -0.4 THEN 'frustration_spike' ELSE 'none' END AS sug,
   CASE WHEN message_count % 4 = 0 THEN NULL WHEN positive > 0.4 THEN 'hype_spike' ELSE 'none' END AS ref, sentiment_confidence AS conf, message_count FROM buckets)"""


def simple_reviews(b):
    s, n = F.col("chat_sentiment"), F.col("message_count")
    sug = F.when(s > 0, "hype_spike").when(s < -0.4, "frustration_spike").otherwise("none")
    ref = F.when(n % 4 == 0, None).when(F.col("positive") > 0.4, "hype_spike").otherwise("none")
    return b.select(
        F.concat_ws("-", "channel_id", F.unix_micros("bucket_start").cast("string")).alias("review_id"), "session_id", "channel_id",
        F.when(n % 2 == 0, "chat_bucket_30s").otherwise("reaction_subwindow").alias("source_window_type"), F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end"),
        sug.alias("suggested_event_label"), ref.alias("reference_event_label"), F.when(ref.isNull(), "uncertain").when(sug == ref, "correct").otherwise("wrong").alias("correctness"),
        F.col("sentiment_confidence").alias("confidence"), F.lit(0.5).alias("streamer_usefulness"), F.lit("r").alias("reason"),
    )


_ARM = """count(*) AS review_count, count(ref) AS evaluated_windows, count(*) FILTER (sug = ref AND sug <> 'none') AS true_positive, count(*) FILTER (ref IS NOT NULL AND sug <> 'none' AND sug <> ref) AS false_positive,
   count(*) FILTER (ref <> 'none' AND sug <> ref) AS false_negative, count(*) FILTER (sug = ref) AS correct, count(*) FILTER (sug <> ref) AS wrong, count(*) FILTER (ref IS NULL) AS uncertain"""


@register(
    "agent_review_metrics",
    f"""WITH {BUCKETS}, {REVIEWS}, rw AS (SELECT *, CASE WHEN ref IS NULL THEN 'uncertain' WHEN sug = ref THEN 'correct' ELSE 'wrong' END AS verdict FROM rv),
        m AS (SELECT session_id, {_ARM}, avg(conf) AS c FROM rv GROUP BY ROLLUP (session_id)), p AS (SELECT *, true_positive / nullif(true_positive + false_positive, 0) AS p, true_positive / nullif(true_positive + false_negative, 0) AS r FROM m),
        x AS ({" UNION ALL ".join(f"SELECT {who} AS session_id, '{side}' AS side, {v} AS v, count(*) AS n FROM rw GROUP BY ALL" for who in ("session_id", "NULL") for side, v in (("s", "sug"), ("v", "verdict")))}),
        t AS (SELECT session_id, side, '{{' || string_agg('"' || v || '":' || CAST(n AS VARCHAR), ',' ORDER BY v) || '}}' AS t FROM x GROUP BY ALL)
        SELECT p.* EXCLUDE (p, r, c), {rnd("round_even(p, 4)")} AS precision, {rnd("round_even(r, 4)")} AS recall, {rnd("round_even(2 * p * r / nullif(p + r, 0), 4)")} AS f1, {rnd("round_even(c, 4)")} AS average_confidence,
          a.t AS suggested_event_counts, b.t AS correctness_counts, CASE WHEN evaluated_windows > 0 THEN 'computed_against_available_window_labels' ELSE 'pending_human_labels' END AS status
        FROM p JOIN t a ON a.session_id IS NOT DISTINCT FROM p.session_id AND a.side = 's' JOIN t b ON b.session_id IS NOT DISTINCT FROM p.session_id AND b.side = 'v'""",
)
def _(spark, sf):
    return reviews.agent_review_metrics(simple_reviews(chat(spark, sf)))


@register("prescore_reviews")
def _(spark, sf):
    return reviews.prescore_reviews(contexts(spark, sf))


@register(
    "merge_reviews",
    f"""WITH {BUCKETS}, b AS (SELECT * REPLACE (session_id || '/' || channel_id AS session_id), CASE WHEN message_count % 2 = 0 THEN 'chat_bucket_30s' ELSE 'reaction_subwindow' END AS k, hour(bucket_start) < 12 AS early FROM buckets)
        SELECT session_id, k AS source_window_type, {us}(bucket_start) AS window_start, {us}(bucket_end) AS window_end, {rnd("CASE WHEN message_count % 3 = 0 THEN 0.9 ELSE sentiment_confidence END")} AS confidence,
          CASE WHEN message_count % 3 = 0 THEN 'generated' ELSE 'r' END AS reason, 'stored' AS origin FROM b WHERE early
        UNION ALL SELECT session_id, k, {us}(bucket_start), {us}(bucket_end), {rnd("0.9")}, 'generated', 'generated' FROM b WHERE NOT early""",
)
def _(spark, sf):
    """All buckets of all channels are generated; those before noon are stored as well, a third of them half empty."""
    b = chat(spark, sf).withColumn("session_id", F.concat_ws("/", "session_id", "channel_id"))
    third = F.col("_n") % 3 == 0
    early = b.where(F.hour("bucket_start") < 12)
    mine = simple_reviews(early).join(early.select("session_id", F.col("bucket_start").alias("window_start"), F.col("message_count").alias("_n")), ["session_id", "window_start"])
    mine = mine.withColumns({"confidence": F.when(third, 0.0).otherwise(F.col("confidence")), "reason": F.when(third, " ").otherwise(F.col("reason"))}).drop("_n")
    made = simple_reviews(b).withColumns({"confidence": F.lit(0.9), "reason": F.lit("generated")})
    return reviews.merge_reviews(mine, made).select("session_id", "source_window_type", "window_start", "window_end", "confidence", "reason", "origin")


@register(
    "best_review_per_window",
    f"""WITH {BUCKETS}, b AS (SELECT session_id, CASE WHEN message_count % 2 = 0 THEN 'chat_bucket_30s' ELSE 'reaction_subwindow' END AS k, bucket_start AS s, bucket_end AS e, channel_id || '-' || CAST(epoch_us(bucket_start) AS VARCHAR) AS id, sentiment_confidence AS c FROM buckets),
        x AS (SELECT session_id, k, s, e, arg_max(id, (c, id)) AS best_for_source FROM b GROUP BY ALL), y AS (SELECT session_id, s, e, arg_max(id, (c, id)) AS best_for_range FROM b GROUP BY ALL)
        SELECT session_id, k AS source_window_type, {us}(s) AS window_start, {us}(e) AS window_end, best_for_source, best_for_range FROM x JOIN y USING (session_id, s, e)""",
)
def _(spark, sf):
    return reviews.best_review_per_window(simple_reviews(chat(spark, sf)))


@register(
    "review_queue_filter",
    f"""WITH {SIGNAL}, {LABELS}, w AS (SELECT DISTINCT session_id, label_start, label_end FROM lab WHERE event_label <> 'none' AND trim(event_label) <> ''),
        f AS (SELECT s.session_id, s.channel_id, s.bucket_start, s.confidence, EXISTS (SELECT 1 FROM w WHERE w.session_id = s.session_id AND label_start = bucket_start AND label_end = bucket_end) AS has,
               EXISTS (SELECT 1 FROM evs e WHERE e.session_id = s.session_id AND e.channel_id = s.channel_id AND e.bucket_start = s.bucket_start) AS det FROM sx s)
        SELECT 'unlabeled' AS mode, session_id, channel_id, {us}(bucket_start) AS window_start FROM f WHERE NOT has UNION ALL SELECT 'agent_suggested', session_id, channel_id, {us}(bucket_start) FROM f WHERE has
        UNION ALL SELECT 'detected', session_id, channel_id, {us}(bucket_start) FROM f WHERE det UNION ALL SELECT 'low_confidence', session_id, channel_id, {us}(bucket_start) FROM f WHERE confidence < 0.65""",
)
def _(spark, sf):
    w = settle(signal(spark, sf).select(*windows.RWINDOW, "confidence", "first_event_type"), "windows")
    lab = window_labels(chat(spark, sf)).where((F.col("event_label") != "none") & (F.trim("event_label") != ""))
    out = None
    for mode in ("unlabeled", "agent_suggested", "detected", "low_confidence"):
        rows = reviews.review_queue_filter(w, mode, lab, lab).select(F.lit(mode).alias("mode"), *STREAM, "window_start")
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "label_tally",
    f"""WITH {BUCKETS}, {REVIEWS}, t AS (SELECT session_id, count(*) AS total, count(*) FILTER (sug = ref) AS correct, count(*) FILTER (sug <> ref) AS wrong, count(*) FILTER (ref IS NULL) AS uncertain FROM rv GROUP BY 1)
        SELECT *, {rnd("correct / nullif(correct + wrong, 0)")} AS correct_rate FROM t""",
)
def _(spark, sf):
    return reviews.label_tally(simple_reviews(chat(spark, sf)))


@register(
    "queue_summary",
    f"""WITH {BUCKETS}, w AS (SELECT DISTINCT session_id, bucket_start FROM buckets), l AS (SELECT DISTINCT session_id, bucket_start FROM buckets WHERE message_count > 8)
        SELECT w.session_id, count(*) AS total, count(l.bucket_start) AS labeled, count(*) - count(l.bucket_start) AS queued, {rnd("count(l.bucket_start) / count(*)")} AS coverage FROM w LEFT JOIN l USING (session_id, bucket_start) GROUP BY 1""",
)
def _(spark, sf):
    b = chat(spark, sf)
    key = ["session_id", F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end")]
    w, lab = b.select(*key).distinct(), b.where(F.col("message_count") > 8).select(*key)
    return reviews.queue_summary(w, lab, reviews.review_queue_filter(w, "unlabeled", lab))


@register(
    "attach_human_labels",
    f"WITH {MSG} SELECT session_id, message_id, label, CASE WHEN text = 'purchase' THEN 'positive' END AS human_label FROM scored",
)
def _(spark, sf):
    m = adapters.messages(spark, sf)
    human = m.where(F.col("text") == "purchase").select("session_id", "message_id", F.lit("positive").alias("label"))
    return reviews.attach_human_labels(m, human).select("session_id", "message_id", "label", "human_label")


@register(
    "representative_messages",
    f"""WITH {BUCKETS}, c AS (SELECT b.session_id, b.channel_id, b.bucket_start, s.message_id, abs(s.score) AS a, s.ts FROM buckets b JOIN scored s ON s.session_id = b.session_id AND s.channel_id = b.channel_id AND s.ts BETWEEN b.bucket_start AND b.bucket_end),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY a DESC, ts, message_id) AS place FROM c)
        SELECT session_id, channel_id, {us}(bucket_start) AS window_start, message_id, place FROM r WHERE place <= 5""",
)
def _(spark, sf):
    w = chat(spark, sf).select(*STREAM, F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end"), F.array().cast("array<string>").alias("evidence_ids"))
    return reviews.representative_messages(w, adapters.messages(spark, sf), 5, HOUR).select(*STREAM, "window_start", "message_id", "place")


@register(
    "resolve_evidence",
    f"""WITH {TBUCKETS}, k AS (SELECT *, regexp_replace(strftime(bucket_start, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS t FROM tbuckets)
        SELECT session_id, channel_id, {us}(bucket_start) AS window_start, CAST(0 AS BIGINT) AS pos, 'transcript:' || t AS evidence_id, 'transcript' AS source, text FROM k
        UNION ALL SELECT session_id, channel_id, {us}(bucket_start), 1, 'm1', 'chat', NULL FROM k UNION ALL SELECT session_id, channel_id, {us}(bucket_start), 2, 'transcript:x', 'unknown', NULL FROM k""",
)
def _(spark, sf):
    from crowdtide.functions.keys import rfc3339

    t = speech(spark, sf)
    ids = F.array(F.concat(F.lit("transcript:"), rfc3339(F.col("bucket_start"))), F.lit("m1"), F.lit("transcript:x"), F.lit(""))
    w = t.select(*STREAM, F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end"), ids.alias("evidence_ids"))
    return reviews.resolve_evidence(w, t).drop("window_end")


@register(
    "array_append_distinct",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = o_orderpriority[1] THEN o_orderstatus ELSE o_orderstatus || '|' || o_orderpriority[1] END || '|z' AS ids FROM orders""",
)
def _(spark, sf):
    p = F.left("o_orderpriority", F.lit(1))
    ids = signals.append_distinct(F.array("o_orderstatus", F.lit(" ")), F.array(p, F.col("o_orderstatus"), F.lit("z")), F.lit(None).cast("array<string>"))
    return adapters.table(spark, sf, "orders").select("o_orderkey", ids.alias("ids"))


def _distance(words: str) -> str:
    """Word edit distance of each turn and the next one: the distance table row by row."""
    return f"""RECURSIVE t AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, {words} AS w FROM conversations),
        p AS (SELECT a.session_id, a.turn, a.w AS l, b.w AS r FROM t a JOIN t b ON a.session_id = b.session_id AND b.turn = a.turn + 1),
        d AS (SELECT *, 0 AS i, CAST(range(0, len(r) + 1) AS BIGINT[]) AS row FROM p
          UNION ALL SELECT session_id, turn, l, r, i + 1, list_transform(e, lambda x, k: list_min(e[1:k]) + k) FROM (
            SELECT *, list_transform(c, lambda x, k: x - k) AS e FROM (
              SELECT *, list_prepend(i + 1, list_transform(range(1, len(r) + 1), lambda j: least(row[j] + CASE WHEN r[j] <> l[i + 1] THEN 1 ELSE 0 END, row[j + 1] + 1))) AS c
              FROM d WHERE i < len(l)))),
        x AS (SELECT session_id, turn, len(l) AS n, len(r) AS m, row[len(r) + 1] AS distance FROM d WHERE i = len(l))"""


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda v: v <> '')"
_SPOKEN = r"list_filter(list_transform(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda v: regexp_replace(v, '[^a-z0-9]', '', 'g')), lambda v: v <> '')"


@register(
    "word_error_rate",
    f"""WITH {_distance(_WORDS)} SELECT session_id, turn, distance AS word_distance, {rnd("CASE WHEN n = 0 THEN CASE WHEN m = 0 THEN 0.0 ELSE 1.0 END ELSE distance / n END")} AS wer FROM x""",
)
def _(spark, sf):
    """Each turn against the next one of its conversation, whole texts."""
    t = adapters.turns(spark, sf)
    nxt = t.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    pairs = t.select("session_id", "turn", F.col("text").alias("reference_text")).join(nxt, ["session_id", "turn"])
    return reviews.word_error_rate(pairs).select("session_id", "turn", "word_distance", "wer")


@register(
    "repair_change",
    f"""WITH {_distance(_SPOKEN)} SELECT session_id, turn, CAST(greatest(0, m - n) AS BIGINT) AS repair_added_words, {rnd("coalesce(distance / nullif(greatest(n, m), 0), 0.0)")} AS repair_changed_ratio FROM x""",
)
def _(spark, sf):
    t = adapters.turns(spark, sf)
    nxt = t.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("final"))
    pairs = t.select("session_id", "turn", F.col("text").alias("live")).join(nxt, ["session_id", "turn"])
    return reviews.repair_change(pairs, "live", "final").select("session_id", "turn", "repair_added_words", "repair_changed_ratio")


MAN = """man AS (SELECT lang AS task, printf('d%09d', d.doc_id) AS example_id, CAST(quality AS VARCHAR) AS gold, CASE WHEN quality IS NOT NULL THEN CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END END AS predicted, quality IS NOT NULL AS has_output, n_chars % 2 = 0 AS audio, quality = 1 AND regexp_matches(text, '\\S') AS ref FROM documents d LEFT JOIN labels USING (doc_id))"""


def manifest(spark, sf):
    d = adapters.documents(spark, sf).select("doc_id", "lang", "n_chars", F.col("text").alias("reference_text")).join(adapters.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return d.select(F.col("lang").alias("task"), F.format_string("d%09d", "doc_id").alias("example_id"), q.cast("string").alias("gold"), F.when(q.isNotNull(), F.when(F.col("n_chars") > 1500, "1").otherwise("0")).alias("predicted"), q.isNotNull().alias("has_output"),
        (F.col("n_chars") % 2 == 0).alias("audio_available"), F.when(q == 1, F.col("reference_text")).otherwise(" ").alias("reference_text"),
    )


@register(
    "manifest_summary",
    f"""WITH {MAN}, s AS (SELECT task, count(*) AS records, count(*) FILTER (has_output) AS model_outputs_present, count(*) FILTER (NOT has_output) AS model_outputs_missing, count(*) FILTER (has_output) AS evaluated_records,
            {rnd(half_away("count(*) FILTER (gold = predicted) / nullif(count(*) FILTER (has_output), 0)", 4))} AS accuracy FROM man GROUP BY 1),
        m AS (SELECT task, string_agg(example_id, '|' ORDER BY example_id) AS missing_examples FROM man WHERE NOT has_output GROUP BY 1),
        g AS (SELECT task, '{{' || string_agg('"' || gold || '":' || CAST(n AS VARCHAR), ',' ORDER BY gold) || '}}' AS label_counts FROM (SELECT task, gold, count(*) AS n FROM man WHERE gold IS NOT NULL GROUP BY ALL) GROUP BY 1),
        a AS (SELECT task, count(*) FILTER (audio) AS audio_available, count(*) FILTER (NOT audio) AS audio_missing, count(*) FILTER (ref) AS reference_text_count FROM man GROUP BY 1)
        SELECT s.*, missing_examples, label_counts, audio_available, audio_missing, reference_text_count, 'computed' AS status FROM s LEFT JOIN m USING (task) LEFT JOIN g USING (task) JOIN a USING (task)""",
)
def _(spark, sf):
    return reviews.manifest_summary(manifest(spark, sf))


@register("manifest_confusion", f"WITH {MAN} SELECT task, gold, predicted, count(*) AS count FROM man WHERE has_output GROUP BY ALL")
def _(spark, sf):
    return reviews.manifest_confusion(manifest(spark, sf))


# --- models -----------------------------------------------------------------

WEIGHTS = {"purchase": 1.0, "signup": 0.5, "error": -1.0}


def bucketed(spark, sf):
    return windows.with_bucket(adapters.messages(spark, sf), HOUR)


PRED = """pred(text, label, confidence) AS (VALUES ('purchase', 'positive', 0.45), ('signup', 'positive', 0.45), ('error', 'negative', 0.45), ('view', 'neutral', 0.45), ('click', 'neutral', 0.45))"""


@register(
    "score_texts",
    f"""WITH pred AS (SELECT DISTINCT text, length(text) AS n FROM conversations) SELECT text, CASE n % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS label, {rnd("n / (n + 10.0)")} AS confidence FROM pred""",
)
def _(spark, sf):
    def by_length(texts: list[str]) -> pd.DataFrame:
        n = [len(t) for t in texts]
        labels = [("positive", "negative", "neutral")[x % 3] for x in n]
        return pd.DataFrame({"label": labels, "confidence": [x / (x + 10.0) for x in n], "scores": [None] * len(n)})

    return models.score_texts(adapters.turns(spark, sf), by_length).drop("scores")


@register(
    "scorer_fallback",
    f"""WITH {PRED} SELECT text, label, {rnd("CASE WHEN text = 'view' THEN 0.99 ELSE confidence END")} AS confidence, CASE WHEN text = 'view' THEN 'model' ELSE 'fallback' END AS status
        FROM pred WHERE text IN (SELECT event_type FROM events)""",
)
def _(spark, sf):
    m = adapters.messages(spark, sf)
    local = models.lexicon_predictions(m, "text", WEIGHTS)
    model = local.where(F.col("text") == "view").withColumn("confidence", F.lit(0.99))
    return models.with_fallback(model, local).drop("scores")


@register(
    "bucket_sentiment",
    f"""WITH {MSG}, {PRED}, j AS (SELECT s.*, p.label AS l, p.confidence AS c FROM scored s JOIN pred p USING (text))
        SELECT {KEY}, count(*) AS message_count, count(*) AS analyzed_count, {rnd("avg(CASE l WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0 END)")} AS chat_sentiment, {rnd("avg(c)")} AS sentiment_confidence,
          {rnd("avg(CASE WHEN l = 'positive' THEN 1.0 ELSE 0 END)")} AS positive, {rnd("avg(CASE WHEN l = 'neutral' THEN 1.0 ELSE 0 END)")} AS neutral, {rnd("avg(CASE WHEN l = 'negative' THEN 1.0 ELSE 0 END)")} AS negative
        FROM j GROUP BY session_id, channel_id, bucket_start, bucket_end""",
)
def _(spark, sf):
    m = bucketed(spark, sf)
    return models.bucket_sentiment(m, models.lexicon_predictions(m, "text", WEIGHTS))


@register(
    "message_scores",
    f"WITH {MSG}, {PRED} SELECT message_id, p.label, {rnd('p.confidence')} AS confidence, {rnd('CASE p.label WHEN ' + chr(39) + 'positive' + chr(39) + ' THEN p.confidence WHEN ' + chr(39) + 'negative' + chr(39) + ' THEN -p.confidence ELSE 0 END')} AS score FROM msg JOIN pred p USING (text)",
)
def _(spark, sf):
    m = adapters.messages(spark, sf)
    return models.message_scores(m, models.lexicon_predictions(m, "text", WEIGHTS)).select("message_id", "label", "confidence", "score")


@register(
    "trace_sample",
    f"""WITH {MSG}, a AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start, label ORDER BY confidence DESC, ts, message_id) AS lp FROM scored),
        b AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY lp > 2, confidence DESC, ts, message_id) AS rank FROM a)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, message_id, rank FROM b WHERE rank <= 6""",
)
def _(spark, sf):
    return models.trace_sample(bucketed(spark, sf), 6).select(*STREAM, "bucket_start", "message_id", "rank")


@register(
    "peak_first_sample",
    f"""WITH {MSG}, a AS (SELECT *, ts < bucket_start + INTERVAL 15 MINUTE AS pk FROM scored), b AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start, pk ORDER BY ts, message_id) - 1 AS pos,
            count(*) OVER (PARTITION BY session_id, channel_id, bucket_start) AS n, count(*) FILTER (pk) OVER (PARTITION BY session_id, channel_id, bucket_start) AS np FROM a),
        c AS (SELECT *, 5 - least(np, 5) AS slots, n - least(np, 5) AS m FROM b)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, message_id FROM c WHERE n <= 5 OR CASE WHEN pk THEN pos < 5 WHEN slots <= 0 THEN FALSE WHEN m <= slots THEN TRUE WHEN slots = 1 THEN pos = floor(m / 2)
           ELSE list_contains([CAST(round_even(i * (m - 1) / (slots - 1), 0) AS BIGINT) for i in range(slots)], pos) END""",
)
def _(spark, sf):
    m = bucketed(spark, sf).withColumns({"ps": F.col("bucket_start"), "pe": F.col("bucket_start") + F.expr("INTERVAL 15 MINUTES")})
    return models.peak_first_sample(m, 5, "ps", "pe", 300.0).select(*STREAM, "bucket_start", "message_id")


@register(
    "message_samples",
    f"""WITH {MSG}, a AS (SELECT *, text = 'purchase' AS pk FROM scored), r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY NOT pk, CAST(substr(message_id, 2) AS BIGINT)) - 1 AS evidence_rank FROM a)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, message_id, sha256('salt:' || lower(username)) AS user_hash, CASE WHEN NOT pk THEN label END AS label, evidence_rank FROM r WHERE evidence_rank < 4""",
)
def _(spark, sf):
    m = bucketed(spark, sf).withColumn("pos", F.substring("message_id", 2, 20).cast("long"))
    return storage.message_samples(m.where(F.col("text") == "purchase"), m, "salt", 4).select(*STREAM, "bucket_start", "message_id", "user_hash", "label", "evidence_rank")


# --- event log and storage --------------------------------------------------


def payloads(spark, sf):
    b = chat(spark, sf)
    from crowdtide.functions.keys import rfc3339

    return b.select(
        F.to_json(F.struct(F.lit("chat_bucket").alias("type"), "session_id", "channel_id", rfc3339(F.col("bucket_start")).alias("bucket_start"), rfc3339(F.col("bucket_end")).alias("bucket_end"), "message_count")).alias("payload")
    )


_T = "strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
_PAY = f"""'{{"type":"chat_bucket","session_id":"' || session_id || '","channel_id":"' || channel_id || '","bucket_start":"' || {_T.format(c="bucket_start")} || '","bucket_end":"' || {_T.format(c="bucket_end")} || '","message_count":' || message_count || '}}'"""


@register(
    "make_envelope",
    f"""WITH {BUCKETS}, p AS (SELECT left({_PAY}, length({_PAY}) - 1) || ', "rate": 1.50}}' AS payload, 'chat_bucket:' || session_id || ':' || channel_id || ':' || {_T.format(c="bucket_start")} || ':' || {_T.format(c="bucket_end")} AS key, session_id, channel_id, {_T.format(c="bucket_start")} AS start FROM buckets)
        SELECT 'stream.chat_buckets.v1' AS topic, key, left(sha256('chat_bucket|' || key || '|' || payload), 32) AS event_id, payload,
          '{{"schema_version":"v1","event_id":"' || left(sha256('chat_bucket|' || key || '|' || payload), 32) || '","event_type":"chat_bucket","event_schema_version":"v1","source":"tests","session_id":"' || session_id
            || '","channel_id":"' || channel_id || '","occurred_at":"' || start || '","payload":' || payload || '}}' AS value,
          'event_id=' || left(sha256('chat_bucket|' || key || '|' || payload), 32) || '|event_type=chat_bucket|event_schema_version=v1|envelope_version=v1|source=tests' AS headers FROM p""",
)
def _(spark, sf):
    """Payloads with their own spacing and number format, and one that is no JSON."""
    own = payloads(spark, sf).select(F.regexp_replace("payload", r"\}$", ', "rate": 1.50}').alias("payload"))
    made = envelopes.make_envelope(own.unionByName(own.limit(1).select(F.lit("{broken").alias("payload"))), "chat_bucket", "tests")
    headers = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), "|")
    return made.select("topic", "key", "event_id", "payload", "value", headers.alias("headers"))


def envelope_rows(spark, sf):
    made = envelopes.make_envelope(payloads(spark, sf), "chat_bucket", "tests")
    n = F.get_json_object("payload", "$.message_count").cast("int")
    return made.withColumns(
        {
            "n": n,
            "schema_version": F.lit("v1"),
            "event_schema_version": F.when(n % 7 == 0, "v2").otherwise("v1"),
            "source": F.when(n % 5 == 0, " ").otherwise("tests"),
            "event_type": F.when(n % 3 == 0, "system_metric").when(n % 11 == 0, "mystery").otherwise("chat_bucket"),
        }
    )


@register(
    "validate_envelope",
    f"""WITH {BUCKETS} SELECT 'chat_bucket:' || session_id || ':' || channel_id || ':' || {_T.format(c="bucket_start")} || ':' || {_T.format(c="bucket_end")} AS key,
          array_to_string(list_filter([CASE WHEN message_count % 7 = 0 THEN 'event_schema_version must be v1' END, CASE WHEN message_count % 3 <> 0 AND message_count % 11 = 0 THEN 'unknown event_type' END,
            CASE WHEN message_count % 5 = 0 THEN 'source is required' END, CASE WHEN message_count % 3 = 0 OR message_count % 11 = 0 THEN 'payload type does not match event_type' END], lambda x: x IS NOT NULL), '|') AS errors FROM buckets""",
)
def _(spark, sf):
    return envelopes.validate_envelope(envelope_rows(spark, sf)).select("key", "errors")


@register(
    "decode_envelope",
    f"""WITH {BUCKETS} SELECT session_id, channel_id, {_T.format(c="bucket_start")} AS bucket_start, CAST(message_count % 4 = 0 AS BIGINT) AS bad, CASE WHEN message_count % 4 <> 0 THEN 'chat_bucket' END AS event_type,
          CASE WHEN message_count % 4 <> 0 THEN 'tests' END AS source, CASE WHEN message_count % 4 <> 0 THEN message_count END AS message_count FROM buckets""",
)
def _(spark, sf):
    """Every fourth envelope has a field too much; what is left of each line is compared field by field."""
    made = envelopes.make_envelope(payloads(spark, sf), "chat_bucket", "tests")
    n = F.get_json_object("payload", "$.message_count").cast("int")
    lines = made.select(F.when(n % 4 == 0, F.regexp_replace("value", r"^\{", '{"extra":1,')).otherwise(F.col("value")).alias("value"))
    d = envelopes.decode_envelope(lines)
    own = F.col("decode_error").isNull()
    return d.select(
        "session_id", "channel_id", F.get_json_object("payload", "$.bucket_start").alias("bucket_start"), F.col("decode_error").isNotNull().alias("bad"), F.when(own, F.col("event_type")).alias("event_type"),
        F.when(own, F.col("source")).alias("source"), F.when(own, F.get_json_object("payload", "$.message_count").cast("long")).alias("message_count"),
    )


@register(
    "infer_event_type",
    f"""WITH {BUCKETS} SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, CASE WHEN message_count % 3 = 0 THEN 'transcript_bucket' ELSE 'chat_bucket' END AS event_type FROM buckets""",
)
def _(spark, sf):
    n = F.get_json_object("payload", "$.message_count").cast("int")
    body = (
        F.when(n % 3 == 0, F.concat(F.lit('{"kind":"Transcript-Buckets","data":'), "payload", F.lit("}")))
        .when(n % 3 == 1, F.concat(F.lit('{"type":"event","bucket":'), F.regexp_replace("payload", '"type":"chat_bucket",', ""), F.lit("}")))
        .otherwise(F.regexp_replace("payload", '"type":"chat_bucket",', ""))
    )
    out = envelopes.infer_event_type(payloads(spark, sf).select(body.alias("value")))
    return out.select("session_id", "channel_id", F.get_json_object("payload", "$.bucket_start").cast("timestamp").alias("bucket_start"), "event_type")


@register(
    "validate_buckets",
    f"""WITH {BUCKETS} SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, CASE WHEN message_count % 5 = 0 THEN 'bucket_start and bucket_end are required' WHEN message_count % 7 = 0 THEN 'bucket_end must be after bucket_start' END AS reject_reason FROM buckets""",
)
def _(spark, sf):
    n = F.col("message_count")
    end = F.when(n % 5 == 0, None).when(n % 7 == 0, F.col("bucket_start")).otherwise(F.col("bucket_end"))
    return filters.validate_buckets(chat(spark, sf).withColumn("bucket_end", end)).select(*STREAM, "bucket_start", "reject_reason")


@register(
    "upsert",
    f"""WITH v AS (SELECT o_custkey AS k, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_totalprice) AS best, min(o_totalprice) AS least, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order,
            arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderpriority NOT LIKE '5%') AS prio FROM orders GROUP BY 1)
        SELECT k, status, {rnd("best")} AS best, {rnd("least")} AS least, first_order, prio FROM v""",
)
def _(spark, sf):
    o = adapters.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("best"), F.col("o_totalprice").alias("least"), F.col("o_orderkey").alias("first_order"),
        F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(F.col("o_orderpriority")).alias("prio"), F.struct("o_orderdate", "o_orderkey").alias("version"),
    )
    old, new = o.where(F.month("version.o_orderdate") <= 6), o.where(F.month("version.o_orderdate") > 6)
    rules = {"best": "greatest", "least": "least", "first_order": "first", "prio": "keep"}
    return storage.upsert(old, new, ["k"], "version", rules).drop("version")


@register(
    "append_metrics",
    f"SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderpriority AS name, {rnd('o_totalprice')} AS value, 'usd' AS unit, {us}(o_orderdate) AS recorded_at, CAST(NULL AS VARCHAR) AS meta FROM orders",
)
def _(spark, sf):
    o = adapters.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value"), F.lit("usd").alias("unit"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"), F.lit(None).cast("string").alias("meta")
    )
    path = storage.fresh_path(spark, "metrics")
    storage.append_metrics(o.where(F.col("value") < 100000), path)
    return storage.append_metrics(o.where(F.col("value") >= 100000), path)


@register(
    "write_reports",
    f"""WITH {BUCKETS} SELECT session_id, 'chat' AS name, {rnd("arg_max(chat_sentiment, (bucket_start, chat_sentiment))")} AS value, count(*) AS detail_rows, CAST(sum(message_count) AS BIGINT) AS messages, CAST(max(unique_chatters) AS BIGINT) AS most_chatters
        FROM buckets GROUP BY 1""",
)
def _(spark, sf):
    """The report read back, beside figures of the detail rows read back."""
    from crowdtide.operators import proof

    b = settle(chat(spark, sf), "chat")
    path = storage.fresh_path(spark, "report")
    storage.write_reports(proof.latest_metric(b.select("session_id", F.lit("chat").alias("name"), F.col("chat_sentiment").alias("value"), F.col("bucket_start").alias("recorded_at"))), b, path)
    detail = spark.read.schema(b.schema).json(f"{path}/rows").groupBy("session_id")
    detail = detail.agg(F.count("*").alias("detail_rows"), F.sum("message_count").alias("messages"), F.max("unique_chatters").alias("most_chatters"))
    return spark.read.schema("session_id STRING, name STRING, value DOUBLE").json(f"{path}/report").join(detail, "session_id")


@register(
    "check_contract",
    f"""WITH {BUCKETS}, x AS (SELECT count(*) FILTER (message_count > 10) AS big, count(*) FILTER (channel_id <> 'c0') AS other, count(*) FILTER (chat_sentiment < -0.5) AS low, count(*) FILTER (sentiment_confidence IS NULL) AS nul, count(*) AS n FROM buckets)
        SELECT 'message_count' AS field, 'maximum' AS rule, big AS violations FROM x UNION ALL SELECT 'channel_id', 'enum', other FROM x UNION ALL SELECT 'chat_sentiment', 'minimum', low FROM x
        UNION ALL SELECT 'sentiment_confidence', 'required', nul FROM x UNION ALL SELECT 'session_id', 'required', 0 FROM x UNION ALL SELECT 'positive', 'unknown_field', n FROM x""",
)
def _(spark, sf):
    F_ = contracts.Field
    rules = {"session_id": F_(required=True), "channel_id": F_(values=("c0",)), "message_count": F_(maximum=10), "chat_sentiment": F_(minimum=-0.5), "sentiment_confidence": F_(required=True)}
    t = chat(spark, sf).select("session_id", "channel_id", "message_count", "chat_sentiment", "sentiment_confidence", "positive")
    return contracts.check_contract(t, rules)


@register(
    "check_payloads",
    f"""WITH {ALIGN}, v(payload, path, rule, violations) AS (
          SELECT 'chat_message', '$.username', 'required', count(*) FILTER (is_bot_likely) FROM scored UNION ALL SELECT 'chat_message', '$.emotes[]', 'type', count(*) FILTER (text = 'error') FROM scored
          UNION ALL SELECT 'chat_bucket', '$.chat_sentiment', 'maximum', count(*) FILTER (message_count > 10) FROM buckets
          UNION ALL SELECT 'chat_bucket', '$.message_scores[].confidence', 'maximum', count(*) FILTER (unique_chatters % 2 = 0) * 2 FROM buckets
          UNION ALL SELECT 'chat_bucket', '$.language_mix.*', 'type', count(*) FROM buckets
          UNION ALL SELECT 'reaction_window', '$.window_end', 'format', count(*) FILTER (message_count % 3 = 0) FROM buckets UNION ALL SELECT 'reaction_window', '$.evidence_messages[]', 'unknown_field', count(*) FROM buckets
          UNION ALL SELECT 'transcript_update', '$.segments[].words[].probability', 'maximum', count(*) FILTER (confidence > 0.5) FROM seg
          UNION ALL SELECT 'transcript_update', '$.segments[].text', 'type', count(*) FROM seg
          UNION ALL SELECT 'transcript_bucket', '$.segments[].confidence', 'maximum', count(*) FILTER (text LIKE 'error%') FROM seg
          UNION ALL SELECT 'alignment_bucket', '$.quality_flags', 'required', count(*) FILTER (relationship = 'diverged') FROM al UNION ALL SELECT 'alignment_bucket', '$.type', 'enum', count(*) FILTER (chat_message_count > 10) FROM al
          UNION ALL SELECT 'signal_window', '$.events[].confidence', 'minimum', count(*) FILTER (message_count > 10) FROM buckets UNION ALL SELECT 'signal_window', '$.events', 'required', count(*) FILTER (message_count <= 10) FROM buckets)
        SELECT * FROM v""",
)
def _(spark, sf):
    """All seven payloads as JSON texts, each with a few rules broken, some of them deep inside."""

    def stamp(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def times(df, *names):
        return df.withColumns({c: stamp(c) for c in names})

    def broken(name, df, **fields):
        row = F.to_json(F.struct(*[F.col(c) for c in df.columns], *[c.alias(n) for n, c in fields.items()]))
        found = payload_contracts.check_payloads(df.select(row.alias("payload")), payload_contracts.contract(name))
        return found.where("violations > 0").select(F.lit(name).alias("payload"), "path", "rule", "violations")

    c, t, al = stored(spark, sf)
    m = times(adapters.messages(spark, sf), "timestamp").select(*STREAM, "message_id", "timestamp", "username", "text", "emotes", "is_bot_likely")
    m = m.withColumns({"username": F.when(~F.col("is_bot_likely"), F.col("username")), "emotes": F.when(F.col("text") == "error", F.array(F.lit(None).cast("string"))).otherwise(F.col("emotes"))})
    b = times(c, "bucket_start", "bucket_end").select(*windows.BUCKET, "message_count", "unique_chatters", "chat_sentiment", "positive", "neutral", "negative")
    odd = F.struct(F.lit("m").alias("message_id"), (1.0 + F.col("unique_chatters") % 2 * -0.5 + 0.25).alias("confidence"))
    mix = F.create_map(F.lit("en"), F.lit("much"))
    high = b.withColumn("chat_sentiment", F.when(F.col("message_count") > 10, 5.0).otherwise(F.col("chat_sentiment")))
    w = b.select(*STREAM, F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end"), "message_count")
    late = w.withColumn("window_end", F.when(F.col("message_count") % 3 == 0, "noon").otherwise(F.col("window_end")))
    seg = times(adapters.segments(spark, sf), "segment_start", "segment_end").withColumnsRenamed({"segment_start": "transcript_start", "segment_end": "transcript_end"})
    word = F.struct(F.lit(0.0).alias("start"), F.lit(0.5).alias("end"), "text", F.when(F.col("confidence") > 0.5, 1.5).otherwise(0.5).alias("probability"))
    said = seg.select(*STREAM, "transcript_start", "transcript_end", "text", F.array(F.struct(F.lit(0).alias("start"), F.lit(7).alias("text"), F.array(word).alias("words"))).alias("segments"))
    spoken = times(t, "bucket_start", "bucket_end").select(
        *windows.BUCKET, "text", F.transform("segments", lambda s: s.withField("confidence", F.when(s["text"].startswith("error"), 2.0).otherwise(s["confidence"]))).alias("segments")
    )
    pair = times(al, "window_start", "window_end").select(*windows.RWINDOW, "delta", "similarity", "relationship", "chat_message_count", "quality_flags")
    pair = pair.withColumn("quality_flags", F.when(F.col("relationship") != "diverged", F.col("quality_flags")))
    event = F.array(F.struct(F.lit("hype_spike").alias("type"), F.lit(-0.5).alias("confidence"), F.array(F.lit("m")).alias("evidence_ids")))
    parts = [
        broken("chat_message", m),
        broken("chat_bucket", high, type=F.lit("chat_bucket"), message_scores=F.array(odd, odd), language_mix=mix),
        broken("reaction_window", late, type=F.lit("reaction_window"), reaction_type=F.lit("hype"), confidence=F.lit(0.5), evidence_messages=F.array(F.struct(F.lit("m").alias("message_id"), F.lit(1).alias("odd")))),
        broken("transcript_update", said, type=F.lit("transcript_segment")),
        broken("transcript_bucket", spoken, type=F.lit("transcript_bucket")),
        broken("alignment_bucket", pair, type=F.when(F.col("chat_message_count") > 10, "pair").otherwise("alignment_bucket")),
        broken("signal_window", w, type=F.lit("signal_window"), reaction_type=F.lit("hype"), events=F.when(F.col("message_count") > 10, event)),
    ]
    return functools.reduce(lambda a, x: a.unionByName(x), parts)


@register(
    "backpressure_events",
    f"""WITH {MSG} SELECT session_id, 'asr.backpressure_count' AS name, 1.0::DOUBLE AS value, 'events' AS unit, {us}(ts) AS recorded_at FROM msg WHERE text = 'error'""",
)
def _(spark, sf):
    m = adapters.messages(spark, sf)
    status = F.when(F.col("text") == "error", " backpressure").otherwise("ok")
    ev = m.select("session_id", "channel_id", "timestamp", status.alias("status"), F.lit(900).alias("asr_latency_ms"), F.lit(500).alias("asr_interval_ms"))
    return filters.backpressure_events(ev).drop("meta")


@register(
    "parse_chat_log",
    """SELECT 'c' || CAST(user_id % 2 AS VARCHAR) AS channel_id, 'id' || CAST(event_id AS VARCHAR) AS message_id, epoch_us(ts) // 1000 * 1000 AS timestamp, 'User ' || CAST(user_id AS VARCHAR) AS display_name, event_type || ' Kappa!' AS text,
              'Kappa' AS emotes, CASE WHEN user_id % 3 = 0 THEN 'moderator' ELSE '' END AS badges, CAST(user_id % 3 = 0 AS BIGINT) AS is_mod, CAST(user_id % 4 = 0 AS BIGINT) AS is_bot_likely FROM events WHERE event_type <> 'view'""",
)
def _(spark, sf):
    ev = adapters.table(spark, sf, "events")
    uid, n = F.col("user_id").cast("string"), F.char_length("event_type")
    badges = F.when(F.col("user_id") % 3 == 0, "moderator/1").otherwise("")
    tags = F.concat(
        F.lit("@badges="), badges, F.lit(";display-name=User\\s"), uid, F.lit(";emotes=25:"), (n + 1).cast("string"), F.lit("-"), (n + 5).cast("string"), F.lit(";id=id"), F.col("event_id").cast("string"),
        F.lit(";mod=1;mod=0;tmi-sent-ts="), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"),
    )
    who = F.concat(F.when(F.col("user_id") % 4 == 0, "BotU").otherwise("u"), uid)
    cmd = F.when(F.col("event_type") == "view", "JOIN").otherwise("PRIVMSG")
    line = F.concat(tags, F.lit(" :"), who, F.lit("!u@host "), cmd, F.lit(" #C"), (F.col("user_id") % 2).cast("string"), F.lit(" :"), "event_type", F.lit(" Kappa!"))
    out = chat_log.parse_chat_log(ev.select(line.alias("value")), "s1")
    return out.select("channel_id", "message_id", "timestamp", "display_name", "text", "emotes", "badges", "is_mod", "is_bot_likely")


@register(
    "read_manifest",
    """SELECT printf('d%d', doc_id) AS example_id, text, CAST(quality AS VARCHAR) AS gold_label FROM documents JOIN labels USING (doc_id)""",
)
def _(spark, sf):
    from crowdtide import schemas

    d = adapters.documents(spark, sf).join(adapters.table(spark, sf, "labels"), "doc_id")
    line = F.to_json(F.struct(F.format_string("d%d", "doc_id").alias("example_id"), "text", F.col("quality").cast("string").alias("gold_label")))
    path = storage.fresh_path(spark, "manifest")
    d.select(line.alias("value")).write.text(path)
    return replays.read_manifest(spark, path, schemas.SENTIMENT_LABEL).select("example_id", "text", "gold_label")


@register(
    "read_replays",
    f"""WITH {BUCKETS} SELECT {KEY}, message_count, {rnd("chat_sentiment")} AS chat_sentiment FROM buckets""",
)
def _(spark, sf):
    """Session documents written from the chat buckets, one file line per session, and read back."""
    b = chat(spark, sf)
    from crowdtide.functions.keys import rfc3339

    item = F.struct("session_id", "channel_id", rfc3339(F.col("bucket_start")).alias("bucket_start"), rfc3339(F.col("bucket_end")).alias("bucket_end"), "message_count", "chat_sentiment")
    docs = b.groupBy("session_id").agg(F.collect_list(item).alias("chat_buckets"))
    doc = F.to_json(F.array(F.struct(F.struct("session_id").alias("session"), "chat_buckets")))
    path = storage.fresh_path(spark, "replays")
    docs.select(doc.alias("value")).write.text(path)
    tables = replays.replay_tables(replays.parse_replays(spark.read.text(path)))
    return tables["chat_buckets"].select(*windows.BUCKET, "message_count", "chat_sentiment")

