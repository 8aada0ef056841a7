"""Chat messages: cleaning, scalar text functions, tumbling and sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.common import (
    BUCKETS,
    EVENT_LEXICON,
    EVENT_WEIGHTS_NEG,
    EVENT_WEIGHTS_POS,
    MSG,
    clamp_sql,
    half_away,
    register,
    rnd,
    us,
)
from crowdtide.functions import keys, lexicons, text
from crowdtide.functions.numbers import clamp, round_half_away
from crowdtide.operators import filters, windows
from crowdtide.sources import adapters

HOUR = adapters.HOUR
KEY = f"session_id, channel_id, {us}(bucket_start) AS bucket_start, {us}(bucket_end) AS bucket_end"

# --- cleaning ---------------------------------------------------------------


@register(
    "normalize_messages",
    """SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id,
              trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, 'other' AS language FROM conversations""",
)
def _(spark, sf):
    msgs = adapters.turns(spark, sf).withColumn("language", F.lit(""))
    return filters.normalize_messages(msgs).select("message_id", "text", "language")


@register(
    "filter_messages",
    f"""WITH {MSG} SELECT message_id, text FROM (SELECT *, trim(text) AS t FROM msg)
        WHERE NOT is_bot_likely AND (t <> '' OR len(emotes) > 0) AND NOT starts_with(t, '!')
          AND (length(t) >= 2 OR upper(t) IN ('W', 'L', '?') OR len(emotes) > 0)""",
)
def _(spark, sf):
    return filters.filter_messages(adapters.messages(spark, sf)).select("message_id", "text")


@register(
    "clip_texts",
    r"""SELECT doc_id, text FROM (
          SELECT doc_id, regexp_replace(left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 280), '^\s+|\s+$', '', 'g') AS text
          FROM documents) WHERE text <> ''""",
)
def _(spark, sf):
    return filters.clip_texts(adapters.documents(spark, sf).select("doc_id", "text"), 280)


@register(
    "drop_caption_noise",
    r"""WITH p AS (
          SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t,
                 (doc_id % 10) / 10.0 AS confidence FROM documents),
        q AS (
          SELECT doc_id, confidence, t, len(regexp_extract_all(t, '\p{L}')) AS letters,
                 len(regexp_extract_all(t, '\p{Latin}')) AS latin,
                 regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM p WHERE t <> '' AND confidence >= 0.25),
        r AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS u,
                 len(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) AS ub
              FROM q WHERE letters = 0 OR (letters - latin) / letters <= 0.35)
        SELECT doc_id FROM r WHERE n < 4 OR NOT (u <= 2 OR ub < n - 1)""",
)
def _(spark, sf):
    docs = adapters.documents(spark, sf).select("doc_id", "text", ((F.col("doc_id") % 10) / 10.0).alias("confidence"))
    return filters.drop_caption_noise(docs).select("doc_id")


@register(
    "label_validity",
    f"""WITH {MSG}, v AS (
          SELECT message_id, CASE text WHEN 'purchase' THEN ' Hype_Spike ' WHEN 'error' THEN 'frustration_spike'
                   WHEN 'signup' THEN '' ELSE text END AS raw,
                 CASE language WHEN 'en' THEN ' CORRECT' WHEN 'de' THEN 'wrong' ELSE 'maybe' END AS verdict FROM msg),
        w AS (SELECT message_id, CASE WHEN trim(raw) = '' THEN 'none' ELSE lower(trim(raw)) END AS event_label, lower(trim(verdict)) AS v FROM v)
        SELECT message_id, event_label,
               CAST(event_label IN ('none', 'hype_spike', 'frustration_spike', 'audience_shift', 'content_audience_divergence') AS BIGINT) AS label_valid,
               CASE WHEN v IN ('correct', 'wrong', 'uncertain') THEN v END AS correctness FROM w""",
)
def _(spark, sf):
    raw = F.when(F.col("text") == "purchase", " Hype_Spike ").when(F.col("text") == "error", "frustration_spike")
    raw = raw.when(F.col("text") == "signup", "").otherwise(F.col("text"))
    verdict = F.when(F.col("language") == "en", " CORRECT").when(F.col("language") == "de", "wrong").otherwise("maybe")
    labels = adapters.messages(spark, sf).select("message_id", raw.alias("event_label"), verdict.alias("correctness"))
    return filters.label_validity(labels)


@register(
    "prediction_distribution",
    f"""WITH {MSG}, s AS (
          SELECT message_id, text, confidence, CASE WHEN text IN ('purchase', 'error') THEN greatest(score, 0) ELSE 0 END AS p,
                 CASE WHEN text IN ('purchase', 'error') THEN greatest(-score, 0) ELSE 0 END AS g,
                 CASE WHEN text = 'purchase' THEN 0.25 ELSE 0 END AS u FROM msg),
        t AS (SELECT *, p + g + u AS total, CASE text WHEN 'signup' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END AS lab FROM s)
        SELECT message_id,
               {rnd("CASE WHEN total > 0 THEN p / total WHEN lab = 'positive' THEN 1.0 ELSE 0.0 END")} AS positive,
               {rnd("CASE WHEN total > 0 THEN u / total WHEN lab = 'neutral' THEN 1.0 ELSE 0.0 END")} AS neutral,
               {rnd("CASE WHEN total > 0 THEN g / total WHEN lab = 'negative' THEN 1.0 ELSE 0.0 END")} AS negative FROM t""",
)
def _(spark, sf):
    msgs = adapters.messages(spark, sf)
    scores = F.when(
        F.col("text") == "purchase",
        F.create_map(F.lit("LABEL_2"), "score", F.lit("label_0"), -F.col("score"), F.lit("neutral"), F.lit(0.25), F.lit("junk"), F.lit(9.0)),
    ).when(F.col("text") == "error", F.create_map(F.lit(" Positive"), "score", F.lit("negative"), -F.col("score")))
    label = F.when(F.col("text") == "signup", "LABEL_2").when(F.col("text") == "error", "label_0").otherwise("other")
    df = msgs.select("message_id", scores.alias("scores"), label.alias("label"), "confidence")
    return filters.prediction_distribution(df).select("message_id", "positive", "neutral", "negative")


# --- scalar functions -------------------------------------------------------


@register(
    "text_tokens",
    """SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct,
              len(list_intersect(list_distinct(t), ['the', 'and', 'best', 'what', 'wait'])) AS hits,
              CAST(contains(' ' || p || ' ', ' of the ') AS BIGINT) + CAST(contains(' ' || p || ' ', ' and the ') AS BIGINT) AS phrases
       FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t,
                    trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS p FROM documents)""",
)
def _(spark, sf):
    t = text.tokens(F.col("text"))
    return adapters.documents(spark, sf).select(
        "doc_id",
        F.size(t).alias("n_tokens"),
        F.size(F.array_distinct(t)).alias("n_distinct"),
        text.term_hits(t, ("the", "and", "best", "what", "wait")).alias("hits"),
        text.phrase_hits(F.col("text"), ("of the", "and the")).alias("phrases"),
    )


_SENT = """SELECT {key}, CASE WHEN n = 0 THEN 0.0 ELSE {score} END AS score,
   CASE WHEN n = 0 THEN {idle} ELSE {conf} END AS confidence FROM hits"""


@register(
    "lexicon_sentiment",
    f"""WITH {MSG}, hits AS (
          SELECT message_id, CASE WHEN text IN ('purchase', 'signup', 'error') THEN 1 ELSE 0 END + CASE WHEN text = 'purchase' THEN 1 ELSE 0 END AS n,
                 CASE text WHEN 'purchase' THEN 1.0 + 0.9 WHEN 'signup' THEN 0.5 WHEN 'error' THEN -1.0 ELSE 0 END AS total FROM msg)
        SELECT message_id, {rnd("CASE WHEN n = 0 THEN 0.0 ELSE total / n END")} AS score,
               {rnd("CASE WHEN n = 0 THEN 0.25 ELSE 0.35 + n * 0.12 END")} AS confidence,
               CASE WHEN n > 0 AND total / n > 0.15 THEN 'positive' WHEN n > 0 AND total / n < -0.15 THEN 'negative' ELSE 'neutral' END AS label
        FROM hits""",
)
def _(spark, sf):
    s = text.lexicon_sentiment(F.col("text"), F.col("emotes"), {**EVENT_WEIGHTS_POS, "pogchamp": 0.9}, EVENT_WEIGHTS_NEG)
    return adapters.messages(spark, sf).select("message_id", s.alias("s")).select("message_id", "s.*")


def _weights_sql(weights: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in weights.items())


def _doc_hits(weights: dict[str, float]) -> str:
    return f"""lex(term, w) AS (VALUES {_weights_sql(weights)}),
        tok AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents),
        agg AS (SELECT doc_id, count(*) AS n, sum(w) AS total FROM tok JOIN lex USING (term) GROUP BY 1),
        hits AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM documents d LEFT JOIN agg USING (doc_id))"""


@register(
    "lexicon_sentiment_speech",
    f"""WITH {_doc_hits(lexicons.SPEECH_TERMS)}
        SELECT doc_id, {rnd("CASE WHEN n = 0 THEN 0.0 ELSE " + clamp_sql("total / n", -1, 1) + " END")} AS score,
               {rnd("CASE WHEN n = 0 THEN 0.25 ELSE " + clamp_sql("0.35 + n * 0.10", 0.35, 0.75) + " END")} AS confidence,
               CASE WHEN n > 0 AND total / n > 0.15 THEN 'positive' WHEN n > 0 AND total / n < -0.15 THEN 'negative' ELSE 'neutral' END AS label
        FROM hits""",
)
def _(spark, sf):
    s = text.lexicon_sentiment_speech(F.col("text"), lexicons.SPEECH_TERMS)
    return adapters.documents(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.*")


@register(
    "lexicon_label",
    f"""WITH {_doc_hits(lexicons.LABEL_TERMS)}
        SELECT doc_id, CASE WHEN n > 0 AND total / n > 0.15 THEN 'positive' WHEN n > 0 AND total / n < -0.15 THEN 'negative' ELSE 'neutral' END AS label,
               {rnd("CASE WHEN n = 0 THEN 0.45 ELSE " + clamp_sql("0.35 + n * 0.10", 0.35, 0.85) + " END")} AS confidence
        FROM hits""",
)
def _(spark, sf):
    s = text.lexicon_label(F.col("text"), lexicons.LABEL_TERMS)
    return adapters.documents(spark, sf).select("doc_id", s.alias("s")).select("doc_id", "s.label", "s.confidence")


@register(
    "text_ratios",
    rf"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\p{{L}}')) AS letters, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper,
                  len(regexp_extract_all(text, '[!?]')) AS marks, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS chars FROM documents)
        SELECT doc_id, {rnd("CASE WHEN letters < 3 THEN 0.0 ELSE upper / letters END")} AS uppercase_ratio,
               {rnd("least(marks / 4.0, 1)")} AS punctuation_burst, CAST(chars BETWEEN 1 AND 12 AS BIGINT) AS is_short_burst FROM d""",
)
def _(spark, sf):
    t = F.col("text")
    return adapters.documents(spark, sf).select(
        "doc_id",
        text.uppercase_ratio(t).alias("uppercase_ratio"),
        text.punctuation_burst(t).alias("punctuation_burst"),
        text.is_short_burst(t).alias("is_short_burst"),
    )


@register(
    "valence",
    f"""WITH lex(term, w) AS (VALUES ('the', 0.4), ('and', -0.2), ('la', 0.3), ('un', -0.7), ('best', 1.0)),
        tok AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents),
        agg AS (SELECT doc_id, avg(w) AS v FROM tok JOIN lex USING (term) GROUP BY 1)
        SELECT d.doc_id, {rnd("v")} AS valence FROM documents d LEFT JOIN agg USING (doc_id)""",
)
def _(spark, sf):
    weights = {"the": 0.4, "and": -0.2, "la": 0.3, "un": -0.7, "best": 1.0}
    v = text.valence(F.array_distinct(text.tokens(F.col("text"))), weights)
    return adapters.documents(spark, sf).select("doc_id", v.alias("valence"))


@register(
    "sentiment_label",
    f"""WITH {MSG} SELECT message_id, CASE WHEN text = 'view' THEN 'neutral' WHEN score > 0.15 THEN 'positive'
        WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM msg""",
)
def _(spark, sf):
    given = F.when(F.col("text") == "view", "neutral").otherwise("")
    return adapters.messages(spark, sf).select("message_id", text.sentiment_label(F.col("score"), given).alias("label"))


@register(
    "evidence_score",
    f"""WITH {MSG} SELECT message_id, {rnd("1.2 * CAST(text IN ('purchase', 'signup') AS INT) + 1.1 * CAST(text = 'click' AS INT) + 1.1 * CAST(text = 'error' AS INT) + 0.4 * len(emotes)")} AS evidence_score FROM msg""",
)
def _(spark, sf):
    feats = windows.message_features(adapters.messages(spark, sf), EVENT_LEXICON)
    return feats.select("message_id", F.col("_evidence").alias("evidence_score"))


@register(
    "round_half_away",
    f"""SELECT l_orderkey, l_linenumber, {rnd(half_away("l_extendedprice * (1 - l_discount) / 7 - 3000", 3))} AS r3,
               {rnd(half_away("l_tax - l_discount", 1))} AS r1, {rnd(clamp_sql("l_quantity / 25 - 1", -0.5, 0.75))} AS c FROM lineitem""",
)
def _(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7 - 3000
    return adapters.table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        round_half_away(net, 3).alias("r3"),
        round_half_away(F.col("l_tax") - F.col("l_discount"), 1).alias("r1"),
        clamp(F.col("l_quantity") / 25 - 1, -0.5, 0.75).alias("c"),
    )


@register(
    "rfc3339_key",
    r"""SELECT event_id, strftime(ts, '%Y-%m-%d') || ':' || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z:'
          || regexp_replace(strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z' AS key FROM events""",
)
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    key = keys.window_key(F.date_format("ts", "yyyy-MM-dd"), ts, F.date_trunc("hour", ts))
    return adapters.table(spark, sf, "events").select("event_id", key.alias("key"))


@register("hash_identity", f"WITH {MSG} SELECT message_id, sha256('pepper:' || lower(trim(display_name))) AS user_hash FROM msg")
def _(spark, sf):
    return adapters.messages(spark, sf).select("message_id", keys.hash_identity("pepper", F.col("display_name")).alias("user_hash"))


@register(
    "snippet",
    r"""SELECT doc_id, CASE WHEN length(t) > 180 THEN left(t, 177) || '...' ELSE t END AS snippet
        FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
)
def _(spark, sf):
    return adapters.documents(spark, sf).select("doc_id", text.snippet(F.col("text"), 180).alias("snippet"))


# --- tumbling windows -------------------------------------------------------


@register(
    "chat_buckets",
    f"""WITH {BUCKETS} SELECT {KEY}, message_count, unique_chatters, {rnd("chat_sentiment")} AS chat_sentiment,
        {rnd("sentiment_confidence")} AS sentiment_confidence, {rnd("positive")} AS positive, {rnd("neutral")} AS neutral,
        {rnd("negative")} AS negative FROM buckets""",
)
def _(spark, sf):
    return windows.chat_buckets(adapters.messages(spark, sf), HOUR)


@register(
    "top_n_terms",
    f"""WITH {MSG}, w AS (
          SELECT CAST(conv_id AS VARCHAR) AS session_id, role AS channel_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term,
                 time_bucket(INTERVAL 1 DAY, make_timestamp((conv_id * 86400 + turn * 20) * 1000000)) AS bucket_start FROM conversations),
        c AS (SELECT session_id, channel_id, bucket_start, term, count(*) AS n FROM w
              WHERE length(term) >= 3 AND term NOT IN ('and', 'are', 'but', 'for', 'lol', 'that', 'the', 'this', 'was', 'with') GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY n DESC, term) AS rn FROM c)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, string_agg(term, '|' ORDER BY rn) AS top_terms
        FROM r WHERE rn <= 5 GROUP BY ALL""",
)
def _(spark, sf):
    return windows.top_terms(adapters.turns(spark, sf), 86400).drop("bucket_end")


@register(
    "top_n_emotes",
    f"""WITH {MSG} SELECT {KEY}, 'PogChamp' AS top_emotes FROM scored WHERE len(emotes) > 0 GROUP BY ALL""",
)
def _(spark, sf):
    return windows.top_emotes(adapters.messages(spark, sf), HOUR)


@register(
    "language_mix",
    f"""WITH {MSG}, c AS (SELECT session_id, channel_id, bucket_start, bucket_end, CASE WHEN language = '' THEN 'other' ELSE language END AS language, count(*) AS n
          FROM scored GROUP BY ALL)
        SELECT {KEY}, language, n, {rnd("n / sum(n) OVER (PARTITION BY session_id, channel_id, bucket_start)")} AS share FROM c""",
)
def _(spark, sf):
    mix = windows.language_mix(adapters.messages(spark, sf), HOUR)
    n = windows.language_shares(adapters.messages(spark, sf), HOUR).drop("share")
    long = mix.select(*windows.BUCKET, F.explode("language_mix").alias("language", "share"))
    return long.join(n, [*windows.BUCKET, "language"])


@register(
    "repeat_ratio",
    f"""WITH {MSG}, c AS (SELECT session_id, channel_id, bucket_start, bucket_end, lower(text) AS t, count(*) AS n FROM scored GROUP BY ALL)
        SELECT {KEY}, CAST(sum(n) AS BIGINT) AS message_count,
               {rnd("CASE WHEN sum(n) <= 1 THEN 0.0 ELSE sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) END")} AS repeat_ratio FROM c GROUP BY session_id, channel_id, bucket_start, bucket_end""",
)
def _(spark, sf):
    return windows.repeat_ratio(adapters.messages(spark, sf), HOUR)


# --- sliding windows --------------------------------------------------------

W, SLIDE = 3600, 1200

REACT = f"""{MSG},
ends AS (SELECT m.*, time_bucket(INTERVAL 20 MINUTE, ts) - i * INTERVAL 20 MINUTE AS window_start FROM msg m, range(3) r(i)),
cur AS (
  SELECT session_id, channel_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, count(DISTINCT lower(username)) AS chatters,
         sum(CAST(text IN ('purchase', 'signup') AS INT) + CAST(text = 'view' AS INT) + len(emotes)) AS hype, sum(CAST(text = 'click' AS INT)) AS confusion,
         sum(CAST(text = 'error' AS INT)) AS frustration, sum(CAST(length(text) BETWEEN 1 AND 12 AS INT)) AS short,
         sum(CASE text WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 WHEN 'error' THEN -1.0 END) AS valence,
         count(CASE WHEN text IN ('purchase', 'signup', 'error') THEN 1 END) AS valence_n
  FROM ends GROUP BY ALL),
rep AS (SELECT session_id, channel_id, window_start, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS repeated
        FROM (SELECT session_id, channel_id, window_start, text, count(*) AS n FROM ends GROUP BY ALL) GROUP BY ALL),
j AS (
  SELECT c.*, r.repeated, coalesce(p.n, 0) AS pn, coalesce(p.chatters, 0) AS pc, c.n / 3600.0 * 60 AS rpm, coalesce(p.n, 0) / 3600.0 * 60 AS prate
  FROM cur c JOIN rep r USING (session_id, channel_id, window_start)
  LEFT JOIN cur p ON p.session_id = c.session_id AND p.channel_id = c.channel_id AND p.window_start = c.window_start - INTERVAL 1 HOUR),
k AS (
  SELECT *, CASE WHEN prate > 0 THEN least(greatest(greatest(least(rpm / 120, 1), (rpm - prate) / greatest(prate, 1)), 0), 1)
              ELSE least(rpm / 120, 1) END AS velocity,
         CASE WHEN pc = 0 THEN least(chatters / 10.0, 1) ELSE least(greatest((chatters - pc) / greatest(pc, 1)::DOUBLE, 0), 1) END AS unique_spike,
         CASE WHEN n <= 1 THEN 0.0 ELSE repeated / n END AS repeat_ratio FROM j),
s AS (
  SELECT *, least(greatest(hype / n * 1.8 + short / n * 0.2 + repeat_ratio * 0.25, 0), 1) AS h, least(confusion / n * 1.5, 1) AS c,
         least(frustration / n * 1.5 + CASE WHEN valence < 0 THEN least(abs(valence / valence_n) * 0.25, 1) ELSE 0 END, 1) AS f,
         velocity * 0.35 + repeat_ratio * 0.15 + unique_spike * 0.12 AS i FROM k),
t AS (
  SELECT *, CASE WHEN greatest(h, c, f, i) < 0.2 THEN 'neutral' WHEN h >= greatest(c, f, i) THEN 'hype' WHEN c >= greatest(f, i) THEN 'confusion'
             WHEN f >= i THEN 'frustration' ELSE 'intensity' END AS reaction_type FROM s),
rw AS (
  SELECT session_id, channel_id, window_start, window_end, n AS message_count, chatters AS unique_chatters, pn, pc, velocity, unique_spike, rpm,
         {half_away("rpm")} AS messages_per_minute, {half_away("velocity")} AS velocity_score, {half_away("h")} AS hype_score, {half_away("i")} AS intensity_score,
         {half_away("c")} AS confusion_score, {half_away("f")} AS frustration_score, {half_away("coalesce(valence / valence_n, 0.0)")} AS valence, reaction_type,
         CASE reaction_type WHEN 'hype' THEN h WHEN 'confusion' THEN c WHEN 'frustration' THEN f WHEN 'intensity' THEN i ELSE i * 0.5 END AS raw_confidence FROM t)"""

WKEY = f"session_id, channel_id, {us}(window_start) AS window_start, {us}(window_end) AS window_end"
_RW_COLS = ", ".join(
    f"{rnd(c)} AS {c}"
    for c in ("messages_per_minute", "velocity_score", "hype_score", "intensity_score", "confusion_score", "frustration_score", "valence")
)


@register(
    "velocity_and_spike",
    f"""WITH {REACT} SELECT {WKEY}, message_count, unique_chatters, CAST(pn AS BIGINT) AS previous_count, CAST(pc AS BIGINT) AS previous_chatters,
        {rnd("rpm")} AS messages_per_minute, {rnd("velocity")} AS velocity, {rnd("unique_spike")} AS unique_spike FROM rw""",
)
def _(spark, sf):
    feats = windows.message_features(adapters.messages(spark, sf), EVENT_LEXICON)
    agg = windows.velocity_and_spike(windows.reaction_features(feats, W, SLIDE), W)
    return agg.select(
        *windows.RWINDOW, "message_count", "unique_chatters", "previous_count", "previous_chatters", "messages_per_minute", "velocity", "unique_spike"
    )


@register(
    "reaction_scores",
    f"""WITH {REACT} SELECT {WKEY}, message_count, unique_chatters, {_RW_COLS}, reaction_type, {rnd(half_away("raw_confidence"))} AS confidence FROM rw""",
)
def _(spark, sf):
    return windows.reaction_core(adapters.messages(spark, sf), W, SLIDE, EVENT_LEXICON).select(*windows.REACTION_COLUMNS)


TARGET = """
tw AS (SELECT session_id, channel_id, window_start, text AS token, count(*) AS n, min((ts, message_id)) AS first FROM ends WHERE text <> 'view' GROUP BY ALL),
tr AS (SELECT w.*, row_number() OVER (PARTITION BY session_id, channel_id, window_start ORDER BY w.n DESC, w.first, w.token) AS rn FROM tw w WHERE w.n >= 2),
tg AS (SELECT c.session_id, c.channel_id, c.window_start, c.window_end, CASE WHEN tr.n / c.n >= 0.4 THEN tr.token END AS target_text
       FROM cur c LEFT JOIN tr ON tr.session_id = c.session_id AND tr.channel_id = c.channel_id AND tr.window_start = c.window_start AND tr.rn = 1)"""

EVID = """
ev AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, window_start ORDER BY
          CASE text WHEN 'purchase' THEN 1.2 + 0.4 WHEN 'signup' THEN 1.2 WHEN 'click' THEN 1.1 WHEN 'error' THEN 1.1 ELSE 0 END DESC, ts, message_id) AS rn FROM ends),
eg AS (SELECT session_id, channel_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, string_agg(message_id, '|' ORDER BY rn) AS evidence_ids,
         string_agg(message_id || ' ' || CAST(epoch_us(ts) AS VARCHAR) || ' ' || username || ' ' || display_name || ' ' || text, '|' ORDER BY rn) AS evidence_messages FROM ev WHERE rn <= 5 GROUP BY ALL)"""


@register("window_target", f"WITH {REACT}, {TARGET} SELECT {WKEY}, target_text FROM tg")
def _(spark, sf):
    return windows.window_target(adapters.messages(spark, sf), W, SLIDE, EVENT_LEXICON)


def shown(messages: str):
    """Evidence messages as one text each, for comparison."""
    return F.transform(messages, lambda m: F.concat_ws(" ", m["message_id"], F.unix_micros(m["timestamp"]).cast("string"), m["username"], m["display_name"], m["text"]))


@register("top_evidence", f"WITH {REACT}, {EVID} SELECT {WKEY}, evidence_ids, evidence_messages FROM eg")
def _(spark, sf):
    found = windows.top_evidence(adapters.messages(spark, sf), W, SLIDE, 5, EVENT_LEXICON)
    return found.withColumn("evidence_messages", shown("evidence_messages"))


FULL_RW = f"""{REACT}, {TARGET}, {EVID},
full_rw AS (SELECT *, CASE WHEN target_text = '' THEN reaction_type ELSE reaction_type || ':' || target_text END AS event_hint, {half_away("raw_confidence")} AS confidence,
         greatest(intensity_score, hype_score, confusion_score, frustration_score) AS reaction_score
  FROM (SELECT rw.*, CASE WHEN reaction_type = 'neutral' OR raw_confidence < 0.35 THEN '' ELSE coalesce(tg.target_text, '') END AS target_text, eg.evidence_ids, eg.evidence_messages
        FROM rw LEFT JOIN tg USING (session_id, channel_id, window_start) LEFT JOIN eg USING (session_id, channel_id, window_start)))"""


@register(
    "reaction_windows",
    f"""WITH {FULL_RW} SELECT {WKEY}, message_count, unique_chatters, {_RW_COLS}, reaction_type, {rnd("confidence")} AS confidence, 'unknown' AS target_type, target_text,
        'chat' AS source, event_hint, evidence_ids, evidence_messages FROM full_rw""",
)
def _(spark, sf):
    found = windows.reaction_windows(adapters.messages(spark, sf), W, SLIDE, EVENT_LEXICON)
    return found.withColumn("evidence_messages", shown("evidence_messages"))


PEAKS = f"""{FULL_RW},
inb AS (SELECT *, time_bucket(INTERVAL 4 HOUR, window_start) AS bucket_start FROM full_rw WHERE window_end <= time_bucket(INTERVAL 4 HOUR, window_start) + INTERVAL 4 HOUR),
pk AS (SELECT session_id, channel_id, bucket_start, count(*) AS subwindow_count, arg_max(inb, (reaction_score, window_end)) AS p FROM inb GROUP BY ALL),
b4 AS (SELECT session_id, channel_id, time_bucket(INTERVAL 4 HOUR, ts) AS bucket_start, count(*) AS message_count FROM msg GROUP BY ALL)"""


@register(
    "attach_peaks",
    f"""WITH {PEAKS} SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, message_count, coalesce(subwindow_count, 0) AS subwindow_count,
        {rnd("p.reaction_score")} AS peak_reaction_score, p.reaction_type AS peak_reaction_type, p.target_text AS peak_target_text, p.event_hint AS peak_event_hint,
        {rnd("p.confidence")} AS peak_confidence, coalesce(p.evidence_ids, '') AS peak_evidence_ids, coalesce(p.evidence_messages, '') AS peak_evidence_messages, {us}(p.window_start) AS peak_window_start, {us}(p.window_end) AS peak_time
        FROM b4 LEFT JOIN pk USING (session_id, channel_id, bucket_start)""",
)
def _(spark, sf):
    msgs = adapters.messages(spark, sf)
    buckets = windows.chat_buckets(msgs, 4 * HOUR)
    rw = windows.reaction_windows(msgs, W, SLIDE, EVENT_LEXICON)
    return windows.attach_peaks(buckets, rw, 4 * HOUR).select(
        "session_id", "channel_id", "bucket_start", "message_count", F.coalesce(F.size("subwindows"), F.lit(0)).alias("subwindow_count"),
        "peak_reaction_score", "peak_reaction_type", "peak_target_text", "peak_event_hint", "peak_confidence", "peak_evidence_ids",
        shown("peak_evidence_messages").alias("peak_evidence_messages"), "peak_window_start", "peak_time",
    )
