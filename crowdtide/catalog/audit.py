"""Evaluation against labels, session audits, baseline comparison and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from crowdtide.catalog.common import BUCKETS, ORACLES, TBUCKETS, half_away, register, rnd, rounded, us
from crowdtide.catalog.timeline import ALIGN, LABELS, LAGS, SIGNAL, STREAM, chat, signal, speech, window_labels
from crowdtide.operators import alignment, correlation, evaluation, proof
from crowdtide.operators.windows import with_bucket
from crowdtide.sources import adapters
from crowdtide.sources.storage import settle

HOUR = adapters.HOUR


def r4(expr: str) -> str:
    return rnd(half_away(expr, 4))


# --- evaluation -------------------------------------------------------------

# Human labels per chat bucket: an older and a newer version, some uncertain or unknown, some for windows that do not exist.
HLABELS = """hl AS (
  SELECT session_id, bucket_start + CASE WHEN message_count = 1 THEN INTERVAL 1 SECOND ELSE INTERVAL 0 SECOND END AS window_start, bucket_end AS window_end,
         CASE WHEN chat_sentiment > 0.2 THEN 'hype_spike' WHEN chat_sentiment < -0.6 THEN 'Frustration_Spike ' WHEN unique_chatters % 5 = 0 THEN 'audience_shift'
              WHEN unique_chatters % 11 = 0 THEN 'boredom' ELSE '' END AS event_label,
         CASE WHEN message_count % 6 = 0 THEN 'uncertain' ELSE 'correct' END AS correctness, CASE WHEN message_count % 4 = 0 THEN 'hype_spike' ELSE '' END AS predicted_event,
         CASE WHEN message_count % 3 = 0 THEN bucket_start + INTERVAL 5 MINUTE END AS event_peak, CASE WHEN message_count % 2 = 0 THEN 'Hype' ELSE '' END AS reaction_type,
         CASE WHEN message_count % 5 = 0 THEN 'unknown' ELSE '' END AS target_type, channel_id, bucket_start AS updated_at FROM buckets),
hl1 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, window_start, window_end ORDER BY updated_at DESC, channel_id) AS rn FROM hl) WHERE rn = 1)"""


def human_labels(buckets):
    s, n = F.col("chat_sentiment"), F.col("message_count")
    label = (
        F.when(s > 0.2, "hype_spike")
        .when(s < -0.6, "Frustration_Spike ")
        .when(F.col("unique_chatters") % 5 == 0, "audience_shift")
        .when(F.col("unique_chatters") % 11 == 0, "boredom")
        .otherwise("")
    )
    none = F.lit(None).cast("timestamp")
    return buckets.select(
        "session_id",
        F.when(n == 1, F.col("bucket_start") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("bucket_start")).alias("window_start"),
        F.col("bucket_end").alias("window_end"),
        label.alias("event_label"),
        F.when(n % 6 == 0, "uncertain").otherwise("correct").alias("correctness"),
        F.when(n % 4 == 0, "hype_spike").otherwise("").alias("predicted_event"),
        none.alias("event_start"),
        F.when(n % 3 == 0, F.col("bucket_start") + F.expr("INTERVAL 5 MINUTES")).alias("event_peak"),
        F.when(n % 2 == 0, "Hype").otherwise("").alias("reaction_type"),
        F.when(n % 5 == 0, "unknown").otherwise("").alias("target_type"),
        F.lit("").alias("target_text"),
        F.lit("").alias("divergence_type"),
        F.col("channel_id").alias("pos"),
        F.col("bucket_start").alias("updated_at"),
        none.alias("created_at"),
    )


# Windows of channel c1 win over c0, as the later row does.
EVW = f"""{SIGNAL}, {HLABELS},
first_ev AS (SELECT session_id, channel_id, bucket_start, arg_min(type, ord) AS first_event_type, list(type ORDER BY ord) AS types FROM evs GROUP BY ALL),
win AS (SELECT * EXCLUDE (rn) FROM (SELECT s.session_id, s.bucket_start AS window_start, s.bucket_end AS window_end, s.reaction_type, coalesce(f.first_event_type, '') AS fe,
          coalesce(f.types, []) AS types, row_number() OVER (PARTITION BY s.session_id, s.bucket_start, s.bucket_end ORDER BY s.channel_id DESC) AS rn
        FROM sx s LEFT JOIN first_ev f USING (session_id, channel_id, bucket_start)) WHERE rn = 1),
jd0 AS (SELECT l.session_id, l.window_start, l.window_end, CASE WHEN trim(l.event_label) = '' THEN 'none' ELSE lower(trim(l.event_label)) END AS actual,
          CASE WHEN l.predicted_event <> '' THEN l.predicted_event WHEN coalesce(w.fe, '') <> '' THEN w.fe ELSE 'none' END AS predicted,
          l.correctness, l.event_peak, lower(l.reaction_type) AS ra, w.reaction_type AS rp, l.target_type, coalesce(w.types, []) AS types, coalesce(w.fe, '') AS fe, w.session_id IS NOT NULL AS matched
        FROM hl1 l LEFT JOIN win w ON w.session_id = l.session_id AND w.window_start = l.window_start AND w.window_end = l.window_end),
jd AS (SELECT *, CASE WHEN NOT matched THEN 'unmatched' WHEN correctness = 'uncertain' THEN 'uncertain'
          WHEN actual NOT IN ('hype_spike', 'frustration_spike', 'audience_shift', 'content_audience_divergence', 'none') THEN 'invalid' ELSE 'evaluated' END AS outcome,
          CASE WHEN actual <> 'none' AND actual = predicted AND (list_contains(types, actual) OR fe = actual) THEN epoch_ms(window_start) - epoch_ms(coalesce(event_peak, window_start)) END AS onset,
          list_contains(types, 'hype_spike') AS hype_hit, list_contains(types, actual) AS actual_hit FROM jd0),
ev AS (SELECT * FROM jd WHERE outcome = 'evaluated')"""


def judged(spark, sf):
    w = signal(spark, sf)
    windows = evaluation.evaluation_windows(w, chat_with_subwindows(chat(spark, sf)))
    return settle(evaluation.judge(windows, human_labels(chat(spark, sf))).drop("w"), "judged")


def chat_with_subwindows(buckets):
    sub = "array<struct<window_start:timestamp,window_end:timestamp,reaction_score:double,reaction_type:string,target_type:string,target_text:string,source:string,event_hint:string,confidence:double,evidence_ids:array<string>>>"
    return buckets.withColumns({"subwindows": F.array().cast(sub), "peak_time": F.lit(None).cast("timestamp")})


@register(
    "evaluation_windows",
    f"""WITH {SIGNAL}, a AS (SELECT session_id, bucket_start AS s, bucket_end AS e, channel_id, 0 AS p, coalesce((SELECT arg_min(type, ord) FROM evs v WHERE v.session_id = sx.session_id
             AND v.channel_id = sx.channel_id AND v.bucket_start = sx.bucket_start), '') AS t FROM sx
          UNION ALL SELECT session_id, bucket_start, CASE WHEN unique_chatters % 2 = 0 THEN bucket_end ELSE bucket_start + INTERVAL 10 MINUTE END, channel_id, 1,
             CASE WHEN greatest(positive, negative) < 0.35 AND sentiment_confidence < 0.35 THEN '' WHEN positive > negative THEN 'hype_spike' ELSE 'frustration_spike' END FROM buckets),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id, s, e ORDER BY p DESC, channel_id DESC) AS rn FROM a)
        SELECT session_id, {us}(s) AS window_start, {us}(e) AS window_end, t AS first_event_type FROM r WHERE rn = 1""",
)
def _(spark, sf):
    b = chat(spark, sf)
    end = F.when(F.col("unique_chatters") % 2 == 0, F.col("bucket_end")).otherwise(F.col("bucket_start") + F.expr("INTERVAL 10 MINUTES"))
    sub = F.struct(
        F.col("bucket_start").alias("window_start"), end.alias("window_end"), F.greatest("positive", "negative").alias("reaction_score"),
        F.when(F.col("positive") > F.col("negative"), "Hype").otherwise("frustration").alias("reaction_type"), F.lit("unknown").alias("target_type"),
        F.lit("").alias("target_text"), F.lit("chat").alias("source"), F.lit("").alias("event_hint"), F.col("sentiment_confidence").alias("confidence"),
        F.array().cast("array<string>").alias("evidence_ids"),
    )
    nested = b.withColumns({"subwindows": F.array(sub), "peak_time": F.lit(None).cast("timestamp")})
    return evaluation.evaluation_windows(signal(spark, sf), nested).select("session_id", "window_start", "window_end", "first_event_type")


@register(
    "reaction_event",
    f"""WITH {TBUCKETS.replace("tbuckets AS", "tb AS")}, s AS (SELECT segment_id, segment_start, confidence, CASE WHEN text LIKE 'purchase%' THEN ' Hype' WHEN text LIKE 'error%' THEN 'frustration'
             WHEN text LIKE 'click%' THEN 'Surprise' ELSE 'neutral' END AS k, asr_latency_ms / 1000.0 AS score, segment_end FROM seg)
        SELECT segment_id, CASE WHEN score < 0.35 AND confidence < 0.35 THEN '' WHEN lower(trim(k)) = 'hype' THEN 'hype_spike' WHEN k = 'frustration' THEN 'frustration_spike'
             WHEN k = 'Surprise' THEN 'audience_shift' ELSE '' END AS event,
             {us}(CASE WHEN date_trunc('minute', segment_end) BETWEEN segment_start AND segment_end THEN date_trunc('minute', segment_end) ELSE segment_end END) AS event_time FROM s""",
)
def _(spark, sf):
    t = F.col("text")
    kind = F.when(t.startswith("purchase"), " Hype").when(t.startswith("error"), "frustration").when(t.startswith("click"), "Surprise").otherwise("neutral")
    at = evaluation.reaction_event_time(F.date_trunc("minute", "segment_end"), F.col("segment_start"), F.col("segment_end"))
    return adapters.segments(spark, sf).select(
        "segment_id", evaluation.reaction_event(kind, F.col("asr_latency_ms") / 1000.0, F.col("confidence")).alias("event"), at.alias("event_time")
    )


@register(
    "latest_label",
    f"""WITH {SIGNAL}, {HLABELS} SELECT session_id, {us}(window_start) AS window_start, {us}(window_end) AS window_end, event_label, channel_id AS pos FROM hl1""",
)
def _(spark, sf):
    return evaluation.latest_label(human_labels(chat(spark, sf))).select("session_id", "window_start", "window_end", "event_label", "pos")


@register(
    "window_label_join",
    f"WITH {EVW} SELECT session_id, {us}(window_start) AS window_start, {us}(window_end) AS window_end, actual, predicted, outcome, CAST(onset AS DOUBLE) AS onset_ms FROM jd",
)
def _(spark, sf):
    return judged(spark, sf).select(
        "session_id", "window_start", "window_end", "actual", "predicted", "outcome", "onset_ms"
    )


@register("event_confusion", f"WITH {EVW} SELECT session_id, actual, predicted, count(*) AS count FROM ev GROUP BY ALL")
def _(spark, sf):
    return evaluation.event_confusion(judged(spark, sf)).drop("actual_rank")


BIN = """count(*) FILTER (actual <> 'none' AND actual = predicted) AS tp, count(*) FILTER (predicted <> 'none' AND actual <> predicted) AS fp,
  count(*) FILTER (actual <> 'none' AND actual <> predicted) AS fn, count(*) FILTER (actual = 'none' AND predicted = 'none') AS tn"""


@register(
    "event_binary_counts",
    f"""WITH {EVW}, b AS (SELECT session_id, {BIN} FROM ev GROUP BY 1)
        SELECT session_id, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative FROM b""",
)
def _(spark, sf):
    return evaluation.event_binary_counts(judged(spark, sf))


P, R = half_away("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END", 4), half_away("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END", 4)
PRF = f"SELECT *, {P} AS p, {R} AS r FROM"
F1 = r4("CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END")


@register(
    "precision_recall",
    f"""WITH {EVW}, b AS (SELECT session_id, {BIN} FROM ev GROUP BY 1) SELECT session_id, {rnd("p")} AS precision, {rnd("r")} AS recall, {F1} AS f1 FROM ({PRF} b)""",
)
def _(spark, sf):
    out = evaluation.with_precision_recall(evaluation.event_binary_counts(judged(spark, sf)))
    return out.select("session_id", "precision", "recall", "f1")


CLS = """lab2(label) AS (VALUES ('hype_spike'), ('frustration_spike'), ('audience_shift'), ('content_audience_divergence'), ('none')),
keys AS (SELECT DISTINCT session_id, label FROM jd, lab2 UNION SELECT session_id, predicted FROM ev),
cls AS (SELECT k.session_id, k.label, count(*) FILTER (actual = k.label) AS support, count(*) FILTER (predicted = k.label) AS predicted_count,
          count(*) FILTER (actual = k.label AND predicted = k.label) AS tp, count(*) FILTER (predicted = k.label AND actual <> k.label) AS fp,
          count(*) FILTER (actual = k.label AND predicted <> k.label) AS fn FROM keys k LEFT JOIN ev USING (session_id) GROUP BY ALL)"""


@register(
    "per_label_metrics",
    f"""WITH {EVW}, {CLS} SELECT session_id, label, support, predicted_count, tp AS true_positive, fp AS false_positive, fn AS false_negative,
        {rnd("p")} AS precision, {rnd("r")} AS recall, {F1} AS f1 FROM ({PRF} cls)""",
)
def _(spark, sf):
    return evaluation.per_label_metrics(judged(spark, sf))


@register(
    "macro_f1",
    f"""WITH {EVW}, {CLS}, m AS (SELECT session_id, {F1} AS f1 FROM ({PRF} cls) WHERE support > 0 OR predicted_count > 0)
        SELECT session_id, {r4("avg(f1)")} AS macro_f1 FROM m GROUP BY 1""",
)
def _(spark, sf):
    return evaluation.macro_f1(evaluation.per_label_metrics(judged(spark, sf)))


PEAKR = """count(*) FILTER (actual = 'hype_spike' AND hype_hit) / nullif(count(*) FILTER (actual = 'hype_spike'), 0)"""
PEAKR2 = """count(*) FILTER (actual <> 'none' AND event_peak IS NOT NULL AND actual_hit) / nullif(count(*) FILTER (actual <> 'none' AND event_peak IS NOT NULL), 0)"""


@register(
    "peak_recall",
    f"""WITH {EVW}, x AS (SELECT session_id, {PEAKR} AS h, {PEAKR2} AS k FROM ev GROUP BY 1)
        SELECT session_id, {r4("h")} AS hype_peak_recall, {r4("coalesce(k, h)")} AS peak_recall FROM x""",
)
def _(spark, sf):
    return evaluation.peak_recall(judged(spark, sf))


@register("onset_latency", f"WITH {EVW} SELECT session_id, {r4('avg(onset)')} AS onset_latency_ms FROM ev GROUP BY 1")
def _(spark, sf):
    return evaluation.onset_latency(judged(spark, sf))


DIMS = f"""{r4("avg(CASE WHEN ra <> '' THEN CAST(ra = rp AS INT) END)")} AS reaction_type_accuracy,
  {r4("avg(CASE WHEN target_type <> '' THEN CAST(target_type = 'unknown' AS INT) END)")} AS target_accuracy,
  {r4("avg(CAST((actual = 'content_audience_divergence') = list_contains(types, 'content_audience_divergence') AS INT))")} AS divergence_accuracy"""


@register("dimension_accuracy", f"WITH {EVW} SELECT session_id, {DIMS} FROM ev GROUP BY 1")
def _(spark, sf):
    return evaluation.dimension_accuracy(judged(spark, sf))


@register(
    "session_evaluation",
    f"""WITH {EVW}, t AS (SELECT session_id, count(*) AS total_windows FROM win GROUP BY 1),
        a AS (SELECT session_id, count(*) AS total_labeled_windows, count(*) FILTER (outcome = 'evaluated') AS evaluated_windows, count(*) FILTER (outcome = 'unmatched') AS unmatched_labels,
           count(*) FILTER (outcome = 'uncertain') AS uncertain_labels, count(*) FILTER (outcome = 'invalid') AS invalid_labels FROM jd GROUP BY 1),
        b AS (SELECT session_id, {BIN}, count(*) FILTER (actual = 'none' AND predicted <> 'none') AS false_positives_normal_chat, {r4("avg(CAST(actual = predicted AS INT))")} AS event_accuracy, {DIMS} FROM ev GROUP BY 1)
        SELECT session_id, total_windows, total_labeled_windows, evaluated_windows, unmatched_labels, uncertain_labels, invalid_labels, false_positives_normal_chat, event_accuracy,
           {rnd("p")} AS event_precision, {rnd("r")} AS event_recall, {F1} AS event_f1, {r4("evaluated_windows / total_windows")} AS coverage, reaction_type_accuracy, target_accuracy, divergence_accuracy
        FROM t JOIN a USING (session_id) JOIN ({PRF} b) USING (session_id)""",
)
def _(spark, sf):
    windows = evaluation.evaluation_windows(signal(spark, sf), chat_with_subwindows(chat(spark, sf)))
    return evaluation.session_evaluation(windows, human_labels(chat(spark, sf))).select(
        "session_id", "total_windows", "total_labeled_windows", "evaluated_windows", "unmatched_labels", "uncertain_labels", "invalid_labels",
        "false_positives_normal_chat", "event_accuracy", "event_precision", "event_recall", "event_f1", "coverage", "reaction_type_accuracy",
        "target_accuracy", "divergence_accuracy",
    )


# Orders per customer in the first and second half of the year act as baseline and current metrics.
BASE = """m AS (SELECT CAST(o_custkey AS VARCHAR) AS session_id, CASE o_orderpriority[1] WHEN '1' THEN 'event_f1' WHEN '2' THEN 'transcript_empty_ratio' WHEN '3' THEN 'total_windows' WHEN '4' THEN 'partial' ELSE 'unknown_metric' END AS name,
   month(o_orderdate) <= 6 AS old, o_totalprice / 1000 AS v FROM orders),
b AS (SELECT session_id, name, avg(v) AS baseline FROM m WHERE old GROUP BY ALL), c AS (SELECT session_id, name, avg(v) AS current FROM m WHERE NOT old GROUP BY ALL)"""


def order_metrics(spark, sf):
    o = adapters.table(spark, sf, "orders")
    p = F.left("o_orderpriority", F.lit(1))
    name = F.when(p == "1", "event_f1").when(p == "2", "transcript_empty_ratio").when(p == "3", "total_windows").when(p == "4", "partial").otherwise("unknown_metric")
    rows = o.select(F.col("o_custkey").cast("string").alias("session_id"), name.alias("name"), (F.month("o_orderdate") <= 6).alias("old"), (F.col("o_totalprice") / 1000).alias("v"))

    def half(old):
        return rows.where(F.col("old") if old else ~F.col("old")).groupBy("session_id", "name").agg(F.avg("v").alias("value"))

    return half(True), half(False)


@register(
    "compare_to_baseline",
    f"""WITH {BASE}, j AS (SELECT b.*, c.current, CASE name WHEN 'event_f1' THEN 10.0 ELSE 0.0 END AS threshold FROM b LEFT JOIN c USING (session_id, name) WHERE session_id IN (SELECT session_id FROM c)),
        r AS (SELECT *, CASE WHEN name = 'unknown_metric' THEN NULL WHEN name = 'total_windows' THEN CASE WHEN coalesce(current, 0) < baseline THEN 'count_drop' END
             WHEN name = 'partial' THEN CASE WHEN current > baseline THEN 'increase' END WHEN current IS NULL THEN 'missing'
             WHEN name = 'event_f1' AND baseline - current > 10 + 1e-7 THEN 'drop' WHEN name = 'transcript_empty_ratio' AND current - baseline > 1e-7 THEN 'increase' END AS reason FROM j)
        SELECT session_id, name, {rnd("baseline")} AS baseline, {rnd("current")} AS current, {rnd("threshold")} AS threshold, reason FROM r WHERE reason IS NOT NULL
        UNION ALL SELECT DISTINCT session_id, 'session', NULL, NULL, NULL, 'missing_session' FROM b WHERE session_id NOT IN (SELECT session_id FROM c)""",
)
def _(spark, sf):
    baseline, current = order_metrics(spark, sf)
    return evaluation.compare_to_baseline(current, baseline, {"event_f1": 10.0})


# --- audits -----------------------------------------------------------------


def latencies(spark, sf):
    """Line items as latency records of one session per supplier."""
    li = adapters.table(spark, sf, "lineitem")
    sid = F.col("l_suppkey").cast("string").alias("session_id")
    return li.select(sid, (F.col("l_quantity") * 10 - 50).cast("long").alias("ms"), F.when(F.col("l_linestatus") == "O", " Final ").when(F.col("l_returnflag") == "A", "").otherwise(F.col("l_returnflag")).alias("status"))


@register(
    "latency_summary",
    f"""WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, CASE WHEN l_quantity * 10 - 50 > 0 THEN CAST(l_quantity * 10 - 50 AS BIGINT) END AS v FROM lineitem)
        SELECT session_id, count(v) AS available_count, count(*) - count(v) AS missing_count, min(v) AS min, max(v) AS max, {r4("avg(v)")} AS average,
          CAST(quantile_disc(v, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(v, 0.95) AS DOUBLE) AS p95 FROM x GROUP BY 1""",
)
def _(spark, sf):
    return proof.latency_summary(latencies(spark, sf), "ms", positive_only=True)


@register(
    "status_counts",
    """WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_id, CASE WHEN l_linestatus = 'O' THEN 'final' WHEN l_returnflag = 'A' THEN 'missing' ELSE lower(l_returnflag) END AS status FROM lineitem)
       SELECT session_id, status, count(*) AS n FROM x GROUP BY ALL""",
)
def _(spark, sf):
    return proof.status_counts(latencies(spark, sf), "status").select("session_id", F.explode("status_counts").alias("status", "n"))


SESS = """sess AS (SELECT session_id, count(*) FILTER (message_count > 2) + 5 AS rec_chat, 10 AS rec_t, 0 AS rec_a, min(bucket_start) AS started_at, CAST(NULL AS TIMESTAMP) AS ended_at FROM buckets GROUP BY 1)"""


def sessions(buckets):
    return buckets.groupBy("session_id").agg(
        F.min("channel_id").alias("channel_id"),
        (F.count_if(F.col("message_count") > 2) + 5).alias("chat_bucket_count"),
        F.lit(10).cast("long").alias("transcript_bucket_count"),
        F.lit(0).cast("long").alias("alignment_count"),
        F.min("bucket_start").alias("started_at"),
        F.lit(None).cast("timestamp").alias("ended_at"),
    )


def aligned(spark, sf):
    return alignment.align(chat(spark, sf), speech(spark, sf), HOUR)


def stored(spark, sf):
    """Chat buckets, transcript buckets and alignments as tables, for queries that read them several times."""
    c, t = settle(chat(spark, sf), "chat"), settle(speech(spark, sf), "speech")
    return c, t, settle(alignment.align(c, t, HOUR), "aligned")


CNT = """cc AS (SELECT session_id, count(*) AS n FROM buckets GROUP BY 1), ct AS (SELECT session_id, count(*) AS n FROM tbuckets GROUP BY 1), ca AS (SELECT session_id, count(*) AS n FROM al GROUP BY 1),
cl AS (SELECT session_id, count(*) AS n FROM (SELECT DISTINCT session_id, label_start, label_end FROM lab) GROUP BY 1)"""


@register(
    "session_totals",
    f"""WITH {ALIGN}, {LABELS}, {SESS}, {CNT} SELECT s.session_id, greatest(rec_chat, cc.n) AS chat_bucket_count, greatest(rec_t, ct.n) AS transcript_bucket_count, greatest(rec_a, ca.n) AS alignment_count,
        cl.n AS signal_window_label_count, greatest(rec_chat, cc.n) + greatest(rec_t, ct.n) + greatest(rec_a, ca.n) AS bucket_count, CAST(cc.n < rec_chat OR ct.n < rec_t AS BIGINT) AS partial
        FROM sess s JOIN cc USING (session_id) JOIN ct USING (session_id) JOIN ca USING (session_id) JOIN cl USING (session_id)""",
)
def _(spark, sf):
    c, t, al = stored(spark, sf)
    out = proof.session_totals(sessions(c), c, t, al, window_labels(c))
    return out.select("session_id", "chat_bucket_count", "transcript_bucket_count", "alignment_count", "signal_window_label_count", "bucket_count", "partial")


@register(
    "session_history",
    f"""WITH {ALIGN}, {LABELS}, {SESS}, {CNT} SELECT s.session_id, cc.n AS chat_bucket_count, ct.n AS transcript_bucket_count, ca.n AS alignment_count,
        (SELECT count(*) FROM lab WHERE lab.session_id = s.session_id) AS label_count
        FROM sess s LEFT JOIN cc USING (session_id) LEFT JOIN ct USING (session_id) LEFT JOIN ca USING (session_id)""",
)
def _(spark, sf):
    c, t, al = stored(spark, sf)
    out = proof.session_history(sessions(c), c, t, al, window_labels(c))
    return out.select("session_id", "chat_bucket_count", "transcript_bucket_count", "alignment_count", "label_count")


@register(
    "timeline_bounds",
    f"""WITH {ALIGN}, {SESS}, t AS (SELECT session_id, bucket_start AS x FROM buckets UNION ALL SELECT session_id, bucket_end FROM buckets UNION ALL SELECT session_id, bucket_start FROM tbuckets
          UNION ALL SELECT session_id, bucket_end FROM tbuckets)
        SELECT session_id, {us}(min(x)) AS timeline_start, {us}(max(x)) AS timeline_end, CAST(floor((epoch_us(max(x)) - epoch_us(min(x))) / 1000) AS BIGINT) AS source_duration_ms FROM t GROUP BY 1""",
)
def _(spark, sf):
    c, t, al = stored(spark, sf)
    return proof.timeline_bounds(sessions(c), c, t, al)


KEYS = """wk AS (SELECT session_id, bucket_start AS s, bucket_end AS e FROM buckets UNION SELECT session_id, window_start, window_end FROM al)"""


@register(
    "distinct_windows",
    f"""WITH {ALIGN}, {KEYS} SELECT session_id, (SELECT count(*) FROM wk WHERE wk.session_id = x.session_id) AS signal_window_count, count(*) AS matched_windows
        FROM (SELECT DISTINCT session_id, channel_id, window_start, window_end, chat_bucket_start, transcript_bucket_start FROM al) x GROUP BY session_id""",
)
def _(spark, sf):
    c, _, al = stored(spark, sf)
    return proof.distinct_windows(c, al)


@register(
    "label_coverage",
    f"""WITH {ALIGN}, {LABELS}, {KEYS}, lk AS (SELECT DISTINCT session_id, label_start AS s, label_end AS e FROM lab),
        j AS (SELECT coalesce(wk.session_id, lk.session_id) AS session_id, wk.s IS NOT NULL AS w, lk.s IS NOT NULL AS l FROM wk FULL JOIN lk ON wk.session_id = lk.session_id AND wk.s = lk.s AND wk.e = lk.e)
        SELECT session_id, count(*) FILTER (w AND l) AS labeled_windows, count(*) FILTER (l AND NOT w) AS unmatched_labels, count(*) FILTER (w) AS total_windows, count(*) FILTER (l) AS stored_label_count,
          {r4("count(*) FILTER (w AND l) / nullif(count(*) FILTER (w), 0)")} AS label_coverage FROM j GROUP BY 1""",
)
def _(spark, sf):
    c, _, al = stored(spark, sf)
    return proof.label_coverage(c, al, window_labels(c))


def stored_speech(t):
    """Transcript buckets with the completeness fields a store would hold."""
    n = F.col("segment_count")
    quality = F.to_json(F.struct(F.when(n % 5 == 0, "completed").alias("repair_status"), F.when(n % 5 == 0, 0.0).alias("repair_changed_ratio")))
    return t.withColumns(
        {
            # whole seconds: sums of them cannot fall between two roundings
            "audio_started_at": F.date_trunc("second", "audio_started_at"),
            "audio_ended_at": F.date_trunc("second", "audio_ended_at"),
            "audio_seconds": F.when(n % 2 == 0, F.col("asr_latency_ms") * 3.0).otherwise(0.0),
            "word_count": F.when(n % 3 == 0, n * 2).otherwise(F.lit(0)),
            "empty_ratio": F.col("transcript_confidence") / 2,
            "repair_added_words": F.when(n % 4 == 0, F.lit(1)).otherwise(F.lit(0)),
            "repair_changed_ratio": F.when(n % 4 == 0, F.col("transcript_confidence")).otherwise(0.0),
            "quality": quality,
            "transcript_status": F.when(n % 3 == 0, "").otherwise("final"),
            "sentiment_status": F.lit(" Local"),
            "sentiment_latency_ms": F.col("asr_latency_ms") + n,
            "pipeline_latency_ms": F.when(n % 2 == 0, F.col("asr_latency_ms") * 2),
        }
    )


COVER = """tc AS (SELECT *, CASE WHEN segment_count % 2 = 0 AND asr_latency_ms > 0 THEN asr_latency_ms * 3.0 ELSE (epoch_us(date_trunc('second', audio_ended_at)) - epoch_us(date_trunc('second', audio_started_at))) / 1e6 END AS audio,
   segment_count * 2 AS words, CASE WHEN segment_count % 4 = 0 THEN 1 ELSE 0 END AS added, CASE WHEN segment_count % 4 = 0 THEN transcript_confidence ELSE 0.0 END AS changed,
   transcript_confidence / 2 AS er FROM tbuckets)"""


@register(
    "transcript_coverage",
    f"""WITH {TBUCKETS}, {COVER}, a AS (SELECT session_id, count(*) AS bucket_count, sum(audio) AS audio, count(*) * 3600.0 AS expected, CAST(sum(segment_count) AS BIGINT) AS segment_count,
            CAST(sum(words) AS BIGINT) AS word_count, CAST(sum(added) AS BIGINT) AS repair_added_words, {half_away("sum(er * audio) / sum(audio)", 4)} AS empty_ratio,
            {half_away("avg(CASE WHEN segment_count % 4 = 0 OR segment_count % 5 = 0 THEN changed END)", 4)} AS rc FROM tc GROUP BY 1)
        SELECT session_id, bucket_count, {r4("audio")} AS audio_seconds, {r4("expected")} AS expected_audio_seconds, segment_count, word_count, repair_added_words, {rnd("empty_ratio")} AS empty_ratio,
          {rnd("rc")} AS average_repair_changed_ratio, {r4("audio / expected")} AS audio_coverage, {r4("greatest(CASE WHEN repair_added_words > 0 THEN repair_added_words / word_count END, rc)")} AS repair_improvement FROM a""",
)
def _(spark, sf):
    return proof.transcript_coverage(stored_speech(speech(spark, sf)))


@register(
    "transcript_status_counts",
    f"""WITH {TBUCKETS}, s AS (SELECT session_id, CASE WHEN segment_count % 3 <> 0 THEN 'final' WHEN segment_count % 5 = 0 THEN 'final' ELSE 'local' END AS status FROM tbuckets)
        SELECT session_id, status, count(*) AS n FROM s GROUP BY ALL""",
)
def _(spark, sf):
    return proof.transcript_status_counts(stored_speech(speech(spark, sf))).select("session_id", F.explode("transcript_status_counts").alias("status", "n"))


@register(
    "reaction_and_peak_counts",
    f"""WITH {ALIGN} SELECT session_id, CAST(sum(unique_chatters) AS BIGINT) AS reaction_window_count, count(*) FILTER (message_count > 5 OR positive > 0.5) AS peak_reaction_count FROM buckets GROUP BY 1""",
)
def _(spark, sf):
    b = chat(spark, sf).withColumns(
        {
            "subwindows": F.array_repeat(F.lit(1), F.col("unique_chatters").cast("int")),
            "peak_reaction_score": F.when(F.col("message_count") > 5, 0.5),
            "peak_window_start": F.lit(None).cast("timestamp"),
            "peak_reaction_type": F.when(F.col("positive") > 0.5, "hype").otherwise(""),
            "peak_evidence_messages": F.lit(None).cast("array<string>"),
        }
    )
    return proof.reaction_and_peak_counts(b)


@register(
    "replay_speeds",
    f"""WITH {ALIGN}, t AS (SELECT session_id, CAST(floor((epoch_us(max(bucket_end)) - epoch_us(min(bucket_start))) / 1000) AS BIGINT) AS ms, count(*) AS n, CAST(sum(message_count) AS BIGINT) AS w FROM buckets GROUP BY 1),
        s(speed) AS (VALUES (CAST(1 AS DOUBLE)), (2.5), (10)), x AS (SELECT *, ceil(ms / speed) AS est FROM t, s)
        SELECT session_id, speed, CAST(est AS BIGINT) AS estimated_replay_duration_ms, {r4("est / 1000")} AS estimated_replay_seconds, {r4("w / (est / 1000)")} AS windows_per_second, {r4("n / (est / 1000)")} AS buckets_per_second FROM x""",
)
def _(spark, sf):
    totals = chat(spark, sf).groupBy("session_id").agg(
        F.floor((F.unix_micros(F.max("bucket_end")) - F.unix_micros(F.min("bucket_start"))) / 1000).alias("source_duration_ms"),
        F.count("*").alias("bucket_count"),
        F.sum("message_count").alias("signal_window_count"),
    )
    return proof.replay_speeds(totals, (10, 1, 2.5, 1))


def _map_sql(status: str, rows: str, out: str) -> str:
    """Counts of a status per session, as the text of a sorted map."""
    return f"""SELECT session_id, '{{' || string_agg('"' || v || '":' || CAST(n AS VARCHAR), ',' ORDER BY v) || '}}' AS {out}
      FROM (SELECT session_id, {status} AS v, count(*) AS n FROM {rows} GROUP BY ALL) GROUP BY session_id"""


LATENCY_FIELDS = ("available_count", "missing_count", "min", "max", "average", "p50", "p95")


def _latency_sql(name: str, value: str, rows: str) -> str:
    figures = ("count(v)", "count(*) - count(v)", "min(v)", "max(v)", r4("avg(v)"), "CAST(quantile_disc(v, 0.5) AS DOUBLE)", "CAST(quantile_disc(v, 0.95) AS DOUBLE)")
    columns = ", ".join(f"{f} AS {name}_{c}" for f, c in zip(figures, LATENCY_FIELDS, strict=True))
    return f"SELECT session_id, {columns} FROM (SELECT session_id, {value} AS v FROM {rows}) GROUP BY 1"


_COVERAGE = ("audio_seconds", "expected_audio_seconds", "segment_count", "word_count", "repair_added_words", "empty_ratio", "average_repair_changed_ratio", "audio_coverage", "repair_improvement")
_LATENCY_SQL = {
    "chat_analysis": ("message_count * 7", "buckets"), "transcript_sentiment": ("asr_latency_ms + segment_count", "tbuckets"), "transcript_asr": ("asr_latency_ms", "tbuckets"),
    "transcript_pipeline": ("CASE WHEN segment_count % 2 = 0 THEN asr_latency_ms * 2 END", "tbuckets"),
}
# The audit of each session, from the SQL of its parts.
PROOF = f"""{ALIGN}, {SESS}, {CNT.split(", ca AS")[0]}, ca AS (SELECT session_id, count(*) AS n FROM al GROUP BY 1),
ch AS (SELECT session_id, min(channel_id) AS channel_id FROM buckets GROUP BY 1),
p1 AS ({ORACLES["session_totals"]}), p2 AS ({ORACLES["timeline_bounds"]}), p3 AS ({ORACLES["distinct_windows"]}), p4 AS ({ORACLES["label_coverage"]}), p5 AS ({ORACLES["transcript_coverage"]}),
p6 AS ({_map_sql("CASE WHEN segment_count % 3 <> 0 THEN 'final' WHEN segment_count % 5 = 0 THEN 'final' ELSE 'local' END", "tbuckets", "transcript_status_counts")}),
p7 AS ({_map_sql("'python'", "buckets", "chat_analysis_status_counts")}), p8 AS ({_map_sql("'local'", "tbuckets", "transcript_sentiment_status_counts")}),
{", ".join(f"q{i} AS ({_latency_sql(n, *x)})" for i, (n, x) in enumerate(_LATENCY_SQL.items()))},
pf AS (SELECT s.session_id, ch.channel_id, p1.* EXCLUDE (session_id), cc.n AS loaded_chat_bucket_count, ct.n AS loaded_transcript_bucket_count, ca.n AS loaded_alignment_count,
         p1.chat_bucket_count + p1.transcript_bucket_count AS source_bucket_count,
         concat_ws('|', CASE WHEN cc.n < rec_chat THEN 'chat_buckets:' || cc.n || ':' || rec_chat END, CASE WHEN ct.n < rec_t THEN 'transcript_buckets:' || ct.n || ':' || rec_t END) AS truncated_sources,
         p2.* EXCLUDE (session_id), p3.* EXCLUDE (session_id), p4.* EXCLUDE (session_id, total_windows),
         {", ".join(f"p5.{c} AS transcript_{c}" for c in _COVERAGE)}, transcript_status_counts, chat_analysis_status_counts, transcript_sentiment_status_counts,
         {", ".join(f"q{i}.* EXCLUDE (session_id)" for i in range(len(_LATENCY_SQL)))}
       FROM sess s JOIN ch USING (session_id) JOIN cc USING (session_id) JOIN ct USING (session_id) JOIN ca USING (session_id) {" ".join(f"JOIN p{i} USING (session_id)" for i in range(1, 9))}
       {" ".join(f"JOIN q{i} USING (session_id)" for i in range(len(_LATENCY_SQL)))})"""


def audited_chat(buckets):
    return buckets.withColumns({"analysis_latency_ms": F.col("message_count") * 7, "analysis_status": F.lit("python")})


@register("session_proof", f"WITH {PROOF} SELECT * FROM pf")
def _(spark, sf):
    b, t, al = stored(spark, sf)
    found = proof.session_proof(sessions(b), audited_chat(b), stored_speech(t), al, window_labels(b)).drop("reaction_window_count", "peak_reaction_count")
    latency = {f"{n}_{c}": F.col(f"{n}_latency.{c}") for n in proof.LATENCIES for c in LATENCY_FIELDS}
    short = F.transform("truncated_sources", lambda x: F.concat_ws(":", x["source"], x["loaded_count"].cast("string"), x["total_count"].cast("string")))
    return found.withColumns({"truncated_sources": short, **latency}).drop(*[f"{n}_latency" for n in proof.LATENCIES])


# The report joins the audit with the evaluation against the human labels.
REPORT = f"""{PROOF}, hw AS (SELECT session_id, bucket_start AS s, bucket_end AS e FROM buckets UNION SELECT session_id, window_start, window_end FROM al),
hk AS (SELECT DISTINCT session_id, window_start AS s, window_end AS e FROM (WITH {BUCKETS}, {HLABELS} SELECT * FROM hl)),
hc AS (SELECT session_id, {r4("count(*) FILTER (hk.s IS NOT NULL) / count(*)")} AS proof_label_coverage FROM hw LEFT JOIN hk USING (session_id, s, e) GROUP BY 1),
e1 AS ({ORACLES["session_evaluation"]}), e2 AS ({ORACLES["peak_recall"]}), e3 AS ({ORACLES["onset_latency"]}),
e4 AS (WITH {EVW}, rr AS (SELECT session_id, ra AS actual, rp AS predicted FROM ev WHERE ra <> ''), keys AS (SELECT session_id, actual AS label FROM rr UNION SELECT session_id, predicted FROM rr),
       cls AS (SELECT k.session_id, k.label, count(*) FILTER (actual = k.label AND predicted = k.label) AS tp, count(*) FILTER (predicted = k.label AND actual <> k.label) AS fp,
                 count(*) FILTER (actual = k.label AND predicted <> k.label) AS fn FROM keys k JOIN rr USING (session_id) GROUP BY ALL), m AS (SELECT session_id, {F1} AS f1 FROM ({PRF} cls))
       SELECT session_id, {r4("avg(f1)")} AS reaction_type_f1 FROM m GROUP BY 1)"""


@register(
    "session_report",
    f"""WITH {REPORT} SELECT pf.session_id, channel_id, proof_label_coverage, e1.coverage AS evaluation_coverage, event_accuracy, event_precision, event_recall, event_f1, peak_recall, hype_peak_recall,
        onset_latency_ms, reaction_type_accuracy, reaction_type_f1, target_accuracy, target_accuracy AS target_extraction_accuracy, divergence_accuracy, false_positives_normal_chat, e1.total_windows,
        total_labeled_windows, evaluated_windows, e1.unmatched_labels, uncertain_labels, invalid_labels, 0 AS reaction_window_count,
        (SELECT count(*) FROM buckets b WHERE b.session_id = pf.session_id AND b.message_count > 5) AS peak_reaction_count,
        {r4("loaded_transcript_bucket_count / 10")} AS transcript_bucket_coverage, transcript_audio_coverage AS transcript_coverage, transcript_audio_coverage, transcript_empty_ratio, transcript_word_count,
        transcript_repair_added_words, transcript_average_repair_changed_ratio AS transcript_repair_changed_ratio, transcript_repair_improvement, loaded_alignment_count AS alignment_count,
        matched_windows AS matched_window_count, 2 AS persistence_metric_count, CAST(NULL AS DOUBLE) AS storage_write_failures, CAST(NULL AS DOUBLE) AS storage_dropped_writes, CAST(0.5 AS DOUBLE) AS storage_queue_depth, CAST(NULL AS DOUBLE) AS reaction_window_metric_count,
        CASE WHEN truncated_sources = '' THEN 0 ELSE len(string_split(truncated_sources, '|')) END AS truncated_source_count, partial,
        {", ".join(f'{n}_p95 AS "latency_p95_ms.{n}"' for n in ("chat_analysis", "transcript_asr", "transcript_pipeline", "transcript_sentiment"))}
        FROM pf JOIN hc USING (session_id) JOIN e1 USING (session_id) LEFT JOIN e2 USING (session_id) LEFT JOIN e3 USING (session_id) LEFT JOIN e4 USING (session_id)""",
)
def _(spark, sf):
    from crowdtide.plans import reports

    b, t, al = stored(spark, sf)
    c = chat_with_subwindows(audited_chat(b)).withColumns(
        {
            "peak_reaction_score": F.when(F.col("message_count") > 5, 0.5),
            "peak_window_start": F.lit(None).cast("timestamp"),
            "peak_reaction_type": F.lit(""),
            "peak_evidence_messages": F.lit(None).cast("array<struct<message_id:string,text:string>>"),
        }
    )
    sess = sessions(b)
    # an older depth and a newer one
    depths = F.explode(F.array(*[F.struct((F.col("started_at") + F.expr(f"INTERVAL {i} HOURS")).alias("recorded_at"), F.lit(v).alias("value")) for i, v in ((2, 0.5), (1, 9.0))]))
    metrics = sess.select("session_id", F.lit("storage.queue_depth").alias("name"), depths.alias("d")).select("session_id", "name", "d.*")
    return reports.session_report(sess, c, stored_speech(t), al, human_labels(b), metrics, HOUR)


_REPLAY = {"audio_coverage": "transcript_audio_coverage", "empty_ratio": "transcript_empty_ratio", "word_count": "transcript_word_count"}


@register(
    "proof_to_metrics",
    f"""WITH {TBUCKETS}, {COVER}, a AS (SELECT session_id, count(*) AS n, {half_away("sum(audio) / (count(*) * 3600.0)", 4)} AS v1, {half_away("sum(er * audio) / sum(audio)", 4)} AS v2, CAST(sum(words) AS DOUBLE) AS v3 FROM tc GROUP BY 1),
        x AS (SELECT session_id, speed, n, ceil(n * 3600000 / speed) / 1000.0 AS seconds FROM a, (VALUES (1.0), (5.0), (10.0)) s(speed)),
        m AS (SELECT session_id, 'transcript_audio_coverage' AS name, v1 AS value, 'ratio' AS unit, NULL AS speed FROM a
          UNION ALL SELECT session_id, 'transcript_empty_ratio', v2, 'ratio', NULL FROM a UNION ALL SELECT session_id, 'transcript_word_count', v3, 'words', NULL FROM a
          UNION ALL SELECT session_id, 'bucket_count', n * 3, 'buckets', NULL FROM a UNION ALL SELECT session_id, 'source_bucket_count', n * 2, 'buckets', NULL FROM a
          UNION ALL SELECT session_id, 'signal_window_count', n, 'windows', NULL FROM a
          UNION ALL SELECT session_id, 'estimated_replay_seconds', {half_away("seconds", 4)}, 'seconds', speed FROM x
          UNION ALL SELECT session_id, 'windows_per_second', {half_away("n / seconds", 4)}, 'windows/s', speed FROM x)
        SELECT session_id, 'replay_proof.' || name AS name, {rnd("value")} AS value, unit, {rnd("speed")} AS speed FROM m""",
)
def _(spark, sf):
    """A proof table of the speech side; figures it has no source for are absent, and so are their metrics."""
    t = stored_speech(speech(spark, sf))
    counts = t.groupBy("session_id").agg(F.count("*").alias("n"))
    wide = proof.transcript_coverage(t).select("session_id", *[F.col(c).alias(name) for c, name in _REPLAY.items()]).join(counts, "session_id")
    given = {c: F.col("n") for c in ("loaded_chat_bucket_count", "loaded_transcript_bucket_count", "loaded_alignment_count", "signal_window_count")}
    wide = wide.withColumns({**given, "source_duration_ms": F.col("n") * HOUR * 1000})
    used = {c.split(".")[0]: F.lit(None).cast("struct<average:double>" if "." in c else "double") for _, c, _ in proof.PROOF_METRICS}
    absent = {c: v for c, v in used.items() if c not in wide.columns and c not in ("loaded_total", "loaded_source")}
    return proof.proof_to_metrics(wide.withColumns(absent)).select("session_id", "name", "value", "unit", "speed")


@register(
    "latest_metric",
    f"""SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderpriority AS name, {rnd("arg_max(o_totalprice, (o_orderdate, o_totalprice))")} AS value FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    o = adapters.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("recorded_at")
    )
    return proof.latest_metric(o)


@register(
    "recent_sessions",
    f"""WITH s AS (SELECT o_custkey AS k, max(o_orderdate) AS started_at FROM orders GROUP BY 1) SELECT CAST(k AS VARCHAR) AS session_id, {us}(started_at) AS started_at FROM s ORDER BY s.started_at DESC, CAST(k AS VARCHAR) LIMIT 25""",
)
def _(spark, sf):
    o = adapters.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("session_id")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("started_at"))
    return proof.recent_sessions(o, 25)


@register(
    "scan_session_tables",
    f"""WITH {ALIGN}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY bucket_start DESC, channel_id) AS rn FROM buckets)
        SELECT session_id, channel_id, {us}(bucket_start) AS bucket_start, message_count FROM r WHERE rn <= 5""",
)
def _(spark, sf):
    return proof.first_n(chat(spark, sf), "bucket_start", 5, newest=True).select(*STREAM, "bucket_start", "message_count")


# --- correlation ------------------------------------------------------------

PAIRS = f"""{ALIGN}, {LABELS}, c AS (SELECT a.session_id, a.channel_id, a.window_start, a.window_end, lower(trim(event_label)) AS l, label_start, label_end
          FROM al a JOIN lab ON lab.session_id = a.session_id AND a.window_start < label_end AND label_start < a.window_end AND trim(event_label) <> ''),
lr AS (SELECT *, row_number() OVER (PARTITION BY session_id, channel_id, window_start, window_end ORDER BY l = 'none', label_start, label_end, l) AS rn FROM c),
pr0 AS (SELECT a.* REPLACE ({rnd("a.chat_sentiment")} AS chat_sentiment, {rnd("a.transcript_sentiment")} AS transcript_sentiment), coalesce(r.l, '') AS label, a.relationship = 'diverged' OR abs(a.delta) >= 0.45 AS dd FROM al a LEFT JOIN lr r ON r.session_id = a.session_id AND r.channel_id = a.channel_id
          AND r.window_start = a.window_start AND r.window_end = a.window_end AND rn = 1),
pr AS (SELECT *, label NOT IN ('', 'none') AS le, NOT dd AND label IN ('', 'none') AND quality >= 0.5 AND chat_message_count >= 5 AND len >= 40 AS calm, abs(delta) AS ad FROM pr0),
co AS (SELECT *, 'all_aligned' AS cohort FROM pr UNION ALL SELECT *, 'calm_baseline' FROM pr WHERE calm UNION ALL SELECT *, 'detected_divergence' FROM pr WHERE dd
       UNION ALL SELECT *, 'labeled_events' FROM pr WHERE le UNION ALL SELECT *, 'labeled_none' FROM pr WHERE label = 'none')"""

CFG = correlation.CohortConfig(minimum_quality=0.5)


def pairs(spark, sf):
    """Stored pairs. Scores are cut to nine digits, so that equal means tie whatever the summation order was."""
    c = settle(chat(spark, sf), "chat")
    al = alignment.align(c, speech(spark, sf), HOUR)
    out = correlation.sentiment_pairs(al, window_labels(c), CFG, HOUR)
    return settle(out.withColumns({x: rounded(F.col(x)) for x in ("chat_sentiment", "transcript_sentiment")}), "pairs")


def _rank(keys: str, v: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    tie = f"PARTITION BY {keys + ', ' if keys else ''}{v}"
    return f"(rank() OVER ({part} ORDER BY {v}) + (count(*) OVER ({tie}) - 1) / 2)"


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _counts(keys: str, value: str) -> str:
    """Counts of the non-empty values as the text of a sorted map."""
    return f"""SELECT {keys}, '{{' || string_agg('"' || v || '":' || CAST(n AS VARCHAR), ',' ORDER BY v) || '}}' AS {value}_counts
      FROM (SELECT {keys}, {value} AS v, count(*) AS n FROM co WHERE coalesce({value}, '') <> '' GROUP BY ALL) GROUP BY {keys}"""


CORR = f"""rk AS (SELECT *, {_rank("cohort", "chat_sentiment")} AS rx, {_rank("cohort", "transcript_sentiment")} AS ry FROM co),
cs AS (SELECT cohort, count(*) AS pair_count, {half_away(_corr("chat_sentiment", "transcript_sentiment"), 4)} AS p, {half_away(_corr("rx", "ry"), 4)} AS s, {half_away("avg(chat_sentiment)", 4)} AS mc,
         {half_away("avg(transcript_sentiment)", 4)} AS mt, {half_away("avg(delta)", 4)} AS md, {half_away("avg(ad)", 4)} AS mad, {half_away("avg(quality)", 4)} AS mq,
         {half_away("quantile_cont(ad, 0.5)", 4)} AS q50, {half_away("quantile_cont(ad, 0.9)", 4)} AS q90, {half_away("quantile_cont(ad, 0.95)", 4)} AS q95 FROM rk GROUP BY 1)"""


@register(
    "cohort_summary",
    f"""WITH {PAIRS}, {CORR}, every(cohort) AS (VALUES ('all_aligned'), ('calm_baseline'), ('detected_divergence'), ('labeled_events'), ('labeled_none'))
        SELECT cohort, coalesce(pair_count, 0) AS pair_count, {rnd("CASE WHEN pair_count >= 3 THEN p END")} AS pearson, {rnd("CASE WHEN pair_count >= 3 THEN s END")} AS spearman, {rnd("mc")} AS mean_chat_sentiment, {rnd("mt")} AS mean_transcript_sentiment, {rnd("md")} AS average_delta,
        {rnd("mad")} AS average_abs_delta, {rnd("mq")} AS average_quality, {rnd("q50")} AS abs_delta_median, {rnd("q90")} AS abs_delta_p90, {rnd("q95")} AS abs_delta_p95,
        CASE WHEN coalesce(pair_count, 0) < 3 THEN 'insufficient_pairs' WHEN p IS NULL OR s IS NULL THEN 'constant_series' ELSE 'computed' END AS correlation_status, relationship_counts, label_counts
        FROM every LEFT JOIN cs USING (cohort) LEFT JOIN ({_counts("cohort", "relationship")}) USING (cohort) LEFT JOIN ({_counts("cohort", "label")}) USING (cohort)""",
)
def _(spark, sf):
    return correlation.cohort_summary(pairs(spark, sf), (), CFG)


@register(
    "cohort_summary_by_session",
    f"""WITH {PAIRS}, every AS (SELECT DISTINCT session_id, unnest(['all_aligned', 'calm_baseline', 'detected_divergence', 'labeled_events', 'labeled_none']) AS cohort FROM pr),
        g AS (SELECT session_id, cohort, count(*) AS n, {r4("quantile_cont(ad, 0.9)")} AS p90, {r4("avg(delta)")} AS ad FROM co GROUP BY ALL)
        SELECT session_id, cohort, coalesce(n, 0) AS pair_count, p90 AS abs_delta_p90, g.ad AS average_delta, label_counts FROM every LEFT JOIN g USING (session_id, cohort) LEFT JOIN ({_counts("session_id, cohort", "label")}) USING (session_id, cohort)""",
)
def _(spark, sf):
    out = correlation.cohort_summary(pairs(spark, sf), ("session_id",), CFG)
    return out.select("session_id", "cohort", "pair_count", "abs_delta_p90", "average_delta", "label_counts")


@register(
    "pearson",
    f"""WITH {ALIGN} SELECT session_id, {rnd(_corr("chat_sentiment", "transcript_sentiment"))} AS pearson, {rnd("covar_pop(delta, 1.0) / nullif(0.0, 0)")} AS constant FROM al GROUP BY 1""",
)
def _(spark, sf):
    al = aligned(spark, sf).withColumn("one", F.lit(1.0))
    return al.groupBy("session_id").agg(correlation.pearson("chat_sentiment", "transcript_sentiment").alias("pearson"), correlation.pearson("delta", "one").alias("constant"))


@register(
    "average_rank",
    f"SELECT l_orderkey, l_linenumber, CAST({_rank('l_returnflag', 'l_quantity')} AS DOUBLE) AS rank FROM lineitem",
)
def _(spark, sf):
    from crowdtide.operators.ranks import average_rank

    li = adapters.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return average_rank(li, ["l_returnflag"], "l_quantity", "rank", slice_width=5).select("l_orderkey", "l_linenumber", "rank")


@register(
    "spearman",
    f"""WITH r AS (SELECT l_returnflag, {_rank("l_returnflag", "l_quantity")} AS rx, {_rank("l_returnflag", "l_extendedprice")} AS ry FROM lineitem) SELECT l_returnflag, {rnd(half_away(_corr("rx", "ry"), 4))} AS spearman FROM r GROUP BY 1""",
)
def _(spark, sf):
    from crowdtide.operators.ranks import average_ranks

    li = adapters.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    ranked = average_ranks(li, ["l_returnflag"], {"l_quantity": "rx", "l_extendedprice": "ry"}, {"l_quantity": 5, "l_extendedprice": 1000})
    return ranked.groupBy("l_returnflag").agg(correlation.r4(correlation.pearson("rx", "ry")).alias("spearman"))


@register(
    "quantiles",
    f"""SELECT l_returnflag, {rnd("quantile_cont(l_extendedprice, 0.5)")} AS p50, {rnd("quantile_cont(l_extendedprice, 0.95)")} AS p95, {rnd("min(l_extendedprice)")} AS p0 FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    from crowdtide.operators.ranks import quantiles

    li = adapters.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return quantiles(li, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p0": 0.0}, slice_width=1000)


@register(
    "compare_cohorts",
    f"""WITH {PAIRS}, {CORR}, x AS (SELECT a.p - b.p AS dp, a.s - b.s AS ds, b.mad - a.mad AS dd FROM cs a, cs b WHERE a.cohort = 'calm_baseline' AND b.cohort = 'detected_divergence')
        SELECT {r4("dp")} AS pearson_drop_from_baseline, {r4("ds")} AS spearman_drop_from_baseline, {r4("dd")} AS average_abs_delta_change, 'computed' AS status FROM x""",
)
def _(spark, sf):
    return correlation.compare_cohorts(correlation.cohort_summary(pairs(spark, sf), (), CFG))


@register(
    "calibrate_threshold",
    f"""WITH {PAIRS}, q AS (SELECT quantile_cont(ad, 0.5) AS m, quantile_cont(ad, 0.9) AS p90, quantile_cont(ad, 0.95) AS p95 FROM pr WHERE calm),
        a AS (SELECT count(*) FILTER (calm) AS nb, count(*) FILTER (dd) AS nd, count(*) FILTER (dd AND ad > p95) AS above, any_value(m) AS m, any_value(p90) AS p90, any_value(p95) AS p95 FROM pr, q)
        SELECT 'computed' AS status, nb AS baseline_pair_count, nd AS detected_divergence_pair_count, 0.45::DOUBLE AS current_threshold, {r4("p95")} AS recommended_threshold, {r4("m")} AS baseline_abs_delta_median,
          {r4("p90")} AS baseline_abs_delta_p90, {r4("p95")} AS baseline_abs_delta_p95, above AS detected_above_baseline_p95, {r4("above / nd")} AS detected_above_baseline_p95_rate,
          CASE WHEN 0.45 < p90 THEN 'current_threshold_below_baseline_p90' WHEN 0.45 > p95 * 1.5 AND p95 > 0 THEN 'current_threshold_much_higher_than_baseline_p95' ELSE 'current_threshold_near_baseline_tail' END AS threshold_assessment FROM a""",
)
def _(spark, sf):
    return correlation.calibrate_threshold(pairs(spark, sf), (), CFG)


LAGP = f"""lagp AS (SELECT CAST(l AS BIGINT) AS lag_seconds, {rnd("a.chat_sentiment")} AS x, {rnd("b.sentiment_score")} AS y FROM buckets a, (VALUES (-3600), (0), (3600)) g(l), tbuckets b WHERE a.session_id = b.session_id AND a.channel_id = b.channel_id
  AND epoch_us(least(a.bucket_end + to_seconds(l), b.bucket_end)) - epoch_us(greatest(a.bucket_start + to_seconds(l), b.bucket_start)) >= 1800e6)"""


@register(
    "lag_summary",
    f"""WITH {ALIGN}, {LAGP}, r AS (SELECT *, {_rank("lag_seconds", "x")} AS rx, {_rank("lag_seconds", "y")} AS ry FROM lagp),
        s AS (SELECT lag_seconds, count(*) AS pair_count, {half_away("avg(abs(x - y))", 4)} AS ad, {half_away(_corr("x", "y"), 4)} AS p, {half_away(_corr("rx", "ry"), 4)} AS sp FROM r GROUP BY 1)
        SELECT lag_seconds, pair_count, {rnd("ad")} AS average_abs_delta, {rnd("p")} AS pearson, {rnd("sp")} AS spearman, CAST(row_number() OVER (ORDER BY abs(p) DESC, lag_seconds) = 1 AS BIGINT) AS best,
          CASE WHEN pair_count < 3 THEN 'insufficient_pairs' WHEN p IS NULL OR sp IS NULL THEN 'constant_series' ELSE 'computed' END AS correlation_status FROM s""",
)
def _(spark, sf):
    c = chat(spark, sf).withColumn("chat_sentiment", rounded(F.col("chat_sentiment")))
    t = speech(spark, sf).withColumn("sentiment_score", rounded(F.col("sentiment_score")))
    lagged = settle(alignment.lag_pairs(c, t, LAGS, HOUR), "lagged")
    return correlation.lag_summary(lagged, LAGS)


ROT = """ro AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY window_start, window_end, channel_id) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM pr),
rot AS (SELECT a.*, b.transcript_sentiment AS shuffled FROM ro a JOIN ro b ON a.session_id = b.session_id AND b.i = (a.i + greatest(1, a.n // 2)) % a.n)"""


@register(
    "rotate_within_session",
    f"WITH {PAIRS}, {ROT} SELECT session_id, channel_id, {us}(window_start) AS window_start, {rnd('shuffled')} AS shuffled FROM rot",
)
def _(spark, sf):
    return correlation.rotate_within_session(pairs(spark, sf)).select(*STREAM, "window_start", "shuffled")


@register(
    "negative_control",
    f"""WITH {PAIRS}, {ROT}, r AS (SELECT *, {_rank("", "chat_sentiment")} AS rx, {_rank("", "transcript_sentiment")} AS ry, {_rank("", "shuffled")} AS rz FROM rot),
        s AS (SELECT count(*) AS n, {half_away(_corr("chat_sentiment", "transcript_sentiment"), 4)} AS op, {half_away(_corr("rx", "ry"), 4)} AS os, {half_away(_corr("chat_sentiment", "shuffled"), 4)} AS sp, {half_away(_corr("rx", "rz"), 4)} AS ss FROM r)
        SELECT 'computed' AS status, n AS pair_count, {rnd("op")} AS observed_pearson, {rnd("os")} AS observed_spearman, {rnd("sp")} AS shuffled_pearson, {rnd("ss")} AS shuffled_spearman, {r4("op - sp")} AS pearson_drop, {r4("os - ss")} AS spearman_drop FROM s""",
)
def _(spark, sf):
    return correlation.negative_control(pairs(spark, sf))


SAMPLED = 10
_WHY = {"detected_divergence": "dd", "labeled_event": "le", "low_chat_volume": "chat_message_count < 5", "low_quality": "quality < 0.5", "short_transcript": "len < 40"}
_EACH = ", ".join(f"""CASE WHEN count(*) FILTER ({c}) > 0 THEN '"{n}":' || count(*) FILTER ({c}) END""" for n, c in _WHY.items())
_REASONS = f""", '{{' || concat_ws(',', {_EACH}) || '}}' AS baseline_exclusion_counts"""
QUAL = f"""count(*) AS alignment_pair_count, count(*) FILTER (calm) AS baseline_pair_count, count(*) FILTER (dd) AS detected_divergence_count, count(*) FILTER (le) AS labeled_event_pair_count,
  count(*) FILTER (label = 'none') AS labeled_none_pair_count, count(*) FILTER (quality < 0.5) AS low_quality_alignment_count, count(*) FILTER (chat_message_count < 5) AS low_chat_volume_count,
  count(*) FILTER (len < 40) AS short_transcript_count, count(*) FILTER (transcript_confidence < 0.7) AS low_transcript_confidence_count, count(*) FILTER (o / 3600 < 0.9) AS partial_overlap_count, {r4("avg(quality)")} AS average_alignment_quality{_REASONS}"""


@register(
    "pair_data_quality",
    f"WITH {PAIRS} SELECT session_id, {QUAL} FROM pr GROUP BY 1 UNION ALL SELECT NULL, {QUAL} FROM pr",
)
def _(spark, sf):
    return correlation.pair_data_quality(pairs(spark, sf), CFG)


@register(
    "source_data_quality",
    f"""WITH {TBUCKETS} SELECT session_id, count(*) AS transcript_bucket_count, CAST(0 AS BIGINT) AS empty_transcript_count, count(*) FILTER (segment_count % 2 = 0) AS missing_transcript_sentiment_count FROM tbuckets GROUP BY ROLLUP (session_id)""",
)
def _(spark, sf):
    t = speech(spark, sf)
    return correlation.source_data_quality(t.withColumn("sentiment_score", F.when(F.col("segment_count") % 2 != 0, F.col("sentiment_score"))))


@register(
    "validation_sample",
    f"""WITH {PAIRS}, s AS (SELECT *, 'detected_divergence' AS sample_cohort, ad AS k FROM pr WHERE dd UNION ALL SELECT *, 'labeled_event', ad FROM pr WHERE le UNION ALL SELECT *, 'stable_baseline', quality FROM pr WHERE calm),
        r AS (SELECT *, row_number() OVER (PARTITION BY sample_cohort ORDER BY k DESC, window_start, session_id, channel_id) AS place FROM s)
        SELECT sample_cohort, place, session_id, channel_id, {us}(window_start) AS window_start, {rnd("delta")} AS delta FROM r WHERE place <= 10""",
)
def _(spark, sf):
    return correlation.validation_sample(pairs(spark, sf)).select("sample_cohort", "place", *STREAM, "window_start", "delta")


def _long_sql(section: str, item: str, query: str, drop: str) -> str:
    return f"""SELECT '{section}' AS section, {item} AS item, name, value FROM (UNPIVOT (SELECT {drop}, CAST(COLUMNS(* EXCLUDE ({drop})) AS DOUBLE) FROM ({query})) ON COLUMNS(* EXCLUDE ({drop})) INTO NAME name VALUE value)"""


_QUALITY = f"""WITH {PAIRS} SELECT 'x' AS k, (SELECT count(DISTINCT session_id) FROM buckets) AS session_count, (SELECT count(*) FROM buckets) AS chat_bucket_count, (SELECT count(*) FROM tbuckets) AS transcript_bucket_count,
  (SELECT count(*) FROM tbuckets WHERE trim(text) = '') AS empty_transcript_count, 0 AS missing_transcript_sentiment_count, {QUAL.replace(_REASONS, "")} FROM pr"""


@register(
    "correlation_report",
    " UNION ALL ".join(
        [
            _long_sql("data_quality", "''", _QUALITY, "k"),
            _long_sql("aggregate", "cohort", f"SELECT * EXCLUDE (correlation_status, relationship_counts, label_counts) FROM ({ORACLES['cohort_summary']})", "cohort"),
            _long_sql("comparison", "status", ORACLES["compare_cohorts"], "status"),
            _long_sql("calibration", "status", f"SELECT * EXCLUDE (threshold_assessment) FROM ({ORACLES['calibrate_threshold']})", "status"),
            _long_sql("lag_analysis", "CAST(lag_seconds AS VARCHAR)", f"SELECT * EXCLUDE (correlation_status, best) FROM ({ORACLES['lag_summary']})", "lag_seconds"),
            f"SELECT 'best_lag', '', 'lag_seconds', CAST(lag_seconds AS DOUBLE) FROM ({ORACLES['lag_summary']}) WHERE best = 1",
            _long_sql("negative_control", "status", ORACLES["negative_control"], "status"),
            f"""SELECT 'validation_sample', sample_cohort || ' ' || place || ' ' || session_id || ' ' || channel_id, 'window_start', {rnd('window_start / 1e6')} FROM ({ORACLES["validation_sample"]})""",
        ]
    ),
)
def _(spark, sf):
    """The nested report, read back section by section as (section, item, name, value)."""
    from crowdtide.plans import reports

    c = settle(chat(spark, sf).withColumn("chat_sentiment", rounded(F.col("chat_sentiment"))), "chat")
    t = settle(speech(spark, sf).withColumn("sentiment_score", rounded(F.col("sentiment_score"))), "speech")
    lagged = settle(alignment.lag_pairs(c, t, LAGS, HOUR), "lagged")
    report = settle(reports.correlation_report(c, t, pairs(spark, sf), lagged, LAGS, CFG, SAMPLED), "report")

    def long(df, section, item, figures):
        kinds = dict(df.select(f"{figures}.*").dtypes)
        numbers = [F.struct(F.lit(n).alias("name"), F.col(f"{figures}.{n}").cast("double").alias("value")) for n, k in kinds.items() if k in ("bigint", "int", "double")]
        return df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(F.array(*numbers))).where("value IS NOT NULL")

    def rows(name):
        return report.select(F.explode(name).alias("r"))

    status = {n: F.col(f"{n}.status") for n in ("comparison", "calibration", "negative_control")}
    parts = [long(report, n, status.get(n, F.lit("")), n) for n in ("data_quality", *status)]
    parts += [long(rows("aggregate"), "aggregate", F.col("r.cohort"), "r.figures"), long(rows("lag_analysis"), "lag_analysis", F.col("r.lag_seconds").cast("string"), "r.figures")]
    parts.append(report.select(F.lit("best_lag").alias("section"), F.lit("").alias("item"), F.lit("lag_seconds").alias("name"), F.col("best_lag").cast("double").alias("value")))
    who = F.concat_ws(" ", "r.sample_cohort", F.col("r.place").cast("string"), "r.figures.session_id", "r.figures.channel_id")
    parts.append(rows("validation_sample").select(F.lit("validation_sample").alias("section"), who.alias("item"), F.lit("window_start").alias("name"), (F.unix_micros("r.figures.window_start") / 1e6).alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@register(
    "pair_evidence",
    f"""WITH {ALIGN}, sm AS (SELECT session_id, channel_id, bucket_start, text, row_number() OVER (PARTITION BY session_id, channel_id, bucket_start ORDER BY abs(score) DESC, ts, text) AS rn FROM scored),
        ms AS (SELECT session_id, channel_id, bucket_start, string_agg('chat: ' || text, '|' ORDER BY rn) AS said FROM sm WHERE rn <= 3 GROUP BY ALL)
        SELECT a.session_id, a.channel_id, {us}(a.window_start) AS window_start, concat_ws('|', 'alignment: ' || printf('relationship=%s; delta=%.4f; quality=%.4f', a.relationship, a.delta, a.quality), ms.said,
          CASE WHEN b.positive > 0 THEN 'chat_terms: a, b' END, 'transcript: ' || trim(a.text)) AS evidence
        FROM al a JOIN buckets b ON b.session_id = a.session_id AND b.channel_id = a.channel_id AND b.bucket_start = a.chat_bucket_start
        JOIN ms ON ms.session_id = a.session_id AND ms.channel_id = a.channel_id AND ms.bucket_start = a.chat_bucket_start""",
)
def _(spark, sf):
    message = F.struct("message_id", "timestamp", "text", F.col("score").alias("sentiment_score"))
    said = with_bucket(adapters.messages(spark, sf), HOUR).groupBy(*STREAM, "bucket_start").agg(F.collect_list(message).alias("message_scores"))
    b = chat(spark, sf).withColumn("top_terms", F.when(F.col("positive") > 0, F.array(F.lit("a"), F.lit("b")))).join(said, [*STREAM, "bucket_start"])
    out = correlation.pair_evidence(aligned(spark, sf), b, speech(spark, sf))
    return out.select(*STREAM, "window_start", F.transform("evidence", lambda e: F.concat(e["source"], F.lit(": "), e["text"])).alias("evidence"))
