"""Coverage and latency audit of stored sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.numbers import ratio, round_half_away
from crowdtide.functions.text import key_text, strip
from crowdtide.operators.correlation import count_map
from crowdtide.operators.transcripts import audio_span, non_zero, status_from_quality, word_count


def r4(x: Column) -> Column:
    return round_half_away(x, 4)


def first_n(table: DataFrame, start: str, n: int, newest: bool = False) -> DataFrame:
    """First (or newest) n rows per session in time order."""
    at = F.col(start)
    ties = [c for c in ("channel_id", "bucket_end", "window_end") if c in table.columns]
    w = Window.partitionBy("session_id").orderBy(at.desc() if newest else at.asc(), *ties)
    return table.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def status_key(x: Column) -> Column:
    s = key_text(x)
    return F.when(s == "", "missing").otherwise(s)


def status_counts(table: DataFrame, column: str, out: str = "status_counts") -> DataFrame:
    return count_map(table.withColumn("_status", status_key(F.col(column))), ["session_id"], "_status", out)


def reaction_and_peak_counts(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("session_id").agg(F.sum(nested_windows()).alias("reaction_window_count"), F.count_if(has_peak()).alias("peak_reaction_count"))


def nested_windows() -> Column:
    return F.greatest(F.coalesce(F.size("subwindows"), F.lit(0)), F.lit(0))


def has_peak() -> Column:
    return (
        F.col("peak_reaction_score").isNotNull()
        | F.col("peak_window_start").isNotNull()
        | (F.coalesce("peak_reaction_type", F.lit("")) != "")
        | (F.coalesce(F.size("peak_evidence_messages"), F.lit(0)) > 0)
    )


def _coverage_inputs(buckets: DataFrame) -> DataFrame:
    """Figures of a transcript bucket that coverage adds up."""
    zero = F.lit(0.0)

    def quality(key: str) -> Column:
        return F.get_json_object("quality", f"$.{key}")

    base = buckets.withColumns(
        {
            "_audio": F.coalesce(non_zero(F.col("audio_seconds")), audio_span(), zero),
            "_expected": F.greatest(zero, (F.unix_micros("bucket_end") - F.unix_micros("bucket_start")) / 1e6),
            "_segments": F.coalesce(non_zero(F.col("segment_count")), F.greatest(F.size("segments"), F.lit(0)), F.lit(0)),
            "_words": F.coalesce(non_zero(F.col("word_count")), word_count(F.col("text"))),
            "_changed": F.coalesce("repair_changed_ratio", zero),
            "_added": F.coalesce("repair_added_words", F.lit(0)),
        }
    )
    weight = F.when(F.col("_audio") > 0, F.col("_audio")).otherwise(F.col("_expected"))
    repaired = F.lower(F.trim(quality("repaired"))).isin("true", "1", "yes")
    completed = (F.lower(F.trim(quality("repair_status"))) == "completed") & quality("repair_changed_ratio").isNotNull()
    observed = (
        (F.col("_changed") != 0)
        | (F.col("_added") != 0)
        | F.coalesce(repaired, F.lit(False))
        | (F.trim(F.coalesce(quality("original_live_text"), F.lit(""))) != "")
        | F.coalesce(completed, F.lit(False))
    )
    return base.withColumns(
        {"_weight": F.when(weight > 0, weight), "_empty": F.when(weight > 0, F.coalesce("empty_ratio", zero) * weight), "_change": F.when(observed, F.col("_changed"))}
    )


COVERAGE_INPUTS = ("_audio", "_expected", "_segments", "_words", "_added", "_weight", "_empty", "_change")


def _coverage_sums(mine: Column | None = None) -> list[Column]:
    """Aggregates of the inputs, over the rows that ``mine`` picks."""

    def own(c: str) -> Column:
        return F.col(c) if mine is None else F.when(mine, F.col(c))

    sums = [F.sum(own(c)).alias(n) for c, n in (("_audio", "audio_seconds"), ("_expected", "expected_audio_seconds"), ("_segments", "segment_count"), ("_words", "word_count"), ("_added", "repair_added_words"))]
    return [*sums, F.sum(own("_empty")).alias("_empty"), F.sum(own("_weight")).alias("_weight"), F.sum(own("_change")).alias("_change"), F.count(own("_change")).alias("_changes")]


def _coverage_ratios(agg: DataFrame) -> DataFrame:
    added = F.when((F.col("word_count") > 0) & (F.col("repair_added_words") > 0), F.col("repair_added_words") / F.col("word_count"))
    rated = agg.withColumns({"empty_ratio": r4(ratio(F.col("_empty"), F.col("_weight"))), "average_repair_changed_ratio": r4(ratio(F.col("_change"), F.col("_changes")))})
    return rated.withColumns(
        {
            "audio_coverage": r4(F.when(F.col("expected_audio_seconds") > 0, F.col("audio_seconds") / F.col("expected_audio_seconds"))),
            "repair_improvement": r4(F.greatest(added, F.col("average_repair_changed_ratio"))),
            "audio_seconds": r4(F.col("audio_seconds")),
            "expected_audio_seconds": r4(F.col("expected_audio_seconds")),
        }
    ).drop("_empty", "_weight", "_change", "_changes")


def transcript_coverage(buckets: DataFrame) -> DataFrame:
    """Audio, words, emptiness and repair figures per session."""
    return _coverage_ratios(_coverage_inputs(buckets).groupBy("session_id").agg(F.count("*").alias("bucket_count"), *_coverage_sums()))


def best_status() -> Column:
    """Transcript status, else the one in the quality document, else the sentiment status."""
    own = status_key(F.col("transcript_status"))
    recorded = status_from_quality(F.col("quality"))
    return F.when(own != "missing", own).when(recorded != "", recorded).otherwise(F.col("sentiment_status"))


def transcript_status_counts(buckets: DataFrame) -> DataFrame:
    return status_counts(buckets.withColumn("_s", best_status()), "_s", "transcript_status_counts")


LATENCIES = {
    "chat_analysis": "analysis_latency_ms",
    "transcript_sentiment": "sentiment_latency_ms",
    "transcript_asr": "asr_latency_ms",
    "transcript_pipeline": "pipeline_latency_ms",
}


def latency_summary(table: DataFrame, column: str, positive_only: bool = False) -> DataFrame:
    """Counts, range, mean and nearest-rank percentiles of whole-millisecond latencies.

    ``percentile_disc`` keeps one counter per distinct value and merges partial results, so a large session only
    costs its distinct milliseconds.
    """
    v = F.col(column)
    v = F.when(v > 0, v) if positive_only else v

    def disc(p: float) -> Column:
        return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _v)").cast("double")

    return (
        table.withColumn("_v", v)
        .groupBy("session_id")
        .agg(
            F.count("_v").alias("available_count"),
            (F.count("*") - F.count("_v")).alias("missing_count"),
            F.min("_v").alias("min"),
            F.max("_v").alias("max"),
            r4(F.avg("_v")).alias("average"),
            disc(0.5).alias("p50"),
            disc(0.95).alias("p95"),
        )
    )


def _counts(table: DataFrame, name: str) -> DataFrame:
    return table.groupBy("session_id").agg(F.count("*").alias(name))


def _label_keys(labels: DataFrame) -> DataFrame:
    return labels.select("session_id", "window_start", "window_end").distinct()


def session_totals(sessions: DataFrame, chat: DataFrame, transcripts: DataFrame, alignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Loaded against recorded totals, with the sources that fall short."""
    out = _recorded(sessions)
    for table, c in zip((chat, transcripts, alignments), SOURCES):
        out = out.join(_counts(table, f"loaded_{c}"), "session_id", "left")
    return _with_totals(out.join(_counts(_label_keys(labels), "signal_window_label_count"), "session_id", "left"))


SOURCES = ("chat_bucket_count", "transcript_bucket_count", "alignment_count")


def _recorded(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "channel_id", *[F.coalesce(c, F.lit(0)).alias(f"_rec_{c}") for c in SOURCES])


def _with_totals(out: DataFrame) -> DataFrame:
    """Totals from the loaded and the recorded counts."""
    sources = SOURCES
    out = out.na.fill(0, [*[f"loaded_{c}" for c in sources], "signal_window_label_count"])
    out = out.withColumns({c: F.greatest(f"_rec_{c}", f"loaded_{c}") for c in sources})
    short = [
        F.when(F.col(f"loaded_{c}") < F.col(c), F.struct(F.lit(s).alias("source"), F.col(f"loaded_{c}").alias("loaded_count"), F.col(c).alias("total_count")))
        for c, s in zip(sources, ("chat_buckets", "transcript_buckets", "alignments"))
    ]
    out = out.withColumn("truncated_sources", F.array_compact(F.array(*short)))
    return out.withColumns(
        {
            "bucket_count": sum((F.col(c) for c in sources[1:]), F.col(sources[0])),
            "source_bucket_count": F.col("chat_bucket_count") + F.col("transcript_bucket_count"),
            "partial": F.size("truncated_sources") > 0,
        }
    ).drop(*[f"_rec_{c}" for c in sources])


def timeline_bounds(sessions: DataFrame, chat: DataFrame, transcripts: DataFrame, alignments: DataFrame) -> DataFrame:
    """First and last time of each session, from its buckets, else from the session itself."""

    def span(t: DataFrame, starts: Sequence[str], ends: Sequence[str]) -> DataFrame:
        # bounds per row need only the extremes, and each table is reduced before the union
        cols = [F.col(c) for c in (*starts, *ends)]
        return t.groupBy("session_id").agg(F.min(F.least(*cols)).alias("s"), F.max(F.greatest(*cols)).alias("e"))

    both = ("bucket_start", "bucket_end")
    al = ("window_start", "window_end", "chat_bucket_start", "chat_bucket_end", "transcript_bucket_start", "transcript_bucket_end")
    seen = span(chat, both[:1], both[1:]).unionByName(span(transcripts, both[:1], both[1:])).unionByName(span(alignments, al[:1], al[1:]))
    bounds = seen.groupBy("session_id").agg(F.min("s").alias("_s"), F.max("e").alias("_e"))
    out = sessions.select("session_id", "started_at", "ended_at").join(bounds, "session_id", "left")
    return out.select("session_id", *[c.alias(n) for n, c in _timeline().items()])


def _timeline() -> dict[str, Column]:
    """Bounds and length from the first and last time seen (_s, _e), else from the session's own times."""
    ordered = F.least("started_at", "ended_at"), F.greatest("started_at", "ended_at")
    start, end = F.coalesce(F.col("_s"), ordered[0]), F.coalesce(F.col("_e"), ordered[1])
    ms = F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000))
    return {"timeline_start": start, "timeline_end": end, "source_duration_ms": F.coalesce(ms, F.lit(0))}


def window_keys(chat: DataFrame, alignments: DataFrame) -> DataFrame:
    """Distinct window ranges over chat buckets, nested reaction windows and alignments."""
    key = ["session_id", "window_start", "window_end"]
    out = chat.select("session_id", F.col("bucket_start").alias("window_start"), F.col("bucket_end").alias("window_end"))
    if "subwindows" in chat.columns:
        nested = chat.select("session_id", F.explode("subwindows").alias("s")).select("session_id", "s.window_start", "s.window_end")
        out = out.unionByName(nested.where(F.col("window_start").isNotNull() & F.col("window_end").isNotNull()))
    return out.unionByName(alignments.select(*key)).distinct()


def distinct_windows(chat: DataFrame, alignments: DataFrame) -> DataFrame:
    matched = alignments.select(
        "session_id", "channel_id", "window_start", "window_end", "chat_bucket_start", "chat_bucket_end", "transcript_bucket_start", "transcript_bucket_end"
    ).distinct()
    out = _counts(window_keys(chat, alignments), "signal_window_count").join(_counts(matched, "matched_windows"), "session_id", "full")
    return out.na.fill(0)


def label_coverage(chat: DataFrame, alignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled share of the windows and labels that hit none."""
    keys = window_keys(chat, alignments)
    hit = keys.withColumn("_w", F.lit(True)).join(_label_keys(labels).withColumn("_l", F.lit(True)), ["session_id", "window_start", "window_end"], "full")
    w, lab = F.col("_w").isNotNull(), F.col("_l").isNotNull()
    out = hit.groupBy("session_id").agg(
        F.count_if(w & lab).alias("labeled_windows"),
        F.count_if(lab & ~w).alias("unmatched_labels"),
        F.count_if(w).alias("total_windows"),
        F.count_if(lab).alias("stored_label_count"),
    )
    return out.withColumn("label_coverage", r4(ratio(F.col("labeled_windows"), F.col("total_windows"))))


def replay_speeds(totals: DataFrame, speeds: Sequence[float] = (1.0, 5.0, 10.0)) -> DataFrame:
    """Estimated replay time and throughput per speed. ``totals``: session_id, source_duration_ms, signal_window_count, bucket_count."""
    wanted = sorted({float(s) for s in speeds if s > 0}) or [1.0, 5.0, 10.0]
    rows = totals.withColumn("speed", F.explode(F.array(*[F.lit(s) for s in wanted])))
    ms = F.when(F.col("source_duration_ms") > 0, F.ceil(F.col("source_duration_ms") / F.col("speed")))
    seconds = ms / F.lit(1000.0)

    def per_second(c: str) -> Column:
        return F.coalesce(r4(ratio(F.col(c), seconds)), F.lit(0.0))

    return rows.select(
        "session_id",
        "speed",
        F.coalesce(ms, F.lit(0)).alias("estimated_replay_duration_ms"),
        F.coalesce(r4(seconds), F.lit(0.0)).alias("estimated_replay_seconds"),
        per_second("signal_window_count").alias("windows_per_second"),
        per_second("bucket_count").alias("buckets_per_second"),
    )


# --- the audit in one pass --------------------------------------------------

_NUMBERS = ("_nested", "_peaks", *COVERAGE_INPUTS)


def _key(*parts: str | Column) -> Column:
    return F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("~")) for p in parts])


def _fact(kind: str, key: Column, own: bool = False, label: bool = False) -> Column:
    """Something that is counted once per (session, kind, key). ``own``: the row itself, which carries its numbers."""
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(own).alias("own"), F.lit(label).alias("label"))


def _facts(table: DataFrame, facts: Column, start: str | None = None, end: str | None = None) -> DataFrame:
    """A narrow row for each fact of each row; the numbers stay with the row's own one."""
    out = table.withColumn("_f", F.explode(facts))
    own = F.col("_f.own")
    numbers = [F.when(own, F.col(c)).cast("double").alias(c) if c in table.columns else F.lit(None).cast("double").alias(c) for c in _NUMBERS]
    none = F.lit(None).cast("timestamp")
    first = F.when(own, F.least(start, end)).alias("_s") if start else none.alias("_s")
    last = F.when(own, F.greatest(start, end)).alias("_e") if start else none.alias("_e")
    return out.select("session_id", "_f.kind", "_f.key", F.col("_f.label").alias("label"), first, last, *numbers)


def _latency(kind: str, rows: str) -> Column:
    """Summary of counted whole milliseconds, as ``latency_summary`` makes it; null for sessions without such rows."""
    counted = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("key").cast("long").alias("v"), "n"))))
    total = F.reduce(counted, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    def disc(p: float) -> Column:
        # the first value by which the share p is reached
        state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
        rank = F.ceil(total * p)

        def step(a: Column, x: Column) -> Column:
            seen = a["seen"] + x["n"]
            return F.struct(seen.alias("seen"), F.when(a["v"].isNull() & (seen >= rank), x["v"]).otherwise(a["v"]).alias("v"))

        return F.reduce(counted, state, step, lambda a: a["v"].cast("double"))

    size = F.sum(F.when(F.col("kind") == rows, F.col("n")))
    mean = F.reduce(counted, F.lit(0).cast("long"), lambda a, x: a + x["v"] * x["n"])
    summary = F.struct(
        total.alias("available_count"), (size - total).alias("missing_count"), F.get(counted, F.lit(0))["v"].alias("min"), F.element_at(F.when(F.size(counted) > 0, counted), -1)["v"].alias("max"),
        r4(ratio(mean, total)).alias("average"), disc(0.5).alias("p50"), disc(0.95).alias("p95"),
    )
    return F.when(size > 0, summary)


def _status_map(kind: str) -> Column:
    entries = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("key"), F.col("n").alias("value")))))
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def session_facts(chat: DataFrame, transcripts: DataFrame, alignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Everything an audit counts, per session, from one scan of each table.

    Each row is emitted as itself and under what it is counted by: its status, its latency, its window ranges. One
    aggregation per (session, kind, key), with map-side partials, makes ranges distinct and counts values; a second one,
    per session, reads all figures off those. A list holds the distinct values of a session, never its rows.
    """
    more = {c: F.lit(None).cast(t) for c, t in CHAT_OPTIONAL.items() if c not in chat.columns}
    chat = chat.withColumns(more) if more else chat
    status, range_ = lambda c: status_key(F.col(c)), lambda a, b: _key(F.unix_micros(a), F.unix_micros(b))
    none = F.array().cast("array<struct<kind:string,key:string,own:boolean,label:boolean>>")
    inner = F.filter(F.coalesce("subwindows", F.array().cast(chat.schema["subwindows"].dataType)), lambda x: x["window_start"].isNotNull() & x["window_end"].isNotNull())
    positive = F.when(F.col("analysis_latency_ms") > 0, F.col("analysis_latency_ms").cast("long").cast("string"))

    def latency(kind: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(_fact(kind, value))).otherwise(none)

    rows = chat.withColumns({"_nested": nested_windows(), "_peaks": has_peak().cast("int")})
    of_chat = F.concat(
        F.array(_fact("chat", F.lit(""), True), _fact("chat_analysis_status_counts", status("analysis_status")), _fact("range", range_("bucket_start", "bucket_end"))),
        latency("chat_analysis", positive), F.transform(inner, lambda x: _fact("range", range_(x["window_start"], x["window_end"]))),
    )
    of_speech = F.concat(
        F.array(_fact("transcript", F.lit(""), True), _fact("transcript_sentiment_status_counts", status("sentiment_status")), _fact("transcript_status_counts", status_key(best_status()))),
        *[latency(n, F.col(c).cast("long").cast("string")) for n, c in LATENCIES.items() if n != "chat_analysis"],
    )
    ends = [f"{x}_{y}" for x in ("window", "chat_bucket", "transcript_bucket") for y in ("start", "end")]
    of_pairs = F.array(_fact("alignment", F.lit(""), True), _fact("range", range_("window_start", "window_end")), _fact("matched", _key("channel_id", *[F.unix_micros(c) for c in ends])))
    bucket = ("bucket_start", "bucket_end")
    facts = (
        _facts(rows, of_chat, *bucket)
        .unionByName(_facts(_coverage_inputs(transcripts), of_speech, *bucket))
        .unionByName(_facts(alignments.withColumns({"_first": F.least(*ends), "_last": F.greatest(*ends)}), of_pairs, "_first", "_last"))
        .unionByName(_facts(labels, F.array(_fact("range", range_("window_start", "window_end"), label=True))))
    )
    counted = facts.groupBy("session_id", "kind", "key").agg(
        F.count("*").alias("n"), F.max("label").alias("label"), F.min("label").alias("only_label"), F.min("_s").alias("_s"), F.max("_e").alias("_e"),
        *[F.sum(c).alias(c) for c in _NUMBERS], F.count("_change").alias("_changes"),
    )

    def size(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    window = (F.col("kind") == "range") & ~F.col("only_label")
    labeled = (F.col("kind") == "range") & F.col("label")
    speech = F.col("kind") == "transcript"

    def whole(c: str) -> Column:
        return F.sum(F.when(speech, F.col(c))).cast("long")

    out = counted.groupBy("session_id").agg(
        size("chat").alias("loaded_chat_bucket_count"), size("transcript").alias("loaded_transcript_bucket_count"), size("alignment").alias("loaded_alignment_count"),
        F.count_if(window).alias("signal_window_count"), F.count_if(F.col("kind") == "matched").alias("matched_windows"),
        F.count_if(window & labeled).alias("labeled_windows"), F.count_if(labeled & ~window).alias("unmatched_labels"), F.count_if(labeled).alias("stored_label_count"),
        F.min("_s").alias("_s"), F.max("_e").alias("_e"),
        F.sum("_audio").alias("audio_seconds"), F.sum("_expected").alias("expected_audio_seconds"), whole("_segments").alias("segment_count"), whole("_words").alias("word_count"),
        whole("_added").alias("repair_added_words"), F.sum("_empty").alias("_empty"), F.sum("_weight").alias("_weight"), F.sum("_change").alias("_change"), F.sum("_changes").alias("_changes"),
        F.sum("_nested").cast("long").alias("reaction_window_count"), F.sum("_peaks").cast("long").alias("peak_reaction_count"),
        *[_status_map(k).alias(k) for k in ("transcript_status_counts", "chat_analysis_status_counts", "transcript_sentiment_status_counts")],
        *[_latency(n, "chat" if n == "chat_analysis" else "transcript").alias(f"{n}_latency") for n in LATENCIES],
    )
    ranges = F.col("signal_window_count") + F.col("unmatched_labels")
    out = out.withColumn("label_coverage", F.when(ranges > 0, r4(ratio(F.col("labeled_windows"), F.col("signal_window_count")))))
    figures = ["audio_seconds", "expected_audio_seconds", "segment_count", "word_count", "repair_added_words", "empty_ratio", "average_repair_changed_ratio", "audio_coverage", "repair_improvement"]
    return _coverage_ratios(out).withColumnsRenamed({c: f"transcript_{c}" for c in figures})


CHAT_OPTIONAL = {
    "subwindows": "array<struct<window_start:timestamp,window_end:timestamp>>", "peak_reaction_score": "double", "peak_window_start": "timestamp", "peak_reaction_type": "string",
    "peak_evidence_messages": "array<struct<message_id:string>>",
}


def session_proof(sessions: DataFrame, chat: DataFrame, transcripts: DataFrame, alignments: DataFrame, labels: DataFrame) -> DataFrame:
    """One audit row per session, see ``session_facts``."""
    facts = session_facts(chat, transcripts, alignments, labels).withColumn("signal_window_label_count", F.col("stored_label_count"))
    times = sessions.select("session_id", "channel_id", "started_at", "ended_at", *[F.coalesce(c, F.lit(0)).alias(f"_rec_{c}") for c in SOURCES])
    out = _with_totals(times.join(facts, "session_id", "left")).withColumns(_timeline()).drop("_s", "_e", "started_at", "ended_at")
    whole = ["signal_window_count", "matched_windows", "labeled_windows", "unmatched_labels", "stored_label_count", "transcript_word_count",
             "transcript_segment_count", "transcript_repair_added_words"]
    return out.na.fill(0, whole)


PROOF_METRICS = (
    ("bucket_count", "loaded_total", "buckets"), ("source_bucket_count", "loaded_source", "buckets"),
    ("signal_window_count", "signal_window_count", "windows"), ("matched_windows", "matched_windows", "windows"),
    ("label_coverage", "label_coverage", "ratio"), ("transcript_audio_coverage", "transcript_audio_coverage", "ratio"),
    ("transcript_empty_ratio", "transcript_empty_ratio", "ratio"), ("transcript_word_count", "transcript_word_count", "words"),
    ("transcript_repair_added_words", "transcript_repair_added_words", "words"),
    ("transcript_repair_changed_ratio", "transcript_average_repair_changed_ratio", "ratio"),
    ("transcript_repair_improvement", "transcript_repair_improvement", "ratio"),
    ("chat_analysis_latency_ms", "chat_analysis_latency.average", "ms"),
    ("transcript_sentiment_latency_ms", "transcript_sentiment_latency.average", "ms"),
    ("transcript_asr_latency_ms", "transcript_asr_latency.average", "ms"),
    ("transcript_pipeline_latency_ms", "transcript_pipeline_latency.average", "ms"),
)


def wide_to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per metric (name, source column, unit); missing values are left out. No shuffle."""
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit")) for n, c, u in metrics])
    return df.select(*keys, F.inline(items)).where(F.col("value").isNotNull())


def proof_to_metrics(proof: DataFrame, speeds: Sequence[float] = (1.0, 5.0, 10.0)) -> DataFrame:
    """Long-format metrics of a proof table, two more per replay speed."""
    total = F.col("loaded_chat_bucket_count") + F.col("loaded_transcript_bucket_count")
    wide = proof.withColumns({"loaded_source": total, "loaded_total": total + F.col("loaded_alignment_count")})
    named = [(f"replay_proof.{n}", c, u) for n, c, u in PROOF_METRICS]
    base = wide_to_long(wide, ["session_id"], named).withColumn("speed", F.lit(None).cast("double"))
    per_speed = replay_speeds(wide.select("session_id", "source_duration_ms", "signal_window_count", F.col("loaded_total").alias("bucket_count")), speeds)
    timed = wide_to_long(
        per_speed,
        ["session_id", "speed"],
        [("replay_proof.estimated_replay_seconds", "estimated_replay_seconds", "seconds"), ("replay_proof.windows_per_second", "windows_per_second", "windows/s")],
    )
    return base.unionByName(timed)


def session_history(sessions: DataFrame, chat: DataFrame, transcripts: DataFrame, alignments: DataFrame, labels: DataFrame) -> DataFrame:
    """Sessions with the number of stored rows, each table counted before it is joined."""
    out = sessions
    for table, c in ((chat, "chat_bucket_count"), (transcripts, "transcript_bucket_count"), (alignments, "alignment_count"), (labels, "label_count")):
        out = out.drop(c).join(_counts(table, c), "session_id", "left")
    return out.na.fill(0, ["chat_bucket_count", "transcript_bucket_count", "alignment_count", "label_count"])


def latest_metric(metrics: DataFrame) -> DataFrame:
    """Newest value per session and metric name."""
    return metrics.groupBy("session_id", "name").agg(F.max_by("value", F.struct("recorded_at", "value")).alias("value"))


def recent_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The n sessions seen last."""
    seen = [F.col(c) for c in ("last_seen", "updated_at", "started_at") if c in sessions.columns]
    return sessions.orderBy(F.coalesce(*seen).desc(), "session_id").limit(n)
