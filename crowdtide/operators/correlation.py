"""Correlation of chat and speech sentiment: cohorts, calibration, lags, negative control."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.numbers import ratio, round_half_away
from crowdtide.functions.text import key_text, strip
from crowdtide.operators.alignment import overlap_label
from crowdtide.operators.ranks import average_ranks, quantiles, row_positions
from crowdtide.sources.storage import settle

COHORTS = ("all_aligned", "calm_baseline", "detected_divergence", "labeled_events", "labeled_none")


@dataclass(frozen=True)
class CohortConfig:
    minimum_pairs: int = 3
    divergence_delta: float = 0.45
    minimum_quality: float = 0.60
    minimum_messages: int = 5
    minimum_text: int = 40


def r4(x: Column) -> Column:
    return round_half_away(x, 4)


def sentiment_pairs(alignments: DataFrame, labels: DataFrame, config: CohortConfig | None = None, width: int = 30) -> DataFrame:
    """Alignments with their overlapping label and the divergence and calm-baseline flags."""
    cfg = config or CohortConfig()
    rel = key_text(F.col("relationship"))
    pairs = overlap_label(alignments, labels, width).withColumns(
        {"relationship": rel, "detected_divergence": (rel == "diverged") | (F.abs("delta") >= cfg.divergence_delta)}
    )
    event = ~F.col("label").isin("", "none")
    calm = (
        ~F.col("detected_divergence")
        & ~event
        & (F.col("quality") >= cfg.minimum_quality)
        & (F.col("chat_message_count") >= cfg.minimum_messages)
        & (F.col("transcript_text_length") >= cfg.minimum_text)
    )
    return pairs.withColumns({"labeled_event": event, "calm_baseline": calm})


def pearson(x: str, y: str) -> Column:
    """NULL for fewer than two rows or a constant series."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), spread))


def with_cohorts(pairs: DataFrame) -> DataFrame:
    """One row per pair and cohort it belongs to; the cohorts overlap."""
    names = F.array_compact(
        F.array(
            F.lit("all_aligned"),
            F.when(F.col("calm_baseline"), "calm_baseline"),
            F.when(F.col("detected_divergence"), "detected_divergence"),
            F.when(F.col("labeled_event"), "labeled_events"),
            F.when(F.col("label") == "none", "labeled_none"),
        )
    )
    return pairs.withColumn("cohort", F.explode(names))


def correlations(pairs: DataFrame, keys: Sequence[str], minimum: int, x: str = "chat_sentiment", ys: Sequence[str] = ("transcript_sentiment",)) -> DataFrame:
    """Pearson and Spearman of x with each y per key, with their status, rounded to four digits.

    Columns of the first y are plain (pearson, spearman, correlation_status); further ones carry its name as prefix.
    """
    k = list(keys)
    ranked = average_ranks(pairs.select(*k, x, *ys), k, {c: f"_r_{c}" for c in (x, *ys)})
    aggs = [F.count("*").alias("n")]
    for y in ys:
        aggs += [pearson(x, y).alias(f"_p_{y}"), pearson(f"_r_{x}", f"_r_{y}").alias(f"_s_{y}")]
    out = ranked.groupBy(*k).agg(*aggs)
    enough = F.col("n") >= minimum
    cols: list[Column] = []
    for i, y in enumerate(ys):
        p, s = F.when(enough, F.col(f"_p_{y}")), F.when(enough, F.col(f"_s_{y}"))
        status = (
            F.when(~enough, "insufficient_pairs")
            .when(p.isNotNull() & s.isNotNull(), "computed")
            .when(p.isNotNull(), "spearman_undefined")
            .when(s.isNotNull(), "pearson_undefined")
            .otherwise("constant_series")
        )
        prefix = "" if i == 0 else f"{y}_"
        cols += [r4(p).alias(f"{prefix}pearson"), r4(s).alias(f"{prefix}spearman"), status.alias(f"{prefix}correlation_status")]
    return out.select(*k, *cols)


def count_map(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Occurrences of each non-empty value as a sorted map; a two-level aggregation."""
    counts = rows.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(value).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(entries).alias(out))


def cohort_summary(pairs: DataFrame, keys: Sequence[str] = (), config: CohortConfig | None = None) -> DataFrame:
    """Every cohort of every key (none: over all sessions), empty cohorts included."""
    cfg = config or CohortConfig()
    k = [*keys, "cohort"]
    rows = with_cohorts(pairs).withColumn("abs_delta", F.abs("delta"))
    means = rows.groupBy(*k).agg(
        F.count("*").alias("pair_count"),
        r4(F.avg("chat_sentiment")).alias("mean_chat_sentiment"),
        r4(F.avg("transcript_sentiment")).alias("mean_transcript_sentiment"),
        r4(F.avg("delta")).alias("average_delta"),
        r4(F.avg("abs_delta")).alias("average_abs_delta"),
        r4(F.avg("quality")).alias("average_quality"),
    )
    cuts = quantiles(rows, k, "abs_delta", {"abs_delta_median": 0.5, "abs_delta_p90": 0.9, "abs_delta_p95": 0.95})
    cuts = cuts.select(*k, *[r4(F.col(c)).alias(c) for c in ("abs_delta_median", "abs_delta_p90", "abs_delta_p95")])
    names = F.explode(F.array(*[F.lit(c) for c in COHORTS])).alias("cohort")
    every = pairs.groupBy(*keys).agg(F.lit(1).alias("_one")).select(*keys, names)
    out = (
        every.join(means, k, "left")
        .join(cuts, k, "left")
        .join(correlations(rows, k, cfg.minimum_pairs), k, "left")
        .join(count_map(rows, k, "relationship", "relationship_counts"), k, "left")
        .join(count_map(rows, k, "label", "label_counts"), k, "left")
    )
    return out.withColumns(
        {"pair_count": F.coalesce("pair_count", F.lit(0)), "correlation_status": F.coalesce("correlation_status", F.lit("insufficient_pairs"))}
    )


def compare_cohorts(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Baseline minus event correlation, and the change of the absolute delta."""

    def of(cohort: str, c: str) -> Column:
        return F.max(F.when(F.col("cohort") == cohort, F.col(c)))

    calm, event = "calm_baseline", "detected_divergence"
    out = summary.groupBy(*keys).agg(
        r4(of(calm, "pearson") - of(event, "pearson")).alias("pearson_drop_from_baseline"),
        r4(of(calm, "spearman") - of(event, "spearman")).alias("spearman_drop_from_baseline"),
        r4(of(event, "average_abs_delta") - of(calm, "average_abs_delta")).alias("average_abs_delta_change"),
    )
    some = F.coalesce(*[F.col(c) for c in ("pearson_drop_from_baseline", "spearman_drop_from_baseline", "average_abs_delta_change")]).isNotNull()
    return out.withColumn("status", F.when(some, "computed").otherwise("insufficient_correlation_pairs"))


def calibrate_threshold(pairs: DataFrame, keys: Sequence[str] = (), config: CohortConfig | None = None) -> DataFrame:
    """Quantiles of the calm baseline and the share of detected events beyond its 95 % point."""
    cfg = config or CohortConfig()
    rows = pairs.withColumn("abs_delta", F.abs("delta"))
    cuts = quantiles(rows.where("calm_baseline"), list(keys), "abs_delta", {"median": 0.5, "p90": 0.9, "p95": 0.95})
    # one row per key: with no key a single row, else joined on it
    joined = rows.join(F.broadcast(cuts), how="left") if not keys else rows.join(cuts, list(keys), "left")
    out = joined.groupBy(*keys).agg(
        F.count_if("calm_baseline").alias("baseline_pair_count"),
        F.count_if("detected_divergence").alias("detected_divergence_pair_count"),
        F.count_if(F.col("detected_divergence") & (F.col("abs_delta") > F.col("p95"))).alias("_above"),
        *[F.first(c).alias(c) for c in ("median", "p90", "p95")],
    )
    ok = F.col("baseline_pair_count") >= cfg.minimum_pairs
    thr = F.lit(float(cfg.divergence_delta))
    assessment = (
        F.when(~ok, "insufficient_baseline_pairs")
        .when(thr < F.col("p90"), "current_threshold_below_baseline_p90")
        .when((thr > F.col("p95") * 1.5) & (F.col("p95") > 0), "current_threshold_much_higher_than_baseline_p95")
        .otherwise("current_threshold_near_baseline_tail")
    )
    return out.select(
        *keys,
        F.when(ok, "computed").otherwise("insufficient_baseline_pairs").alias("status"),
        "baseline_pair_count",
        "detected_divergence_pair_count",
        r4(thr).alias("current_threshold"),
        F.when(ok, r4(F.col("p95"))).alias("recommended_threshold"),
        F.when(ok, r4(F.col("median"))).alias("baseline_abs_delta_median"),
        F.when(ok, r4(F.col("p90"))).alias("baseline_abs_delta_p90"),
        F.when(ok, r4(F.col("p95"))).alias("baseline_abs_delta_p95"),
        F.when(ok, F.col("_above")).otherwise(F.lit(0)).alias("detected_above_baseline_p95"),
        F.when(ok, r4(ratio(F.col("_above"), F.col("detected_divergence_pair_count")))).alias("detected_above_baseline_p95_rate"),
        assessment.alias("threshold_assessment"),
    )


def lag_summary(lagged: DataFrame, lags: Sequence[int], keys: Sequence[str] = (), minimum: int = 3) -> DataFrame:
    """Correlation per lag; ``best`` marks the largest absolute Pearson, the smallest lag on ties."""
    k = [*keys, "lag_seconds"]
    means = lagged.groupBy(*k).agg(F.count("*").alias("pair_count"), r4(F.avg(F.abs("delta"))).alias("average_abs_delta"))
    found = means.join(correlations(lagged, k, minimum), k, "left")
    every = lagged.groupBy(*keys).agg(F.lit(1).alias("_one")).select(*keys, F.explode(F.array(*[F.lit(int(x)) for x in lags])).alias("lag_seconds"))
    out = every.join(found, k, "left").withColumns(
        {"pair_count": F.coalesce("pair_count", F.lit(0)), "correlation_status": F.coalesce("correlation_status", F.lit("insufficient_pairs"))}
    )
    w = Window.partitionBy(*keys).orderBy(F.abs("pearson").desc_nulls_last(), "lag_seconds")
    return out.withColumn("best", F.col("pearson").isNotNull() & (F.row_number().over(w) == 1))


def rotate_within_session(pairs: DataFrame, value: str = "transcript_sentiment", out: str = "shuffled") -> DataFrame:
    """Each row receives the value half a session further on; a single row keeps its own."""
    tied = pairs.withColumn("_tie", F.struct("window_end", "channel_id"))
    placed = row_positions(tied, ["session_id"], "window_start", "_tie", 3600, "_i", "_total").withColumn("_i", F.col("_i").cast("int")).drop("_tie")
    step = F.greatest(F.lit(1), F.floor(F.col("_total") / 2)).cast("long")
    # the giver at position i serves the row that looks `step` ahead of itself
    giver = placed.select("session_id", ((F.col("_i") - step + F.col("_total")) % F.col("_total")).cast("int").alias("_i"), F.col(value).alias(out))
    return placed.join(giver, ["session_id", "_i"]).withColumn("effective", F.col("_total") > 1).drop("_i", "_total")


def negative_control(pairs: DataFrame, keys: Sequence[str] = (), minimum: int = 3) -> DataFrame:
    """Observed correlation against the rotated series."""
    k = list(keys)
    rotated = rotate_within_session(pairs)
    if not k:
        rotated = rotated.withColumn("_all", F.lit(1))
        k = ["_all"]
    # read by every rank of both correlations
    rotated = settle(rotated.select(*k, "chat_sentiment", "transcript_sentiment", "shuffled", "effective"), "rotated")
    found = correlations(rotated, k, minimum, ys=("transcript_sentiment", "shuffled")).withColumnsRenamed(
        {"pearson": "observed_pearson", "spearman": "observed_spearman"}
    )
    base = rotated.groupBy(*k).agg(F.count("*").alias("pair_count"), F.max("effective").alias("_eff"))
    out = base.join(found, k, "left")
    eff = F.col("_eff")
    out = out.withColumns({c: F.when(eff, F.col(c)) for c in ("shuffled_pearson", "shuffled_spearman")})
    out = out.withColumns(
        {
            "pearson_drop": r4(F.col("observed_pearson") - F.col("shuffled_pearson")),
            "spearman_drop": r4(F.col("observed_spearman") - F.col("shuffled_spearman")),
        }
    )
    status = (
        F.when(F.col("pair_count") < minimum, "insufficient_pairs")
        .when(~eff, "insufficient_shuffle_pairs")
        .when(F.coalesce("pearson_drop", "spearman_drop").isNull(), "constant_series")
        .otherwise("computed")
    )
    return out.withColumn("status", status).select(
        *keys, "status", "pair_count", "observed_pearson", "observed_spearman", "shuffled_pearson", "shuffled_spearman", "pearson_drop", "spearman_drop"
    )


def pair_data_quality(pairs: DataFrame, config: CohortConfig | None = None, by_session: bool = True) -> DataFrame:
    """Counters of weak pairs per session and, with a NULL session, overall."""
    cfg = config or CohortConfig()
    low_quality = F.col("quality") < cfg.minimum_quality
    few = F.col("chat_message_count") < cfg.minimum_messages
    short = F.col("transcript_text_length") < cfg.minimum_text
    excluded = {
        "detected_divergence": F.col("detected_divergence"), "labeled_event": F.col("labeled_event"), "low_chat_volume": few, "low_quality": low_quality, "short_transcript": short,
    }
    # why pairs are no calm baseline: a pair counts under each of its reasons
    reasons = F.array_compact(F.array(*[F.when(F.count_if(c) > 0, F.struct(F.lit(n).alias("key"), F.count_if(c).alias("value"))) for n, c in excluded.items()]))
    grouped = pairs.rollup("session_id") if by_session else pairs.groupBy()
    return grouped.agg(
        F.when(F.size(reasons) > 0, F.map_from_entries(reasons)).alias("baseline_exclusion_counts"),
        F.count("*").alias("alignment_pair_count"),
        F.count_if("calm_baseline").alias("baseline_pair_count"),
        F.count_if("detected_divergence").alias("detected_divergence_count"),
        F.count_if("labeled_event").alias("labeled_event_pair_count"),
        F.count_if(F.col("label") == "none").alias("labeled_none_pair_count"),
        F.count_if(low_quality).alias("low_quality_alignment_count"),
        F.count_if(few).alias("low_chat_volume_count"),
        F.count_if(short).alias("short_transcript_count"),
        F.count_if(F.col("transcript_confidence") < 0.7).alias("low_transcript_confidence_count"),
        F.count_if(F.array_contains("quality_flags", "partial_overlap")).alias("partial_overlap_count"),
        r4(F.avg("quality")).alias("average_alignment_quality"),
    )


def source_data_quality(transcripts: DataFrame) -> DataFrame:
    """Empty and unscored transcript buckets per session and overall."""
    return transcripts.rollup("session_id").agg(
        F.count("*").alias("transcript_bucket_count"),
        F.count_if(strip(F.coalesce("text", F.lit(""))) == "").alias("empty_transcript_count"),
        F.count_if(F.col("sentiment_score").isNull()).alias("missing_transcript_sentiment_count"),
    )


def validation_sample(pairs: DataFrame, per_cohort: int = 10) -> DataFrame:
    """The most telling pairs of each cohort for manual review."""
    names = F.array_compact(
        F.array(
            F.when(F.col("detected_divergence"), "detected_divergence"),
            F.when(F.col("labeled_event"), "labeled_event"),
            F.when(F.col("calm_baseline"), "stable_baseline"),
        )
    )
    rows = pairs.withColumn("sample_cohort", F.explode(names))
    key = F.when(F.col("sample_cohort") == "stable_baseline", F.col("quality")).otherwise(F.abs("delta"))
    w = Window.partitionBy("sample_cohort").orderBy(F.desc("_key"), "window_start", "session_id", "channel_id")
    return rows.withColumn("_key", key).withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_cohort).drop("_key")


def pair_evidence(pairs: DataFrame, chat: DataFrame, transcripts: DataFrame, messages: int = 3, terms: int = 5) -> DataFrame:
    """Evidence of a pair: the alignment itself, its strongest messages, top terms and the transcript text."""
    stream = ["session_id", "channel_id"]
    c = chat.select(*stream, F.col("bucket_start").alias("chat_bucket_start"), F.col("bucket_end").alias("chat_bucket_end"), "message_scores", "top_terms")
    t = transcripts.select(*stream, F.col("bucket_start").alias("transcript_bucket_start"), F.col("bucket_end").alias("transcript_bucket_end"), F.col("text").alias("_speech"))
    joined = pairs.join(c, [*stream, "chat_bucket_start", "chat_bucket_end"], "left").join(t, [*stream, "transcript_bucket_start", "transcript_bucket_end"], "left")

    def item(source: str, text: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), text.alias("text"))

    none = F.array().cast("array<struct<source:string,text:string>>")
    own = F.format_string("relationship=%s; delta=%.4f; quality=%.4f", "relationship", "delta", "quality")
    order = F.transform("message_scores", lambda m: F.struct((-F.abs(m["sentiment_score"])).alias("a"), m["timestamp"].alias("b"), m["text"].alias("text")))
    said = F.transform(F.slice(F.array_sort(order), 1, messages), lambda s: item("chat", s["text"]))
    words = F.when(F.size("top_terms") > 0, F.array(item("chat_terms", F.array_join(F.slice("top_terms", 1, terms), ", "))))
    speech = F.when(F.col("_speech").isNotNull(), F.array(item("transcript", strip("_speech"))))
    evidence = F.concat(F.array(item("alignment", own)), F.coalesce(said, none), F.coalesce(words, none), F.coalesce(speech, none))
    return joined.withColumn("evidence", evidence).drop("message_scores", "top_terms", "_speech")
