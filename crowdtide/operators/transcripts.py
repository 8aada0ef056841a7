"""Speech segments and transcript buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crowdtide.functions.lexicons import SIGNAL_STOP_WORDS
from crowdtide.functions.numbers import ratio
from crowdtide.functions.text import bigrams, collapse_spaces, let, strip, tokens

STREAM = ["session_id", "channel_id"]


#: Tasks that share the segments of one stream when they meet its start.
SALTS = 16


def session_start(segments: DataFrame) -> DataFrame:
    """First audio of each stream; one small row per session."""
    return segments.groupBy(*STREAM).agg(F.min("segment_start").alias("audio_start"))


def bucket_index(seconds: int) -> Column:
    offset = F.unix_micros("segment_start") - F.unix_micros("audio_start")
    return F.floor(offset / F.lit(seconds * 1_000_000))


def joined_text() -> Column:
    """Aggregate: texts of the segments in time order, stripped, blank ones left out."""
    spoken = F.when(strip("text") != "", F.struct("segment_start", "segment_id", strip("text").alias("text")))
    return F.array_join(F.transform(F.array_sort(F.collect_list(spoken)), lambda s: s["text"]), " ")


def transcript_buckets(segments: DataFrame, seconds: int = 30, latency: str = "last") -> DataFrame:
    """Tumbling buckets counted from the first audio of a session, with the text joined in time order.

    ``latency``: ``last`` keeps the newest recognition time of a bucket, ``sum`` adds them up (chunk mode).
    """
    # the start of a stream is copied to several places, so that the segments of a long stream fill several tasks
    starts = session_start(segments).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = segments.withColumn("_salt", F.pmod(F.xxhash64("segment_id", "segment_start"), F.lit(SALTS)).cast("int"))
    indexed = salted.join(starts, [*STREAM, "_salt"]).drop("_salt").withColumn("idx", bucket_index(seconds))
    at = F.timestamp_micros(F.unix_micros("audio_start") + F.col("idx") * seconds * 1_000_000)
    newest = F.struct("segment_start", "segment_id")
    asr = F.max_by("asr_latency_ms", newest) if latency == "last" else F.sum("asr_latency_ms")
    base = F.unix_micros("bucket_start")
    seg = F.struct(
        ((F.unix_micros("segment_start") - base) / 1e6).alias("start"),
        ((F.unix_micros("segment_end") - base) / 1e6).alias("end"),
        strip("text").alias("text"),
        "confidence",
    )
    indexed = indexed.withColumn("bucket_start", at)
    return (
        indexed.groupBy(*STREAM, "bucket_start")
        .agg(
            joined_text().alias("text"),
            F.min("segment_start").alias("audio_started_at"),
            F.max("segment_end").alias("audio_ended_at"),
            F.max("confidence").alias("transcript_confidence"),
            F.count("*").alias("segment_count"),
            asr.alias("asr_latency_ms"),
            F.array_sort(F.collect_list(seg)).alias("segments"),
        )
        .withColumn("bucket_end", F.col("bucket_start") + F.expr(f"INTERVAL {seconds} SECONDS"))
    )


def interval_coverage(segments: DataFrame, key: list[str], start: str, end: str, length: str) -> DataFrame:
    """Covered seconds of possibly overlapping ranges clipped to [0, length], and the share left empty.

    ``start``/``end``/``length`` are seconds. Running maximum of the ends, islands at every gap.
    """
    lo = F.greatest(F.lit(0.0), F.least(F.col(start), F.col(length)))
    hi = F.greatest(F.lit(0.0), F.least(F.col(end), F.col(length)))
    order = Window.partitionBy(*key).orderBy("_lo", "_hi")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    clipped = segments.withColumns({"_lo": lo, "_hi": hi})
    # each range adds only what reaches beyond everything seen before it
    fresh = F.greatest(F.lit(0.0), F.col("_hi") - F.greatest("_lo", F.coalesce(F.max("_hi").over(before), F.col("_lo"))))
    covered = F.least(F.sum("_fresh"), F.max(length))
    return (
        clipped.withColumn("_fresh", F.when(F.col("_hi") > F.col("_lo"), fresh).otherwise(0.0))
        .groupBy(*key)
        .agg(F.max(length).alias("audio_seconds"), F.coalesce(covered, F.lit(0.0)).alias("covered_seconds"))
        .withColumn(
            "empty_ratio",
            F.when(
                F.col("audio_seconds") > 0,
                F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio(F.col("covered_seconds"), F.col("audio_seconds")))),
            ),
        )
    )


REPAIRING = ("pending", "queued")
FINAL = ("completed",)
DEGRADED = ("failed", "queue_full", "audio_read_failed", "audio_write_failed", "empty")
DISABLED = ("disabled", "no_audio")


def transcript_status(repair_status: Column, text: Column, repaired: Column) -> Column:
    s = F.lower(F.coalesce(repair_status, F.lit("")))
    return (
        F.when(s.isin(*REPAIRING), "repairing")
        .when(s.isin(*FINAL), "final")
        .when(s.isin(*DEGRADED), "degraded")
        .when(s.isin(*DISABLED), F.when(F.coalesce(text, F.lit("")) == "", "degraded").otherwise("final"))
        .otherwise(F.when(F.coalesce(repaired, F.lit(False)), "final").otherwise("live"))
    )


def status_from_quality(quality: Column) -> Column:
    """Status recorded in the free-form quality document, '' when it has none."""
    repair = F.lower(F.trim(F.get_json_object(quality, "$.repair_status")))
    derived = F.when(repair.isin(*REPAIRING), "repairing").when(repair.isin(*FINAL), "final").when(repair.isin(*DEGRADED), "degraded")
    return F.coalesce(F.get_json_object(quality, "$.status"), derived, F.lit(""))


def _quality_number(*names: str) -> Column:
    return F.coalesce(*[F.get_json_object("quality", f"$.{n}").try_cast("double") for n in names], F.lit(0.0))


def non_zero(x: Column) -> Column:
    return F.when(x != 0, x)


def audio_span() -> Column:
    span = (F.unix_micros("audio_ended_at") - F.unix_micros("audio_started_at")) / 1e6
    return F.when(F.col("audio_ended_at") > F.col("audio_started_at"), span)


def word_count(text: Column) -> Column:
    t = collapse_spaces(F.coalesce(text, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def backfill_transcript(buckets: DataFrame) -> DataFrame:
    """Fill missing completeness fields from the quality document, else from the bucket itself."""
    zero = F.lit(0.0)

    def first(*xs: Column) -> Column:
        return F.coalesce(*[non_zero(x) for x in xs], zero)

    def count(x: Column) -> Column:
        return x.cast("long")

    stage1 = buckets.withColumns(
        {
            "audio_seconds": first(F.col("audio_seconds"), _quality_number("audio_seconds", "audio_coverage_seconds"), audio_span()),
            "segment_count": count(first(F.col("segment_count"), F.floor(_quality_number("raw_segment_count", "retained_segment_count")), F.coalesce(F.size("segments"), F.lit(0)))),
            "word_count": count(first(F.col("word_count"), F.floor(_quality_number("word_count")), word_count(F.col("text")))),
            "repair_added_words": count(first(F.col("repair_added_words"), F.floor(_quality_number("repair_added_words")))),
            "repair_changed_ratio": first(F.col("repair_changed_ratio"), _quality_number("repair_changed_ratio")),
            "transcript_status": F.coalesce(F.when(F.col("transcript_status") != "", F.col("transcript_status")), status_from_quality(F.col("quality"))),
        }
    )
    silent = F.when((F.col("audio_seconds") > 0) & (F.col("word_count") == 0), 1.0)
    return stage1.withColumn("empty_ratio", F.coalesce(non_zero(F.col("empty_ratio")), non_zero(_quality_number("empty_ratio")), silent, zero))


def signal_terms(text: Column, stop_words: tuple[str, ...] = SIGNAL_STOP_WORDS) -> Column:
    return F.filter(tokens(text), lambda t: (F.char_length(t) >= 3) & ~t.isin(*stop_words))


def _most_repeated(items: DataFrame, key: list[str], out: str) -> DataFrame:
    """Item seen most often, at least twice, the first seen on ties. ``items``: key, item, pos."""
    counts = items.groupBy(*key, "item").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where(F.col("n") >= 2)
    return counts.groupBy(*key).agg(F.min_by("item", F.struct(-F.col("n"), "pos", "item")).alias(out))


def most_repeated_item(items: Column) -> Column:
    """Item of an array seen most often, at least twice, the first seen on ties; NULL without one.

    Sorting brings equal items together and one fold over the runs keeps the best, so a text never leaves its row.
    """
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
    none = F.lit(None).cast("string")
    zero = F.lit(0)
    start = F.struct(none.alias("k"), zero.alias("n"), zero.alias("i"), F.lit(1).alias("best_n"), zero.alias("best_i"), none.alias("best"))

    def step(acc: Column, e: Column) -> Column:
        same = acc["k"].eqNullSafe(e["k"])
        n = F.when(same, acc["n"] + 1).otherwise(F.lit(1))
        first = F.when(same, acc["i"]).otherwise(e["i"])
        better = (n > acc["best_n"]) | ((n > 1) & (n == acc["best_n"]) & (first < acc["best_i"]))
        return F.struct(
            e["k"].alias("k"), n.alias("n"), first.alias("i"), F.when(better, n).otherwise(acc["best_n"]).alias("best_n"),
            F.when(better, first).otherwise(acc["best_i"]).alias("best_i"), F.when(better, e["k"]).otherwise(acc["best"]).alias("best"),
        )

    return F.aggregate(keyed, start, step, lambda acc: acc["best"])


def transcript_target(texts: DataFrame, key: list[str], text: str = "text", stop_words: tuple[str, ...] = SIGNAL_STOP_WORDS) -> DataFrame:
    """Repeated word pair of a text, else its most repeated word; '' when nothing repeats. No shuffle."""
    terms = signal_terms(F.coalesce(F.col(text), F.lit("")), stop_words)
    target = let(terms, lambda w: F.coalesce(most_repeated_item(bigrams(w)), most_repeated_item(w), F.lit("")))
    return texts.select(*key, target.alias("target_text"))


def bucket_target(texts: DataFrame, key: list[str], stop_words: tuple[str, ...] = SIGNAL_STOP_WORDS) -> DataFrame:
    """Most repeated word over all texts of a bucket. ``texts``: key, pos (text order), text."""
    words = texts.select(*key, F.col("pos").alias("_p"), F.posexplode(signal_terms(F.col("text"), stop_words)).alias("_i", "item"))
    return _most_repeated(words.withColumn("pos", F.struct("_p", "_i")).drop("_p", "_i"), key, "target_text")


def neighbour_context(buckets: DataFrame) -> DataFrame:
    """Text of the previous and next transcript bucket of the same session."""
    w = Window.partitionBy("session_id").orderBy("bucket_start", "bucket_end", "channel_id")
    return buckets.withColumns({"previous_text": F.lag("text").over(w), "next_text": F.lead("text").over(w)})
