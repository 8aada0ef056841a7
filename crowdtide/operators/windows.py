"""Tumbling and sliding window aggregation of chat messages.

Two-level aggregation throughout: rows are first reduced per (window, user) or (window, text), with a map-side
partial step, and only the reduced rows meet per window. A window, channel or user holding a third of the input
is therefore spread over many tasks. The same code runs on streams: no DISTINCT aggregate is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtide.functions.lexicons import BUCKET_STOP_WORDS, ReactionLexicon
from crowdtide.functions.numbers import clamp, clamp01, ratio, round_half_away
from crowdtide.functions.text import (
    collapse_spaces,
    first_non_empty,
    is_short_burst,
    phrase_hits,
    punctuation_burst,
    sentiment_label,
    term_hits,
    tokens,
    uppercase_ratio,
    valence,
    words_lit,
)
from crowdtide.sources.storage import settle

STREAM = ["session_id", "channel_id"]
BUCKET = [*STREAM, "bucket_start", "bucket_end"]
RWINDOW = [*STREAM, "window_start", "window_end"]


def with_bucket(messages: DataFrame, seconds: int) -> DataFrame:
    """Attach the tumbling window of each message."""
    return (
        messages.withColumn("window", F.window("timestamp", f"{seconds} seconds"))
        .withColumns({"bucket_start": F.col("window.start"), "bucket_end": F.col("window.end")})
        .drop("window")
    )


def chat_buckets(messages: DataFrame, seconds: int = 30) -> DataFrame:
    """Count, distinct chatters, mean sentiment and label shares per tumbling window."""
    label = sentiment_label(F.col("score"), F.col("label"))
    key = [*STREAM, F.window("timestamp", f"{seconds} seconds").alias("window")]
    per_user = messages.withColumn("_label", label).groupBy(*key, "username").agg(
        F.count("*").alias("n"),
        F.sum("score").alias("score"),
        F.sum("confidence").alias("confidence"),
        F.sum((F.col("_label") == "positive").cast("long")).alias("pos"),
        F.sum((F.col("_label") == "negative").cast("long")).alias("neg"),
    )
    total = F.sum("n")
    return (
        per_user.groupBy(*STREAM, "window")
        .agg(
            total.alias("message_count"),
            F.count("*").alias("unique_chatters"),
            ratio(F.sum("score"), total).alias("chat_sentiment"),
            ratio(F.sum("confidence"), total).alias("sentiment_confidence"),
            ratio(F.sum("pos"), total).alias("positive"),
            ratio(total - F.sum("pos") - F.sum("neg"), total).alias("neutral"),
            ratio(F.sum("neg"), total).alias("negative"),
        )
        .withColumns({"bucket_start": F.col("window.start"), "bucket_end": F.col("window.end")})
        .select(*BUCKET, "message_count", "unique_chatters", "chat_sentiment", "sentiment_confidence", "positive", "neutral", "negative")
    )


def _top_n(items: DataFrame, n: int, item: str, out: str) -> DataFrame:
    counts = items.groupBy(*BUCKET, item).agg(F.count("*").alias("cnt"))
    order = Window.partitionBy(*BUCKET).orderBy(F.desc("cnt"), item)
    top = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    ranked = F.array_sort(F.collect_list(F.struct("rn", item)))
    return top.groupBy(*BUCKET).agg(F.transform(ranked, lambda s: s[item]).alias(out))


def top_terms(messages: DataFrame, seconds: int = 30, n: int = 5, stop_words: tuple[str, ...] = BUCKET_STOP_WORDS) -> DataFrame:
    """The n most frequent words of each bucket, ties by word."""
    words = with_bucket(messages, seconds).select(*BUCKET, F.explode(tokens(F.col("text"))).alias("term"))
    return _top_n(words.where((F.char_length("term") >= 3) & ~F.col("term").isin(*stop_words)), n, "term", "top_terms")


def top_emotes(messages: DataFrame, seconds: int = 30, n: int = 5) -> DataFrame:
    items = with_bucket(messages, seconds).select(*BUCKET, F.explode("emotes").alias("emote"))
    return _top_n(items.where(F.col("emote") != ""), n, "emote", "top_emotes")


def language_shares(messages: DataFrame, seconds: int = 30) -> DataFrame:
    """Long form of the language mix: one row per bucket and language."""
    language = F.coalesce(first_non_empty(F.col("language")), F.lit("other"))
    counts = with_bucket(messages, seconds).groupBy(*BUCKET, language.alias("language")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*BUCKET))))


def language_mix(messages: DataFrame, seconds: int = 30) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct("language", "share")))
    return language_shares(messages, seconds).groupBy(*BUCKET).agg(F.map_from_entries(entries).alias("language_mix"))


def chatter() -> Column:
    """Who a message counts for in reaction windows: case-folded user name, else the display name."""
    name = F.trim(F.coalesce("username", F.lit("")))
    shown = F.trim(F.coalesce("display_name", F.lit("")))
    return F.lower(F.when(name != "", name).otherwise(shown))


def message_features(messages: DataFrame, lex: ReactionLexicon | None = None) -> DataFrame:
    """Per-message inputs of the reaction formulas; a narrow projection."""
    lex = lex or ReactionLexicon()
    text = F.coalesce("text", F.lit(""))
    tok = F.col("_tok")
    emotes = F.coalesce(F.size("emotes"), F.lit(0))
    base = messages.withColumn("_tok", F.array_distinct(tokens(text)))
    hype, confusion, frustration = (term_hits(tok, t) for t in (lex.hype, lex.confusion, lex.frustration))
    return base.withColumns(
        {
            "_chatter": chatter(),
            "_text": collapse_spaces(F.lower(text)),
            "_hype": hype + phrase_hits(text, lex.phrases) + emotes,
            "_confusion": confusion + text.contains("?").cast("int") + text.contains("???").cast("int") * 2,
            "_frustration": frustration,
            "_short": is_short_burst(text).cast("int"),
            "_caps": uppercase_ratio(text),
            "_punct": punctuation_burst(text),
            "_valence": valence(tok, lex.valence),
            "_words": F.filter(F.array_except(tok, words_lit(lex.target_stop_words)), lambda t: F.char_length(t) >= 3),
            "_evidence": hype * 1.2
            + confusion * 1.1
            + frustration * 1.1
            + uppercase_ratio(text) * 0.5
            + punctuation_burst(text) * 0.3
            + emotes * 0.4,
        }
    )


def sliding(messages: DataFrame, seconds: int, slide: int, time_col: str = "timestamp") -> DataFrame:
    return messages.withColumn("window", F.window(time_col, f"{seconds} seconds", f"{slide} seconds"))


def _with_window_bounds(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def as_current_and_previous(features: DataFrame, seconds: int) -> DataFrame:
    """Each message counts for its own window and, shifted by one window length, as the past of the next one."""
    roles = F.array(
        F.struct(F.col("timestamp").alias("ets"), F.lit(True).alias("current")),
        F.struct((F.col("timestamp") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("ets"), F.lit(False).alias("current")),
    )
    return features.withColumn("_role", F.explode(roles)).withColumns(
        {"ets": F.col("_role.ets"), "current": F.col("_role.current")}
    ).drop("_role")


MESSAGE = ("message_id", "timestamp", "username", "display_name", "text")


def _facts() -> Column:
    """What a message is counted under: its text, its author, each word it may be about, and itself as evidence."""
    def fact(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    # messages that share an id are told apart by the rest of them
    own = F.concat_ws("|", "message_id", F.xxhash64(*MESSAGE).cast("string"))
    two = F.array(fact("text", F.col("_text")), fact("user", F.col("_chatter")), fact("best", own))
    return F.concat(two, F.transform("_words", lambda t: fact("token", t)))


def _evidence_entry() -> Column:
    """A message as evidence; the least entry is the strongest, the earliest of equals."""
    return F.struct((-F.col("_evidence")).alias("neg"), "timestamp", "message_id", "username", "display_name", "text")


def reaction_features(features: DataFrame, seconds: int = 5, slide: int = 1, watermark: str | None = None) -> DataFrame:
    """Sums, repeated texts and distinct chatters per sliding window, without a self join.

    Every message is emitted under several keys, see ``_facts``. The first aggregation is per (window, kind, key) and its
    counts give both the repeats and the distinct chatters of the second. A batch first adds up its messages in panes, so
    that panes, not messages, are multiplied into windows; a stream, which cannot chain a third aggregation on another
    time column, expands its messages. It also reports each window's shared word and strongest messages.

    The state of a stream has no row per message or chatter: tasks hand on the strongest messages of a pane only, and the
    chatters of a window are sets, one to each of ``PLACES`` places by hash.
    """
    if watermark is None:
        return _window_totals(_expand_panes(_panes(features, seconds, slide), seconds, slide), F.col("people"))
    rows = as_current_and_previous(_with_strongest(features, math.gcd(seconds, slide)), seconds)
    rows = rows.withWatermark("ets", watermark)
    current, strong = F.col("current"), F.col("_strong")
    # the messages' own rows count, those repeated as strongest are evidence only
    wanted = F.filter(_stream_facts(), lambda f: F.when(strong, current & (f["kind"] == "best")).otherwise(f["kind"].isin("text", "user") | (current & (f["kind"] == "token"))))
    rows = rows.select(*STREAM, "ets", "current", F.explode(wanted).alias("_fact"))
    is_text, is_user = F.col("_fact.kind") == "text", F.col("_fact.kind") == "user"
    mine = is_text & current

    def total(name: str) -> Column:
        return F.sum(F.when(mine, F.col(f"_fact.sums.{name}"))).alias(name)

    window = F.window("ets", f"{seconds} seconds", f"{slide} seconds").alias("window")
    kind = F.when(~is_user, F.col("_fact.kind")).when(current, "now").otherwise("before")
    per_key = rows.groupBy(*STREAM, window, kind.alias("kind"), F.when(~is_text | current, F.col("_fact.key")).alias("key")).agg(
        F.sum(F.when(current & ~is_user, 1).otherwise(0)).alias("n"),
        F.sum(F.when(is_text & ~current, 1).otherwise(0)).alias("n_prev"),
        *[total(c) for c in _SUMS],
        F.sum(F.when(mine & F.col("_fact.sums._valence").isNotNull(), 1).otherwise(0)).alias("_valence_n"),
        F.min("_fact.first").alias("first"),
        F.collect_list("_fact.entry").alias("entries"),
        F.collect_set(F.when(F.col("_fact.user") != "", F.col("_fact.user"))).alias("users"),
    )
    target = F.min(F.when((F.col("kind") == "token") & (F.col("n") >= 2), _target_entry()))
    entries = F.flatten(F.collect_list(F.when(F.col("kind") == "best", F.col("entries"))))
    return _window_totals(per_key, F.size("users"), {"best": target, "entries": F.slice(F.array_sort(entries), 1, TOP)})


#: Places that the chatters of a streamed window are dealt to.
PLACES = 64
#: Messages a task of a stream holds while it looks for the strongest.
HELD = 1 << 16


def _stream_facts() -> Column:
    """``_facts`` with what each is aggregated from, and nothing else, so that rows stay narrow."""

    def fact(kind: str, key: Column) -> Column:
        def only(of: str, value: Column) -> Column:
            return F.when(F.lit(kind == of), value)

        return F.struct(
            F.lit(kind).alias("kind"), key.cast("string").alias("key"), only("user", F.col("_chatter")).alias("user"),
            only("text", F.struct(*_SUMS)).alias("sums"), only("token", F.struct("timestamp", "message_id")).alias("first"), only("best", _evidence_entry()).alias("entry"),
        )

    place = F.pmod(F.xxhash64("_chatter"), F.lit(PLACES))
    three = F.array(fact("text", F.col("_text")), fact("user", place), fact("best", F.lit("")))
    return F.concat(three, F.transform("_words", lambda t: fact("token", t)))


def _strongest(held: pa.Table, pane: int) -> pa.Table:
    """The ``TOP`` strongest messages of each stream and pane, as ``_evidence_entry`` orders them."""
    at = held["timestamp"].cast(pa.int64()).to_numpy() // pane
    groups = [pc.fill_null(held[c].combine_chunks().dictionary_encode().indices, -1) for c in STREAM]
    texts = ("message_id", "username", "display_name", "text")
    rows = pa.table([*groups, pa.array(at), pc.negate(held["_evidence"]), held["timestamp"], *(held[c] for c in texts)], names=[*STREAM, "pane", "neg", "timestamp", *texts])
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in rows.column_names], null_placement="at_start").to_numpy()
    first = np.ones(len(order), bool)
    first[1:] = False
    for g in (*(np.asarray(x) for x in groups), at):
        first[1:] |= np.diff(g[order]) != 0
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - starts[np.cumsum(first) - 1]
    return held.take(pa.array(order[rank < TOP]))


def _with_strongest(features: DataFrame, pane: int) -> DataFrame:
    """All messages, and once more, marked ``_strong``, those that are among the strongest of their pane in their task.

    The strongest of a window are among the strongest of its panes, whichever task holds them.
    """
    columns = [*STREAM, *MESSAGE, "_chatter", "_text", "_words", "_evidence", *_SUMS]
    rows = features.where("timestamp IS NOT NULL").select(*columns, F.lit(False).alias("_strong"))
    rows = rows.withColumn("_evidence", F.col("_evidence").cast("double"))
    width = pane * 1_000_000

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked(few: pa.Table) -> list[pa.RecordBatch]:
            at = few.column_names.index("_strong")
            return few.set_column(at, few.schema.field(at), pa.array(np.ones(few.num_rows, bool))).to_batches()

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            yield batch
            held.append(batch)
            size += batch.num_rows
            if size > HELD:
                few = _strongest(pa.Table.from_batches(held), width)
                held, size = few.to_batches(), few.num_rows
                if size > HELD // 2:
                    yield from marked(few)
                    held, size = [], 0
        if size:
            yield from marked(_strongest(pa.Table.from_batches(held), width))

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    return rows.mapInArrow(mark, schema)


#: Evidence messages of a window.
TOP = 5
_SUMS = ("_hype", "_confusion", "_frustration", "_short", "_caps", "_punct", "_valence")


def _panes(features: DataFrame, seconds: int, slide: int, kinds: tuple[str, ...] = ("text", "user")) -> DataFrame:
    """Messages added up per (pane, kind, key); a pane is the largest span that no window cuts."""
    pane = math.gcd(seconds, slide)
    facts = F.filter(_facts(), lambda f: f["kind"].isin(*kinds))
    rows = features.withColumns({"pane": F.unix_micros(F.window("timestamp", f"{pane} seconds")["start"]), "_fact": F.explode(facts)})
    is_text = F.col("_fact.kind") == "text"
    more = {
        "token": F.min(F.when(F.col("_fact.kind") == "token", F.struct("timestamp", "message_id"))).alias("first"),
        "best": F.min(F.when(F.col("_fact.kind") == "best", _evidence_entry())).alias("entry"),
    }
    return rows.groupBy(*STREAM, "pane", F.col("_fact.kind").alias("kind"), F.col("_fact.key").alias("key")).agg(
        F.count("*").alias("n"),
        *[F.sum(F.when(is_text, F.col(c))).alias(c) for c in _SUMS],
        F.count(F.when(is_text, F.col("_valence"))).alias("_valence_n"),
        *[more[k] for k in more if k in kinds],
    )


def _window_starts(at: Column, seconds: int, slide: int) -> Column:
    """Starts of the windows that hold a pane; windows may leave gaps between them, then some panes are in none."""
    step, span, pane = slide * 1_000_000, seconds * 1_000_000, math.gcd(seconds, slide) * 1_000_000
    first, last = F.ceil((at + pane - span) / F.lit(step)), F.floor(at / F.lit(step))
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * step)).otherwise(F.array().cast("array<bigint>"))


def _window_of(start: Column, seconds: int) -> Column:
    start = F.timestamp_micros(start)
    return F.struct(start.alias("start"), (start + F.expr(f"INTERVAL {seconds} SECONDS")).alias("end")).alias("window")


def _in_windows(panes: DataFrame, seconds: int, slide: int) -> DataFrame:
    """Each pane in the windows that hold it and, moved by one window length, as the past of the next ones."""

    def role(at: Column, current: bool) -> Column:
        return F.transform(_window_starts(at, seconds, slide), lambda w: F.struct(w.alias("at"), F.lit(current).alias("current")))

    p = F.col("pane").cast("long")
    return panes.withColumn("_in", F.explode(F.concat(role(p, True), role(p + seconds * 1_000_000, False))))


def _pane_chatters(panes: DataFrame, seconds: int, slide: int) -> DataFrame:
    """Distinct chatters per window and of its past, without a row per window and chatter.

    A chatter counts in the first pane of a window that has them: the one whose predecessor lies before the window. So
    chatters are first counted per pane and predecessor.
    """
    span = seconds * 1_000_000
    users = panes.where((F.col("kind") == "user") & (F.col("key") != "")).select(*STREAM, F.col("pane").cast("long").alias("pane"), "key")
    before = F.lag("pane").over(Window.partitionBy(*STREAM, "key").orderBy("pane"))
    users = users.withColumn("_last", before).withColumn("_last", F.when(F.col("pane") - F.col("_last") < span, F.col("_last")))
    rows = _in_windows(users.groupBy(*STREAM, "pane", "_last").agg(F.count("*").alias("people")), seconds, slide)
    current, at = F.col("_in.current"), F.col("_in.at")
    rows = rows.where(F.col("_last").isNull() | (F.col("_last") < F.when(current, at).otherwise(at - span)))
    return rows.groupBy(*STREAM, _window_of(at, seconds), F.when(current, "now").otherwise("before").alias("kind"), F.lit("all").alias("key")).agg(F.sum("people").alias("people"))


def _expand_panes(panes: DataFrame, seconds: int, slide: int) -> DataFrame:
    """Counts per (window, kind, key): texts, and the chatters of a window as one."""
    rows = _in_windows(panes.where("kind = 'text'"), seconds, slide)
    current = F.col("_in.current")
    texts = rows.groupBy(*STREAM, _window_of(F.col("_in.at"), seconds), F.col("kind"), F.when(current, F.col("key")).alias("key")).agg(
        F.sum(F.when(current, F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(~current, F.col("n")).otherwise(0)).alias("n_prev"),
        *[F.sum(F.when(current, F.col(c))).alias(c) for c in (*_SUMS, "_valence_n")],
    )
    return texts.unionByName(_pane_chatters(panes, seconds, slide), allowMissingColumns=True)


def _window_totals(per_key: DataFrame, chatters: Column, more: dict[str, Column] | None = None) -> DataFrame:
    """Windows from their counts per (kind, key). ``chatters``: how many a key stands for."""
    named = F.col("key").isNotNull() & (F.col("key") != "")
    return (
        per_key.groupBy(*STREAM, "window")
        .agg(
            F.sum(F.when(F.col("kind") == "text", F.col("n")).otherwise(0)).alias("message_count"),
            F.sum("n_prev").alias("previous_count"),
            F.sum(F.when((F.col("kind") == "text") & named & (F.col("n") > 1), F.col("n")).otherwise(0)).alias("repeated"),
            F.sum(F.when((F.col("kind") == "now") & named, chatters).otherwise(0)).alias("unique_chatters"),
            F.sum(F.when((F.col("kind") == "before") & named, chatters).otherwise(0)).alias("previous_chatters"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c[1:]) for c in (*_SUMS, "_valence_n")],
            *[c.alias(name) for name, c in (more or {}).items()],
        )
        .transform(_with_window_bounds)
        .where(F.col("message_count") > 0)
    )


def velocity_and_spike(agg: DataFrame, seconds: int) -> DataFrame:
    """Rate, change of rate and growth of the crowd against the preceding window."""
    span = float(max(seconds, 1))
    rate = F.col("message_count") / span * 60
    prev = F.col("previous_count") / span * 60
    base = clamp01(rate / 120)
    velocity = F.when(prev > 0, clamp01(F.greatest(base, (rate - prev) / F.greatest(prev, F.lit(1.0))))).otherwise(base)
    cur_c, prev_c = F.col("unique_chatters"), F.col("previous_chatters")
    spike = (
        F.when(cur_c == 0, F.lit(0.0))
        .when(prev_c == 0, clamp01(cur_c / 10))
        .otherwise(clamp01((cur_c - prev_c) / F.greatest(prev_c, F.lit(1))))
    )
    return agg.withColumns({"messages_per_minute": rate, "velocity": velocity, "unique_spike": spike})


def reaction_scores(agg: DataFrame) -> DataFrame:
    """Unrounded hype, confusion, frustration, intensity and valence."""
    n = F.greatest(F.col("message_count"), F.lit(1)).cast("double")
    caps, punct, short = F.col("caps") / n, F.col("punct") / n, F.col("short") / n
    repeat = F.when(F.col("message_count") <= 1, 0.0).otherwise(F.col("repeated") / n)
    mean_valence = F.coalesce(ratio(F.col("valence"), F.col("valence_n")), F.lit(0.0))
    boost = F.when(F.col("valence") < 0, clamp01(F.abs(mean_valence) * 0.25)).otherwise(0.0)
    return agg.withColumns(
        {
            "repeat_ratio": repeat,
            "hype_score": clamp01(F.col("hype") / n * 1.8 + short * 0.2 + repeat * 0.25 + caps * 0.3),
            "confusion_score": clamp01(F.col("confusion") / n * 1.5),
            "frustration_score": clamp01(F.col("frustration") / n * 1.5 + boost),
            "intensity_score": clamp01(
                F.col("velocity") * 0.35 + caps * 0.2 + punct * 0.18 + repeat * 0.15 + F.col("unique_spike") * 0.12
            ),
            "valence": clamp(mean_valence, -1.0, 1.0),
        }
    )


def reaction_type(hype: Column, confusion: Column, frustration: Column, intensity: Column) -> Column:
    """Name of the largest score, earlier names winning ties; neutral below 0.2."""
    scores = [("hype", hype), ("confusion", confusion), ("frustration", frustration), ("intensity", intensity)]
    best = F.greatest(*[s for _, s in scores])
    out = F.when(best < 0.2, "neutral")
    for name, score in scores:
        out = out.when(score == best, name)
    return out


def reaction_confidence(kind: Column, hype: Column, confusion: Column, frustration: Column, intensity: Column) -> Column:
    own = F.when(kind == "hype", hype).when(kind == "confusion", confusion).when(kind == "frustration", frustration)
    return clamp01(own.when(kind == "intensity", intensity).otherwise(intensity * 0.5))


def event_hint(kind: Column, target: Column) -> Column:
    return F.when(F.coalesce(target, F.lit("")) == "", kind).otherwise(F.concat_ws(":", kind, target))


def finish_reaction(scored: DataFrame) -> DataFrame:
    """Type and confidence from the unrounded scores, then three-digit rounding."""
    parts = [F.col(f"{c}_score") for c in ("hype", "confusion", "frustration", "intensity")]
    typed = scored.withColumn("reaction_type", reaction_type(*parts))
    typed = typed.withColumn("raw_confidence", reaction_confidence(F.col("reaction_type"), *parts))
    rounded = {c: round_half_away(F.col(c)) for c in ("messages_per_minute", "hype_score", "confusion_score", "frustration_score", "intensity_score", "valence")}
    return typed.withColumns(
        {
            **rounded,
            "velocity_score": round_half_away(F.col("velocity")),
            "confidence": round_half_away(F.col("raw_confidence")),
        }
    )


REACTION_COLUMNS = [
    *RWINDOW,
    "message_count",
    "unique_chatters",
    "messages_per_minute",
    "velocity_score",
    "hype_score",
    "intensity_score",
    "confusion_score",
    "frustration_score",
    "valence",
    "reaction_type",
    "confidence",
]


def _scored(agg: DataFrame, seconds: int) -> DataFrame:
    return finish_reaction(reaction_scores(velocity_and_spike(agg, seconds)))


def reaction_core(messages: DataFrame, seconds: int = 5, slide: int = 1, lex: ReactionLexicon | None = None, watermark: str | None = None) -> DataFrame:
    """Scored reaction windows. On a stream (``watermark``) they are whole, with target, hint and evidence; for a batch
    ``reaction_windows`` adds those."""
    scored = _scored(reaction_features(message_features(messages, lex), seconds, slide, watermark), seconds)
    return scored if watermark is None else _with_context(scored)


def _target_entry() -> Column:
    """A shared word; the least entry is in most messages, then seen first."""
    return F.struct((-F.col("n")).alias("neg"), "first", F.col("key").alias("token"))


def _target(total: Column) -> Column:
    """The word of the best entry, if it is in 40 % of the messages."""
    return F.when(-F.col("best.neg") / total >= 0.4, F.col("best.token"))


def _evidence_ids(entries: str) -> Column:
    return F.array_distinct(F.filter(F.transform(entries, lambda e: e["message_id"]), lambda i: i != ""))


def _evidence_messages(entries: str) -> Column:
    return F.transform(entries, lambda e: F.struct(*[e[c].alias(c) for c in MESSAGE]))


def _pane_targets(panes: DataFrame, seconds: int, slide: int) -> DataFrame:
    """(window, best): the word that most messages of a window share, of those in two or more."""
    rows = panes.where("kind = 'token'").withColumn("_at", F.explode(_window_starts(F.col("pane").cast("long"), seconds, slide)))
    counts = rows.groupBy(*STREAM, _window_of(F.col("_at"), seconds), "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return counts.where("n >= 2").groupBy(*STREAM, "window").agg(F.min(_target_entry()).alias("best")).transform(_with_window_bounds)


def _pane_evidence(panes: DataFrame, seconds: int, slide: int, n: int) -> DataFrame:
    """(window, entries): the strongest messages of a window, from the strongest of each pane."""
    rows = panes.where("kind = 'best'").select(*STREAM, "pane", "entry", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(n)).cast("int"))).alias("_copy"))
    best = Window.partitionBy(*STREAM, "pane").orderBy("entry")
    few = rows.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= n)
    spread = few.select(*STREAM, "entry", F.explode(_window_starts(F.col("pane").cast("long"), seconds, slide)).alias("_at")).withColumn("window", _window_of(F.col("_at"), seconds))
    order = Window.partitionBy(*STREAM, "window").orderBy("entry")
    top = spread.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    return top.groupBy(*STREAM, "window").agg(F.array_sort(F.collect_list("entry")).alias("entries")).transform(_with_window_bounds)


def window_target(messages: DataFrame, seconds: int = 5, slide: int = 1, lex: ReactionLexicon | None = None) -> DataFrame:
    """The word most messages of a window share: in at least two messages and 40 % of them; null without one."""
    panes = settle(_panes(message_features(messages, lex), seconds, slide, ("token", "text")), "panes")
    sizes = panes.where("kind = 'text'").groupBy(*STREAM, "pane").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumn("_at", F.explode(_window_starts(F.col("pane").cast("long"), seconds, slide)))
    sizes = sizes.groupBy(*STREAM, _window_of(F.col("_at"), seconds)).agg(F.sum("n").alias("total")).transform(_with_window_bounds)
    found = sizes.join(_pane_targets(panes, seconds, slide), RWINDOW, "left")
    return found.select(*RWINDOW, _target(F.col("total")).alias("target_text"))


def top_evidence(messages: DataFrame, seconds: int = 5, slide: int = 1, n: int = TOP, lex: ReactionLexicon | None = None) -> DataFrame:
    """The n messages of each window with the highest evidence score, earliest first on ties, and their ids."""
    panes = _panes(message_features(messages, lex), seconds, slide, ("best",))
    found = _pane_evidence(panes, seconds, slide, n)
    return found.select(*RWINDOW, _evidence_ids("entries").alias("evidence_ids"), _evidence_messages("entries").alias("evidence_messages"))


CONTEXT_COLUMNS = ["target_type", "target_text", "source", "event_hint", "evidence_ids", "evidence_messages"]


def _with_context(scored: DataFrame) -> DataFrame:
    """Target, hint and evidence from the ``best`` word and the evidence ``entries`` of scored windows."""
    weak = (F.col("reaction_type") == "neutral") | (F.col("raw_confidence") < 0.35)
    named = scored.withColumn("target_text", F.when(weak, "").otherwise(F.coalesce(_target(F.col("message_count")), F.lit(""))))
    named = named.withColumns(
        {
            "target_type": F.lit("unknown"), "source": F.lit("chat"), "event_hint": event_hint(F.col("reaction_type"), F.col("target_text")),
            "evidence_ids": _evidence_ids("entries"), "evidence_messages": _evidence_messages("entries"),
        }
    )
    return named.select(*REACTION_COLUMNS, *CONTEXT_COLUMNS)


def reaction_windows(messages: DataFrame, seconds: int = 5, slide: int = 1, lex: ReactionLexicon | None = None) -> DataFrame:
    """Full reaction windows: scores, type, shared target word, hint, evidence ids and messages.

    Messages are read once and added up in panes, which are stored; scores, targets and evidence come from the panes.
    """
    panes = settle(_panes(message_features(messages, lex), seconds, slide, ("text", "user", "token", "best")), "panes")
    counted = panes.where("kind IN ('text', 'user')").drop("first", "entry")
    scored = _scored(_window_totals(_expand_panes(counted, seconds, slide), F.col("people")), seconds)
    scored = scored.join(_pane_targets(panes, seconds, slide), RWINDOW, "left").join(_pane_evidence(panes, seconds, slide, TOP), RWINDOW, "left")
    return _with_context(scored)


EVIDENCE_TYPE = "array<struct<message_id:string,timestamp:timestamp,username:string,display_name:string,text:string>>"


def peak_score() -> Column:
    return F.greatest("intensity_score", "hype_score", "confusion_score", "frustration_score")


def bucket_peaks(windows: DataFrame, seconds: int = 30) -> DataFrame:
    """Reaction windows lying inside one bucket, nested, with the peak (latest end wins ties).

    A bucket nests at most seconds/slide windows, so the lists are bounded by the window layout.
    """
    inside = windows.withColumn("bucket_start", F.window("window_start", f"{seconds} seconds")["start"]).where(
        F.col("window_end") <= F.col("bucket_start") + F.expr(f"INTERVAL {seconds} SECONDS")
    )
    sub = F.struct(
        "window_start", "window_end", "message_count", peak_score().alias("reaction_score"), "hype_score", "intensity_score",
        "confusion_score", "frustration_score", "reaction_type", "target_type", "target_text", "source", "event_hint",
        "confidence", "evidence_ids",
    )
    messages = F.col("evidence_messages") if "evidence_messages" in windows.columns else F.array().cast(EVIDENCE_TYPE)
    peak = F.max(F.struct(peak_score().alias("score"), F.col("window_end").alias("at"), sub.alias("w"), messages.alias("m")))
    grouped = inside.groupBy(*STREAM, "bucket_start").agg(F.array_sort(F.collect_list(sub)).alias("subwindows"), peak.alias("peak"))
    return grouped.select(
        *STREAM,
        "bucket_start",
        "subwindows",
        F.col("peak.score").alias("peak_reaction_score"),
        *[F.col(f"peak.w.{c}").alias(f"peak_{c}") for c in ("reaction_type", "target_type", "target_text", "source", "event_hint", "confidence", "evidence_ids")],
        F.col("peak.m").alias("peak_evidence_messages"),
        F.col("peak.at").alias("peak_time"),
        F.col("peak.w.window_start").alias("peak_window_start"),
        F.col("peak.w.window_end").alias("peak_window_end"),
    )


def attach_peaks(buckets: DataFrame, windows: DataFrame, seconds: int = 30) -> DataFrame:
    """Buckets with their nested reaction windows and peak fields."""
    return buckets.join(bucket_peaks(windows, seconds), [*STREAM, "bucket_start"], "left").withColumns(
        {
            "peak_target_type": F.coalesce("peak_target_type", F.lit("unknown")),
            "peak_source": F.coalesce("peak_source", F.lit("chat")),
            "peak_evidence_ids": F.coalesce("peak_evidence_ids", F.array().cast("array<string>")),
            "peak_evidence_messages": F.coalesce("peak_evidence_messages", F.array().cast(EVIDENCE_TYPE)),
        }
    )


def repeat_ratio(messages: DataFrame, seconds: int = 30) -> DataFrame:
    """Share of messages whose text occurs more than once in the bucket."""
    text = collapse_spaces(F.lower(F.coalesce("text", F.lit(""))))
    counts = with_bucket(messages, seconds).groupBy(*BUCKET, text.alias("t")).agg(F.count("*").alias("n"))
    repeated = F.sum(F.when((F.col("n") > 1) & (F.col("t") != ""), F.col("n")).otherwise(0))
    return counts.groupBy(*BUCKET).agg(
        F.sum("n").alias("message_count"),
        F.when(F.sum("n") <= 1, 0.0).otherwise(ratio(repeated, F.sum("n"))).alias("repeat_ratio"),
    )
