"""Event-log records: decoding, validation, type inference and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide import schemas
from crowdtide.functions.keys import rfc3339

# fixed values
TOPICS = {
    "chat_bucket": "stream.chat_buckets.v1",
    "transcript_bucket": "stream.transcript_buckets.v1",
    "analysis_result": "stream.analysis_results.v1",
    "system_metric": "stream.system_metrics.v1",
}
ALIASES = {
    "chat_bucket": ("chat_bucket",),
    "transcript_bucket": ("transcript_bucket",),
    "analysis_result": ("analysis_result", "analysis_bucket"),
    "system_metric": ("system_metric", "system_metrics"),
}
FIELDS = ("schema_version", "event_id", "event_type", "event_schema_version", "source", "session_id", "channel_id", "occurred_at", "payload")
VERSION = "v1"


def read_event_log(spark: SparkSession, servers: str, group: str = "analysis", max_per_batch: int | None = None) -> DataFrame:
    """Stream of both bucket topics."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join((TOPICS["chat_bucket"], TOPICS["transcript_bucket"])))
        .option("kafka.group.id", group)
    )
    if max_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", max_per_batch)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp")


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """The same stream from a folder of JSON lines."""
    return spark.readStream.text(path)


def decode_envelope(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed envelope columns with ``decode_error``; unknown fields are refused and the payload stays raw JSON."""
    text = F.trim(F.col(column))
    names = F.json_object_keys(text)
    unknown = F.array_except(names, F.array(*[F.lit(f) for f in FIELDS]))
    body = F.from_json(text, schemas.ENVELOPE + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = lines.withColumns({"_e": body, "_unknown": unknown, "_names": names})
    error = (
        F.when(F.col("_names").isNull(), "decode event envelope: not a JSON object")
        .when(F.size("_unknown") > 0, F.concat(F.lit("decode event envelope: unknown field "), F.array_join("_unknown", ", ")))
        .when(F.col("_e._corrupt").isNotNull(), "decode event envelope: wrong field type")
    )
    return out.select(*[F.col(f"_e.{f}").alias(f) for f in FIELDS], error.alias("decode_error"))


def payload_text(*names: str) -> Column:
    return F.coalesce(*[F.when(F.trim(F.get_json_object("payload", f"$.{n}")) != "", F.trim(F.get_json_object("payload", f"$.{n}"))) for n in names])


def payload_time(*names: str) -> Column:
    return payload_text(*names).try_cast("timestamp")


def _given(c: str) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def bucket_key(df: DataFrame) -> DataFrame:
    """Key parts of bucket events, taken from the envelope first and then from the payload."""
    return df.withColumns(
        {
            "_session": F.coalesce(_given("session_id"), payload_text("session_id")),
            "_channel": F.coalesce(_given("channel_id"), payload_text("channel_id")),
            "_start": payload_time("bucket_start", "window_start"),
            "_end": payload_time("bucket_end", "window_end"),
        }
    )


def validate_envelope(envelopes: DataFrame) -> DataFrame:
    """Envelopes with an ``errors`` list, empty when valid."""
    kind = F.trim("event_type")
    declared = payload_text("type")
    aliases = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(a) for a in x]) for kv in ALIASES.items() for x in kv])
    is_object = F.json_object_keys("payload").isNotNull()
    bucket = kind.isin("chat_bucket", "transcript_bucket")
    keyed = F.col("_session").isNotNull() & F.col("_channel").isNotNull() & F.col("_start").isNotNull() & F.col("_end").isNotNull()
    checks = [
        F.when(F.coalesce(F.trim("schema_version"), F.lit("")) != VERSION, "schema_version must be v1"),
        F.when(_given("event_id").isNull(), "event_id is required"),
        F.when(F.coalesce(F.trim("event_schema_version"), F.lit("")) != VERSION, "event_schema_version must be v1"),
        F.when(~F.coalesce(kind, F.lit("")).isin(*TOPICS), "unknown event_type"),
        F.when(_given("source").isNull(), "source is required"),
        F.when(F.col("occurred_at").isNull(), "occurred_at is required"),
        F.when(~F.coalesce(is_object, F.lit(False)), "payload must be a JSON object"),
        F.when(declared.isNotNull() & ~F.coalesce(F.array_contains(F.try_element_at(aliases, kind), declared), F.lit(False)), "payload type does not match event_type"),
        F.when(bucket & ~keyed, "bucket events require session, channel, start and end"),
        F.when(bucket & (F.col("_end") <= F.col("_start")), "bucket end must be after start"),
    ]
    return bucket_key(envelopes).withColumn("errors", F.array_compact(F.array(*checks))).drop("_session", "_channel", "_start", "_end")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and dead letters."""
    ok = F.size("errors") == 0
    return validated.where(ok).drop("errors"), validated.where(~ok)


def normalized_type(value: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(value)), "[-.]", "_")
    return (
        F.when(v.isin("chat_bucket", "chat_buckets", "bucket_chat", "chat"), "chat_bucket")
        .when(v.isin("transcript_bucket", "transcript_buckets", "bucket_transcript", "transcript"), "transcript_bucket")
        .otherwise(v)
    )


def infer_event_type(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Type, session, channel and payload of loosely shaped JSON events; type NULL when nothing fits."""
    body = F.trim(F.col(column))

    def field(src: Column, *names: str) -> Column:
        return F.coalesce(*[F.trim(F.get_json_object(src, f"$.{n}")) for n in names])

    payload = F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in ("payload", "data", "bucket", "chat_bucket", "transcript_bucket")], body)
    rows = bodies.where(body != "").withColumn("payload", payload)
    names = F.json_object_keys("payload")

    def has(*keys: str) -> Column:
        return F.coalesce(sum((F.array_contains(names, k).cast("int") for k in keys), F.lit(0)) == len(keys), F.lit(False))

    guess = (
        F.when(has("chat_sentiment"), "chat_bucket")
        .when(has("message_count", "bucket_start"), "chat_bucket")
        .when(has("transcript_confidence"), "transcript_bucket")
        .when(has("text", "bucket_start"), "transcript_bucket")
    )

    def known(x: Column) -> Column:
        v = normalized_type(x)
        return F.when(~v.isin("", "event"), v)

    kind = F.coalesce(known(field(body, "event_type", "type", "kind")), known(field(F.col("payload"), "event_type", "type", "kind")), guess)
    return rows.withColumns(
        {
            "event_type": kind,
            "session_id": F.coalesce(field(F.col("payload"), "session_id"), field(body, "session_id", "session")),
            "channel_id": F.coalesce(field(F.col("payload"), "channel_id"), field(body, "channel_id", "channel")),
        }
    )


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def malformed_payloads(payloads: DataFrame) -> DataFrame:
    """Dead letters of ``make_envelope``: payloads that are null or no JSON."""
    return payloads.where(~F.coalesce(_is_json(F.col("payload")), F.lit(False)))


def make_envelope(payloads: DataFrame, event_type: str, source: str) -> DataFrame:
    """Envelopes of JSON payloads (column ``payload``) with deterministic ids, and the columns a Kafka sink takes.

    Payloads that are no JSON have no envelope; ``malformed_payloads`` returns them.
    """
    sound = payloads.where(_is_json(F.col("payload")))
    base = sound.withColumns({"event_type": F.lit(event_type), "session_id": payload_text("session_id"), "channel_id": payload_text("channel_id")})
    keyed = bucket_key(base)
    part = F.concat_ws(":", "event_type", "_session", "_channel", rfc3339(F.col("_start")), rfc3339(F.col("_end")))
    full = F.col("_session").isNotNull() & F.col("_channel").isNotNull() & F.col("_start").isNotNull() & (F.col("_end") > F.col("_start"))
    some = F.coalesce("session_id", "channel_id").isNotNull()
    pair = F.concat_ws("|", F.coalesce("session_id", F.lit("")), F.coalesce("channel_id", F.lit("")))
    key = F.when(full, part).when(some, pair).otherwise(F.col("payload"))
    ident = F.left(F.sha2(F.concat_ws("|", "event_type", key, "payload"), 256), F.lit(32))
    occurred = F.coalesce(payload_time("occurred_at"), payload_time("transcribed_at"), payload_time("bucket_start"), payload_time("window_start"), F.current_timestamp())
    out = keyed.withColumns({"event_id": ident, "occurred_at": occurred, "key": F.when(full | some, key).otherwise(ident)})
    head = F.to_json(
        F.struct(
            F.lit(VERSION).alias("schema_version"), "event_id", "event_type", F.lit(VERSION).alias("event_schema_version"), F.lit(source).alias("source"),
            "session_id", "channel_id", rfc3339(F.col("occurred_at")).alias("occurred_at"),
        )
    )
    # the payload is published as the text its id was computed from
    value = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), F.col("payload"), F.lit("}"))
    headers = {"event_id": F.col("event_id"), "event_type": F.col("event_type"), "event_schema_version": F.lit(VERSION), "envelope_version": F.lit(VERSION), "source": F.lit(source)}
    header = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in headers.items()])
    return out.select(F.lit(TOPICS[event_type]).alias("topic"), "key", value.alias("value"), header.alias("headers"), "event_id", "event_type", "session_id", "channel_id", "occurred_at", "payload")
