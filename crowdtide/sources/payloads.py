"""Contracts of nested JSON payloads: a JSON schema walked into one expression that counts violations by path.

A payload is parsed once, into a variant. The walk turns each rule of the schema (type, required, const, enum, minimum,
maximum, format, items, properties, additionalProperties, nullable anyOf, $ref) into a 0/1 column; elements of arrays and
maps add theirs up, at any depth. A payload yields one array of counts, a table one aggregation over them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdtide import schemas

DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"
_SCALARS = {"string": "^STRING", "boolean": "^BOOLEAN", "number": _NUMBER, "integer": _NUMBER}

Rule = tuple[str, str]


def _resolved(schema: Mapping, root: Mapping) -> tuple[Mapping, bool]:
    """The schema behind references, and whether null is allowed beside it."""
    nullable = False
    while True:
        if "$ref" in schema:
            target = root
            for part in schema["$ref"].removeprefix("#/").split("/"):
                target = target[part]
            schema = target
        elif "anyOf" in schema:
            rest = [s for s in schema["anyOf"] if s.get("type") != "null"]
            if len(rest) != 1:
                raise ValueError("anyOf is supported for one schema or null")
            nullable, schema = nullable or len(rest) < len(schema["anyOf"]), rest[0]
        else:
            kinds = schema.get("type")
            if isinstance(kinds, list):
                rest = [k for k in kinds if k != "null"]
                nullable, schema = nullable or "null" in kinds, {**schema, "type": rest[0]}
            return schema, nullable


def _summed(vectors: Column, n: int) -> Column:
    """Element-wise sum of an array of arrays of n counts; null counts as none."""
    zero = F.array(*[F.lit(0).cast("long")] * n)
    return F.reduce(F.coalesce(vectors, F.array().cast("array<array<bigint>>")), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def _walk(value: Column, schema: Mapping, root: Mapping, path: str) -> tuple[list[Rule], Column]:
    """Rules below ``path`` and an array with the violations of each. ``value`` is a variant, null if it is missing."""
    schema, nullable = _resolved(schema, root)
    there = value.isNotNull()
    null = there & F.is_variant_null(value)
    some = there & ~F.is_variant_null(value)
    rules: list[Rule] = []
    bad: list[Column] = []
    parts: list[Column] = []

    def rule(name: str, broken: Column, at: str = path) -> None:
        rules.append((at, name))
        bad.append(F.coalesce(broken, F.lit(False)).cast("long"))

    kind = schema.get("type", "string" if "const" in schema or "enum" in schema else None)
    if kind in _SCALARS:
        found = F.schema_of_variant(value)
        fits = found.rlike(_SCALARS[kind])
        number = F.try_variant_get(value, "$", "double")
        if kind == "integer":
            fits = fits & (number == F.floor(number))
        rule("type", (some & ~fits) if nullable else null | (some & ~fits))
        if "minimum" in schema:
            rule("minimum", some & found.rlike(_NUMBER) & (number < schema["minimum"]))
        if "maximum" in schema:
            rule("maximum", some & found.rlike(_NUMBER) & (number > schema["maximum"]))
        allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
        if allowed is not None:
            rule("enum", some & ~F.try_variant_get(value, "$", "string").isin(*allowed))
        if schema.get("format") == "date-time":
            rule("format", some & fits & ~F.try_variant_get(value, "$", "string").rlike(DATE_TIME))
    elif kind == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        rule("type", (some & items.isNull()) if nullable else null | (some & items.isNull()))
        if "items" in schema:
            inner: list[Rule] = []

            def one(x: Column) -> Column:
                inner[:], vector = _walk(x, schema["items"], root, f"{path}[]")
                return vector

            vectors = F.transform(items, one)
            rules += inner
            parts.append(_summed(vectors, len(inner)))
    elif kind == "object":
        entries = F.try_variant_get(value, "$", "map<string,variant>")
        rule("type", (some & entries.isNull()) if nullable else null | (some & entries.isNull()))
        fields, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        child = {name: F.try_variant_get(value, f"$['{name}']", "variant") for name in fields}
        for name in schema.get("required", ()):
            present = F.array_contains(F.map_keys(entries), name)
            rule("required", entries.isNotNull() & ~present, f"{path}.{name}")
        if more is False:
            rules.append((path, "unknown_field"))
            bad.append(F.coalesce(F.size(F.filter(F.map_keys(entries), lambda k: ~k.isin(*fields))) if fields else F.size(entries), F.lit(0)).cast("long"))
        elif isinstance(more, Mapping):
            inner_values: list[Rule] = []

            def of_value(x: Column) -> Column:
                inner_values[:], vector = _walk(x, more, root, f"{path}.*")
                return vector

            vectors = F.transform(F.map_values(entries), of_value)
            parts.append(_summed(vectors, len(inner_values)))
            below = list(inner_values)
        for name, sub in fields.items():
            found_rules, vector = _walk(child[name], sub, root, f"{path}.{name}")
            parts.append(vector)
            if isinstance(more, Mapping):
                below += found_rules
            else:
                rules += found_rules
        if isinstance(more, Mapping):
            rules += below
    elif kind is not None:
        raise ValueError(f"unknown type {kind}")
    own = F.array(*bad) if bad else F.array().cast("array<bigint>")
    return rules, F.concat(own, *parts) if parts else own


def check_payloads(payloads: DataFrame, schema: Mapping, root: Mapping | None = None, column: str = "payload") -> DataFrame:
    """(path, rule, violations) for every rule of a schema, over a table of JSON texts; one aggregation.

    ``root``: the document that references point into, by default the schema itself. Text that is no JSON breaks the rule
    ``json`` of the path ``$`` and no other; a null text is no payload and breaks none. An empty table breaks no rule.
    """
    value = F.col("_v")
    rules, vector = _walk(value, schema, root or schema, "$")
    parsed = payloads.select(F.col(column).alias("_text"), F.try_parse_json(column).alias("_v"))
    wrong = (F.col("_text").isNotNull() & value.isNull()).cast("long")
    counted = parsed.select(F.concat(F.array(wrong), vector).alias("_n"))
    rules = [("$", "json"), *rules]
    sums = counted.agg(*[F.coalesce(F.sum(F.get("_n", F.lit(i))), F.lit(0)).alias(f"r{i}") for i in range(len(rules))])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (p, r) in enumerate(rules)])
    return sums.select(F.inline(rows))


def load_contract(path: str) -> dict:
    """A JSON schema document from a file of the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


# --- contracts of this package's own tables ---------------------------------

# Bounds by field name; fixed values.
SIGNED = ("chat_sentiment", "transcript_sentiment", "sentiment_score", "aggregate_sentiment", "valence")
SHARES = (
    "positive", "neutral", "negative", "confidence", "sentiment_confidence", "transcript_confidence", "chat_confidence", "peak_confidence", "probability", "reaction_score", "hype_score",
    "intensity_score", "confusion_score", "frustration_score", "velocity_score", "peak_reaction_score", "quality_score", "similarity", "alignment_quality", "empty_ratio",
)
AMOUNTS = (
    "message_count", "unique_chatters", "analyzed_count", "segment_count", "word_count", "chat_message_count", "transcript_text_length", "overlap_seconds", "analysis_latency_ms",
    "sentiment_latency_ms", "asr_latency_ms", "pipeline_latency_ms", "messages_per_minute", "audio_seconds", "repair_added_words",
)


def _typed(name: str, kind: T.DataType) -> dict:
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _typed("", kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": _typed("", kind.valueType)}
    if isinstance(kind, T.StructType):
        return object_contract(kind)
    if isinstance(kind, T.TimestampType):
        return {"type": "string", "format": "date-time"}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.StringType):
        return {"type": "string"}
    number: dict = {"type": "integer" if isinstance(kind, (T.LongType, T.IntegerType)) else "number"}
    if name in SIGNED:
        number |= {"minimum": -1, "maximum": 1}
    elif name in SHARES:
        number |= {"minimum": 0, "maximum": 1}
    elif name in AMOUNTS:
        number |= {"minimum": 0}
    return number


def object_contract(struct: T.StructType, required: Sequence[str] = (), kind: str | None = None) -> dict:
    """A closed object with the fields of a row. Fields that are not required may be null; ``kind`` is the value of ``type``."""
    fields = {f.name: _typed(f.name, f.dataType) for f in struct.fields}
    fields = {n: s if n in required else {"anyOf": [s, {"type": "null"}]} for n, s in fields.items()}
    if kind is not None:
        fields["type"] = {"const": kind}
        required = ["type", *required]
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": fields}


STREAM = ("session_id", "channel_id")
BUCKET = (*STREAM, "bucket_start", "bucket_end")
WINDOW = (*STREAM, "window_start", "window_end")

REACTION_WINDOW = (
    f"session_id STRING, channel_id STRING, source STRING, {schemas.SUBWINDOW.replace('reaction_score DOUBLE, ', '').replace('source STRING, ', '')}, unique_chatters BIGINT, messages_per_minute DOUBLE, "
    "velocity_score DOUBLE, valence DOUBLE, evidence_messages ARRAY<STRUCT<message_id STRING, timestamp TIMESTAMP, username STRING, display_name STRING, text STRING>>"
)
TRANSCRIPT_UPDATE = (
    "session_id STRING, channel_id STRING, transcript_start TIMESTAMP, transcript_end TIMESTAMP, text STRING, language STRING, transcript_confidence DOUBLE, asr_latency_ms BIGINT, "
    "segments ARRAY<STRUCT<start DOUBLE, end DOUBLE, text STRING, confidence DOUBLE, words ARRAY<STRUCT<start DOUBLE, end DOUBLE, text STRING, probability DOUBLE>>>>"
)
SIGNAL_WINDOW = (
    "session_id STRING, channel_id STRING, window_start TIMESTAMP, window_end TIMESTAMP, message_count BIGINT, aggregate_sentiment DOUBLE, confidence DOUBLE, alignment_quality DOUBLE, "
    "reaction_type STRING, evidence_ids ARRAY<STRING>, events ARRAY<STRUCT<type STRING, confidence DOUBLE, text STRING, evidence_ids ARRAY<STRING>>>"
)
#: Row layout, name in ``type`` and required fields of each payload.
PAYLOADS = {
    "chat_message": (schemas.CHAT_MESSAGE, None, (*STREAM, "message_id", "timestamp", "username", "text")),
    "reaction_window": (REACTION_WINDOW, "reaction_window", (*WINDOW, "message_count", "reaction_type", "confidence")),
    "chat_bucket": (schemas.CHAT_BUCKET, "chat_bucket", (*BUCKET, "message_count", "unique_chatters", "chat_sentiment", "positive", "neutral", "negative")),
    "transcript_update": (TRANSCRIPT_UPDATE, "transcript_segment", (*STREAM, "transcript_start", "transcript_end", "text", "segments")),
    "transcript_bucket": (schemas.TRANSCRIPT_BUCKET, "transcript_bucket", (*BUCKET, "text")),
    "alignment_bucket": (schemas.ALIGNMENT, "alignment_bucket", (*WINDOW, "delta", "similarity", "relationship", "quality_flags")),
    "signal_window": (SIGNAL_WINDOW, "signal_window", (*WINDOW, "reaction_type", "events")),
}


def contract(name: str) -> dict:
    """The contract of one of ``PAYLOADS``. Needs a session, which reads the row layout."""
    layout, kind, required = PAYLOADS[name]
    return object_contract(T.StructType.fromDDL(layout), required, kind)
