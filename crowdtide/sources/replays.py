"""Session documents and label manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdtide import schemas

TABLES = ("chat_buckets", "transcript_buckets", "alignments", "window_labels", "agent_reviews", "system_metrics")


def parse_replays(documents: DataFrame, column: str = "value") -> DataFrame:
    """Documents holding an array of sessions, or an object map of them, as one row per session.

    A session without an id takes its map key. An empty or repeated id fails the job when rows are read.
    """
    raw = F.trim(F.col(column))
    as_list = F.from_json(raw, f"ARRAY<STRUCT<{schemas.REPLAY}>>")
    as_map = F.from_json(raw, f"MAP<STRING, STRUCT<{schemas.REPLAY}>>")
    listed = documents.where(raw.startswith("[")).select(F.lit("").alias("_key"), F.explode(as_list).alias("r"))
    mapped = documents.where(raw.startswith("{")).select(F.explode(as_map).alias("_key", "r"))
    rows = listed.unionByName(mapped)
    sid = F.trim(F.coalesce(F.when(F.trim("r.session.session_id") != "", F.col("r.session.session_id")), F.col("_key")))
    rows = rows.withColumn("session_id", sid)
    rows = rows.where(F.assert_true(F.col("session_id") != "", F.lit("replay has empty session.session_id")).isNull())
    seen = rows.groupBy("session_id").agg(F.count("*").alias("_copies"), F.first("r").alias("r"))
    unique = F.assert_true(F.col("_copies") == 1, F.concat(F.lit("duplicate session "), F.col("session_id"))).isNull()
    n = F.greatest(F.size("r.window_labels"), F.lit(0)).cast("long")
    labels = F.coalesce(F.when(F.col("r.label_count") != 0, F.col("r.label_count")), n)
    own = F.coalesce(F.when(F.col("r.session.label_count") != 0, F.col("r.session.label_count")), labels)
    session = F.col("r.session").withField("session_id", F.col("session_id")).withField("label_count", own)
    return seen.where(unique).select("session_id", session.alias("session"), *[F.col(f"r.{t}").alias(t) for t in TABLES], labels.alias("label_count"))


def read_replays(spark: SparkSession, path: str) -> DataFrame:
    return parse_replays(spark.read.text(path, wholetext=True))


def replay_tables(replays: DataFrame) -> dict[str, DataFrame]:
    """The relations nested in the session documents, each keyed by its session."""
    out = {"sessions": replays.select("session.*")}
    for name in TABLES:
        items = replays.select("session_id", F.posexplode(name).alias("pos", "item"))
        out[name] = items.select("session_id", "pos", *[F.col(f"item.{c}").alias(c) for c in _columns(replays, name) if c != "session_id"])
    return out


def _columns(replays: DataFrame, name: str) -> list[str]:
    return replays.schema[name].dataType.elementType.fieldNames()


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, anything but an object fails the job."""
    return parse_manifest(spark.read.text(path), schema)


def parse_manifest(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    text = F.trim(F.col(column))
    rows = lines.where(text != "")
    ok = F.assert_true(F.json_object_keys(text).isNotNull(), F.concat(F.lit("not a JSON object: "), F.left(text, F.lit(80)))).isNull()
    return rows.where(ok).select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
