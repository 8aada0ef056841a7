"""Intermediate tables, keyed upserts, appends and report files.

Intermediate results that several branches read are written once to the shared folder named by
``spark.checkpoint.dir``. Lost executors re-read the files instead of recomputing, and a narrow branch prunes columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(checkpoint_dir: str | None, warehouse: str, master: str) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, which a cluster names, else the warehouse.

    The default warehouse is a folder of the driver's machine. Executors elsewhere would write to folders of their own,
    so it is refused unless everything runs on one machine.
    """
    if checkpoint_dir:
        return checkpoint_dir
    on_disk = warehouse.startswith(("file:", "/"))
    if on_disk and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return warehouse


def work_dir(spark: SparkSession) -> str:
    """One folder per application below the shared one. Spark's file system deletes it when the application ends."""
    base = shared_base(spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
    folder = f"{base.rstrip('/')}/crowdtide-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a result that is read more than once and return it as a stored table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- upserts ----------------------------------------------------------------


def keep_old_if_blank(new: str, version: str) -> Column:
    """Newest non-blank text."""
    v = F.when(F.trim(new) != "", F.struct(F.col(version).alias("_at"), F.col(new).alias("_v")))
    return F.max(v)["_v"]


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str, policies: Mapping[str, str] | None = None) -> DataFrame:
    """Merge changes into a table: the highest version wins per key, except for columns with a policy.

    Policies: ``keep`` (newest non-blank text), ``greatest``, ``least``, ``first`` (value of the lowest version).
    One partial aggregation on the key, so a key with many versions is reduced before the shuffle.
    """
    rules = policies or {}
    both = current.unionByName(changes)
    plain = [c for c in both.columns if c not in keys and c not in rules]
    order = F.struct(version, *[F.xxhash64(c) for c in plain if c != version])
    aggs: list[Column] = [F.max_by(F.struct(*plain), order).alias("_row")]
    for c, rule in rules.items():
        if rule == "keep":
            aggs.append(keep_old_if_blank(c, version).alias(c))
        elif rule == "greatest":
            aggs.append(F.max(c).alias(c))
        elif rule == "least":
            aggs.append(F.min(c).alias(c))
        elif rule == "first":
            aggs.append(F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(version).alias("_at"), F.col(c).alias("_v"))))["_v"].alias(c))
        else:
            raise ValueError(f"unknown policy {rule}")
    merged = both.groupBy(*keys).agg(*aggs)
    return merged.select(*[F.col(f"_row.{c}").alias(c) if c in plain else F.col(c) for c in both.columns])


def changed_rows(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes that are new or differ from the stored row."""
    body = [c for c in changes.columns if c not in keys]
    old = current.select(*keys, F.xxhash64(*body).alias("_old"))
    new = changes.withColumn("_new", F.xxhash64(*body))
    return new.join(old, list(keys), "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("_new"))).drop("_old", "_new")


METRIC_COLUMNS = ["session_id", "name", "value", "unit", "recorded_at", "meta"]


def append_metrics(metrics: DataFrame, path: str) -> DataFrame:
    """Append long-format metrics and return the table."""
    metrics.select(*METRIC_COLUMNS).write.mode("append").parquet(path)
    return metrics.sparkSession.read.schema(metrics.select(*METRIC_COLUMNS).schema).parquet(path)


def write_reports(report: DataFrame, rows: DataFrame, path: str) -> None:
    """Report as JSON, one document per row, and its detail rows as JSON lines."""
    report.write.mode("overwrite").json(f"{path}/report")
    rows.write.mode("overwrite").json(f"{path}/rows")


def message_samples(peak: DataFrame, scored: DataFrame, salt: str, n: int = 10) -> DataFrame:
    """Privacy-safe sample per bucket: peak evidence before scored messages, distinct ids, hashed users.

    Both inputs: bucket key, pos, message_id, timestamp, username, display_name, text; ``scored`` also label,
    confidence and score.
    """
    from pyspark.sql import Window

    from crowdtide.functions.keys import hash_identity
    from crowdtide.functions.text import first_non_empty

    key = ["session_id", "channel_id", "bucket_start", "bucket_end"]
    none = {"label": "string", "confidence": "double", "score": "double"}
    first = peak.where(F.coalesce("message_id", F.lit("")) != "").withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    cols = [*key, "pos", "message_id", "timestamp", "username", "display_name", "text", *none]
    both = first.select(*cols, F.lit(0).alias("_src")).unionByName(scored.select(*cols, F.lit(1).alias("_src")))
    # rows without an id are never duplicates of each other
    ident = F.when(F.coalesce("message_id", F.lit("")) == "", F.concat_ws("-", "_src", "pos")).otherwise(F.col("message_id"))
    picked = both.withColumn("_id", ident).groupBy(*key, "_id").agg(F.min(F.struct("_src", "pos", *cols[len(key) + 1 :])).alias("m"))
    w = Window.partitionBy(*key).orderBy("m._src", "m.pos")
    ranked = picked.withColumn("evidence_rank", F.row_number().over(w) - 1).where(F.col("evidence_rank") < n)
    user = F.coalesce(first_non_empty(F.trim("m.username"), F.trim("m.display_name")), F.lit(""))
    return ranked.select(
        *key, F.col("m.message_id").alias("message_id"), F.col("m.timestamp").alias("timestamp"), hash_identity(salt, user).alias("user_hash"),
        F.col("m.text").alias("text"), *[F.col(f"m.{c}").alias(c) for c in none], "evidence_rank",
    )
