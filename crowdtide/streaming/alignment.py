"""Alignment of two bucket streams, redone only where a micro-batch touches it.

Each stream's time line is cut into slices. Buckets are logged by slice, and the pairs of a slice are those of the
transcript buckets that start in it. Matching goes forward in time: a slice depends on its own buckets, on the chat
buckets around it, and on which of those the slice before has taken. So a batch re-aligns the slices it touches, and
then those after slices that now take other chat buckets across their end, until nothing changes; usually that is one
more round. What is read are the slices at hand and their neighbours, by the partitions of the log.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from crowdtide.operators import alignment
from crowdtide.sources.storage import settle
from crowdtide.streaming.pipelines import BUCKET, STREAM, latest_rows, run_to_end

SLICE = [*STREAM, "slice"]
#: Folders that the streams are dealt to, each with one folder per slice; and how many of those a filter may name.
PARTS, FOLDERS = 16, 500
_PLACE = [StructField("session_id", StringType()), StructField("channel_id", StringType()), StructField("slice", LongType())]
_VERSION = [StructField("batch", LongType()), StructField("round", LongType())]
SEPARATOR = "\x1f"


class SlicedAlignment:
    """The logs of one aligned pair of streams below ``path``. ``feed`` rows: kind, version, structs chat and speech."""

    def __init__(self, spark, schema: StructType, path: str, seconds: int, slice_windows: int):
        self.spark, self.schema, self.path, self.seconds = spark, schema, path, seconds
        self.width = seconds * slice_windows * 1_000_000
        empty = spark.createDataFrame([], schema)
        none = self._keyed(empty)
        self.pairs_schema = alignment.align(*self._sides(none, none), seconds).schema
        place = StructType(_PLACE)
        for name, fields in (("aligned", StructType([*self.pairs_schema, _PLACE[2]])), ("touched", place)):
            spark.createDataFrame([], fields).write.mode("overwrite").parquet(f"{path}/{name}/batch=-1/round=0")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        start = F.coalesce("chat.bucket_start", "speech.bucket_start")
        keyed = rows.withColumns({c: F.coalesce(f"chat.{c}", f"speech.{c}") for c in STREAM})
        return keyed.withColumns({"slice": F.floor(F.unix_micros(start) / F.lit(self.width)), "part": F.pmod(F.hash(*STREAM), F.lit(PARTS))})

    def _sides(self, chats: DataFrame, speeches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Newest versions of both sides, each slice as a session of its own."""

        def newest(rows: DataFrame, kind: str, name: str) -> DataFrame:
            side = rows.where(F.col("kind") == kind).select(f"{name}.*", "version", "slice")
            marked = latest_rows(side, [*BUCKET, "slice"], "version")
            return marked.withColumn("session_id", F.concat_ws(SEPARATOR, F.coalesce("session_id", F.lit("")), F.col("slice").cast("string"))).drop("slice")

        return newest(chats, "chat", "chat"), newest(speeches, "transcript", "speech")

    def append(self, batch: DataFrame, batch_id: int) -> None:
        self._keyed(batch).write.mode("overwrite").partitionBy("part", "slice").parquet(f"{self.path}/log/batch={batch_id}")

    def read(self, wanted: DataFrame, upto: int) -> DataFrame:
        """Logged buckets of the slices ``wanted`` (SLICE); other folders are not opened."""
        types = [*self.schema, *_PLACE[:2], _VERSION[0], StructField("part", LongType()), _PLACE[2]]
        rows = self.spark.read.schema(StructType(types)).parquet(f"{self.path}/log").where(F.col("batch") <= upto)
        places = wanted.select(*SLICE).distinct().withColumn("part", F.pmod(F.hash(*STREAM), F.lit(PARTS)).cast("long"))
        # a batch that touches few slices names their folders, so that the others are not listed; the join decides anyway
        folders = places.select("part", "slice").distinct().limit(FOLDERS + 1).collect()
        if len(folders) <= FOLDERS:
            by_part: dict[int, list[int]] = {}
            for part, number in folders:
                by_part.setdefault(part, []).append(number)
            named = [(F.col("part") == part) & F.col("slice").isin(numbers) for part, numbers in by_part.items()]
            rows = rows.where(reduce(or_, named, F.lit(False)))
        return rows.join(places, [*SLICE, "part"]).drop("batch")

    def _log(self, name: str, fields: list[StructField]) -> DataFrame:
        return self.spark.read.schema(StructType([*fields, *_VERSION])).parquet(f"{self.path}/{name}")

    def pairs(self, slices: DataFrame | None = None, batch_id: int | None = None, turn: int = 0) -> DataFrame:
        """Pairs as last aligned, with their slice; of some slices, and as they were before a round of a batch."""
        touched, rows = self._log("touched", _PLACE), self._log("aligned", [*self.pairs_schema, _PLACE[2]])
        if batch_id is not None:
            before = (F.col("batch") < batch_id) | ((F.col("batch") == batch_id) & (F.col("round") < turn))
            touched, rows = touched.where(before), rows.where(before)
        if slices is not None:
            touched = touched.join(slices.select(*SLICE).distinct(), SLICE, "left_semi")
        last = touched.groupBy(*SLICE).agg(F.max(F.struct("batch", "round")).alias("v")).select(*SLICE, "v.batch", "v.round")
        return rows.join(last, [*SLICE, "batch", "round"]).drop("batch", "round")

    def align(self, todo: DataFrame, batch_id: int, turn: int) -> DataFrame:
        """New pairs of some slices, given what the slices before them have taken."""
        around = todo.select(*STREAM, F.col("slice").alias("_target"), F.explode(F.array(*[F.col("slice") + d for d in (-1, 0, 1)])).alias("slice"))
        logged = self.read(around, batch_id)
        chats = logged.where("kind = 'chat'").join(around, SLICE).drop("slice").withColumnRenamed("_target", "slice")
        before = todo.select(*STREAM, (F.col("slice") - 1).alias("slice"))
        taken = self.pairs(before, batch_id, turn).select(*STREAM, (F.col("slice") + 1).alias("slice"), "chat_bucket_start", "chat_bucket_end")
        mine = chats.withColumns({"chat_bucket_start": F.col("chat.bucket_start"), "chat_bucket_end": F.col("chat.bucket_end")})
        free = mine.join(taken, [*SLICE, "chat_bucket_start", "chat_bucket_end"], "left_anti")
        found = alignment.align(*self._sides(free, logged.join(todo, SLICE, "left_semi")), self.seconds)
        at = F.substring_index("session_id", SEPARATOR, -1)
        own = F.left("session_id", F.length("session_id") - F.length(at) - 1)
        return found.withColumns({"slice": at.cast("long"), "session_id": own})

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.append(batch, batch_id)
        rows = self._keyed(batch)
        # a chat bucket may serve speech that starts in the slices around its own
        reach = F.when(F.col("kind") == "chat", F.array(*[F.lit(d) for d in (-1, 0, 1)])).otherwise(F.array(F.lit(0)))
        todo = rows.withColumn("_d", F.explode(reach)).select(*STREAM, (F.col("slice") + F.col("_d")).alias("slice")).distinct()
        todo, turn = settle(todo, "todo"), 0
        while not todo.isEmpty():
            old = settle(self.pairs(todo, batch_id, turn), "pairs_before")
            where = f"batch={batch_id}/round={turn}"
            self.align(todo, batch_id, turn).write.mode("overwrite").parquet(f"{self.path}/aligned/{where}")
            todo.write.mode("overwrite").parquet(f"{self.path}/touched/{where}")
            new = self.pairs(todo, batch_id, turn + 1)
            across = F.unix_micros("chat_bucket_end") > (F.col("slice") + 1) * self.width
            key = [*SLICE, "chat_bucket_start", "chat_bucket_end"]
            changed = old.where(across).select(*key).unionByName(new.where(across).select(*key)).groupBy(*key).count().where("count = 1")
            todo = settle(changed.select(*STREAM, (F.col("slice") + 1).alias("slice")).distinct(), "todo")
            turn += 1


def stream_align(feed: DataFrame, path: str, seconds: int, slice_windows: int = 64) -> DataFrame:
    """Pairs of everything two bucket streams have brought, over this and earlier runs.

    ``feed``: kind (chat or transcript), version, and struct columns chat and speech, one of them null. The newest version
    of a bucket counts. Buckets are at most as long as a slice of ``slice_windows`` windows. All state is in logs by batch
    id and round below ``path``; a replayed batch reads what was there before it and writes the same again.
    """
    state = SlicedAlignment(feed.sparkSession, feed.schema, path, seconds, slice_windows)
    run_to_end(feed, path, state.process)
    return state.pairs().drop("slice")
