"""Streams: chapter files into a snapshot, the queue of changed chapters, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from storyloom.functions.text import content_hash
from storyloom.operators.changes import last_written, upserted
from storyloom.sources.files import CHAPTER
from storyloom.sources.snapshot import Snapshot


def chapter_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Chapters (book_id from the folder book_id=..., id, title, content, updated) as their files arrive."""
    return spark.readStream.schema(f"{CHAPTER}, book_id string").option("multiLine", True).option("maxFilesPerTrigger", files_at_once).json(path)


def ingest(chapters: DataFrame, snapshot: Snapshot, checkpoint: str) -> DataStreamWriter:
    """Merges arriving chapters into the snapshot and queues the changed ones, each batch in one commit that rewrites only the buckets it touches.

    A batch that is delivered again finds every hash unchanged and commits nothing. Of several
    files for one chapter in a batch the latest counts.
    """

    def merge(batch: DataFrame, _: int) -> None:
        rows = last_written(batch.where("id IS NOT NULL"), ["book_id", "id"], [F.desc("updated"), F.desc("content")])
        rows = rows.withColumn("content_hash", content_hash(F.col("content"))).select("id", "book_id", "title", "content_hash", F.col("updated").cast("bigint").alias("updated_at"))
        version, old = snapshot.version, snapshot.table("chapters")
        changed = rows.join(old.select("id", "book_id", "content_hash"), ["id", "book_id", "content_hash"], "left_anti").persist()
        try:
            if changed.isEmpty():
                return
            pending = changed.withColumn("status", F.lit("pending"))
            entries = pending.select(F.sha2(F.concat_ws("|", "book_id", "id"), 256).alias("id"), F.col("book_id").alias("work_id"), "book_id", F.col("id").alias("chapter_id"), F.lit("changed").alias("reason"), F.col("updated_at").alias("enqueued_at"), "status", F.lit(0).alias("attempts"))
            put = {"chapters": lambda old, new: upserted(old, new, ["id", "book_id"], {"tokens_used": 0}), "kb_dirty_queue": lambda old, new: upserted(old, new, ["id"])}
            snapshot.merge({"chapters": pending, "kb_dirty_queue": entries}, lambda name, old, new: put[name](old, new), version)
        finally:
            changed.unpersist()

    return chapters.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) in tumbling windows; rows later than `late` are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap of `gap` or more."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
