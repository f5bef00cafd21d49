"""The change stream: debounce by key, hash-suppressed changes, keyed application, and windows on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import normal_path
from ..operators.relational import incremental_diff


def debounced(changes: DataFrame, gap: str = "5 seconds", key: str = "filepath", watermark: str | None = None) -> DataFrame:
    """(key, start, stop, n, change_type): bursts of changes of a key closer than ``gap``; the last type wins. For batches, and for streams with a watermark."""
    rows = changes.withColumn("key", normal_path(F.col(key)))
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    return rows.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by("change_type", F.struct("ts", "change_id")).alias("change_type")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "change_type")


def real_changes(changes: DataFrame, cache: DataFrame) -> DataFrame:
    """Changes (path, hash) whose content differs from the cache (path, hash); deletions have a null hash and stay."""
    return changes.join(cache.withColumnRenamed("hash", "_old"), "path", "left").where(F.col("hash").isNull() | ~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def apply_changes(stream: DataFrame, table, checkpoint: str) -> StreamingQuery:
    """Apply a stream of new file contents (rows of the chunk table) to a VersionedTable, one batch at a time, and stop when the input is used up."""

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            batch = batch.persist()
            table.replace_files(latest_rows(batch), batch.select("filepath").distinct())
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(batch: DataFrame, order: str = "indexed_at") -> DataFrame:
    """Each id once: the row of the greatest time, where the rows have one, and of equal ones the greatest by its other columns."""
    rest = [c for c in batch.columns if c not in ("id", order)]
    row = F.struct(*([order] if order in batch.columns else []), *rest)
    return batch.groupBy("id").agg(F.max(row).alias("_r")).select(*[F.col(c) if c == "id" else F.col(f"_r.{c}") for c in batch.columns])


def watched(spark: SparkSession, folder: str, patterns: str = "*", max_files: int = 1000) -> DataFrame:
    """(path, ts, change_type, hash, content) stream of the files that appear below a folder, whatever the case of their names; at most ``max_files`` a batch.

    A file source sees new files only: writers put a file in place whole, by renaming, and tell deletions with a
    file of their own, not an empty one, whose name ends in ``.deleted``.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", patterns).option("maxFilesPerTrigger", max_files).load(folder)
    gone = F.lower("path").endswith(".deleted")
    return files.select(
        F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), r"(?i)\.deleted$", "").alias("path"), F.col("modificationTime").alias("ts"), F.when(gone, "unlink").otherwise("add").alias("change_type"), F.when(~gone, F.sha2("content", 256)).alias("hash"), F.when(~gone, F.decode("content", "UTF-8")).alias("content")
    )


def reconciled(spark: SparkSession, current: DataFrame, indexed: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, change_type) that bring an index up to date before a stream starts and after it stops: the difference as changes, without those that change nothing."""
    state = incremental_diff(current, indexed, cache)
    kind = F.when(F.col("state") == "added", "add").when(F.col("state") == "modified", "change").when(F.col("state") == "removed", "unlink")
    return state.select("path", kind.alias("change_type")).where("change_type IS NOT NULL")


class Progress:
    """A long job under a name: what runs under it can be cancelled, its stages counted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def __enter__(self) -> Progress:
        self.spark.sparkContext.setJobGroup(self.name, self.name, interruptOnCancel=True)
        return self

    def __exit__(self, *_) -> None:
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.name)

    def state(self) -> dict[str, int]:
        """Jobs of the name that have been seen, and the tasks of their running stages done and in all."""
        tracker = self.spark.sparkContext.statusTracker()
        jobs = tracker.getJobIdsForGroup(self.name)
        stages = [tracker.getStageInfo(s) for j in jobs if (i := tracker.getJobInfo(j)) for s in i.stageIds]
        return {"jobs": len(jobs), "done": sum(s.numCompletedTasks for s in stages if s), "tasks": sum(s.numTasks for s in stages if s)}


def tumbling(events: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window on event time."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
