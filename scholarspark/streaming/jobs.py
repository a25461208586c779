"""Structured Streaming: event windows, sessions, idempotent merges into committed tables, and the sync queue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queueing
from ..operators.aggregates import last_messages
from ..operators.entity import upsert_edges
from ..operators.lineage import materialize, scratch_dir
from ..operators.relational import due_queue
from ..sources.committed import CommittedTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; the same on a batch and on a stream."""
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    w = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "2 days") -> DataFrame:
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def weekly(events: DataFrame, late: str = "14 days") -> DataFrame:
    """Counts by week from Monday, for periodic reports."""
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def latest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table that ``merge_into`` keeps under ``path``; with a schema, an empty one where nothing was merged yet."""
    return CommittedTable(spark, path, schema=schema).read()


def merge_into(path: str, key: str, merge, buckets: int = 64):
    """A ``foreachBatch`` function that merges a micro-batch into the committed table under ``path``, in buckets of a key.

    Only buckets that the batch touches are read, merged by ``merge(stored or None, batch)`` and written anew; readers see
    all of a batch or nothing of it, and a batch that is run again counts once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        table, step, folder = CommittedTable(batch.sparkSession, path, key, buckets=buckets), ("stream", batch_id), f"batch={batch_id}"
        if table.version():
            table.update(lambda stored: merge(stored, batch), batch, "merge", step, folder=folder)
        elif touched := table.touched(batch):
            table.commit(merge(None, batch), 0, touched, operation="merge", step=step, folder=folder)

    return run


def merge_edges_into(path: str):
    """Citation edges of a stream, merged by ``upsert_edges``."""

    def merge(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        fresh = batch.dropDuplicates(["source_paper_id", "target_paper_id"])
        return fresh if stored is None else upsert_edges(stored, fresh)

    return merge_into(path, "source_paper_id", merge)


def remember_into(path: str, turns: int = 6):
    """The memory of chats: the last messages of each session, twice ``turns``."""

    def merge(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if stored is None else stored.unionByName(batch)
        return last_messages(both.dropDuplicates(["session_id", "id"]), max(2, 2 * turns)).drop("nth")

    return merge_into(path, "session_id", merge)


def sync_into(queue: CommittedTable, now, handle, delay: int = 600, name: str = "sync"):
    """The sync loop's step on a ticking stream: due papers of a queue, handled and settled, new ones enqueued.

    ``handle(due)`` returns ``(results (paper_id, error), edges)``; the papers that the edges newly name are asked for
    later. ``now()`` gives the time of a round. Only buckets of papers that change are written; a round counts once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if queue.done(name) >= batch_id:
            return
        moment, stored = now(), queue.read()
        fresh = queueing.requeue_stale(stored, moment)
        due = materialize(due_queue(fresh, moment, 5), "due")
        results, edges = handle(due)
        ends = edges.select(F.explode(F.array("source_paper_id", "target_paper_id")).alias("paper_id")).distinct()
        new = ends.join(stored, "paper_id", "left_anti")
        stale = fresh.select("paper_id", "status").exceptAll(stored.select("paper_id", "status")).select("paper_id")
        change = lambda rows: queueing.enqueue(queueing.settle(queueing.requeue_stale(rows, moment), results, moment), new, moment, delay)
        queue.update(change, due.select("paper_id").union(new.select("paper_id")).union(stale), "sync", (name, batch_id))

    return run


def start(stream: DataFrame, step, state: str, every: str = "60 seconds", once: bool = False):
    """Run a ``foreachBatch`` function over a stream, every minute or once over what is there; ``state`` holds its progress."""
    writer = stream.writeStream.option("checkpointLocation", state).foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder, and read that."""
    spark = stream.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)  # noqa: E731  complete: each batch is the whole table
    (writer.foreachBatch(keep).start() if mode == "complete" else writer.format("parquet").start(path)).awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # nothing was there
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(path)
