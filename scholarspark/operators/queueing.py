"""Work queue and job state as transformations of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import retry_delay


def enqueue(queue: DataFrame, papers: DataFrame, now: int, delay: int = 0) -> DataFrame:
    """The queue with the given papers in it: new ones queued, waiting ones rescheduled, running ones left alone."""
    asked = papers.select("paper_id").distinct().withColumn("__in", F.lit(True))
    rows = queue.join(asked, "paper_id", "full_outer")
    touched = F.col("__in") & (F.coalesce("status", F.lit("")) != "running")
    return rows.select(
        "paper_id",
        F.when(touched, "queued").otherwise(F.col("status")).alias("status"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(F.col("__in"), F.lit(now + delay)).otherwise(F.col("next_run_at")).cast("long").alias("next_run_at"),
        "last_error",
    )


def settle(queue: DataFrame, results: DataFrame, now: int, period: int = 86400) -> DataFrame:
    """The queue after results ``(paper_id, error)``: successes idle until the next period, failures back off."""
    rows = queue.join(results.withColumn("__done", F.lit(True)), "paper_id", "left")
    done, failed = F.coalesce("__done", F.lit(False)), F.col("error").isNotNull()
    return rows.select(
        "paper_id",
        F.when(done, F.when(failed, "failed").otherwise("idle")).otherwise(F.col("status")).alias("status"),
        F.when(done, F.when(failed, F.col("attempts") + 1).otherwise(0)).otherwise(F.col("attempts")).alias("attempts"),
        F.when(done, F.lit(now) + F.when(failed, retry_delay("attempts")).otherwise(period)).otherwise(F.col("next_run_at")).alias("next_run_at"),
        F.when(done, F.substring("error", 1, 500)).otherwise(F.col("last_error")).alias("last_error"),
    )


def requeue_stale(queue: DataFrame, now: int, lease: int = 3600) -> DataFrame:
    """Rows that have been running longer than the lease are queued again."""
    stale = (F.col("status") == "running") & (F.coalesce("next_run_at", F.lit(0)) + lease < now)
    return queue.withColumn("status", F.when(stale, "queued").otherwise(F.col("status")))


def expand(edges: DataFrame, papers: DataFrame, queue: DataFrame) -> DataFrame:
    """Neighbours without a file that are not queued yet."""
    near = edges.select(F.explode(F.array("source_paper_id", "target_paper_id")).alias("paper_id")).distinct()
    bare = papers.where(F.coalesce("file_path", F.lit("")) == "").select(F.col("id").alias("paper_id"))
    return near.join(bare, "paper_id", "left_semi").join(queue.select("paper_id"), "paper_id", "left_anti")


def job_state(events: DataFrame) -> DataFrame:
    """The latest status of each kind of job and user, with its failures."""
    last = F.max_by("status", F.struct("created_at", "id")).alias("status")
    return events.groupBy("job_type", "user_id").agg(last, F.count_if(F.col("status") == "failed").alias("failures"))
