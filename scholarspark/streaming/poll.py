"""The poll loop as a stream: papers of a feed are asked for in order, their edges merged, their queue rows settled.

The feed, the edges and the queue are committed tables. A batch publishes each of them once, under its own number, so a
loop that is killed at any place goes on where it was: papers are asked for again at most, never twice in a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import queueing
from ..operators.entity import upsert_edges
from ..operators.lineage import materialize, number_rows, release
from ..sources.committed import CommittedTable
from ..sources.files import qualified
from ..sources.services import register

FEED = "seq long, paper_id long, not_before long"
QUEUE = "paper_id long, status string, attempts int, next_run_at long, last_error string"
EDGES = "source_paper_id long, target_paper_id long, confidence double"
#: Confidence of an edge that the service names.
SERVICE_CONFIDENCE = 0.9


def feed_table(spark: SparkSession, path: str) -> CommittedTable:
    return CommittedTable(spark, qualified(spark, path), None, FEED, 1)


def queue_table(spark: SparkSession, path: str, buckets: int = 64) -> CommittedTable:
    return CommittedTable(spark, path, "paper_id", QUEUE, buckets)


def edge_table(spark: SparkSession, path: str, buckets: int = 64) -> CommittedTable:
    return CommittedTable(spark, path, "source_paper_id", EDGES, buckets)


def ask(feed: CommittedTable, papers: DataFrame, not_before: int = 0, step: tuple[str, int] | None = None) -> int:
    """Put the papers of ``papers (paper_id, place)`` at the feed's end, in the order of place and id, each once a call.

    They are asked for from the time ``not_before`` on; a feed is read in its order, so later ones wait for them.
    """
    if step and feed.done(step[0]) >= step[1]:
        return feed.version()
    base, known = feed.version(), feed.extra().get("rows", 0)
    once = papers.where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("place").alias("place"))
    rows = number_rows(once, ["place", "paper_id"], "n").select((F.col("n") + known).alias("seq"), "paper_id", F.lit(not_before).alias("not_before"))
    return feed.commit(rows, base, append=True, operation="ask", step=step, extra={"rows": known + rows.count()})


def paper_of(record_id: Column) -> Column:
    """The paper that a service's id stands for: its digits."""
    return F.regexp_extract(record_id, r"(\d+)$", 1).try_cast("long")


def poll_step(edges: CommittedTable, queue: CommittedTable, feed: CommittedTable | None, now: Callable[[], int], delay: int = 600, paper: Callable[[Column], Column] = paper_of, name: str = "poll"):
    """A ``foreachBatch`` function for the rows of ``readStream.format("poll")``.

    Named papers become edges at the service's confidence; the asked ones are settled in the queue, with a back-off where the
    service failed; papers that are not in the queue yet are queued and, with a ``feed``, asked for after ``delay``.
    """

    def run(batch: DataFrame, number: int) -> None:
        step, at = (name, number), now()
        got = materialize(batch, "polled")  # asked once, whatever reads it
        named = got.where("record IS NOT NULL").select(F.col("paper_id").alias("source_paper_id"), paper(F.col("record.paperId")).alias("target_paper_id"), F.lit(SERVICE_CONFIDENCE).alias("confidence"))
        fresh = named.where("target_paper_id IS NOT NULL AND source_paper_id <> target_paper_id").distinct()
        edges.update(lambda stored: upsert_edges(stored, fresh), fresh, "poll", step)
        results = got.groupBy("paper_id").agg(F.max("error").alias("error"))
        ends = fresh.select(F.col("target_paper_id").alias("paper_id")).distinct()
        if queue.done(name) < number:
            known = queue.read().select("paper_id").union(results.select("paper_id"))
            new = materialize(ends.join(known, "paper_id", "left_anti"), "polled-new")
            change = lambda stored: queueing.enqueue(queueing.settle(asked(stored, results), results, at), new, at, delay)
            if feed is not None:  # before the queue, as the new papers are told by it
                ask(feed, new.withColumn("place", F.col("paper_id")), at + delay, step)
            queue.update(change, results.select("paper_id").union(new), "poll", step)
            release(new)
        release(got)

    return run


def asked(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue with the papers of results in it, also those that were asked for without it."""
    missing = results.select("paper_id").join(queue, "paper_id", "left_anti")
    return queue.unionByName(missing.select("paper_id", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("long").alias("next_run_at"), F.lit(None).cast("string").alias("last_error")))


def poll_stream(spark: SparkSession, feed: CommittedTable, progress: str, **options) -> DataFrame:
    """The stream of the feed's papers; ``options`` as of the sources ``papers`` and ``poll``."""
    register(spark)
    return spark.readStream.format("poll").option("feed", qualified(spark, feed.path)).option("progress", qualified(spark, progress)).options(**options).load()
