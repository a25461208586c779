"""Periods and the payload of a periodic report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import present


def period_start(day: Column, kind: str) -> Column:
    """Monday of the week, or the first of the month."""
    return F.date_trunc("week", day).cast("date") if kind == "weekly" else F.trunc(day, "month")


def period_end(day: Column, kind: str) -> Column:
    return F.date_add(period_start(day, kind), 6) if kind == "weekly" else F.last_day(day)


def report(papers: DataFrame, tasks: DataFrame, start: int, end: int, today: str, most: int = 20) -> DataFrame:
    """One row: progress, the newest papers of a period, papers read in it, and overdue tasks."""
    inside = lambda c: F.col(c).between(start, end)
    counts = papers.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("read_status") == 1).alias("read"),
        F.count_if(present("file_path").isNotNull()).alias("uploaded"),
        F.count_if((F.col("read_status") == 1) & inside("updated_at")).alias("read_updates"),
    )
    newest = papers.where(inside("created_at")).orderBy(F.desc("created_at"), F.desc("id")).limit(most).agg(F.reverse(F.sort_array(F.collect_list("id"))).alias("new_papers"))
    late = tasks.agg(F.count_if((F.col("status") != "done") & (F.col("due_date") < today)).alias("overdue"))
    return counts.join(F.broadcast(newest)).join(F.broadcast(late))
