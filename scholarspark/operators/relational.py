"""Filters, joins, projections, limits and set operations over the domain tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_present, present


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def filter_papers(papers: DataFrame, sub_field: str | None = None, year_from: int | None = None, year_to: int | None = None, uploaded_only: bool = False) -> DataFrame:
    """Papers of a field and range of years; a missing year fails a set bound, a bound of 0 or None is no bound."""
    tests: list[Column] = []
    if uploaded_only:
        tests.append(present("file_path").isNotNull())
    if sub_field:
        tests.append(F.col("sub_field") == sub_field)
    if year_from:
        tests.append(present("year", text=False) >= year_from)
    if year_to:
        tests.append(present("year", text=False) <= year_to)
    return papers.where(reduce(Column.__and__, tests)) if tests else papers


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows equal to every value that is given; None asks for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in values.items() if v is not None], df)


def induced_edges(edges: DataFrame, nodes: DataFrame, least_confidence: float = 0.0, node_col: str = "id") -> DataFrame:
    """Edges with both ends among the nodes and enough confidence, a missing one counting as certain."""
    ids = nodes.select(F.col(node_col).alias("__id"))
    kept = edges.where(F.coalesce("confidence", F.lit(1.0)) >= least_confidence)
    for end in ("source_paper_id", "target_paper_id"):
        kept = kept.join(ids, F.col(end) == F.col("__id"), "left_semi")
    return kept


def recent_edges(edges: DataFrame, papers: DataFrame, as_of: int, years: int) -> DataFrame:
    """Edges whose citing paper is at most ``years`` old; a missing year is year 0."""
    year = papers.select(F.col("id").alias("source_paper_id"), F.coalesce("year", F.lit(0)).alias("__year"))
    return edges.join(year, "source_paper_id").where(F.col("__year") >= as_of - years).drop("__year")


def backlog(papers: DataFrame, summary: bool = True, references: bool = True, limit: int = 100) -> DataFrame:
    """The newest uploaded papers that lack a summary or parsed references."""
    wants = []
    if summary:
        wants.append(present("summary_one").isNull())
    if references:
        wants.append(F.col("refs_parsed_at").isNull())
    has_file = papers.where(present("file_path").isNotNull())
    return (has_file.where(reduce(Column.__or__, wants)) if wants else has_file).orderBy(F.desc("id")).limit(limit)


def due_queue(queue: DataFrame, now: int, limit: int) -> DataFrame:
    ready = F.col("status").isin("queued", "idle", "failed") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now))
    return queue.where(ready).orderBy(F.asc_nulls_first("next_run_at"), "paper_id").limit(limit)


def orphan_cleanup(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges without self-loops and without an end that is no paper."""
    ids = papers.select(F.col("id").alias("__id"))
    kept = edges.where("source_paper_id <> target_paper_id")
    for end in ("source_paper_id", "target_paper_id"):
        kept = kept.join(ids, F.col(end) == F.col("__id"), "left_semi")
    return kept


def keep_first(df: DataFrame, keys: Iterable[str], order: str = "id") -> DataFrame:
    """The row of the smallest ``order`` of each group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def search_documents(papers: DataFrame, notes: DataFrame) -> DataFrame:
    """``(doc_id, title, abstract, notes, text)`` of each paper with its notes; missing parts are blank."""
    joined = papers.join(notes.withColumnRenamed("paper_id", "id"), "id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    note_text = F.trim(F.concat_ws(" ", blank("notes"), blank("method"), blank("datasets"), blank("conclusions")))
    rows = joined.select(F.col("id").alias("doc_id"), blank("title").alias("title"), blank("abstract").alias("abstract"), note_text.alias("notes"))
    return rows.withColumn("text", F.trim(F.concat_ws(" ", "title", "abstract", "notes")))


def edge_details(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Edges with the titles and years of both ends."""
    side = lambda p: papers.select(F.col("id").alias(f"{p}_paper_id"), F.col("title").alias(f"{p}_title"), F.col("year").alias(f"{p}_year"))
    return edges.join(side("source"), "source_paper_id").join(side("target"), "target_paper_id")


def node_stats(papers: DataFrame, tasks: DataFrame, experiments: DataFrame, today: str) -> DataFrame:
    """Papers with their open and overdue tasks and experiments, 0 where there are none."""
    is_open = F.col("status") != "done"
    task = tasks.groupBy(F.col("paper_id").alias("id")).agg(F.count_if(is_open).alias("open_tasks"), F.count_if(is_open & (F.col("due_date") < today)).alias("overdue_tasks"))
    runs = experiments.groupBy(F.col("paper_id").alias("id")).agg(F.count("*").alias("experiment_count"))
    out = papers.join(task, "id", "left").join(runs, "id", "left")
    return out.na.fill(0, ["open_tasks", "overdue_tasks", "experiment_count"])


def node_projection(papers: DataFrame) -> DataFrame:
    """Node label, colour and size."""
    unread = present("file_path").isNull() | (F.col("read_status") == 0)
    color = F.when(unread, "gray").when(F.col("ccf_level").isin("A", "B"), "red").when(F.col("source_type") == "CNKI", "green").otherwise("blue")
    size = 20 + F.least(F.lit(40.0), 4 * F.sqrt(F.coalesce("citation_count", F.lit(0))))
    label = F.coalesce(present("title"), F.concat(F.lit("Paper "), F.col("id").cast("string")))
    return papers.select("id", label.alias("label"), color.alias("color"), size.alias("size"))


def path_export(papers: DataFrame) -> DataFrame:
    return papers.select("id", "title", "authors", "year", first_present("venue").alias("venue"), "doi")


def compare_papers(papers: DataFrame, metrics: DataFrame, ids: list[int]) -> DataFrame:
    """The asked papers, each with its metrics as a sorted list."""
    grouped = metrics.where(F.col("paper_id").isin(ids)).groupBy(F.col("paper_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dataset_name", F.col("id").alias("metric_id"), "f1"))).alias("metrics"))
    return papers.where(F.col("id").isin(ids)).join(grouped, "id", "left").select("id", "title", "year", F.coalesce(F.size("metrics"), F.lit(0)).alias("n_metrics"), F.get("metrics", F.lit(0))["f1"].alias("first_f1"))


def fuse_scores(left: DataFrame, right: DataFrame, key: str = "doc_id", left_weight: float = 0.58, right_weight: float = 0.42) -> DataFrame:
    """Weighted sum of two keyed score tables; a key missing on one side scores 0 there."""
    a, b = left.select(key, F.col("score").alias("__a")), right.select(key, F.col("score").alias("__b"))
    return a.join(b, key, "full_outer").select(key, (left_weight * F.coalesce("__a", F.lit(0.0)) + right_weight * F.coalesce("__b", F.lit(0.0))).alias("score"))


def page_nodes(papers: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return papers.orderBy(F.desc(F.coalesce(F.col(order), F.lit(0))), "id").offset(offset).limit(limit)
