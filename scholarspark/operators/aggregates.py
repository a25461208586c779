"""Grouped aggregates and ranking over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize_text, present, round_half_even, slug, tag_list, topic_of, velocity
from .lineage import materialize, number_rows


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_paper_id").alias("id")).agg(F.count("*").alias("in_degree"))


def topic_years(papers: DataFrame) -> DataFrame:
    """Papers by topic and year; papers without a year count nowhere."""
    return papers.where(present("year", text=False).isNotNull()).groupBy(topic_of().alias("topic"), "year").agg(F.count("*").alias("n"))


def bursts(topics: DataFrame, limit: int = 20) -> DataFrame:
    """Topic years with 3 or more papers, 2 more than in the topic's previous year and half as many again."""
    w = Window.partitionBy("topic").orderBy("year")
    prev = topics.withColumn("prev", F.lag("n").over(w)).where("prev IS NOT NULL")
    grown = prev.withColumn("growth", F.col("n") - F.col("prev")).withColumn("ratio", F.col("growth") / F.col("prev"))
    hot = grown.where("n >= 3 AND growth >= 2 AND ratio >= 0.5").select("topic", "year", "n", "growth", round_half_even("ratio", 3).alias("ratio"))
    return hot.orderBy(F.desc("ratio"), F.desc("n"), "topic", "year").limit(limit)


def hotspots(papers: DataFrame, as_of: int, top: int = 5) -> DataFrame:
    """The papers of each year that are cited fastest."""
    rows = papers.where(present("year", text=False).isNotNull()).select("id", "year", F.round(velocity(as_of), 4).alias("velocity"))
    w = Window.partitionBy("year").orderBy(F.desc("velocity"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def river(topics: DataFrame) -> DataFrame:
    """Each topic's share of its year."""
    total = F.sum("n").over(Window.partitionBy("year"))
    return topics.select("year", "topic", "n", round_half_even(F.col("n") / F.greatest(F.lit(1), total), 4).alias("share"))


def river_wide(topics: DataFrame, names: list[str]) -> DataFrame:
    return topics.groupBy("year").pivot("topic", names).sum("n").na.fill(0)


def doi_key(c: str = "doi"):
    return normalize_text(c)


def doi_duplicates(papers: DataFrame) -> DataFrame:
    """DOIs that more than one paper has, with the papers."""
    keyed = papers.select("id", doi_key().alias("doi")).where("doi <> ''")
    return keyed.groupBy("doi").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


def doi_conflicts(papers: DataFrame) -> DataFrame:
    """DOIs whose papers differ in title or year."""
    keyed = papers.select(doi_key().alias("doi"), normalize_text("title").alias("t"), "year").where("doi <> ''")
    out = keyed.groupBy("doi").agg(F.count_distinct(F.when(F.col("t") != "", F.col("t"))).alias("titles"), F.count_distinct("year").alias("years"))
    return out.where("titles > 1 OR years > 1")


def open_tags(papers: DataFrame, known: list[str], least: int = 2, top: int = 20) -> DataFrame:
    """The commonest tags that are no known field."""
    skip = [k.lower() for k in known] + ["event extraction", "nlp"]
    tags = papers.select(F.explode(tag_list("dynamic_tags")).alias("tag")).where((F.length("tag") >= 4) & ~F.lower("tag").isin(skip))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "tag").limit(top)


def tag_clusters(tags: DataFrame) -> DataFrame:
    """Tags joined by their first two words of three letters or more; the shortest names the cluster."""
    words = F.filter(F.split(slug("tag"), " "), lambda w: F.length(w) >= 3)
    key = F.coalesce(present(F.array_join(F.slice(words, 1, 2), " ")), slug("tag"))
    return tags.groupBy(key.alias("key")).agg(F.sum("n").alias("n"), F.min_by("tag", F.struct(F.length("tag"), "tag")).alias("label"))


def sota_board(metrics: DataFrame, papers: DataFrame, dataset: str | None = None, limit: int = 50) -> DataFrame:
    """Metric rows with their papers, best score first.

    Rows are ranked beside their papers' years alone; titles are read for the papers of the ``limit`` best rows.
    """
    rows = metrics if dataset is None else metrics.where(F.lower("dataset_name") == dataset.lower())
    score = F.coalesce("f1", "argument_f1", "trigger_f1", F.lit(0.0))
    order = (F.desc("score"), F.desc(F.coalesce("year", F.lit(0))), "id")
    years = papers.select(F.col("id").alias("paper_id"), "year")
    best = materialize(rows.join(years, "paper_id").withColumn("score", score).orderBy(*order).limit(limit), "board")
    ids = [r[0] for r in best.select("paper_id").distinct().collect()]  # `limit` rows at most
    titles = papers.where(F.col("id").isin(ids)).select(F.col("id").alias("paper_id"), "title").distinct()
    return best.join(F.broadcast(titles), "paper_id").select("paper_id", *[c for c in rows.columns if c != "paper_id"], "title", "year", "score").orderBy(*order)


def metric_trend(metrics: DataFrame, papers: DataFrame, metric: str = "f1") -> DataFrame:
    """Best and mean score by year; papers without a year count nowhere."""
    name = metric if metric in ("precision_", "recall_", "f1", "trigger_f1", "argument_f1") else "f1"
    p = papers.select(F.col("id").alias("paper_id"), F.coalesce("year", F.lit(0)).alias("year"))
    joined = metrics.where(F.col(name).isNotNull()).join(p, "paper_id")
    out = joined.groupBy("year").agg(F.max(name).alias("best"), F.round(F.avg(name), 4).alias("mean"), F.count("*").alias("n"))
    return out.where("year <> 0")


def progress(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("total"), F.count_if(F.col("read_status") == 1).alias("read"), F.count_if(F.coalesce("read_status", F.lit(0)) != 1).alias("unread"), F.count_if(present("file_path").isNotNull()).alias("uploaded"))


def capsule_board(capsules: DataFrame, statuses: tuple[str, ...] = ("seed", "incubating", "validated", "archived")) -> DataFrame:
    """Capsules by status, every status present; blank status counts as the first."""
    named = capsules.withColumn("status", F.coalesce(present("status"), F.lit(statuses[0])))
    all_statuses = capsules.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counted = named.groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return F.broadcast(all_statuses).join(counted, "status", "left").na.fill(0, ["n"])


def last_messages(messages: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("id"))
    return messages.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def timeline_layout(papers: DataFrame, width: float = 1000.0, height: float = 600.0) -> DataFrame:
    """A place for each dated paper: x by year, y by rank within the year, gaps between 12 and 38.

    Papers are numbered over all years in ranges, so that no task sorts a whole year; a year's first number makes ranks.
    """
    least = F.coalesce(-F.col("citation_count"), F.lit((1 << 63) - 1))
    dated = papers.where(present("year", text=False).isNotNull()).select("id", "year", "sub_field", least.alias("less"))
    numbered = number_rows(dated, ["year", "sub_field", "less", "id"], "at").select("id", "year", "at")
    years = numbered.groupBy("year").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # as many rows as years
    span = years.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    placed = numbered.join(years, "year").withColumn("rank", (F.col("at") - F.col("first") + 1).cast("int")).join(F.broadcast(span))
    gap = F.greatest(F.lit(12.0), F.least(F.lit(38.0), F.lit(height) / F.greatest(F.col("n") - 1, F.lit(1))))
    x = F.lit(width) * (F.col("year") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    return placed.select("id", "year", "rank", F.round(x, 4).alias("x"), F.round((F.col("rank") - 1 - (F.col("n") - 1) / 2) * gap, 4).alias("y"))
