"""Sources beyond Parquet: landed answers of web services, venue lists, tables of parsers, and text of binary files.

Web services are reached by jobs that land their answers as JSON lines in a folder of any file system that Spark reads;
the readers below turn landed answers into rows, so that a batch can be run again without calling anyone. A broken line
is an empty answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize_text, present
from ..operators.lineage import ship_package

RECORD = "paperId string, title string, year int, externalIds struct<DOI: string>, citationCount long, authors array<struct<name: string>>, fieldsOfStudy array<string>"
WORKS = "query string, message struct<items: array<struct<DOI: string, title: array<string>>>>"
ITEM = "key string, version long, data struct<title: string, date: string, extra: string, publicationTitle: string, DOI: string, creators: array<struct<firstName: string, lastName: string>>>"
TABLE = "paper_id long, parser string, table_id string, page int, rows array<array<string>>"


def landed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The JSON objects of a folder's lines; lines that are no object of the schema are left out."""
    lines = spark.read.text(folder).where(F.ltrim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def flat_records(records: DataFrame, *more: str) -> DataFrame:
    """Records of a paper service as rows: identifiers, authors in order, fields of study once each and sorted; ``more`` columns come along."""
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    fields = F.array_sort(F.array_distinct(F.coalesce("fieldsOfStudy", F.array().cast("array<string>"))))
    return records.select(F.col("paperId").alias("paper_id"), "title", "year", F.col("externalIds.DOI").alias("doi"), F.col("citationCount").alias("citation_count"), F.array_join(F.coalesce(names, F.array().cast("array<string>")), ", ").alias("authors"), F.array_join(fields, ", ").alias("fields"), *more)


def landed_records(spark: SparkSession, folder: str) -> DataFrame:
    return flat_records(landed(spark, folder, RECORD))


def title_dois(works: DataFrame) -> DataFrame:
    """``(title, doi)``: of each asked title the DOI of the first work found; titles without one are left out."""
    first = F.get("message.items", F.lit(0))["DOI"]
    found = works.select(F.col("query").alias("title"), first.alias("doi")).where(present("title").isNotNull() & F.col("doi").isNotNull())
    return found.groupBy("title").agg(F.min("doi").alias("doi"))


def library_search(titles: DataFrame, items: DataFrame) -> DataFrame:
    """``(title, key, version)``: of the items found for a title the first of the same normalised title, else the first.

    ``items (title, nth, key, version, found)`` are the answers in their order, ``found`` an item's own title.
    """
    same = normalize_text("found") == normalize_text("title")
    best = F.min_by(F.struct("key", "version"), F.struct(F.when(same, 0).otherwise(1), F.col("nth"))).alias("b")
    return titles.select("title").distinct().join(items, "title").groupBy("title").agg(best).select("title", "b.*")


def library_put(items: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The library after ``changes (key, version, data)``, and the keys with ``done``.

    A change is made only to an item that still has the version it was read with; the item's version then grows by one.
    Of several changes to an item the first by data counts and the others fail, as does one of an unknown key.
    """
    stored = items.select("key", F.col("version").alias("__has"), F.col("data").alias("__old"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.to_json("data")))
    judged = changes.withColumn("__nth", nth).join(stored, "key", "left").withColumn("done", F.coalesce((F.col("version") == F.col("__has")) & (F.col("__nth") == 1), F.lit(False)))
    made = judged.where("done").select("key", F.col("data").alias("__new"), F.lit(True).alias("__made"))
    out = items.join(made, "key", "left").select("key", F.when(F.col("__made"), F.col("version") + 1).otherwise(F.col("version")).alias("version"), F.when(F.col("__made"), F.col("__new")).otherwise(F.col("data")).alias("data"))
    return out, judged.select("key", "version", "done")


def parsed_tables(*parsers: DataFrame) -> DataFrame:
    """The tables of several parsers together: cells cleaned, rows without text and tables without rows left out."""
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    rows = F.filter(F.transform("rows", lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), cell)), lambda r: F.exists(r, lambda c: c != ""))
    out = parsers[0]
    for more in parsers[1:]:
        out = out.unionByName(more)
    return out.withColumn("rows", rows).where(F.size("rows") > 0).select("paper_id", "parser", "table_id", "page", "rows")


def venue_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``(venue, level)`` of a JSON file ``{"A": [...], "B": [...], "C": [...]}``."""
    raw = spark.read.schema("A array<string>, B array<string>, C array<string>").option("multiLine", True).json(path)
    return raw.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, "ABC")), F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in "ABC"]))).alias("level", "venues")).select("level", F.explode("venues").alias("venue"))


def binary_text(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``(path, text, sha256)`` of text files; other formats plug in their own decoder of the content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))


def pages_of(text: Column, first: int | None = None, page_break: str = "\n\n") -> Column:
    """The text of the first pages, or of all."""
    pages = F.split(F.coalesce(text, F.lit("")), page_break)
    return F.array_join(pages if first is None else F.slice(pages, 1, first), "\n")


def paper_texts(pages: DataFrame, markdown: DataFrame) -> DataFrame:
    """``(paper_id, text, kind)`` of ``pages (paper_id, text)`` and what a parser made, ``markdown (paper_id, markdown)``.

    A paper's text is its Markdown (the least where a parser landed several) unless that is missing or blank, else its
    pages' text; papers without pages are those of the Markdown alone. Ids of pages are unique.
    """
    made = markdown.groupBy("paper_id").agg(F.min(F.when(F.trim("markdown") != "", F.col("markdown"))).alias("made"))
    both = pages.select("paper_id", F.col("text").alias("whole")).join(made, "paper_id", "full_outer")
    return both.select("paper_id", F.coalesce("made", "whole").alias("text"), F.when(F.col("made").isNotNull(), "markdown").otherwise("pages").alias("kind"))


def completions(prompts: DataFrame, model=None) -> DataFrame:
    """``prompts`` with an answer of a model given as a function of a list of texts; without one all are null.

    The function is called on batches in the workers. Where it fails on a batch, or answers another number of prompts,
    each prompt of the batch is asked alone, and one that fails alone has no answer; a null prompt is never asked.
    """
    if model is None:
        return prompts.withColumn("answer", F.lit(None).cast("string"))

    def answers(asked: list[str]) -> list[str | None]:
        try:
            found = list(model(asked))
            if len(found) == len(asked):
                return found
        except Exception:  # noqa: BLE001  a service that fails gives no answer
            pass
        return [None] if len(asked) == 1 else [a for p in asked for a in answers([p])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            known = frame["prompt"].notna()
            out = pd.Series([None] * len(frame), index=frame.index, dtype=object)
            if known.any():
                out[known] = answers(frame["prompt"][known].tolist())
            yield frame.assign(answer=out)

    ship_package(prompts.sparkSession)
    return prompts.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", answer string")
