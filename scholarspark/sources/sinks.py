"""Exports of papers as CSV, Markdown and BibTeX rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_present, present
from ..operators.lineage import number_rows

CSV_COLUMNS = ("order", "title", "authors", "year", "venue", "doi", "url")


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def csv_lines(papers: DataFrame) -> DataFrame:
    """``(order, line)``: each paper as a line of quoted fields, in order of id."""
    rows = number_rows(papers, ["id"], "order").select("order", "title", "authors", "year", first_present("venue").alias("venue"), "doi", F.when(present("doi").isNotNull(), F.concat(F.lit("https://doi.org/"), F.trim("doi"))).alias("url"))
    return rows.select("order", F.array_join(F.array(*[quoted(F.col(c)) for c in CSV_COLUMNS]), ",").alias("line"))


def write_csv(papers: DataFrame, path: str) -> None:
    papers.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def markdown_lines(papers: DataFrame) -> DataFrame:
    text = F.format_string("- **%s** (%s) %s", F.coalesce("title", F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.coalesce("authors", F.lit("")))
    return papers.select("id", text.alias("line"))


def bibtex_entries(papers: DataFrame) -> DataFrame:
    """``(id, key, type)``: citation keys of last name, year and first title word; later papers of a key are numbered."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    last = plain(F.regexp_extract(F.coalesce("authors", F.lit("")), r"(\S+)\s*(?:,|$)", 1))
    word = plain(F.regexp_extract(F.coalesce("title", F.lit("")), r"(\S+)", 1))
    base = F.concat(last, F.coalesce(F.col("year").cast("string"), F.lit("")), word)
    venue = F.lower(F.coalesce("venue", F.lit("")))
    kind = F.when(venue.rlike("journal|transactions|letters"), "article").when(venue.rlike("proc|conference|meeting|workshop|symposium"), "inproceedings").otherwise("misc")
    nth = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    return papers.select("id", base.alias("base"), kind.alias("type")).withColumn("n", nth).select("id", F.when(F.col("n") > 1, F.concat("base", F.col("n").cast("string"))).otherwise(F.col("base")).alias("key"), "type")
