"""Scores and contexts extracted from lines and tables of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import DATASETS, clean_line, lines
from ..functions.scalar import to_metric

# The patterns by which scores are read from a line.
PRF = r"(?i)\bP(?:recision)?\s*[:=]?\s*(\d+(?:\.\d+)?)\b.*?\bR(?:ecall)?\s*[:=]?\s*(\d+(?:\.\d+)?)\b.*?\bF1?\s*[:=]?\s*(\d+(?:\.\d+)?)\b"
TRIGGER_F1 = r"(?i)trigger\s*f1\s*[:=]?\s*(\d+(?:\.\d+)?)"
ARGUMENT_F1 = r"(?i)argument\s*f1\s*[:=]?\s*(\d+(?:\.\d+)?)"
METRICS = ("precision", "recall", "f1", "trigger_f1", "argument_f1")


def dataset_of(line: Column) -> Column:
    """The first known dataset that a line names, without its space; white space in the line need not be cleaned."""
    low = F.lower(line)
    out = F.lit(None).cast("string")
    for name in reversed(DATASETS):
        words = name.lower().split(" ")
        held = low.contains(words[0])
        if len(words) > 1:  # only then does white space matter
            held &= low.rlike("(?U)" + r"\s+".join(words))
        out = F.when(held, name.replace(" ", "")).otherwise(out)
    return out


def line_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 40) -> DataFrame:
    """Scores in lines that name a dataset: precision, recall and F1 together, or trigger and argument F1.

    Equal scores of a document count once, at their first line; at most ``limit`` a document.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(lines(text_col)).alias("at", "raw")).withColumn("dataset_name", dataset_of(F.col("raw"))).where("dataset_name IS NOT NULL")
    rows = rows.select("id", "at", "dataset_name", clean_line("raw").alias("line"))
    group = lambda pattern, k: to_metric(F.nullif(F.regexp_extract("line", pattern, k), F.lit("")))
    none = F.lit(None).cast("double")
    trig, arg = TRIGGER_F1, ARGUMENT_F1
    shape = lambda k, values, conf: F.struct(F.lit(k).alias("k"), *[v.cast("double").alias(m) for m, v in zip(METRICS, values, strict=True)], F.lit(conf).alias("confidence"))
    first = F.when(F.col("line").rlike(PRF), shape(0, [group(PRF, 1), group(PRF, 2), group(PRF, 3), none, none], 0.8))
    second = F.when(F.col("line").rlike(trig) | F.col("line").rlike(arg), shape(1, [none, none, none, group(trig, 1), group(arg, 1)], 0.72))
    found = rows.select("id", "at", "dataset_name", F.substring("line", 1, 280).alias("source"), F.explode(F.array_compact(F.array(first, second))).alias("m")).select("id", "at", "dataset_name", "source", "m.*")
    w = Window.partitionBy("id", "dataset_name", *METRICS).orderBy("at", "k")
    once = found.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    kept = once.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("at", "k"))).where(F.col("nth") <= limit)
    return kept.select(F.col("id").alias(id_col), "nth", "dataset_name", *METRICS, "confidence", "source")


def table_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, cells, line)`` of the lines that hold cells parted by bars; empty cells are left out of the line."""
    rows = docs.select(F.col(id_col), F.posexplode(lines(text_col)).alias("row", "raw")).where(F.col("raw").contains("|"))
    cells = F.transform(F.split("raw", r"\|"), lambda c: clean_line(c))
    return rows.select(id_col, "row", cells.alias("cells"), F.array_join(F.filter(cells, lambda c: c != ""), " | ").alias("line"))


# Which headers name a dataset or a score; a score takes the first column whose header fits.
HEADERS = {
    "dataset_name": (("dataset", "corpus"), ("data", "bench")),
    "precision": (("precision",), ("p", "prec")),
    "recall": (("recall",), ("r",)),
    "f1": (("f1",), ("f",)),
    "trigger_f1": (("trigger", "f1"), ()),
    "argument_f1": (("argument", "f1"), ()),
}


def header_column(header: Column, name: str) -> Column:
    """The place, from 0, of the first header that names a score or the dataset; null without any."""
    parts, whole = HEADERS[name]
    join = Column.__and__ if name in ("trigger_f1", "argument_f1") else Column.__or__
    fits = lambda h: reduce(join, [F.lower(h).contains(p) for p in parts]) | F.lower(h).isin(*whole)
    at = F.array_position(F.transform(header, fits), True)
    return F.when(at > 0, (at - 1).cast("int"))


def names_dataset(cell: Column) -> Column:
    return F.coalesce(reduce(Column.__or__, [F.lower(cell).contains(d.lower()) for d in DATASETS]), F.lit(False))


def table_rows(tables: DataFrame) -> DataFrame:
    """``(paper_id, parser, table_id, row_index, dataset_name, at, cells)`` of the body rows that name a known dataset.

    ``tables (paper_id, parser, table_id, rows)`` hold cells as text, headers first; ``at`` says which column holds
    which score. A row's dataset is its dataset cell (the first one where no header names it), else its first cell that
    names a known one, without its spaces.
    """
    clean = F.transform("rows", lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), lambda c: clean_line(c)))
    known = tables.select("paper_id", "parser", "table_id", clean.alias("rows")).where(F.size("rows") >= 2)
    header = F.get("rows", F.lit(0))
    at = F.struct(*[header_column(header, m).alias(m) for m in HEADERS])
    body = known.withColumn("at", at).select("paper_id", "parser", "table_id", "at", F.posexplode("rows").alias("row_index", "cells")).where("row_index > 0 AND size(cells) > 0")
    own = F.get("cells", F.coalesce("at.dataset_name", F.lit(0)))
    named = F.when(names_dataset(own), own).otherwise(F.get(F.filter("cells", names_dataset), F.lit(0)))
    return body.withColumn("dataset_name", F.replace(named, F.lit(" "), F.lit(""))).where("dataset_name <> ''")


def _score(metric: str) -> Column:
    cell = F.get("cells", F.col(f"at.{metric}"))
    return to_metric(F.nullif(F.regexp_extract(F.coalesce(cell, F.lit("")), r"(\d+(?:\.\d+)?)", 1), F.lit("")))


def _trust() -> Column:
    return F.when(F.col("parser") == "gmft", 0.86).otherwise(0.78)


def table_metrics(tables: DataFrame, limit: int = 80) -> DataFrame:
    """Scores of tables: one row per table row that names a known dataset and holds a score, with where it stands.

    Rows of a paper with equal dataset and scores count once, the first in order of table and row; ``limit`` a paper.
    """
    rows = table_rows(tables).select("*", *[_score(m).alias(m) for m in METRICS]).where(F.coalesce(*METRICS).isNotNull())
    first = Window.partitionBy("paper_id", "dataset_name", *METRICS).orderBy("table_id", "row_index")
    once = rows.withColumn("__rn", F.row_number().over(first)).where("__rn = 1")
    kept = once.withColumn("__nth", F.row_number().over(Window.partitionBy("paper_id").orderBy("table_id", "row_index"))).where(F.col("__nth") <= limit)
    last = F.coalesce(*[F.when(F.col(m).isNotNull(), F.col(f"at.{m}")) for m in reversed(METRICS)])
    source = F.concat("table_id", F.lit(" row "), F.col("row_index").cast("string"))
    return kept.select("paper_id", "table_id", "row_index", "dataset_name", *METRICS, _trust().alias("confidence"), last.alias("col_index"), F.get("cells", last).alias("cell_text"), source.alias("source"))


def table_cells(tables: DataFrame) -> DataFrame:
    """Each score of ``table_metrics`` as a row of its own, before repeats and the limit: what the table says where."""
    scored = table_rows(tables).select("paper_id", "parser", "table_id", "row_index", "dataset_name", *[_score(m).cast("double").alias(m) for m in METRICS], *[F.col(f"at.{m}").alias(f"{m}_at") for m in METRICS], "cells")
    cell = lambda m: F.struct(F.lit(m).alias("metric_key"), F.col(m).alias("metric_value"), F.col(f"{m}_at").alias("col_index"), F.get("cells", F.col(f"{m}_at")).alias("cell_text"))
    rows = scored.withColumn("all", F.filter(F.array(*map(cell, METRICS)), lambda c: c["metric_value"].isNotNull())).withColumn("c", F.explode("all"))
    return rows.select("paper_id", "table_id", "row_index", "dataset_name", "c.metric_key", "c.metric_value", "c.col_index", "c.cell_text", "parser", _trust().alias("confidence"))


# Words that do not identify a title.
COMMON_TITLE_WORDS = ("using", "model", "method")


def citation_contexts(refs: DataFrame) -> DataFrame:
    """``refs`` with ``context``: of rows ``(text, title, doi)``, the sentence of the text that names the reference.

    The body before the references is searched for the first of the title's first three telling words that occurs,
    else for the DOI; the sentence has 360 characters at most.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    mark = F.regexp_extract(low, r"(?s)^(.*?)\n\s*(references|bibliography|参考文献)\b", 1)
    body = F.when(low.rlike(r"\n\s*(references|bibliography|参考文献)\b"), F.substring("text", F.lit(1), F.length(mark))).otherwise(F.coalesce("text", F.lit("")))
    body_low = F.lower(body)
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("[a-z0-9]{4,}"), F.lit(0)), lambda w: ~w.isin(*COMMON_TITLE_WORDS))
    hits = F.filter(F.transform(F.slice(words, 1, 3), lambda w: F.locate(w, body_low) if isinstance(w, str) else F.instr(body_low, w)), lambda i: i > 0)
    doi_at = F.when(F.coalesce("doi", F.lit("")) != "", F.instr(body_low, F.lower(F.trim("doi"))))
    at = F.coalesce(F.get(hits, F.lit(0)), F.when(doi_at > 0, doi_at))
    before, after = F.substring(body, F.lit(1), at - 1), F.substring(body, at, F.length(body))
    left = F.regexp_extract(before, r"(?s)([^.。!?]*)$", 1)
    right = F.when(after.rlike("[.。!?]"), F.regexp_extract(after, r"(?s)^([^.。!?]*[.。!?])", 1)).otherwise(F.substring(after, 1, 260))
    return refs.withColumn("context", F.when(at.isNotNull(), F.substring(clean_line(F.concat(left, right)), 1, 360)))
