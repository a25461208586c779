"""Upkeep of the paper tables: aliases, levels, fields, notes, mappings from libraries and models, and backfills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.scalar import first_present, present
from . import chunking, entity, extraction, relational


def first_seen(rows: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """Of values of a group that are equal ignoring case, the one at the first place."""
    w = Window.partitionBy(group, F.lower(value)).orderBy(at)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def alias_union(rows: DataFrame, group: str, alias: str, most: int = 40) -> DataFrame:
    """The distinct lower-case aliases of a group, sorted, ``most`` of them."""
    known = rows.where(present(alias).isNotNull() & present(group).isNotNull())
    return known.groupBy(group).agg(F.slice(F.sort_array(F.collect_set(F.lower(alias))), 1, most).alias("aliases"))


def learn_aliases(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``known (alias, level)`` with what ``seen (alias, level)`` adds; an alias that is known keeps its level.

    Of several levels seen for an alias the first by name counts; a blank alias or level teaches nothing.
    """
    new = seen.where(present("alias").isNotNull() & present("level").isNotNull()).groupBy("alias").agg(F.min("level").alias("level"))
    return known.select("alias", "level").unionByName(new.join(known.select("alias"), "alias", "left_anti").select("alias", "level"))


#: Most names of a list of ranked venues.
MOST_RANKS = 100_000


def venue_levels(venues: DataFrame, ranks: DataFrame, venue: str = "venue") -> DataFrame:
    """``(<venue>, level)``: the best level of a ranked name that a venue holds, or that holds it, or of its acronym.

    Each distinct venue is ranked once; ``ranks (level, name)`` is a list of ``MOST_RANKS`` venues at most, broadcast as such.
    """
    if ranks.limit(MOST_RANKS + 1).count() > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} ranked venues")
    names = F.broadcast(ranks.select("level", X.venue_norm("name").alias("__name"), F.upper("name").alias("__abbr")))
    asked = venues.select(present(venue).alias(venue)).where(F.col(venue).isNotNull()).distinct()
    v = X.venue_norm(venue)
    hit = v.contains(F.col("__name")) | F.col("__name").contains(v) | F.array_contains(X.venue_candidates(venue), F.col("__abbr"))
    return asked.join(names, hit).groupBy(venue).agg(F.min("level").alias("level"))


def relevel(papers: DataFrame, ranks: DataFrame, venue: Column | None = None) -> DataFrame:
    """``papers`` whose ``ccf_level`` is that of their venue, where one is found; else it stays."""
    of = papers.withColumn("__venue", present("venue") if venue is None else venue)
    return of.join(venue_levels(of, ranks, "__venue"), "__venue", "left").withColumn("ccf_level", F.coalesce("level", "ccf_level")).select(*papers.columns)


def promote_fields(fields: DataFrame, clusters: DataFrame) -> DataFrame:
    """``fields (name)`` with the labels of tag clusters that no field has, ignoring case."""
    new = clusters.select(F.trim("label").alias("name")).where("name <> ''").groupBy(F.lower("name").alias("__low")).agg(F.min("name").alias("name"))
    return fields.select("name").unionByName(new.join(fields.select(F.lower("name").alias("__low")), "__low", "left_anti").select("name"))


def cleanup_due(runs: DataFrame, now: int, every: int = 86400) -> DataFrame:
    """``(job_type, due)``: whether a job of a type last ran ``every`` seconds ago or more."""
    return runs.groupBy("job_type").agg((F.max("created_at") + every <= now).alias("due"))


def fill_if_blank(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with each named column filled where it is null or blank."""
    return df.withColumns({c: F.coalesce(present(F.trim(c)), v) for c, v in values.items()})


def library_fields(items: DataFrame) -> DataFrame:
    """A library's items ``(key, data)`` as a paper's fields: names of creators, the year in the date, the head of the extra."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return items.select("key", blank("data.title").alias("title"), X.name_of_creators("data.creators").alias("authors"), X.first_year("data.date").alias("year"), F.substring(blank("data.extra"), 1, 300).alias("summary_one"), blank("data.publicationTitle").alias("venue"), blank("data.DOI").alias("doi"))


def normalise_metadata(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Model answers as metadata: text trimmed or null, the year a whole number, a field as it is spelled in ``fields``.

    An open field that only repeats the field is dropped.
    """
    text = [c for c, kind in rows.dtypes if kind == "string" and c != "year"]
    out = rows.withColumns({c: present(F.trim(c)) for c in text})
    if "year" in rows.columns:
        year = F.when(F.col("year").cast("string").rlike(r"^\d+(\.\d*)?$"), F.col("year").cast("double").cast("int")) if dict(rows.dtypes)["year"] != "string" else F.when(F.col("year").rlike(r"^\d+$"), F.col("year").try_cast("int"))
        out = out.withColumn("year", year)
    if "sub_field" in rows.columns:
        spelled = F.col("sub_field")
        for name in reversed(fields):
            spelled = F.when(F.lower("sub_field") == name.lower(), F.lit(name)).otherwise(spelled)
        out = out.withColumn("sub_field", spelled)
        if "open_sub_field" in rows.columns:
            out = out.withColumn("open_sub_field", F.when(~F.lower("open_sub_field").eqNullSafe(F.lower("sub_field")), F.col("open_sub_field")))
    return out


NOTE_FIELDS = ("method", "datasets", "conclusions", "reproducibility", "risks", "notes")


def merge_notes(notes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Notes after ``mapping (old_id, new_id)``: the kept paper's fields, filled from those merged into it."""
    m = mapping.select(F.col("old_id").alias("paper_id"), "new_id")
    to = notes.join(m, "paper_id", "left").withColumn("__to", F.coalesce("new_id", "paper_id"))
    order = F.struct(F.when(F.col("paper_id") == F.col("__to"), 0).otherwise(1), F.col("paper_id"))
    value = lambda c: F.coalesce(F.min_by(c, F.when(present(c).isNotNull(), order)), F.min_by(c, F.when(F.col(c).isNotNull(), order)))
    fields = [value(c).alias(c) for c in notes.columns if c in NOTE_FIELDS]
    return to.groupBy(F.col("__to").alias("paper_id")).agg(*fields)


def move_rows(rows: DataFrame, mapping: DataFrame, column: str = "paper_id") -> DataFrame:
    """Rows of merged papers under the kept paper's id."""
    m = mapping.select(F.col("old_id").alias(column), F.col("new_id").alias("__new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).select(*rows.columns)


def auto_merge(papers: DataFrame, threshold: float = 0.96) -> DataFrame:
    """``(old_id, new_id, group_id)`` of the papers of nearly equal titles and the one of each group that is kept.

    Kept is a paper with a file, then the most cited, the newest updated, the first. Edges and notes follow by
    ``entity.merge_papers``, ``move_rows`` and, if wanted, ``merge_notes``.
    """
    groups = entity.duplicate_groups(entity.title_pairs(papers, threshold))
    known = papers.select("id", present("file_path").isNotNull().alias("has"), F.coalesce("citation_count", F.lit(0)).alias("cited"), F.coalesce("updated_at", F.lit(0)).alias("updated"))
    rows = groups.join(known, "id")
    keeper = rows.groupBy("group_id").agg(F.max_by("id", F.struct("has", "cited", "updated", -F.col("id"))).alias("new_id"))
    return rows.join(keeper, "group_id").select(F.col("id").alias("old_id"), "new_id", "group_id")


def backfill(papers: DataFrame, texts: DataFrame, tables: DataFrame, summary: bool = True, references: bool = True, embeddings: bool = True, metrics: bool = True, force: bool = False, limit: int = 10, summarise=None) -> dict[str, DataFrame]:
    """What a backfill adds, as tables, and its ``counters``: one row.

    ``texts (paper_id, text)`` are the papers' full texts, ``tables`` their parsed tables. Taken are the newest uploaded
    papers that lack a summary or parsed references, or with ``force`` all. Each step runs only where it is asked for and
    its result is missing: a summary (``summarise`` adds ``answer`` to rows with ``prompt``, none is given without it),
    references (DOIs at the end of the text), chunks, schema words, and scores of lines and tables.
    """
    picked = relational.backlog(papers, summary and not force, references and not force, limit)
    wants = lambda missing: F.lit(True) if force else missing
    full = picked.select(F.col("id").alias("paper_id")).join(texts, "paper_id").where(present("text").isNotNull())
    out: dict[str, DataFrame] = {}
    none = picked.limit(0)
    asked = picked.where(wants(present("summary_one").isNull())).select("id", F.concat_ws("\n", "title", "abstract").alias("prompt"))
    answers = summarise(asked) if summary and summarise else none.select("id", F.lit("").alias("prompt"), F.lit("").alias("answer"))
    out["summaries"] = answers.where(present("answer").isNotNull()).select("id", F.col("answer").alias("summary_one"))
    parsed = picked.where(wants(F.col("refs_parsed_at").isNull())) if references else none
    ends = parsed.select(F.col("id").alias("paper_id")).join(texts, "paper_id").select("paper_id", X.references_section("text").alias("refs"))
    out["references"] = ends.select("paper_id", F.explode(X.all_dois("refs")).alias("doi"))
    out["chunks"] = chunking.chunk_documents(full if embeddings else full.limit(0), "paper_id")
    schema = (full if embeddings else full.limit(0)).select("paper_id", X.schema_fallback("text").alias("s")).select("paper_id", "s.*")
    out["schemas"] = schema.where(F.size("events") > 0)
    lines = extraction.line_metrics(full if metrics else full.limit(0), "paper_id").select("paper_id", "dataset_name", *extraction.METRICS, "confidence", "source")
    mine = tables.join(full.select("paper_id"), "paper_id", "left_semi") if metrics else tables.limit(0)
    scores = lines.unionByName(extraction.table_metrics(mine).select(*lines.columns))
    out["metrics"] = scores
    out["metric_cells"] = extraction.table_cells(mine)
    named = scores.withColumnsRenamed({"precision": "precision_", "recall": "recall_"}).withColumn("id", F.lit(None).cast("long"))
    out["experiments"] = entity.metrics_to_experiments(named).select("paper_id", "name", "metric_value", "is_sota")
    count = lambda name, df: df.agg(F.count("*").alias(name))
    counters = count("processed", picked)
    for name, table in (("summary_added", out["summaries"]), ("references_parsed", parsed), ("chunks_indexed", out["chunks"]), ("metrics_upserted", out["metrics"]), ("metric_cells_upserted", out["metric_cells"]), ("auto_experiments", out["experiments"]), ("schemas_extracted", out["schemas"])):
        counters = counters.join(F.broadcast(count(name, table)))  # one row each
    return out | {"counters": counters}


def venue_of(df: DataFrame) -> Column:
    """A paper's venue: where it appeared, else its venue."""
    return first_present(*[c for c in ("journal_conf", "venue") if c in df.columns])
