"""Concepts: canonical names, co-occurrence, support, and the upsert that joins aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import canonical_concept


def co_occurrence(links: DataFrame, least: int = 2) -> DataFrame:
    """``(a, b, n)``: pairs of concepts, ``a < b``, with the number of papers that name both.

    A paper's concepts are few and distinct, so the pairs of one paper are made from its own sorted array.
    """
    sets = links.select("paper_id", "concept_id").distinct().groupBy("paper_id").agg(F.sort_array(F.collect_list("concept_id")).alias("c"))
    pairs = sets.select(F.explode(F.flatten(F.transform("c", lambda x, i: F.transform(F.slice("c", i + 2, F.size("c")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))).select("col.a", "col.b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def support(concepts: DataFrame, links: DataFrame, least: int = 1) -> DataFrame:
    """Concepts with the papers that name them, those of enough support."""
    papers = links.groupBy("concept_id").agg(F.count_distinct("paper_id").alias("papers"))
    return concepts.join(papers, "concept_id", "left").na.fill(0, ["papers"]).where(F.col("papers") >= least)


def upsert_concepts(names: DataFrame, most_aliases: int = 40) -> DataFrame:
    """``(canonical, type, aliases)`` of named concepts; the same word as an event and a role is two concepts."""
    keyed = names.select(canonical_concept("name").alias("canonical"), F.col("concept_type").alias("type"), F.trim("name").alias("alias")).where("canonical IS NOT NULL")
    first = keyed.groupBy("canonical", "type", F.lower("alias").alias("k")).agg(F.min("alias").alias("alias"))
    return first.groupBy("canonical", "type").agg(F.slice(F.sort_array(F.collect_list("alias")), 1, most_aliases).alias("aliases"))
