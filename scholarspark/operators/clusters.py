"""Clusters of papers by k-means over TF-IDF vectors in long form: rows of (paper, term, weight), centroids a small table.

The vocabulary and the number of clusters are bounded, so the centroids are too: they are broadcast, and a round is one
join on the term, one sum per paper and cluster, and one mean per cluster and term. Everything is ordered by hashes and ids,
so the result does not depend on how rows lie in partitions.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_present, present
from .lineage import materialize, release
from .retrieval import STOP_WORDS, WORD

#: Terms of the vocabulary: the commonest ones.
FEATURES = 2000
#: Most clusters, and the least number of texts to make any.
MOST, LEAST_TEXTS = 6, 4


def cluster_text(columns: list[str]) -> Column:
    """What a paper is clustered by: its tags, keywords, method, abstract or title, the first of its columns that is there."""
    listed = F.array_join(F.filter(F.from_json("dynamic_tags", "array<string>"), lambda x: x != ""), ", ")
    tags = F.when(F.col("dynamic_tags").startswith("[") & F.try_parse_json("dynamic_tags").isNotNull(), listed).otherwise(F.col("dynamic_tags"))
    return first_present(*[tags if c == "dynamic_tags" else c for c in ("dynamic_tags", "keywords", "proposed_method_name", "abstract", "title") if c in columns])


def tfidf_vectors(texts: DataFrame, features: int = FEATURES) -> DataFrame:
    """``(id, term, w)`` of ``texts (id, text)``: unit vectors over the commonest words of two characters or more."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    counts = texts.select("id", F.explode(words).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    counts = materialize(counts, "cluster-counts")
    common = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features)
    n = texts.count()
    weighed = counts.join(F.broadcast(common), "term").select("id", "term", (F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("w"))  # `features` rows
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    out = materialize(weighed.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w")), "cluster-vectors")
    release(counts)
    return out


def _distances(ids: DataFrame, vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``(id, cell, d)``: squared distances of all papers to all centroids ``(cell, term, c)``."""
    sizes = centroids.groupBy("cell").agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    dots = vectors.join(F.broadcast(centroids), "term").groupBy("id", "cell").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    every = ids.select("id", "unit").join(F.broadcast(sizes))  # papers by clusters, of which there are few
    return every.join(dots, ["id", "cell"], "left").select("id", "cell", F.round(F.col("unit") + F.col("cc") - 2 * F.coalesce("dot", F.lit(0.0)), 9).alias("d"))


def kmeans(ids: DataFrame, vectors: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """``(id, cell)``: cells from 0, of ``ids (id)`` and unit ``vectors (id, term, w)``; an id without a vector is a zero.

    The first centroid is the paper of the least id, each next one the paper farthest from those before it. Rounds end
    when no paper moves; an empty cell keeps its centroid; ties go to the smaller cell or id.
    """
    ids = materialize(ids.select("id").distinct().join(vectors.select("id").distinct().withColumn("unit", F.lit(1.0)), "id", "left").na.fill(0.0, ["unit"]), "cluster-ids")
    spark = ids.sparkSession
    vector = lambda cell, i: vectors.where(F.col("id") == i).select(F.lit(cell).alias("cell"), "term", F.col("w").alias("c")) if i is not None else None
    at_zero = lambda cell: spark.createDataFrame([(cell, "", 0.0)], "cell int, term string, c double")
    first = ids.agg(F.min("id")).first()[0]
    centroids = materialize(at_zero(0).unionByName(vector(0, first)), "cluster-centroids")
    for cell in range(1, k):
        far = _distances(ids, vectors, centroids).groupBy("id").agg(F.min("d").alias("d")).orderBy(F.desc("d"), "id").first()
        centroids = materialize(centroids.unionByName(at_zero(cell)).unionByName(vector(cell, far.id)), "cluster-centroids")
    cells = None
    for _ in range(rounds):
        nearest = materialize(_distances(ids, vectors, centroids).groupBy("id").agg(F.min_by("cell", F.struct("d", "cell")).alias("cell")), "cluster-cells")
        moved = cells is None or nearest.join(cells.toDF("id", "was"), "id").where("cell <> was").limit(1).count()
        if cells is not None:
            release(cells)
        cells = nearest
        if not moved:
            break
        held = cells.groupBy("cell").agg(F.count("*").alias("n"))
        means = vectors.join(cells, "id").groupBy("cell", "term").agg(F.sum("w").alias("s")).join(F.broadcast(held), "cell").select("cell", "term", (F.col("s") / F.col("n")).alias("c"))
        kept = centroids.join(F.broadcast(held), "cell", "left_anti")
        zeros = held.select("cell", F.lit("").alias("term"), F.lit(0.0).alias("c"))
        centroids = materialize(means.unionByName(kept).unionByName(zeros), "cluster-centroids")
    return cells


def paper_clusters(papers: DataFrame) -> DataFrame:
    """``(id, cluster)``: ``Cluster 1`` and so on of the papers that have a text, as many as the root of their number, 2 to 6.

    With fewer than four texts every paper's cluster is its field, ``Cluster 1`` where it has none. Papers that share an id
    count as the one of the least text; no papers give no rows.
    """
    texts = papers.select("id", cluster_text(papers.columns).alias("text")).where("text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    n = texts.count()
    if n < LEAST_TEXTS:
        return papers.select("id", F.coalesce(present("sub_field"), F.lit("Cluster 1")).alias("cluster")).distinct()
    cells = kmeans(texts.select("id"), tfidf_vectors(texts), max(2, min(MOST, isqrt(n))))
    return cells.select("id", F.concat(F.lit("Cluster "), (F.col("cell") + 1).cast("string")).alias("cluster"))
