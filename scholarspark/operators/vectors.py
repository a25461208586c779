"""A persistent collection of vectors in cells around centroids, searched exactly by probing as few cells as it takes.

Centroids come from rounds of k-means over the vectors' directions. Each vector is written to the cell of its nearest
centroid, a folder of its own, and a small table keeps each cell's centroid and radius: the widest angle of a member. A query
at angle a from a centroid of radius r is at least a - r from every member, which bounds the cell's best cosine; cells are
read in order of that bound until no cell left can hold a vector better than the k-th found.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import cosine
from .lineage import scratch_dir, ship_package

#: Most cells: their centroids are held by the driver and each task.
MOST_CELLS = 4096
#: Most vectors that the centroids are fitted on, a share of all by hash of their id; every vector is in the collection.
FIT_ROWS = 200_000
# The least and the most answers of a search.
LEAST, MOST = 1, 20


def directions(column: pd.Series, dims: int) -> np.ndarray:
    """Unit vectors; those that are null, zero, not finite or of another length are rows of NaN."""
    out = np.full((len(column), dims), np.nan)
    for k, v in enumerate(column):
        if v is not None and len(v) == dims:
            out[k] = v
    with np.errstate(all="ignore"):
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    out[~np.isfinite(out).all(axis=1)] = np.nan
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, vec_col: str) -> DataFrame:
    """``vectors`` with ``cell`` (the nearest centroid, the first of equal ones; null without a direction) and ``angle`` to it."""
    dims = centroids.shape[1]
    ship_package(vectors.sparkSession)

    @F.pandas_udf("cell int, angle double")
    def nearest(column: pd.Series) -> pd.DataFrame:
        unit = directions(column, dims)
        near = np.nan_to_num(unit, nan=0.0) @ centroids.T
        cell = near.argmax(axis=1)
        none = np.isnan(unit[:, 0])
        angle = np.arccos(np.clip(near[np.arange(len(near)), cell], -1, 1))
        return pd.DataFrame({"cell": pd.array(np.where(none, None, cell), dtype="Int32"), "angle": np.where(none, np.nan, angle)})

    return vectors.withColumn("__near", nearest(vec_col)).select(*vectors.columns, "__near.cell", "__near.angle")


def fit_centroids(vectors: DataFrame, cells: int, id_col: str, vec_col: str, rounds: int = 4, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Unit centroids by k-means on cosines: sums by cell in each round, one row a cell to the driver; no vectors, none."""
    n = vectors.count()
    order = F.xxhash64(id_col, F.lit(7))
    some = vectors if n <= fit_rows else vectors.where(F.pmod(order, F.lit(-(-n // fit_rows))) == 0)
    first = [np.asarray(r[0], dtype=float) for r in some.where(F.col(vec_col).isNotNull()).orderBy(order, id_col).limit(2 * cells).select(vec_col).collect()]
    if not first:
        return np.zeros((0, 1))
    dims = max(len(v) for v in first)
    unit = directions(pd.Series(first), dims)
    unit = np.unique(unit[~np.isnan(unit[:, 0])], axis=0)[:cells]

    @F.pandas_udf("array<double>")
    def unit_of(column: pd.Series) -> pd.Series:
        return pd.Series(list(directions(column, dims)))

    for _ in range(rounds):
        if not len(unit):
            break
        rows = assigned(some.select(id_col, vec_col), unit, vec_col).where("cell IS NOT NULL").select("cell", unit_of(vec_col).alias("u"))
        sums = rows.groupBy("cell").agg(*[F.sum(F.get("u", F.lit(d))).alias(f"d{d}") for d in range(dims)]).collect()  # one row a cell
        moved = unit.copy()
        for r in sums:
            v = np.array(r[1:], dtype=float)
            if np.linalg.norm(v) > 0:
                moved[r.cell] = v / np.linalg.norm(v)
        if np.allclose(moved, unit):
            break
        unit = moved
    return unit


class VectorCollection:
    """The collection under ``path``, as ``write`` made it."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vec_col = spark, path.rstrip("/"), id_col, vec_col
        self.cells_read = 0

    @classmethod
    def write(cls, vectors: DataFrame, path: str | None = None, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None) -> VectorCollection:
        """Write all rows of ``vectors``, about the square root of their number of cells (``MOST_CELLS`` at most).

        Vectors without a direction (null, zero, not finite, of another length) are in no cell and never found, as is a row without an id.
        """
        spark = vectors.sparkSession
        path = path or f"{scratch_dir(spark)}/vectors-{uuid.uuid4().hex}"
        known = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        wanted = cells or max(1, min(MOST_CELLS, math.isqrt(known.count())))
        centroids = fit_centroids(known, wanted, id_col, vec_col)
        if not len(centroids):
            centroids = np.zeros((1, 1))
        placed = assigned(known, centroids, vec_col).where("cell IS NOT NULL")
        placed.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{path}/vectors")
        held = spark.read.schema(placed.schema).parquet(f"{path}/vectors")  # perhaps without a file
        radii = held.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        middle = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
        radii.join(F.broadcast(middle), "cell").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path, id_col, vec_col)

    def bounds(self, query: list[float]) -> list[tuple[float, int, int]]:
        """``(best cosine that the cell can hold, cell, vectors)`` of all cells, best first."""
        q = np.asarray(query, dtype=float)
        q = q / np.linalg.norm(q)
        out = []
        for r in self.spark.read.parquet(f"{self.path}/cells").collect():  # ``MOST_CELLS`` rows at most
            apart = math.acos(max(-1.0, min(1.0, float(q @ np.asarray(r.centroid)))))
            out.append((math.cos(max(0.0, apart - r.radius)) + 1e-9, r.cell, r.n))
        return sorted(out, key=lambda x: (-x[0], x[1]))

    def cell_rows(self, cells: list[int]) -> DataFrame:
        """The vectors of some cells; the folders of others are not listed among the files read."""
        return self.spark.read.parquet(f"{self.path}/vectors").where(F.col("cell").isin(cells))

    def search(self, query: list[float], k: int = 5, first: int = 4, where: Column | None = None) -> DataFrame:
        """``(<id>, score)`` of the best ``2 k`` vectors (1 to 20 of them), score the cosine where it is over 0 and else 0.

        Ties go to the smaller id; with ``where``, a condition on the written columns, only rows that meet it count.
        ``first`` cells are read, then ever twice as many, until none left can change the result. A query without a direction finds nothing. ``cells_read`` counts cells afterwards.
        """
        self.cells_read = 0
        wanted = min(max(LEAST, 2 * k), MOST)
        schema = f"{self.id_col} long, score double"
        if not query or not np.isfinite(query).all() or not np.linalg.norm(query):
            return self.spark.createDataFrame([], schema)
        cells = self.bounds(query)
        q = F.array(*[F.lit(float(x)) for x in query])
        best: list[tuple] = []
        at, size = 0, first
        while at < len(cells):
            some = cells[at : at + size]
            # scores under 0 count as 0: of such vectors the smallest ids are wanted, wherever they are
            if len(best) == wanted and max(some[0][0], 0.0) < best[-1][1]:
                break
            rows = self.cell_rows([c for _, c, _ in some])
            rows = (rows if where is None else rows.where(where)).select(self.id_col, F.greatest(F.lit(0.0), cosine(F.col(self.vec_col).cast("array<double>"), q)).alias("score"))
            best += [tuple(r) for r in rows.orderBy(F.desc("score"), self.id_col).limit(wanted).collect()]
            best = sorted(best, key=lambda r: (-r[1], r[0]))[:wanted]
            self.cells_read += len(some)
            at, size = at + size, size * 2
        return self.spark.createDataFrame(best, schema)
