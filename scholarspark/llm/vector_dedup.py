"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Unit vectors are projected on many Gaussian directions. Two of them at distance d differ by N(0, d^2) on each, so a
window of a few d around a query's value catches the other end of a true pair nearly always and an unrelated vector
seldom. A pair's collisions are counted over all directions; pairs whose count reaches a bound calibrated for the wanted
recall are verified by their exact cosine.

Which pairs are counted at all is settled by cells of other projections: a table of cells cuts ``k`` directions into
stretches with random offsets, and a pair meets where it shares a cell of any table. ``k`` grows with the logarithm of a
label's size, so that an unrelated vector is seldom met whatever the size, and the number of tables follows from the
wanted recall; a label that fits a block is one cell. Cells with one vector end there, before any vector moves.
A pair is counted in the first table whose cell it shares. Large cells are cut into blocks that meet two by two, each
meeting a task of bounded size; a task returns a sum and one tree edge for each vector, never its pairs.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_arrow, materialize, release, ship_package

#: Directions, half-width of a window in standard deviations, and the chance a true pair may be missed by its count.
DIRECTIONS, HALF_WIDTH, MISS = 24, 2.5, 1e-6
#: Width of a cell's stretches in standard deviations, unrelated vectors that a vector should meet in a cell, and most
#: vectors in a block.
CELL, MATES, BLOCK = 6.0, 0.25, 2048
#: Vectors in a cell up to which pairs are listed one by one; beyond it windows of sorted projections are looked up.
FEW = 64
#: Most labels whose table of sizes (60 bytes a row) is broadcast, and rows of a task's batch of meetings.
BROADCAST_LABELS, BATCH = 100_000, 4096


@lru_cache(maxsize=4096)
def tables_for(n: int, sigma: float, block: int = BLOCK, miss: float = MISS) -> tuple[int, int]:
    """``(k, tables)`` for a label of ``n`` vectors whose farthest true pairs differ by ``sigma`` on a direction.

    A true pair shares one direction's stretch with chance ``1 - E|N(0, 1)| / CELL`` at least, an unrelated pair with
    that of two standard normal values; both chances are powers of ``k`` for a cell.
    """
    if n <= block:
        return 0, 1
    near = 1 - math.sqrt(2 / math.pi) / CELL
    width = CELL * sigma
    grid = np.arange(-5, 5, 0.01)
    share = lambda at: 0.5 * (math.erf((at + width) / math.sqrt(2)) - math.erf(at / math.sqrt(2)))
    # over a random offset, the chance that two independent values fall into the same stretch
    far = min(0.9, float(sum(share(x) ** 2 for x in grid) * 0.01 / width))
    k = max(1, math.ceil(math.log(n / MATES) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def cells_of(units: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """For each unit vector the cell, as a hash of its stretches, that it has in each table."""
    if not k:
        return np.zeros((len(units), tables), np.int64)
    rng = np.random.default_rng([20240102, units.shape[1], k])
    directions, offsets = rng.normal(size=(units.shape[1], k * tables)), rng.uniform(0, width, k * tables)
    mix = rng.integers(1 << 62, size=k).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    stretch = np.floor((units @ directions + offsets) / width).astype(np.int64).astype(np.uint64).reshape(len(units), tables, k)
    return (stretch * mix).sum(axis=2, dtype=np.uint64).view(np.int64)


def least_collisions(directions: int = DIRECTIONS, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """The highest bound that a pair at the very threshold fails with a chance of at most ``miss``."""
    p = math.erf(half_width / math.sqrt(2))
    below, bound = 0.0, 0
    for k in range(directions + 1):
        below += math.comb(directions, k) * p**k * (1 - p) ** (directions - k)
        if below > miss:
            break
        bound = k + 1
    return bound


def collisions(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """How many of each query's windows each other vector falls into; rows of projections, at most 65,535 others."""
    counts = np.zeros((len(queries), len(others)), np.uint8)
    for q, o in zip(queries.T, others.T, strict=True):
        order = np.argsort(o, kind="stable")
        ranks = np.empty(len(o), np.uint16)
        ranks[order] = np.arange(len(o))
        low = np.searchsorted(o[order], q - half, "left").astype(np.uint16)
        span = np.searchsorted(o[order], q + half, "right").astype(np.uint16) - low
        counts += (ranks[None, :] - low[:, None]) < span[:, None]  # unsigned: a rank below the range wraps far above it
    return counts


def linked(i: np.ndarray, j: np.ndarray, unit: np.ndarray, min_cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose exact cosine is enough."""
    left, right = [i[:0]], [j[:0]]
    for k in range(0, len(i), 1 << 15):
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        near = np.einsum("nd,nd->n", unit[x], unit[y]) >= min_cos
        left.append(x[near]), right.append(y[near])
    return np.concatenate(left), np.concatenate(right)


def met_pairs(x: np.ndarray, y: np.ndarray, shadow: np.ndarray, half: float, bound: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows ``x`` with the rows ``y`` (with themselves, each pair once, if the same) that collide enough."""
    left, right = [], []
    for at in range(0, len(x), step):
        i, j = np.nonzero(collisions(shadow[x[at : at + step]], shadow[y], half) >= bound)
        i += at
        if y is x:
            i, j = i[i < j], j[i < j]
        left.append(x[i]), right.append(y[j])
    return (np.concatenate(left), np.concatenate(right)) if left else (x[:0], x[:0])


def listed_pairs(unit_of: np.ndarray, shadow: np.ndarray, half: float, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one unit that collide enough; rows are sorted by unit, no unit has more than ``FEW``."""
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for d in range(1, FEW):
        i = np.flatnonzero(unit_of[:-d] == unit_of[d:])
        if not len(i):
            break
        enough = (np.abs(shadow[i] - shadow[i + d]) <= half).sum(axis=1) >= bound
        left.append(i[enough]), right.append(i[enough] + d)
    return np.concatenate(left), np.concatenate(right)


def meet_in_units(bucket: np.ndarray, bi: np.ndarray, bj: np.ndarray, side: np.ndarray, table: np.ndarray, unit: np.ndarray, shadow: np.ndarray, cells: np.ndarray, min_cos: float, half: float, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of row numbers: rows of one cell and pair of blocks meet, each pair in its first common table."""
    order = np.lexsort((side, bj, bi, bucket))
    change = np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(bi[order]) != 0) | (np.diff(bj[order]) != 0)) + 1
    starts = np.concatenate([[0], change]) if len(order) else np.zeros(0, int)
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    left, right = [], []
    within = bi[order[starts]] == bj[order[starts]]
    few = within & (sizes <= FEW)
    small = np.repeat(few, sizes)
    rows = order[small]
    if len(rows) > 1:
        i, j = listed_pairs(np.repeat(np.arange(len(starts)), sizes)[small], shadow[rows], half, bound)
        left.append(rows[i]), right.append(rows[j])
    for at in np.flatnonzero(~few):
        rows = order[starts[at] : starts[at] + sizes[at]]
        x = rows[side[rows] == 0]
        i, j = met_pairs(x, x if within[at] else rows[side[rows] == 1], shadow, half, bound)
        left.append(i), right.append(j)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    i, j = linked(np.concatenate(left), np.concatenate(right), unit, min_cos)
    own = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 15):
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        own[k : k + (1 << 15)] = (cells[x] == cells[y]).argmax(axis=1) == table[x]
    return i[own], j[own]


def _padded(rows: list[bytes], kind) -> np.ndarray:
    """Byte strings of numbers as the rows of a matrix, shorter ones filled up with zeros."""
    wide = max(map(len, rows), default=0)
    return np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in rows), kind).reshape(len(rows), -1)


def _stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == old).all():
            return label


def vector_components(vectors: DataFrame, min_cos: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: ``(<id_col>, n_links, component_id, kept)``.

    Vectors of one label and dimension link at a cosine of ``min_cos`` or more in double precision. A null label, and a
    vector that is null, empty, all zero or holds a null or non-finite component, links with nothing and is its own
    component. Copies (equal label and components) collapse before the search; each counts as a link of the others. Rows
    that repeat an id are vectors like any other; a component's id is its smallest, null where none has one. No
    rows give no rows. Other columns are not read.
    """
    ship_package(vectors.sparkSession)
    sigma = math.sqrt(2 - 2 * min_cos)
    half, width, bound = HALF_WIDTH * sigma, CELL * sigma, least_collisions()
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("least_id"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")), "vector-classes")
    sizes = materialize(classes.groupBy("label", "dim").agg(F.count("*").alias("members")), "vector-labels")
    members = F.broadcast(sizes) if sizes.count() <= BROADCAST_LABELS else sizes

    def project(batch: pa.RecordBatch) -> dict:
        x = batch.column("vec")
        dims, members = batch.column("dim").to_numpy(), batch.column("members").to_numpy()
        units, shadows, cells = [b""] * len(x), [b""] * len(x), [b""] * len(x)
        plans: dict[tuple[int, int, int], list[int]] = {}
        for row, (d, m) in enumerate(zip(dims.tolist(), members.tolist(), strict=True)):
            plans.setdefault((d, *tables_for(m, sigma, block)), []).append(row)
        for (d, k, tables), at in plans.items():
            v = np.array([x[row].as_py() for row in at], np.float64)
            v /= np.abs(v).max(axis=1, keepdims=True)  # no component is too large or small to be squared
            v /= np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]
            shade = (v @ np.random.default_rng(20240101 + d).normal(size=(d, DIRECTIONS))).astype("f4")
            cell = cells_of(v, k, tables, width)
            for row, a, b, c in zip(at, v, shade, cell, strict=True):
                units[row], shadows[row], cells[row] = a.tobytes(), b.tobytes(), c.tobytes()
        return {"node": batch.column("node"), "label": batch.column("label"), "n": batch.column("n"), "dim": batch.column("dim"), "unit": units, "shadow": shadows, "cells": cells, "cell": [np.frombuffer(c, np.int64) for c in cells]}

    shadows = materialize(map_arrow(classes.join(members, ["label", "dim"]).select("node", "label", "n", "dim", "members", "vec"), project, "node long, label string, n long, dim int, unit binary, shadow binary, cells binary, cell array<long>"), "vector-shadows")
    keyed = shadows.select("label", "dim", "node", F.posexplode("cell").alias("tab", "cell"))
    buckets = keyed.groupBy("label", "dim", "tab", "cell").agg(F.count("*").alias("met")).where("met > 1")
    buckets = materialize(buckets.select("label", "dim", "tab", "cell", "met", F.ceil(F.col("met") / block).cast("int").alias("blocks"), F.monotonically_increasing_id().alias("bucket")), "vector-cells")
    meetings = buckets.agg(F.coalesce(F.sum(F.col("met") * F.col("blocks")), F.lit(0))).first()[0]  # one number
    b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("b"), k).alias("i"), F.greatest(F.col("b"), k).alias("j"), F.when(F.col("b") <= k, 0).otherwise(1).alias("side")))
    met = keyed.join(buckets, ["label", "dim", "tab", "cell"]).select("node", "tab", "bucket", "blocks", b.alias("b")).select("node", "tab", "bucket", F.explode(units).alias("u")).select("node", "tab", "bucket", "u.*")
    batches = max(1, math.ceil(meetings / BATCH))
    dealt = met.join(shadows.select("node", "n", "unit", "shadow", "cells"), "node").withColumn("batch", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(batches)))

    def meet(table: pa.Table) -> pa.Table:
        col = lambda name: table.column(name).to_numpy()
        read = lambda name, kind: _padded(table.column(name).to_pylist(), kind)
        node, n = col("node"), col("n")
        i, j = meet_in_units(col("bucket"), col("i"), col("j"), col("side"), col("tab"), read("unit", np.float64), read("shadow", np.float32), read("cells", np.int64), min_cos, half, bound)
        # a vector is there once for each of its meetings
        nodes, first, place = np.unique(node, return_index=True, return_inverse=True)
        i, j, n = place[i], place[j], n[first]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        rep = _stars(len(nodes), i, j)
        seen = np.flatnonzero(links)
        return pa.table({"node": pa.array(nodes[seen], pa.int64()), "links": pa.array(links[seen], pa.int64()), "rep": pa.array(nodes[rep[seen]], pa.int64())})

    found = materialize(dealt.groupBy("batch").applyInArrow(meet, "node long, links long, rep long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("node <> rep"), "node", "rep")
    named = classes.select("node", "label", "vec", "n", "least_id").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    named = materialize(named.select("node", "label", "vec", "n", "least_id", "links", "root"), "vector-named")
    for table in (classes, sizes, shadows, buckets, found, roots):
        release(table)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = named.join(least, "root").select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    good = rows.where("usable").join(of, ["label", "vec"]).select("id", "n_links", "component_id")
    out = good.unionByName(rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
