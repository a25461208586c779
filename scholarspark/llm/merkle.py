"""A Merkle manifest of a dataset by parent preimages, and proofs of its rows from them.

Leaves are hashes of rows, numbered in order within their group. ``BLOCK`` neighbours meet in one row, which builds the
levels above them and stores, for each parent, its preimage: the hashes of its children put together. The roots of
blocks are the leaves of the next round, so a group of any size takes a handful of rounds and never one task; the roots of
groups are the leaves of one more tree.

A node's path is the preimages of its ancestors, with the slot of 64 characters that each keeps for it. Its siblings are what remains
when the slot is excised; folding splices another hash into the slot, hashes, and goes on one ancestor up. Paths come
down block by block, so a leaf joins the preimages of its ancestors through its block alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import BROADCAST_BYTES, number_rows
from .common import materialize

#: Levels that are built within one row; a block holds 2 to this power of hashes.
LEVELS = 10


def leaf_hash(*values: Column) -> Column:
    """Hash of a row's values: each as its length in bytes and itself, null as a dash."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def siblings(path: Column) -> Column:
    """The hashes beside a node on its way to the root, put together: each preimage without the node's own slot."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["preimage"], F.lit(""), p["slot"] * 64 + 1, F.lit(64))), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to: it is spliced into its parent's preimage, that one's hash into the next, and so on."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.overlay(p["preimage"], h, p["slot"] * 64 + 1, F.lit(64)), 256))


def _blocks(nodes: DataFrame, sizes: DataFrame, levels: int, tag: str) -> DataFrame:
    """``(key, block, nodes, preimages, root)`` of ``nodes (key, at, hash, row)``: the levels above each run of nodes.

    ``sizes (key, n)`` says how many nodes a key has: a block stops at the key's root, or after ``levels`` levels.
    """
    width = 1 << levels
    rows = nodes.groupBy("key", F.expr(f"`at` div {width}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "hash", "row"))).alias("nodes"))  # `width` nodes at most
    # how often n nodes are halved until one is left
    left = F.when(F.col("n") > 1, F.least(F.length(F.bin(F.col("n") - 1)), F.lit(levels))).otherwise(0)
    steps = F.when(left > 0, F.sequence(F.lit(1), left)).otherwise(F.array().cast("array<int>"))
    pairs = "transform(sequence(0, (size(s.hashes) - 1) div 2), j -> concat(s.hashes[2 * j], coalesce(get(s.hashes, 2 * j + 1), '')))"
    state = "named_struct('hashes', transform(nodes, x -> x.hash), 'preimages', cast(array() AS array<array<string>>))"
    built = rows.join(sizes, "key").withColumn("steps", steps).withColumn("built", F.expr(f"aggregate(steps, {state}, (s, k) -> named_struct('hashes', transform({pairs}, p -> sha2(p, 256)), 'preimages', concat(s.preimages, array({pairs}))))"))
    return materialize(built.select("key", "block", "nodes", "built.preimages", F.col("built.hashes")[0].alias("root")), tag)


def _numbered(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with their number ``at`` within their key, from 0, and ``(key, n)``."""
    rows = number_rows(leaves, ["key", *order], "nth")
    spans = materialize(rows.groupBy("key").agg(F.min("nth").alias("first"), F.count("*").alias("n")), "merkle-keys")
    return rows.join(_side(spans, "first"), "key").withColumn("at", F.col("nth") - F.col("first")), spans.select("key", "n")


def _side(spans: DataFrame, *columns: str) -> DataFrame:
    """A table of one row a key, broadcast where its counted size allows it."""
    few = spans.select("key", *columns)
    return F.broadcast(few) if 64 * spans.count() <= BROADCAST_BYTES else few


def _tree(nodes: DataFrame, sizes: DataFrame, levels: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, from the leaves up, and ``(key, root)``."""
    rounds, most = [], sizes.agg(F.max("n")).first()[0] or 0
    row_type = nodes.schema["row"].dataType
    while True:
        rounds.append(_blocks(nodes, _side(sizes, "n"), levels, tag))
        if most <= 1 << levels:
            return rounds, rounds[-1].select("key", "root")
        most = -(-most // (1 << levels))
        sizes = sizes.withColumn("n", F.expr(f"(n + {(1 << levels) - 1}) div {1 << levels}"))
        nodes = rounds[-1].select("key", F.col("block").alias("at"), F.col("root").alias("hash"), F.lit(None).cast(row_type).alias("row"))


#: A node's own ancestors in its block, and those above.
PATH = "concat(transform(preimages, (level, k) -> named_struct('preimage', level[cast(shiftright(i, k + 1) AS int)], 'slot', cast(shiftright(i, k) & 1 AS int))), above)"


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths from the roots down to the leaves' blocks: ``(key, block, above, ...)`` from ``above (key, above, ...)``."""
    more = [c for c in above.columns if c not in ("key", "above")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        rows = blocks.drop("root").join(above, ["key", "block"]).select("key", "above", *more, F.expr(f"transform(nodes, (x, i) -> named_struct('block', x.at, 'above', {PATH}))").alias("below"))
        above = rows.select("key", *more, F.explode("below").alias("b")).select("key", "b.block", "b.above", *more)
    return above


def prove(leaves: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """``(row, leaf, subroot, root, path)`` of ``leaves (key, <order>, hash, row)``, one row each.

    Leaves of a key are in the order of the columns named, then of their hash; keys are in the order of their UTF-8 bytes
    and must not be null. ``row`` is a struct that comes along. Leaves that repeat are leaves of their own. No leaves give no rows.
    """
    nodes, sizes = _numbered(leaves, [*order, "hash"])
    rounds, roots = _tree(nodes.select("key", "at", "hash", "row"), sizes, levels, "merkle-blocks")
    tops, n_roots = _numbered(roots.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("root").alias("hash")), ["of"])
    upper, root = _tree(tops.select("key", "at", "hash", F.struct("of").alias("row")), n_roots, levels, "merkle-roots")
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    top = _down(upper, root.select("key", none.alias("above"), "root"))
    named = upper[0].drop("root").join(top.drop("key"), "block").select("root", F.expr(f"transform(nodes, (x, i) -> named_struct('key', x.row.of, 'subroot', x.hash, 'above', {PATH}))").alias("below"))
    subroots = named.select("root", F.explode("below").alias("b")).select("b.key", "b.above", "b.subroot", "root")
    blocks = _down(rounds, subroots)
    found = rounds[0].drop("root").join(blocks, ["key", "block"]).select("subroot", "root", F.expr(f"transform(nodes, (x, i) -> named_struct('row', x.row, 'leaf', x.hash, 'path', {PATH}))").alias("leaves"))
    return found.select("subroot", "root", F.explode("leaves").alias("l")).select("l.row", "l.leaf", "subroot", "root", "l.path")
