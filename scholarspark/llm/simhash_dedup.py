"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the popcounts of its 32 two-bit segments. The Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints, so a range join on the embedding misses no link.
The range join runs on a grid: the 32 dimensions are dealt into ``BANDS`` bands; two embeddings within ``max_bits``
agree fully on at least ``BANDS - max_bits`` bands, hence share the cell of some choice of that many bands. Pairs of
one cell pass the Manhattan bound and then the exact Hamming test inside the join itself, so that the join emits
verified links only: of a fingerprint there are at most 2,080 others within two bits, whatever the size of its group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_name, map_arrow, materialize

#: Seed of XXH64 over a shingle's UTF-8 bytes.
SEED = 42
LOW = 0x5555555555555555
#: Most bytes of a table of removed rows (16 a row) that is broadcast to where the texts are.
BROADCAST_BYTES = 16 << 20


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text: majority of its shingles' XXH64 bits, repeats included; 0 without words."""
    if not text:
        return 0
    words = text.encode().lower().split()  # bytes: A-Z only, and only ASCII white space parts words
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    stops = (ends[shingle - 1 :] - 1).tolist()
    starts = [0, *ends[: n - shingle].tolist()]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65536):  # bounded memory for very long texts
        h = np.fromiter((digest(flat[i:j], SEED) for i, j in zip(starts[at : at + 65536], stops[at : at + 65536], strict=True)), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hashed: bool = False) -> DataFrame:
    """``(id, fp)`` of every row, the fingerprint as a signed long; a null or wordless text has 0.

    With ``hashed`` a column ``th``, a hash of the text, tells texts of one fingerprint apart.
    """

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
        return {"id": batch.column(0), "fp": pa.array(fps.view(np.int64))} | ({"th": batch.column(2)} if hashed else {})

    more = [F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")] if hashed else []
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more), run, "id long, fp long" + ", th long" * hashed)


def unary_popcounts(fp: Column) -> Column:
    """The embedding, each two-bit segment's popcount 0, 1, 2 written in unary (00, 01, 11).

    So the Manhattan distance of two embeddings is the number of bits in which these longs differ.
    """
    up = F.shiftrightunsigned(fp, 1)
    either, both = fp.bitwiseOR(up).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(up).bitwiseAND(F.lit(LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def grid_cells(embedding: Column, max_bits: int, bands: int) -> Column:
    """Cells of the grid: for each choice of ``bands - max_bits`` bands, their counts and which bands they are."""
    masks = [sum(3 << (2 * d) for d in range(32) if d * bands // 32 == k) for k in range(bands)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    picks = combinations(range(bands), bands - max_bits)
    return F.array(*[F.struct(F.lit(i).alias("choice"), embedding.bitwiseAND(F.lit(signed(sum(masks[k] for k in pick))).cast("long")).alias("cell")) for i, pick in enumerate(picks)])


def hamming_links(fps: DataFrame, max_bits: int = 2, bands: int = 6) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of the distinct longs in ``fp`` that differ in at most ``max_bits`` bits."""
    cells = fps.select("fp", F.explode(grid_cells(unary_popcounts(F.col("fp")), max_bits, bands)).alias("g")).select("fp", "g.choice", "g.cell")
    x, y = cells.alias("x"), cells.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    manhattan = F.bit_count(unary_popcounts(a).bitwiseXOR(unary_popcounts(b)))
    linked = (a < b) & (manhattan <= max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)
    on = (F.col("x.choice") == F.col("y.choice")) & (F.col("x.cell") == F.col("y.cell")) & linked
    return x.join(y, on).select(a.alias("a"), b.alias("b")).distinct()


def fingerprint_groups(fps: DataFrame, max_bits: int = 2, bands: int = 6) -> DataFrame:
    """``(fp, root, least)`` of each distinct ``fp`` of ``fps (id, fp)``: its component, and the smallest id in that."""
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("least_id")), "simhash-classes")
    of = connected_components(hamming_links(classes.select("fp"), max_bits, bands)).withColumnRenamed("node", "fp")
    joined = classes.join(of, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    return joined.join(joined.groupBy("root").agg(F.min("least_id").alias("least")), "root").select("fp", "root", "least")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, bands: int = 6) -> DataFrame:
    """One row per input row: ``(<id_col>, fp, component)``, component the smallest id reachable by links.

    Rows link when their fingerprints differ in at most ``max_bits`` bits. Texts are whole; null and wordless texts
    have fingerprint 0 and link like any other; short ones have the one shingle of all their words. Copies collapse to
    one fingerprint before any join, so a group of copies costs one row. Repeated rows stay and share a component;
    a null id keeps its row and counts as an id only where its whole component has no other. No rows give no
    rows. Other columns are neither read nor returned, so their names cannot clash.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-rows")
    named = fingerprint_groups(rows, max_bits, bands)
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", F.col("least").alias("component"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, bands: int = 6) -> DataFrame:
    """One row of each component of ``docs``: the smallest id, of its texts the one with the smallest hash; all columns stay.

    Of repeated rows one stays (which one, where other columns differ, is open). Rows that share an id but are unlike
    belong to components of their own and stay. Rows without an id cannot be named and stay as they are. No rows give
    no rows. The texts move only where the table of removed rows is too large to be broadcast.
    """
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = materialize(fingerprints(docs, id_col, text_col, shingle, hashed=True), "simhash-rows")
    named = fingerprint_groups(rows, max_bits, bands)
    copies = materialize(rows.where("id IS NOT NULL").groupBy("id", "fp", "th").agg(F.count("*").alias("n")).join(named, "fp"), "simhash-copies")
    chosen = copies.where("id = least").groupBy("root").agg(F.min(F.struct("id", "th", "n")).alias("c")).select("root", "c.*")
    gone = materialize(copies.join(chosen.select("root", "id", "th"), ["root", "id", "th"], "left_anti").select("id", "th").distinct(), "simhash-gone")
    again = materialize(chosen.where("n > 1").select("id", "th"), "simhash-repeated")
    key, text = (free_name(docs, name) for name in ("gone_id", "gone_text"))
    marked = docs.withColumn(text, th)
    small = lambda table: F.broadcast(table) if 16 * table.count() <= BROADCAST_BYTES else table
    at = lambda table: (marked[id_col].cast("long") == table[key]) & (marked[text] == table["th"])
    named_gone, named_again = small(gone).withColumnRenamed("id", key), small(again).withColumnRenamed("id", key)
    kept = marked.join(named_gone, at(named_gone), "left_anti")
    if not again.limit(1).count():
        return kept.drop(text)
    single = kept.join(named_again, at(named_again), "left_anti")
    repeated = kept.join(named_again, at(named_again), "left_semi").dropDuplicates([id_col, text])
    return single.unionByName(repeated).drop(text)
