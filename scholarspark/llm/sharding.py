"""Balanced contiguous shards by byte size: prefix sums over the whole table from per-partition totals.

Rows are put in one global order by range partitions. Each partition's total is summed, the totals are summed up in
partition order, and within a partition a running sum finishes the global prefix sum. Cuts at equal targets of that sum
give shards that are contiguous in the order and differ from the target by less than one row at either end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes counted for each row besides its text.
OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row per row of ``docs``: ``(<id_col>, size, text_crc32, shard, slot)``.

    Size is the text's UTF-8 bytes (a null text: none) plus ``overhead``; the global order is id (nulls first), then
    checksum and size. A row goes to the shard in which the middle of its bytes falls, so every shard's size is within one
    row of an equal share; slots count from 0 in each shard. Rows that repeat an id, ties and equal texts are rows like
    any other; a huge text may leave a neighbouring shard empty; no rows give no rows. Only counts of partitions and
    shards are gathered, the texts never move, and other columns are not read.
    """
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("size"), crc.alias("crc"))
    order = ["id", "crc", "size"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # which partition a row is in, and its place there, are fixed by writing them down: every later pass agrees
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("part", F.spark_partition_id()), "shard-rows")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grand = F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), grand.alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.select("*", F.sum("size").over(inside).alias("up_to"), F.row_number().over(inside).alias("nth")).join(starts, "part")
    doubled = 2 * (F.col("bytes_before") + F.col("up_to")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.expr("`#m` div `#t`")).cast("int")
    ranked = summed.withColumns({"#m": doubled * shards, "#t": 2 * F.col("total")}).select("id", "size", "crc", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("at"))
    firsts = F.broadcast(ranked.groupBy("shard").agg(F.min("at").alias("first")))  # at most `shards` rows
    return ranked.join(firsts, "shard").select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - F.col("first")).alias("slot"))
