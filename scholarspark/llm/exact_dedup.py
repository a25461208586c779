"""Exact dedup in three combining steps: within tasks, within salted digest groups, and over the winners of the salts.

A step groups by a digest and the whole text, so what it merges is equal character by character, whatever the digest is.
The first step is the map-side half of the second's aggregation: of the copies in a task one row leaves it. Digests that
hold a large share of all rows are salted by id, so their copies meet in many tasks; the winners of the salts, a few rows
each, meet last. All other digests are whole after the second step, so a text that differs from all others moves once.

Which group a row is in is then told by its digest alone, in thin rows, but where unlike texts share a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import free_name, materialize, release

#: A digest is hot where it has one in so many rows at least: no more than so many digests are ever broadcast.
HOT_SHARE = 1024
#: Tasks over which the copies of a hot digest are dealt.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salts: int = SALTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per row of ``docs``: ``(<id_col>, keep_id, group_size, kept, digest)``.

    Rows of equal texts are a group, a null text counts as empty; ``keep_id`` is the largest id of the group, and one row
    that has it is kept. Rows without an id come before all others, so one is kept only where none of its group has an
    id (``keep_id`` is then null); of rows that repeat an id and a text one is kept, and a repeated id with unlike texts
    is a row of each group. No rows give no rows; other columns are not read. ``digest`` is a function from a text to a
    binary column: where it is the same for unlike texts, the text itself takes its place, which costs time only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("digest", digest(F.col("t")))
    # thin rows, written with a number each: every later pass agrees on it
    thin = materialize(rows.select("id", "digest", F.monotonically_increasing_id().alias("row")), "exact-thin")
    least, seen, found = -(-thin.count() // hot_share), Observation(), Observation()
    counts = thin.groupBy("digest").agg(F.count("*").alias("n")).observe(seen, F.count("*").alias("n"))
    hot = materialize(counts.where((F.col("n") >= least) & (F.col("n") > 1)).select("digest", F.lit(True).alias("hot")), "exact-hot")  # `hot_share` rows at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id", F.lit(13)), F.lit(salts))).otherwise(0)
    dealt = rows.join(F.broadcast(hot), "digest", "left").withColumn("salt", salt)
    merged = dealt.groupBy("digest", "hot", "salt", "t").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    merged = materialize(merged.withColumn("t", F.when(F.col("hot"), F.col("t"))), "exact-merged")
    cold = merged.where("hot IS NULL").select("digest", "keep_id", "n")
    warm = merged.where("hot").groupBy("digest", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")).select("digest", "keep_id", "n")
    groups = materialize(cold.unionByName(warm).observe(found, F.count("*").alias("n")).where("n > 1"), "exact-groups")  # a group of one is its row
    release(merged)
    if found.get.get("n", 0) > seen.get.get("n", 0):  # more texts than digests
        for df in (thin, hot, groups):
            release(df)
        return exact_groups(docs, id_col, text_col, lambda t: t.cast("binary"), salts, hot_share).withColumn("digest", digest(F.col("digest").cast("string")))
    # the groups of hot digests are few and broadcast, so no key of the shuffled join has many rows
    large, small = (groups.join(F.broadcast(hot), "digest", how) for how in ("left_semi", "left_anti"))
    marked = thin.join(F.broadcast(hot), "digest", "left")
    joined = marked.where("hot").join(F.broadcast(large), "digest", "left").unionByName(marked.where("hot IS NULL").join(small, "digest", "left"))
    top = F.col("n").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))
    tops = Observation()
    out = materialize(joined.withColumn("top", top).observe(tops, F.count_if("top").alias("n")).drop("hot"), "exact-rows")
    if tops.get.get("n", 0) > groups.count():  # rows repeat an id and a text
        first = out.where("top").groupBy("digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
        out = out.join(first, "row", "left").withColumn("top", F.coalesce("first", F.lit(False)))
    for df in (thin, hot, groups):
        release(df)
    alone = F.col("n").isNull()
    return out.select(F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (alone | F.col("top")).alias("kept"), "digest")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns; cases as there."""
    key, own = free_name(docs, "__digest"), free_name(docs, "__id")
    rows = docs.withColumns({key: sha256(F.coalesce(F.col(text_col), F.lit(""))), own: F.col(id_col).cast("long")})
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("i"), F.col("digest").alias("d"))
    return rows.join(kept, F.col(own).eqNullSafe(F.col("i")) & (F.col(key) == F.col("d")), "left_semi").dropDuplicates([own, key]).drop(own, key)
