"""A persistent inverted index: postings by term in blocks of documents, with what a block's best score can be.

Documents are dealt to blocks by the hash of their id. A row holds one term's postings of one block: the ids as differences
from the block's first, term frequencies, document lengths, and the largest frequency and smallest length, which bound
the BM25 score of any document in it whatever the corpus statistics become. A search reads those bounds first (two
numbers a block), and then the postings of blocks in order of their bound, until no block left can reach the k-th best score.

Rows live in a committed table by the hash of their term, so a search lists the files of its terms only. Each addition is a
segment of its own; a document that comes again, or goes, is marked dead in its old segment; ``merge`` writes one segment
without the dead. Statistics count living documents only, so results equal those of a scan at any time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import tokens
from ..sources.committed import CommittedTable
from .lineage import materialize, release
from .retrieval import query_tokens

SCHEMA = "term string, segment int, block int, n int, max_tf int, min_len int, first long, ids array<long>, tfs array<int>, lens array<int>"
#: Documents of a block, on average.
BLOCK = 128
#: Most blocks that are taken in order of their bound at once; beyond, all that may matter are read together.
MOST_ORDERED = 1 << 16
# Terms that no text has: the documents of a block themselves, and those of them that are dead.
DOCUMENTS, DEAD = "\u0000documents", "\u0000dead"


class InvertedIndex:
    """The index under ``path``. Ids are longs; a null id is left out, a null or wordless text is a document without terms.

    Of rows that repeat an id in one addition the one with the least text counts, as one of them must.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, block: int = BLOCK):
        self.spark, self.block = spark, block
        self.table = CommittedTable(spark, path, "term", SCHEMA, buckets)
        self.blocks_read = self.blocks_found = 0

    # writing ----------------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """A segment of the documents, in place of older ones of the same ids; the new version."""
        texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), tokens(text_col).alias("t"))
        if docs.select(id_col).distinct().count() < docs.count():
            texts = texts.groupBy("id").agg(F.min("t").alias("t"))
        postings = texts.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").cast("int").alias("tf"))
        lengths = texts.select("id", F.size("t").alias("len"))
        base, extra = self.table.version(), self.table.extra()
        segment = extra.get("segments", 0)
        n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        dead = self._found(lengths.select("id")) if n and segment else None
        rows = self._blocks(postings, lengths, segment, n)
        if dead is not None:
            rows = rows.unionByName(self._dead_rows(dead))
        return self.table.commit(rows, base, append=True, operation="add", extra={"segments": segment + 1, "docs": extra.get("docs", 0) + n, "tokens": extra.get("tokens", 0) + total})

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> int:
        """Mark documents dead; ids that are not in the index are none."""
        return self.table.commit(self._dead_rows(self._found(ids.select(F.col(id_col).cast("long").alias("id")))), self.table.version(), append=True, operation="remove", extra=self.table.extra())

    def merge(self) -> int:
        """One segment of all living documents."""
        base, extra = self.table.version(), self.table.extra()
        rows = self.table.read(base)
        living = self._living(self._decoded(rows.where(F.col("term") != DEAD), "term"), rows)
        held = materialize(living, "index-living")
        lengths = held.where(F.col("term") == DOCUMENTS).select("id", "len")
        n, total = lengths.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        out = self._blocks(held.where(F.col("term") != DOCUMENTS).select("id", "len", "term", "tf"), lengths, extra.get("segments", 0), n)
        version = self.table.commit(out, base, operation="merge", extra={"segments": extra.get("segments", 0) + 1, "docs": n, "tokens": total})
        release(held)
        return version

    def _blocks(self, postings: DataFrame, lengths: DataFrame, segment: int, n: int) -> DataFrame:
        """Rows of a segment of ``n`` documents: ``postings (id, len, term, tf)`` and the documents themselves."""
        every = postings.unionByName(lengths.select("id", "len", F.lit(DOCUMENTS).alias("term"), F.lit(0).alias("tf")))
        block = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // self.block)))).cast("int")
        rows = every.withColumn("block", block).groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("p"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))
        return _coded(rows.withColumn("segment", F.lit(segment)))

    def _found(self, ids: DataFrame) -> DataFrame:
        """``(segment, block, id)`` of the living documents among ``ids``."""
        rows = self.table.read(buckets=self._buckets([DOCUMENTS, DEAD]))
        held = self._decoded(rows.where(F.col("term") == DOCUMENTS))
        return self._living(held, rows).join(ids.distinct(), "id", "left_semi").select("segment", "block", "id", "len")

    def _dead_rows(self, dead: DataFrame) -> DataFrame:
        rows = dead.groupBy("segment", "block").agg(F.sort_array(F.collect_list(F.struct("id", F.lit(0).alias("tf"), "len"))).alias("p"))
        return _coded(rows.withColumns({"term": F.lit(DEAD), "max_tf": F.lit(0), "min_len": F.lit(0)}))

    # reading ----------------------------------------------------------------------------------------------------------

    def _buckets(self, terms: list[str]) -> list[int]:
        return self.table.touched(self.spark.createDataFrame([(t,) for t in terms], "term string"))

    def _decoded(self, rows: DataFrame, *more: str) -> DataFrame:
        """``(segment, block, id, tf, len)`` of rows."""
        posting = F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")
        return rows.select("segment", "block", "first", *more, posting).select("segment", "block", (F.col("first") + F.col("p.ids")).alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"), *more)

    def _living(self, postings: DataFrame, rows: DataFrame) -> DataFrame:
        dead = self._decoded(rows.where(F.col("term") == DEAD)).select("segment", "block", "id").distinct()
        return postings.join(dead, ["segment", "block", "id"], "left_anti")

    def search(self, query: str, k: int = 20, k1: float = 1.6, b: float = 0.75, first: int = 16, digits: int = 6) -> DataFrame:
        """``(id, score)`` of the ``k`` documents of the best BM25 scores, rounded to ``digits``, ties by id.

        Blocks are read in order of their bounds, ``first`` of them, then eight times as many each time; a query without
        a known term finds nothing. ``blocks_read`` and ``blocks_found`` count blocks afterwards.
        """
        self.blocks_read = self.blocks_found = 0
        asked = Counter(query_tokens(query))
        nothing = self.spark.createDataFrame([], "id long, score double")
        if not asked or not self.table.version():
            return nothing
        version, terms, extra = self.table.version(), list(asked), self.table.extra()
        dead = self.table.read(version, self._buckets([DEAD])).where(F.col("term") == DEAD)
        gone = materialize(self._decoded(dead).select("segment", "block", "id", "len").distinct(), "index-gone")
        n_dead, lost = gone.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        n, total = extra["docs"] - n_dead, extra["tokens"] - lost
        rows = self.table.read(version, self._buckets(terms)).where(F.col("term").isin(terms))
        try:
            found = rows.select("term", "segment", "block", "n", "max_tf", "min_len")  # not the postings
            if n_dead:
                hurt = gone.select("segment", "block").distinct()
                lost = self._decoded(rows.join(hurt, ["segment", "block"], "left_semi"), "term").join(gone, ["segment", "block", "id"], "left_semi").groupBy("term").agg(F.count("*").alias("lost"))
                counts = found.groupBy("term").agg(F.sum("n").alias("df")).join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
            else:
                counts = found.groupBy("term").agg(F.sum("n").alias("df"))
            df = {r.term: r.df for r in counts.collect()}  # as many rows as the query has terms
            if not n or not any(df.values()):
                return nothing
            weight = {t: asked[t] * log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in terms}
            average = max(total / n, 1e-9)

            def score(tf: Column, length: Column) -> Column:
                w = reduce(lambda c, t: c.when(F.col("term") == t, weight[t]), terms, F.when(F.lit(False), 0.0))
                return w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.greatest(length, F.lit(1)) / average))

            bounds = found.groupBy("segment", "block").agg(F.sum(score(F.col("max_tf"), F.col("min_len"))).alias("bound"))
            bounds = materialize(bounds, "index-bounds")
            best = self._best(rows, bounds, gone if n_dead else None, score, k, first, digits)
            release(bounds)
            return self.spark.createDataFrame(best, "id long, score double")
        finally:
            release(gone)

    def _best(self, rows: DataFrame, bounds: DataFrame, gone: DataFrame | None, score, k: int, first: int, digits: int) -> list[tuple[int, float]]:
        self.blocks_found = bounds.count()
        best: list[tuple[int, float]] = []
        slack = 10.0**-digits
        for left, chosen in _batches(bounds, self.blocks_found, first, lambda: best[k - 1][1] - slack if len(best) >= k else None):
            postings = self._decoded(rows.join(chosen, ["segment", "block"], "left_semi"), "term")
            if gone is not None:
                postings = postings.join(gone, ["segment", "block", "id"], "left_anti")
            scored = postings.groupBy("id").agg(F.round(F.sum(score(F.col("tf"), F.col("len"))), digits).alias("score")).where("score > 0")
            best += [(r.id, r.score) for r in scored.orderBy(F.desc("score"), "id").limit(k).collect()]  # k rows
            best = sorted(best, key=lambda r: (-r[1], r[0]))[:k]
            self.blocks_read += left
        return best


def _batches(bounds: DataFrame, total: int, first: int, reached) -> Iterator[tuple[int, DataFrame]]:
    """``(how many, blocks)`` in order of bounds, ever more at a time, while one may hold a score that ``reached()`` does not beat."""
    done = None  # the last block taken, as (bound, segment, block)
    size = first
    while total > 0:
        rest = bounds
        if done is not None:
            b, s, k = done
            rest = rest.where((F.col("bound") < b) | ((F.col("bound") == b) & ((F.col("segment") > s) | ((F.col("segment") == s) & (F.col("block") > k)))))
        if (least := reached()) is not None:
            rest = rest.where(F.col("bound") >= least)
        last = size > MOST_ORDERED
        chosen = materialize(rest if last else rest.orderBy(F.desc("bound"), "segment", "block").limit(size), "index-chosen")
        n = chosen.count()
        if n:
            yield n, chosen
        if n and not last:
            done = tuple(chosen.orderBy("bound", F.desc("segment"), F.desc("block")).first()[c] for c in ("bound", "segment", "block"))
        release(chosen)
        if last or n < size:
            return
        size *= 8


def _coded(rows: DataFrame) -> DataFrame:
    """Rows of the table from ``(term, segment, block, max_tf, min_len, p)``, ``p`` the postings in order of id."""
    first = F.col("p")[0]["id"]
    part = lambda name: F.transform("p", lambda x: x[name])
    return rows.select("term", "segment", "block", F.size("p").alias("n"), "max_tf", "min_len", first.alias("first"), F.transform("p", lambda x: x["id"] - first).alias("ids"), part("tf").alias("tfs"), part("len").alias("lens"))
