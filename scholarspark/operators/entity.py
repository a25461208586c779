"""Entity resolution: upserts, edge merges, fuzzy duplicates, record merges."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import normalize_text, present, suspicious_title
from . import alike
from .lineage import connected_components, materialize, number_rows, ship_package

#: Columns in which a new value that is there always replaces the stored one.
OVERWRITE = ("citation_count", "reference_count", "influential_citation_count", "citation_velocity", "file_path", "file_hash")
#: Keys by which a paper is known, in the order in which they are tried.
KEYS = ("file_hash", "doi", "s2_paper_id")


@F.pandas_udf(T.DoubleType())
def title_ratio(s: pd.Series, t: pd.Series) -> pd.Series:
    """Similarity of two texts by their longest matching blocks; not symmetric, so the order of the sides matters."""
    return pd.Series([alike.ratio(a, b) for a, b in zip(s, t, strict=True)], dtype="float64")


def match_papers(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``match``, the stored paper of the same key, the first of ``KEYS`` that finds one, else of its title.

    An unsuspicious title matches a stored paper of the same title and year; without a year, any of the same title.
    Each key is an equi-join of its own; a null or blank key matches nothing; of several matches the smallest id counts;
    a key that either side lacks is not tried.
    """
    out, found = incoming, []
    for key in (k for k in KEYS if k in stored.columns and k in incoming.columns):
        side = stored.where(present(key).isNotNull()).groupBy(key).agg(F.min("id").alias(f"__{key}"))
        out = out.join(side, key, "left")
        found.append(F.col(f"__{key}"))
    safe = ~suspicious_title("title")
    titled = stored.where(present("title").isNotNull())
    any_year = titled.groupBy("title").agg(F.min("id").alias("__titled"))
    by_year = titled.where("year IS NOT NULL").groupBy("title", "year").agg(F.min("id").alias("__dated"))
    out = out.join(any_year, "title", "left").join(by_year, ["title", "year"], "left")
    by_title = F.when(safe, F.when(F.col("year").isNull(), F.col("__titled")).otherwise(F.col("__dated")))
    return out.withColumn("match", F.coalesce(*found, by_title)).select(*incoming.columns, "match")


def batch_groups(fresh: DataFrame) -> DataFrame:
    """``(id, first)`` of the rows of a batch that are the same paper as an earlier one, by the keys and titles of ``match_papers``."""
    links = []
    for key in (k for k in KEYS if k in fresh.columns):
        same = Window.partitionBy(key)
        links.append(fresh.where(present(key).isNotNull()).select("id", F.min("id").over(same).alias("first")))
    safe = fresh.where(~suspicious_title("title"))
    links.append(safe.where("year IS NOT NULL").select("id", F.min("id").over(Window.partitionBy("title", "year")).alias("first")))
    earliest = F.min("id").over(Window.partitionBy("title"))
    links.append(safe.select("id", "year", earliest.alias("first")).where("year IS NULL").select("id", "first"))
    pairs = reduce(DataFrame.unionByName, links).where("id <> first")
    return connected_components(pairs, "id", "first").toDF("id", "first")


def upsert_papers(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored table after an upsert: matched papers keep what they have and are filled, unmatched ones are added.

    Rows of a batch that are the same paper, by what they match or among themselves, come together in order of their
    ids: a column takes the first value that is there, or the last for those that are always replaced. Rows without a
    key and with a blank or suspicious title are papers of their own. New ids follow the largest stored one in the order
    of the batch's ids, which must be unique. A key that only an earlier row of the batch brings to a stored paper is
    not looked up for later rows.
    """
    columns = stored.columns
    matched = match_papers(stored, incoming)
    lone = matched.where("match IS NULL")
    grouped = lone.join(batch_groups(lone), "id", "left").withColumn("__key", F.coalesce("first", "id")).drop("first")
    kinds = dict(incoming.dtypes)

    def merged(df: DataFrame, by: str) -> DataFrame:
        def value(c: str) -> Column:
            there = F.col(c).isNotNull()
            if c in OVERWRITE:
                return F.max_by(c, F.when(there, F.col("id"))).alias(f"__{c}")
            filled = present(c).isNotNull() if kinds[c] == "string" else there
            return F.coalesce(F.min_by(c, F.when(filled, F.col("id"))), F.min_by(c, F.when(there, F.col("id")))).alias(f"__{c}")

        return df.groupBy(F.col(by).alias("__of")).agg(*[value(c) for c in columns if c != "id" and c in kinds])

    def updated(c: str) -> Column:
        if c == "id" or c not in kinds:
            return F.col(c)
        new = F.col(f"__{c}")
        kept = present(c) if dict(stored.dtypes)[c] == "string" else F.col(c)
        return (F.coalesce(new, F.col(c)) if c in OVERWRITE else F.coalesce(kept, new, F.col(c))).alias(c)

    old = merged(matched.where("match IS NOT NULL"), "match").withColumnRenamed("__of", "id")
    kept = stored.join(old, "id", "left").select(*[updated(c) for c in columns])
    fresh = merged(grouped, "__key")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    ranked = number_rows(fresh, ["__of"], "__n").join(F.broadcast(top))
    return kept.unionByName(ranked.select((F.col("__top") + F.col("__n")).alias("id"), *[F.col(f"__{c}").alias(c) for c in columns if c != "id" and c in kinds]), allowMissingColumns=True)


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges merged by their ends: the highest confidence over 0 (a stored null stays against a 0), else the newest value."""
    rows = stored.withColumn("__seq", F.lit(0)).unionByName(incoming.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    others = [c for c in stored.columns if c not in ("source_paper_id", "target_paper_id", "confidence")]
    had = F.max(F.when(F.col("__seq") == 0, F.struct(F.lit(1), F.col("confidence"))))["confidence"]
    best = F.max(F.when((F.col("__seq") == 0) | (F.col("confidence") > 0), F.col("confidence")))
    only_new = F.max(F.when(F.col("__seq") == 1, F.col("confidence")))
    conf = F.when(F.max(F.when(F.col("__seq") == 0, 1)).isNull(), only_new).otherwise(F.coalesce(best, had)).alias("confidence")
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c) for c in others]
    return rows.groupBy("source_paper_id", "target_paper_id").agg(conf, *newest)


#: Length of the character runs by which links are looked up among titles.
RUN = 3
#: Texts of a block at least and at most, and blocks where there are enough texts: each block meets each that its lengths allow.
BLOCK_ROWS, BLOCKS = (1024, 32768), 16


def title_pairs(papers: DataFrame, threshold: float = 0.9, years: int = 2) -> DataFrame:
    """``(a, b, similarity)`` of papers whose normalised titles are alike and whose years, where known and not 0, are near.

    Titles are dealt to blocks by their length, and blocks whose lengths allow alike titles meet in a task of their own. There all
    pairs are tested by bounds first, see ``alike``; no pair is lost, none but the alike ones leaves the task. The tests
    grow with the square of the titles; memory is that of two blocks, and what moves is each title once a block.

    The ratio takes the paper of the smaller id first, so two titles of several papers each can meet in both orders. They
    are a pair, of their first papers, if in one of the orders papers of near years meet and the ratio is enough; of both
    the similarity is that of the first papers' order. Missing and empty titles are none, blank ones are all one title.
    """
    rows = papers.select("id", present("year", text=False).alias("year"), "title", normalize_text("title").alias("t")).where("title <> ''").drop("title")
    dated = rows.groupBy("t", "year").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    titles = dated.groupBy("t").agg(F.min("first").alias("id"), F.collect_list(F.struct("year", "first", "last")).alias("dated"))
    titles = materialize(titles.withColumn("n", F.length("t")), "titles")
    known = titles.where("n > 0")
    size = min(max(BLOCK_ROWS[0], -(-known.count() // BLOCKS)), BLOCK_ROWS[1])
    dealt = number_rows(known, ["n", "t"], "at").withColumn("block", F.expr(f"(at - 1) div {size}"))
    spans = materialize(dealt.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "title-blocks")  # a row a block
    i, k = spans.toDF("i", "li", "hi"), spans.toDF("k", "lk", "hk")
    pairs = i.join(k, (F.col("i") <= F.col("k")) & (F.col("hi") >= F.ceil(F.col("lk") * (threshold / (2 - threshold)) - 1e-9))).select("i", "k")
    side = lambda c, i, k: dealt.join(F.broadcast(pairs), F.col("block") == F.col(c)).select(F.col("i").alias(i), F.col("k").alias(k), *[F.col(x).alias(x) for x in ("id", "t", "dated")])

    def near(x: dict, y: dict) -> bool:
        """Whether a paper of title x comes before one of title y in a near year, or one of them has no year."""
        return any(u["first"] < v["last"] and (u["year"] is None or v["year"] is None or abs(u["year"] - v["year"]) <= years) for u in x["dated"] for v in y["dated"])

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        rest = [t.select(["id", "dated"]) for t in (left, right)]
        mine, theirs = (t.column("t").to_pylist() for t in (left, right))
        if key[0].as_py() == key[1].as_py():
            rest[1], theirs = rest[0], mine  # the rows of a block come in any order
        for p, q in alike.alike_pairs(mine, theirs, threshold, rest[0] is rest[1]):
            x, y = rest[0].slice(p, 1).to_pylist()[0] | {"t": mine[p]}, rest[1].slice(q, 1).to_pylist()[0] | {"t": theirs[q]}
            x, y = (x, y) if x["id"] < y["id"] else (y, x)
            for s, t in ((x, y), (y, x)):
                if near(s, t) and (r := alike.ratio(s["t"], t["t"])) >= threshold:
                    found.append((x["id"], y["id"], r))
                    break
        return pa.table({"a": pa.array([f[0] for f in found], kind), "b": pa.array([f[1] for f in found], kind), "similarity": pa.array([f[2] for f in found], pa.float64())})

    ship_package(papers.sparkSession)
    id_type = dict(papers.dtypes)["id"]
    kind = pa.int32() if id_type == "int" else pa.int64()
    different = side("i", "xi", "xk").groupBy("xi", "xk").cogroup(side("k", "yi", "yk").groupBy("yi", "yk")).applyInArrow(meet, f"a {id_type}, b {id_type}, similarity double")
    # papers of one title link to its first paper instead of to each other
    same = rows.join(titles.select("t", F.col("id").alias("first")), "t").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return different.unionByName(same)


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """``(id, group_id)`` of papers joined by pairs."""
    return connected_components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def resolve_links(links: DataFrame, papers: DataFrame, threshold: float = 0.72) -> DataFrame:
    """``(link_text, target)``: the paper titled like a link, ignoring case; else the most similar of those that hold it.

    A title holds a link at any place, inside words too. It can be similar enough only if the link is long against it,
    so titles are looked up by their character runs, and a link by its rarest run; links shorter than a run are
    compared with the few titles that are short enough for them.
    """
    texts = links.select("link_text").where("link_text IS NOT NULL").distinct()
    exact = texts.join(papers.select(F.lower("title").alias("__t"), "id"), F.lower("link_text") == F.col("__t")).groupBy("link_text").agg(F.min("id").alias("target"))
    rest = texts.join(exact, "link_text", "left_anti").select("link_text", F.lower("link_text").alias("l")).where("l <> ''")
    titles = papers.select("id", F.lower("title").alias("t")).where("t <> ''").groupBy("t").agg(F.min("id").alias("id"))
    # the ratio of a link of n characters and a title of m that holds it is 2n/(n+m) at most
    fits = F.length("t") <= F.floor(F.length("l") * ((2 - threshold) / threshold) + 1e-9)
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (RUN - 1)), lambda i: F.substring(c, i, F.lit(RUN))))
    held = titles.where(F.length("t") >= RUN).select("id", "t", F.explode(runs("t")).alias("g"))
    often = held.groupBy("g").agg(F.count("*").alias("f"))
    asked = rest.where(F.length("l") >= RUN).select("link_text", "l", F.explode(runs("l")).alias("g")).join(often, "g", "left")
    rarest = asked.groupBy("link_text", "l").agg(F.min(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "g")).alias("r")).where("r.f > 0").select("link_text", "l", F.col("r.g").alias("g"))
    found = rarest.join(held, "g").where(fits & F.col("t").contains(F.col("l"))).select("link_text", "l", "id", "t")
    # shorter links are looked up by themselves, among the pieces of as many characters of titles short enough for them
    brief = titles.where(F.length("t") <= int((RUN - 1) * (2 - threshold) / threshold + 1e-9))
    pieces = F.array_distinct(F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.length("t")), lambda i, n=n: F.substring("t", i, F.lit(n))) for n in range(1, RUN)])))
    tiny = rest.where(F.length("l") < RUN).join(brief.select("id", "t", F.explode(pieces).alias("l")), "l").where(fits).select("link_text", "l", "id", "t")

    ship_package(papers.sparkSession)
    scored = found.unionByName(tiny).withColumn("r", title_ratio("l", "t")).where(F.col("r") >= threshold)
    return exact.unionByName(scored.groupBy("link_text").agg(F.min_by("id", F.struct(-F.col("r"), "id")).alias("target")))


def merge_papers(papers: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and edges after ``mapping (old_id, new_id)``: the kept paper is filled from those merged into it.

    Edges are redirected at both ends, self-loops vanish, a missing or zero confidence becomes 0.8, parallel edges join.
    """
    m = mapping.select(F.col("old_id").alias("id"), "new_id")
    to = papers.join(m, "id", "left").withColumn("__to", F.coalesce("new_id", "id"))
    order = F.struct(F.when(F.col("id") == F.col("__to"), 0).otherwise(1).alias("k"), F.col("id"))
    fill = [F.min_by(c, F.when(present(c, text=kind == "string").isNotNull() if kind in ("string", "int", "bigint") else F.col(c).isNotNull(), order)).alias(c) for c, kind in papers.dtypes if c != "id"]
    merged = to.groupBy("__to").agg(*fill).withColumnRenamed("__to", "id").select(*papers.columns)
    out = edges
    for end in ("source_paper_id", "target_paper_id"):
        out = out.join(m.toDF(end, "__new"), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    conf = F.max(F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.8).otherwise(F.col("confidence"))).alias("confidence")
    return merged, out.where("source_paper_id <> target_paper_id").groupBy("source_paper_id", "target_paper_id").agg(conf)


def sync_decisions(local: DataFrame, remote: DataFrame, fields: list[str], strategy: str = "manual") -> DataFrame:
    """``(id, field, action)`` for each field of records on both sides: fill the blank side, or settle a conflict.

    Conflicts are both set and different after trimming: kept for a person, or settled in favour of one side.
    """
    long = lambda df, name: df.select("id", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))))])).alias("field", name))
    both = long(local, "l").join(long(remote, "r"), ["id", "field"])
    settle = {"manual": "conflict", "prefer_local": "push", "prefer_remote": "pull"}[strategy]
    action = F.when(F.col("l") == F.col("r"), "same").when(F.col("l") == "", "pull").when(F.col("r") == "", "push").otherwise(settle)
    return both.select("id", "field", action.alias("action"))


def metrics_to_experiments(metrics: DataFrame, fields: tuple[str, ...] = ("precision_", "recall_", "f1", "trigger_f1", "argument_f1")) -> DataFrame:
    """One row for each score that is there, named after its dataset and score; high F1 scores are marked."""
    long = metrics.unpivot(["id", "paper_id", "dataset_name"], list(fields), "metric_name", "metric_value").where("metric_value IS NOT NULL")
    name = F.concat(F.lit("AUTO_METRIC:"), "dataset_name", F.lit(":"), "metric_name")
    return long.select("id", "paper_id", name.alias("name"), "metric_value", (F.col("metric_name").contains("f1") & (F.col("metric_value") >= 80)).alias("is_sota"))


def replace_snapshot(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows without those of any key that ``fresh`` has, and ``fresh``: delete-then-insert of whole keys."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def merge_by_key(stored: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Stored rows with the patch's non-null values in ``columns``; patch rows of new keys are added."""
    renamed = patch.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__in"))
    joined = stored.join(renamed, keys, "full_outer")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])
