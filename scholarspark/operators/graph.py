"""Citation-graph analytics on vertex and edge tables; iteration state is written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import velocity
from .aggregates import in_degree
from .lineage import connected_components, materialize, number_rows, release
from .relational import filter_papers, induced_edges, recent_edges


def simple_edges(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` without parallel edges and nulls."""
    return edges.select(F.col("source_paper_id").alias("src"), F.col("target_paper_id").alias("dst")).na.drop().distinct()


def subgraph(papers: DataFrame, edges: DataFrame, year_from: int | None = None, least_confidence: float = 0.0, as_of: int | None = None, recent: int | None = None, least_in_degree: int = 0, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """Filtered nodes, most cited first, and the edges among them; the in-degree test is made once, not repeated."""
    nodes = filter_papers(papers, year_from=year_from)
    kept = induced_edges(edges, nodes, least_confidence)
    if recent is not None and as_of is not None:
        kept = recent_edges(kept, papers, as_of, recent)
    if least_in_degree > 0:
        nodes = nodes.join(in_degree(kept).where(F.col("in_degree") >= least_in_degree).select("id"), "id", "left_semi")
    nodes = nodes.orderBy(F.desc("citation_count"), "id").limit(limit)
    return nodes, induced_edges(kept, nodes)


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float = 1e-6, check_every: int = 5) -> DataFrame:
    """``(id, rank)``: power iteration, parallel edges once, the rank of nodes without targets spread evenly.

    Nodes are ``id``; edges ``(src, dst)`` among them. Ranks sum to one. Rounds end once the ranks of a round differ from
    those before by less than ``tolerance`` for each node in all, or after ``iterations``; every ``check_every``
    rounds the ranks are written and that difference, one number, is looked at. A tolerance of 0 asks for all rounds.
    """
    ids = nodes.select("id").distinct()
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    degree = e.groupBy("src").agg(F.count("*").alias("deg"))
    links = materialize(e.join(degree, "src").select("src", "dst", "deg"), "pr-links")
    base = materialize(ids.join(degree.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("deg").isNull().alias("dangling")), "pr-nodes")
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("rank"))

    def step(rank: DataFrame) -> DataFrame:
        inflow = links.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("deg")).alias("inflow"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        return base.join(inflow, "id", "left").join(F.broadcast(lost)).select("id", "dangling", (F.lit((1 - damping) / n) + damping * (F.coalesce("inflow", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))

    rank = base.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    written = None
    for k in range(1, iterations + 1):
        before, rank = rank, step(rank)
        if k % check_every == 0 and k < iterations:
            pair = materialize(rank.join(before.select("id", F.col("rank").alias("was")), "id"), "pr-ranks")
            if written is not None:
                release(written)
            rank, written = pair.select("id", "dangling", "rank"), pair
            if tolerance and pair.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < n * tolerance:
                break
    return rank.select("id", "rank")


def neighbourhood(edges: DataFrame, seed: int, depth: int = 2, limit: int = 200) -> DataFrame:
    """``(id, depth)`` of nodes within ``depth`` undirected steps, the nearest first and then the smallest ids."""
    spark = edges.sparkSession
    e = simple_edges(edges)
    both = e.union(e.select("dst", "src")).toDF("src", "dst").distinct()
    seen = spark.createDataFrame([(seed, 0)], "id long, depth int")
    frontier = seen
    for d in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = reached.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "id").limit(limit)


def shortest_path(edges: DataFrame, start: int, goal: int, direction: str = "any", max_depth: int = 6) -> DataFrame:
    """``(step, id)`` of a shortest path, of equal ones the lexicographically smallest; no rows without a path."""
    spark = edges.sparkSession
    e = simple_edges(edges)
    hop = {"out": e, "in": e.select("dst", "src").toDF("src", "dst"), "any": e.union(e.select("dst", "src")).toDF("src", "dst").distinct()}[direction]
    paths = spark.createDataFrame([(start, [start])], "id long, path array<long>")
    seen = paths.select("id")
    for _ in range(max_depth):
        if start == goal:
            break
        found = paths.join(hop, F.col("id") == F.col("src")).join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti")
        paths = materialize(found.groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")), "path-front")
        seen = materialize(seen.union(paths.select("id")), "path-seen")
        if not paths.limit(1).count() or paths.where(F.col("id") == goal).limit(1).count():
            break
    return paths.where(F.col("id") == goal).select(F.posexplode("path").alias("step", "id"))


def has_cycle(edges: DataFrame) -> bool:
    """Whether a directed graph of ``(src, dst)`` has a cycle, a self-loop included.

    Each round takes away all nodes that nothing points to or that point to nothing, as no cycle holds them; where there
    are none and edges are left, every one lies behind a cycle. Of the nodes between one other and one other, in a chain, an
    independent set by a hashed coin is skipped over, so a chain shrinks by a share in each round however long it is. Two tables are
    kept at a time.
    """
    live = materialize(edges.select("src", "dst").distinct(), "cycle-edges")
    coin = lambda c, k: F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2))
    turn = 0
    while True:
        n, loops = live.agg(F.count("*"), F.count_if(F.col("src") == F.col("dst"))).first()
        if not n or loops:
            release(live)
            return bool(loops)
        out = live.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"), F.min("dst").alias("after"))
        into = live.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("into"), F.min("src").alias("before"))
        nodes = materialize(out.join(into, "id", "full_outer"), "cycle-nodes")
        inner = nodes.where("out IS NOT NULL AND into IS NOT NULL")
        if nodes.count() == inner.count():
            release(nodes)
            release(live)
            return True
        skipped = inner.where(F.expr("out = 1 AND into = 1") & (coin("id", turn) == 1) & (coin("before", turn) == 0)).select("id", "before", "after")
        kept = inner.select("id").join(skipped.select("id"), "id", "left_anti")
        shorter = live.unionByName(skipped.select(F.col("before").alias("src"), F.col("after").alias("dst")))
        for end in ("src", "dst"):
            shorter = shorter.join(kept.withColumnRenamed("id", end), end, "left_semi")
        nxt = materialize(shorter.select("src", "dst").distinct(), "cycle-edges")
        for table in (live, nodes):
            release(table)
        live, turn = nxt, turn + 1


def foundation_path(nodes: DataFrame, edges: DataFrame, top: int = 15, order: str | None = None) -> DataFrame:
    """``(position, id)``: topological order of an acyclic graph by (longest-path level, id); else the best PageRanks.

    Levels are peeled until they hold ``top`` nodes, so there are ``top`` of them at most. With ``order``, a column of ``nodes`` that
    every edge leads down (or every one up), there is no cycle to look for.
    """
    ids = materialize(nodes.select("id").distinct(), "topo-nodes")
    e = simple_edges(edges)
    e = materialize(e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "topo-edges")
    if not (order and _ordered(nodes, e, order)) and has_cycle(e):
        ranked = pagerank(ids, e).orderBy(F.desc(F.round("rank", 9)), "id").limit(top)
        return ranked.select((F.row_number().over(Window.orderBy(F.desc(F.round("rank", 9)), "id")) - 1).alias("position"), "id")
    left, live, level, done = ids, e, 0, ids.sparkSession.createDataFrame([], "id long, level int")
    found = 0
    while found < top:
        free = left.join(live.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        free = materialize(free.select(F.col("id").cast("long").alias("id"), F.lit(level).alias("level")), "topo-level")
        n = free.count()
        if not n:
            break
        done, found = done.unionByName(free), found + n
        before = left, live
        if found < top:
            left = materialize(left.join(free, "id", "left_anti").select("id"), "topo-left")
            live = materialize(live.join(free.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"), "topo-live")
            if level:
                for table in before:
                    release(table)
        level += 1
    first = done.orderBy("level", "id").limit(top)
    return first.select((F.row_number().over(Window.orderBy("level", "id")) - 1).alias("position"), "id")


def _ordered(nodes: DataFrame, e: DataFrame, order: str) -> bool:
    """Whether all edges lead down, or all up, in a column of their ends."""
    at = nodes.groupBy("id").agg(F.min(order).alias("at"), F.max(order).alias("top"), F.count_if(F.col(order).isNull()).alias("none"))
    ends = e.join(at.toDF("src", "s", "s2", "s_none"), "src").join(at.toDF("dst", "d", "d2", "d_none"), "dst")
    known = (F.col("s_none") == 0) & (F.col("d_none") == 0) & (F.col("s") == F.col("s2")) & (F.col("d") == F.col("d2"))
    n, down, up = ends.agg(F.count("*"), F.count_if(known & (F.col("s") > F.col("d"))), F.count_if(known & (F.col("s") < F.col("d")))).first()
    return n in (down, up)


def sota_list(papers: DataFrame, as_of: int, years: int = 3, top: int = 15) -> DataFrame:
    """Recent papers by citations a year."""
    recent = papers.where(F.col("year") >= as_of - years)
    return recent.select("id", "year", F.round(velocity(as_of), 4).alias("score")).orderBy(F.desc("score"), "id").limit(top)


def label_propagation(edges: DataFrame, rounds: int = 18) -> DataFrame:
    """``(id, community)`` by synchronous label propagation: the commonest label around a node, its own included; the
    smallest on ties. Rounds end when no label changes; communities are numbered by size."""
    e = simple_edges(edges).where("src <> dst")
    both = materialize(e.union(e.select("dst", "src")).toDF("src", "dst").distinct(), "lpa-edges")
    labels = both.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label"))
    labels = materialize(labels, "lpa-labels")
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label").union(labels.select("id", "label"))
        best = votes.groupBy("id", "label").agg(F.count("*").alias("n")).groupBy("id").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"))
        nxt = materialize(best, "lpa-labels")
        changed = nxt.join(labels.select("id", F.col("label").alias("old")), "id").where("label <> old").limit(1).count()
        release(labels)
        labels = nxt
        if not changed:
            break
    release(both)
    sizes = labels.groupBy("label").agg((-F.count("*")).alias("less"))
    return labels.join(number_rows(sizes, ["less", "label"], "community").select("label", "community"), "label").select("id", "community")


def edge_rank(edges: DataFrame, top: int = 200, unknown: float = 0.65) -> DataFrame:
    """The edges that matter most to a drawing: confidence, ``unknown`` where it is missing, and the degrees of their ends."""
    ends = edges.select(F.explode(F.array("source_paper_id", "target_paper_id")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    a, b = ends.toDF("source_paper_id", "da"), ends.toDF("target_paper_id", "db")
    weight = 0.72 * F.coalesce("confidence", F.lit(unknown)) + 0.025 * (F.col("da") + F.col("db"))
    return edges.join(a, "source_paper_id").join(b, "target_paper_id").select("source_paper_id", "target_paper_id", F.round(weight, 6).alias("weight")).orderBy(F.desc("weight"), "source_paper_id", "target_paper_id").limit(top)


#: Most edges of a drawing: all their pairs are weighed.
MOST_DRAWN = 10_000


def edge_compatibility(ranked: DataFrame, places: DataFrame, least: float = 0.22) -> DataFrame:
    """``(source_a, target_a, source_b, target_b, weight)`` of the pairs of a drawing's edges that can be bundled.

    ``ranked`` is a result of ``edge_rank``, ``MOST_DRAWN`` edges at most, ``places (id, x, y)`` where nodes are drawn. The weight
    is the product of how alike two edges are in angle and length, how near their middles are, and how far each
    sees the other; pairs of ``least`` or more are kept, each once.
    """
    if ranked.limit(MOST_DRAWN + 1).count() > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} edges to draw")
    end = lambda side: places.select(F.col("id").alias(f"{side}_paper_id"), F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
    drawn = ranked.join(end("source"), "source_paper_id").join(end("target"), "target_paper_id")
    drawn = drawn.withColumns({"dx": F.col("target_x") - F.col("source_x"), "dy": F.col("target_y") - F.col("source_y"), "mx": (F.col("source_x") + F.col("target_x")) / 2, "my": (F.col("source_y") + F.col("target_y")) / 2})
    drawn = drawn.withColumn("len", F.greatest(F.lit(1.0), F.hypot("dx", "dy"))).select("source_paper_id", "target_paper_id", "dx", "dy", "mx", "my", "len")
    a, b = drawn.alias("a"), F.broadcast(drawn.alias("b"))
    before = (F.col("a.source_paper_id") < F.col("b.source_paper_id")) | ((F.col("a.source_paper_id") == F.col("b.source_paper_id")) & (F.col("a.target_paper_id") < F.col("b.target_paper_id")))
    la, lb = F.col("a.len"), F.col("b.len")
    angle = F.abs((F.col("a.dx") * F.col("b.dx") + F.col("a.dy") * F.col("b.dy")) / (la * lb))
    scale = 2 / (la / lb + lb / la)
    apart = F.hypot(F.col("a.mx") - F.col("b.mx"), F.col("a.my") - F.col("b.my"))
    weight = angle * scale * ((la + lb) / 2 / ((la + lb) / 2 + apart)) * F.greatest(F.lit(0.0), 1 - apart / (la + lb))
    pairs = a.join(b, before).select(F.col("a.source_paper_id").alias("source_a"), F.col("a.target_paper_id").alias("target_a"), F.col("b.source_paper_id").alias("source_b"), F.col("b.target_paper_id").alias("target_b"), weight.alias("weight"))
    return pairs.where(F.col("weight") >= least)


def edge_focus(edges: DataFrame, node: int, direction: str = "all", intent: str | None = None) -> DataFrame:
    """Edges at a node, going in, out or both, of one intent or any."""
    out, into = F.col("source_paper_id") == node, F.col("target_paper_id") == node
    kept = edges.where({"out": out, "in": into, "all": out | into}[direction])
    return kept if intent is None else kept.where(F.col("intent") == intent)


def hull_of(points) -> list[tuple[float, float]]:
    """The corners around points, counter-clockwise from the leftmost, none on an edge between others."""

    def chain(run):
        out: list = []
        for x, y in run:
            while len(out) > 1:
                (ax, ay), (bx, by) = out[-2:]
                if (bx - ax) * (y - ay) > (by - ay) * (x - ax):  # a turn to the left
                    break
                out.pop()
            out.append((x, y))
        return out

    ordered = sorted(set(points))
    if len(ordered) < 2:
        return ordered
    lower, upper = chain(ordered), chain(ordered[::-1])
    return lower[:-1] + upper[:-1]


def convex_hulls(points: DataFrame, least: int = 3) -> DataFrame:
    """``(community, hull)``: the corners, counter-clockwise, around each community of ``least`` points or more.

    Input ``(community, x, y)``; rows with a null are left out. Each batch of rows first gives the hulls of its own
    points, and a community's hull is that of their corners: so no task gathers a community's points.
    """
    import pandas as pd

    def corners(frames):
        for frame in frames:
            rows = [(c, x, y) for c, part in frame.groupby("community") for x, y in hull_of(zip(part["x"], part["y"], strict=True))]
            yield pd.DataFrame(rows, columns=["community", "x", "y"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        hull = hull_of(zip(frame["x"], frame["y"], strict=True))
        return pd.DataFrame({"community": [frame["community"].iloc[0]], "hull": [[[float(x), float(y)] for x, y in hull]]})

    known = points.select("community", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).na.drop()
    enough = known.distinct().groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("community")
    kind = dict(points.dtypes)["community"]
    kept = known.join(enough, "community", "left_semi")
    return kept.mapInPandas(corners, f"community {kind}, x double, y double").groupBy("community").applyInPandas(whole, f"community {kind}, hull array<array<double>>")


def components(edges: DataFrame) -> DataFrame:
    e = simple_edges(edges)
    return connected_components(e, "src", "dst")
