"""Queries of the citation graph, entity resolution, upserts and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import entity, graph, maintenance
from ..operators import relational as R
from .adapter import AS_OF
from .registry import query

SIMPLE = "sg AS (SELECT DISTINCT source_paper_id AS src, target_paper_id AS dst FROM citations)"
BOTH = f"{SIMPLE}, bg AS (SELECT src, dst FROM sg UNION SELECT dst, src FROM sg)"

query(
    "g1_subgraph",
    "papers citations",
    f"""WITH e AS (SELECT c.* FROM citations c JOIN papers s ON s.id = source_paper_id JOIN papers g ON g.id = target_paper_id WHERE s.year >= 2005 AND g.year >= 2005 AND coalesce(confidence, 1.0) >= 0.3 AND s.year >= {AS_OF} - 12),
  d AS (SELECT target_paper_id AS id, count(*) AS k FROM e GROUP BY 1 HAVING count(*) >= 2), n AS (SELECT p.id FROM papers p JOIN d USING (id) WHERE year >= 2005 ORDER BY citation_count DESC, p.id LIMIT 200)
  SELECT source_paper_id, target_paper_id FROM e WHERE source_paper_id IN (SELECT id FROM n) AND target_paper_id IN (SELECT id FROM n)""",
)(lambda t: graph.subgraph(t.papers, t.citations, 2005, 0.3, AS_OF, 12, 2, 200)[1].select("source_paper_id", "target_paper_id"))


def _pagerank_sql(k: int) -> str:
    steps = ["r0 AS (SELECT id, 1.0e0 / n AS r FROM nd, nn)"]
    for i in range(1, k + 1):
        steps.append(
            f"r{i} AS (SELECT nd.id, 0.15e0 / n + 0.85e0 * (coalesce(inflow, 0) + lost / n) AS r FROM nd LEFT JOIN (SELECT dst AS id, sum(r / deg) AS inflow FROM lk JOIN r{i - 1} ON r{i - 1}.id = src GROUP BY 1) f ON f.id = nd.id, nn, "
            f"(SELECT coalesce(sum(r), 0) AS lost FROM r{i - 1} WHERE id NOT IN (SELECT src FROM lk)))"
        )
    return f"WITH nd AS (SELECT id FROM papers), nn AS (SELECT count(*) AS n FROM nd), sg AS (SELECT DISTINCT source_paper_id AS src, target_paper_id AS dst FROM citations WHERE target_paper_id IN (SELECT id FROM nd)), lk AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM sg), {', '.join(steps)} SELECT id, round(r, 9) AS rank FROM r{k}"


query("g2_pagerank", "papers citations", _pagerank_sql(12))(lambda t: graph.pagerank(t.papers, graph.simple_edges(t.citations), 12, tolerance=0).select("id", F.round("rank", 9).alias("rank")))
query(
    "g3_neighbourhood",
    "citations",
    f"WITH {BOTH}, d1 AS (SELECT DISTINCT dst AS id FROM bg WHERE src = 7), d2 AS (SELECT DISTINCT dst AS id FROM bg WHERE src IN (SELECT id FROM d1)) SELECT id, min(depth) AS depth FROM (SELECT 7 AS id, 0 AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2) GROUP BY 1 ORDER BY depth, id LIMIT 200",
)(lambda t: graph.neighbourhood(t.citations, 7, 2, 200))
query(
    "g4_shortest_path",
    "citations",
    f"""WITH RECURSIVE {BOTH}, w AS (SELECT CAST(3 AS BIGINT) AS id, [CAST(3 AS BIGINT)] AS path UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN bg ON w.id = src WHERE len(path) < 5 AND NOT list_contains(path, dst)),
  b AS (SELECT path FROM w WHERE id = 150 ORDER BY len(path), path LIMIT 1) SELECT CAST(unnest(range(len(path))) AS INT) AS step, unnest(path) AS id FROM b""",
)(lambda t: graph.shortest_path(t.citations, 3, 150, "any", 4))


query(
    "g5_foundation_path",
    "papers citations",
    """WITH RECURSIVE nd AS (SELECT id, year FROM papers WHERE year IS NOT NULL), e AS (SELECT DISTINCT s.id AS src, g.id AS dst FROM citations JOIN nd s ON s.id = source_paper_id JOIN nd g ON g.id = target_paper_id WHERE s.year > g.year),
  lv AS (SELECT id, 0 AS l FROM nd UNION SELECT dst, l + 1 FROM lv JOIN e ON src = id), top AS (SELECT id, max(l) AS l FROM lv GROUP BY 1)
  SELECT row_number() OVER (ORDER BY l, id) - 1 AS position, id FROM top ORDER BY l, id LIMIT 15""",
)(lambda t: _foundation(t))


def _foundation(t):
    """Reading order over the edges that point to older papers, which have no cycle."""
    years = t.papers.select("id", "year")
    e = t.citations.join(years.toDF("source_paper_id", "sy"), "source_paper_id").join(years.toDF("target_paper_id", "ty"), "target_paper_id").where("sy > ty")
    return graph.foundation_path(t.papers.where("year IS NOT NULL"), e, order="year")


query("g6_sota_list", "papers", f"SELECT id, year, round(coalesce(citation_velocity, citation_count / CAST(greatest(1, {AS_OF} - coalesce(year, {AS_OF}) + 1) AS DOUBLE)), 4) AS score FROM papers WHERE year >= {AS_OF} - 3 ORDER BY score DESC, id LIMIT 15")(
    lambda t: graph.sota_list(t.papers, AS_OF)
)


def _rounds_sql(rounds: int) -> str:
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS label FROM lg)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"l{k} AS MATERIALIZED (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS rn FROM (SELECT id, label, count(*) AS n FROM (SELECT src AS id, label FROM lg JOIN l{k - 1} ON id = dst UNION ALL SELECT id, label FROM l{k - 1}) GROUP BY 1, 2)) WHERE rn = 1)"
        )
    return ", ".join(steps)


query(
    "g7_communities",
    "citations",
    f"""WITH {BOTH}, lg AS MATERIALIZED (SELECT src, dst FROM bg WHERE src <> dst AND src IS NOT NULL AND dst IS NOT NULL), {_rounds_sql(18)},
  z AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS community FROM l18 GROUP BY 1) SELECT id, community FROM l18 JOIN z USING (label)""",
)(lambda t: graph.label_propagation(t.citations))


RANKED = "d AS (SELECT id, count(*) AS k FROM (SELECT source_paper_id AS id FROM citations UNION ALL SELECT target_paper_id FROM citations) GROUP BY 1), ranked AS (SELECT source_paper_id, target_paper_id, round(0.72e0 * coalesce(confidence, 0.65) + 0.025e0 * (a.k + b.k), 6) AS weight FROM citations JOIN d a ON a.id = source_paper_id JOIN d b ON b.id = target_paper_id ORDER BY weight DESC, source_paper_id, target_paper_id LIMIT 200)"
query("g9_edge_rank", "citations", f"WITH {RANKED} SELECT * FROM ranked")(lambda t: graph.edge_rank(t.citations))
PLACES = "SELECT id, CAST(id % 97 AS DOUBLE) * 9 AS x, CAST(id % 41 AS DOUBLE) * 13 AS y FROM papers"
query(
    "g9_edge_bundles",
    "papers citations",
    f"""WITH {RANKED}, pl AS ({PLACES}), e AS (SELECT source_paper_id AS s, target_paper_id AS t, g.x - f.x AS dx, g.y - f.y AS dy, (f.x + g.x) / 2 AS mx, (f.y + g.y) / 2 AS my FROM ranked JOIN pl f ON f.id = source_paper_id JOIN pl g ON g.id = target_paper_id), l AS (SELECT *, greatest(1.0, sqrt(dx * dx + dy * dy)) AS n FROM e),
  c AS (SELECT a.s AS source_a, a.t AS target_a, b.s AS source_b, b.t AS target_b, abs((a.dx * b.dx + a.dy * b.dy) / (a.n * b.n)) * (2 / (a.n / b.n + b.n / a.n)) AS v, (a.n + b.n) / 2 AS h, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) AS m FROM l a JOIN l b ON a.s < b.s OR (a.s = b.s AND a.t < b.t))
  SELECT source_a, target_a, source_b, target_b, round(v * (h / (h + m)) * greatest(0.0, 1 - m / (2 * h)), 5) AS weight FROM c WHERE v * (h / (h + m)) * greatest(0.0, 1 - m / (2 * h)) >= 0.22""",
)(lambda t: graph.edge_compatibility(graph.edge_rank(t.citations), t.papers.selectExpr("id", "CAST(id % 97 AS DOUBLE) * 9 AS x", "CAST(id % 41 AS DOUBLE) * 13 AS y")).withColumn("weight", F.round("weight", 5)))


@query("g10_hulls")
def hulls(t):
    """Hulls of the vectors' first two components by label, as the number of corners."""
    pts = t.embeddings.where("label IS NOT NULL").select(F.col("label").cast("long").alias("community"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return graph.convex_hulls(pts).select("community", F.size("hull").alias("corners"))


query("g12_edge_focus", "citations", "SELECT source_paper_id, target_paper_id, intent FROM citations WHERE (source_paper_id = 10 OR target_paper_id = 10) AND intent = 'mention'")(
    lambda t: graph.edge_focus(t.citations, 10, "all", "mention").select("source_paper_id", "target_paper_id", "intent")
)
def _least_sql(rounds: int) -> str:
    """Labels that fall to the least of a node's own and its neighbours', round by round: ``r<rounds> (id, label)``."""
    steps = ["r0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS label FROM lg)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS MATERIALIZED (SELECT id, min(label) AS label FROM (SELECT src AS id, label FROM lg JOIN r{k - 1} ON id = dst UNION ALL SELECT id, label FROM r{k - 1}) GROUP BY 1)")
    return ", ".join(steps)


@query(
    "g_components",
    "citations",
    f"""WITH {BOTH}, lg AS MATERIALIZED (SELECT src, dst FROM bg WHERE src <> dst AND src IS NOT NULL AND dst IS NOT NULL), {_least_sql(24)}
  SELECT id AS node, label AS component FROM r24""",
)
def components(t):
    """Components of the whole citations table."""
    return graph.components(t.citations)


@query("g2_pagerank_converged")
def pagerank_converged(t):
    """Ranks at which the default tolerance stops; checked against a plain rewrite in the tests."""
    return graph.pagerank(t.papers, graph.simple_edges(t.citations)).select("id", F.round("rank", 6).alias("rank"))


# entity resolution ------------------------------------------------------------------------------------------------

#: Incoming papers: some known by a key, some by their title, some of them twice, some without title, year or key.
INC = {
    "id": "CASE WHEN id % 2 = 0 THEN 100000 + id ELSE 200000 + id END",
    "title": "CASE WHEN id % 25 = 0 THEN NULL WHEN id % 3 = 0 THEN concat('New paper number ', CAST(id % 40 AS STRING)) ELSE title END",
    "year": "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 2000 + CAST(id % 2 AS INT) ELSE year END",
    "doi": "CASE WHEN id % 3 = 1 THEN doi END",
    "s2_paper_id": "CASE WHEN id % 2 = 1 THEN s2_paper_id END",
    "file_hash": "CASE WHEN id % 4 = 0 THEN file_hash END",
    "abstract": "md5(abstract)",
    "citation_count": "CASE WHEN id % 11 <> 0 THEN citation_count + 1 END",
}
INCOMING = f"inc AS (SELECT {', '.join(f'{e} AS {c}' for c, e in INC.items())} FROM papers WHERE id % 5 = 0)"
KEEP = list(INC)
SUSPECT = r"(length(trim(coalesce(title, ''))) < 8 OR regexp_matches(lower(trim(title)), '@|http|www|\b(university|institute|laboratory|department|school|college)\b'))"


def _incoming(t):
    return t.papers.where("id % 5 = 0").selectExpr(*[f"{e} AS {c}" for c, e in INC.items()])


_by_key = " ".join(f"LEFT JOIN (SELECT {k}, min(id) AS m{n} FROM papers WHERE coalesce({k}, '') <> '' GROUP BY 1) k{n} ON k{n}.{k} = i.{k}" for n, k in enumerate(entity.KEYS))
MATCHED = f"""{INCOMING}, matched AS (SELECT i.*, coalesce(m0, m1, m2, CASE WHEN NOT {SUSPECT} THEN CASE WHEN i.year IS NULL THEN t.m ELSE y.m END END) AS match FROM inc i {_by_key}
  LEFT JOIN (SELECT title AS tt, min(id) AS m FROM papers WHERE coalesce(title, '') <> '' GROUP BY 1) t ON t.tt = i.title LEFT JOIN (SELECT title AS tt, year AS yy, min(id) AS m FROM papers WHERE coalesce(title, '') <> '' AND year IS NOT NULL GROUP BY 1, 2) y ON y.tt = i.title AND y.yy = i.year)"""
query("u1_paper_match", "papers", f"WITH {MATCHED} SELECT id, match FROM matched")(lambda t: entity.match_papers(t.papers.select(*KEEP), _incoming(t)).select("id", "match"))
_links = " UNION ".join(f"SELECT id AS x, min(id) OVER (PARTITION BY {k}) AS y FROM lone WHERE coalesce({k}, '') <> ''" for k in entity.KEYS)
_text = lambda c: f"coalesce(arg_min({c}, id) FILTER (coalesce({c}, '') <> ''), arg_min({c}, id) FILTER ({c} IS NOT NULL)) AS {c}"
_merged = ", ".join([_text("title"), "arg_min(year, id) FILTER (year IS NOT NULL) AS year", _text("doi"), _text("s2_paper_id"), "arg_max(file_hash, id) FILTER (file_hash IS NOT NULL) AS file_hash", _text("abstract"), "arg_max(citation_count, id) FILTER (citation_count IS NOT NULL) AS citation_count"])
_kept = "coalesce(nullif(p.{0}, ''), o.{0}, p.{0}) AS {0}"
query(
    "u1_paper_upsert",
    "papers",
    f"""WITH RECURSIVE {MATCHED}, lone AS (SELECT * FROM matched WHERE match IS NULL),
  links AS ({_links} UNION SELECT id, min(id) OVER (PARTITION BY title, year) FROM lone WHERE NOT {SUSPECT} AND year IS NOT NULL UNION SELECT id, f FROM (SELECT id, year, min(id) OVER (PARTITION BY title) AS f FROM lone WHERE NOT {SUSPECT}) WHERE year IS NULL),
  ends AS (SELECT x, y FROM links UNION SELECT y, x FROM links), reach AS (SELECT id AS x, id AS y FROM lone UNION SELECT reach.x, ends.y FROM reach JOIN ends ON reach.y = ends.x), grp AS (SELECT x AS of, min(y) AS first FROM reach GROUP BY 1),
  o AS (SELECT match AS of, {_merged} FROM matched WHERE match IS NOT NULL GROUP BY 1), n AS (SELECT first, {_merged} FROM lone JOIN grp ON of = id GROUP BY 1)
  SELECT p.id, {_kept.format('title')}, coalesce(p.year, o.year) AS year, {_kept.format('doi')}, {_kept.format('s2_paper_id')}, coalesce(o.file_hash, p.file_hash) AS file_hash, md5({_kept.format('abstract')[:-12]}) AS abstract, coalesce(o.citation_count, p.citation_count) AS citation_count FROM papers p LEFT JOIN o ON o.of = p.id
  UNION ALL SELECT (SELECT max(id) FROM papers) + row_number() OVER (ORDER BY first), title, year, doi, s2_paper_id, file_hash, md5(abstract), citation_count FROM n""",
)(lambda t: entity.upsert_papers(t.papers.select(*KEEP), _incoming(t)).withColumn("abstract", F.md5("abstract")))


NEW = "CASE WHEN (source_paper_id + target_paper_id) % 3 = 0 THEN 0.95e0 WHEN (source_paper_id + target_paper_id) % 3 = 1 THEN 0.0e0 END"
query(
    "u2_edge_upsert",
    "citations",
    f"""WITH o AS (SELECT source_paper_id, target_paper_id, min(confidence) AS c, min(intent) AS intent FROM citations GROUP BY 1, 2), n AS (SELECT source_paper_id, target_paper_id, {NEW} AS c, CASE WHEN source_paper_id % 2 = 0 THEN 'fresh' END AS intent FROM o WHERE target_paper_id % 2 = 0)
  SELECT o.source_paper_id, o.target_paper_id, CASE WHEN n.c > coalesce(o.c, 0) THEN n.c ELSE o.c END AS confidence, coalesce(n.intent, o.intent) AS intent FROM o LEFT JOIN n ON n.source_paper_id = o.source_paper_id AND n.target_paper_id = o.target_paper_id""",
)(lambda t: _edge_upsert(t))


def _edge_upsert(t):
    old = t.citations.groupBy("source_paper_id", "target_paper_id").agg(F.min("confidence").alias("confidence"), F.min("intent").alias("intent"))
    new = old.where("target_paper_id % 2 = 0").selectExpr("source_paper_id", "target_paper_id", f"{NEW.replace('e0', 'D')} AS confidence", "CASE WHEN source_paper_id % 2 = 0 THEN 'fresh' END AS intent")
    return entity.upsert_edges(old, new)


query(
    "u3_edge_confidence",
    "papers citations",
    """SELECT source_paper_id, target_paper_id, round(greatest(0.2e0, least(0.99e0, CASE edge_source WHEN 'semantic_scholar' THEN 0.95e0 WHEN 'crossref' THEN 0.85e0 WHEN 'llm_reference' THEN 0.7e0 ELSE 0.75e0 END
  + CASE WHEN doi IS NOT NULL THEN 0.05e0 ELSE 0 END + least(0.08e0, 0.08e0 * coalesce(confidence, 0)))), 4) AS score FROM citations JOIN papers ON id = target_paper_id""",
)(lambda t: t.citations.join(t.papers.select(F.col("id").alias("target_paper_id"), "doi"), "target_paper_id").select("source_paper_id", "target_paper_id", S.edge_confidence("edge_source", F.col("doi").isNotNull(), "confidence").alias("score")))
MAP = "mp AS (SELECT id AS old_id, id - 1 AS new_id FROM papers WHERE id % 10 = 1)"
query(
    "u4_merge_edges",
    "papers citations",
    f"""WITH {MAP} SELECT coalesce(a.new_id, source_paper_id) AS source_paper_id, coalesce(b.new_id, target_paper_id) AS target_paper_id, max(CASE WHEN coalesce(confidence, 0) = 0 THEN 0.8e0 ELSE confidence END) AS confidence
  FROM citations LEFT JOIN mp a ON a.old_id = source_paper_id LEFT JOIN mp b ON b.old_id = target_paper_id WHERE coalesce(a.new_id, source_paper_id) <> coalesce(b.new_id, target_paper_id) GROUP BY 1, 2""",
)(lambda t: entity.merge_papers(t.papers, t.citations, _mapping(t))[1])
query(
    "u4_merge_fields",
    "papers",
    f"WITH {MAP} SELECT coalesce(new_id, id) AS id, coalesce(max(nullif(venue, '')) FILTER (new_id IS NULL), max(nullif(venue, '')) FILTER (new_id IS NOT NULL)) AS venue, coalesce(max(nullif(year, 0)) FILTER (new_id IS NULL), max(year)) AS year FROM papers LEFT JOIN mp ON old_id = id GROUP BY 1",
)(lambda t: entity.merge_papers(t.papers.select("id", "venue", "year"), t.citations, _mapping(t))[0])


def _mapping(t):
    return t.papers.where("id % 10 = 1").select(F.col("id").alias("old_id"), (F.col("id") - 1).alias("new_id"))


query(
    "u4_merge_notes",
    "papers paper_notes",
    f"""WITH {MAP.replace('10 = 1', '10 = 2').replace('id - 1', 'id + 2')}, n AS (SELECT coalesce(new_id, paper_id) AS paper_id, paper_id AS old, method, datasets, conclusions, notes, CASE WHEN new_id IS NULL THEN 0 ELSE 1 END AS k FROM paper_notes LEFT JOIN mp ON old_id = paper_id)
  SELECT paper_id, {", ".join(f"coalesce(arg_min({c}, k) FILTER (coalesce({c}, '') <> ''), arg_min({c}, k) FILTER ({c} IS NOT NULL)) AS {c}" for c in ("method", "datasets", "conclusions", "notes"))} FROM n GROUP BY 1""",
)(lambda t: maintenance.merge_notes(t.paper_notes.select("paper_id", "method", "datasets", "conclusions", "notes"), t.papers.where("id % 10 = 2").select(F.col("id").alias("old_id"), (F.col("id") + 2).alias("new_id"))))
query(
    "u4_move_rows",
    "papers reading_tasks",
    f"WITH {MAP} SELECT r.id, coalesce(new_id, paper_id) AS paper_id FROM reading_tasks r LEFT JOIN mp ON old_id = paper_id",
)(lambda t: maintenance.move_rows(t.reading_tasks.select("id", "paper_id"), _mapping(t)))


@query("u5_auto_merge")
def auto_merge(t):
    """Papers of nearly equal titles with the one that is kept; tested against all pairs."""
    return maintenance.auto_merge(t.papers)


@query("u5_merged_edges")
def merged_edges(t):
    """The citations after the automatic merge; tested against all pairs."""
    mapping = maintenance.auto_merge(t.papers).where("old_id <> new_id")
    return entity.merge_papers(t.papers, t.citations, mapping)[1]


query(
    "u6_cleanup",
    "papers citations",
    "SELECT source_paper_id, target_paper_id FROM citations WHERE source_paper_id <> target_paper_id AND source_paper_id IN (SELECT id FROM papers) AND target_paper_id IN (SELECT id FROM papers)",
)(lambda t: R.orphan_cleanup(t.citations, t.papers).select("source_paper_id", "target_paper_id"))
query(
    "u9_sync_decisions",
    "papers",
    """SELECT id, field, CASE WHEN l = r THEN 'same' WHEN l = '' THEN 'pull' WHEN r = '' THEN 'push' ELSE 'conflict' END AS action FROM (SELECT id, 'venue' AS field, trim(coalesce(venue, '')) AS l, trim(CASE id % 3 WHEN 0 THEN 'Proc. ACL 2020' WHEN 1 THEN '' ELSE coalesce(venue, '') END) AS r FROM papers
  UNION ALL SELECT id, 'doi', trim(coalesce(doi, '')), trim(coalesce(CASE WHEN id % 2 = 0 THEN concat(doi, ' ') END, '')) FROM papers)""",
)(
    lambda t: entity.sync_decisions(
        t.papers.select("id", "venue", "doi"), t.papers.selectExpr("id", "CASE id % 3 WHEN 0 THEN 'Proc. ACL 2020' WHEN 1 THEN '' ELSE coalesce(venue, '') END AS venue", "CASE WHEN id % 2 = 0 THEN concat(doi, ' ') END AS doi"), ["venue", "doi"]
    )
)
query(
    "u12_intent_update",
    "citations",
    """SELECT source_paper_id, target_paper_id, CASE WHEN regexp_matches(lower(coalesce(context_snippet, '')), 'baseline|build on|following') THEN 'build_on' WHEN regexp_matches(lower(coalesce(context_snippet, '')), 'however|limitation|challenge') THEN 'contrast'
  WHEN regexp_matches(lower(coalesce(context_snippet, '')), 'we use|adopt|follow') THEN 'use_as_baseline' ELSE 'mention' END AS intent, CASE WHEN coalesce(context_snippet, '') <> '' THEN 'body_context' ELSE 'metadata' END AS intent_source
  FROM citations WHERE coalesce(intent, '') = '' OR intent_confidence IS NULL""",
)(
    lambda t: t.citations.where((F.coalesce("intent", F.lit("")) == "") | F.col("intent_confidence").isNull()).select(
        "source_paper_id", "target_paper_id", S.citation_intent("context_snippet")["intent"].alias("intent"), F.when(S.present("context_snippet").isNotNull(), "body_context").otherwise("metadata").alias("intent_source")
    )
)
query("u14_label_feedback", "papers", "SELECT id, title, sub_field FROM (SELECT * FROM papers ORDER BY updated_at DESC, id DESC LIMIT 6) WHERE coalesce(sub_field, '') <> ''")(
    lambda t: t.papers.orderBy(F.desc("updated_at"), F.desc("id")).limit(6).where("coalesce(sub_field, '') <> ''").select("id", "title", "sub_field")
)
query(
    "u15_wide_to_long",
    "ee_metrics",
    "SELECT id, paper_id, concat('AUTO_METRIC:', dataset_name, ':', name) AS name, value AS metric_value, contains(name, 'f1') AND value >= 80 AS is_sota FROM (UNPIVOT (SELECT id, paper_id, dataset_name, precision_, recall_, f1, trigger_f1, argument_f1 FROM ee_metrics) ON precision_, recall_, f1, trigger_f1, argument_f1 INTO NAME name VALUE value)",
)(lambda t: entity.metrics_to_experiments(t.ee_metrics))
query("snk1_insert_defaults", "papers", "SELECT id, coalesce(refs_parsed_at, 1700000000) AS updated_at, coalesce(read_status, 0) AS read_status FROM papers")(
    lambda t: t.papers.select("id", F.coalesce("refs_parsed_at", F.lit(1700000000)).alias("updated_at"), F.coalesce("read_status", F.lit(0)).alias("read_status"))
)
query("snk2_partial_update", "reading_tasks", "SELECT id, CASE WHEN id % 4 = 0 THEN 'done' ELSE status END AS status, priority FROM reading_tasks")(
    lambda t: entity.merge_by_key(t.reading_tasks.select("id", "status", "priority"), t.reading_tasks.where("id % 4 = 0").select("id", F.lit("done").alias("status")), ["id"], ["status"])
)
query("snk3_delete", "reading_tasks", "SELECT id FROM reading_tasks WHERE id % 9 <> 0")(lambda t: t.reading_tasks.select("id").join(t.reading_tasks.where("id % 9 = 0").select("id"), "id", "left_anti"))
query(
    "snk4_snapshot_replace",
    "ee_metrics",
    "SELECT paper_id, source, id, f1 FROM ee_metrics WHERE NOT (paper_id % 3 = 0 AND source = 'table') UNION ALL SELECT paper_id, source, id + 1000000, 50.0 FROM ee_metrics WHERE paper_id % 3 = 0 AND source = 'table'",
)(
    lambda t: entity.replace_snapshot(
        t.ee_metrics.select("paper_id", "source", "id", "f1"), t.ee_metrics.where("paper_id % 3 = 0 AND source = 'table'").select("paper_id", "source", (F.col("id") + 1000000).alias("id"), F.lit(50.0).alias("f1")), ["paper_id", "source"]
    )
)


@query("j12_fuzzy_duplicates")
def fuzzy_duplicates(t):
    return entity.duplicate_groups(entity.title_pairs(t.papers, 0.9))


@query("j13_resolve_links")
def resolve_links(t):
    from ..functions.extract import note_links

    links = t.paper_notes.select(F.explode(note_links("notes")).alias("link_text")).unionByName(t.papers.where("id % 40 = 0").select(F.regexp_replace("title", "[.]$", "").alias("link_text")))
    return entity.resolve_links(links, t.papers)
