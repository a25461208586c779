"""Queries of scans, filters, projections, joins, aggregates, windows, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import relational as R
from .adapter import AS_OF
from .registry import query

NOW, TODAY = 1_700_002_000, "1997-06-01"
NZ_FILE = "nullif(file_path, '') IS NOT NULL"
TOPIC = """CASE WHEN nullif(sub_field, '') IS NOT NULL THEN sub_field
  WHEN starts_with(dynamic_tags, '[') AND nullif(json_extract_string(dynamic_tags, '$[0]'), '') IS NOT NULL THEN json_extract_string(dynamic_tags, '$[0]')
  WHEN contains(dynamic_tags, ',') AND NOT starts_with(dynamic_tags, '[') THEN trim(split_part(dynamic_tags, ',', 1))
  WHEN nullif(trim(split_part(keywords, ',', 1)), '') IS NOT NULL THEN trim(split_part(keywords, ',', 1)) ELSE 'Unknown' END"""
TY = f"ty AS (SELECT {TOPIC} AS topic, year, count(*) AS n FROM papers WHERE coalesce(year, 0) <> 0 GROUP BY 1, 2)"
VEL = f"coalesce(citation_velocity, citation_count / CAST(greatest(1, {AS_OF} - coalesce(year, {AS_OF}) + 1) AS DOUBLE))"

# scans ------------------------------------------------------------------------------------------------------------

query("src1_scan", "papers", "SELECT id, title, year, sub_field, citation_count FROM papers")(lambda t: t.papers.select("id", "title", "year", "sub_field", "citation_count"))
query("src2_point_lookup", "papers", "SELECT id, title, doi FROM papers WHERE id = 42")(lambda t: t.papers.where("id = 42").select("id", "title", "doi"))
query("src3_pruned_scan", "papers", "SELECT id, title, doi, year FROM papers")(lambda t: t.papers.select("id", "title", "doi", "year"))
query("src4_multi_get", "papers", "SELECT id, title FROM papers WHERE id IN (1, 5, 8, 13, 21, 34, 999999)")(lambda t: t.papers.where(F.col("id").isin(1, 5, 8, 13, 21, 34, 999999)).select("id", "title"))


@query(
    "src5_key_lookup",
    "papers",
    """SELECT q.id AS probe, min(p.id) AS found FROM papers q JOIN papers p
  ON (q.file_hash = p.file_hash OR (q.file_hash IS NULL AND nullif(trim(lower(q.doi)), '') = trim(lower(p.doi)))) GROUP BY q.id""",
)
def key_lookup(t):
    """The first paper of the same file, or, for papers without one, of the same DOI: equi-joins, never an OR."""
    p = t.papers.select("id", "file_hash", F.lower(F.trim("doi")).alias("doi"))
    by_hash, by_doi = p.groupBy("file_hash").agg(F.min("id").alias("found")), p.groupBy("doi").agg(F.min("id").alias("found"))
    return p.join(by_hash, "file_hash").select(F.col("id").alias("probe"), "found").unionByName(p.where("file_hash IS NULL AND doi <> ''").join(by_doi, "doi").select(F.col("id").alias("probe"), "found"))


# filters ----------------------------------------------------------------------------------------------------------

query("f1_paper_filter", "papers", f"SELECT id, year, sub_field FROM papers WHERE year >= 2005 AND year <= 2015 AND {NZ_FILE}")(lambda t: R.filter_papers(t.papers, year_from=2005, year_to=2015, uploaded_only=True).select("id", "year", "sub_field"))
query(
    "f2_edge_filter",
    "papers citations",
    "SELECT source_paper_id, target_paper_id, confidence FROM citations WHERE coalesce(confidence, 1.0) >= 0.5 AND source_paper_id IN (SELECT id FROM papers WHERE year >= 2008) AND target_paper_id IN (SELECT id FROM papers WHERE year >= 2008)",
)(lambda t: R.induced_edges(t.citations, R.filter_papers(t.papers, year_from=2008), 0.5).select("source_paper_id", "target_paper_id", "confidence"))
query("f3_edge_recency", "papers citations", f"SELECT source_paper_id, target_paper_id FROM citations JOIN papers ON id = source_paper_id WHERE coalesce(year, 0) >= {AS_OF} - 5")(
    lambda t: R.recent_edges(t.citations, t.papers, AS_OF, 5).select("source_paper_id", "target_paper_id")
)
query("f4_optional_equality", "reading_tasks", "SELECT id, status, priority FROM reading_tasks WHERE status = 'todo' AND priority = 2")(lambda t: R.where_equal(t.reading_tasks, status="todo", priority=2, paper_id=None).select("id", "status", "priority"))
query("f5_case_insensitive", "ee_metrics", "SELECT id, dataset_name FROM ee_metrics WHERE lower(dataset_name) = lower('ds3')")(lambda t: t.ee_metrics.where(F.lower("dataset_name") == F.lower(F.lit("ds3"))).select("id", "dataset_name"))
query("f6_like_search", "papers", "SELECT id, title FROM papers WHERE title ILIKE '%thre%' ORDER BY id LIMIT 50")(lambda t: t.papers.where(F.col("title").ilike("%thre%")).select("id", "title").orderBy("id").limit(50))
query("f7_prefix_like", "experiments", "SELECT id, name FROM experiments WHERE name ILIKE 'AUTO_METRIC:%'")(lambda t: t.experiments.where(F.col("name").ilike("AUTO_METRIC:%")).select("id", "name"))
query(
    "f8_backlog",
    "papers",
    f"SELECT id, summary_one, refs_parsed_at FROM papers WHERE {NZ_FILE} AND (coalesce(summary_one, '') = '' OR refs_parsed_at IS NULL) ORDER BY id DESC LIMIT 100",
)(lambda t: R.backlog(t.papers).select("id", "summary_one", "refs_parsed_at"))
query("f9_epoch_between", "papers", "SELECT id, created_at FROM papers WHERE created_at BETWEEN 1700086400 AND 1700691199")(lambda t: t.papers.where(F.col("created_at").between(1700086400, 1700691199)).select("id", "created_at"))
query("f10_array_member", "idea_capsules", "SELECT id, title FROM (SELECT * FROM idea_capsules ORDER BY id DESC LIMIT 200) WHERE list_contains([linked_a, linked_b], 7)")(
    lambda t: t.idea_capsules.orderBy(F.desc("id")).limit(200).where(F.array_contains(F.array(F.col("linked_a").cast("long"), F.col("linked_b").cast("long")), F.lit(7).cast("long"))).select("id", "title")
)
query(
    "f11_schema_search",
    "job_runs papers",
    "SELECT j.id, title FROM (SELECT * FROM job_runs ORDER BY id DESC LIMIT 400) j JOIN papers p ON p.id = j.user_id WHERE contains(lower(concat_ws(' ', title, job_type, json_extract_string(payload, '$.k'))), 'error')",
)(
    lambda t: t.job_runs.orderBy(F.desc("id")).limit(400).join(t.papers.select(F.col("id").alias("user_id"), "title"), "user_id").where(F.lower(F.concat_ws(" ", "title", "job_type", F.get_json_object("payload", "$.k"))).contains("error")).select("id", "title")
)
query(
    "f12_pending_intent",
    "citations",
    "SELECT source_paper_id, target_paper_id, intent FROM citations WHERE coalesce(intent, '') = '' OR intent_confidence IS NULL ORDER BY last_verified_at DESC, source_paper_id, target_paper_id LIMIT 200",
)(
    lambda t: t.citations.where((F.coalesce("intent", F.lit("")) == "") | F.col("intent_confidence").isNull()).orderBy(F.desc("last_verified_at"), "source_paper_id", "target_paper_id").limit(200).select("source_paper_id", "target_paper_id", "intent")
)
query(
    "f13_due_queue",
    "sync_queue",
    f"SELECT paper_id, status, next_run_at FROM sync_queue WHERE status IN ('queued', 'idle', 'failed') AND (next_run_at IS NULL OR next_run_at <= {NOW}) ORDER BY next_run_at ASC NULLS FIRST, paper_id LIMIT 50",
)(lambda t: R.due_queue(t.sync_queue, NOW, 50).select("paper_id", "status", "next_run_at"))
query("f14_overdue", "reading_tasks", f"SELECT id, due_date FROM reading_tasks WHERE status <> 'done' AND due_date < '{TODAY}'")(lambda t: t.reading_tasks.where((F.col("status") != "done") & (F.col("due_date") < TODAY)).select("id", "due_date"))
query("f15_needs_id", "papers", f"SELECT id FROM papers WHERE doi IS NOT NULL AND (file_hash IS NULL OR venue IS NULL)")(lambda t: t.papers.where(F.col("doi").isNotNull() & (F.col("file_hash").isNull() | F.col("venue").isNull())).select("id"))
query(
    "f16_suspicious_title",
    "papers",
    r"SELECT id, title FROM papers WHERE length(trim(coalesce(title, ''))) < 8 OR regexp_matches(lower(trim(title)), '@|http|www|\b(university|institute|laboratory|department|school|college)\b')",
)(lambda t: t.papers.where(S.suspicious_title("title")).select("id", "title"))

# projections ------------------------------------------------------------------------------------------------------

query(
    "p1_node_projection",
    "papers",
    f"""SELECT id, coalesce(nullif(title, ''), concat('Paper ', id)) AS label, CASE WHEN NOT ({NZ_FILE}) OR read_status = 0 THEN 'gray' WHEN ccf_level IN ('A', 'B') THEN 'red'
  WHEN source_type = 'CNKI' THEN 'green' ELSE 'blue' END AS color, 20 + least(40.0, 4 * sqrt(coalesce(citation_count, 0))) AS size FROM papers""",
)(lambda t: R.node_projection(t.papers))
query("p4_path_export", "papers", "SELECT id, title, authors, year, nullif(venue, '') AS venue, doi FROM papers")(lambda t: R.path_export(t.papers))
query(
    "p5_short_label",
    "papers",
    r"SELECT id, CASE WHEN length(l) > 36 THEN concat(substr(l, 1, 33), '...') ELSE l END AS label FROM (SELECT id, trim(regexp_replace(coalesce(title, ''), '\s+', ' ', 'g')) AS l FROM papers)",
)(lambda t: t.papers.select("id", S.short_label("title").alias("label")))
query("p6_json_decode", "job_runs", "SELECT id, CAST(json_extract_string(payload, '$.k') AS INT) AS k FROM job_runs")(lambda t: t.job_runs.select("id", F.from_json("payload", "k int")["k"].alias("k")))


@query(
    "p7_declutter",
    "papers citations",
    """SELECT id, degree FROM (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS rk, count(*) OVER () AS n FROM
  (SELECT id, count(x) AS degree FROM papers LEFT JOIN (SELECT source_paper_id AS x FROM citations UNION ALL SELECT target_paper_id FROM citations) ON x = id GROUP BY id)) WHERE rk <= ceil(n * 0.06)""",
)
def declutter(t):
    """The best connected 6 % of nodes, whose labels stay visible."""
    ends = t.citations.select(F.explode(F.array("source_paper_id", "target_paper_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    nodes = t.papers.select("id").join(ends, "id", "left").na.fill(0, ["degree"])
    return nodes.orderBy(F.desc("degree"), "id").limit(-(-nodes.count() * 6 // 100))


# joins ------------------------------------------------------------------------------------------------------------

query("j1_fact_dim", "ee_metrics papers", "SELECT m.id, m.f1, p.year FROM ee_metrics m JOIN papers p ON p.id = m.paper_id")(
    lambda t: t.ee_metrics.select("id", "f1", "paper_id").join(t.papers.select(F.col("id").alias("paper_id"), "year"), "paper_id").select("id", "f1", "year")
)
query(
    "j2_search_documents",
    "papers paper_notes",
    """SELECT doc_id, notes, length(trim(concat_ws(' ', title, abstract, notes))) AS n_text FROM (SELECT id AS doc_id, coalesce(title, '') AS title, coalesce(abstract, '') AS abstract,
  trim(concat_ws(' ', coalesce(notes, ''), coalesce(method, ''), coalesce(datasets, ''), coalesce(conclusions, ''))) AS notes FROM papers LEFT JOIN paper_notes ON paper_id = id)""",
)(lambda t: R.search_documents(t.papers, t.paper_notes).select("doc_id", "notes", F.length("text").alias("n_text")))
query(
    "j3_double_dim",
    "papers citations",
    "SELECT c.source_paper_id, c.target_paper_id, s.title AS source_title, g.title AS target_title, s.year AS source_year, g.year AS target_year FROM citations c JOIN papers s ON s.id = c.source_paper_id JOIN papers g ON g.id = c.target_paper_id",
)(lambda t: R.edge_details(t.citations, t.papers).select("source_paper_id", "target_paper_id", "source_title", "target_title", "source_year", "target_year"))
query("j4_backlinks", "papers citations", "SELECT p.id, p.title FROM citations c JOIN papers p ON p.id = c.source_paper_id WHERE c.target_paper_id = 8 ORDER BY last_verified_at DESC, p.id LIMIT 200")(
    lambda t: t.citations.where("target_paper_id = 8").join(t.papers.select(F.col("id").alias("source_paper_id"), "title"), "source_paper_id").orderBy(F.desc("last_verified_at"), "source_paper_id").limit(200).select(F.col("source_paper_id").alias("id"), "title")
)
query("j5_newest_chunks", "papers chat_messages", "SELECT c.id, p.year FROM (SELECT * FROM chat_messages ORDER BY created_at DESC, id DESC LIMIT 300) c JOIN papers p ON p.id = c.session_id")(
    lambda t: t.chat_messages.orderBy(F.desc("created_at"), F.desc("id")).limit(300).select("id", "session_id").join(t.papers.select(F.col("id").alias("session_id"), "year"), "session_id").select("id", "year")
)
query(
    "j9_null_aware_anti",
    "papers citations",
    "SELECT source_paper_id, target_paper_id FROM citations WHERE target_paper_id NOT IN (SELECT id FROM papers WHERE id IS NOT NULL)",
)(lambda t: t.citations.join(t.papers.select(F.col("id").alias("target_paper_id")), "target_paper_id", "left_anti").select("source_paper_id", "target_paper_id"))
query("j10_keep_first", "papers", "SELECT min(id) AS id, sub_field, year FROM papers GROUP BY sub_field, year")(lambda t: R.keep_first(t.papers.select("id", "sub_field", "year"), ["sub_field", "year"]))
query("j11_semi_join", "papers citations", f"SELECT source_paper_id, target_paper_id FROM citations WHERE source_paper_id IN (SELECT id FROM papers WHERE {NZ_FILE})")(
    lambda t: t.citations.join(t.papers.where(S.present("file_path").isNotNull()).select(F.col("id").alias("source_paper_id")), "source_paper_id", "left_semi").select("source_paper_id", "target_paper_id")
)
query(
    "j8_node_stats",
    "papers reading_tasks experiments",
    f"""SELECT p.id, coalesce(o, 0) AS open_tasks, coalesce(d, 0) AS overdue_tasks, coalesce(e, 0) AS experiment_count FROM papers p
  LEFT JOIN (SELECT paper_id, count(*) FILTER (status <> 'done') AS o, count(*) FILTER (status <> 'done' AND due_date < '{TODAY}') AS d FROM reading_tasks GROUP BY 1) t ON t.paper_id = p.id
  LEFT JOIN (SELECT paper_id, count(*) AS e FROM experiments GROUP BY 1) x ON x.paper_id = p.id""",
)(lambda t: R.node_stats(t.papers.select("id"), t.reading_tasks, t.experiments, TODAY))
query(
    "j14_score_fusion",
    "papers",
    "SELECT coalesce(a.id, b.id) AS doc_id, 0.58 * coalesce(a.s, 0) + 0.42 * coalesce(b.s, 0) AS score FROM (SELECT id, citation_count / 500.0 AS s FROM papers WHERE id % 2 = 0) a FULL JOIN (SELECT id, citation_velocity / 25.0 AS s FROM papers WHERE id % 3 = 0) b ON a.id = b.id",
)(
    lambda t: R.fuse_scores(t.papers.where("id % 2 = 0").select(F.col("id").alias("doc_id"), (F.col("citation_count") / 500.0).alias("score")), t.papers.where("id % 3 = 0").select(F.col("id").alias("doc_id"), (F.col("citation_velocity") / 25.0).alias("score")))
)
query(
    "j15_containment_lookup",
    "papers paper_notes",
    "SELECT n.paper_id, min(d.name) AS name FROM paper_notes n JOIN (SELECT DISTINCT dataset AS name FROM (VALUES ('ACE'), ('ACE 2005'), ('graph')) v(dataset)) d ON contains(concat_ws(' ', n.datasets, n.method), d.name) GROUP BY 1",
)(
    lambda t: t.paper_notes.select("paper_id", F.explode(F.filter(F.array(*map(F.lit, ("ACE", "ACE 2005", "graph"))), lambda name: F.concat_ws(" ", "datasets", "method").contains(name))).alias("name")).groupBy("paper_id").agg(F.min("name").alias("name"))
)
query(
    "j17_compare",
    "papers ee_metrics",
    "SELECT p.id, title, year, coalesce(n, 0) AS n_metrics, first_f1 FROM papers p LEFT JOIN (SELECT paper_id, count(*) AS n, (list(f1 ORDER BY dataset_name, id))[1] AS first_f1 FROM ee_metrics GROUP BY 1) m ON m.paper_id = p.id WHERE p.id IN (3, 10, 77, 100)",
)(lambda t: R.compare_papers(t.papers, t.ee_metrics, [3, 10, 77, 100]))


@query("j18_library_match", "papers", "SELECT id, min(id) OVER (PARTITION BY trim(lower(regexp_replace(title, '\\s+', ' ', 'g')))) AS matched FROM papers WHERE coalesce(title, '') <> ''")
def library_match(t):
    """The first paper of the same normalised title."""
    p = t.papers.where("coalesce(title, '') <> ''").select("id", S.normalize_text("title").alias("key"))
    return p.join(p.groupBy("key").agg(F.min("id").alias("matched")), "key").select("id", "matched")


# aggregates -------------------------------------------------------------------------------------------------------

query("a1_global", "papers", "SELECT count(*) AS n, min(year) AS lo, max(year) AS hi FROM papers")(lambda t: t.papers.agg(F.count("*").alias("n"), F.min("year").alias("lo"), F.max("year").alias("hi")))
query("a2_status_counts", "sync_queue", "SELECT status, count(*) AS n FROM sync_queue GROUP BY status")(lambda t: t.sync_queue.groupBy("status").agg(F.count("*").alias("n")))
query(
    "a3_conditional_sums",
    "reading_tasks",
    f"SELECT paper_id, sum(CASE WHEN status <> 'done' THEN 1 ELSE 0 END) AS open_tasks, sum(CASE WHEN status <> 'done' AND due_date < '{TODAY}' THEN 1 ELSE 0 END) AS overdue FROM reading_tasks GROUP BY paper_id",
)(lambda t: t.reading_tasks.groupBy("paper_id").agg(F.count_if(F.col("status") != "done").alias("open_tasks"), F.count_if((F.col("status") != "done") & (F.col("due_date") < TODAY)).alias("overdue")))
query(
    "a4_metric_trend",
    "ee_metrics papers",
    "SELECT coalesce(year, 0) AS year, max(f1) AS best, round(avg(f1), 4) AS mean, count(*) AS n FROM ee_metrics m JOIN papers p ON p.id = m.paper_id WHERE f1 IS NOT NULL GROUP BY 1 HAVING coalesce(year, 0) <> 0",
)(lambda t: A.metric_trend(t.ee_metrics, t.papers, "no such metric"))
query("a5_having", "citations", "SELECT target_paper_id AS id, count(*) AS in_degree FROM citations GROUP BY 1 HAVING in_degree >= 7")(lambda t: A.in_degree(t.citations).where("in_degree >= 7"))
query("a6_year_histogram", "papers", "SELECT year, count(*) AS n FROM papers WHERE year IS NOT NULL GROUP BY year")(lambda t: t.papers.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n")))
query("a7_topic_years", "papers", f"WITH {TY} SELECT topic, year, sum(n) AS n FROM ty GROUP BY ROLLUP (year, topic) HAVING year IS NOT NULL")(lambda t: A.topic_years(t.papers).rollup("year", "topic").agg(F.sum("n").alias("n")).where("year IS NOT NULL"))
query("a8_river_wide", "papers", f"WITH {TY} SELECT year, coalesce(sum(n) FILTER (topic = 'src1'), 0) AS src1, coalesce(sum(n) FILTER (topic = 'src2'), 0) AS src2, coalesce(sum(n) FILTER (topic = 'src3'), 0) AS src3 FROM ty GROUP BY year")(
    lambda t: A.river_wide(A.topic_years(t.papers), ["src1", "src2", "src3"])
)
query("a9_doi_conflicts", "papers", r"SELECT * FROM (SELECT trim(lower(doi)) AS doi, count(DISTINCT nullif(trim(lower(regexp_replace(title, '\s+', ' ', 'g'))), '')) AS titles, count(DISTINCT year) AS years FROM papers WHERE trim(doi) <> '' GROUP BY 1) WHERE titles > 1 OR years > 1")(
    lambda t: A.doi_conflicts(t.papers)
)
query("a10_doi_duplicates", "papers", "SELECT trim(lower(doi)) AS doi, list(id ORDER BY id) AS ids FROM papers WHERE trim(doi) <> '' GROUP BY 1 HAVING count(*) > 1")(lambda t: A.doi_duplicates(t.papers))
query("a11_in_degree", "citations", "SELECT target_paper_id AS id, count(*) AS in_degree FROM citations GROUP BY 1")(lambda t: A.in_degree(t.citations))
query("a12_progress", "papers", f"SELECT count(*) AS total, count(*) FILTER (read_status = 1) AS read, count(*) FILTER (read_status <> 1) AS unread, count(*) FILTER ({NZ_FILE}) AS uploaded FROM papers")(lambda t: A.progress(t.papers))
TAGS = """tg AS (SELECT id, trim(unnest(CASE WHEN starts_with(dynamic_tags, '[') THEN from_json(dynamic_tags, '["VARCHAR"]') ELSE string_split(dynamic_tags, ',') END)) AS tag FROM papers WHERE dynamic_tags IS NOT NULL),
  tags AS (SELECT tag, count(*) AS n FROM (SELECT id, lower(tag) AS k, min(tag) AS tag FROM tg WHERE tag <> '' GROUP BY 1, 2) WHERE length(tag) >= 4 GROUP BY tag HAVING count(*) >= 2 ORDER BY n DESC, tag LIMIT 20)"""
query("a13_open_tags", "papers", f"WITH {TAGS} SELECT tag, n FROM tags")(lambda t: A.open_tags(t.papers, ["src1"]))
query("a14_tag_clusters", "papers", f"WITH {TAGS} SELECT regexp_replace(lower(tag), ' .$', '') AS key, sum(n) AS n, arg_min(tag, struct_pack(a := length(tag), b := tag)) AS label FROM tags GROUP BY 1")(
    lambda t: A.tag_clusters(A.open_tags(t.papers, ["src1"]))
)
query("a15_page_datasets", "ee_metrics", "SELECT DISTINCT dataset_name FROM (SELECT * FROM ee_metrics ORDER BY id LIMIT 25)")(lambda t: t.ee_metrics.orderBy("id").limit(25).select("dataset_name").distinct())
query(
    "a16_capsule_board",
    "idea_capsules",
    "SELECT s.status, count(c.id) AS n, min(c.id) AS first_id FROM (VALUES ('seed'), ('incubating'), ('validated'), ('archived')) s(status) LEFT JOIN idea_capsules c ON coalesce(nullif(c.status, ''), 'seed') = s.status GROUP BY 1",
)(lambda t: A.capsule_board(t.idea_capsules))
query("a17_best_per_key", "ee_metrics", "SELECT paper_id, arg_min(id, struct_pack(a := -coalesce(f1, -1), b := id)) AS best_id, max(f1) AS f1 FROM ee_metrics GROUP BY 1")(
    lambda t: t.ee_metrics.groupBy("paper_id").agg(F.min_by("id", F.struct(-F.coalesce("f1", F.lit(-1.0)), "id")).alias("best_id"), F.max("f1").alias("f1"))
)
query("a18_traceability", "chat_messages", "SELECT session_id, coalesce(round(greatest(0.0, least(1.0, avg(turn_score) * CASE WHEN max(len) >= 80 THEN 1.0 ELSE greatest(0.4, max(len) / 80.0) END)), 4), 0.0) AS score FROM (SELECT session_id, (id % 7) / 10.0 AS turn_score, length(content) AS len FROM chat_messages) GROUP BY 1")(
    lambda t: t.chat_messages.groupBy("session_id").agg(F.avg((F.col("id") % 7) / 10.0).alias("s"), F.max(F.length("content")).alias("len")).select("session_id", S.traceability("s", "len").alias("score"))
)
query("a19_top_label", "papers", "SELECT year, sub_field FROM (SELECT year, sub_field, row_number() OVER (PARTITION BY year ORDER BY count(*) DESC, sub_field) AS rk FROM papers WHERE coalesce(sub_field, '') <> '' GROUP BY 1, 2) WHERE rk = 1")(
    lambda t: t.papers.where("coalesce(sub_field, '') <> ''").groupBy("year", "sub_field").agg(F.count("*").alias("n")).withColumn("rk", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "sub_field"))).where("rk = 1").select("year", "sub_field")
)

# windows, limits, sets --------------------------------------------------------------------------------------------

query(
    "w1_bursts",
    "papers",
    f"""WITH {TY}, l AS (SELECT *, lag(n) OVER (PARTITION BY topic ORDER BY year) AS prev FROM ty)
  SELECT topic, year, n, n - prev AS growth, round((n - prev) / CAST(prev AS DOUBLE), 3) AS ratio FROM l WHERE n >= 3 AND n - prev >= 2 AND (n - prev) / CAST(prev AS DOUBLE) >= 0.5 ORDER BY ratio DESC, n DESC, topic, year LIMIT 20""",
)(lambda t: A.bursts(A.topic_years(t.papers)))
query(
    "w2_hotspots",
    "papers",
    f"SELECT * FROM (SELECT id, year, velocity, row_number() OVER (PARTITION BY year ORDER BY velocity DESC, id) AS rank FROM (SELECT id, year, round({VEL}, 4) AS velocity FROM papers WHERE coalesce(year, 0) <> 0)) WHERE rank <= 5",
)(lambda t: A.hotspots(t.papers, AS_OF))
query("w3_river", "papers", f"WITH {TY} SELECT year, topic, n, round(n / CAST(greatest(1, sum(n) OVER (PARTITION BY year)) AS DOUBLE), 4) AS share FROM ty")(lambda t: A.river(A.topic_years(t.papers)))
query("w5_last_messages", "chat_messages", "SELECT session_id, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS nth FROM chat_messages) WHERE nth <= 6")(lambda t: A.last_messages(t.chat_messages).select("session_id", "id", "nth"))
query("w8_max_normalise", "papers", "SELECT id, citation_count / CAST(max(citation_count) OVER () AS DOUBLE) AS score FROM papers")(
    lambda t: t.papers.select("id", "citation_count").join(F.broadcast(t.papers.agg(F.max("citation_count").alias("most")))).select("id", (F.col("citation_count") / F.col("most")).alias("score"))
)
query(
    "w9_timeline",
    "papers",
    """SELECT id, year, rank, round(1000.0 * (year - lo) / greatest(hi - lo, 1), 4) AS x, round((rank - 1 - (n - 1) / 2.0) * greatest(12.0, least(38.0, 600.0 / greatest(n - 1, 1))), 4) AS y FROM (
  SELECT id, year, row_number() OVER (PARTITION BY year ORDER BY sub_field NULLS FIRST, citation_count DESC, id) AS rank, count(*) OVER (PARTITION BY year) AS n, min(year) OVER () AS lo, max(year) OVER () AS hi FROM papers WHERE coalesce(year, 0) <> 0)""",
)(lambda t: A.timeline_layout(t.papers))
query("t3_task_order", "reading_tasks", "SELECT id, due_date, priority FROM reading_tasks ORDER BY coalesce(due_date, '9999-12-31'), priority DESC, id DESC LIMIT 200")(
    lambda t: t.reading_tasks.orderBy(F.coalesce("due_date", F.lit("9999-12-31")), F.desc("priority"), F.desc("id")).limit(200).select("id", "due_date", "priority")
)
query("t4_node_page", "papers", "SELECT id, citation_count FROM papers ORDER BY citation_count DESC, id LIMIT 50 OFFSET 100")(lambda t: R.page_nodes(t.papers, "citation_count", 100, 50).select("id", "citation_count"))
query("t5_node_sort", "papers", "SELECT id, coalesce(year, 0) AS year FROM papers ORDER BY coalesce(year, 0) DESC, id LIMIT 300")(lambda t: R.page_nodes(t.papers, "year", 0, 300).select("id", F.coalesce("year", F.lit(0)).alias("year")))
query("t6_search_fallback", "papers", "SELECT id FROM papers ORDER BY citation_count DESC, year DESC NULLS LAST, id LIMIT 20")(lambda t: t.papers.orderBy(F.desc("citation_count"), F.desc_nulls_last("year"), "id").limit(20).select("id"))
query("t7_merge_keeper", "papers", f"SELECT doi, id FROM (SELECT trim(lower(doi)) AS doi, id, row_number() OVER (PARTITION BY trim(lower(doi)) ORDER BY ({NZ_FILE}) DESC, citation_count DESC, updated_at DESC, id) AS rk FROM papers WHERE doi IS NOT NULL) WHERE rk = 1")(
    lambda t: t.papers.where("doi IS NOT NULL").withColumn("doi", F.lower(F.trim("doi"))).withColumn("rk", F.row_number().over(Window.partitionBy("doi").orderBy(F.desc(S.present("file_path").isNotNull()), F.desc("citation_count"), F.desc("updated_at"), "id"))).where("rk = 1").select("doi", "id")
)
query("s2_set_difference", "papers citations", "SELECT id FROM papers EXCEPT SELECT target_paper_id FROM citations WHERE confidence >= 0.7")(lambda t: t.papers.select("id").subtract(t.citations.where("confidence >= 0.7").select("target_paper_id")))
query("s3_union_all", "ee_metrics experiments", "SELECT paper_id, f1 AS value FROM ee_metrics UNION ALL SELECT paper_id, metric_value FROM experiments")(
    lambda t: t.ee_metrics.select("paper_id", F.col("f1").alias("value")).unionByName(t.experiments.select("paper_id", F.col("metric_value").alias("value")))
)
