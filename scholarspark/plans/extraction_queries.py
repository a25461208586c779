"""Queries of extraction, ontology, boards, reports, queues, exports, connectors and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import extraction, maintenance, ontology, queueing, reports
from ..operators.lineage import scratch_dir
from ..sources import connectors, sinks
from ..streaming import jobs
from .adapter import AS_OF
from .registry import query
from .relational_queries import TOPIC, TY, VEL

NOW = 1_700_002_000
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"

# extraction -------------------------------------------------------------------------------------------------------

query("x1_clean_line", None, rf"SELECT doc_id, md5({FLAT.format('text')}) AS h FROM documents WHERE text IS NOT NULL")(lambda t: t.documents.where("text IS NOT NULL").select("doc_id", F.md5(X.clean_line("text")).alias("h")))
LINES = rf"list_transform(string_split(coalesce(text, ''), chr(10))[1:30], lambda x: {FLAT.format('x')})"
query(
    "x2_guess_title",
    None,
    rf"""WITH c AS (SELECT doc_id, list_filter({LINES}, lambda x: length(x) BETWEEN 10 AND 200 AND NOT regexp_matches(lower(x), 'abstract|@|http|www|\b(university|institute|laboratory|department|school|college)\b')) AS ok FROM documents)
  SELECT doc_id, list_filter(ok, lambda x: length(x) = list_max(list_transform(ok, lambda y: length(y))))[1] AS title FROM c""",
)(lambda t: t.documents.select("doc_id", X.guess_title("text").alias("title")))


SPANS = "string_split(coalesce(text, ''), chr(10))[1:6]"
query(
    "x3_font_title",
    None,
    rf"""WITH l AS (SELECT doc_id, i, 10.0 + 2 * ((doc_id + i) % 3) AS size, {FLAT.format('ls[i]')} AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, {SPANS} AS ls FROM documents))),
  k AS (SELECT *, max(size) OVER (PARTITION BY doc_id) AS most FROM l WHERE t <> ''), j AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS title FROM k WHERE size >= most - 0.5 GROUP BY 1)
  SELECT d.doc_id, CASE WHEN length(title) BETWEEN 10 AND 200 THEN title END AS title FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id""",
)(
    lambda t: t.documents.select(
        "doc_id", X.title_by_font(F.transform(F.slice(X.lines("text"), 1, 6), lambda x, i: F.struct((i + 1).cast("double").alias("y"), (10.0 + 2 * ((F.col("doc_id") + i + 1) % 3)).alias("size"), x.alias("text")))).alias("title")
    )
)
AFF = r"\b(university|institute|laboratory|department|school|college)\b"
query(
    "x4_guess_authors",
    None,
    rf"""WITH c AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {FLAT.format('x')}) AS ls FROM documents),
  g AS (SELECT doc_id, ls, list_filter(ls[1:30], lambda x: length(x) BETWEEN 10 AND 200 AND NOT regexp_matches(lower(x), 'abstract|@|http|www|{AFF}')) AS ok FROM c),
  t AS (SELECT doc_id, ls, list_filter(ok, lambda x: length(x) = list_max(list_transform(ok, lambda y: length(y))))[1] AS title FROM g),
  a AS (SELECT doc_id, CASE WHEN title IS NULL THEN [] ELSE ls[list_position(ls, title) + 1:list_position(ls, title) + 4] END AS rest FROM t),
  s AS (SELECT doc_id, rest, list_position(list_transform(rest, lambda x: starts_with(lower(x), 'abstract')), true) AS stop FROM a),
  b AS (SELECT doc_id, CASE WHEN stop > 0 THEN rest[1:stop - 1] ELSE rest END AS rest FROM s)
  SELECT doc_id, list_filter(rest, lambda x: x <> '' AND NOT regexp_matches(lower(x), '{AFF}') AND (contains(x, ',') OR contains(lower(x), ' and ') OR len(string_split(x, ' ')) <= 8))[1] AS authors FROM b""",
)(lambda t: t.documents.select("doc_id", X.guess_authors("text", X.guess_title("text")).alias("authors")))


query("x5_guess_year", None, r"SELECT page_id, list_max(list_filter(list_transform(regexp_extract_all(coalesce(html, ''), '\b(?:19|20)\d{2}\b'), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1980 AND 2035)) AS year FROM pages")(
    lambda t: t.pages.select("page_id", X.guess_year("html").alias("year"))
)
query(
    "x6_guess_abstract",
    None,
    r"""SELECT doc_id, CASE WHEN length(a) >= 50 THEN substr(a, 1, 2000) END AS abstract FROM (SELECT doc_id, trim(regexp_extract(coalesce(text, ''), '(?is)(?:^|[^\p{L}\p{N}_])(?:the|der|le|la)[:\n ](.*?)(?:[^\p{L}]introduction|[^\p{L}]keywords|$)', 1)) AS a FROM documents)""",
)(lambda t: t.documents.select("doc_id", X.guess_abstract("text", "(?:the|der|le|la)").alias("abstract")))
query("x7_dois", "papers", r"SELECT id, nullif(regexp_extract(coalesce(doi, ''), '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b', 0), '') AS doi FROM papers")(lambda t: t.papers.select("id", X.first_doi("doi").alias("doi")))
query("x7_all_dois", "papers", r"SELECT id, len(list_distinct(list_transform(regexp_extract_all(concat(coalesce(doi, ''), ' ', upper(coalesce(doi, '')), ' 10.5555/zz'), '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'), lambda d: lower(d)))) AS n FROM papers")(
    lambda t: t.papers.select("id", F.size(X.all_dois(F.concat(F.coalesce("doi", F.lit("")), F.lit(" "), F.upper(F.coalesce("doi", F.lit(""))), F.lit(" 10.5555/zz")))).alias("n"))
)
query("x8_guess_journal", "papers", rf"SELECT id, {FLAT.format(chr(39) + chr(39))} || CASE WHEN regexp_matches(lower(coalesce(venue, '')), 'proceedings|conference|journal|transactions') THEN venue ELSE '' END AS venue FROM papers")(
    lambda t: t.papers.select("id", X.guess_journal("venue").alias("venue"))
)
query(
    "x9_to_metric",
    None,
    "SELECT l_orderkey, l_linenumber, CASE WHEN v > 100 THEN NULL WHEN v > 0 AND v <= 1 THEN round(v * 100, 3) ELSE round(v, 3) END AS metric FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN l_discount WHEN 3 THEN l_extendedprice ELSE NULL END AS v FROM lineitem)",
)(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", S.to_metric(F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).when(F.col("l_linenumber") == 2, F.col("l_discount")).when(F.col("l_linenumber") == 3, F.col("l_extendedprice"))).alias("metric")))
DS = "CASE " + " ".join(f"WHEN contains(lower(line), '{d.lower()}') THEN '{d.replace(' ', '')}'" for d in X.DATASETS) + " END"
query(
    "x10_line_datasets",
    None,
    rf"SELECT doc_id, dataset_name, count(*) AS n FROM (SELECT doc_id, {DS} AS dataset_name FROM (SELECT doc_id, {FLAT.format('unnest(string_split(text, chr(10)))')} AS line FROM documents)) WHERE dataset_name IS NOT NULL GROUP BY 1, 2",
)(
    lambda t: t.documents.select("doc_id", F.explode(X.lines("text")).alias("raw")).select("doc_id", extraction.dataset_of(F.col("raw")).alias("dataset_name")).where("dataset_name IS NOT NULL").groupBy("doc_id", "dataset_name").agg(F.count("*").alias("n"))
)
METRIC_TEXT = "concat('On ACE 2005 P: ', CAST(id % 101 AS STRING), ' R: ', CAST(id % 89 AS STRING), ' F1: ', CAST(id % 97 AS STRING), chr(10), 'no dataset P 1 R 2 F1 3', chr(10), 'MAVEN trigger F1 ', CAST(id % 50 AS STRING))"
query(
    "x10_line_metrics",
    "papers",
    """SELECT id, 1 AS nth, 'ACE2005' AS dataset_name, CASE WHEN id % 101 <= 100 THEN CASE WHEN id % 101 = 1 THEN 100.0 ELSE id % 101 END END AS precision, CASE WHEN id % 89 = 1 THEN 100.0 ELSE id % 89 END AS recall, CASE WHEN id % 97 = 1 THEN 100.0 ELSE id % 97 END AS f1, NULL AS trigger_f1, 0.8 AS confidence FROM papers
  UNION ALL SELECT id, 2, 'MAVEN', NULL, NULL, NULL, CASE WHEN id % 50 = 1 THEN 100.0 ELSE id % 50 END, 0.72 FROM papers""",
)(lambda t: extraction.line_metrics(t.papers.selectExpr("id", f"{METRIC_TEXT} AS text"), "id").select("id", "nth", "dataset_name", "precision", "recall", "f1", "trigger_f1", "confidence"))


#: A table of two rows a metric: headers, and a body row whose dataset stands in its own cell, in a note, or nowhere.
CELL = "CASE id % 4 WHEN 0 THEN 'ACE 2005' WHEN 1 THEN dataset_name WHEN 2 THEN '' ELSE 'MAVEN' END"
NOTED = "CASE WHEN id % 3 = 0 THEN 'as in RAMS' ELSE 'a note' END"
TABLE_ID = "concat(table_id, '-', CAST(id AS STRING))"


def _tables(t):
    cells = F.array(*[F.expr(e) for e in (CELL, "CAST(precision_ AS STRING)", "CAST(recall_ AS STRING)", "concat(CAST(trigger_f1 AS STRING), ' (±1)')", NOTED)])
    rows = F.array(F.array(*map(F.lit, ("Dataset", "P", "Recall", "Trigger F1", "Note"))), cells)
    return t.ee_metrics.select("paper_id", F.when(F.col("source") == "table", "gmft").otherwise("pdfplumber").alias("parser"), F.expr(TABLE_ID).alias("table_id"), (F.col("id") % 9).cast("int").alias("page"), rows.alias("rows"))


NUMBER = "CASE WHEN {0} > 100 THEN NULL WHEN {0} > 0 AND {0} <= 1 THEN round({0} * 100, 3) ELSE round({0}, 3) END"
TABLED = f"""tb AS (SELECT paper_id, {TABLE_ID} AS table_id, CASE WHEN source = 'table' THEN 'gmft' ELSE 'pdfplumber' END AS parser, CASE WHEN id % 4 = 0 THEN 'ACE2005' WHEN id % 4 = 3 THEN 'MAVEN' WHEN id % 3 = 0 THEN 'asinRAMS' END AS dataset_name,
  {NUMBER.format('precision_')} AS p, {NUMBER.format('recall_')} AS r, {NUMBER.format('trigger_f1')} AS f FROM ee_metrics),
  tn AS (SELECT * FROM tb WHERE dataset_name IS NOT NULL)"""
query(
    "x11_table_metrics",
    "ee_metrics",
    f"""WITH {TABLED}, o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, dataset_name, p, r, f ORDER BY table_id) AS rn FROM tn WHERE coalesce(p, r, f) IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY table_id) AS nth FROM o WHERE rn = 1)
  SELECT paper_id, table_id, 1 AS row_index, dataset_name, p AS precision, r AS recall, f AS f1, f AS trigger_f1, NULL AS argument_f1, CASE WHEN parser = 'gmft' THEN 0.86 ELSE 0.78 END AS confidence, CASE WHEN f IS NOT NULL THEN 3 WHEN r IS NOT NULL THEN 2 ELSE 1 END AS col_index FROM n WHERE nth <= 80""",
)(lambda t: extraction.table_metrics(_tables(t)).drop("cell_text", "source"))
query(
    "x11_table_cells",
    "ee_metrics",
    f"""WITH {TABLED} SELECT paper_id, table_id, dataset_name, m AS metric_key, v AS metric_value, c AS col_index FROM (SELECT paper_id, table_id, dataset_name, 'precision' AS m, p AS v, 1 AS c FROM tn UNION ALL SELECT paper_id, table_id, dataset_name, 'recall', r, 2 FROM tn
  UNION ALL SELECT paper_id, table_id, dataset_name, 'f1', f, 3 FROM tn UNION ALL SELECT paper_id, table_id, dataset_name, 'trigger_f1', f, 3 FROM tn) WHERE v IS NOT NULL""",
)(lambda t: extraction.table_cells(_tables(t)).select("paper_id", "table_id", "dataset_name", "metric_key", "metric_value", "col_index"))
MARKED = r"\n\s*(references|bibliography|参考文献)"
query(
    "x12_citation_contexts",
    "citations papers",
    rf"""WITH r AS (SELECT DISTINCT source_paper_id AS a, target_paper_id AS b FROM citations WHERE source_paper_id <> target_paper_id), j AS (SELECT a, b, coalesce(d.text, '') AS text, title, doi FROM r JOIN documents d ON d.doc_id = a JOIN papers p ON p.id = b),
  m AS (SELECT *, CASE WHEN regexp_matches(lower(text), '{MARKED}\b') THEN substr(text, 1, length(regexp_extract(lower(text), '(?s)^(.*?){MARKED}\b', 1))) ELSE text END AS body FROM j),
  w AS (SELECT *, list_filter(list_transform(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]{{4,}}'), lambda x: x NOT IN ('using', 'model', 'method'))[1:3], lambda x: instr(lower(body), x)), lambda i: i > 0)[1] AS hit, CASE WHEN coalesce(doi, '') <> '' THEN nullif(instr(lower(body), lower(trim(doi))), 0) END AS doi_at FROM m),
  p AS (SELECT *, coalesce(hit, doi_at) AS pos FROM w), q AS (SELECT a, b, pos, substr(body, 1, pos - 1) AS before, substr(body, pos) AS after FROM p)
  SELECT a AS source_paper_id, b AS target_paper_id, CASE WHEN pos IS NOT NULL THEN substr({FLAT.format("concat(regexp_extract(before, '(?s)([^.。!?]*)$', 1), CASE WHEN regexp_matches(after, '[.。!?]') THEN regexp_extract(after, '(?s)^([^.。!?]*[.。!?])', 1) ELSE substr(after, 1, 260) END)")}, 1, 360) END AS context FROM q""",
)(lambda t: _contexts(t))


def _contexts(t):
    """The sentence of each citing document, searched in full, that names the cited paper."""
    refs = t.citations.where("source_paper_id <> target_paper_id").select("source_paper_id", "target_paper_id").distinct().join(t.documents.select(F.col("doc_id").alias("source_paper_id"), "text"), "source_paper_id").join(t.papers.select(F.col("id").alias("target_paper_id"), "title", "doi"), "target_paper_id")
    return extraction.citation_contexts(refs).select("source_paper_id", "target_paper_id", "context")


query(
    "x13_note_links",
    "paper_notes",
    "SELECT paper_id, CASE WHEN notes IS NULL THEN 0 ELSE 2 END AS n, CASE WHEN notes IS NOT NULL THEN CAST(paper_id % 50 AS STRING) END AS first FROM paper_notes",
)(lambda t: t.paper_notes.select("paper_id", F.size(X.note_links("notes")).alias("n"), F.get(X.note_links("notes"), F.lit(0)).alias("first")))
query(
    "x14_open_tags",
    "papers",
    "SELECT id, CASE id % 5 WHEN 0 THEN ['Alpha ' || id % 8, 'Beta tag'] WHEN 1 THEN ['gamma ' || id % 6, 'Delta set'] ELSE [] END AS tags FROM papers",
)(lambda t: t.papers.select("id", S.tag_list("dynamic_tags").alias("tags")))
query(
    "x15_canonical_concepts",
    "papers",
    "SELECT id, nullif(substr(array_to_string(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9一-鿿]+', ' ', 'g')), ' ')[1:3], ' '), 1, 80), '') AS concept FROM papers",
)(lambda t: t.papers.select("id", X.canonical_concept("title").alias("concept")))
FIELD = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(x, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{name}'" for name, phrases in X.FIELD_RULES) + " END"
ODD = "concat(text, CASE doc_id % 9 WHEN 0 THEN ' Few-shot' WHEN 1 THEN ' doc-level argument' WHEN 2 THEN ' open domain' ELSE '' END)"
query("x16_infer_field", None, f"SELECT doc_id, {FIELD} AS field FROM (SELECT doc_id, lower({ODD}) AS x FROM documents)")(lambda t: t.documents.select("doc_id", X.infer_field(F.expr(ODD)).alias("field")))
query("x17_source_type", "papers", "SELECT id, CASE WHEN id % 6 = 0 THEN 'CNKI' ELSE 'Global' END AS source_type FROM papers WHERE title IS NOT NULL")(
    lambda t: t.papers.where("title IS NOT NULL").select("id", F.when(S.contains_cjk(F.expr("concat(title, CASE WHEN id % 6 = 0 THEN ' 抽取' ELSE '' END)")), "CNKI").otherwise("Global").alias("source_type"))
)
# A small list of ranked venues; the full list is a file of the caller's.
RANKS = (("A", "association for computational linguistics"), ("A", "ACL"), ("B", "journal of machine learning research"), ("C", "workshop on small things"))
VENUE = "trim(regexp_replace(lower(coalesce(venue, '')), '[^a-z0-9]+', ' ', 'g'))"
query(
    "x18_venue_level",
    "papers",
    f"SELECT id, CASE WHEN contains(v, 'association for computational linguistics') OR contains(v, 'acl') THEN 'A' WHEN contains(v, 'journal of machine learning research') THEN 'B' WHEN contains(v, 'workshop on small things') THEN 'C' END AS level FROM (SELECT id, {VENUE} AS v FROM papers)",
)(lambda t: _venue_levels(t))


def _ranks(t):
    return t.spark.createDataFrame(RANKS, "level string, name string")


def _venue_levels(t):
    return t.papers.select("id", "venue").join(maintenance.venue_levels(t.papers, _ranks(t)), "venue", "left").select("id", "level")


query("j16_venue_match", "papers", f"SELECT v AS venue, count(*) AS n FROM (SELECT {VENUE} AS v FROM papers) WHERE contains(v, 'acl') OR contains(v, 'association for computational linguistics') GROUP BY 1")(
    lambda t: _venue_levels(t).where("level = 'A'").join(t.papers.select("id", X.venue_norm("venue").alias("venue")), "id").groupBy("venue").agg(F.count("*").alias("n"))
)
query(
    "x19_citation_intent",
    "citations",
    """SELECT source_paper_id, target_paper_id, CASE WHEN c LIKE '%baseline%' OR c LIKE '%build on%' OR c LIKE '%following%' THEN 'build_on' WHEN c LIKE '%however%' OR c LIKE '%limitation%' OR c LIKE '%challenge%' THEN 'contrast' WHEN c LIKE '%we use%' OR c LIKE '%adopt%' OR c LIKE '%follow%' THEN 'use_as_baseline' ELSE 'mention' END AS intent
  FROM (SELECT *, lower(coalesce(context_snippet, '')) AS c FROM citations)""",
)(lambda t: t.citations.select("source_paper_id", "target_paper_id", S.citation_intent("context_snippet")["intent"].alias("intent")))
EV = ", ".join(f"'{e}'" for e in X.EVENTS)
query("x20_schema_fallback", None, f"SELECT doc_id, list_filter([{EV}], lambda w: contains(lower(coalesce(text, '')), lower(w))) AS events FROM documents")(lambda t: t.documents.select("doc_id", X.schema_fallback("text")["events"].alias("events")))
query("x21_metadata_merge", "papers paper_notes", "SELECT id, coalesce(nullif(method, ''), nullif(venue, '')) AS venue, coalesce(nullif(datasets, ''), nullif(title, '')) AS title FROM papers LEFT JOIN paper_notes ON paper_id = id")(
    lambda t: t.papers.join(t.paper_notes.withColumnRenamed("paper_id", "id"), "id", "left").select("id", S.first_present("method", "venue").alias("venue"), S.first_present("datasets", "title").alias("title"))
)
query("x24_author_names", "papers", "SELECT id, 2 AS n, 'Ann' AS first, chr(CAST(65 + id % 26 AS INT)) || 'x' AS last FROM papers")(
    lambda t: t.papers.select("id", X.author_names("authors").alias("a")).select("id", F.size("a").alias("n"), F.col("a")[0]["first"].alias("first"), F.col("a")[0]["last"].alias("last"))
)
query("x25_lenient_json", "job_runs", "SELECT id, CAST(json_extract_string(payload, '$.k') AS INT) AS k FROM job_runs")(
    lambda t: t.job_runs.select("id", X.lenient_json(F.when(F.col("id") % 2 == 0, F.concat(F.lit("Sure: "), "payload", F.lit(" done"))).otherwise(F.col("payload")), "k int")["k"].alias("k"))
)
query("x27_sha256", None, "SELECT page_id, sha256(html) AS h FROM pages")(lambda t: t.pages.select("page_id", F.sha2("html", 256).alias("h")))


# ontology, boards, reports ----------------------------------------------------------------------------------------

query("j6_co_occurrence", "concept_links", "WITH d AS (SELECT DISTINCT paper_id, concept_id FROM concept_links) SELECT x.concept_id AS a, y.concept_id AS b, count(*) AS n FROM d x JOIN d y ON x.paper_id = y.paper_id AND x.concept_id < y.concept_id GROUP BY 1, 2 HAVING count(*) >= 2")(
    lambda t: ontology.co_occurrence(t.concept_links)
)
query("j7_concept_support", "concept_links", f"SELECT concept_id, count(DISTINCT paper_id) AS papers FROM concept_links GROUP BY 1 HAVING count(DISTINCT paper_id) >= 3")(lambda t: ontology.support(t.concept_links.select("concept_id").distinct(), t.concept_links, 3))
query(
    "g8_ontology_graph",
    "concept_links",
    "WITH d AS (SELECT DISTINCT paper_id, concept_id FROM concept_links WHERE concept_type <> 'click'), e AS (SELECT x.concept_id AS a, y.concept_id AS b, count(*) AS n FROM d x JOIN d y ON x.paper_id = y.paper_id AND x.concept_id < y.concept_id GROUP BY 1, 2 HAVING count(*) >= 2), s AS (SELECT concept_id, count(*) AS papers FROM d GROUP BY 1) SELECT e.a, e.b, e.n, p.papers AS papers_a, q.papers AS papers_b FROM e JOIN s p ON p.concept_id = a JOIN s q ON q.concept_id = b",
)(lambda t: _ontology_graph(t))


def _ontology_graph(t):
    links = t.concept_links.where("concept_type <> 'click'")
    s = ontology.support(links.select("concept_id").distinct(), links)
    return ontology.co_occurrence(links).join(s.toDF("a", "papers_a"), "a").join(s.toDF("b", "papers_b"), "b").select("a", "b", "n", "papers_a", "papers_b")


query("u7_concept_upsert", "concept_links", "SELECT concept_type AS canonical, 'event' AS type, [concept_type] AS aliases FROM (SELECT DISTINCT concept_type FROM concept_links)")(
    lambda t: ontology.upsert_concepts(t.concept_links.select(F.col("concept_type").alias("name"), F.lit("event").alias("concept_type")))
)
query("b1_topic_of", "papers", f"SELECT id, {TOPIC} AS topic FROM papers")(lambda t: t.papers.select("id", S.topic_of().alias("topic")))
query("b2_topic_evolution", "papers", f"WITH {TY}, y AS (SELECT year, sum(n) AS papers, count(*) AS topics, max(n) AS largest FROM ty GROUP BY 1) SELECT * FROM y")(
    lambda t: A.topic_years(t.papers).groupBy("year").agg(F.sum("n").alias("papers"), F.count("*").alias("topics"), F.max("n").alias("largest"))
)
query("b3_velocity", "papers", f"SELECT id, round({VEL}, 4) AS velocity FROM papers")(lambda t: t.papers.select("id", F.round(S.velocity(AS_OF), 4).alias("velocity")))
BOARD = "SELECT m.id, p.title, coalesce(f1, argument_f1, trigger_f1, 0) AS score FROM ee_metrics m JOIN papers p ON p.id = m.paper_id {} ORDER BY score DESC, coalesce(year, 0) DESC, m.id LIMIT {}"
query("b4_sota_board", "ee_metrics papers", BOARD.format("WHERE lower(dataset_name) = 'ds5'", 50))(lambda t: A.sota_board(t.ee_metrics, t.papers, "DS5").select("id", "title", "score"))
query("b5_leaderboard", "ee_metrics papers", BOARD.format("", 300))(lambda t: A.sota_board(t.ee_metrics, t.papers, limit=300).select("id", "title", "score"))
query("b6_provenance", "ee_metrics", "SELECT id, table_id, source, confidence FROM ee_metrics WHERE source = 'table' ORDER BY confidence DESC, id LIMIT 1000")(
    lambda t: t.ee_metrics.where("source = 'table'").orderBy(F.desc("confidence"), "id").limit(1000).select("id", "table_id", "source", "confidence")
)
query(
    "b7_periods",
    None,
    "SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS week_end, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders",
)(
    lambda t: t.orders.select("o_orderkey", *[f(F.col("o_orderdate").cast("date"), kind).alias(f"{kind[:-2]}_{name}") for kind in ("weekly", "monthly") for name, f in (("start", reports.period_start), ("end", reports.period_end))])
)
query(
    "b8_report",
    "papers reading_tasks",
    """SELECT count(*) AS total, count(*) FILTER (read_status = 1) AS read, count(*) FILTER (coalesce(file_path, '') <> '') AS uploaded, count(*) FILTER (read_status = 1 AND updated_at BETWEEN 1700086400 AND 1701291199) AS read_updates,
  (SELECT list(id ORDER BY id DESC) FROM (SELECT id FROM papers WHERE created_at BETWEEN 1700086400 AND 1701291199 ORDER BY created_at DESC, id DESC LIMIT 20)) AS new_papers, (SELECT count(*) FROM reading_tasks WHERE status <> 'done' AND due_date < '1997-06-01') AS overdue FROM papers""",
)(lambda t: reports.report(t.papers, t.reading_tasks, 1_700_086_400, 1_701_291_199, "1997-06-01"))

# queue ------------------------------------------------------------------------------------------------------------

query(
    "q1_enqueue",
    "sync_queue papers",
    f"""SELECT coalesce(q.paper_id, p.id) AS paper_id, CASE WHEN p.id IS NOT NULL AND coalesce(status, '') <> 'running' THEN 'queued' ELSE status END AS status, CASE WHEN p.id IS NOT NULL THEN {NOW} + 600 ELSE next_run_at END AS next_run_at
  FROM sync_queue q FULL JOIN (SELECT id FROM papers WHERE id % 3 = 0) p ON p.id = q.paper_id""",
)(lambda t: queueing.enqueue(t.sync_queue, t.papers.where("id % 3 = 0").select(F.col("id").alias("paper_id")), NOW, 600).select("paper_id", "status", "next_run_at"))
query(
    "q2_settle",
    "sync_queue",
    f"""SELECT paper_id, CASE WHEN paper_id % 5 = 0 THEN 'failed' WHEN paper_id % 5 = 1 THEN 'idle' ELSE status END AS status, CASE WHEN paper_id % 5 = 0 THEN attempts + 1 WHEN paper_id % 5 = 1 THEN 0 ELSE attempts END AS attempts,
  CASE WHEN paper_id % 5 = 0 THEN {NOW} + CAST(least(600 * pow(2, least(attempts + 1, 5)), 86400) AS BIGINT) WHEN paper_id % 5 = 1 THEN {NOW} + 86400 ELSE next_run_at END AS next_run_at FROM sync_queue""",
)(lambda t: queueing.settle(t.sync_queue, t.sync_queue.where("paper_id % 5 < 2").select("paper_id", F.when(F.col("paper_id") % 5 == 0, "broken").alias("error")), NOW).select("paper_id", "status", "attempts", "next_run_at"))
query("q3_backoff", "sync_queue", "SELECT paper_id, CAST(least(600 * pow(2, least(attempts + 1, 5)), 86400) AS BIGINT) AS delay FROM sync_queue")(lambda t: t.sync_queue.select("paper_id", S.retry_delay("attempts").alias("delay")))
query(
    "q4_expand",
    "citations papers sync_queue",
    "SELECT id AS paper_id FROM papers WHERE coalesce(file_path, '') = '' AND id IN (SELECT source_paper_id FROM citations UNION SELECT target_paper_id FROM citations) AND id NOT IN (SELECT paper_id FROM sync_queue WHERE paper_id % 2 = 0)",
)(lambda t: queueing.expand(t.citations, t.papers, t.sync_queue.where("paper_id % 2 = 0")))
query("q5_job_state", "job_runs", "SELECT job_type, user_id, arg_max(status, struct_pack(a := created_at, b := id)) AS status, count(*) FILTER (status = 'failed') AS failures FROM job_runs GROUP BY 1, 2")(lambda t: queueing.job_state(t.job_runs))
query("q6_spaced_repetition", "reading_tasks", "SELECT id, CASE WHEN interval_days <= 0 THEN 1 WHEN interval_days < 3 THEN 3 WHEN interval_days < 7 THEN 7 WHEN interval_days < 14 THEN 14 WHEN interval_days < 30 THEN 30 ELSE 60 END AS next_days FROM reading_tasks")(
    lambda t: t.reading_tasks.select("id", S.next_interval("interval_days").alias("next_days"))
)

# sources and sinks ------------------------------------------------------------------------------------------------

query("src6_page_text", None, "SELECT doc_id, md5(array_to_string(string_split(coalesce(text, ''), chr(10))[1:2], chr(10))) AS h FROM documents")(lambda t: t.documents.select("doc_id", F.md5(connectors.pages_of(F.col("text"), 2, "\n")).alias("h")))
query(
    "src7_text_fallback",
    None,
    "SELECT doc_id AS paper_id, md5(CASE WHEN doc_id % 3 = 0 THEN coalesce('# ' || lang || chr(10) || text, text) ELSE text END) AS h, CASE WHEN doc_id % 3 = 0 AND lang IS NOT NULL AND text IS NOT NULL THEN 'markdown' ELSE 'pages' END AS kind FROM documents",
)(lambda t: _parsed_texts(t))


def _parsed_texts(t):
    """Whole texts of the documents, as a parser's Markdown where it made some: of a third, and blank for another third."""
    made = t.documents.where("doc_id % 3 <> 2").select(F.col("doc_id").alias("paper_id"), F.expr("CASE WHEN doc_id % 3 = 0 THEN '# ' || lang || chr(10) || text ELSE ' ' END").alias("markdown"))
    return connectors.paper_texts(t.documents.select(F.col("doc_id").alias("paper_id"), "text"), made).select("paper_id", F.md5("text").alias("h"), "kind")


TL = rf"SELECT doc_id, list_filter(list_transform(string_split(line, '|'), lambda c: {FLAT.format('c')}), lambda c: c <> '') AS cells FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE contains(line, '|')"
query("src8_table_lines", None, f"SELECT doc_id, md5(array_to_string(cells, ' | ')) AS h FROM ({TL})")(lambda t: extraction.table_lines(t.documents).select("doc_id", F.md5("line").alias("h")))
query("src9_table_cells", None, f"SELECT doc_id, sum(len(cells)) AS n_cells FROM ({TL}) GROUP BY 1")(lambda t: extraction.table_lines(t.documents).groupBy("doc_id").agg(F.sum(F.size(F.filter("cells", lambda c: c != ""))).alias("n_cells")))
query("src10_references", None, "SELECT doc_id, md5(CASE WHEN length(e) >= 400 THEN e END) AS h FROM (SELECT doc_id, right(coalesce(text, ''), 20000) AS e FROM documents)")(lambda t: t.documents.select("doc_id", F.md5(X.references_section("text")).alias("h")))


query(
    "src9_parsed_tables",
    "ee_metrics",
    f"SELECT paper_id, CASE WHEN source = 'table' THEN 'gmft' ELSE 'pdfplumber' END AS parser, {TABLE_ID} AS table_id, CAST(id % 9 AS INT) AS page, 2 AS n_rows, ({CELL}) AS first_cell FROM ee_metrics",
)(lambda t: _parsed(t))


def _parsed(t):
    """The tables of two parsers as one, with a blank row each that is left out."""
    tables = _tables(t).withColumn("rows", F.concat("rows", F.array(F.array(F.lit(" "), F.lit(None).cast("string")))))
    both = connectors.parsed_tables(tables.where("parser = 'gmft'"), tables.where("parser <> 'gmft'"))
    return both.select("paper_id", "parser", "table_id", "page", F.size("rows").alias("n_rows"), F.get(F.get("rows", F.lit(1)), F.lit(0)).alias("first_cell"))


def _landing(t, rows, name):
    """Answers of a web service, as a job would land them: a folder of JSON lines, here in the session's shared folder."""
    folder = f"{scratch_dir(t.spark)}/landed-{name}-{uuid.uuid4().hex}"
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).unionByName(t.spark.createDataFrame([("broken {",)], "value string")).write.text(folder)
    return folder


query("src11_landed_records", "papers", "SELECT concat('p', id) AS paper_id, title, year, doi, citation_count, concat('Ann X, Bo ', id) AS authors, 'AI, CS' AS fields FROM papers")(lambda t: _landed_papers(t))


def _landed_papers(t):
    """Papers as a service would answer, landed and read back."""
    people = F.array(F.struct(F.lit("Ann X").alias("name")), F.struct(F.concat(F.lit("Bo "), F.col("id").cast("string")).alias("name")))
    rows = t.papers.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("paperId"), "title", "year", F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.col("citation_count").alias("citationCount"), people.alias("authors"), F.array(*map(F.lit, ("CS", "AI", "CS"))).alias("fieldsOfStudy"))
    return connectors.landed_records(t.spark, _landing(t, rows, "papers"))


query("src12_title_dois", "papers", "SELECT title, min(trim(doi)) AS doi FROM papers WHERE coalesce(title, '') <> '' AND doi IS NOT NULL AND id % 3 <> 0 GROUP BY 1")(lambda t: _landed_works(t))


def _landed_works(t):
    """Works found for titles: the first one's DOI; for a third of the titles nothing is found."""
    item = lambda doi: F.struct(doi.alias("DOI"), F.array(F.col("title")).alias("title"))
    some = F.when(F.col("id") % 3 != 0, F.array(item(F.trim("doi")), item(F.lit("10.9/other")))).otherwise(F.array().cast("array<struct<DOI:string,title:array<string>>>"))
    rows = t.papers.select(F.col("title").alias("query"), F.struct(some.alias("items")).alias("message"))
    return connectors.title_dois(connectors.landed(t.spark, _landing(t, rows, "works"), connectors.WORKS))


query("src13_library_search", "papers", "SELECT title, concat('k', min(id)) AS key, 3 AS version FROM papers WHERE coalesce(title, '') <> '' GROUP BY 1")(lambda t: _library_search(t))


def _library_search(t):
    """Items found for each title: an unlike one first, then those of the title in order."""
    one = t.papers.where("coalesce(title, '') <> ''")
    w = Window.partitionBy("title").orderBy("id")
    like = one.select("title", (F.row_number().over(w) + 1).alias("nth"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(3).cast("long").alias("version"), F.concat(F.lit(" "), F.col("title"), F.lit("  ")).alias("found"))
    unlike = one.select("title", F.lit(1).alias("nth"), F.lit("other").alias("key"), F.lit(1).cast("long").alias("version"), F.concat("title", F.lit(" x")).alias("found")).distinct()
    return connectors.library_search(one, unlike.unionByName(like))


query("src13_library_put", "papers", "SELECT concat('k', id) AS key, CASE WHEN id % 4 = 0 THEN 8 ELSE 7 END AS version, CASE WHEN id % 4 = 0 THEN 'new' ELSE title END AS title FROM papers")(lambda t: _library_put(t))


def _library_put(t):
    """Changes of every second item; half of them were read at a version that is no longer the item's."""
    items = t.papers.select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(7).cast("long").alias("version"), F.struct("title").alias("data"))
    changes = t.papers.where("id % 2 = 0").select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.expr("CAST(CASE WHEN id % 4 = 0 THEN 7 ELSE 6 END AS BIGINT)").alias("version"), F.struct(F.lit("new").alias("title")).alias("data"))
    return connectors.library_put(items, changes)[0].select("key", "version", F.col("data.title").alias("title"))


query("src14_completions", "papers", "SELECT id, title AS prompt, NULL AS answer FROM papers")(lambda t: connectors.completions(t.papers.select("id", F.col("title").alias("prompt"))))
Q = "concat('\"', replace(coalesce(CAST({} AS STRING), ''), '\"', '\"\"'), '\"')"
query(
    "snk6_csv_lines",
    "papers",
    "SELECT rn AS \"order\", concat_ws(',', " + ", ".join(Q.format(c) for c in ("rn", "title", "authors", "year", "nullif(venue, '')", "doi", "concat('https://doi.org/', nullif(trim(doi), ''))")).replace(Q.format("concat('https://doi.org/', nullif(trim(doi), ''))"), Q.format("CASE WHEN nullif(doi, '') IS NOT NULL THEN 'https://doi.org/' || trim(doi) END")) + ") AS line FROM (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM papers)",
)(lambda t: sinks.csv_lines(t.papers))
query("snk7_markdown", "papers", "SELECT id, concat('- **', coalesce(title, ''), '** (', coalesce(CAST(year AS STRING), 'n.d.'), ') ', authors) AS line FROM papers")(lambda t: sinks.markdown_lines(t.papers))
query(
    "snk8_bibtex",
    "papers",
    r"""SELECT id, CASE WHEN n > 1 THEN concat(base, n) ELSE base END AS key, type FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM (SELECT id, concat(chr(CAST(97 + id % 26 AS INT)), 'x', coalesce(CAST(year AS STRING), ''), regexp_replace(lower(regexp_extract(coalesce(title, ''), '(\S+)', 1)), '[^a-z0-9]+', '', 'g')) AS base,
  CASE WHEN regexp_matches(lower(coalesce(venue, '')), 'journal|transactions|letters') THEN 'article' WHEN regexp_matches(lower(coalesce(venue, '')), 'proc|conference|meeting|workshop|symposium') THEN 'inproceedings' ELSE 'misc' END AS type FROM papers))""",
)(lambda t: sinks.bibtex_entries(t.papers))
query("snk10_event_rows", "chat_messages", "SELECT id, concat('data: {\"role\":\"', role, '\",\"id\":', id, '}') AS line FROM chat_messages")(lambda t: t.chat_messages.select("id", F.concat(F.lit("data: "), F.to_json(F.struct("role", "id"))).alias("line")))

# streams, run as batches over the same code ------------------------------------------------------------------------

query("st1_tumbling", None, "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")(lambda t: jobs.tumbling(t.events).withColumn("start", F.col("start").cast("timestamp_ntz")))
query("st2_sliding", None, "SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1")(lambda t: jobs.sliding(t.events).withColumn("start", F.col("start").cast("timestamp_ntz")))
query(
    "st3_sessions",
    None,
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, s""",
)(lambda t: jobs.sessions(t.events).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz")))
query("st4_weekly", None, "SELECT date_trunc('week', ts) AS start, count(*) AS n FROM events GROUP BY 1")(lambda t: jobs.weekly(t.events).withColumn("start", F.col("start").cast("timestamp_ntz")))


@query("st5_stream_counts", None, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(t):
    """The events as a stream, run over what is there, counted by type."""
    stream = t.spark.readStream.schema(jobs.EVENTS).parquet(f"{t.sf_dir}/event[s].parquet")
    return jobs.run_available(stream.groupBy("event_type").agg(F.count("*").alias("n")), f"stream_counts_{abs(hash(t.sf_dir))}", "complete")


@query("st6_session_memory", "chat_messages", "SELECT session_id, id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM chat_messages) WHERE n <= 12")
def session_memory(t):
    """The last messages of each session, kept by a stream over the conversations."""
    stream = t.spark.readStream.schema(t.conversations.schema).parquet(f"{t.sf_dir}/conversation[s].parquet")
    messages = stream.selectExpr("conv_id AS session_id", "conv_id * 1000 + turn AS id", "role", "text AS content")
    path = f"{scratch_dir(t.spark)}/memory-{uuid.uuid4().hex}"
    jobs.start(messages, jobs.remember_into(path), f"{path}-state", once=True).awaitTermination()
    return jobs.latest(t.spark, path)

