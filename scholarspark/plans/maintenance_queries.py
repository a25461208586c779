"""Queries of table maintenance, ingestion, record mapping and the remaining list operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import entity, graph
from ..operators import maintenance as M
from ..operators import relational as R
from ..operators.lineage import scratch_dir
from ..sources import connectors
from .extraction_queries import VENUE, _ranks
from .graph_queries import _pagerank_sql
from .registry import query
from .retrieval_queries import SEARCHED
from .relational_queries import NZ_FILE, TODAY

query("p2_rank_size", "papers citations", f"SELECT id, round(20 + least(50.0, 800 * rank), 5) AS size FROM ({_pagerank_sql(3)})")(
    lambda t: graph.pagerank(t.papers, graph.simple_edges(t.citations), 3, tolerance=0).select("id", F.round(20 + F.least(F.lit(50.0), 800 * F.round("rank", 9)), 5).alias("size"))
)
query(
    "p3_node_view",
    "papers reading_tasks experiments",
    f"""SELECT p.id, coalesce(nullif(title, ''), concat('Paper ', p.id)) AS label, coalesce(o, 0) AS open_tasks, coalesce(d, 0) AS overdue_tasks, coalesce(e, 0) AS experiment_count FROM papers p
  LEFT JOIN (SELECT paper_id, count(*) FILTER (status <> 'done') AS o, count(*) FILTER (status <> 'done' AND due_date < '{TODAY}') AS d FROM reading_tasks GROUP BY 1) t ON t.paper_id = p.id
  LEFT JOIN (SELECT paper_id, count(*) AS e FROM experiments GROUP BY 1) x ON x.paper_id = p.id""",
)(lambda t: R.node_stats(R.node_projection(t.papers).select("id", "label"), t.reading_tasks, t.experiments, TODAY))
query("t1_clamped_limit", "job_runs", "SELECT id, status FROM job_runs ORDER BY id DESC LIMIT 500")(lambda t: t.job_runs.orderBy(F.desc("id")).limit(R.clamp(9999, 500)).select("id", "status"))
query("t2_multi_key", "ee_metrics papers", "SELECT m.id FROM ee_metrics m JOIN papers p ON p.id = m.paper_id ORDER BY coalesce(f1, argument_f1, trigger_f1, 0) DESC, coalesce(year, 0) DESC, m.id LIMIT 200")(
    lambda t: A.sota_board(t.ee_metrics, t.papers, limit=200).select("id")
)
query("t8_top_lists", "papers", "SELECT id, citation_count FROM papers ORDER BY citation_count DESC, id LIMIT 80")(lambda t: t.papers.orderBy(F.desc("citation_count"), "id").limit(80).select("id", "citation_count"))
query("s1_id_union", "papers citations", "SELECT id FROM papers WHERE id % 2 = 0 UNION SELECT target_paper_id FROM citations WHERE confidence > 0.6")(
    lambda t: t.papers.where("id % 2 = 0").select("id").union(t.citations.where("confidence > 0.6").select("target_paper_id")).distinct()
)
query("s4_alias_union", "papers", "SELECT sub_field, list_sort(list_distinct(list(concat(lower(venue), ' ', id % 60))))[1:40] AS aliases FROM papers WHERE coalesce(venue, '') <> '' AND coalesce(sub_field, '') <> '' GROUP BY 1")(
    lambda t: M.alias_union(t.papers.selectExpr("sub_field", "CASE WHEN venue <> '' THEN concat(venue, ' ', CAST(id % 60 AS STRING)) END AS alias"), "sub_field", "alias")
)
query("w4_first_seen", "papers", "SELECT id, lower(unnest(string_split(concat(keywords, ',x,X'), ','))) AS tag FROM papers WHERE keywords = 'never' UNION ALL SELECT id, tag FROM (SELECT id, unnest(CASE WHEN keywords = '' THEN ['', 'x'] ELSE [string_split(keywords, ',')[1], 'common', 'x'] END) AS tag FROM papers)")(
    lambda t: M.first_seen(t.papers.select("id", F.posexplode(F.split(F.concat("keywords", F.lit(",x,X")), ",")).alias("at", "tag")), "id", "at", "tag").select("id", "tag")
)
query("w6_min_id", "papers", "SELECT min(id) AS id, doi FROM papers WHERE doi IS NOT NULL GROUP BY doi")(lambda t: R.keep_first(t.papers.where("doi IS NOT NULL").select("id", "doi"), ["doi"]))
query("w7_collisions", "papers", "SELECT id, row_number() OVER (PARTITION BY coalesce(year, 0), authors ORDER BY id) AS n FROM papers")(lambda t: t.papers.select("id", F.row_number().over(Window.partitionBy(F.coalesce("year", F.lit(0)), "authors").orderBy("id")).alias("n")))
query("a20_corpus_stats", None, "SELECT count(*) AS n, avg(len(string_split(text, ' '))) AS mean_words, sum(CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END) AS df FROM documents")(
    lambda t: t.documents.agg(F.count("*").alias("n"), F.avg(F.size(F.split("text", " "))).alias("mean_words"), F.count_if(F.col("text").contains("the")).alias("df"))
)
query("u8_note_upsert", "paper_notes", "SELECT paper_id, coalesce(CASE WHEN paper_id % 6 = 0 THEN 'fresh note' END, notes) AS notes FROM paper_notes UNION ALL SELECT 900001, 'new'")(
    lambda t: entity.merge_by_key(
        t.paper_notes.select("paper_id", "notes"),
        t.paper_notes.where("paper_id % 6 = 0").select("paper_id", F.lit("fresh note").alias("notes")).unionByName(t.spark.createDataFrame([(900001, "new")], "paper_id long, notes string")),
        ["paper_id"],
        ["notes"],
    )
)
query("u10_alias_learning", "papers", "SELECT alias, level FROM (SELECT lower(trim(venue)) AS alias, min(ccf_level) AS level FROM papers WHERE ccf_level IS NOT NULL AND coalesce(venue, '') <> '' GROUP BY 1) WHERE alias <> 'proc. acl 2020' UNION ALL SELECT 'proc. acl 2020', 'B'")(
    lambda t: M.learn_aliases(t.spark.createDataFrame([("proc. acl 2020", "B")], "alias string, level string"), t.papers.select(F.lower(F.trim("venue")).alias("alias"), F.col("ccf_level").alias("level")))
)
query(
    "u11_relevel",
    "papers",
    f"SELECT id, coalesce(CASE WHEN contains(v, 'association for computational linguistics') OR contains(v, 'acl') THEN 'A' WHEN contains(v, 'journal of machine learning research') THEN 'B' WHEN contains(v, 'workshop on small things') THEN 'C' END, ccf_level) AS ccf_level FROM (SELECT id, ccf_level, {VENUE} AS v FROM papers)",
)(lambda t: M.relevel(t.papers, _ranks(t)).select("id", "ccf_level"))
query(
    "u13_promote_fields",
    "papers",
    "WITH f AS (SELECT DISTINCT sub_field AS name FROM papers WHERE coalesce(sub_field, '') <> '' UNION SELECT 'GAMMA 3') SELECT name FROM f UNION ALL SELECT unnest(['Alpha 0', 'Beta tag', 'Delta set', 'gamma 0'])",
)(lambda t: _promoted(t))


def _promoted(t):
    """Fields, one of them spelled like a tag in capitals, with the clusters of the open tags."""
    fields = t.papers.where("sub_field <> ''").select(F.col("sub_field").alias("name")).distinct().union(t.spark.createDataFrame([("GAMMA 3",)], "name string"))
    return M.promote_fields(fields, A.tag_clusters(A.open_tags(t.papers, [], top=200)))


query(
    "u16_backfill_counters",
    "papers",
    rf"""WITH p AS (SELECT * FROM papers WHERE {NZ_FILE} AND (coalesce(summary_one, '') = '' OR refs_parsed_at IS NULL) ORDER BY id DESC LIMIT 100)
  SELECT count(*) AS processed, count(*) FILTER (coalesce(summary_one, '') = '' AND id % 2 = 0) AS summary_added, count(*) FILTER (refs_parsed_at IS NULL) AS references_parsed, count(*) FILTER (id % 5 = 0) AS metrics_upserted, 2 * count(*) FILTER (id % 5 = 0) AS metric_cells_upserted, 2 * count(*) FILTER (id % 5 = 0) AS auto_experiments FROM p""",
)(lambda t: _backfill(t)["counters"].drop("chunks_indexed", "schemas_extracted"))


def _backfill(t):
    """Every step over the newest papers: the model answers for even ids, every fifth paper has a table with two scores."""
    tables = t.papers.where("id % 5 = 0").select(F.col("id").alias("paper_id"), F.lit("gmft").alias("parser"), F.lit("t1").alias("table_id"), F.expr("array(array('Dataset', 'P', 'R'), array('MAVEN', '50', '60'))").alias("rows"))
    answer = lambda rows: rows.withColumn("answer", F.when(F.col("id") % 2 == 0, F.lit("a line")))
    return M.backfill(t.papers, t.papers.select(F.col("id").alias("paper_id"), F.col("abstract").alias("text")), tables, limit=100, summarise=answer)


query(
    "g11_ingest_references",
    "papers citations",
    """WITH o AS (SELECT source_paper_id AS s, target_paper_id AS g, max(confidence) AS c FROM citations GROUP BY 1, 2), n AS (SELECT id AS s, id + 1 AS g FROM papers WHERE id % 4 = 0 UNION ALL SELECT id + 1, id FROM papers WHERE id % 8 = 0)
  SELECT coalesce(o.s, n.s) AS source_paper_id, coalesce(o.g, n.g) AS target_paper_id, CASE WHEN n.s IS NULL THEN o.c WHEN o.s IS NULL THEN 0.85 ELSE greatest(coalesce(o.c, 0), 0.85) END AS confidence FROM o FULL JOIN n ON o.s = n.s AND o.g = n.g""",
)(lambda t: _ingest(t))


def _ingest(t):
    """Fetched references and citations, both as edges from the citing paper, merged into the table."""
    old = t.citations.groupBy("source_paper_id", "target_paper_id").agg(F.max("confidence").alias("confidence"))
    out = t.papers.where("id % 4 = 0").select(F.col("id").alias("source_paper_id"), (F.col("id") + 1).alias("target_paper_id"))
    into = t.papers.where("id % 8 = 0").select((F.col("id") + 1).alias("source_paper_id"), F.col("id").alias("target_paper_id"))
    return entity.upsert_edges(old, out.unionByName(into).withColumn("confidence", F.lit(0.85)))


query("q7_cleanup_throttle", "job_runs", "SELECT job_type, max(created_at) + 86400 <= 1700350000 AS due FROM job_runs GROUP BY 1")(lambda t: M.cleanup_due(t.job_runs, 1_700_350_000))
query("x22_record_flatten", "papers", "SELECT concat('p', id) AS paper_id, doi, concat('Ann, Bo ', id) AS authors, 'AI, CS' AS fields FROM papers")(
    lambda t: connectors.flat_records(
        t.papers.select(
            F.concat(F.lit("p"), F.col("id").cast("string")).alias("paperId"),
            "title",
            "year",
            F.struct(F.col("doi").alias("DOI")).alias("externalIds"),
            F.col("citation_count").alias("citationCount"),
            F.array(F.struct(F.lit("Ann").alias("name")), F.struct(F.concat(F.lit("Bo "), F.col("id").cast("string")).alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"),
            F.array(F.lit("CS"), F.lit("AI"), F.lit("CS")).alias("fieldsOfStudy"),
        )
    ).select("paper_id", "doi", "authors", "fields")
)
query(
    "x23_library_mapping",
    "papers",
    r"SELECT concat('k', id) AS key, CASE id % 3 WHEN 0 THEN 'Ann X, Y' WHEN 1 THEN 'Y' END AS authors, CAST(nullif(regexp_extract(concat('published ', coalesce(CAST(year AS STRING), 'unknown')), '\b((?:19|20)\d{2})\b', 1), '') AS INT) AS year, substr(nullif(abstract, ''), 1, 300) AS summary_one FROM papers",
)(
    lambda t: M.library_fields(
        t.papers.select(
            F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"),
            F.struct(
                "title",
                F.concat(F.lit("published "), F.coalesce(F.col("year").cast("string"), F.lit("unknown"))).alias("date"),
                F.col("abstract").alias("extra"),
                F.col("venue").alias("publicationTitle"),
                F.col("doi").alias("DOI"),
                F.expr("CASE id % 3 WHEN 0 THEN array(struct(' Ann' AS firstName, 'X ' AS lastName), struct('' AS firstName, 'Y' AS lastName)) WHEN 1 THEN array(struct(NULL AS firstName, 'Y' AS lastName)) ELSE array() END").alias("creators"),
            ).alias("data"),
        )
    ).select("key", "authors", "year", "summary_one")
)
query(
    "x26_metadata_normalise",
    "papers",
    """SELECT id, nullif(trim(venue), '') AS venue, CASE WHEN lower(trim(sub_field)) = 'src1' THEN 'SRC1' ELSE nullif(trim(sub_field), '') END AS sub_field, CASE WHEN lower(coalesce(trim(CASE WHEN id % 2 = 0 THEN upper(sub_field) ELSE source_type END), '')) <> lower(coalesce(trim(sub_field), '')) THEN nullif(trim(CASE WHEN id % 2 = 0 THEN upper(sub_field) ELSE source_type END), '') END AS open_sub_field,
  CASE WHEN id % 4 <> 0 THEN year END AS year FROM papers""",
)(
    lambda t: M.normalise_metadata(
        t.papers.selectExpr("id", "concat(venue, ' ') AS venue", "concat(' ', sub_field) AS sub_field", "CASE WHEN id % 2 = 0 THEN upper(sub_field) ELSE source_type END AS open_sub_field", "CASE WHEN id % 4 = 0 THEN 'about 2001' ELSE CAST(year AS STRING) END AS year"), ["SRC1"]
    )
)
query("x28_fill_if_blank", "papers", "SELECT id, coalesce(nullif(trim(venue), ''), 'from library') AS venue FROM papers")(lambda t: M.fill_if_blank(t.papers.select("id", "venue"), venue=F.lit("from library")))
query("x30_model_fallback", "papers", "SELECT id, title AS prompt, NULL AS answer FROM papers WHERE summary_one = ''")(lambda t: connectors.completions(t.papers.where("summary_one = ''").select("id", F.col("title").alias("prompt"))))
query("x7_first_doi_text", None, r"SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b', 0), '') AS doi FROM documents")(lambda t: t.documents.select("doc_id", X.first_doi("text").alias("doi")))
query("snk5_search_table", "papers paper_notes", f"SELECT doc_id, md5(text) AS h, length(text) AS n FROM ({SEARCHED})")(lambda t: R.search_documents(t.papers, t.paper_notes).select("doc_id", F.md5("text").alias("h"), F.length("text").alias("n")))


@query("src15_venue_ranks", "papers", "SELECT DISTINCT CASE length(venue) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS level, venue FROM papers WHERE coalesce(venue, '') <> ''")
def venue_ranks(t):
    """A file of ranked venues, made of the papers' own in the session's shared folder and read back."""
    folder = f"{scratch_dir(t.spark)}/ranks-{uuid.uuid4().hex}"
    names = t.papers.where("coalesce(venue, '') <> ''").select("venue").distinct().withColumn("level", F.expr("substr('ABC', length(venue) % 3 + 1, 1)"))
    lists = [F.collect_set(F.when(F.col("level") == x, F.col("venue"))).alias(x) for x in "ABC"]  # a list of venues
    names.agg(*lists).select(F.to_json(F.struct("A", "B", "C")).alias("value")).coalesce(1).write.text(folder)
    return connectors.venue_ranks(t.spark, folder)
