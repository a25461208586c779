"""Queries of services, stateful streams, committed tables and persistent indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import enrichment, entity
from ..operators.inverted import InvertedIndex
from ..operators.lineage import scratch_dir
from ..operators.vectors import VectorCollection
from ..sources import connectors, events, services
from ..sources.committed import CommittedTable
from ..streaming import poll, state
from .registry import query
from .retrieval_queries import ASKED, _bm25_sql, _query_vector

#: When the recorded services were asked.
NOW = 1_700_100_000
#: Records of a recorded answer, so that papers have several pages.
PAGE = 2
FAILS = "id % 23 = 7"
BROKEN = "id % 29 = 3"


def _place(t, name: str) -> str:
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _record(p: str) -> Column:
    people = F.array(F.struct(F.lit("Ann X").alias("name")), F.struct(F.concat(F.lit("Bo "), F.col(f"{p}id").cast("string")).alias("name")))
    return F.struct(
        F.concat(F.lit("p"), F.col(f"{p}id").cast("string")).alias("paperId"), F.col(f"{p}title").alias("title"), F.col(f"{p}year").alias("year"), F.struct(F.col(f"{p}doi").alias("DOI")).alias("externalIds"), F.col(f"{p}citation_count").alias("citationCount"), people.alias("authors"), F.array(F.lit("CS")).alias("fieldsOfStudy")
    )


def recorded_references(t) -> str:
    """What a paper service would answer for the references of all papers, page by page, in a folder.

    One paper in 23 is refused and one in 29 answered with a broken body; papers without references get an empty page.
    """
    cited = t.papers.select("id", "title", "year", "doi", "citation_count")
    named = t.citations.join(cited, F.col("target_paper_id") == F.col("id")).select(F.col("source_paper_id").alias("paper"), "target_paper_id", "edge_source", _record("").alias("citedPaper"))
    mine = Window.partitionBy("paper")
    nth = F.row_number().over(mine.orderBy("target_paper_id", "edge_source"))
    pages = named.withColumns({"nth": nth, "all": F.count("*").over(mine)}).withColumn("page", F.expr(f"(nth - 1) div {PAGE}"))
    data = F.transform(F.sort_array(F.collect_list(F.struct("nth", F.struct("citedPaper").alias("item")))), lambda x: x["item"]).alias("data")
    pages = pages.groupBy("paper", "page", "all").agg(data).select(F.col("paper").alias("id"), (F.col("page") * PAGE).alias("offset"), F.when(F.col("all") > (F.col("page") + 1) * PAGE, (F.col("page") + 1) * PAGE).alias("next"), "data")
    asked = t.papers.select("id").join(pages, "id", "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long")))
    body = F.when(F.expr(BROKEN), "{broken").otherwise(F.to_json(F.struct("offset", "next", F.coalesce("data", F.array().cast(pages.schema["data"].dataType)).alias("data"))))
    path = F.concat(F.lit("/paper/"), F.col("id").cast("string"), F.lit("/references?offset="), F.col("offset").cast("string"), F.lit(f"&limit={PAGE}"))
    rows = asked.select(F.col("id").alias("key"), path.alias("path"), F.when(F.expr(FAILS), 429).otherwise(200).alias("status"), body.alias("body"))
    return services.record_answers(rows, _place(t, "recorded"))


GOOD = f"NOT ({FAILS.replace('id', 'source_paper_id')}) AND NOT ({BROKEN.replace('id', 'source_paper_id')})"


@query(
    "src11_service_references",
    "papers citations",
    f"SELECT source_paper_id AS paper_id, concat('p', p.id) AS cited, title, year, doi, citation_count, concat('Ann X, Bo ', p.id) AS authors FROM citations c JOIN papers p ON p.id = c.target_paper_id WHERE {GOOD}",
)
def service_references(t) -> DataFrame:
    """All papers' references, read page by page from a recorded service by ranges of papers."""
    services.register(t.spark)
    got = t.spark.read.format("papers").option("recording", recorded_references(t)).option("limit", PAGE).option("perPartition", 250).load()
    flat = connectors.flat_records(got.select("record.*", F.col("paper_id").alias("source")), "source")
    return flat.select(F.col("source").alias("paper_id"), F.col("paper_id").alias("cited"), "title", "year", "doi", "citation_count", "authors")


@query("src11_service_filter", "papers citations", f"SELECT source_paper_id AS paper_id, count(*) AS n FROM citations c JOIN papers p ON p.id = c.target_paper_id WHERE {GOOD} AND source_paper_id >= 40 AND source_paper_id < 140 GROUP BY 1")
def service_filter(t) -> DataFrame:
    """References of a range of papers: the filter reaches the service's reader, which asks for no other paper."""
    services.register(t.spark)
    got = t.spark.read.format("papers").option("recording", recorded_references(t)).option("limit", PAGE).option("perPartition", 50).load()
    return got.where("paper_id >= 40 AND paper_id < 140").groupBy("paper_id").agg(F.count("*").alias("n"))


@query("src12_service_dois", "papers", "SELECT title, min(trim(doi)) AS doi FROM papers WHERE coalesce(title, '') <> '' AND doi IS NOT NULL AND id % 3 <> 0 GROUP BY 1")
def service_dois(t) -> DataFrame:
    """DOIs of all titles, asked of a recorded registry by ranges of titles; for some nothing is found."""
    services.register(t.spark)
    titles = services.write_titles(t.papers, _place(t, "titles"))
    known = t.papers.where("id % 3 <> 0 AND doi IS NOT NULL AND coalesce(title, '') <> ''").groupBy("title").agg(F.min(F.trim("doi")).alias("DOI"))
    asked = t.papers.select("title").where("trim(title) <> ''").distinct().join(known, "title", "left")
    works = F.when(F.col("DOI").isNotNull(), F.array(F.struct("DOI"), F.struct(F.lit("10.9/other").alias("DOI")))).otherwise(F.array().cast("array<struct<DOI:string>>"))
    rows = asked.select(services.title_key(F.col("title")).alias("key"), F.concat(F.lit("/works?rows=1&query.title="), F.col("title")).alias("path"), F.lit(200).alias("status"), F.to_json(F.struct(F.struct(works.alias("items")).alias("message"))).alias("body"))
    return t.spark.read.format("works").option("titles", titles).option("recording", services.record_answers(rows, _place(t, "registry"))).option("perPartition", 250).load()


# streams ----------------------------------------------------------------------------------------------------------


def _polled(t) -> tuple[CommittedTable, CommittedTable]:
    """The poll loop over a feed of every second paper, run until nothing is due: edges and queue."""
    spark, recording = t.spark, recorded_references(t)
    feed, edges, queue = poll.feed_table(spark, _place(t, "feed")), poll.edge_table(spark, _place(t, "edges"), 8), poll.queue_table(spark, _place(t, "queue"), 8)
    asked = t.papers.where("id % 2 = 0").select(F.col("id").alias("paper_id"), F.col("citation_count").alias("place"))
    poll.ask(feed, asked)
    most = max(5, -(-feed.extra()["rows"] // 3))
    stream = poll.poll_stream(spark, feed, _place(t, "progress"), recording=recording, limit=PAGE, papersPerTrigger=most, now=NOW)
    step = poll.poll_step(edges, queue, feed, lambda: NOW)
    running = stream.writeStream.option("checkpointLocation", _place(t, "poll-state")).foreachBatch(step).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return edges, queue


@query("st7_poll_edges", "papers citations", f"SELECT DISTINCT source_paper_id, target_paper_id, 0.9 AS confidence FROM citations c JOIN papers p ON p.id = c.target_paper_id WHERE {GOOD} AND source_paper_id % 2 = 0 AND source_paper_id <> target_paper_id")
def poll_edges(t) -> DataFrame:
    """The edges that the poll loop has merged."""
    return _polled(t)[0].read()


@query(
    "st8_poll_queue",
    "papers citations",
    f"""WITH named AS (SELECT DISTINCT target_paper_id AS id FROM citations c JOIN papers p ON p.id = c.target_paper_id WHERE {GOOD} AND source_paper_id % 2 = 0 AND source_paper_id <> target_paper_id)
  SELECT id AS paper_id, CASE WHEN {FAILS} OR {BROKEN} THEN 'failed' ELSE 'idle' END AS status, CASE WHEN {FAILS} OR {BROKEN} THEN 1 ELSE 0 END AS attempts, {NOW} + CASE WHEN {FAILS} OR {BROKEN} THEN 1200 ELSE 86400 END AS next_run_at,
    CASE WHEN {FAILS} THEN 'status 429' WHEN {BROKEN} THEN 'no JSON' END AS last_error FROM papers WHERE id % 2 = 0
  UNION ALL SELECT id, 'queued', 0, {NOW} + 600, NULL FROM named WHERE id % 2 = 1""",
)
def poll_queue(t) -> DataFrame:
    """The queue after the poll loop: asked papers settled, papers that they name queued."""
    return _polled(t)[1].read()


@query(
    "st9_due_retries",
    None,
    """WITH r AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS came, event_type <> 'error' AS ok FROM events WHERE user_id IS NOT NULL),
  s AS (SELECT *, count(*) FILTER (ok) OVER w AS run, lead(came) OVER w AS after, max(came) OVER () AS newest FROM r WINDOW w AS (PARTITION BY user_id ORDER BY came, event_id)),
  f AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY came, event_id) AS attempts FROM s WHERE NOT ok),
  d AS (SELECT *, came + 1000 * least(600 * CAST(power(2, least(attempts, 5)) AS BIGINT), 86400) AS due FROM f)
  SELECT user_id AS paper_id, CAST(attempts AS INT) AS attempts, due AS due_ms FROM d WHERE due <= coalesce(after, newest - 1)""",
)
def due_retries(t) -> DataFrame:
    """Retries that fell due in a stream of results: the users' events, errors as failures."""
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    results = stream.select(F.col("user_id").cast("long").alias("paper_id"), F.col("event_id").alias("result_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"))
    out = _place(t, "retries")
    state.run_once(state.due_retries(results, "0 seconds"), f"{out}-state", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    rows = t.spark.read.schema("paper_id long, attempts int, due timestamp").parquet(f"{out}/batch=*")
    return rows.select("paper_id", "attempts", F.unix_millis("due").alias("due_ms"))


@query("st10_session_state", "chat_messages", "SELECT session_id, id, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM chat_messages) WHERE n <= 12")
def session_state(t) -> DataFrame:
    """The last messages of each session, held and read as the state of a stream over the conversations."""
    stream = t.spark.readStream.schema(t.conversations.schema).parquet(f"{t.sf_dir}/conversation[s].parquet")
    messages = stream.selectExpr("CAST(conv_id AS BIGINT) AS session_id", "CAST(conv_id * 1000 + turn AS BIGINT) AS id", "role", "text AS content")
    place = _place(t, "memory-state")
    state.run_once(state.remember(messages), place, mode="update")
    return state.memory(t.spark, place)


# committed tables -------------------------------------------------------------------------------------------------

TASKS = "id long, status string, priority int, updated_at long"


def _task_table(t) -> CommittedTable:
    """Reading tasks through inserts with defaults, a partial update, a deletion and a replacement, a version each."""
    tasks = t.reading_tasks.select("id", "status", "priority")
    table = CommittedTable(t.spark, _place(t, "tasks"), "id", TASKS, 8)
    table.append(tasks.where("id % 5 <> 0").withColumn("updated_at", F.lit(NOW)), "insert")
    fresh = tasks.where("id % 5 = 0").select("id", F.lit("todo").alias("status"), F.lit(3).alias("priority"), F.lit(NOW).alias("updated_at"))
    table.append(fresh, "insert defaults")
    patch = tasks.where("id % 4 = 0").select("id", F.lit("done").alias("status"), F.lit(NOW + 1).alias("updated_at"))
    table.update(lambda stored: entity.merge_by_key(stored, patch, ["id"], ["status", "updated_at"]), patch, "partial update")
    table.delete(tasks.where("id % 9 = 0").select("id"))
    again = tasks.where("id % 7 = 0 AND id % 9 <> 0").select("id", F.lit("again").alias("status"), "priority", F.lit(NOW + 2).alias("updated_at"))
    table.update(lambda stored: entity.replace_snapshot(stored, again, ["id"]), again, "replace")
    return table


@query(
    "snk11_committed_tasks",
    "reading_tasks",
    f"""SELECT id, CASE WHEN id % 7 = 0 THEN 'again' WHEN id % 4 = 0 THEN 'done' WHEN id % 5 = 0 THEN 'todo' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN priority WHEN id % 5 = 0 THEN 3 ELSE priority END AS priority,
  CASE WHEN id % 7 = 0 THEN {NOW + 2} WHEN id % 4 = 0 THEN {NOW + 1} ELSE {NOW} END AS updated_at FROM reading_tasks WHERE id % 9 <> 0""",
)
def committed_tasks(t) -> DataFrame:
    """The newest version of a table that five writes have made."""
    return _task_table(t).read()


@query("snk12_older_version", "reading_tasks", f"SELECT id, CASE WHEN id % 5 = 0 THEN 'todo' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 3 ELSE priority END AS priority, {NOW} AS updated_at FROM reading_tasks")
def older_version(t) -> DataFrame:
    """An older version of the same table, as it was before the update."""
    return _task_table(t).read(2)


@query("src13_committed_put", "papers", "SELECT concat('k', id) AS key, CASE WHEN id % 4 = 0 THEN 8 ELSE 7 END AS version, CASE WHEN id % 4 = 0 THEN 'new' ELSE title END AS title FROM papers")
def committed_put(t) -> DataFrame:
    """Changes of a library's items under a lock on their versions; changes read at another version leave no trace."""
    key = F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")
    table = CommittedTable(t.spark, _place(t, "library"), "key", "key string, version long, data struct<title: string>", 8)
    table.append(t.papers.select(key, F.lit(7).cast("long").alias("version"), F.struct("title").alias("data")))
    changes = t.papers.where("id % 2 = 0").select(key, F.expr("CAST(CASE WHEN id % 4 = 0 THEN 7 ELSE 6 END AS BIGINT)").alias("version"), F.struct(F.lit("new").alias("title")).alias("data"))
    table.update(lambda items: connectors.library_put(items, changes)[0], changes, "put")
    return table.read().select("key", "version", F.col("data.title").alias("title"))


# indexes ----------------------------------------------------------------------------------------------------------


@query("r19_index_search", None, f"WITH {_bm25_sql(ASKED)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def index_search(t) -> DataFrame:
    """The best documents by BM25 from a persistent index that was built in two additions, of which one is made again."""
    index = InvertedIndex(t.spark, _place(t, "index"), 16)
    index.add(t.documents.where("doc_id % 3 <> 0"))
    index.add(t.documents.where("doc_id % 3 = 0").withColumn("text", F.lit("stale the the tion")))
    index.add(t.documents.where("doc_id % 3 = 0"))
    return index.search(ASKED, 20).withColumnRenamed("id", "doc_id")


@query(
    "src16_collection_search",
    None,
    "SELECT a.vec_id, round(greatest(0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 9 ORDER BY greatest(0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) DESC, a.vec_id LIMIT 20",
)
def collection_search(t) -> DataFrame:
    """The nearest vectors from a collection in cells, read cell by cell as far as it takes."""
    collection = VectorCollection.write(t.embeddings)
    return collection.search(_query_vector(t, 9), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "snk13_event_sequences",
    "chat_messages",
    "SELECT id AS session_id, CAST(3 + ceil(length(coalesce(content, '')) / 40.0) AS BIGINT) AS events, md5(coalesce(content, '')) AS answer, 'meta' AS first, 'done' AS last FROM chat_messages WHERE role = 'assistant'",
)
def event_sequences(t) -> DataFrame:
    """Answers as sequences of events, written in two jobs and read back: how many, the answer that they make, and their ends."""
    asked = t.chat_messages.withColumn("query", F.lag("content").over(Window.partitionBy("session_id").orderBy("id"))).where("role = 'assistant'")
    rows = events.chat_events(asked.select(F.col("id").alias("session_id"), "query", F.col("content").alias("answer"), F.array(F.col("session_id").cast("long")).alias("sources")))
    place = _place(t, "events")
    for half in (0, 1):
        place = events.write_events(rows.where(F.col("session_id") % 2 == half), place)
    got = events.read_events(t.spark, place).withColumn("delta", F.coalesce(F.get_json_object("event", "$.delta"), F.lit("")))
    ordered = F.sort_array(F.collect_list(F.struct("nth", "type", "delta")))  # the events of one answer
    return got.groupBy("session_id").agg(F.count("*").alias("events"), F.md5(F.array_join(F.transform(ordered, lambda x: x["delta"]), "")).alias("answer"), F.min_by("type", "nth").alias("first"), F.max_by("type", "nth").alias("last"))


# a model's answers ------------------------------------------------------------------------------------------------


def scripted_model(prompts: list[str]) -> list[str]:
    """A model that answers by the length of the text that it is asked about: well, badly, only when pressed, or not at all."""
    out = []
    for prompt in prompts:
        n, pressed = len(prompt.split("TEXT:\n", 1)[1]), "nothing else" in prompt
        good = f'{{"title": " T{n} ", "year": {1900 + n % 100}, "sub_field": "src1", "open_sub_field": "SRC1"}}'
        if n % 5 == 0:
            raise TimeoutError
        out.append({1: good if pressed else "I cannot say", 2: f"Here it is: {good} - well?", 3: '{"title": null}', 4: good if pressed else '{"title": "first", "year": "about 2000"}'}[n % 5])
    return out


@query(
    "x30_enriched_metadata",
    "papers",
    """WITH p AS (SELECT id, length(abstract) AS n FROM papers)
  SELECT id, CASE WHEN coalesce(n, 0) > 0 AND n % 5 NOT IN (0, 3) THEN concat('T', n) END AS title, CASE WHEN coalesce(n, 0) > 0 AND n % 5 NOT IN (0, 3) THEN 1900 + n % 100 END AS year, CASE WHEN coalesce(n, 0) > 0 AND n % 5 NOT IN (0, 3) THEN 'SRC1' END AS sub_field,
    CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n % 5 IN (0, 3) THEN 3 WHEN n % 5 = 2 THEN 1 ELSE 2 END AS tries, coalesce(n, 0) > 0 AND n % 5 NOT IN (0, 3) AS valid FROM p""",
)
def enriched_metadata(t) -> DataFrame:
    """Metadata of whole papers from a model that often fails: batches are taken apart, bad answers asked for again."""
    rows = enrichment.enrich_metadata(t.papers.select("id", F.col("abstract").alias("text")), scripted_model, ["SRC1"])
    return rows.where("open_sub_field IS NULL").select("id", "title", "year", "sub_field", "tries", "valid")


def summarising_model(prompts: list[str]) -> list[str]:
    if any(len(p) % 11 == 0 for p in prompts):
        raise TimeoutError
    return [("null", " ", '"Says {}."')[len(p) % 3].format(len(p.rsplit("ABSTRACT: ", 1)[1])) for p in prompts]


@query(
    "src14_summaries",
    "papers",
    """WITH p AS (SELECT *, length('Say in one sentence what this paper does; if it is not to be seen, answer null.' || chr(10) || 'TITLE: ' || coalesce(title, '') || chr(10) || 'ABSTRACT: ' || coalesce(abstract, '')) AS n FROM papers)
  SELECT id, CASE WHEN (coalesce(title, '') <> '' OR coalesce(abstract, '') <> '') AND n % 11 <> 0 AND n % 3 = 2 THEN concat('Says ', length(coalesce(abstract, '')), '.') END AS summary FROM p""",
)
def model_summaries(t) -> DataFrame:
    """One sentence about each paper from a model that fails on some prompts, and so on every batch that has one."""
    return enrichment.summaries(t.papers.select("id", "title", "abstract"), summarising_model)


@query(
    "x29_half_even",
    None,
    """WITH q AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q FROM lineitem)
  SELECT l_orderkey, l_linenumber, CAST(format('{:.2f}', q / 8) AS DOUBLE) AS eighths, CAST(format('{:.3f}', (2 * q + 1) / 2000) AS DOUBLE) AS halves, CAST(format('{:.4f}', -q / l_linenumber) AS DOUBLE) AS parts FROM q""",
)
def half_even(t) -> DataFrame:
    """Rounding by the binary value, on numbers of which many lie on or beside a half."""
    q = F.col("l_quantity").cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", S.round_half_even(q / 8, 2).alias("eighths"), S.round_half_even((2 * q + 1) / 2000, 3).alias("halves"), S.round_half_even(-q / F.col("l_linenumber"), 4).alias("parts"))
