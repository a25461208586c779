"""The scholarly domain tables, derived deterministically from the driver's tables.

Each table is a list of SQL expressions that Spark and DuckDB read alike, so a query's Spark plan and its oracle start from
the same rows. ``Tables`` gives the DataFrames, ``with_tables`` the common table expressions of an oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Year that stands for "now" wherever the age of a paper counts; operators take it as an argument.
AS_OF = 2022
#: Edges that each document sends out.
FAN_OUT = 5

PAPERS = {
    "id": "doc_id",
    "title": "substr(split_part(text, chr(10), 1), 1, 120)",
    "authors": "concat('Ann ', chr(CAST(65 + doc_id % 26 AS INT)), 'x, Bo ', chr(CAST(65 + doc_id % 7 AS INT)), 'y')",
    "abstract": "text",
    "sub_field": "CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN NULL ELSE source END",
    "year": "CASE WHEN doc_id % 17 <> 0 THEN CAST(2000 + (doc_id * doc_id + n_chars) % 23 AS INT) END",
    "citation_count": "CAST(n_chars % 500 AS BIGINT)",
    "citation_velocity": "CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars % 97 AS DOUBLE) / 4 END",
    "file_path": "CASE WHEN doc_id % 3 = 0 THEN concat('f', CAST(doc_id AS STRING)) WHEN doc_id % 3 = 1 THEN '' END",
    "file_hash": "CASE WHEN doc_id % 3 = 0 THEN md5(text) END",
    "read_status": "CAST(doc_id % 2 AS INT)",
    "doi": "CASE WHEN doc_id % 4 = 0 THEN concat('10.1000/', CAST(doc_id % 300 AS STRING)) WHEN doc_id % 4 = 1 THEN concat(' 10.1000/X', CAST(doc_id % 250 AS STRING)) END",
    "s2_paper_id": "CASE WHEN doc_id % 5 = 2 THEN concat('s', CAST(doc_id % 400 AS STRING)) WHEN doc_id % 5 = 3 THEN '' END",
    "keywords": "CASE WHEN doc_id % 6 = 0 THEN concat('key', CAST(doc_id % 9 AS STRING), ',common') ELSE '' END",
    "dynamic_tags": "CASE doc_id % 5 WHEN 0 THEN concat('[\"Alpha ', CAST(doc_id % 8 AS STRING), '\", \"Beta tag\", \"beta tag\"]') WHEN 1 THEN concat('gamma ', CAST(doc_id % 6 AS STRING), ', Delta set') WHEN 2 THEN '' END",
    "venue": "CASE doc_id % 6 WHEN 0 THEN 'Annual Meeting of the Association for Computational Linguistics' WHEN 1 THEN 'Journal of Machine Learning Research' WHEN 2 THEN '' WHEN 3 THEN 'Proc. ACL 2020' WHEN 4 THEN 'Workshop on Small Things' END",
    "ccf_level": "CASE doc_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END",
    "source_type": "CASE WHEN doc_id % 9 = 0 THEN 'CNKI' ELSE 'Global' END",
    "lang": "lang",
    "summary_one": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'done' END",
    "refs_parsed_at": "CASE WHEN doc_id % 5 > 1 THEN CAST(1700000000 + doc_id AS BIGINT) END",
    "created_at": "CAST(1700000000 + doc_id * 3600 AS BIGINT)",
    "updated_at": "CAST(1700000000 + (doc_id * 7919) % 5000000 AS BIGINT)",
}
TARGET = "(doc_id * (2 * k + 3) + 7 * k + 1) % n"
CITATIONS = {
    "source_paper_id": "doc_id",
    "target_paper_id": f"CASE WHEN doc_id % 97 = 0 AND k = 4 THEN -1 - doc_id WHEN doc_id % 89 = 0 AND k = 3 THEN doc_id ELSE {TARGET} END",
    "confidence": "CASE WHEN (doc_id + k) % 10 = 9 THEN NULL ELSE CAST((doc_id + k) % 10 AS DOUBLE) / 10.0 END",
    "edge_source": "CASE k WHEN 0 THEN 'semantic_scholar' WHEN 1 THEN 'crossref' WHEN 2 THEN 'llm_reference' ELSE 'manual' END",
    "intent": "CASE (doc_id + k) % 4 WHEN 0 THEN 'mention' WHEN 1 THEN '' WHEN 2 THEN 'contrast' END",
    "intent_confidence": "CASE WHEN (doc_id + k) % 4 <> 3 THEN 0.4 END",
    "context_snippet": "CASE k WHEN 0 THEN 'we build on this baseline' WHEN 1 THEN 'however, a limitation remains' WHEN 2 THEN 'we use their data' WHEN 3 THEN '' END",
    "last_verified_at": "CAST(1700000000 + (doc_id * 31 + k * 17) % 100000 AS BIGINT)",
}
#: name: (source table, expressions, condition)
SIMPLE = {
    "papers": ("documents", PAPERS, "true"),
    "paper_notes": (
        "documents",
        {
            "paper_id": "doc_id",
            "method": "CASE WHEN doc_id % 8 = 0 THEN 'graph model' ELSE '' END",
            "datasets": "CASE WHEN doc_id % 8 = 2 THEN 'ACE 2005' END",
            "conclusions": "CASE WHEN doc_id % 8 = 4 THEN 'works well' END",
            "notes": "CASE WHEN doc_id % 4 = 0 THEN concat('see [[', CAST(doc_id % 50 AS STRING), ']] and [[Other Paper]] [[other paper]] [[]]') END",
            "updated_at": "CAST(1700000000 + doc_id * 60 AS BIGINT)",
        },
        "doc_id % 2 = 0",
    ),
    "ee_metrics": (
        "lineitem",
        {
            "id": "l_orderkey * 10 + l_linenumber",
            "paper_id": "l_partkey",
            "dataset_name": "concat('DS', CAST(l_suppkey % 12 AS STRING))",
            "precision_": "CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS DOUBLE) * 2 END",
            "recall_": "CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS DOUBLE) * 1.5 END",
            "f1": "CASE WHEN l_linenumber < 5 THEN CAST(l_quantity AS DOUBLE) * 1.75 END",
            "trigger_f1": "CASE WHEN l_linenumber > 2 THEN CAST(l_quantity AS DOUBLE) * 1.25 END",
            "argument_f1": "CASE WHEN l_linenumber = 5 THEN CAST(l_quantity AS DOUBLE) END",
            "source": "CASE WHEN l_returnflag = 'A' THEN 'table' ELSE 'regex' END",
            "confidence": "CAST(l_discount AS DOUBLE) * 10",
            "table_id": "concat('t', CAST(l_linenumber AS STRING))",
        },
        "true",
    ),
    "reading_tasks": (
        "orders",
        {
            "id": "o_orderkey",
            "paper_id": "o_custkey",
            "title": "concat('Read ', CAST(o_custkey AS STRING))",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'todo' ELSE 'doing' END",
            "priority": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
            "due_date": "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END",
            "next_review_at": "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(1700000000 + o_orderkey AS BIGINT) END",
            "interval_days": "CAST(o_orderkey % 70 AS INT)",
        },
        "true",
    ),
    "experiments": (
        "lineitem",
        {"id": "l_orderkey * 10 + l_linenumber", "paper_id": "l_partkey", "name": "CASE WHEN l_linenumber % 3 = 0 THEN concat('AUTO_METRIC:DS', CAST(l_suppkey % 12 AS STRING), ':F1') ELSE 'manual run' END", "metric_value": "CAST(l_quantity AS DOUBLE)"},
        "true",
    ),
    "sync_queue": (
        "customer",
        {
            "paper_id": "c_custkey",
            "status": "CASE c_custkey % 4 WHEN 0 THEN 'idle' WHEN 1 THEN 'queued' WHEN 2 THEN 'failed' ELSE 'running' END",
            "attempts": "CAST(c_custkey % 9 AS INT)",
            "next_run_at": "CASE WHEN c_custkey % 6 <> 0 THEN CAST(1700000000 + (c_custkey * 37) % 5000 AS BIGINT) END",
            "last_error": "CASE WHEN c_custkey % 4 = 2 THEN 'timeout' END",
        },
        "true",
    ),
    "job_runs": (
        "events",
        {
            "id": "event_id",
            "job_type": "event_type",
            "status": "CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 5 = 0 THEN 'running' ELSE 'success' END",
            "attempts": "CAST(event_id % 3 AS INT)",
            "payload": "props",
            "user_id": "user_id",
            "created_at": "CAST(1700000000 + event_id * 30 AS BIGINT)",
        },
        "true",
    ),
    "chat_messages": (
        "conversations",
        {"id": "conv_id * 1000 + turn", "session_id": "conv_id", "role": "role", "content": "text", "created_at": "CAST(1700000000 + conv_id * 100 + turn AS BIGINT)"},
        "true",
    ),
    "idea_capsules": (
        "customer",
        {
            "id": "c_custkey",
            "title": "c_name",
            "status": "CASE c_custkey % 5 WHEN 0 THEN 'seed' WHEN 1 THEN 'incubating' WHEN 2 THEN '' WHEN 3 THEN 'validated' END",
            "priority": "CAST(c_custkey % 4 AS INT)",
            "linked_a": "c_custkey % 30",
            "linked_b": "c_nationkey",
        },
        "true",
    ),
    "concept_links": ("events", {"paper_id": "user_id", "concept_id": "event_id % 40", "concept_type": "event_type", "confidence": "value"}, "true"),
}


class Tables:
    """The domain tables over one directory of driver tables, each read once when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SIMPLE:
            return self.raw(name)
        source, columns, condition = SIMPLE[name]
        return self.raw(source).where(condition).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])

    @cached_property
    def citations(self) -> DataFrame:
        docs = self.raw("documents").select("doc_id")
        rows = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(FAN_OUT - 1))).alias("k"), F.lit(docs.count()).alias("n"))
        return rows.selectExpr(*[f"{e} AS {c}" for c, e in CITATIONS.items()])


def with_tables(names: str, body: str) -> str:
    """An oracle: ``body`` after the common table expressions of the named tables."""
    ctes = []
    for name in names.split():
        if name == "citations":
            columns = ", ".join(f"{e} AS {c}" for c, e in CITATIONS.items())
            ctes.append(f"citations AS (SELECT {columns} FROM documents, (SELECT unnest(range({FAN_OUT})) AS k), (SELECT count(*) AS n FROM documents))")
        else:
            source, columns, condition = SIMPLE[name]
            ctes.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition})")
    head = ", ".join(ctes)
    body = body.strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
