"""Connectors, exports and streams."""

import json

from pyspark.sql import functions as F

from scholarspark.sources import connectors, sinks
from scholarspark.sources.committed import CommittedTable
from scholarspark.streaming import jobs

from .conftest import DATA


def test_landed_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"paperId": "p", "authors": [{"name": "N"}, {"name": None}], "fieldsOfStudy": ["b", "a", "b"]}) + "\nnot json\n[]\n")
    (row,) = connectors.landed_records(spark, str(tmp_path)).collect()
    assert (row.paper_id, row.authors, row.fields, row.doi) == ("p", "N", "a, b", None)


def test_titles_and_library(spark):
    works = spark.createDataFrame([("T", ([("10.1/a", ["T"]), ("10.1/b", ["U"])],)), ("U", ([],)), ("", ([("10.1/c", ["x"])],)), ("V", None)], connectors.WORKS)
    assert connectors.title_dois(works).collect() == [("T", "10.1/a")]
    items = spark.createDataFrame([("k1", 4, ("old",)), ("k2", 9, ("kept",))], "key string, version long, data struct<title: string>")
    changes = spark.createDataFrame([("k1", 4, ("a",)), ("k1", 4, ("b",)), ("k2", 8, ("late",)), ("k3", 1, ("none",))], "key string, version long, data struct<title: string>")
    out, done = connectors.library_put(items, changes)
    assert {(r.key, r.version, r.data.title) for r in out.collect()} == {("k1", 5, "a"), ("k2", 9, "kept")}
    assert sorted((r.key, r.done) for r in done.collect()) == [("k1", False), ("k1", True), ("k2", False), ("k3", False)]


def test_parsed_tables(spark):
    rows = spark.createDataFrame([(1, "gmft", "g", None, [["a ", None], [" "], None]), (2, "gmft", "g", 1, [[""]])], connectors.TABLE)
    got = connectors.parsed_tables(rows, rows.where("paper_id = 1").withColumn("parser", F.lit("other"))).collect()
    assert [(r.paper_id, r.parser, r.rows) for r in got] == [(1, "gmft", [["a", ""]]), (1, "other", [["a", ""]])]


def test_venue_ranks_and_binary_text(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"A": ["ACL"], "C": []}')
    assert connectors.venue_ranks(spark, str(tmp_path / "r.json")).collect() == [("A", "ACL")]
    (tmp_path / "t.txt").write_text("é")
    (row,) = connectors.binary_text(spark, str(tmp_path)).collect()
    assert row.text == "é" and len(row.sha256) == 64


def test_completions(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert [r.answer for r in connectors.completions(df).collect()] == [None, None]
    assert [r.answer for r in connectors.completions(df, lambda ps: [p.upper() for p in ps]).collect()] == ["A", "B"]

    def broken(_):
        raise RuntimeError

    assert [r.answer for r in connectors.completions(df, broken).collect()] == [None, None]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", title'), (2, None)], "id long, title string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert {r.title for r in back.collect()} == {'a "quoted", title', None} or {r.title for r in back.collect()} == {'a "quoted", title', ""}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(folder)
    stream = jobs.event_stream(spark, folder, 10)
    got = jobs.run_available(jobs.tumbling(stream).select("start", "event_type", "n"), "tumbling_test", "complete")
    want = jobs.tumbling(events).select("start", "event_type", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    again = events.union(events)
    again.write.parquet(str(tmp_path / "twice"))
    assert jobs.run_available(jobs.deduplicated(jobs.event_stream(spark, str(tmp_path / "twice"), 10)), "dedup_test").count() == events.count()


def test_merge_edges_stream(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    schema = "source_paper_id long, target_paper_id long, confidence double"
    for k, rows in enumerate(([(1, 2, 0.3), (1, 3, None)], [(1, 2, 0.8), (4, 5, 0.1)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
    merge = jobs.merge_edges_into(out)
    for k in range(2):
        merge(spark.read.parquet(str(folder / f"b{k}")), k)
    merge(spark.read.parquet(str(folder / "b1")), 1)  # a batch run again counts once
    got = {(r.source_paper_id, r.target_paper_id): r.confidence for r in jobs.latest(spark, out).collect()}
    assert got == {(1, 2): 0.8, (1, 3): None, (4, 5): 0.1} and jobs.latest(spark, out).count() == 3
    # only the buckets that the second batch touches are written again
    assert len(list((tmp_path / "out" / "batch=1").glob("bucket=*"))) == 2


def test_session_memory(spark, tmp_path):
    schema = "session_id long, id long, role string, content string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        rows = [(s, 10 * k + i, "user", f"m{k}{i}") for s in (1, 2) for i in range(3)] + ([(1, 0, "user", "m00")] if k else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        jobs.start(spark.readStream.schema(schema).parquet(folder), jobs.remember_into(out, 2), str(tmp_path / "ck"), once=True).awaitTermination()
    got = sorted((r.session_id, r.id) for r in jobs.latest(spark, out).collect())
    assert got == [(s, i) for s in (1, 2) for i in (12, 20, 21, 22)]


def test_sync_loop(spark, tmp_path):
    """Rounds of the loop on a ticking stream: due papers are handled and settled, their new neighbours asked for later."""
    queue = "paper_id long, status string, attempts int, next_run_at long, last_error string"
    table = CommittedTable(spark, str(tmp_path / "queue"), "paper_id", queue, 8)
    table.append(spark.createDataFrame([(1, "queued", 0, None, None), (2, "queued", 0, 5, None), (3, "idle", 0, 10_000, None), (4, "running", 2, 9_000, None)], queue))

    def handle(due):
        results = due.select("paper_id", F.when(F.col("paper_id") == 2, "broken").alias("error"))
        return results, due.where("paper_id = 1").select(F.col("paper_id").alias("source_paper_id"), (F.col("paper_id") + 10).alias("target_paper_id"))

    step = jobs.sync_into(table, lambda: 1000, handle)
    step(spark.range(1), 0)
    step(spark.range(1), 0)  # a round counts once
    got = {r.paper_id: (r.status, r.attempts, r.next_run_at) for r in table.read().collect()}
    assert got == {1: ("idle", 0, 1000 + 86400), 2: ("failed", 1, 1000 + 1200), 3: ("idle", 0, 10_000), 4: ("running", 2, 9_000), 11: ("queued", 0, 1600)}
    assert len(table.history()[-1]["touched"]) <= 3  # papers 1, 2 and 11
    # rows that have been running past their lease are queued again, in the same round
    jobs.sync_into(table, lambda: 13_000, handle)(spark.range(1), 1)
    assert {r.paper_id: r.status for r in table.read().collect()}[4] == "idle"


def test_numbered_rows(spark):
    from scholarspark.operators.lineage import number_rows

    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("id")).union(spark.createDataFrame([(None,)], "id long"))
    got = [r.id for r in number_rows(df, ["id"]).orderBy("n").collect()]
    assert got == [None, *range(1000)]
