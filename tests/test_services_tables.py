"""Service sources, the poll loop, stateful streams, committed tables and the event sink: failures, restarts and races."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from scholarspark.operators import entity
from scholarspark.sources import committed, events, services
from scholarspark.sources.committed import CommittedTable, Conflict
from scholarspark.streaming import jobs, poll, state

# services ---------------------------------------------------------------------------------------------------------


def page(paper, offset, limit, items, after=None, kind="references"):
    body = {"offset": offset, "data": [{services.INSIDE[kind]: i} for i in items]}
    return paper, f"/paper/{paper}/{kind}?offset={offset}&limit={limit}", 200, json.dumps(body | ({"next": after} if after is not None else {}))


def recording(spark, path, rows):
    return services.record_answers(spark.createDataFrame(rows, "key long, path string, status int, body string"), str(path))


ANSWERS = [
    page(1, 0, 2, [{"paperId": "p5", "year": 2001}, {"paperId": "p6", "year": "bad"}], 2),
    page(1, 2, 2, [{"paperId": "p7", "externalIds": {"DOI": "10.1/x"}, "authors": [{"name": "A"}, "odd"], "fieldsOfStudy": ["CS", 3]}]),
    page(2, 0, 2, [{"paperId": "p5"}], 2),
    (2, "/paper/2/references?offset=2&limit=2", 503, ""),
    (3, "/paper/3/references?offset=0&limit=2", 200, "{broken"),
    (4, "/paper/4/references?offset=0&limit=2", 200, "[1]"),
    page(5, 0, 2, []),
    page(6, 0, 2, [{"paperId": "p1"}, None, "odd"], 0),
    page(9, 0, 2, [{"paperId": "p1"}, None, "odd"]),
    (9, "/paper/9", 200, '{"paperId": "p9", "title": "T"}'),
    page(9, 0, 2, [{"paperId": "p2"}], None, "citations"),
]


def test_papers_source(spark, tmp_path):
    services.register(spark)
    folder = recording(spark, tmp_path / "r", ANSWERS)
    read = lambda **o: spark.read.format("papers").options(recording=folder, limit=2, perPartition=2, **o).load()
    # a paper of which any page fails, or whose pages do not advance, gives nothing
    got = sorted((r.paper_id, r.nth, r.record.paperId) for r in read().collect())
    assert got == [(1, 1, "p5"), (1, 2, "p6"), (1, 3, "p7"), (9, 1, "p1")]
    one = read().where("paper_id = 1 AND nth = 3").first().record
    assert (one.externalIds.DOI, [a.name for a in one.authors], one.fieldsOfStudy, one.year) == ("10.1/x", ["A"], ["CS"], None)
    assert read().where("nth = 2").first().record.year is None
    assert [(r.paper_id, r.record.title) for r in read(kind="record").collect()] == [(9, "T")]
    assert [(r.paper_id, r.record.paperId) for r in read(kind="citations").collect()] == [(9, "p2")]
    assert read(first=2, last=8).count() == 0
    assert read().rdd.getNumPartitions() == 5


def test_filters_reach_the_service(spark, tmp_path):
    services.register(spark)
    folder = recording(spark, tmp_path / "r", [page(k, 0, 100, [{"paperId": f"p{k}"}]) for k in range(100)])
    df = spark.read.format("papers").options(recording=folder, perPartition=10).load()
    assert df.rdd.getNumPartitions() == 10
    for condition, parts, rows in (("paper_id BETWEEN 20 AND 39", 2, 20), ("paper_id IN (3, 5, 999)", 1, 2), ("paper_id = 7 AND nth = 1", 1, 1), ("paper_id > 97 AND paper_id < 5", 1, 0), ("nth = 2", 10, 0)):
        found = df.where(condition)
        assert (found.rdd.getNumPartitions(), found.count()) == (parts, rows)


def test_empty_recordings(spark, tmp_path):
    services.register(spark)
    folder = recording(spark, tmp_path / "r", [])
    assert spark.read.format("papers").options(recording=folder).load().count() == 0
    titles = services.write_titles(spark.createDataFrame([(None,), (" ",)], "title string"), str(tmp_path / "t"))
    assert spark.read.format("works").options(recording=folder, titles=titles).load().count() == 0


def test_works_source(spark, tmp_path):
    services.register(spark)
    bodies = {"A": '{"message": {"items": [{"DOI": "10.1/a"}, {"DOI": "10.1/b"}]}}', "B": '{"message": {"items": []}}', "C": '{"message": 3}', "D": "x", "E": '{"message": {"items": [{}]}}', "a b?&é": '{"message": {"items": [{"DOI": "10.1/é"}]}}'}
    df = spark.createDataFrame([(t,) for t in [*bodies, *bodies, "unknown", None, ""]], "title string")
    titles = services.write_titles(df, str(tmp_path / "t"))
    rows = spark.createDataFrame(list(bodies.items()), "title string, body string").select(services.title_key(F.col("title")).alias("key"), F.concat(F.lit("/works?rows=1&query.title="), "title").alias("path"), F.lit(200).alias("status"), "body")
    folder = services.record_answers(rows, str(tmp_path / "r"))
    got = spark.read.format("works").options(recording=folder, titles=titles, perPartition=2).load()
    assert sorted(map(tuple, got.collect())) == [("A", "10.1/a"), ("a b?&é", "10.1/é")]


# the poll loop ----------------------------------------------------------------------------------------------------


def loop(spark, root, feed, step, **options):
    stream = poll.poll_stream(spark, feed, str(root / "progress"), **options)
    running = stream.writeStream.option("checkpointLocation", str(root / "state")).foreachBatch(step).start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def poll_world(spark, root):
    answers = [page(k, 0, 100, [{"paperId": f"s{k + 100}"}, {"paperId": f"s{k + 1}"}, {"paperId": f"s{k}"}]) for k in range(1, 13)]
    answers[3] = (4, "/paper/4/references?offset=0&limit=100", 500, "")
    return recording(spark, root / "r", answers), poll.feed_table(spark, str(root / "feed")), poll.edge_table(spark, str(root / "edges"), 4), poll.queue_table(spark, str(root / "queue"), 4)


def test_a_trigger_is_dealt_by_ranges_of_papers(spark, tmp_path):
    """A trigger of many papers makes tasks of ranges of papers, not one a paper, and asks for each paper once."""
    folder, feed, *_ = poll_world(spark, tmp_path)
    poll.ask(feed, spark.createDataFrame([(k, -k) for k in range(1, 13)], "paper_id long, place int"))
    options = {"feed": feed.path, "progress": f"file://{tmp_path}/progress", "recording": folder, "perpartition": "5"}
    reader = services.PollReader(options, _parse_datatype_string(services.POLL_ROWS))
    parts = reader.partitions({"taken": 0}, {"taken": 11})
    assert [[p for p, _ in part.entries] for part in parts] == [[2, 3, 4], [5, 6, 7, 8, 9], [10, 11, 12]]
    rows = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted({(r["seq"], r["paper_id"]) for r in rows}) == [(13 - k, k) for k in range(12, 1, -1)]
    assert [(r["nth"], r["error"]) for r in rows if r["paper_id"] == 4] == [(None, "status 500")] and len(rows) == 10 * 3 + 1


def test_poll_loop_resumes_after_a_kill(spark, tmp_path):
    folder, feed, edges, queue = poll_world(spark, tmp_path)
    poll.ask(feed, spark.createDataFrame([(k, 0) for k in range(12, 0, -1)] + [(3, 5), (None, 1)], "paper_id long, place int"))
    step, taken = poll.poll_step(edges, queue, None, lambda: 1000), []

    def killed(batch, number):
        taken.append((number, sorted({r.paper_id for r in batch.collect()})))
        if number == 1 and len(taken) == 2:
            step(batch, number)  # the tables are written, the stream does not get to know
            raise RuntimeError("killed")
        step(batch, number)

    with pytest.raises(Exception, match="killed"):
        loop(spark, tmp_path, feed, killed, recording=folder)
    assert taken == [(0, [1, 2, 3, 4, 5]), (1, [6, 7, 8, 9, 10])]
    loop(spark, tmp_path, feed, killed, recording=folder)
    assert taken[2:] == [(1, [6, 7, 8, 9, 10]), (2, [11, 12])]
    # nothing twice, nothing lost
    got = sorted((r.source_paper_id, r.target_paper_id, r.confidence) for r in edges.read().collect())
    assert got == sorted((k, t, 0.9) for k in range(1, 13) if k != 4 for t in (k + 100, k + 1))
    rows = {r.paper_id: (r.status, r.attempts, r.next_run_at, r.last_error) for r in queue.read().collect()}
    assert rows[4] == ("failed", 1, 1000 + 1200, "status 500") and rows[5] == ("idle", 0, 1000 + 86400, None) and rows[112] == ("queued", 0, 1600, None)
    assert len(rows) == 12 + 12
    # one version a batch
    assert [h["operation"] for h in edges.history()] == ["poll"] * 3
    # a restart between two triggers takes up what came meanwhile
    poll.ask(feed, spark.createDataFrame([(4, 0)], "paper_id long, place int"))
    loop(spark, tmp_path, feed, killed, recording=folder)
    assert taken[4:] == [(3, [4])] and {r.paper_id: r.attempts for r in queue.read().collect()}[4] == 2


def test_feed_waits_for_its_time(spark, tmp_path):
    folder, feed, edges, queue = poll_world(spark, tmp_path)
    poll.ask(feed, spark.createDataFrame([(1, 0)], "paper_id long, place int"))
    poll.ask(feed, spark.createDataFrame([(1, 0)], "paper_id long, place int"), step=("x", 0))
    poll.ask(feed, spark.createDataFrame([(1, 0)], "paper_id long, place int"), step=("x", 0))  # once a step
    assert feed.extra()["rows"] == 2
    step = poll.poll_step(edges, queue, feed, lambda: 1000)
    loop(spark, tmp_path, feed, step, recording=folder, now=1599)
    assert {r.paper_id: r.status for r in queue.read().collect()} == {1: "idle", 2: "queued", 101: "queued"}
    step = poll.poll_step(edges, queue, feed, lambda: 1600)
    loop(spark, tmp_path, feed, step, recording=folder, now=1600)  # those that paper 1 names are due
    assert {r.paper_id: r.status for r in queue.read().collect()} == {1: "idle", 2: "idle", 101: "failed", 3: "queued", 102: "queued"}


# state and timers -------------------------------------------------------------------------------------------------

RESULT = "paper_id long, result_id long, at timestamp, ok boolean"


def seconds(s):
    from datetime import UTC, datetime

    return datetime.fromtimestamp(s, UTC).replace(tzinfo=None)


def run_retries(spark, root, batches):
    out = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame([(p, i, None if s is None else seconds(s), ok) for p, i, s, ok in rows], RESULT).coalesce(1).write.mode("append").parquet(str(root / "in"))
        stream = spark.readStream.schema(RESULT).parquet(str(root / "in"))
        got = []
        state.run_once(state.due_retries(stream, "0 seconds"), str(root / "state"), lambda b, n, g=got: g.extend((r.paper_id, r.attempts, int(r.ms / 1000)) for r in b.withColumn("ms", F.unix_millis("due")).collect()))
        out[k] = sorted(got)
    return out


def test_retries_fall_due(spark, tmp_path):
    got = run_retries(
        spark,
        tmp_path,
        [
            [(1, 1, 100, False), (2, 2, 100, False), (None, 3, 100, False), (3, 4, None, False), (9, 5, 200, True)],
            [(9, 6, 1299, True)],  # the stream's time is not past 100 + 1200
            [(9, 7, 1302, True)],  # now both are due, by their timers
            [(1, 8, 1400, False), (2, 9, 1400, True), (9, 10, 1500, True)],
            [(1, 11, 1450, False), (1, 12, 1450, None), (9, 13, 3000, True)],  # older than the stream's time: left out
            [(9, 14, 4000, True)],  # 1400 + 2400
            [(4, 15, 5000, False), (4, 16, 5000 + 1200, False), (4, 17, 20_000, True)],  # within one batch
        ],
    )
    assert got[0] == got[1] == [] and got[2] == [(1, 1, 1300), (2, 1, 1300)]
    assert got[3] == got[4] == [] and got[5] == [(1, 2, 3800)]
    assert got[6] == [(4, 1, 6200), (4, 2, 8600)]


def test_due_times_equal_the_queues_back_off(spark, tmp_path):
    """A script of failures, each when its retry falls due: the times are those of the queue's own rule."""
    at, script, want = 1000, [], []
    for n in range(1, 9):
        script.append([(1, n, at, False)])
        due = at + min(600 * 2 ** min(n, 5), 86400)
        want.append((1, n, due))
        at = due + 1
    # some within one batch, some by their timers
    got = run_retries(spark, tmp_path, [sum(script[:3], []), script[3], sum(script[4:], []), [(2, 99, at + 10, True)]])
    assert [x for k in sorted(got) for x in got[k]] == want


def test_session_state_survives_a_restart(spark, tmp_path):
    schema = "session_id long, id long, role string, content string"
    batches = [
        [(1, k, "user", f"m{k}") for k in range(20)] + [(2, 5, "user", "five")],
        [(1, 3, "user", "late"), (1, 25, "user", "m25"), (2, 1, "user", "late but held"), (2, 5, "user", "again"), (None, 1, "x", "y"), (1, None, "x", "y")],
        [(2, k, "assistant", None) for k in range(6, 30)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state.run_once(state.remember(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), str(tmp_path / "state"), mode="update")
        got = sorted((r.session_id, r.id, r.content) for r in state.memory(spark, str(tmp_path / "state")).collect())
        if rows is batches[1]:
            assert got == [(1, k, f"m{k}") for k in range(9, 20)] + [(1, 25, "m25"), (2, 1, "late but held"), (2, 5, "five")]
    assert [g for g in got if g[0] == 2] == [(2, k, None) for k in range(18, 30)]


# committed tables -------------------------------------------------------------------------------------------------

ROWS = "id long, v string"


def rows_of(table, **how):
    return sorted(((r.id, r.v) for r in table.read(**how).collect()), key=repr)


def test_empty_and_older_versions(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "id", ROWS, 4)
    assert table.version() == 0 and rows_of(table) == []
    with pytest.raises(ValueError, match="no schema"):
        CommittedTable(spark, str(tmp_path / "none")).read()
    table.append(spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], ROWS))
    table.append(spark.createDataFrame([], ROWS))
    table.delete(spark.createDataFrame([(2,), (None,), (77,)], "id long"))
    table.commit(spark.createDataFrame([("c", 3.0)], "v string, id double"))  # by name, cast
    assert rows_of(table) == [(3, "c")] and rows_of(table, version=3) == [(1, "a")] and rows_of(table, version=1) == rows_of(table, version=2) == [(1, "a"), (2, "b"), (None, "n")]
    again = CommittedTable(spark, str(tmp_path / "t"))  # key, schema and buckets are in the log
    assert (again.key, again.buckets, again.schema.simpleString()) == ("id", 4, "struct<id:bigint,v:string>")
    with pytest.raises(Exception, match="zz|UNRESOLVED"):
        table.append(spark.createDataFrame([(1,)], "zz long"))
    assert table.version() == 4


def test_two_writers_of_one_version(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "id", ROWS, 4)
    table.append(spark.createDataFrame([(k, "old") for k in range(40)], ROWS))
    base = table.version()
    by_bucket = {b: [r.id for r in table.read(buckets=[b]).collect()] for b in range(4)}
    change = lambda b, v: table.read(base, [b]).withColumn("v", F.lit(v))
    table.commit(change(0, "first"), base, [0])
    with pytest.raises(Conflict):
        table.commit(change(0, "second"), base, [0])
    table.commit(change(1, "third"), base, [1])  # another bucket: put on top
    table.append(spark.createDataFrame([(100, "new")], ROWS))
    got = dict(rows_of(table))
    assert {got[k] for k in by_bucket[0]} == {"first"} and {got[k] for k in by_bucket[1]} == {"third"} and {got[k] for k in by_bucket[2]} == {"old"} and got[100] == "new"
    with pytest.raises(Conflict):
        table.commit(table.read(base), base)  # the whole table, from an older version
    # an update is made again from what the other writer has left
    tries = []

    def add(stored):
        if not tries:
            tries.append(1)
            table.update(lambda s: s.withColumn("v", F.concat("v", F.lit("+"))), operation="other")
        return stored.withColumn("v", F.concat("v", F.lit("!")))

    table.update(add)
    assert set(dict(rows_of(table)).values()) == {"first+!", "third+!", "old+!", "new+!"}
    with pytest.raises(ValueError, match="does not name"):
        table.commit(table.read(), table.version(), [0])


def test_racing_writers_lose_nothing(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "id", "id long, n int", 1)
    table.append(spark.createDataFrame([(1, 0)], "id long, n int"))
    failed = []

    def work():
        try:
            for _ in range(3):
                CommittedTable(spark, str(tmp_path / "t")).update(lambda s: s.withColumn("n", F.col("n") + 1), spark.createDataFrame([(1,)], "id long"), tries=50)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and table.read().first().n == 9 and table.version() == 10


def test_crash_before_publishing(spark, tmp_path, monkeypatch):
    table = CommittedTable(spark, str(tmp_path / "t"), "id", ROWS, 2)
    table.append(spark.createDataFrame([(1, "a")], ROWS))

    def crash(self, manifest):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(committed.CommittedTable, "_publish", crash)
        with pytest.raises(RuntimeError):
            table.update(lambda s: s.withColumn("v", F.lit("lost")))
    assert rows_of(table) == [(1, "a")] and table.version() == 1
    table.update(lambda s: s.withColumn("v", F.lit("b")))
    assert rows_of(table) == [(1, "b")]
    # young folders stay, as someone may publish them; old ones that no kept version names go
    assert table.vacuum(keep=1) == [] and len(table.vacuum(keep=1, older_than=-5)) == 2
    assert rows_of(table) == [(1, "b")] and table.versions() == [2]


def test_steps_of_a_stream_count_once(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "id", ROWS, 2)
    for _ in range(2):
        table.append(spark.createDataFrame([(1, "a")], ROWS), step=("s", 0))
    table.append(spark.createDataFrame([(2, "b")], ROWS), step=("other", 0))
    table.update(lambda s: s.withColumn("v", F.lit("x")), spark.createDataFrame([], "id long"), step=("s", 1))
    assert rows_of(table) == [(1, "a"), (2, "b")] and (table.done("s"), table.done("other"), table.done("none")) == (1, 0, -1)


def test_upserts_on_a_committed_table(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), "id", "id long, bucket string", 4)
    table.append(spark.createDataFrame([(k, "x") for k in range(10)], "id long, bucket string"))
    patch = spark.createDataFrame([(3, "y"), (11, "z"), (4, None)], "id long, bucket string")
    table.update(lambda s: entity.merge_by_key(s, patch, ["id"], ["bucket"]), patch)
    got = {r.id: r.bucket for r in table.read().collect()}
    assert got == {k: "x" for k in range(10)} | {3: "y", 11: "z"}
    touched = table.history()[-1]["touched"]
    assert set(touched) == {str(b) for b in table.touched(patch)} and len(touched) < 4


def test_latest_of_nothing(spark, tmp_path):
    assert jobs.latest(spark, str(tmp_path / "none"), "id long").count() == 0


# the event sink ---------------------------------------------------------------------------------------------------


def answers(spark, rows):
    return spark.createDataFrame(rows, "session_id long, query string, answer string, sources array<long>")


def test_event_sequences(spark, tmp_path):
    rows = [(1, "what?", "x" * 85, [4, 5]), (2, None, None, None), (3, 'quote " \n é', "line\n\n\nbreak data: {}", []), (None, "q", "a", [])]
    folder = events.write_events(events.chat_events(answers(spark, rows)), str(tmp_path / "e"))
    got = {}
    for r in sorted(events.read_events(spark, folder).collect(), key=lambda r: (r.session_id, r.nth)):
        got.setdefault(r.session_id, []).append((r.nth, json.loads(r.event)))
    assert [[e["type"] for _, e in got[k]] for k in (1, 2, 3)] == [["meta", "delta", "delta", "delta", "sources", "done"], ["meta", "sources", "done"], ["meta", "delta", "sources", "done"]]
    assert ("".join(e.get("delta", "") for _, e in got[1]), got[1][0][1]["context_count"], got[1][4][1]["sources"]) == ("x" * 85, 2, [4, 5])
    assert (got[3][0][1]["query"], got[3][1][1]["delta"]) == ('quote " \n é', "line\n\n\nbreak data: {}") and got[2][0][1]["query"] is None
    assert all(n == k for s in got.values() for k, (n, _) in enumerate(s, 1))
    # frames as a browser takes them
    for f in (tmp_path / "e" / "data").glob("*.sse"):
        assert all(frame.startswith("data: {") for frame in f.read_text().split("\n\n")[:-1])
    events.write_events(events.chat_events(answers(spark, [(9, "q", "a", [])])), str(tmp_path / "e"))
    assert events.read_events(spark, folder).select("session_id").distinct().count() == 4
    events.write_events(events.chat_events(answers(spark, [(9, "q", "a", [])])), str(tmp_path / "e"), "overwrite")
    assert events.read_events(spark, folder).select("session_id").distinct().count() == 1


def test_broken_sequences_leave_nothing(spark, tmp_path):
    whole = events.chat_events(answers(spark, [(k, "q", "a" * 100, []) for k in range(20)]))
    for broken in (whole.where("session_id <> 7 OR type <> 'done'"), whole.where("session_id <> 7 OR nth <> 2"), whole.where("session_id <> 7 OR type <> 'meta'"), whole.unionByName(whole.where("session_id = 7"))):
        with pytest.raises(Exception, match="BrokenSequence|session 7"):
            events.write_events(broken, str(tmp_path / "e"))
        assert events.read_events(spark, str(tmp_path / "e")).count() == 0
    assert not list(Path(tmp_path).rglob("*.sse"))
    assert events.read_events(spark, events.write_events(whole.limit(0), str(tmp_path / "e"))).count() == 0
