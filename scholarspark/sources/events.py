"""An ordered sink of chat events: each answer's sequence of frames, whole or absent.

``df.write.format("events")`` takes rows ``(session_id, nth, type, payload)`` and writes frames ``data: {json}`` with a blank line
after each. A task's file counts only when the job's manifest names it, and that is published once all tasks are done; an
aborted job deletes what its tasks left and publishes nothing. A task refuses a sequence that is out of order or cut off,
so rows must come dealt by session and sorted by ``nth``, which ``write_events`` sees to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.lineage import ship_package
from .files import file_system, qualified, write_json

ROWS = "session_id long, nth int, type string, payload string"
#: What may follow an event of a type; None stands for the sequence's start.
AFTER = {None: {"meta"}, "meta": {"delta", "sources"}, "delta": {"delta", "sources"}, "sources": {"done"}, "done": set()}


class BrokenSequence(Exception):
    pass


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    sequences: int


def frames(rows: Iterator[Any]) -> Iterator[tuple[bytes, bool]]:
    """``(frame, last of its sequence)`` of rows in order; ``BrokenSequence`` where one is not a whole sequence."""
    session, last, nth = None, "done", 0
    for row in rows:
        if last == "done":
            session, last, nth = row.session_id, None, 0
        if row.session_id != session or row.type not in AFTER[last] or row.nth != nth + 1:
            raise BrokenSequence(f"session {row.session_id}: {row.type} {row.nth} after {last} {nth} of session {session}")
        last, nth = row.type, row.nth
        event = {"type": row.type, "session_id": row.session_id, "nth": row.nth} | json.loads(row.payload or "{}")
        yield f"data: {json.dumps(event, ensure_ascii=False)}\n\n".encode(), last == "done"
    if last != "done":
        raise BrokenSequence(f"session {session} ends with {last}")


class EventWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Written:
        fs, root = file_system(self.folder)
        name, out, sequences = f"{self.job}-{uuid.uuid4().hex}.sse", None, 0
        for frame, last in frames(iterator):
            if out is None:
                fs.create_dir(f"{root}/data", recursive=True)
                out = fs.open_output_stream(f"{root}/data/{name}")
            out.write(frame)
            sequences += last
        if out is None:
            return Written(None, 0)
        out.close()
        return Written(name, sequences)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.file]
        write_json(f"{self.folder}/jobs/{self.job}.json", {"files": sorted(m.file for m in done), "sequences": sum(m.sequences for m in done)})
        if self.overwrite:
            fs, root = file_system(self.folder)
            for f in fs.get_file_info(pafs.FileSelector(f"{root}/jobs")):
                if f.base_name != f"{self.job}.json":
                    fs.delete_file(f.path)
        self._sweep({m.file for m in done})

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(set())

    def _sweep(self, kept: set[str]) -> None:
        """Delete what tasks of this job left, those that were tried again included."""
        fs, root = file_system(self.folder)
        for f in fs.get_file_info(pafs.FileSelector(f"{root}/data", allow_not_found=True)):
            if f.base_name.startswith(self.job) and f.base_name not in kept:
                fs.delete_file(f.path)


class Events(DataSource):
    """``df.write.format("events").option("folder", ...)``, appending or overwriting."""

    @classmethod
    def name(cls) -> str:
        return "events"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: Any, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["folder"], overwrite)


def chat_events(answers: DataFrame, size: int = 40) -> DataFrame:
    """``(session_id, nth, type, payload)`` of ``answers (session_id, query, answer, sources)``: meta, deltas, sources, done.

    ``sources`` are numbers of contexts; deltas are pieces of ``size`` characters, none of a null or empty answer.
    Sessions are unique and not null; rows without a session are left out.
    """
    event = lambda kind, *fields: F.struct(F.lit(kind).alias("type"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))
    pieces: Column = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    held = F.coalesce("sources", F.array().cast("array<bigint>"))
    deltas = F.transform(pieces, lambda p: event("delta", p.alias("delta")))
    done = F.struct(F.lit("done").alias("type"), F.lit("{}").alias("payload"))
    all_ = F.concat(F.array(event("meta", F.col("query"), F.size(held).alias("context_count"))), deltas, F.array(event("sources", held.alias("sources")), done))
    rows = answers.where("session_id IS NOT NULL").select("session_id", F.posexplode(all_).alias("k", "e"))
    return rows.select("session_id", (F.col("k") + 1).cast("int").alias("nth"), "e.type", "e.payload")


def write_events(events: DataFrame, folder: str, mode: str = "append") -> str:
    """Write whole sequences; a session is in one task, in order. The folder with its scheme."""
    spark = events.sparkSession
    ship_package(spark)
    spark.dataSource.register(Events)
    folder = qualified(spark, folder)
    rows = events.select("session_id", "nth", "type", "payload").repartition("session_id").sortWithinPartitions("session_id", "nth")
    rows.write.format("events").option("folder", folder).mode(mode).save()
    return folder


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """``(session_id, nth, type, event)`` of the published sequences, ``event`` the frame's object as text."""
    fs, root = file_system(qualified(spark, folder))
    files = []
    for f in fs.get_file_info(pafs.FileSelector(f"{root}/jobs", allow_not_found=True)):
        if f.path.endswith(".json"):
            with fs.open_input_stream(f.path) as s:
                files += json.loads(s.read())["files"]
    schema = "session_id long, nth int, type string"
    if not files:
        return spark.createDataFrame([], schema + ", event string")
    lines = spark.read.text([f"{folder}/data/{f}" for f in files], lineSep="\n\n").where("value LIKE 'data: %'")
    event = F.substring("value", 7, 1 << 30)
    return lines.select(F.from_json(event, schema).alias("e"), event.alias("event")).select("e.*", "event")
