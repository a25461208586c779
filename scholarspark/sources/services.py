"""Paged answers of scholarly services as Spark data sources, batch and stream.

``papers`` asks a paper service for the references, citations or records of papers, ``works`` asks a registry for the DOIs of
titles, and ``poll`` is a stream that takes a few papers of a feed in each trigger. A scan is split by ranges of keys, so
many workers ask at once; within a paper one page is asked for after the other, until an answer names no next one.

A transport answers a request ``(key, path)`` with a status and a body. ``Recorded`` looks answers up in a folder that
``record_answers`` has written; any class of that interface can stand for it (option ``transport``, ``module:Class``). As a
service's failures must not end a job, a request that fails makes its whole paper or title an empty answer: no rows in a
scan, and in a stream one row that says why.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.lineage import ship_package
from .connectors import RECORD
from .files import file_system, parquet_files, parquet_files_in, qualified, read_json, write_json

#: Most records that the paper service gives in one answer.
PAGE = 100
#: Papers that one partition of a scan asks for.
PER_PARTITION = 1000
#: Rows after which a stream's answers are handed on.
BATCH_ROWS = 1000
PAPER_ROWS = f"paper_id long, nth int, record struct<{RECORD}>"
POLL_ROWS = f"seq long, paper_id long, nth int, record struct<{RECORD}>, error string"
DOI_ROWS = "title string, doi string"
#: What an answer's items hold their record under.
INSIDE = {"references": "citedPaper", "citations": "citingPaper"}


class ServiceError(Exception):
    """An answer that is no success, no answer at all, or one that is no object."""


class Recorded:
    """Answers from a folder of rows ``(key, path, status, body)``, those of a range of keys held at a time."""

    def __init__(self, options: dict):
        self.folder = options["recording"]
        self.answers: dict[tuple[int, str], tuple[int, str]] = {}

    def span(self) -> tuple[int, int] | None:
        """The smallest and the largest key, from the files' own statistics."""
        fs, files = parquet_files(self.folder)
        ends = []
        for f in files:
            meta = pq.ParquetFile(f, filesystem=fs).metadata
            ends += [s for k in range(meta.num_row_groups) if (s := meta.row_group(k).column(0).statistics) is not None and s.has_min_max]
        return (min(s.min for s in ends), max(s.max for s in ends)) if ends else None

    def load(self, low: int, high: int) -> None:
        """Hold the answers of the keys from ``low`` to ``high``; row groups of other keys are not read."""
        fs, files = parquet_files(self.folder)
        if files:
            rows = pq.read_table(files, filesystem=fs, filters=(pc.field("key") >= low) & (pc.field("key") <= high))
            self.answers = {(k, p): (s, b) for k, p, s, b in zip(*(rows.column(c).to_pylist() for c in ("key", "path", "status", "body")), strict=True)}

    def get(self, key: int, path: str) -> tuple[int, str]:
        return self.answers.get((key, path), (404, ""))


def transport_of(options: dict) -> Any:
    if named := options.get("transport"):
        module, _, name = named.partition(":")
        return getattr(importlib.import_module(module), name)(options)
    return Recorded(options)


def answer(transport: Any, key: int, path: str) -> dict:
    status, body = transport.get(key, path)
    if status != 200:
        raise ServiceError(f"status {status}")
    try:
        found = json.loads(body)
    except (TypeError, ValueError):
        raise ServiceError("no JSON") from None
    if not isinstance(found, dict):
        raise ServiceError("no object")
    return found


def page_path(paper: Any, kind: str, offset: Any, limit: int) -> str:
    return f"/paper/{paper}" + (f"/{kind}?offset={offset}&limit={limit}" if kind in INSIDE else "")


def records(transport: Any, paper: int, kind: str, limit: int) -> list[dict]:
    """All records of a paper's answer in order, page by page; the first failure ends it."""
    if kind == "record":
        return [answer(transport, paper, page_path(paper, kind, 0, limit))]
    found: list[dict] = []
    offset: int | None = 0
    while offset is not None:
        page = answer(transport, paper, page_path(paper, kind, offset, limit))
        found += [item.get(INSIDE[kind]) for item in page.get("data") or []]
        after = page.get("next")
        if after is not None and after <= offset:
            raise ServiceError("pages do not advance")
        offset = after
    return [r for r in found if isinstance(r, dict)]


class Range(InputPartition):
    """Keys from ``low`` to ``high``, both included; of these only ``keys``, where they are named."""

    def __init__(self, low: int, high: int, keys: tuple[int, ...] | None = None):
        self.low, self.high, self.keys = low, high, keys


class Ranges(DataSourceReader):
    """A scan in ranges of keys, narrowed by the filters on its key column."""

    column = ""

    def __init__(self, options: dict, schema: StructType):
        self.options, self.arrow = dict(options), to_arrow_schema(schema)
        self.low: int | None = int(options["first"]) if "first" in options else None
        self.high: int | None = int(options["last"]) if "last" in options else None
        self.keys: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != (self.column,) or not self._narrow(f):
                yield f

    def _narrow(self, f: Filter) -> bool:
        """Take a filter over exactly, or leave it to Spark."""
        if isinstance(f, (EqualTo, In)):
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.keys = asked if self.keys is None else self.keys & asked
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            at = f.value + isinstance(f, GreaterThan)
            self.low = at if self.low is None else max(self.low, at)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            at = f.value - isinstance(f, LessThan)
            self.high = at if self.high is None else min(self.high, at)
        else:
            return False
        return True

    def span(self) -> tuple[int, int] | None:
        return transport_of(self.options).span()

    def partitions(self) -> list[Range]:
        span = self.span() if self.low is None or self.high is None else (self.low, self.high)
        if span is None:
            return [Range(1, 0)]
        low = span[0] if self.low is None else self.low
        high = span[1] if self.high is None else self.high
        step = int(self.options.get("perpartition", PER_PARTITION))
        if self.keys is not None:
            asked = sorted(k for k in self.keys if low <= k <= high)
            parts = [Range(asked[i], asked[min(i + step, len(asked)) - 1], tuple(asked[i : i + step])) for i in range(0, len(asked), step)]
        else:
            parts = [Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]
        return parts or [Range(1, 0)]


def clean(record: dict) -> dict:
    """A record without values of another type than its column's: a service's odd value is no reason to fail."""
    kinds = {"paperId": str, "title": str, "year": int, "externalIds": dict, "citationCount": int, "authors": list, "fieldsOfStudy": list}
    out = {k: v for k, kind in kinds.items() if isinstance(v := record.get(k), kind)}
    if "externalIds" in out:
        out["externalIds"] = {"DOI": d if isinstance(d := out["externalIds"].get("DOI"), str) else None}
    if "authors" in out:
        out["authors"] = [{"name": a["name"] if isinstance(a.get("name"), str) else None} for a in out["authors"] if isinstance(a, dict)]
    if "fieldsOfStudy" in out:
        out["fieldsOfStudy"] = [x for x in out["fieldsOfStudy"] if isinstance(x, str)]
    return out


class PaperReader(Ranges):
    column = "paper_id"

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind, limit, transport = self.options.get("kind", "references"), min(int(self.options.get("limit", PAGE)), PAGE), transport_of(self.options)
        if partition.low <= partition.high:
            transport.load(partition.low, partition.high)
        for paper in partition.keys or range(partition.low, partition.high + 1):
            try:
                found = records(transport, paper, kind, limit)
            except ServiceError:
                continue
            if found:
                yield pa.RecordBatch.from_pylist([{"paper_id": paper, "nth": k, "record": clean(r)} for k, r in enumerate(found, 1)], self.arrow)


class Papers(DataSource):
    """``spark.read.format("papers")``: ``(paper_id, nth, record)``.

    Options: ``recording`` (a folder) or ``transport``; ``kind`` (``references``, ``citations``, ``record``); ``limit`` (records a request,
    100 at most); ``first`` and ``last`` paper (else all that are recorded); ``perPartition`` (1,000 papers).
    """

    @classmethod
    def name(cls) -> str:
        return "papers"

    def schema(self) -> str:
        return PAPER_ROWS

    def reader(self, schema: StructType) -> PaperReader:
        return PaperReader(self.options, schema)


class WorkReader(Ranges):
    """Titles by ranges of their key; a title's answer is the DOI of the first work in it."""

    column = "key"

    def span(self) -> tuple[int, int] | None:
        return Recorded({"recording": self.options["titles"]}).span()

    def partitions(self) -> list[Range]:
        span = self.span()
        if span is None:
            return [Range(1, 0)]
        fs, files = parquet_files(self.options["titles"])
        rows = sum(pq.ParquetFile(f, filesystem=fs).metadata.num_rows for f in files)
        # keys are spread evenly, so equal ranges hold about equally many
        step = -(-(span[1] - span[0] + 1) * int(self.options.get("perpartition", PER_PARTITION)) // max(rows, 1))
        return [Range(a, min(a + step - 1, span[1])) for a in range(span[0], span[1] + 1, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.low > partition.high:
            return
        transport = transport_of(self.options)
        transport.load(partition.low, partition.high)
        fs, files = parquet_files(self.options["titles"])
        asked = pq.read_table(files, filesystem=fs, filters=(pc.field("key") >= partition.low) & (pc.field("key") <= partition.high))
        rows = []
        for key, title in zip(asked.column("key").to_pylist(), asked.column("title").to_pylist(), strict=True):
            try:
                message = answer(transport, key, work_path(title)).get("message")
                items = message.get("items") if isinstance(message, dict) else None
                first = items[0].get("DOI") if items else None
            except (ServiceError, AttributeError):
                continue
            if isinstance(first, str):
                rows.append({"title": title, "doi": first})
        yield pa.RecordBatch.from_pylist(rows, self.arrow)


def work_path(title: str) -> str:
    return f"/works?rows=1&query.title={title}"


class Works(DataSource):
    """``spark.read.format("works")``: ``(title, doi)`` of the titles that ``write_titles`` has put in the folder ``titles``."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return DOI_ROWS

    def reader(self, schema: StructType) -> WorkReader:
        return WorkReader(self.options, schema)


class Asked(InputPartition):
    """Entries ``(paper, seq)`` of a feed whose papers lie in one range of keys, in their order."""

    def __init__(self, entries: list[tuple[int, int]]):
        self.entries = entries


class PollReader(DataSourceStreamReader):
    """A few papers of a feed in each trigger; an offset is the number of papers taken.

    How far the stream has been planned is kept in the folder ``progress``, as a reader of a restarted stream must offer
    the papers after those. Where it is behind the stream's own log, the stream plans that batch again, and it catches up.
    """

    def __init__(self, options: dict, schema: StructType):
        self.options, self.arrow = dict(options), to_arrow_schema(schema)
        self.progress = self.options["progress"].rstrip("/") + "/poll.json"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"taken": 0}

    def _rows(self, after: int, to: int) -> list[tuple[int, int, int]]:
        """The feed's entries ``(seq, paper, not before)`` after a number and up to another."""
        fs, root = file_system(self.options["feed"])
        logs = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/log", allow_not_found=True)) if f.base_name.endswith(".json")]
        if not logs or after >= to:
            return []
        with fs.open_input_stream(max(logs)) as f:
            manifest = json.loads(f.read())
        files = [p for found in manifest["files"].values() for folder in found for p in parquet_files_in(fs, f"{root}/{folder}")]
        if not files:
            return []
        rows = pq.read_table(files, filesystem=fs, columns=["seq", "paper_id", "not_before"], filters=(pc.field("seq") > after) & (pc.field("seq") <= to))
        return sorted(zip(*(rows.column(c).to_pylist() for c in ("seq", "paper_id", "not_before")), strict=True))

    def latestOffset(self) -> dict:  # noqa: N802
        planned = (read_json(self.progress) or {"taken": 0})["taken"]
        now = int(self.options.get("now", time.time()))
        taken = planned
        for seq, _, not_before in self._rows(planned, planned + int(self.options.get("paperspertrigger", 5))):
            if (not_before or 0) > now:
                break
            taken = seq
        return {"taken": taken}

    def partitions(self, start: dict, end: dict) -> list[Asked]:
        if end["taken"] > (read_json(self.progress) or {"taken": 0})["taken"]:
            write_json(self.progress, end)
        # papers of one range of keys are asked for together: a trigger of many makes as many tasks as a scan of them, not one each
        step = int(self.options.get("perpartition", PER_PARTITION))
        ranges: dict[int, list[tuple[int, int]]] = {}
        for seq, paper, _ in self._rows(start["taken"], end["taken"]):
            ranges.setdefault(paper // step, []).append((paper, seq))
        return [Asked(sorted(ranges[k])) for k in sorted(ranges)]

    def _answered(self, transport: Any, paper: int, seq: int) -> list[dict]:
        head = {"seq": seq, "paper_id": paper}
        try:
            found = records(transport, paper, self.options.get("kind", "references"), min(int(self.options.get("limit", PAGE)), PAGE))
        except ServiceError as e:
            return [head | {"error": str(e)}]
        return [head | {"nth": k, "record": clean(r)} for k, r in enumerate(found, 1)] or [head]

    def read(self, partition: Asked) -> Iterator[pa.RecordBatch]:
        transport = transport_of(self.options)
        transport.load(partition.entries[0][0], partition.entries[-1][0])
        rows: list[dict] = []
        for paper, seq in partition.entries:
            rows += self._answered(transport, paper, seq)
            if len(rows) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(rows, self.arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.arrow)

    def commit(self, end: dict) -> None:
        """Nothing to do: what was planned is in the stream's own log."""


class Poll(DataSource):
    """``spark.readStream.format("poll")``: ``(seq, paper_id, nth, record, error)`` of the papers of a feed, in its order.

    A paper without records, or with an error, is one row without a record. Options: those of ``papers``, ``feed``
    (the path of a committed table ``(seq, paper_id, not_before)``), ``progress`` (a folder of this stream alone),
    ``papersPerTrigger`` (5), ``perPartition`` (papers whose ids lie in one range of so many are asked for by one task) and ``now`` (the clock, else the machine's), before which an entry is not taken.
    """

    @classmethod
    def name(cls) -> str:
        return "poll"

    def schema(self) -> str:
        return POLL_ROWS

    def streamReader(self, schema: StructType) -> PollReader:  # noqa: N802
        return PollReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let filters reach them."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Papers, Works, Poll):
        spark.dataSource.register(source)


def record_answers(answers: DataFrame, folder: str) -> str:
    """Write ``answers (key, path, status, body)`` for ``Recorded``, files by ranges of keys; the folder with its scheme."""
    rows = answers.select(F.col("key").cast("long"), "path", F.col("status").cast("int"), "body")
    rows.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.block.size", 1 << 20).parquet(folder)
    return qualified(answers.sparkSession, folder)


def title_key(title: Column) -> Column:
    return F.crc32(title.cast("binary"))


def write_titles(titles: DataFrame, folder: str) -> str:
    """Write the distinct titles of ``titles (title)`` that are no blank, with their keys; the folder with its scheme."""
    rows = titles.select("title").where("trim(title) <> ''").distinct().select(title_key(F.col("title")).alias("key"), "title")
    rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(folder)
    return qualified(titles.sparkSession, folder)
