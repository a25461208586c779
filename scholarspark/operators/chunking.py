"""Text chunks with overlap, cut at sentence ends where one is near."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import ship_package

#: Characters that end a sentence, and how far into a chunk one must stand for the chunk to end there.
SENTENCE_END = re.compile("[。.!?]")
NEAREST_END = 120


def spans(flat: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Where chunks of ``size`` characters at most begin and end, found from the places of all sentence ends."""
    room = size if size > overlap else overlap + NEAREST_END
    stops = [m.start() for m in SENTENCE_END.finditer(flat)]
    begin, total = 0, len(flat)
    while total - begin > room:
        last = bisect_left(stops, begin + room) - 1  # the last sentence end inside the chunk, if any
        near = last >= 0 and stops[last] - begin > NEAREST_END
        end = stops[last] + 1 if near else begin + room
        yield begin, end
        begin = max(end - overlap, begin + 1)
    if begin < total:
        yield begin, total


def chunk_text(text: str | None, size: int = 900, overlap: int = 160) -> list[str]:
    """The chunks of a text with its white space collapsed, in order.

    A chunk ends after the last sentence end that stands more than ``NEAREST_END`` characters in, else when it is full;
    the next starts ``overlap`` before that. A size within the overlap is raised above it. Blank texts have none.
    """
    flat = " ".join((text or "").split())
    return [chunk for at, to in spans(flat, size, overlap) if (chunk := flat[at:to].strip())]


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 900, overlap: int = 160) -> DataFrame:
    """``(doc_id, chunk_index, chunk_text)`` of all documents; blank texts have none.

    Where a chunk begins depends on the one before, so each text is cut in one go, in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                chunks = [chunk_text(t.as_py(), size, overlap) for t in rows.column(1)]
                owner = pa.array([k for k, c in enumerate(chunks) for _ in c], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0).take(owner), pa.array([n for c in chunks for n in range(len(c))], pa.int32()), pa.array([x for c in chunks for x in c], pa.string())], names=["id", "chunk_index", "chunk_text"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, chunk_index int, chunk_text string").withColumnRenamed("id", id_col)
