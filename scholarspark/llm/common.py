"""Shared plumbing of the subpackage: the library's written tables and components, and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.lineage import connected_components, materialize, release, scratch_dir, ship_package

__all__ = ["connected_components", "free_name", "map_arrow", "materialize", "release", "scratch_dir", "ship_package", "slices"]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name where ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Rows that a function sees at once: what it makes of them stays small beside the batch itself.
SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices, without copying; batches without rows are left out.

    At the end of a task the worker, which waits for the next one, gives the memory that it freed back to the system.
    """
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on slices of batches; a dict result is cast to ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            if isinstance(out, dict):
                out = pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip((out[f.name] for f in target), target, strict=True)], schema=target)
            yield out

    return df.mapInArrow(run, schema)
