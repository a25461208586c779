"""Files beside Spark's tables: small state files of drivers and parts that a Python worker reads or writes itself.

Folders carry the scheme that Spark gives them, so that drivers and workers mean the same place.
"""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder; without a scheme it is refused, as machines would not agree on it."""
    if folder.startswith("file:") and "://" not in folder:
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


def parquet_files(folder: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, root = file_system(folder)
    return fs, parquet_files_in(fs, root)


def parquet_files_in(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".parquet"))


def read_json(place: str) -> dict | None:
    """A state file's object, or None where there is none."""
    fs, path = file_system(place)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def write_json(place: str, value: dict) -> None:
    """A state file in place of the former one; a reader sees the one or the other whole."""
    fs, path = file_system(place)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path + ".new") as f:
        f.write(json.dumps(value).encode())
    fs.move(path + ".new", path)
