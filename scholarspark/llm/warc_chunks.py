"""WARC archives written and read as a chunked record table.

A payload is never held whole in Python: the plan cuts it into rows ``(record, chunk number, bytes)`` of a bounded size,
the writer streams these rows into archive members (one gzip member per record), and the reader streams members back
into such rows, each with the SHA-256 of the payload up to and including it. The last row of a record so carries
the digest of its whole payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_dir, ship_package

CHUNK = 1 << 20
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: Most distinct repeated payloads whose table (about 100 bytes a row) is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def with_decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """``(id, url, payload, bytes, digest, refers_to)``: of equal payloads of ``least`` bytes or more the smallest id is stored.

    ``refers_to`` is null for stored records. Null payloads are empty. Of rows repeating the smallest id of their
    payload each is stored; rows without an id refer to the smallest id where there is one.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    repeated = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "first")
    repeated = materialize(repeated, "warc-repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated, ["digest", "bytes"], "left")
    return joined.select("id", "url", "payload", "bytes", "digest", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of records, in order within each: ``(id, url, bytes, digest, refers_to, chunk_no, last, data)``.

    A record that refers to another has one row without data, as has an empty payload.
    """
    stored = F.when(F.col("refers_to").isNull(), F.col("bytes")).otherwise(F.lit(0))
    last = F.greatest(F.lit(0), F.floor((stored - 1) / chunk)).cast("int")
    rows = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last)))
    data = F.when(F.col("refers_to").isNull(), F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return rows.select("id", "url", "bytes", "digest", "refers_to", "chunk_no", (F.col("chunk_no") == last).alias("last"), data.alias("data"))


def _record_name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _head(page: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The record header and the HTTP header of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_name(page)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_name(refers_to)}"]
    body = len(http) + (size if refers_to is None else 0)
    return "\r\n".join([*lines, f"Content-Length: {body}", "", ""]).encode() + http


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it, so that workers write where Spark itself would."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder with a scheme; one without is refused."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder)


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """One ``.warc.gz`` file per partition in ``folder``; returns the written table ``(file, records)`` of the files.

    A file takes its final name only when complete, so a task that is tried again after a lost executor leaves no
    second archive: only files named in the table count, and unfinished ones of this
    call are deleted at the end. Chunks of a record come in order and together; no chunks give no files, and other columns are not read.
    """
    ship_package(chunks.sparkSession)
    folder, call = qualified(chunks.sparkSession, folder), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        name = f"{root}/{call}-{uuid.uuid4().hex}.warc.gz"
        out, packer, records = None, None, 0
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(name + ".part")
                if col["chunk_no"][k].as_py() == 0:
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(_head(*(col[n][k].as_py() for n in ("id", "url", "bytes", "digest", "refers_to")))))
                if (data := col["data"][k]).is_valid:
                    out.write(packer.compress(data.as_buffer()))
                if col["last"][k].as_py():
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    records += 1
        if out is not None:
            out.close()
            fs.move(name + ".part", name)
            yield pa.RecordBatch.from_pydict({"file": [name.rsplit("/", 1)[1]], "records": pa.array([records], pa.int64())})

    try:
        return materialize(chunks.mapInArrow(run, "file string, records long"), "warc-files")
    finally:
        fs, root = _file_system(folder)
        for left in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if left.base_name.startswith(call) and left.path.endswith(".part"):  # of a task that failed or was tried again elsewhere
                fs.delete_file(left.path)


class _Stream:
    """Plain bytes of consecutive gzip members, read in bounded blocks."""

    def __init__(self, source, block: int):
        self.source, self.block, self.raw, self.buffer = source, block, b"", bytearray()
        self.unpacker = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.raw = self.unpacker.unused_data or self.raw
                self.unpacker = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.block)
                if not self.raw:
                    return False
            plain = self.unpacker.decompress(self.raw, self.block)
            self.raw = b"" if self.unpacker.eof else self.unpacker.unconsumed_tail
            if plain:
                self.buffer += plain
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def some(self, most: int) -> bytes:
        """Between one and ``most`` bytes."""
        if not self.buffer and not self._more():
            raise EOFError("the archive ends inside a record")
        out = bytes(self.buffer[:most])
        del self.buffer[:most]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("the archive ends inside a record")
        return self.some(n)


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def read_chunks(source, chunk: int = CHUNK, block: int = 1 << 16) -> Iterator[dict]:
    """Chunk rows of an archive stream; memory stays within a chunk and a block whatever a record's size.

    A stored payload that does not have the digest in its header, or a record of another length, raises an error.

    Keys: ``page``, ``record_type``, ``refers_to``, ``payload_bytes`` and ``stated_digest`` as the headers have them,
    ``chunk_no``, ``last``, ``data``, and ``digest``, the SHA-256 of the record's stored payload so far.
    """
    stream = _Stream(source, block)
    number = lambda name: None if name is None or name == "<urn:page:none>" else int(name[10:-1])
    while (raw := stream.until(b"\r\n\r\n")) is not None:
        head = _headers(raw)
        http = stream.until(b"\r\n\r\n")
        left = int(head["content-length"]) - len(http)
        row = {"page": number(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": number(head.get("warc-refers-to")), "payload_bytes": int(_headers(http)["content-length"]), "stated_digest": head["warc-payload-digest"].partition(":")[2]}
        running, k = hashlib.sha256(), 0
        while True:
            data = stream.exactly(min(chunk, left))
            left -= len(data)
            running.update(data)
            digest = running.copy().hexdigest()
            if not left and row["record_type"] == "response" and digest != row["stated_digest"]:
                raise ValueError(f"the payload of record {row['page']} is not the one that its digest names")
            yield row | {"chunk_no": k, "last": left == 0, "data": data, "digest": digest}
            k += 1
            if not left:
                break
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


CHUNK_SCHEMA = "page long, record_type string, refers_to long, payload_bytes long, stated_digest string, chunk_no int, last boolean, data binary, digest string"


def read_archives(files: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``files``; without data where only digests are wanted."""
    ship_package(files.sparkSession)
    folder = qualified(files.sparkSession, folder)
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    most_rows, most_bytes = 1000, 8 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        types = pa.schema([("page", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("stated_digest", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("digest", pa.string())])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for row in read_chunks(source, chunk):
                        held += len(row["data"])
                        rows.append(row if with_data else row | {"data": None})
                        if len(rows) >= most_rows or held >= most_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema=types)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=types)

    assert names == ["page", "record_type", "refers_to", "payload_bytes", "stated_digest", "chunk_no", "last", "data", "digest"]
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(run, CHUNK_SCHEMA)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, with_data: bool = False) -> DataFrame:
    """Write a record per row of ``pages``, then return the chunked record table read back from the archives.

    No rows give no archives and no chunks; an empty or null payload has one chunk of no bytes. Repeated rows have a
    record each. Columns other than the three named are not read. ``folder`` is by default a new one in the shared folder.
    """
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    files = write_archives(chunked(with_decisions(pages, id_col, url_col, payload_col)), folder)
    return read_archives(files, folder, with_data=with_data)


def record_summary(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: its digest is the payload's; a revisit's is the one that it states.

    Repeated records and null ids stay as they are; no chunks give no rows.
    """
    digest = F.when(F.col("record_type") == "revisit", F.col("stated_digest")).otherwise(F.col("digest"))
    return chunks.where("last").select(F.col("page").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
