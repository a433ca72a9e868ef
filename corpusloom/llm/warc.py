"""WARC archives as a PySpark data source, read and written by executors.

Reading: ``spark.read.format("warc").load(path)`` after :func:`register`.  Files
are planned into partitions by size; predicates on the record type and on
headers are pushed into the scan, where a record's headers are parsed first and
the payload of an unwanted record is passed over without being read (plain
files: by a seek) or decoded.  Writing: each task writes a file under a hidden
name, and the driver's commit makes all of them visible.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from . import scratch

#: Small files share a partition up to so many bytes; a larger file is one of its own.
PARTITION_BYTES = 128 << 20
BATCH_BYTES, BATCH_RECORDS = 8 << 20, 2000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Column of the schema, and the header it comes from.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Gunzip(io.RawIOBase):
    """The bytes of gzip members one after another; passing over bytes still inflates them."""

    def __init__(self, source):
        self.source, self.inflate, self.rest = source, zlib.decompressobj(31), b""

    def read(self, n: int = -1) -> bytes:
        out = []
        while n > 0:
            if self.inflate.eof:
                self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            raw = self.rest or self.source.read(1 << 18)
            if not raw:
                break
            piece = self.inflate.decompress(raw, n)
            self.rest = self.inflate.unconsumed_tail
            out.append(piece)
            n -= len(piece)
        return b"".join(out)


class Records:
    """Reads records one by one; ``skip`` passes over what is left of one."""

    def __init__(self, source, seekable: bool):
        self.source, self.seekable, self.buffer, self.at = source, seekable, b"", 0

    def _more(self) -> bool:
        piece = self.source.read(1 << 18)
        self.buffer, self.at = self.buffer[self.at :] + piece, 0
        return bool(piece)

    def block(self) -> list[bytes] | None:
        """Lines up to an empty one; None at the end of the file."""
        while (end := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more():
                return None
        lines = self.buffer[self.at : end].split(b"\r\n")
        self.at = end + 4
        return lines

    def take(self, n: int) -> bytes:
        got = self.buffer[self.at : self.at + n]
        self.at += len(got)
        pieces = [got]
        n -= len(got)
        while n > 0 and (piece := self.source.read(n)):
            pieces.append(piece)
            n -= len(piece)
        if n > 0:
            raise EOFError("a WARC record ends early")
        return b"".join(pieces)

    def skip(self, n: int) -> None:
        here = min(n, len(self.buffer) - self.at)
        self.at += here
        n -= here
        if n and self.seekable:
            self.source.seek(n, 1)
        elif n:
            self.take(n)


def fields_of(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, _, v in (line.partition(b":") for line in lines)}


def wanted(filters: list[Filter], row: dict[str, str | None]) -> bool:
    for f in filters:
        value = row.get(f.attribute[0])
        if isinstance(f, EqualTo):
            ok = value is not None and value == f.value
        elif isinstance(f, In):
            ok = value is not None and value in f.value
        elif isinstance(f, StringStartsWith):
            ok = value is not None and value.startswith(f.value)
        else:
            ok = value is not None
        if not ok:
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.names
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.digest = str(options.get("digest", "true")).lower() == "true"
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, root = open_store(self.path)
        files = [i for i in store.get_file_info(pafs.FileSelector(root)) if i.is_file and not i.base_name.startswith((".", "_"))] if store.get_file_info(root).type == pafs.FileType.Directory else [store.get_file_info(root)]
        plan, full = [], self.partition_bytes + 1
        for info in sorted(files, key=lambda i: i.path):
            if full + info.size > self.partition_bytes:
                plan.append(Files([]))
                full = 0
            plan[-1].paths.append(info.path)
            full += info.size
        return plan or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        rows: list[dict] = []
        held = 0
        for path in partition.paths:
            for row in self.records(store, path):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held >= BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in self.names], names=self.names)

    def records(self, store, path: str) -> Iterator[dict]:
        with store.open_input_file(path) as raw:
            packed = path.endswith(".gz")
            records = Records(Gunzip(raw) if packed else raw, not packed)
            while (lines := records.block()) is not None:
                while lines and not lines[0].startswith(b"WARC/"):
                    lines = lines[1:]
                if not lines:
                    continue
                head = fields_of(lines[1:])
                row = {c: head.get(h) for c, h in HEADER.items()}
                length = int(head.get("content-length", 0))
                if not wanted(self.filters, row):
                    records.skip(length + 4)
                    continue
                row |= {"payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha256:") or None, "payload_bytes": length, "payload": None}
                revisit = row["record_type"] == "revisit"
                http = head.get("content-type", "").startswith("application/http")
                if not (self.payload or self.digest or http):
                    records.skip(length + 4)
                    yield row
                    continue
                block = records.take(length)
                records.skip(4)
                if http:
                    top, _, block = block.partition(b"\r\n\r\n")
                    row["payload_bytes"] = int(fields_of(top.split(b"\r\n")[1:]).get("content-length", 0)) if revisit else len(block)
                if not revisit:
                    if self.digest:
                        row["payload_digest"] = hashlib.sha256(block).hexdigest()
                    if self.payload:
                        row["payload"] = block
                yield row


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    final: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"]
        self.packed = options.get("compression", "none") == "gzip"
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed
        with store.open_output_stream(f"{root}/_{name}", compression=None) as out:
            for batch in iterator:
                columns = [batch.column(c) for c in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")]
                for i in range(batch.num_rows):
                    record = self.record(*(c[i].as_py() for c in columns))
                    out.write(zlib.compress(record, 1, 31) if self.packed else record)
        return Written(f"{root}/_{name}", f"{root}/{name}")

    def record(self, record_id, kind, uri, refers_to, digest, n, payload) -> bytes:
        revisit = kind == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        block = http if revisit else http + (payload or b"")
        head = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": self.date, "WARC-Target-URI": uri, "WARC-Refers-To": refers_to, "WARC-Profile": REVISIT_PROFILE if revisit else None, "WARC-Payload-Digest": digest and f"sha256:{digest}", "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
        lines = [f"{k}: {str(v).replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in head.items() if v is not None]
        return b"".join([b"WARC/1.1\r\n", "\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])

    def commit(self, messages) -> None:
        store, _ = open_store(self.path)
        for m in messages:
            if m is not None:
                store.move(m.hidden, m.final)

    def abort(self, messages) -> None:
        store, _ = open_store(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(m.hidden)


class WarcDataSource(DataSource):
    """Options: path; payload, digest (read: whether to return and to hash payloads); partitionBytes; compression (write: none or gzip); date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archive_records(pages: DataFrame, least: int = 100, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows for the WARC writer, one per page.

    Of pages with equal payloads of ``least`` bytes or more, the smallest id is
    a response and the others are revisits of it; rows that share the smallest
    id are all responses.  Shorter payloads are always responses.  A null
    payload is empty, a null id is larger than any other, a null url is left
    out of the headers; other columns are ignored.

    Digests with more than one page are written as a small table first, so that
    Spark can broadcast it if its known size allows and else joins by digest
    (splitting a hot one), moving payloads only then.
    """
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload")).withColumns({"n": F.length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    repeated = scratch.written(base.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "warc-repeated")
    first: Column = F.col("first")
    revisit = (F.col("n") >= least) & first.isNotNull() & ~F.col("id").eqNullSafe(first)
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return base.join(repeated, "digest", "left").select(
        urn(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("uri").cast("string").alias("target_uri"),
        F.when(revisit, urn(first)).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("n").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame, path: str | None = None, compression: str = "none") -> DataFrame:
    """Write ``pages`` as archives below ``path`` (the shared folder by default) and read what they say.

    Returns page_id, payload_bytes, payload_digest (of the full payload; hashed
    anew for responses, as recorded for revisits), record_type, refers_to.
    """
    spark = pages.sparkSession
    register(spark)
    path = path or scratch.new_path(spark, "warc")
    archive_records(pages).write.format("warc").option("compression", compression).mode("append").save(path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  after "urn:page:"
    return spark.read.format("warc").option("payload", "false").load(path).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
