"""WARC 1.1 archives: a Python data source that reads and writes them, and the archiving of pages with revisit records.

Each record is a gzip member of its own. The writer notes the member's compressed length in the gzip header (the `sl`
extra field), so the reader, which parses headers first, seeks over whatever its filters or its schema leave out.
"""

from __future__ import annotations

import base64
import json
import os
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
READ_SCHEMA = "file string, record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, http_headers string"
#: What the writer takes.
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date; a fixed one keeps reruns alike
FIRST_READ = 1 << 14


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def member(block: bytes, level: int = 6) -> bytes:
    """A gzip member whose header holds its own length, as far as 32 bits can."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(block) + squeeze.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(block) & 0xFFFFFFFF) if size < 1 << 32 else b"no" + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(record_id: str, kind: str, uri: str | None, refers_to: str | None, sha1: str, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = payload if kind != "revisit" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_clean(uri)}"] if uri is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers_to}"] if kind == "revisit" else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Task output goes to a hidden folder and is moved at commit, so retried and speculative tasks leave nothing behind."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.most = int(options.get("max_file_bytes", 256 << 20))
        self.job = f".{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        fs.create_dir(posixpath.join(root, self.job), recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                for row in zip(*(batch.column(batch.schema.get_field_index(c)) for c in WRITE_COLUMNS), strict=True):
                    record_id, kind, uri, refers_to, sha1, payload = (x.as_py() for x in row)
                    data = member(record(record_id, kind, uri, refers_to, sha1, payload or b""))
                    if out is None or size + len(data) > self.most and size:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(posixpath.join(root, self.job, files[-1]), compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: Sequence[Written | None]) -> None:
        fs, root = open_fs(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for f in m.files if m else ():
                fs.move(posixpath.join(root, self.job, f), posixpath.join(root, f))
        self.abort([])

    def abort(self, messages: Sequence[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = open_fs(self.path)
        if fs.get_file_info(posixpath.join(root, self.job)).type == FileType.Directory:
            fs.delete_dir(posixpath.join(root, self.job))


@dataclass
class Files(InputPartition):
    files: tuple[str, ...]

    def __post_init__(self) -> None:
        super().__init__(self.files)


class Unpacker:
    """The decoded bytes of one gzip member or of one plain record, read on demand."""

    def __init__(self, stream, start: int) -> None:
        self.stream, self.start, self.data, self.ended = stream, start, b"", False
        self.length = None
        stream.seek(start)
        head = stream.read(FIRST_READ)
        self.empty = not head
        self.zip = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None
        if self.zip and len(head) > 12 and head[3] & 4:
            size = struct.unpack_from("<H", head, 10)[0]
            at = 12
            while at + 4 <= min(12 + size, len(head)):
                if head[at : at + 2] == b"sl" and at + 12 <= len(head):
                    self.length = struct.unpack_from("<I", head, at + 4)[0]
                at += 4 + struct.unpack_from("<H", head, at + 2)[0]
        self.read = len(head)
        self._take(head)

    def _take(self, chunk: bytes) -> None:
        self.data += self.zip.decompress(chunk) if self.zip else chunk
        self.ended = bool(self.zip and self.zip.eof) or not chunk

    def more(self) -> bool:
        if self.ended:
            return False
        chunk = self.stream.read(1 << 16)
        self.read += len(chunk)
        self._take(chunk)
        return True

    def upto(self, mark: bytes, start: int) -> int:
        while (at := self.data.find(mark, start)) < 0:
            if not self.more():
                return -1
        return at

    def fill(self, size: int) -> None:
        if len(self.data) < size:
            parts, have = [self.data], len(self.data)
            while have < size:
                self.data = b""
                if not self.more():
                    break
                parts.append(self.data)
                have += len(self.data)
            self.data = b"".join(parts)

    def end(self, plain_size: int) -> int:
        """Where the next record starts; a member with a noted length isn't decoded for that."""
        if not self.zip:
            return self.start + plain_size
        if self.length:
            return self.start + self.length
        while not self.ended:
            self.data = b""
            self.more()
        return self.start + self.read - len(self.zip.unused_data)


def parse(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def hex_digest(value: str | None) -> str | None:
    if not value or not value.lower().startswith("sha1:"):
        return value
    value = value[5:]
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.names = options["path"], schema.fieldNames()
        self.group = int(options.get("group_bytes", 64 << 20))
        given = json.loads(options.get("where", "{}"))
        self.wanted: dict[str, set] = {k: set(v) for k, v in given.items() if v is not None}
        self.present: set[str] = {k for k, v in given.items() if v is None}
        self.once = str(options.get("pushdown", "false")).lower() == "true"
        if odd := given.keys() - HEADERS.keys():
            raise ValueError(f"no WARC headers: {sorted(odd)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership tests on what stands in the WARC header are decided before a payload is touched, if the frame serves one query only:
        Spark keeps what a Python source took over for later queries over the same frame."""
        if not self.once:
            yield from filters
            return
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else ""
            if name in HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            elif name in HEADERS:
                self.present.add(name)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together."""
        from pyarrow.fs import FileSelector

        fs, root = open_fs(self.path)
        found = sorted((f for f in fs.get_file_info(FileSelector(root)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))), key=lambda f: f.path)
        groups: list[list[str]] = []
        room = 0
        for f in found:
            if not groups or f.size > room:
                groups.append([])
                room = self.group
            groups[-1].append(f.path)
            room -= f.size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def _records(self, stream, name: str) -> Iterator[list]:
        at, with_payload = 0, "payload" in self.names
        while True:
            u = Unpacker(stream, at)
            if u.empty:
                return
            cut = u.upto(b"\r\n\r\n", 0)
            if cut < 0 or not u.data.startswith(b"WARC/"):
                raise ValueError(f"{name}: no WARC record at {at}")
            warc = parse(u.data[:cut])
            size = int(warc.get("content-length", 0))
            got = {k: warc.get(h.lower()) for k, h in HEADERS.items()}
            got["payload_digest"] = hex_digest(got["payload_digest"])
            if all(got[k] in v for k, v in self.wanted.items()) and all(got[k] is not None for k in self.present):
                body, head, http = cut + 4, False, {}
                if warc.get("content-type", "").startswith("application/http"):
                    split = u.upto(b"\r\n\r\n", body)
                    head = 0 <= split < body + size  # a status line needn't be followed by fields
                    http = parse(u.data[body:split]) if head else {}
                start = split + 4 if head else body
                length = body + size - start
                if got["record_type"] == "revisit" and http.get("content-length", "").isdigit():
                    length = int(http["content-length"])
                out = {"file": name, **got, "payload_bytes": length, "http_headers": u.data[body:split].decode("utf-8", "replace") if head else None}
                if with_payload:
                    u.fill(body + size)
                    out["payload"] = u.data[start : body + size]
                yield [out[c] for c in self.names]
            at = u.end(cut + 4 + size + 4)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(self.path)
        types = {"payload": pa.binary(), "payload_bytes": pa.int64()}

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(self.names, zip(*rows, strict=True), strict=True)], names=list(self.names))

        for file in partition.files:
            with fs.open_input_file(file) as stream:
                rows, size = [], 0
                for row in self._records(stream, file):
                    rows.append(row)
                    size += 400 + (len(row[-1]) if self.names[-1] == "payload" else 0)
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)


class WarcSource(DataSource):
    """format("warc"). Options: path; payload ("true" adds the payload column); where (JSON: header columns and the values that they must have, null for any);
    pushdown ("true": filters of the one query that the frame serves are taken over); group_bytes; max_file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA + (", payload binary" if str(self.options.get("payload", "false")).lower() == "true" else "")

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """One record per page, as the writer takes them: WRITE_COLUMNS.

    pages: page_id (long), url, html and any others. The payload is the html in UTF-8, empty for null. Of records with equal payloads of at
    least least_bytes, those with the largest page_id are responses and the others revisit it; the rest are responses. Rows
    that repeat the largest page_id are responses all. Null page_ids are responses and nothing refers to them.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), body.alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    long = base.filter((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull())
    # max and count combine map-side; the join is one that adaptive execution can split where copies abound
    latest = long.groupBy("payload_digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = base.join(latest, "payload_digest", "left")
    again = F.coalesce(F.col("page_id") < F.col("latest"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    own = F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    return found.select(own.alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(again, urn(F.col("latest"))).alias("refers_to"), "payload_digest", "payload")


def archive(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    register(pages.sparkSession)
    records(pages, least_bytes).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = False, where: Mapping[str, Sequence[str] | None] | None = None, pushdown: bool = False) -> DataFrame:
    """Records of the archives below path. where: header columns (record_type, target_uri, ...) and the values that they must have, None for any; it is
    decided on the header, and what fails isn't decoded further. pushdown: the same for equalities and memberships in the filters of a query, for a
    frame that is used in one query only."""
    register(spark)
    source = spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", str(pushdown).lower())
    return source.option("where", json.dumps({k: None if v is None else list(v) for k, v in (where or {}).items()})).load(path)


def page_id(urn: str):
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
