"""Avro in Spark: a data source for container files, and columns of framed messages."""

from __future__ import annotations

import json
import os
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from tarnlake.sources import avro_codec as codec

SPARK_TYPES = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType(), "enum": T.StringType(), "fixed": T.BinaryType()}


def open_fs(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def spark_type(s: Any) -> tuple[T.DataType, bool]:
    """Spark type and nullability of an Avro type. General unions become a struct of tag and branches."""
    kind = codec.kind_of(s)
    if kind == "union":
        some = [x for x in s if codec.kind_of(x) != "null"]
        if len(some) == 1:
            return spark_type(some[0])[0], len(s) > 1
        return T.StructType([T.StructField("tag", T.IntegerType()), *(T.StructField(f"b{i}", spark_type(x)[0]) for i, x in enumerate(s))]), True
    if kind == "record":
        return T.StructType([T.StructField(f["name"], *spark_type(f["type"])) for f in s["fields"]]), False
    if kind == "array":
        return T.ArrayType(*spark_type(s["items"])), False
    if kind == "map":
        return T.MapType(T.StringType(), *spark_type(s["values"])), False
    logical = s.get("logicalType", "") if isinstance(s, dict) else ""
    if logical == "decimal":
        return T.DecimalType(s["precision"], s.get("scale", 0)), False
    if logical == "date":
        return T.DateType(), False
    if "timestamp" in logical:
        return (T.TimestampNTZType() if logical.startswith("local") else T.TimestampType()), False
    if logical.startswith("time-"):
        return T.LongType(), False
    if logical == "duration":
        return T.StructType([T.StructField(n, T.LongType()) for n in ("months", "days", "millis")]), False
    return SPARK_TYPES[kind], kind == "null"


def avro_schema(t: T.StructType, name: str = "topLevelRecord") -> dict:
    """The Avro record of a Spark schema."""
    count = 0

    def one(k: T.DataType, nullable: bool) -> Any:
        nonlocal count
        if isinstance(k, T.StructType):
            count += 1
            own = f"{name}_{count}"
            out: Any = {"type": "record", "name": own, "fields": [{"name": f.name, "type": one(f.dataType, f.nullable)} for f in k.fields]}
        elif isinstance(k, T.ArrayType):
            out = {"type": "array", "items": one(k.elementType, k.containsNull)}
        elif isinstance(k, T.MapType):
            if not isinstance(k.keyType, T.StringType):
                raise TypeError("map keys are strings")
            out = {"type": "map", "values": one(k.valueType, k.valueContainsNull)}
        elif isinstance(k, T.DecimalType):
            out = {"type": "bytes", "logicalType": "decimal", "precision": k.precision, "scale": k.scale}
        elif isinstance(k, T.DateType):
            out = {"type": "int", "logicalType": "date"}
        elif isinstance(k, T.TimestampType):
            out = {"type": "long", "logicalType": "timestamp-micros"}
        elif isinstance(k, T.TimestampNTZType):
            out = {"type": "long", "logicalType": "local-timestamp-micros"}
        elif isinstance(k, T.NullType):
            return "null"
        else:
            names = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.BinaryType: "bytes", T.StringType: "string"}
            out = names[type(k)]
        return ["null", out] if nullable else out

    return {"type": "record", "name": name, "fields": [{"name": f.name, "type": one(f.dataType, f.nullable)} for f in t.fields]}


def plain(v: Any) -> Any:
    """Rows and their like as dicts and lists."""
    if isinstance(v, T.Row):
        return {k: plain(x) for k, x in zip(v.__fields__, v, strict=True)}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def shaped(v: Any, t: T.DataType) -> Any:
    """Decoded values in the shape that Spark takes for a type."""
    if v is None:
        return None
    if isinstance(t, T.StructType):
        if isinstance(v, tuple):
            return v
        return tuple(shaped(v.get(f.name), f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return [shaped(x, t.elementType) for x in v]
    if isinstance(t, T.MapType):
        return {k: shaped(x, t.valueType) for k, x in v.items()}
    return v


#: Bytes of a file that one task reads.
SPLIT = 32 << 20


@dataclass
class Part(InputPartition):
    """A range of a file: the blocks that begin in it."""

    path: str
    start: int = 0
    end: int = 0

    def __post_init__(self) -> None:
        super().__init__((self.path, self.start, self.end))


class AvroReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.schema, self.reader, self.split = options["path"], schema, options.get("readerschema"), int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        return [Part(p, at, at + self.split) for p, size in sized(self.path) for at in range(0, max(size, 1), self.split)] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = open_fs(self.path)
        wanted = json.loads(self.reader) if self.reader else None
        with fs.open_input_file(partition.path) as f:
            own = codec.flat_fields(codec.parse(codec.read_header(f)[0])) if wanted is None else None
            if own is None:
                for row in codec.read_rows(f, wanted, partition.start, partition.end):
                    yield tuple(shaped(row.get(x.name), x.dataType) for x in self.schema.fields)
                return
            arrow = to_arrow_schema(self.schema, timestamp_utc=True)
            decode = codec.column_decoder(own, frozenset(self.schema.fieldNames()))
            for n, data in codec.read_blocks(f, partition.start, partition.end):
                columns = decode(data, n)
                yield pa.RecordBatch.from_arrays([as_array(columns[x.name], x.type) if x.name in columns else pa.nulls(n, x.type) for x in arrow], schema=arrow)


def as_array(values: list, kind: pa.DataType) -> pa.Array:
    if pa.types.is_timestamp(kind) or pa.types.is_date(kind):
        return pa.array(values, pa.int64() if pa.types.is_timestamp(kind) else pa.int32()).view(kind)
    return pa.array(values, kind)


def sized(path: str) -> list[tuple[str, int]]:
    """Files and their sizes, in order."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = open_fs(path)
    info = fs.get_file_info(root)
    if info.type == FileType.File:
        return [(root, info.size)]
    return sorted((f.path, f.size) for f in fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.base_name.endswith(".avro"))


def files(path: str) -> list[str]:
    return [p for p, _ in sized(path)]


def as_list(column: pa.Array, kind: str) -> list:
    """Values as column_encoder() takes them: times as numbers, strings as their bytes."""
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us", column.type.tz)).view(pa.int64())
    elif pa.types.is_date32(column.type):
        column = column.view(pa.int32())
    elif kind in ("string", "bytes"):
        column = column.cast(pa.binary())
    return column.to_pylist()


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class AvroWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = options["path"], schema, overwrite
        self.codec, self.avro = options.get("compression", "deflate"), options.get("avroschema")
        self.job = f".{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = open_fs(self.path)
        schema = json.loads(self.avro) if self.avro else avro_schema(self.schema)
        fs.create_dir(posixpath.join(root, self.job), recursive=True)
        name, writer, out = f"part-{uuid.uuid4().hex}.avro", None, None
        own = codec.flat_fields(codec.parse(schema))
        encode = codec.column_encoder(own) if own else None
        for batch in (b for b in iterator if b.num_rows):
            if writer is None:
                out = fs.open_output_stream(posixpath.join(root, self.job, name))
                writer = codec.FileWriter(out, schema, self.codec)
            if encode:
                for b in encode([as_list(batch.column(name), kind) for name, kind, _ in own]):
                    writer.write_encoded(b)
            else:
                for row in batch.to_pylist(maps_as_pydicts="strict"):
                    writer.write(row)
        if writer is None:
            return Written(None)
        writer.flush()
        out.close()
        return Written(name)

    def commit(self, messages: Sequence[Written | None]) -> None:
        fs, root = open_fs(self.path)
        for p in files(self.path) if self.overwrite else []:
            if f"/{self.job}/" not in p:
                fs.delete_file(p)
        for m in messages:
            if m and m.name:
                fs.move(posixpath.join(root, self.job, m.name), posixpath.join(root, m.name))
        self.abort([])

    def abort(self, messages: Sequence[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = open_fs(self.path)
        if fs.get_file_info(posixpath.join(root, self.job)).type == FileType.Directory:
            fs.delete_dir(posixpath.join(root, self.job))


class AvroSource(DataSource):
    """format("avro_ocf"). Options: path; readerSchema; fields (JSON list of names or places to read); split (bytes to a task); avroSchema (for writing);
    compression (null, deflate, snappy, zstandard, lz4)."""

    @classmethod
    def name(cls) -> str:
        return "avro_ocf"

    def schema(self) -> T.StructType:
        found = self._whole()
        own = json.loads(self.options["fields"]) if "fields" in self.options else found.fieldNames()
        return T.StructType([found[c] for c in own])

    def _whole(self) -> T.StructType:
        if reader := self.options.get("readerschema"):
            return spark_type(codec.parse(reader))[0]
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        with open_fs(self.options["path"])[0].open_input_file(found[0]) as f:
            return spark_type(codec.parse(codec.read_header(f)[0]))[0]

    def reader(self, schema: T.StructType) -> AvroReader:
        return AvroReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> AvroWriter:
        return AvroWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AvroSource)


def read(spark: SparkSession, path: str, columns: Sequence[str] | Sequence[int] | None = None, skip: Sequence[str] = (), reader_schema: dict | str | None = None) -> DataFrame:
    """Rows of container files; columns by name or place, or all but some; resolved to a reader's schema if there is one."""
    register(spark)
    source = spark.read.format("avro_ocf")
    if reader_schema is not None:
        source = source.option("readerSchema", reader_schema if isinstance(reader_schema, str) else json.dumps(reader_schema))
    if columns is not None:  # the others are stepped over
        return source.option("fields", json.dumps(list(columns))).load(path)
    if skip:
        return source.option("fields", json.dumps([c for c in source.load(path).columns if c not in skip])).load(path)
    return source.load(path)


def write(df: DataFrame, path: str, compression: str = "deflate", schema: dict | None = None, mode: str = "append") -> None:
    register(df.sparkSession)
    out = df.write.format("avro_ocf").mode(mode).option("compression", compression)
    (out.option("avroSchema", json.dumps(schema)) if schema else out).save(path)


def encode(row: Column, schema: dict, wire: str = "single", key: int | None = None) -> Column:
    """A struct column as framed messages."""
    body, mark = schema, codec.fingerprint(schema) if wire == "single" else key

    @F.arrow_udf(T.BinaryType())
    def to_message(rows: pa.Array) -> pa.Array:
        own = codec.encoder(codec.parse(body))
        return pa.array([None if v is None else codec.frame(own(v), wire, mark) for v in rows.to_pylist(maps_as_pydicts="strict")], pa.binary())

    return to_message(row)


def decode(message: Column, schema: dict, wire: str = "single", store: codec.SchemaStore | None = None) -> Column:
    """Framed messages as structs of a reader's schema; writers' schemas come from the store, by fingerprint or id. Broken messages give null."""
    kind, known = spark_type(codec.parse(schema))[0], dict(store.known) if store else {codec.fingerprint(schema): codec.parse(schema)}

    arrow = to_arrow_type(kind, timestamp_utc=True)

    @F.arrow_udf(kind)
    def to_struct(messages: pa.Array) -> pa.Array:
        plans: dict = {}

        def one(v: bytes | None) -> Any:
            if v is None:
                return None
            try:
                key, body = codec.unframe(v, wire)
                if key not in plans:
                    writer = codec.parse(schema) if key is None else known[key]
                    plans[key] = codec.decoder(writer), codec.resolver(writer, codec.parse(schema))
                read_, fix = plans[key]
                return fix(read_(codec.Reader(body)))
            except (codec.AvroError, KeyError, IndexError, UnicodeDecodeError):
                return None

        return pa.array([one(v) for v in messages.to_pylist()], arrow)

    return to_struct(message)
