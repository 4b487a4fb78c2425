"""Parquet and ORC scans and sinks, on Spark's own readers and writers."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.plans import compile as comp
from tarnlake.plans.expr import Expr


def with_settings(spark: SparkSession, settings: Mapping[str, object]) -> SparkSession:
    """A session like this one, over the same context, that has settings of its own."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in settings.items():
        own.conf.set(k, str(v))
    return own


def scan_parquet(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, filter_: Expr | None = None, batch_rows: int | None = None, verify_checksums: bool = False) -> DataFrame:
    """Projection and filter reach the scan, which skips row groups and pages by statistics and Bloom filters; the filter is then exact. Dotted names reach into structs."""
    if batch_rows:
        spark = with_settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": batch_rows})
    reader = spark.read.option("parquet.page.verify-checksum.enabled", str(verify_checksums).lower())
    return comp.apply(reader.parquet(*paths), filter_, list(columns) if columns is not None else None)


def scan_orc(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, filter_: Expr | None = None, batch_rows: int | None = None) -> DataFrame:
    if batch_rows:
        spark = with_settings(spark, {"spark.sql.orc.columnarReaderBatchSize": batch_rows})
    return comp.apply(spark.read.orc(*paths), filter_, list(columns) if columns is not None else None)


def row_group(spark: SparkSession, path: str | Sequence[str], index: int, columns: Sequence[str] | None = None) -> DataFrame:
    """One row group of a file, or that of each of some files which has so many, by the rows that the footers give it."""
    paths, spans = [path] if isinstance(path, str) else list(path), []
    for p in paths:
        sizes = [g["rows"] for g in parquet_metadata(p)["row_groups"]]
        if 0 <= index < len(sizes):
            spans.append((p, sum(sizes[:index]), sum(sizes[: index + 1])))
    if not spans:
        raise IndexError(index)
    df, row = spark.read.parquet(*[p for p, _, _ in spans]), F.col("_metadata.row_index")
    if len(spans) == 1:
        df = df.filter((row >= spans[0][1]) & (row < spans[0][2]))
    else:
        own = spark.createDataFrame([(posixpath.basename(p), lo, hi) for p, lo, hi in spans], "__name string, __lo long, __hi long")
        df = df.select("*", F.col("_metadata.file_name").alias("__name"), row.alias("__row")).join(F.broadcast(own), "__name").filter("__row >= __lo and __row < __hi").drop("__name", "__row", "__lo", "__hi")
    return df.select(*columns) if columns else df


def _file(path: str):
    from pyarrow import fs

    found, rel = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found.open_input_file(rel)


def parquet_metadata(path: str) -> dict:
    """What a footer says: rows, schema, key-value metadata, and per row group rows and column statistics."""
    import pyarrow.parquet as pq

    with _file(path) as f:
        meta = pq.read_metadata(f)
    groups = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        columns = {}
        for c in range(group.num_columns):
            s = group.column(c).statistics
            bounded = s is not None and s.has_min_max and group.column(c).physical_type != "INT96"
            columns[group.column(c).path_in_schema] = {"min": s.min if bounded else None, "max": s.max if bounded else None, "nulls": s.null_count if s is not None and s.has_null_count else None, "compressed": group.column(c).total_compressed_size, "codec": group.column(c).compression}
        groups.append({"rows": group.num_rows, "bytes": group.total_byte_size, "columns": columns})
    return {"rows": meta.num_rows, "created_by": meta.created_by, "schema": str(meta.schema.to_arrow_schema()), "metadata": {k.decode(): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items()}, "row_groups": groups}


def orc_metadata(path: str) -> dict:
    """What a footer says. Rows by stripe are asked of Spark's own ORC reader, where a session is active."""
    from pyarrow import orc

    with _file(path) as f:
        o = orc.ORCFile(f)
        out = {"rows": o.nrows, "stripes": o.nstripes, "compression": str(o.compression), "schema": str(o.schema), "row_index_stride": o.row_index_stride, "metadata": {k.decode(): v.decode("utf-8", "replace") for k, v in (o.metadata or {}).items()}}
    spark = SparkSession.getActiveSession()
    if spark is not None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        try:
            out["stripe_rows"] = [s.getNumberOfRows() for s in reader.getStripes()]
        finally:
            reader.close()
    return out


def candidate_groups(path: str, column: str, *values: object) -> list[int]:
    """Row groups that can hold one of the values, by their bounds."""
    out = []
    for k, g in enumerate(parquet_metadata(path)["row_groups"]):
        s = g["columns"].get(column)
        if s is None or s["min"] is None or any(s["min"] <= v <= s["max"] for v in values):
            out.append(k)
    return out


def bloom_groups(spark: SparkSession, path: str, column: str, *values: int | float | str | bytes) -> list[int]:
    """Row groups whose bounds and Bloom filters allow one of the values; groups without a filter go by their bounds. Only the footer
    and the filters are read."""
    import struct

    import xxhash

    jvm, kept, out = spark._jvm, set(candidate_groups(path, column, *values)), []
    hadoop = jvm.org.apache.parquet.hadoop
    packed = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()))
    try:
        for k, block in enumerate(reader.getFooter().getBlocks()):
            chunk = next(c for c in block.getColumns() if c.getPath().toDotString() == column)
            bloom = reader.getBloomFilterDataReader(block).readBloomFilter(chunk) if k in kept else None
            if bloom is not None:
                form = packed.get(str(chunk.getPrimitiveType().getPrimitiveTypeName()))
                plain = [struct.pack(form, v) if form else v.encode() if isinstance(v, str) else v for v in values]
                if not any(bloom.findHash(struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(b)))[0]) for b in plain):
                    continue
            if k in kept:
                out.append(k)
    finally:
        reader.close()
    return out


def bloom_stripes(spark: SparkSession, path: str, column: str, *values: int | float | str) -> list[int]:
    """Stripes of an ORC file of which a row group's Bloom filter allows one of the values; all, if the column has none."""
    jvm, orc, gateway = spark._jvm, spark._jvm.org.apache.orc, spark.sparkContext._gateway
    reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    rows, out = reader.rows(), []
    try:
        kind = reader.getSchema().findSubtype(column)
        k, many = kind.getId(), reader.getSchema().getMaximumId() + 1
        flags = gateway.new_array(gateway.jvm.boolean, many)
        for i in range(many):
            flags[i] = i in (0, k)
        for stripe in range(reader.getStripes().size()):
            index = rows.readRowIndex(stripe, flags, flags)
            filters = index.getBloomFilterIndex()[k]
            if filters is None:
                out.append(stripe)
                continue
            for g in range(filters.getBloomFilterCount()):
                bloom = orc.util.BloomFilterIO.deserialize(index.getBloomFilterKinds()[k], orc.OrcProto.ColumnEncoding.getDefaultInstance(), reader.getWriterVersion(), kind.getCategory(), filters.getBloomFilter(g))
                test = bloom.testString if isinstance(values[0], str) else bloom.testDouble if isinstance(values[0], float) else bloom.testLong
                if any(test(v) for v in values):
                    out.append(stripe)
                    break
    finally:
        rows.close()
        reader.close()
    return out


@dataclass(frozen=True)
class WriteOptions:
    """compression and level; row group or stripe size; encodings: version 2 pages take delta and byte-stream-split; dictionary per column;
    Bloom filters on columns; files: how many, or at most so many rows each."""

    compression: str = "zstd"
    level: int | None = None
    group_bytes: int | None = None
    max_rows_per_file: int | None = None
    files: int | None = None
    version2: bool = False
    dictionary: Mapping[str, bool] = field(default_factory=dict)
    bloom: Sequence[str] = ()
    bloom_fpp: float = 0.05
    sort_by: Sequence[str] = ()
    partition_by: Sequence[str] = ()


def _shaped(df: DataFrame, o: WriteOptions) -> DataFrame:
    df = df.repartition(o.files) if o.files else df
    return df.sortWithinPartitions(*o.sort_by) if o.sort_by else df


def write_parquet(df: DataFrame, path: str, options: WriteOptions | None = None, mode: str = "errorifexists") -> None:
    o = options or WriteOptions()
    out = _shaped(df, o).write.mode(mode).option("compression", o.compression).option("parquet.writer.version", "v2" if o.version2 else "v1")
    settings = {"parquet.block.size": o.group_bytes, "maxRecordsPerFile": o.max_rows_per_file, "parquet.compression.codec.zstd.level": o.level}
    settings |= {f"parquet.enable.dictionary#{c}": str(on).lower() for c, on in o.dictionary.items()}
    settings |= {k: v for c in o.bloom for k, v in ((f"parquet.bloom.filter.enabled#{c}", "true"), (f"parquet.bloom.filter.fpp#{c}", o.bloom_fpp))}
    for k, v in settings.items():
        if v is not None:
            out = out.option(k, v)
    (out.partitionBy(*o.partition_by) if o.partition_by else out).parquet(path)


def write_orc(df: DataFrame, path: str, options: WriteOptions | None = None, mode: str = "errorifexists", stride: int = 10_000, dictionary_share: float | None = None) -> None:
    o = options or WriteOptions()
    out = _shaped(df, o).write.mode(mode).option("compression", o.compression).option("orc.row.index.stride", stride)
    settings = {"orc.stripe.size": o.group_bytes, "maxRecordsPerFile": o.max_rows_per_file, "orc.dictionary.key.threshold": dictionary_share}
    settings |= {"orc.bloom.filter.columns": ",".join(o.bloom), "orc.bloom.filter.fpp": o.bloom_fpp} if o.bloom else {}
    for k, v in settings.items():
        if v is not None:
            out = out.option(k, v)
    (out.partitionBy(*o.partition_by) if o.partition_by else out).orc(path)
