"""Files of a table as a DataFrame with row addresses, and the removal of deleted rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators.storage import Store

#: Every write gets a folder of its own below data/, which readers see as a partition.
BATCH = "_batch"
PATH, ROW = "__path", "__row"


def relative(store: Store, column: Column) -> Column:
    """Path below the table's root, URI-encoded."""
    root = urlparse(store.root).path.rstrip("/") + "/"
    return F.substr(column, F.locate(root, column) + F.lit(len(root)))


def read_placed(store: Store, spark: SparkSession, files: Sequence[tuple[str, dict[str, str | None]]], schema: T.StructType, partitions: Sequence[str], addresses: bool = False) -> DataFrame:
    """Rows of files that lie anywhere below the table: their partition values come with their paths, not from folders."""
    own = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields if f.name not in partitions])
    df = spark.read.schema(own).option("recursiveFileLookup", "true").parquet(*[store.uri(p) for p, _ in files])
    df = df.select("*", relative(store, F.col("_metadata.file_path")).alias(PATH), F.col("_metadata.row_index").alias(ROW))
    if partitions:
        values = spark.createDataFrame([(p, *[v.get(c) for c in partitions]) for p, v in files], T.StructType([T.StructField(PATH, T.StringType()), *(T.StructField(c, T.StringType()) for c in partitions)]))
        df = df.join(values, PATH)
    names = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in partitions else F.col(f"`{f.name}`") for f in schema.fields]
    return df.select(*names, *([PATH, ROW] if addresses else []))


def read_files(store: Store, spark: SparkSession, paths: Sequence[str], schema: T.StructType, addresses: bool = False, partitioned: bool = True) -> DataFrame:
    """Rows of some files, partition columns from their folders (unless partitioned is false: then folders may differ in kind). Narrower types in old files widen; columns that they lack are null."""
    fields = [T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields]
    full = T.StructType([*fields, T.StructField(BATCH, T.StringType())])
    if not paths:
        df = spark.createDataFrame([], full).withColumns({PATH: F.lit(""), ROW: F.lit(0).cast("long")})
        return df.drop(BATCH) if addresses else df.select(*[F.col(f"`{f.name}`") for f in fields])
    reader = spark.read.schema(full).option("basePath", store.uri("data")) if partitioned else spark.read.schema(T.StructType(fields)).option("recursiveFileLookup", "true")
    df = reader.parquet(*map(store.uri, paths))
    names = [F.col(f"`{f.name}`") for f in fields]
    return df.select(*names, relative(store, F.col("_metadata.file_path")).alias(PATH), F.col("_metadata.row_index").alias(ROW)) if addresses else df.select(*names)


#: Deleted rows up to which every task gets them all.
BROADCAST = 1_000_000


def without(df: DataFrame, deleted: DataFrame | None, paths: Sequence[str], many: int) -> DataFrame:
    """Drop the addressed rows; deleted: path, row; paths: all files of df; many: how many rows are deleted. Files join by number and rows
    as words of 64, so that dense deletes stay small and a task never hashes more than a word for 64 of its rows, nor sorts these."""
    if deleted is None:
        return df
    numbers = F.broadcast(df.sparkSession.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), f"{PATH} string, __file int"))
    word, bit = (lambda r: F.shiftright(r, 6)), (lambda r: F.pmod(r, F.lit(64)).cast("int"))
    gone = deleted.withColumnRenamed("path", PATH).join(numbers, PATH).groupBy("__file", word(F.col("row")).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("row")))).alias("__gone"))
    gone = F.broadcast(gone) if many <= BROADCAST else gone.hint("shuffle_hash")
    marked = df.join(numbers, PATH).withColumn("__word", word(F.col(ROW))).join(gone, ["__file", "__word"], "left")
    return marked.filter(F.col("__gone").isNull() | (F.getbit("__gone", bit(F.col(ROW))) == 0)).select(*[F.col(f"`{c}`") for c in df.columns])


def numbered(store: Store, df: DataFrame, name: str) -> DataFrame:
    """Rows with consecutive numbers from 0 in column `name`. They are staged first, so that numbers don't change when a task is run again."""
    spark, stage = df.sparkSession, f"_stage/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(store.uri(stage))
    staged = spark.read.schema(df.schema).parquet(store.uri(stage)).select("*", F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(ROW))
    sizes = staged.groupBy(PATH).agg((F.max(ROW) + 1).alias("n")).orderBy(PATH).collect()  # one row per file
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r[PATH], total))
        total += r["n"]
    starts = spark.createDataFrame(offsets, f"{PATH} string, first long")
    return staged.join(starts, PATH).withColumn(name, F.col("first") + F.col(ROW)).drop(PATH, ROW, "first")


Batches = Callable[[pa.RecordBatch], pa.Array]


def flagged(df: DataFrame, test: Batches, name: str) -> DataFrame:
    """df with a boolean column: what a function over record batches says of each row; null counts as false. It sees the columns of df but for addresses."""
    shown = [c for c in df.columns if c not in (PATH, ROW)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = test(b.select(shown))
            said = said.combine_chunks() if isinstance(said, pa.ChunkedArray) else said
            yield pa.RecordBatch.from_arrays([*b.columns, pc.fill_null(said.cast(pa.bool_()), False)], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))


def changed_by(df: DataFrame, change: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """Rows as a function over record batches changes them; columns that it leaves out stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = change(b)
            if new.num_rows != b.num_rows:
                raise ValueError(f"{b.num_rows} rows became {new.num_rows}")
            have = dict(zip(new.schema.names, new.columns, strict=True))
            yield pa.RecordBatch.from_arrays([have.get(f.name, b.column(f.name)).cast(b.schema.field(f.name).type) for f in schema.fields], names=schema.fieldNames())

    return df.select(*[F.col(f"`{c}`") for c in schema.fieldNames()]).mapInArrow(run, schema)
