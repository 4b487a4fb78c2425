"""A dataset with zone statistics: rows keep their order and are cut into zones of equal size, each with statistics."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.registry import DEFAULT, Registry
from tarnlake.operators import stats as st
from tarnlake.operators.storage import Store
from tarnlake.plans import compile as comp
from tarnlake.plans.expr import Expr
from tarnlake.plans.prune import can_match

ZONE, POSITION = "_zone", "_position"


def plain_bytes(f: T.StructField) -> Column:
    """Bytes that the values of a column take unpacked: strings and binaries by their length, others by their type."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long")
    width = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4, "long": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "decimal": 16}.get(f.dataType.typeName())
    return F.count(c) * width if width else F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(c)))), F.lit(0)).cast("long")


class ZonedDataset:
    """data/ holds the rows in folders of many zones each, with their position; stats/ holds a row per zone."""

    def __init__(self, spark: SparkSession, path: str, registry: Registry = DEFAULT) -> None:
        self.spark, self.store, self.registry = spark, Store(spark, path), registry
        self.info = self.store.read_json("_zones.json") if self.store.exists("_zones.json") else None

    @classmethod
    def write(cls, df: DataFrame, path: str, order_by: str | list[str], zone_rows: int = 8192) -> ZonedDataset:
        """Rows get consecutive positions in the given order: range-partitioned, sorted, and numbered from partition sizes."""
        ds = cls(df.sparkSession, path)
        keys = [order_by] if isinstance(order_by, str) else order_by
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(ds.store.uri("_stage"))
        names = {f"part-{n.split('-')[1]}": n for n in ds.store.names("_stage") if n.startswith("part-")}
        staged = ds.spark.read.schema(df.schema).parquet(ds.store.uri("_stage")).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        sizes = {r["__file"]: r["n"] for r in staged.groupBy("__file").agg(F.count("*").alias("n")).collect()}
        offsets, total = [], 0
        for _, n in sorted(names.items()):
            offsets.append((n, total))
            total += sizes.get(n, 0)
        starts = ds.spark.createDataFrame(offsets, "__file string, __first long")
        rows = staged.join(starts, "__file").withColumn(POSITION, F.col("__first") + F.col("__row")).drop("__file", "__row", "__first").withColumn(ZONE, F.floor(F.col(POSITION) / zone_rows).cast("long"))
        rows.repartitionByRange(POSITION).sortWithinPartitions(POSITION).write.parquet(ds.store.uri("data"))
        ds.store.delete("_stage")
        ds.info = {"schema": df.schema.json(), "zone_rows": zone_rows, "rows": total}
        ds._rows().groupBy(ZONE).agg(*st.aggregates(df.schema), *[F.try_sum(f"`{f.name}`").alias(f"_sum_{f.name}") for f in df.schema.fields if isinstance(f.dataType, T.NumericType)], *[plain_bytes(f).alias(f"_bytes_{f.name}") for f in df.schema.fields]).coalesce(1).write.parquet(ds.store.uri("stats"))
        ds.store.write("_zones.json", json.dumps(ds.info))
        return ds

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.info["schema"]))

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(POSITION, T.LongType()), T.StructField(ZONE, T.LongType())])).parquet(self.store.uri("data"))

    def stats(self) -> DataFrame:
        return self.spark.read.parquet(self.store.uri("stats"))

    def column_stats(self, column: str) -> DataFrame:
        """Per zone: rows, min, max, nulls, nans, exact, sum, bytes (of the values, unpacked), and whether the column is constant, sorted, strictly sorted."""
        s = self.stats()
        total = [F.col(f"_sum_{column}").alias("sum")] if f"_sum_{column}" in s.columns else []
        return s.select(ZONE, "rows", f"{column}.*", *total, F.col(f"_bytes_{column}").alias("bytes")).join(st.order_flags(self._rows(), ZONE, POSITION, column), ZONE)

    def zones(self, filter_: Expr) -> list[int]:
        """The zones that can hold matching rows."""
        s = self.stats()
        return sorted(r[ZONE] for r in s.filter(can_match(filter_, self.schema, F.col("rows"), st.accessor(s.schema))).select(ZONE).collect())

    def read(self, columns: list[str] | list[int] | None = None, filter_: Expr | None = None, zones: Iterable[int] | None = None, offset: int | None = None, count: int | None = None) -> DataFrame:
        """Any of: columns by name or place; a filter; explicit zones; and rows [offset, offset + count), clamped. Zones and positions push
        down to the sorted files' statistics; neighbouring zones merge into ranges."""
        df = self._rows()
        chosen = None if zones is None else set(zones)
        if filter_ is not None:
            able = set(self.zones(filter_))
            chosen = able if chosen is None else chosen & able
        if chosen is not None:
            df = df.filter(self._ranges(sorted(chosen)))
        if offset is not None or count is not None:
            lo = max(0, offset or 0)
            hi = self.info["rows"] if count is None else min(self.info["rows"], (offset or 0) + count)
            df = df.filter((F.col(POSITION) >= lo) & (F.col(POSITION) < hi))
        names = self.schema.fieldNames()
        picked = None if columns is None else [names[c] if isinstance(c, int) else c for c in columns]
        return comp.apply(df.drop(POSITION, ZONE) if picked is None else df, filter_, picked, self.registry)

    @staticmethod
    def _ranges(zones: list[int]) -> Column:
        runs: list[list[int]] = []
        for z in zones:
            if runs and runs[-1][1] == z - 1:
                runs[-1][1] = z
            else:
                runs.append([z, z])
        out = F.lit(False)
        for a, b in runs:
            out = out | F.col(ZONE).between(a, b)
        return out
