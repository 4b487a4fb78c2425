"""Statistics of files, zones and fragments, each set in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.plans.prune import ColumnStats

#: Code points that string bounds keep.
BOUND_LENGTH = 64


def has_bounds(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType | T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BooleanType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def aggregates(schema: T.StructType) -> list[Column]:
    """rows, and for each top-level primitive column: min, max (NaN apart), nulls, nans and whether bounds are exact."""
    # the empty set keeps groups in a hash map: with bounds of strings alone, Spark would sort whole rows first
    out = [(F.count("*") + F.size(F.collect_set(F.lit(None).cast("int")))).alias("rows")]
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        nulls = F.sum(c.isNull().cast("long")).alias("nulls")
        nans = F.sum(F.coalesce(F.isnan(c), F.lit(False)).cast("long")) if is_float(f.dataType) else F.lit(0).cast("long")
        if not has_bounds(f.dataType):
            out.append(F.struct(nulls, nans.alias("nans")).alias(f.name))
            continue
        v = F.when(~F.isnan(c), c) if is_float(f.dataType) else c
        low, high, exact = F.min(v), F.max(v), F.lit(True)
        if isinstance(f.dataType, T.StringType):
            exact = F.coalesce((F.char_length(low) <= BOUND_LENGTH) & (F.char_length(high) <= BOUND_LENGTH), F.lit(True))
            low, high = F.substring(low, 1, BOUND_LENGTH), F.substring(high, 1, BOUND_LENGTH)
        out.append(F.struct(low.alias("min"), high.alias("max"), nulls, nans.alias("nans"), exact.alias("exact")).alias(f.name))
    return out


def accessor(stats_schema: T.StructType, prefix: str = ""):
    """Column statistics out of a frame made by aggregates(); prefix: what their names begin with."""

    def find(name: str) -> ColumnStats | None:
        name = prefix + name
        if name not in stats_schema.fieldNames() or not isinstance(stats_schema[name].dataType, T.StructType):
            return None
        own, at = stats_schema[name].dataType.fieldNames(), F.col(f"`{name}`")
        if "max" not in own:
            return ColumnStats(nulls=at["nulls"], nans=at["nans"])
        high = at["max"]
        if isinstance(stats_schema[name].dataType["max"].dataType, T.StringType):
            # a cut upper bound lies below what it bounds: the highest character makes up for that
            high = F.when(at["exact"], high).otherwise(F.concat(high, F.lit("\U0010ffff")))
        return ColumnStats(at["min"], high, at["nulls"], at["nans"], at["exact"])

    return find


def order_flags(df: DataFrame, zone: str, position: str, name: str) -> DataFrame:
    """Per zone, whether a column is constant, sorted and strictly sorted by position; null where it holds nulls."""
    before = F.lag(name).over(Window.partitionBy(zone).orderBy(position))
    marked = df.select(zone, name, (F.col(name) >= before).alias("up"), (F.col(name) > before).alias("over"))
    full = F.count(F.when(F.col(name).isNull(), 1)) == 0
    return marked.groupBy(zone).agg(
        F.when(full, F.count_distinct(name) == 1).alias("constant"), F.when(full, F.coalesce(F.bool_and("up"), F.lit(True))).alias("sorted"), F.when(full, F.coalesce(F.bool_and("over"), F.lit(True))).alias("strict")
    )
