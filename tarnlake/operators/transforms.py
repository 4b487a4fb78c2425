"""Partition transforms as Columns: identity, bucket, truncate, year, month, day, hour, void."""

from __future__ import annotations

import re
import struct
import uuid as uuid_
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = 0xFFFFFFFF


def murmur3(data: bytes) -> int:
    """MurmurHash3 x86 32 with seed 0, signed. Spark's own hash() has another seed and pads tails otherwise."""
    def rotate(x: int, r: int) -> int:
        return (x << r | x >> (32 - r)) & MASK

    def scrambled(k: int) -> int:
        return rotate(k * 0xCC9E2D51 & MASK, 15) * 0x1B873593 & MASK

    h, whole = 0, len(data) & ~3
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h = (rotate(h ^ scrambled(k), 13) * 5 + 0xE6546B64) & MASK
    if tail := data[whole:]:
        h ^= scrambled(int.from_bytes(tail, "little"))
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * by & MASK
    return h - (1 << 32) if h >> 31 else h


def hash_bytes(value: object) -> bytes | None:
    """What the bucket transform hashes: integers and times as 8 bytes, decimals as their least two's complement."""
    if value is None:
        return None
    if isinstance(value, bool | int):
        return struct.pack("<q", int(value))
    if isinstance(value, Decimal):
        n = int(value.scaleb(-value.as_tuple().exponent))
        return n.to_bytes((n if n >= 0 else ~n).bit_length() // 8 + 1, "big", signed=True)
    if isinstance(value, uuid_.UUID):
        return value.bytes
    return value.encode() if isinstance(value, str) else bytes(value)


def parse(text: str) -> tuple[str, int | None]:
    m = re.fullmatch(r"(identity|year|month|day|hour|void|bucket|truncate)(?:\[(\d+)\])?", text)
    if not m or (m[1] in ("bucket", "truncate")) != bool(m[2]) or m[2] == "0":
        raise ValueError(f"no transform {text!r}")
    return m[1], int(m[2]) if m[2] else None


def result_type(text: str, source: T.DataType) -> T.DataType:
    name, _ = parse(text)
    return source if name in ("identity", "truncate", "void") else T.IntegerType()


def apply(text: str, c: Column, kind: T.DataType) -> Column:
    name, n = parse(text)
    if name == "identity":
        return c
    if name == "void":
        return F.lit(None).cast(kind)
    if name == "truncate":
        if isinstance(kind, T.StringType):
            return F.substring(c, 1, n)
        if isinstance(kind, T.BinaryType):
            return F.substring(c, 1, n)
        width = F.lit(n).cast(kind) if not isinstance(kind, T.DecimalType) else F.lit(Decimal(n).scaleb(-kind.scale))
        return (c - F.pmod(c, width)).cast(kind)
    if name == "bucket":
        return _bucket(c, kind, n)
    if name == "year":
        return F.year(c) - 1970
    if name == "month":
        return (F.year(c) - 1970) * 12 + F.month(c) - 1
    if name == "day":
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
    return F.floor(F.unix_micros(c.cast("timestamp")) / 3_600_000_000).cast("int")


def _bucket(c: Column, kind: T.DataType, n: int) -> Column:
    if isinstance(kind, T.DateType):
        c, kind = F.unix_date(c).cast("long"), T.LongType()
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        c, kind = F.unix_micros(c.cast("timestamp")), T.LongType()
    elif isinstance(kind, T.IntegralType):
        c = c.cast("long")

    @F.pandas_udf(T.IntegerType())
    def bucket(values: pd.Series) -> pd.Series:
        known = {v: (murmur3(b) & 0x7FFFFFFF) % n for v in values.dropna().unique() if (b := hash_bytes(v if not hasattr(v, "item") else v.item())) is not None}
        return values.map(known).astype("Int32")

    return bucket(c)


def value_bounds(text: str, kind: T.DataType) -> bool:
    """Whether the transform keeps order, so that bounds of the source bound the result."""
    return parse(text)[0] not in ("bucket", "void")
