"""Trees to Spark Columns, with exact three-valued logic: incomparable operands compare to null, where ANSI casts would raise."""

from __future__ import annotations

import datetime as dt
import decimal
import uuid
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.registry import DEFAULT, Registry
from tarnlake.plans.binding import BindingError, field_type
from tarnlake.plans.expr import All, Any_, Bound, Call, Compare, Const, Expr, In, Lit, Not, Ref, Test

Typed = tuple[Column, T.DataType | None]


def literal(e: Lit) -> Typed:
    v, kind = e.value, None
    if isinstance(v, bool):
        kind = T.BooleanType()
    elif isinstance(v, int):
        kind = T.IntegerType() if -(1 << 31) <= v < 1 << 31 else T.LongType() if -(1 << 63) <= v < 1 << 63 else T.DecimalType(38, 0)
        v = decimal.Decimal(v) if isinstance(kind, T.DecimalType) else v
    elif isinstance(v, float):
        kind = T.DoubleType()
    elif isinstance(v, decimal.Decimal):
        scale = max(0, -v.as_tuple().exponent)
        kind = T.DecimalType(min(38, max(len(v.as_tuple().digits), scale + 1)), scale)
    elif isinstance(v, uuid.UUID):
        v, kind = str(v), T.StringType()
    elif isinstance(v, str):
        kind = T.StringType()
    elif isinstance(v, bytes | bytearray):
        v, kind = bytes(v), T.BinaryType()
    elif isinstance(v, dt.datetime):
        kind = T.TimestampType() if v.tzinfo else T.TimestampNTZType()
    elif isinstance(v, dt.date):
        kind = T.DateType()
    elif isinstance(v, dt.time):  # times of day are microseconds
        v, kind = ((v.hour * 60 + v.minute) * 60 + v.second) * 1_000_000 + v.microsecond, T.LongType()
    if e.type:
        kind = T._parse_datatype_string(e.type) if hasattr(T, "_parse_datatype_string") else kind
        return F.lit(v).cast(e.type), kind
    return (F.lit(v).cast(kind) if kind else F.lit(None)), kind


def family(kind: T.DataType | None) -> str:
    """Types of a family compare with each other."""
    if kind is None or isinstance(kind, T.NullType):
        return "any"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType | T.CharType | T.VarcharType):
        return "string"
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    return kind.typeName()


def comparable(a: T.DataType | None, b: T.DataType | None) -> bool:
    return "any" in (family(a), family(b)) or family(a) == family(b)


class Compiler:
    def __init__(self, schema: T.StructType, registry: Registry = DEFAULT, strict: bool = True) -> None:
        self.schema, self.registry, self.strict = schema, registry, strict

    def value(self, e: Expr) -> Typed:
        """An expression and its type, where that is known."""
        if isinstance(e, Ref | Bound):
            kind = field_type(self.schema, e.name)
            if kind is None:
                if self.strict:
                    raise BindingError(e.name)
                return F.lit(None), None
            parts = [e.name] if e.name in self.schema.fieldNames() else e.name.split(".")
            return F.col(".".join(f"`{p}`" for p in parts)), kind
        if isinstance(e, Lit):
            return literal(e)
        if isinstance(e, Call):
            if e.name.lower() in ("cast", "try_cast"):  # the type is a constant
                c, to = self.value(e.args[0])[0], e.args[1].value
                return (c.cast(to) if e.name.lower() == "cast" else c.try_cast(to)), None
            return self.registry.invoke(e.name, *(self.value(a)[0] for a in e.args)), None
        return self.predicate(e), T.BooleanType()

    def predicate(self, e: Expr) -> Column:
        if isinstance(e, Const):
            return F.lit(e.value)
        if isinstance(e, All | Any_):
            parts = [self.predicate(p) for p in e.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(e, All) else out | p
            return out
        if isinstance(e, Not):
            return ~self.predicate(e.part)
        if isinstance(e, Compare):
            return self._compare(e.op, self.value(e.left), self.value(e.right))
        if isinstance(e, Test):
            c, kind = self.value(e.part)
            if e.kind in ("null", "not null"):
                return c.isNull() if e.kind == "null" else c.isNotNull()
            nan = F.isnan(c) if kind is None or isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else F.lit(False)
            return F.coalesce(nan, F.lit(False)) if e.kind == "nan" else F.when(c.isNotNull(), ~nan)
        if isinstance(e, In):
            c, kind = self.value(e.part)
            values = [literal(v) for v in e.values]
            fitting = [v for v, k in values if k is not None and comparable(kind, k)]
            missing = any(k is None for _, k in values)
            if not fitting:
                return F.when(c.isNotNull() & F.lit(not missing), F.lit(False))
            return c.isin(*fitting, *([F.lit(None)] if missing else []))
        if isinstance(e, Lit) and (e.value is None or isinstance(e.value, bool)):
            return F.lit(e.value).cast("boolean")
        return self.value(e)[0]  # a boolean column or call

    def _compare(self, op: str, left: Typed, right: Typed) -> Column:
        (a, ka), (b, kb) = left, right
        if op == "<=>":
            return a.eqNullSafe(b) if comparable(ka, kb) else a.isNull() & b.isNull()
        if not comparable(ka, kb):
            return F.lit(None).cast("boolean")
        if op == "starts":
            if family(ka) not in ("string", "any") or family(kb) not in ("string", "any"):
                return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
            return F.startswith(a, b) if not isinstance(ka, T.NullType) and ka is not None else F.lit(None).cast("boolean")
        return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def predicate(e: Expr, schema: T.StructType, registry: Registry = DEFAULT, strict: bool = True) -> Column:
    """A boolean Column; df.filter() keeps the rows where it is true."""
    return Compiler(schema, registry, strict).predicate(e)


def expression(e: Expr, schema: T.StructType, registry: Registry = DEFAULT) -> Column:
    return Compiler(schema, registry).value(e)[0]


def apply(df: Any, filter_: Expr | Column | str | None = None, columns: list[str] | None = None, registry: Registry = DEFAULT) -> Any:
    """Filter, then project. A projection may leave out what the filter reads; unknown, repeated and no columns are refused."""
    if filter_ is not None:
        df = df.filter(predicate(filter_, df.schema, registry) if isinstance(filter_, Expr) else filter_)
    if columns is None:
        return df
    if not columns or len(set(columns)) < len(columns):
        raise ValueError("a projection needs columns, each once")
    if unknown := [c for c in columns if field_type(df.schema, c) is None]:
        raise BindingError(", ".join(unknown))
    return df.select(*columns)
