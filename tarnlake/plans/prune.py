"""Data skipping: a predicate becomes tests over rows of statistics.

For each predicate three Columns say whether a unit (file, zone, fragment) can hold a row where it is true, false or null.
NOT swaps the first two, AND and OR combine them as Kleene's tables do, so skipping stays sound under any nesting. A unit is
skipped only if it can't hold a true row. Missing statistics allow everything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.plans.binding import field_type
from tarnlake.plans.compile import comparable, family, literal
from tarnlake.plans.expr import All, Any_, Bound, Compare, Const, Expr, In, Lit, Not, Ref, Test

FLIPPED = {"=": "=", "<>": "<>", "<": ">", "<=": ">=", ">": "<", ">=": "<=", "<=>": "<=>"}


@dataclass(frozen=True)
class ColumnStats:
    """Columns of a statistics row about one data column; None where nothing is kept. low and high bound what isn't null
    or NaN; they are exact unless truncated."""

    low: Column | None = None
    high: Column | None = None
    nulls: Column | None = None
    nans: Column | None = None
    exact: Column | None = None


Accessor = Callable[[str], ColumnStats | None]


@dataclass(frozen=True)
class Possible:
    true: Column
    false: Column
    null: Column


def _or(c: Column, otherwise: bool) -> Column:
    return F.coalesce(c, F.lit(otherwise))



class Pruner:
    def __init__(self, schema: T.StructType, rows: Column, accessor: Accessor) -> None:
        self.schema, self.rows, self.accessor = schema, rows, accessor

    def unknown(self) -> Possible:
        return Possible(F.lit(True), F.lit(True), F.lit(True))

    def possible(self, e: Expr) -> Possible:
        if isinstance(e, Const):
            return Possible(F.lit(e.value), F.lit(not e.value), F.lit(False))
        if isinstance(e, Not):
            p = self.possible(e.part)
            return Possible(p.false, p.true, p.null)
        if isinstance(e, All | Any_):
            out = self.possible(e.parts[0])
            for part in e.parts[1:]:
                p = self.possible(part)
                if isinstance(e, All):
                    null = out.null & (p.true | p.null) | p.null & (out.true | out.null)
                    out = Possible(out.true & p.true, out.false | p.false, null)
                else:
                    null = out.null & (p.false | p.null) | p.null & (out.false | out.null)
                    out = Possible(out.true | p.true, out.false & p.false, null)
            return out
        if isinstance(e, Compare):
            return self._compare(e.op, e.left, e.right)
        if isinstance(e, Test):
            return self._test(e)
        if isinstance(e, In):
            return self._in(e)
        return self.unknown()

    def _stats(self, e: Expr) -> tuple[ColumnStats, T.DataType] | None:
        if not isinstance(e, Ref | Bound):
            return None
        kind, stats = field_type(self.schema, e.name), self.accessor(e.name)
        return None if kind is None or stats is None else (stats, kind)

    def _nulls(self, s: ColumnStats) -> tuple[Column, Column]:
        """Whether there can be nulls, and values."""
        if s.nulls is None:
            return F.lit(True), F.lit(True)
        return _or(s.nulls > 0, True), _or(s.nulls < self.rows, True)

    def _nans(self, s: ColumnStats, kind: T.DataType) -> Column:
        if not isinstance(kind, T.FloatType | T.DoubleType):
            return F.lit(False)
        return F.lit(True) if s.nans is None else _or(s.nans > 0, True)

    def _compare(self, op: str, left: Expr, right: Expr) -> Possible:
        if isinstance(left, Lit) and isinstance(right, Lit):
            return self._fold(op, left, right)
        if isinstance(left, Lit) and op in FLIPPED:
            op, left, right = FLIPPED[op], right, left
        found = self._stats(left)
        if found is None or not isinstance(right, Lit):
            return self.unknown()
        s, kind = found
        v, vk = literal(right)
        nulls, values = self._nulls(s)
        if vk is None:  # against null
            return Possible(nulls, values, F.lit(False)) if op == "<=>" else Possible(F.lit(False), F.lit(False), F.lit(True))
        if not comparable(kind, vk):
            return Possible(F.lit(False), values | nulls, F.lit(False)) if op == "<=>" else Possible(F.lit(False), F.lit(False), F.lit(True))
        if isinstance(vk, T.DecimalType) != isinstance(kind, T.DecimalType) and family(kind) == "number":
            return self.unknown()
        nan, is_nan = self._nans(s, kind), F.lit(isinstance(right.value, float) and right.value != right.value)
        exact = F.lit(True) if s.exact is None else _or(s.exact, False)
        if s.low is None or s.high is None:
            t = f = values
        else:
            low, high = s.low, s.high
            same = exact & (low == v) & (high == v) & ~nan
            # NaN is above every number, and equal to itself
            tests = {
                "=": ((low <= v) & (high >= v) | nan & is_nan, ~same),
                "<>": (~same, (low <= v) & (high >= v) | nan & is_nan),
                "<": (low < v, (high >= v) | nan),
                "<=": (low <= v, (high > v) | nan & ~is_nan),
                ">": ((high > v) | nan & ~is_nan, low <= v),
                ">=": ((high >= v) | nan, low < v),
            }
            tests["<=>"] = tests["="]
            if op == "starts":
                if family(kind) != "string" or family(vk) != "string":
                    return self.unknown()
                n = len(right.value)
                inside = exact & (F.substring(low, 1, n) == v) & (F.substring(high, 1, n) == v) if n else F.lit(True)
                t, f = (F.substring(low, 1, n) <= v) & (~exact | (high >= v)), ~inside
            else:
                t, f = tests[op]
            # truncated upper bounds may lie below what they bound
            t, f = (values & (_or(x, True)) for x in (t, f))
        if op == "<=>":
            return Possible(t, f | nulls, F.lit(False))
        return Possible(t, f, nulls)

    def _fold(self, op: str, left: Lit, right: Lit) -> Possible:
        (a, ka), (b, kb) = literal(left), literal(right)
        if op == "<=>":
            c = a.eqNullSafe(b) if comparable(ka, kb) else F.lit(False)
        elif not comparable(ka, kb) or ka is None or kb is None:
            return Possible(F.lit(False), F.lit(False), F.lit(True))
        else:
            c = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "starts": F.startswith(a.cast("string"), b.cast("string"))}[op]
        return Possible(_or(c, False), _or(~c, False), c.isNull())

    def _test(self, e: Test) -> Possible:
        found = self._stats(e.part)
        if found is None:
            return Possible(F.lit(True), F.lit(True), F.lit(e.kind == "not nan"))
        s, kind = found
        nulls, values = self._nulls(s)
        if e.kind == "null":
            return Possible(nulls, values, F.lit(False))
        if e.kind == "not null":
            return Possible(values, nulls, F.lit(False))
        nan = self._nans(s, kind)
        numbers = values if s.nans is None or s.nulls is None else _or(s.nans + s.nulls < self.rows, True)
        return Possible(nan, numbers | nulls, F.lit(False)) if e.kind == "nan" else Possible(numbers, nan, nulls)

    def _in(self, e: In) -> Possible:
        if not e.values:
            found = self._stats(e.part)
            nulls, values = self._nulls(found[0]) if found else (F.lit(True), F.lit(True))
            return Possible(F.lit(False), values, nulls)
        parts = [self._compare("=", e.part, v) for v in e.values if v.value is not None]
        null = self._nulls(found[0])[0] if (found := self._stats(e.part)) else F.lit(True)
        if len(parts) < len(e.values):
            null = F.lit(True)
        true, false = F.lit(False), F.lit(True)
        for p in parts:
            true, false = true | p.true, false & (p.false | p.null)
        return Possible(true, false, null)


def decision(e: Expr, schema: T.StructType, rows: Column, accessor: Accessor) -> Column:
    """'always false', 'always true' or 'unknown' per row of statistics."""
    p = Pruner(schema, rows, accessor).possible(e)
    return F.when(~p.true, "always false").when(~p.false & ~p.null, "always true").otherwise("unknown")


def can_match(e: Expr, schema: T.StructType, rows: Column, accessor: Accessor) -> Column:
    """Whether a unit can hold a row that the predicate keeps."""
    return Pruner(schema, rows, accessor).possible(e).true
