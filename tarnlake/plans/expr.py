"""Predicate and expression trees. Builders fold constants as they go; nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields, replace
from typing import Any


class Expr:
    """A node. Comparison builders are methods; & | ~ combine predicates."""

    def __and__(self, other: Expr) -> Expr:
        return all_of(self, other)

    def __or__(self, other: Expr) -> Expr:
        return any_of(self, other)

    def __invert__(self) -> Expr:
        return negate(self)

    def _compare(self, op: str, other: Any) -> Compare:
        return Compare(op, self, lit(other))

    def eq(self, other: Any) -> Compare:
        return self._compare("=", other)

    def ne(self, other: Any) -> Compare:
        return self._compare("<>", other)

    def lt(self, other: Any) -> Compare:
        return self._compare("<", other)

    def le(self, other: Any) -> Compare:
        return self._compare("<=", other)

    def gt(self, other: Any) -> Compare:
        return self._compare(">", other)

    def ge(self, other: Any) -> Compare:
        return self._compare(">=", other)

    def eq_null_safe(self, other: Any) -> Compare:
        return self._compare("<=>", other)

    def starts_with(self, prefix: Any) -> Compare:
        return self._compare("starts", prefix)

    def not_starts_with(self, prefix: Any) -> Expr:
        return negate(self.starts_with(prefix))

    def is_null(self) -> Test:
        return Test("null", self)

    def is_not_null(self) -> Test:
        return Test("not null", self)

    def is_nan(self) -> Test:
        return Test("nan", self)

    def is_not_nan(self) -> Test:
        return Test("not nan", self)

    def isin(self, *values: Any) -> In:
        return In(self, tuple(map(lit, values)))

    def not_in(self, *values: Any) -> Expr:
        return negate(self.isin(*values))


@dataclass(frozen=True)
class Ref(Expr):
    """A column, by name; dots reach into structs."""

    name: str


@dataclass(frozen=True)
class Bound(Expr):
    """A column resolved to its field id."""

    field_id: int
    name: str


@dataclass(frozen=True)
class Lit(Expr):
    """A constant. type: a Spark type string, or None to go by the value."""

    value: Any
    type: str | None = None


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Const(Expr):
    value: bool


@dataclass(frozen=True)
class All(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Any_(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    part: Expr


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Test(Expr):
    kind: str
    part: Expr


@dataclass(frozen=True)
class In(Expr):
    part: Expr
    values: tuple[Lit, ...]


TRUE, FALSE = Const(True), Const(False)


def col(name: str) -> Ref:
    return Ref(name)


def lit(value: Any, type_: str | None = None) -> Expr:
    return value if isinstance(value, Expr) else Lit(value, type_)


def call(name: str, *args: Any) -> Call:
    return Call(name, tuple(map(lit, args)))


def _join(kind: type, parts: Iterable[Expr], unit: Const, zero: Const) -> Expr:
    flat: list[Expr] = []
    for p in parts:
        flat += p.parts if isinstance(p, kind) else [p]
    if zero in flat:
        return zero
    flat = [p for p in flat if p != unit]
    return unit if not flat else flat[0] if len(flat) == 1 else kind(tuple(flat))


def all_of(*parts: Expr) -> Expr:
    """AND of any number; none is TRUE."""
    return _join(All, parts, TRUE, FALSE)


def any_of(*parts: Expr) -> Expr:
    """OR of any number; none is FALSE."""
    return _join(Any_, parts, FALSE, TRUE)


def negate(part: Expr) -> Expr:
    if isinstance(part, Const):
        return Const(not part.value)
    return part.part if isinstance(part, Not) else Not(part)


def children(e: Expr) -> Iterator[Expr]:
    for f in fields(e):
        v = getattr(e, f.name)
        if isinstance(v, Expr):
            yield v
        elif isinstance(v, tuple):
            yield from (x for x in v if isinstance(x, Expr))


def rewrite(e: Expr, fn: Callable[[Expr], Expr]) -> Expr:
    """Apply fn bottom-up; an unchanged tree comes back as the same object."""
    changes = {}
    for f in fields(e):
        v = getattr(e, f.name)
        new = v
        if isinstance(v, Expr):
            new = rewrite(v, fn)
        elif isinstance(v, tuple) and v and all(isinstance(x, Expr) for x in v):
            new = tuple(rewrite(x, fn) for x in v)
            new = v if all(a is b for a, b in zip(v, new, strict=True)) else new
        if new is not v:
            changes[f.name] = new
    return fn(replace(e, **changes) if changes else e)


def columns(e: Expr) -> set[str]:
    """Names of the columns that e reads."""
    own = {e.name} if isinstance(e, Ref | Bound) else set()
    return own.union(*(columns(c) for c in children(e)))
