"""Functions that expressions may call, by name: builders from Columns to a Column. User functions register beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]


def _like(c: Column, pattern: Column) -> Column:
    return F.like(c, pattern)


BUILT_IN: dict[str, Builder] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "date_format": lambda c, f: F.call_function("date_format", c, f), "current_date": F.current_date, "current_timestamp": F.current_timestamp,
    "substring": lambda c, a, n: F.substr(c, a, n), "concat": F.concat, "length": F.length, "trim": F.trim, "upper": F.upper, "lower": F.lower,
    "coalesce": F.coalesce, "ifnull": F.ifnull, "nullif": F.nullif, "if": lambda p, a, b: F.when(p, a).otherwise(b), "between": lambda c, a, b: (c >= a) & (c <= b), "like": _like,
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: F.try_divide(a, b), "modulo": lambda a, b: F.try_mod(a, b), "negate": lambda a: -a, "abs": F.abs,
    "cast": lambda c, t: F.call_function("cast", c, t),
}


def _case(*args: Column) -> Column:
    """Pairs of condition and value, then the value otherwise."""
    out = F.when(args[0], args[1])
    for k in range(2, len(args) - 1, 2):
        out = out.when(args[k], args[k + 1])
    return out.otherwise(args[-1]) if len(args) % 2 else out


BUILT_IN["case"] = _case


class Registry:
    def __init__(self) -> None:
        self._own: dict[str, Builder] = {}

    def register(self, name: str, builder: Builder) -> None:
        """builder takes and gives Columns; a pandas_udf is one."""
        self._own[name.lower()] = builder

    def is_registered(self, name: str) -> bool:
        return name.lower() in self._own or name.lower() in BUILT_IN

    def invoke(self, name: str, *args: Column) -> Column:
        found = self._own.get(name.lower()) or BUILT_IN.get(name.lower())
        if found is None:
            raise KeyError(f"no function {name!r}")
        return found(*args)


DEFAULT = Registry()
