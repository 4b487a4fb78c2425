"""Resolve column names of a tree against a schema."""

from __future__ import annotations

from pyspark.sql import types as T

from tarnlake.plans.expr import Bound, Expr, Ref, rewrite

FIELD_ID = "parquet.field.id"


def field_type(schema: T.StructType, name: str) -> T.DataType | None:
    """Type of a column, dots reaching into structs; None if there is none."""
    at: T.DataType = schema
    if name in schema.fieldNames():
        return schema[name].dataType
    for part in name.split("."):
        if not isinstance(at, T.StructType) or part not in at.fieldNames():
            return None
        at = at[part].dataType
    return at


class BindingError(KeyError):
    """A column that the schema doesn't have."""


def bind(e: Expr, schema: T.StructType, strict: bool = True) -> Expr:
    """Replace names by field ids, which are those in the fields' metadata or else places in the schema. strict: unknown columns raise;
    otherwise they stay as they are. A tree without names comes back as the same object."""
    ids = {f.name: f.metadata.get(FIELD_ID, k) for k, f in enumerate(schema.fields, 1)}

    def one(x: Expr) -> Expr:
        if not isinstance(x, Ref):
            return x
        if field_type(schema, x.name) is None:
            if strict:
                raise BindingError(x.name)
            return x
        return Bound(ids.get(x.name, ids.get(x.name.split(".")[0])), x.name)

    return rewrite(e, one)
