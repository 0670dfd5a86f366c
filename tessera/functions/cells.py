"""Column expressions over plain and tagged cells."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ID, KIND_BOOL, KIND_DOUBLE, KIND_INT, KIND_MISSING, KIND_NULL, KIND_STRING, MISSING, TAGGED, cell, column_kind, is_tagged, kind_of


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(frame: DataFrame | T.StructType, name: str) -> Column:
    """Whether a row leaves the field out."""
    schema = frame.schema if isinstance(frame, DataFrame) else frame
    if name not in schema.names:
        return F.lit(True)
    if is_tagged(schema[name].dataType):
        return quoted(name)["t"] == KIND_MISSING
    if MISSING in schema.names:
        return F.coalesce(F.array_contains(quoted(MISSING), name), F.lit(False))
    return F.lit(False)


def equals(schema: T.StructType, name: str, value: Any) -> Column:
    """Whether a field holds exactly this value: of the same kind, an explicit null only for null. Never null itself."""
    kind = kind_of(value)
    if name not in schema.names:
        return F.lit(False)
    column, held = quoted(name), schema[name].dataType
    if is_tagged(held):
        if kind is None:
            return F.lit(False)
        if kind == KIND_NULL:
            return column["t"] == KIND_NULL
        slot = {KIND_BOOL: "b", KIND_INT: "n", KIND_DOUBLE: "d", KIND_STRING: "s"}[kind]
        return (column["t"] == kind) & (column[slot] == F.lit(value))
    if kind == KIND_NULL:
        return column.isNull() & ~is_missing(schema, name)
    if kind is None or column_kind(held) != kind:
        return F.lit(False)
    return F.coalesce(column == F.lit(value), F.lit(False)) if schema[name].nullable else column == F.lit(value)


def after(schema: T.StructType, bound: Any, inclusive: bool) -> Column:
    """Whether _id lies beyond a bound, numbers in numeric order and kinds in their order."""
    column, held, kind = quoted(ID), schema[ID].dataType, kind_of(bound)
    if kind is None:
        return F.lit(False)
    if is_tagged(held):
        limit = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cell(bound), TAGGED)])
        return column >= limit if inclusive else column > limit
    own = column_kind(held)
    if kind == own or {kind, own} == {KIND_INT, KIND_DOUBLE}:
        return column >= F.lit(bound) if inclusive else column > F.lit(bound)
    # another kind: all values lie on one side; nulls come first
    return column.isNotNull() if own is not None and own > kind else F.lit(False)


def tagged(column: Column, held: T.DataType, missing: Column) -> Column:
    """A plain column as tagged cells."""
    if is_tagged(held):
        return column
    kind = column_kind(held)
    slots = {"b": KIND_BOOL, "n": KIND_INT, "d": KIND_DOUBLE, "s": KIND_STRING}
    tag = F.when(missing, KIND_MISSING).when(column.isNull(), KIND_NULL).otherwise(KIND_NULL if kind is None else kind)
    types = {f.name: f.dataType for f in TAGGED}
    values = [F.when(~missing, column).cast(types[s]).alias(s) if kind == k else F.lit(None).cast(types[s]).alias(s) for s, k in slots.items()]
    return F.struct(tag.cast("tinyint").alias("t"), *values)


def tagged_literal(value: Any, missing: bool = False) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cell(value, missing), TAGGED)])


def json_value(column: Column, held: T.DataType) -> Column:
    """A cell as JSON text; SQL null for a missing one."""
    def text(c: Column) -> Column:
        body = F.to_json(F.array(c))
        return F.substring(body, 2, F.length(body) - 2)

    def string(c: Column) -> Column:
        """Printable ASCII without quote and backslash is written as it is, the rest by the JSON writer, which takes several times as long."""
        return F.when(c.rlike(r"[^ !#-\[\]-~]"), text(c)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))

    if not is_tagged(held):
        own = string(column) if held == T.StringType() else column.cast("string") if column_kind(held) in (KIND_BOOL, KIND_INT) else text(column)
        return F.when(column.isNull(), "null").otherwise(own)
    return (
        F.when(column["t"] == KIND_NULL, "null").when(column["t"] == KIND_BOOL, column["b"].cast("string")).when(column["t"] == KIND_INT, column["n"].cast("string"))
        .when(column["t"] == KIND_DOUBLE, text(column["d"])).when(column["t"] == KIND_STRING, string(column["s"]))
    )


def json_document(schema: T.StructType, names: list[str] | None = None) -> Column:
    """A row as JSON text in column order, missing fields left out."""
    parts = []
    for field in schema:
        if field.name == MISSING or (names is not None and field.name not in names):
            continue
        value = json_value(quoted(field.name), field.dataType)
        key = '"' + field.name.replace("\\", "\\\\").replace('"', '\\"') + '":'
        parts.append(F.when(~is_missing(schema, field.name), F.concat(F.lit(key), value)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
