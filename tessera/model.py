"""Names, declared columns, and scalar values of documents.

A collection is a DataFrame with `_id` first. Its columns are either plain Spark types (all values of one kind; SQL null is
an explicit null, and the optional column `__missing` lists the fields that a row leaves out), or tagged cells, which
hold a value of any scalar kind with its kind, null and missing included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from .errors import DocumentValidationError

ID, MISSING = "_id", "__missing"

#: Kinds of tagged cells, in their order.
KIND_MISSING, KIND_NULL, KIND_BOOL, KIND_INT, KIND_DOUBLE, KIND_STRING = range(6)
TAGGED = T.StructType([T.StructField("t", T.ByteType()), T.StructField("b", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType())])

MAX_DATABASE_BYTES = 63
FORBIDDEN = re.compile(r'[\0 ./\\"$]')


def database_name(name: str) -> str:
    if not name or len(name.encode()) > MAX_DATABASE_BYTES or FORBIDDEN.search(name):
        raise DocumentValidationError(f"invalid database name: {name!r}")
    return name


@dataclass(frozen=True, order=True)
class Namespace:
    database: str
    collection: str

    def __post_init__(self) -> None:
        database_name(self.database)
        if not self.collection or "\0" in self.collection:
            raise DocumentValidationError(f"invalid collection name: {self.collection!r}")

    @classmethod
    def parse(cls, full: str) -> Namespace:
        database, dot, collection = full.partition(".")
        if not dot:
            raise DocumentValidationError(f"a namespace is database.collection, not {full!r}")
        return cls(database, collection)

    @property
    def full_name(self) -> str:
        return f"{self.database}.{self.collection}"


OPLOG = Namespace("local", "oplog.rs")
REPL_STATE = Namespace("local", "repl_state")
RESERVED = {OPLOG, REPL_STATE}


def storage_columns(columns: list[str]) -> list[str]:
    for c in columns:
        if not isinstance(c, str) or not c or c == ID or "." in c:
            raise DocumentValidationError(f"invalid storage column: {c!r}")
    if len(set(columns)) < len(columns):
        raise DocumentValidationError("storage columns must be unique")
    return list(columns)


def kind_of(value: Any) -> int | None:
    """The kind of a scalar; None for anything that a cell can't hold."""
    if value is None:
        return KIND_NULL
    if isinstance(value, bool):
        return KIND_BOOL
    if isinstance(value, int):
        return KIND_INT if -(2**63) <= value < 2**63 else None
    if isinstance(value, float):
        return KIND_DOUBLE
    if isinstance(value, str):
        return KIND_STRING
    return None


def scalar(name: str, value: Any) -> Any:
    if kind_of(value) is None:
        raise DocumentValidationError(f"{name} must be a top-level scalar value")
    return value


def column_kind(kind: T.DataType) -> int | None:
    """The kind of values in a plain column; None for types outside the document model."""
    if isinstance(kind, T.BooleanType):
        return KIND_BOOL
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return KIND_INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return KIND_DOUBLE
    if isinstance(kind, T.StringType):
        return KIND_STRING
    return None


def is_tagged(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == TAGGED.names


def cell(value: Any, missing: bool = False) -> tuple:
    """A value as the fields of a tagged cell."""
    if missing:
        return (KIND_MISSING, None, None, None, None)
    kind = kind_of(scalar("value", value))
    return (kind, value if kind == KIND_BOOL else None, value if kind == KIND_INT else None, value if kind == KIND_DOUBLE else None, value if kind == KIND_STRING else None)


def check_document(document: dict, columns: list[str]) -> dict:
    """A document that fits the declared columns; fields may be left out but not added."""
    if not isinstance(document, dict):
        raise DocumentValidationError("document must be an object")
    if ID not in document:
        raise DocumentValidationError("document is missing _id")
    for name, value in document.items():
        if name != ID and name not in columns:
            raise DocumentValidationError(f"field {name} is not a declared storage column")
        scalar(name, value)
    return document


def read_row(row: Any, schema: T.StructType) -> dict:
    """A collected row as a document: _id first, then the declared order; missing fields are left out."""
    missing = set(row[MISSING] or ()) if MISSING in schema.names else set()
    out: dict[str, Any] = {}
    for field in schema:
        if field.name == MISSING or field.name in missing:
            continue
        value = row[field.name]
        if is_tagged(field.dataType):
            if value is None or value["t"] == KIND_MISSING:
                continue
            value = next((value[k] for k in "bnds" if value[k] is not None), None)
        out[field.name] = value
    return out
