"""Filter documents as column expressions, and the access path that they imply."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentValidationError
from ..functions.cells import after, equals
from ..functions.keys import index_prefix
from ..model import ID

RANGES = {"$gt": False, "$gte": True}


def normalized(filter_doc: Any) -> dict:
    if filter_doc is None:
        return {}
    if not isinstance(filter_doc, dict):
        raise DocumentValidationError("filter must be an object")
    return filter_doc


def id_range(operators: dict) -> tuple[Any, bool]:
    """Bound and inclusiveness of an _id range."""
    named = [op for op in RANGES if op in operators]
    if not named:
        raise DocumentValidationError("only _id.$gt and _id.$gte are supported")
    if len(operators) > 1:
        raise DocumentValidationError("only a single _id.$gt or _id.$gte operator is supported")
    return operators[named[0]], RANGES[named[0]]


def predicate(schema: T.StructType, filter_doc: Any, id_operators: bool = True) -> Column:
    """All fields equal, _id also beyond a bound; never null, so its negation selects the other rows."""
    terms = []
    for name, value in normalized(filter_doc).items():
        if name == ID and id_operators and isinstance(value, dict):
            bound, inclusive = id_range(value)
            terms.append(F.coalesce(after(schema, bound, inclusive), F.lit(False)) if schema[ID].nullable else after(schema, bound, inclusive))
        else:
            terms.append(equals(schema, name, value))
    return reduce(and_, terms) if terms else F.lit(True)


def pushed(schema: T.StructType, filter_doc: Any, id_operators: bool = True) -> list[Column]:
    """The same condition in the plain form that a scan can take over; for filtering only, where null counts as false."""
    terms = []
    for name, value in normalized(filter_doc).items():
        if name == ID and id_operators and isinstance(value, dict):
            terms.append(after(schema, *id_range(value)))
        elif value is not None and name in schema.names:
            strict = T.StructType([T.StructField(f.name, f.dataType, False) for f in schema])
            terms.append(equals(strict, name, value))
        else:
            terms.append(equals(schema, name, value))
    return terms


@dataclass(frozen=True)
class AccessPath:
    """How a request finds its rows; Catalyst does the work, this names the choice."""

    kind: str  # table_scan, id_lookup, id_range, index_equality
    index: str | None = None


def access_path(filter_doc: Any, indexes: dict[str, str] | None = None) -> AccessPath:
    """indexes: name to field of the ready ones."""
    wanted = normalized(filter_doc)
    if ID in wanted:
        if isinstance(wanted[ID], dict):
            id_range(wanted[ID])
            return AccessPath("id_range")
        return AccessPath("id_lookup")
    for name, field in sorted((indexes or {}).items()):
        if field in wanted:
            return AccessPath("index_equality", name) if index_prefix(wanted[field]) is not None else AccessPath("table_scan")
    return AccessPath("table_scan")
