"""Update documents as new column expressions for the rows that a condition selects."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentValidationError
from ..functions.cells import quoted, tagged, tagged_literal
from ..model import ID, KIND_DOUBLE, KIND_INT, KIND_MISSING, KIND_NULL, MISSING, TAGGED, column_kind, is_tagged, kind_of, scalar

#: Operators in the order in which they apply, whatever their order in the update.
ORDER = ("$set", "$unset", "$inc", "$push", "$pull")


class RowUpdate:
    """The columns of a frame while an update is applied to the rows where `when` holds."""

    def __init__(self, frame: DataFrame, when: Column) -> None:
        self.frame, self.when = frame, when
        self.columns = {f.name: quoted(f.name) for f in frame.schema if f.name != MISSING}
        self.types = {f.name: f.dataType for f in frame.schema if f.name != MISSING}
        self.missing = quoted(MISSING) if MISSING in frame.columns else None
        #: rows for which the result could not be stored
        self.invalid: list[Column] = []

    def absent(self, name: str) -> Column:
        if is_tagged(self.types[name]):
            return self.columns[name]["t"] == KIND_MISSING
        return F.lit(False) if self.missing is None else F.coalesce(F.array_contains(self.missing, name), F.lit(False))

    def declared(self, name: str) -> str:
        if name == ID:
            raise DocumentValidationError("_id cannot be changed")
        if name not in self.columns:
            raise DocumentValidationError(f"field {name} is not a declared storage column")
        return name

    def promote(self, name: str) -> None:
        """Makes a column one of tagged cells, because it is to hold values of another kind."""
        if not is_tagged(self.types[name]):
            self.columns[name] = tagged(self.columns[name], self.types[name], self.absent(name))
            self.types[name] = TAGGED
            self.present(name, F.lit(True))

    def present(self, name: str, where: Column) -> None:
        if self.missing is not None:
            self.missing = F.when(where, F.array_remove(self.missing, name)).otherwise(self.missing)

    def set(self, name: str, value: Any) -> None:
        kind = kind_of(scalar(self.declared(name), value))
        held = self.types[name]
        if not is_tagged(held) and kind != KIND_NULL and column_kind(held) != kind:
            self.promote(name)
        new = tagged_literal(value) if is_tagged(self.types[name]) else F.lit(value).cast(self.types[name])
        self.present(name, self.when)
        self.columns[name] = F.when(self.when, new).otherwise(self.columns[name])

    def unset(self, name: str) -> None:
        if name == ID:
            raise DocumentValidationError("_id cannot be changed")
        if name not in self.columns:
            return
        if is_tagged(self.types[name]):
            self.columns[name] = F.when(self.when, tagged_literal(None, missing=True)).otherwise(self.columns[name])
            return
        held = F.array().cast("array<string>") if self.missing is None else F.coalesce(self.missing, F.array().cast("array<string>"))
        self.missing = F.when(self.when, F.array_union(held, F.array(F.lit(name)))).otherwise(held)
        self.columns[name] = F.when(self.when, F.lit(None).cast(self.types[name])).otherwise(self.columns[name])

    def inc(self, name: str, by: Any) -> None:
        """Adds in floating point; what is no number counts as 0, and a sum that is no number becomes the whole number 0."""
        if kind_of(by) not in (KIND_INT, KIND_DOUBLE):
            return
        held = self.types[self.declared(name)]
        if not is_tagged(held) and column_kind(held) not in (KIND_INT, KIND_DOUBLE):
            self.promote(name)
        column = self.columns[name]
        if not is_tagged(self.types[name]):
            total = F.coalesce(column.cast("double"), F.lit(0.0)) + F.lit(float(by))
            total = F.when(F.isnan(total) | (F.abs(total) == math.inf), F.lit(0.0)).otherwise(total)
            self.present(name, self.when)
            self.columns[name], self.types[name] = F.when(self.when, total).otherwise(column.cast("double")), T.DoubleType()
            return
        current = F.when(column["t"] == KIND_INT, column["n"].cast("double")).when(column["t"] == KIND_DOUBLE, column["d"]).otherwise(F.lit(0.0))
        total = current + F.lit(float(by))
        none = lambda k: F.lit(None).cast(k)
        new = F.struct(F.lit(KIND_DOUBLE).cast("tinyint").alias("t"), none("boolean").alias("b"), none("bigint").alias("n"), total.alias("d"), none("string").alias("s"))
        new = F.when(F.isnan(total) | (F.abs(total) == math.inf), tagged_literal(0)).otherwise(new)
        self.columns[name] = F.when(self.when, new).otherwise(column)

    def push(self, name: str, item: Any) -> None:
        """Appends to an array column; a scalar stays as it is, and a new array in a missing field could not be stored."""
        held = self.types[self.declared(name)]
        if isinstance(held, T.ArrayType):
            self.columns[name] = F.when(self.when & self.columns[name].isNotNull(), F.array_append(self.columns[name], F.lit(item).cast(held.elementType))).otherwise(self.columns[name])
        else:
            self.invalid.append(self.when & self.absent(name))

    def pull(self, name: str, item: Any) -> None:
        """Removes equal items from an array column; does nothing to anything else."""
        held = self.types.get(name)
        if isinstance(held, T.ArrayType):
            equal = lambda x: x.isNull() if item is None else x == F.lit(item).cast(held.elementType)
            self.columns[name] = F.when(self.when, F.filter(self.columns[name], lambda x: ~F.coalesce(equal(x), F.lit(False)))).otherwise(self.columns[name])

    def replace(self, document: dict) -> None:
        for name, value in document.items():
            if name != ID:
                self.set(name, value)
        for name in list(self.columns):
            if name != ID and name not in document:
                self.unset(name)

    def result(self, *extra: str) -> DataFrame:
        own = [c.alias(n) for n, c in self.columns.items()]
        return self.frame.select(*own, *([self.missing.alias(MISSING)] if self.missing is not None else []), *extra)


def prepared(frame: DataFrame, when: Column, update: Any) -> RowUpdate:
    """The update applied where `when` holds; anything but an object changes nothing."""
    rows = RowUpdate(frame, when)
    if not isinstance(update, dict):
        return rows
    if not any(k.startswith("$") for k in update):
        rows.replace(update)
        return rows
    for operator in ORDER:
        fields = update.get(operator)
        if isinstance(fields, dict):
            for name, value in fields.items():
                {"$set": rows.set, "$unset": lambda n, _: rows.unset(n), "$inc": rows.inc, "$push": rows.push, "$pull": rows.pull}[operator](name, value)
    return rows


def updated(frame: DataFrame, when: Column, update: Any) -> DataFrame:
    return prepared(frame, when, update).result()


