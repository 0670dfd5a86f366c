"""Aggregation stages as DataFrame steps. Lazy, so a match reaches the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import quoted
from ..model import ID, MISSING
from .filters import pushed

#: Steps of one stage document, in the order in which they apply.
ORDER = ("$match", "$limit", "$skip", "$count", "$project")


def whole_number(value: Any) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def included(value: Any) -> bool:
    return value is True or whole_number(value) == 1


def project(frame: DataFrame, spec: dict) -> DataFrame:
    """Fields marked 1 or true, in the spec's order; _id last unless it is named with 0, or named among them."""
    names = [k for k, v in spec.items() if included(v) and k in frame.columns and k != MISSING]
    if ID in frame.columns and ID not in names and whole_number(spec.get(ID)) != 0:
        names.append(ID)
    kept = [quoted(n) for n in names]
    return frame.select(*kept, *([quoted(MISSING)] if MISSING in frame.columns else []))


def matched(frame: DataFrame, filter_doc: Any) -> DataFrame:
    return reduce(DataFrame.filter, pushed(frame.schema, filter_doc, id_operators=False), frame)


def apply_stage(frame: DataFrame, stage: Any) -> DataFrame:
    """One stage; other keys and stages that are no documents change nothing."""
    if not isinstance(stage, dict):
        return frame
    if isinstance(stage.get("$match"), dict):
        frame = matched(frame, stage["$match"])
    if (n := whole_number(stage.get("$limit"))) is not None and n >= 0:
        frame = in_order(frame).limit(n)
    if (n := whole_number(stage.get("$skip"))) is not None:
        frame = in_order(frame).offset(n) if n >= 0 else frame.filter(F.lit(False))
    if isinstance(stage.get("$count"), str):
        return frame.agg(F.count("*").alias(stage["$count"]))
    if isinstance(stage.get("$project"), dict):
        frame = project(frame, stage["$project"])
    return frame


def in_order(frame: DataFrame) -> DataFrame:
    return frame.orderBy(quoted(ID)) if ID in frame.columns else frame


def aggregate(frame: DataFrame, stages: list) -> DataFrame:
    return reduce(apply_stage, stages, frame)
