"""Inserts, updates and deletes as DataFrame to DataFrame steps, with the rows that they change."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StorageError
from ..functions.cells import quoted, tagged, tagged_literal
from ..functions.keys import with_id
from ..model import ID, MISSING, TAGGED, cell, check_document, is_tagged
from ..plans.filters import predicate
from ..plans.updates import prepared

CHANGED = "__changed"


@dataclass
class Change:
    """A collection after a write, and the documents written (after-images) or deleted; of an update or a delete both in one frame, with a flag for the latter."""

    after: DataFrame
    changed: DataFrame
    op: str
    flagged: DataFrame | None = None


def documents_frame(spark: SparkSession, documents: list[dict], columns: list[str]) -> DataFrame:
    """Documents as tagged cells in the declared order."""
    schema = T.StructType([T.StructField(c, TAGGED) for c in [ID, *columns]])
    rows = [tuple(cell(d.get(c), c not in d) for c in [ID, *columns]) for d in documents]
    return spark.createDataFrame(rows, schema)


def as_tagged(frame: DataFrame) -> DataFrame:
    """Every column as tagged cells, so that values of any kind fit; a flag of changed rows stays."""
    absent = lambda c: F.coalesce(F.array_contains(quoted(MISSING), c), F.lit(False)) if MISSING in frame.columns else F.lit(False)
    cells = [tagged(quoted(f.name), f.dataType, absent(f.name)).alias(f.name) for f in frame.schema if f.name not in (MISSING, CHANGED)]
    return frame.select(*cells, *[F.coalesce(CHANGED, F.lit(False)).alias(CHANGED)] * (CHANGED in frame.columns))


def alike(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two frames of the same columns with the same representation."""
    if left.schema.names == right.schema.names and all(a.dataType == b.dataType for a, b in zip(left.schema, right.schema)):
        return left, right
    left, right = as_tagged(left), as_tagged(right)
    return left, right.select(*left.columns)


def insert_rows(frame: DataFrame, new: DataFrame) -> Change:
    """Adds the rows of `new` whose _id is not there yet; of rows of one _id within `new`, one. The collection's keys are never broadcast."""
    own, new = alike(frame, new)
    fresh = new.dropDuplicates([ID]).join(own.select(quoted(ID)).hint("merge"), ID, "left_anti").select(*own.columns)
    return Change(own.unionByName(fresh), fresh, "i")


def insert_documents(frame: DataFrame, documents: list[dict], columns: list[str]) -> tuple[Change, list[dict], Exception | None]:
    """Inserts documents in order until one fails: the change, the documents inserted, and the failure."""
    spark, accepted, failure = frame.sparkSession, [], None
    for document in documents:
        try:
            accepted.append(check_document(with_id(document), columns))
        except Exception as e:  # noqa: BLE001  reported with what came before
            failure = e
            break
    keys = [cell(d[ID]) for d in accepted]
    held = held_ids(frame, keys) if keys else set()
    for i, key in enumerate(keys):
        if key in held:
            failure = StorageError("duplicate key error")
            accepted = accepted[:i]
            break
        held.add(key)
    new = documents_frame(spark, accepted, columns)
    own, new = alike(frame, new)
    return Change(own.unionByName(new), new, "i"), accepted, failure


def held_ids(frame: DataFrame, keys: list[tuple]) -> set[tuple]:
    """Which of the request's own keys are in the collection."""
    wanted = frame.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(ID, TAGGED)]))
    ids = as_tagged(frame.select(quoted(ID)))
    return {tuple(r[0]) for r in wanted.join(ids, ID, "left_semi").distinct().collect()}


def selected(frame: DataFrame, condition: Column, one: bool) -> DataFrame:
    """The frame with a flag for the rows to change: all that meet the condition, or the one of least _id."""
    if not one:
        return frame.withColumn(CHANGED, condition)
    target = frame.filter(condition).select(quoted(ID).alias("__target")).orderBy("__target").limit(1).withColumn(CHANGED, F.lit(True))
    marked = frame.join(F.broadcast(target), quoted(ID).eqNullSafe(F.col("__target")), "left")  # one row
    return marked.withColumn(CHANGED, F.coalesce(CHANGED, F.lit(False))).drop("__target")


def update(frame: DataFrame, filter_doc: Any, change: Any, many: bool = True) -> Change:
    """Updates the first matching document in _id order, or all. Documents that stay equal count as changed."""
    flagged = selected(frame, predicate(frame.schema, filter_doc), not many)
    rows = prepared(flagged.drop(CHANGED), F.col(CHANGED), change)
    rows.frame = flagged
    result = rows.result(CHANGED)
    invalid = reduce(lambda a, b: a | b, rows.invalid) if rows.invalid else None
    if invalid is not None and flagged.filter(invalid).limit(1).count():
        raise StorageError("value must be a top-level scalar value")
    return Change(result.drop(CHANGED), result.filter(CHANGED).drop(CHANGED), "u", result)


def delete(frame: DataFrame, filter_doc: Any, many: bool = True) -> Change:
    """Deletes the first matching document in _id order, or all; rows with nulls in the filter's fields stay."""
    flagged = selected(frame, predicate(frame.schema, filter_doc), not many)
    return Change(flagged.filter(~F.col(CHANGED)).drop(CHANGED), flagged.filter(CHANGED).drop(CHANGED), "d", flagged)


def upsert_images(frame: DataFrame, images: DataFrame) -> DataFrame:
    """Replaces documents by key, adding those that are new."""
    own, images = alike(frame, images)
    return own.join(images.select(quoted(ID)), ID, "left_anti").select(*own.columns).unionByName(images)


def remove_keys(frame: DataFrame, keys: DataFrame) -> DataFrame:
    """Deletes documents by key; keys that are not there are ignored."""
    if is_tagged(frame.schema[ID].dataType) != is_tagged(keys.schema[ID].dataType):
        frame, keys = as_tagged(frame), as_tagged(keys)
    return frame.join(keys.select(quoted(ID)), ID, "left_anti").select(*frame.columns)


def tagged_missing() -> Column:
    return tagged_literal(None, missing=True)


def variant_path(name: str) -> str:
    quote = "'" if "'" not in name else '"'
    if quote in name:
        raise StorageError(f"field name {name!r} cannot be read back from JSON")
    return f"$[{quote}{name}{quote}]"


def cell_of_variant(document: Column, name: str) -> Column:
    """A field of a parsed JSON document as a tagged cell: a number written with a fraction or exponent is a double, an absent field is missing."""
    path = variant_path(name)
    held = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    kind = F.when(held.isNull(), 0).when(held == "VOID", 1).when(held == "BOOLEAN", 2).when(held == "BIGINT", 3).when(held == "STRING", 5).otherwise(4)
    value = lambda k, t: F.when(kind == k, F.try_variant_get(document, path, t))
    return F.struct(kind.cast("tinyint").alias("t"), value(2, "boolean").alias("b"), value(3, "bigint").alias("n"), value(4, "double").alias("d"), value(5, "string").alias("s"))


def logged_cells(log: DataFrame, namespace: str, columns: list[str]) -> DataFrame:
    """op, index, row of a namespace's documents in the log, as tagged cells."""
    own = log.filter((F.col("ns") == namespace) & F.col("op").isin("i", "u", "d"))
    parsed = F.parse_json("o")
    return own.select("op", F.col(ID).alias("index"), F.struct(*[cell_of_variant(parsed, c).alias(c) for c in [ID, *columns]]).alias("row"))


def check_applicable(log: DataFrame, namespace: str, frame: DataFrame, columns: list[str]) -> None:
    """Refuses a log whose first entry of a key inserts it beside another document, or updates it where it is not held."""
    first = logged_cells(log, namespace, columns).groupBy(F.col("row")[ID].alias("key")).agg(F.min_by(F.struct("op", "row"), "index").alias("first"))
    held = frame.select(quoted(ID).alias("key"), F.struct(*[quoted(c) for c in [ID, *columns]]).alias("held"))
    met = first.filter("first.op <> 'd'").join(held, "key", "left")
    wrong = met.filter(((F.col("first.op") == "u") & F.col("held").isNull()) | ((F.col("first.op") == "i") & F.col("held").isNotNull() & ~F.col("held").eqNullSafe(F.col("first.row"))))
    found = wrong.select("first.op").first()
    if found is not None:
        raise StorageError("change log updates a document that is not there" if found[0] == "u" else "change log inserts another document under a key that is held")


def last_states(log: DataFrame, namespace: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of each key in the log its last image: documents that are there now, and keys that are gone."""
    last = logged_cells(log, namespace, columns).groupBy(F.col("row")[ID].alias("key")).agg(F.max_by(F.struct("op", "row"), "index").alias("image"))
    images = last.filter("image.op <> 'd'").select(*[F.col("image.row")[c].alias(c) for c in [ID, *columns]])
    return images, last.filter("image.op = 'd'").select(F.col("key").alias(ID))
