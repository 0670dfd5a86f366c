"""find, count, distinct and statistics over a collection's DataFrame."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import is_missing, quoted
from ..model import ID, TAGGED
from ..plans.filters import access_path, pushed


def empty(spark: SparkSession, columns: list[str] | None = None) -> DataFrame:
    """What reading an unknown collection gives."""
    schema = T.StructType([T.StructField(ID, TAGGED)] + [T.StructField(c, TAGGED) for c in columns or []])
    return spark.createDataFrame([], schema)


def matching(frame: DataFrame, filter_doc: Any) -> DataFrame:
    """The documents that a filter selects, as conditions that the scan can take over."""
    return reduce(DataFrame.filter, pushed(frame.schema, filter_doc), frame)


def at_least_zero(n: Any) -> int:
    return n if isinstance(n, int) and not isinstance(n, bool) and n > 0 else 0


def find(frame: DataFrame, filter_doc: Any = None, skip: Any = 0, limit: Any = 0) -> DataFrame:
    """Matching documents; in _id order where a skip or limit makes the order matter.

    An equality on _id ignores the skip. A limit or skip below 1 is none.
    """
    found = matching(frame, filter_doc)
    skip = 0 if access_path(filter_doc).kind == "id_lookup" else at_least_zero(skip)
    limit = at_least_zero(limit)
    if not skip and not limit:
        return found
    found = found.orderBy(quoted(ID))
    found = found.offset(skip) if skip else found
    return found.limit(limit) if limit else found


def count(frame: DataFrame, filter_doc: Any = None) -> DataFrame:
    return matching(frame, filter_doc).agg(F.count("*").alias("n"))


def distinct(frame: DataFrame, key: str = ID, filter_doc: Any = None) -> DataFrame:
    """The values that a field takes, null among them, missing not; values of different kinds stay apart."""
    if key not in frame.columns:
        return frame.select(F.lit(None).cast("string").alias("value")).filter(F.lit(False))
    return matching(frame, filter_doc).filter(~is_missing(frame, key)).select(quoted(key).alias("value")).distinct()


def distinct_in_order(frame: DataFrame, key: str = ID, filter_doc: Any = None) -> DataFrame:
    """The same values in the order in which a scan by _id first meets them."""
    if key not in frame.columns:
        return distinct(frame, key)
    found = matching(frame, filter_doc).filter(~is_missing(frame, key)).groupBy(quoted(key).alias("value"))
    return found.agg(F.min(quoted(ID)).alias("first")).orderBy("first").select("value")


def collection_stats(frame: DataFrame, namespace: str, n_indexes: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    return frame.agg(F.count("*").alias("count")).select(F.lit(namespace).alias("ns"), "count", zero.alias("size"), F.lit(0.0).alias("avgObjSize"), zero.alias("storageSize"), F.lit(n_indexes + 1).alias("nindexes"), zero.alias("totalIndexSize"))


def database_stats(frames: dict[str, DataFrame], database: str, n_indexes: int, spark: SparkSession) -> DataFrame:
    counts = [f.agg(F.count("*").alias("n")) for f in frames.values()]
    total = reduce(DataFrame.union, counts) if counts else spark.range(0).selectExpr("id AS n")
    zero = F.lit(0).cast("long")
    return total.agg(F.coalesce(F.sum("n"), zero).alias("objects")).select(
        F.lit(database).alias("db"), F.lit(len(frames)).alias("collections"), "objects", F.lit(0.0).alias("avgObjSize"), zero.alias("dataSize"), zero.alias("storageSize"), F.lit(n_indexes).alias("indexes"), zero.alias("indexSize")
    )
