"""Change-log rows and their application.

Row: `_id` (index), term, op (i insert, u update, d delete, c create collection, ci create index), ns, and JSON texts o (the
document after an insert or update, a deleted document's key, a definition) and o2 (an updated document's key).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import json_document, quoted
from ..model import ID
from ..sources.files import materialized

SCHEMA = T.StructType([T.StructField(ID, T.LongType()), T.StructField("term", T.LongType()), T.StructField("op", T.StringType()), T.StructField("ns", T.StringType()), T.StructField("o", T.StringType()), T.StructField("o2", T.StringType())])


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """Indexes from `first` on in _id order.

    Ranges of _id are counted, their counts summed up, and each range numbered by itself, so no task sees all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialized(rows.repartitionByRange(parts, quoted(ID)).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranged.groupBy("__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))  # a row per range
    within = F.row_number().over(Window.partitionBy("__part").orderBy(quoted(ID)))
    return ranged.join(F.broadcast(begins), F.col("__part") == F.col("__p")).withColumn("__index", within + F.col("__begin") + F.lit(first - 1)).drop("__part", "__p", "__begin")


def numbered_files(rows: DataFrame, first: int) -> DataFrame:
    """Indexes from `first` on in _id order, of rows read from files that are ranges of _id, each in its order: by file and place in it, with no shuffle of the rows."""
    file = rows.metadataColumn("_metadata")
    placed = rows.select("*", file["file_path"].alias("__file"), file["row_index"].alias("__row"))
    sizes = placed.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))
    least = placed.filter("__row = 0").select(F.col("__file").alias("__f"), quoted(ID).alias("__least"))
    before = Window.orderBy("__least").rowsBetween(Window.unboundedPreceding, -1)
    begins = least.join(F.broadcast(sizes), F.col("__f") == F.col("__file")).select("__f", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))  # a row per file
    return placed.join(F.broadcast(begins), F.col("__file") == F.col("__f")).withColumn("__index", F.col("__row") + F.col("__begin") + F.lit(first)).drop("__file", "__row", "__f", "__begin")


def entries(changed: DataFrame, op: str, namespace: str, first: int, term: int = 1, ranged: bool = False) -> DataFrame:
    """Log rows of one statement's documents, in _id order from index `first` on. ranged: they are read from files as numbered_files takes them."""
    body, key = json_document(changed.schema), json_document(changed.schema, [ID])
    rows = (numbered_files if ranged else numbered)(changed, first)
    none = F.lit(None).cast("string")
    o, o2 = (key, none) if op == "d" else (body, key if op == "u" else none)
    return rows.select(F.col("__index").cast("long").alias("_index"), F.lit(term).cast("long").alias("term"), F.lit(op).alias("op"), F.lit(namespace).alias("ns"), o.alias("o"), o2.alias("o2")).withColumnRenamed("_index", ID)


def definition_entry(spark: SparkSession, op: str, namespace: str, definition: dict, index: int, term: int = 1) -> DataFrame:
    return spark.createDataFrame([(index, term, op, namespace, json.dumps(definition, separators=(",", ":")), None)], SCHEMA)


def after(log: DataFrame, index: int, limit: int | None = None) -> DataFrame:
    """Entries beyond an index, in order."""
    found = log.filter(F.col(ID) > index).orderBy(ID)
    return found if limit is None else found.limit(limit)


def read_stream(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """The log folder as a stream; new files are new micro-batches."""
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").options(**options).parquet(path)


def tail(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None], await_data: bool = False) -> StreamingQuery:
    """Hands each new batch of entries to `each`; ends at the log's end, or with await_data goes on waiting."""
    writer = read_stream(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="500 milliseconds") if await_data else writer.trigger(availableNow=True)).start()


def last_images(log: DataFrame, namespace: str, fields: T.StructType) -> DataFrame:
    """For each document key in a namespace its last entry: op, and the document's fields (null after a delete).

    One partial aggregation per key; applying it twice, or with entries seen before, gives the same.
    """
    own = log.filter((F.col("ns") == namespace) & F.col("op").isin("i", "u", "d"))
    parsed = F.from_json("o", fields, {"mode": "FAILFAST"})
    keyed = own.select(parsed[ID].alias("key"), F.col(ID).alias("index"), F.struct("op", parsed.alias("document")).alias("image"))
    return keyed.groupBy("key").agg(F.max_by("image", "index").alias("image")).select("key", "image.op", "image.document")


def replayed(base: DataFrame, log: DataFrame, namespace: str) -> DataFrame:
    """A plain typed collection after the log: last images replace or remove, the rest stays."""
    last = last_images(log, namespace, base.schema)
    kept = base.join(last.select(F.col("key").alias(ID)), ID, "left_anti").select(*base.columns)
    return kept.unionByName(last.filter("op <> 'd'").select("document.*"))
