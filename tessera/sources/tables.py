"""Given Parquet tables as collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ID

#: The column that names a row. lineitem has none: its order and line numbers repeat.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id",
    "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its key as `_id` in front; a conversation's key is made of its number and turn."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    if name == "conversations":
        return frame.select(F.concat_ws("-", "conv_id", "turn").alias(ID), "*")
    key = KEYS.get(name)
    return frame if key is None else frame.select(F.col(key).alias(ID), *[c for c in frame.columns if c != key])
