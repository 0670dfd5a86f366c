"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a few joins and aggregations over the links, written to the checkpoint folder in place of the step before, so neither links
nor components reach the driver; the steps end when they change nothing. A hub is handled by partial
aggregation; in the joins its links are one task's, a row at a time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i]; label[i] is a smaller or equal member of i's class."""
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("low")).select("c", F.least("c", "low").alias("low"))
    joined = both.join(least, F.col("u") == F.col("c")).filter(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("low"))
    onto = links.join(least, F.col("u") == F.col("c")).filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return onto.union(least.select(F.col("c").alias("u"), F.col("low").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of links(a, b) that is not itself the smallest."""
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _digest(links)
    while before[0]:
        older, links = links, cut(_small_star(_large_star(links)))
        after = _digest(links)
        release(older)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
