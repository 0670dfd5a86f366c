"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised; a Gaussian projection, shifted and cut into steps of fixed width, gives a whole
number that near vectors share with high probability. Several such numbers are a table's bucket, and there
are several tables: both follow from the number of vectors, so that a bucket keeps a bounded number of far
vectors and a pair at exactly the cosine asked for meets in some table with probability RECALL. Every pair
that meets is checked by its exact cosine in double precision, and counted in the first table where it meets only, so
links are counted once and no pair leaves a task. Buckets with many vectors are cut into blocks and block is
compared with block.

A vector's buckets are sent as numbers first. Those that no other vector shares go; the vectors are joined to the rest and
travel once for each. A task that compares a block works out its vectors' other buckets itself. Few tables with buckets
of some FAR vectors shuffle least; comparing them is a product of matrices.

Equal vectors are one row with a multiplicity: they link with each other, and a link to one is a link to all.
Links name these rows, so that vectors without an id link like others; a component is named by its smallest
id at the end, and by null if it has none.

Defined results: a vector that is null, zero or holds null or non-finite components links with nothing; vectors of
different lengths do not link; repeated rows are separate vectors; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, stream_groups, typed
from .components import components, merge_labels

COSINE = 0.9
RECALL = 0.98
#: Far vectors that share a bucket, about.
FAR = 2500
SEED = 20240
#: Vectors in a block of a large bucket, and pairs whose cosines are worked out at once.
BLOCK, PAIRS = 8000, 100_000


def collide(distance: float, width: float) -> float:
    """Probability that one projection of two vectors at this distance falls into the same step."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, float]:
    """Projections per table, tables, and step width for n vectors."""
    near = math.sqrt(max(1e-9, 2 - 2 * cosine))
    width = 4 * near
    p_near, p_far = collide(near, width), collide(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 1) / FAR) / -math.log(p_far))) if n > FAR else 4
    return k, math.ceil(math.log(1 - recall) / math.log(1 - p_near**k)), width


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; powers of two are taken out first, which is exact and keeps squares from overflowing."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


#: Projections by number of dimensions and plan; a worker process makes them once.
AXES: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def projections(dimensions: int, k: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian axes, shifts, and odd numbers that mix a table's steps."""
    of = dimensions, k, tables, width
    if of not in AXES:
        rng = np.random.default_rng([SEED, dimensions])
        AXES[of] = rng.standard_normal((dimensions, k * tables)), rng.uniform(0, width, k * tables), rng.integers(1, 2**62, k, dtype=np.int64) * 2 + 1
    return AXES[of]


def signatures(vectors: np.ndarray, k: int, tables: int, width: float) -> np.ndarray:
    """One 64-bit bucket number per vector and table."""
    axes, shift, mixer = projections(vectors.shape[1], k, tables, width)
    steps = np.floor((vectors @ axes + shift) / width).astype(np.int64).reshape(len(vectors), tables, k)
    with np.errstate(over="ignore"):
        return (steps * mixer).sum(axis=2)


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def hashed(reps: DataFrame, k: int, tables: int, width: float) -> DataFrame:
    """node, table, bucket of reps(node, vector): a row per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                node, lengths = batch.column("node").to_numpy(), batch.column("vector").value_lengths().to_numpy()
                flat = np.asarray(batch.column("vector").flatten())
                for d in np.unique(lengths).tolist():
                    vectors = flat[np.repeat(lengths == d, lengths)].reshape(-1, d)
                    buckets = signatures(unit(vectors.astype(float)), k, tables, width)
                    yield pa.RecordBatch.from_pydict({"node": np.repeat(node[lengths == d], tables), "table": np.tile(np.arange(tables, dtype=np.int32), len(vectors)), "bucket": buckets.ravel()})

    return typed(reps, run, "node long, table int, bucket long")


def as_bytes(reps: DataFrame) -> DataFrame:
    """node, size, vector of reps with the vector as bytes; of single-precision input in single precision, which loses nothing."""
    kind = vector_kind(reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            raw, ends = np.asarray(column.flatten()).astype(kind).tobytes(), np.r_[0, np.cumsum(column.value_lengths().to_numpy())] * int(kind[-1])
            yield pa.RecordBatch.from_pydict({"node": batch.column("node"), "size": batch.column("size"), "vector": pa.array([raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())})

    return typed(reps.select("node", "size", "vector"), run, "node long, size long, vector binary")


def vector_kind(reps: DataFrame) -> str:
    return "<f4" if isinstance(reps.schema["vector"].dataType.elementType, T.FloatType) else "<f8"


def matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def compare(table: pa.Table, at: int, same: bool, cosine: float, kind: str, k: int, tables: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vector of a block, or of two blocks against each other: linked vectors met here first, the smallest linked node or itself, and the smallest node of its class."""
    node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
    first_block = table.column("side").to_numpy() == 0
    x = unit(matrix(table.column("vector"), kind).astype(float))
    rows, cols = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(first_block), np.flatnonzero(~first_block))
    links, least, label, met = np.zeros(len(node), np.int64), node.copy(), np.arange(len(node)), None
    for lo in range(0, len(rows), 512):
        part = rows[lo : lo + 512]
        i, j = np.nonzero(x[part] @ x[cols].T >= cosine - 1e-9)
        i, j = part[i], cols[j]
        keep = i < j if same else i != j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        exact = np.concatenate([(x[i[a : a + PAIRS]] * x[j[a : a + PAIRS]]).sum(axis=1) >= cosine for a in range(0, len(i), PAIRS)])
        i, j = i[exact], j[exact]
        np.minimum.at(least, i, node[j])
        np.minimum.at(least, j, node[i])
        label = merge_labels(label, i, j)
        if at:
            met = signatures(x, k, tables, width)[:, :at] if met is None else met
            fresh = np.ones(len(i), bool)
            for before in range(at):
                fresh &= met[i, before] != met[j, before]
            i, j = i[fresh], j[fresh]
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
    root = node.copy()
    np.minimum.at(root, label, node)
    return links, least, root[label]


def linked(reps: DataFrame, cosine: float, k: int, tables: int, width: float, block: int = BLOCK) -> DataFrame:
    """node, links, least, root of reps(node, size, vector): partial counts of linked vectors, the smallest linked node (or itself), and the smallest node of its class in a block."""
    kind = vector_kind(reps)
    buckets = cut(hashed(reps.select("node", "vector"), k, tables, width))
    sizes = buckets.groupBy(F.col("table").alias("b_table"), F.col("bucket").alias("b_bucket")).agg(F.count("*").alias("n")).filter("n > 1")
    rows = buckets.join(sizes, (F.col("table") == F.col("b_table")) & (F.col("bucket") == F.col("b_bucket")))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high"), (F.col("own") > o).cast("int").alias("side")))
    rows = rows.join(as_bytes(reps), "node").select("table", "bucket", "node", "size", "vector", F.inline(pairs))
    keys = ["table", "bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in stream_groups(batches, keys):
            lengths = pc.binary_length(group.column("vector"))
            for d in pc.unique(lengths).to_pylist():
                part = group.filter(pc.equal(lengths, d))
                links, least, root = compare(part, key[0], key[2] == key[3], cosine, kind, k, tables, width)
                node = part.column("node").to_numpy()
                some = (links > 0) | (least < node) | (root != node)
                if some.any():
                    yield pa.RecordBatch.from_pydict({"node": node[some], "links": links[some], "least": least[some], "root": root[some]})

    return typed(rows.repartition(*keys).sortWithinPartitions(*keys), run, "node long, links long, least long, root long")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings(vec_id, embedding)."""
    single = isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType)
    element = "float" if single else "double"
    rows = embeddings.select("vec_id", F.col("embedding").cast(f"array<{element}>").alias("vector"))
    zero = F.lit(0.0).cast(element)  # added to turn -0 into 0
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.transform("vector", lambda x: x + zero)))
    reps = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("size"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))  # as written: ids can be null
    k, tables, width = plan(reps.count(), cosine, recall)
    found = cut(linked(reps, cosine, k, tables, width, block))
    counts = found.groupBy(F.col("node").alias("c_node")).agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "k_node")
    per_rep = reps.join(counts, F.col("node") == F.col("c_node"), "left").join(classes, F.col("node") == F.col("k_node"), "left")
    per_rep = per_rep.select(F.col("vector").alias("r_vector"), "least_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("component", "node").alias("k_class"))
    per_rep = per_rep.join(per_rep.groupBy(F.col("k_class").alias("l_class")).agg(F.min("least_id").alias("class")), F.col("k_class") == F.col("l_class"))
    joined = rows.join(per_rep, F.col("vector") == F.col("r_vector"), "left")
    out = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("r_vector").isNull(), F.col("vec_id")).otherwise(F.col("class")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
