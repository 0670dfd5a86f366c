"""Helpers shared by the operators: Arrow maps, checkpoints, ordered group streams, spark settings."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.files import shared_folder

#: Separators of words: space and \t \n \v \f \r; bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


folder = shared_folder

#: Applications whose workers have been given this package.
SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application, for those that don't have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    if package.is_dir():  # else it came from such an archive
        archive = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        sc.addPyFile(archive)
    SHIPPED.add(sc.applicationId)


#: Bytes of an Arrow batch; several workers and tasks hold one or two each, inside and outside the JVM.
BATCH = 8 * 2**20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: ten thousand long texts would be far more than a worker needs at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH:
        spark.conf.set(name, BATCH)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of plain values as a frame that needs no Python on the executors."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in schema.split(", "))
    given = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.inline(given.cast(f"array<struct<{kind}>>")))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def release(*frames: DataFrame) -> None:
    """Deletes the checkpoints under frames that nothing needs any more, and lets the cluster drop the shuffles that led to them.

    Only for frames whose successors are written already: no later job, nor the repeat of a lost task, reads them. Shuffle files go when the
    driver collects its garbage, which a driver with room to spare does rarely; loops would leave those of all their steps.
    """
    for frame in frames:
        sc = frame.sparkSession.sparkContext
        leaves = frame._jdf.queryExecution().analyzed().collectLeaves()
        for i in range(leaves.size()):
            leaf = leaves.apply(i)
            if leaf.nodeName() == "Scan ExistingRDD" or leaf.getClass().getSimpleName() == "LogicalRDD":
                file = leaf.rdd().getCheckpointFile()
                if file.isDefined():
                    path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
                    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is the empty text."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


#: Fixed by the contract of fingerprints.
HASH_SEED = 42


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words, lower-cased and joined by a space; of fewer words, of all of them; none of no words."""
    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n, of = b" ".join(words), len(words) - shingle + 1, xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([of(joined, HASH_SEED)], np.uint64)
    after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    ends = (after[shingle - 1 :] - 1).tolist()
    starts = [0, *after[: n - 1].tolist()]
    return np.array([of(joined[a:b], HASH_SEED) for a, b in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some hashes, as a signed 64-bit number."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def give_back() -> None:
    """Returns a worker's free memory to the system; workers wait for further tasks, and their free memory adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not the GNU library
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, each: Callable[[dict[str, list]], dict[str, list]], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with bounded slices: each() gets the columns of up to `rows` rows as lists, and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = each({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out)

    return typed(df, run, schema)


def typed(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose batches are cast to the declared schema, in its column order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            columns = [batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target)
        give_back()

    return df.mapInArrow(cast, schema)


def stream_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The groups of a stream sorted by `keys`; holds one group at a time besides the current batch."""
    held: list[pa.RecordBatch] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = None
        for k in keys:
            col = batch.column(k)
            differs = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)), True)
            change = differs if change is None else pc.or_(change, differs)
        starts = [0, *(i + 1 for i in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held_key, pa.Table.from_batches(held)


def aligned(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of about `rows` rows of a stream sorted by `keys` that cut no group in two."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held.append(table)
        n += table.num_rows
        if n < rows:
            continue
        whole = pa.concat_tables(held).combine_chunks()
        last = [whole.column(k)[n - 1].as_py() for k in keys]
        lo, hi = 0, n - 1
        while lo < hi:  # the first row of the last group; equal rows are at the end
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if [whole.column(k)[mid].as_py() for k in keys] == last else (mid + 1, hi)
        if lo:
            yield whole.slice(0, lo)
        held, n = [whole.slice(lo)], n - lo
    if n:
        yield pa.concat_tables(held).combine_chunks()


def by_size(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.Table]:
    """The rows in tables of about `size` bytes of one text column; a longer text is a table's last."""
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        lengths = pc.fill_null(pc.binary_length(table.column(column)), 0).to_pylist()
        first = 0
        for i, length in enumerate(lengths):
            n += length
            if n >= size:
                yield pa.concat_tables([*held, table.slice(first, i + 1 - first)])
                held, n, first = [], 0, i + 1
        if first < len(lengths):
            held.append(table.slice(first))
    if held:
        yield pa.concat_tables(held)


class Memo(dict):
    """Remembered values; those of the generation before are taken over when they are used again, the rest go with it."""

    def __init__(self, older: dict) -> None:
        super().__init__()
        self.older = dict(older)

    def __missing__(self, key: str) -> Any:
        found = self[key] = self.older[key]
        return found
