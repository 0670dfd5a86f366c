"""Raw ordered key and value objects: range scans over a DataFrame of binary keys, and cursors with their write contract."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StorageError

SCHEMA = "key binary, value binary"


def key_range(frame: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Entries with start <= key < end, in key order; an open side is None."""
    if start is not None:
        frame = frame.filter(F.col("key") >= F.lit(start))
    if end is not None:
        frame = frame.filter(F.col("key") < F.lit(end))
    return frame.orderBy("key")


def changes(spark: SparkSession, pending: dict[bytes, bytes | None]) -> tuple[DataFrame | None, DataFrame | None]:
    """A transaction's own writes as entries and as deleted keys."""
    written = [(k, v) for k, v in pending.items() if v is not None]
    gone = [(k,) for k, v in pending.items() if v is None]
    return spark.createDataFrame(written, SCHEMA) if written else None, spark.createDataFrame(gone, "key binary") if gone else None


def merged(frame: DataFrame, pending: dict[bytes, bytes | None]) -> DataFrame:
    """A snapshot with a transaction's own writes; None deletes."""
    for part in changes(frame.sparkSession, pending):
        if part is not None:
            kept = frame.join(part.select("key"), "key", "left_anti").select("key", "value")
            frame = kept.unionByName(part) if "value" in part.columns else kept
    return frame


class KvCursor:
    """A cursor over one object: reads see the transaction's own writes; every write resets the position.

    `frame` gives the object's current entries, `write(key, value)` records a change (None deletes).
    """

    def __init__(self, frame: Callable[[], DataFrame], write: Callable[[bytes, bytes | None], None]) -> None:
        self._frame, self._write = frame, write
        self._start: bytes | None = None
        self._end: bytes | None = None
        self._rows: Iterator | None = None

    def set_range(self, start: bytes | None = None, end: bytes | None = None) -> None:
        self._start, self._end = start, end
        self.reset()

    def reset(self) -> None:
        self._rows = None

    def get(self, key: bytes) -> bytes | None:
        rows = self._frame().filter(F.col("key") == F.lit(key)).select("value").take(1)
        return bytes(rows[0][0]) if rows else None

    def next(self) -> tuple[bytes, bytes] | None:
        if self._rows is None:
            self._rows = key_range(self._frame(), self._start, self._end).toLocalIterator()
        row = next(self._rows, None)
        return None if row is None else (bytes(row["key"]), bytes(row["value"]))

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        while (entry := self.next()) is not None:
            yield entry

    def insert(self, key: bytes, value: bytes) -> None:
        if self.get(key) is not None:
            raise StorageError("duplicate key error")
        self._changed(key, value)

    def update(self, key: bytes, value: bytes) -> None:
        self._known(key)
        self._changed(key, value)

    def delete(self, key: bytes) -> None:
        self._known(key)
        self._changed(key, None)

    def _known(self, key: bytes) -> None:
        if self.get(key) is None:
            raise StorageError("key not found")

    def _changed(self, key: bytes, value: bytes | None) -> None:
        self._write(key, value)
        self.reset()
