"""Paging: keyset pages over a collection, materialised results, and the cursors that remember where a client is.

A find cursor is a bookmark, not a snapshot: each page is a fresh query for what lies beyond the last _id, with a limit,
so a page costs a top-k over a pushed-down range however deep it is.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ProtocolError
from ..functions.cells import quoted
from ..model import ID, is_tagged, read_row
from ..plans.filters import access_path
from .reads import at_least_zero, matching


@dataclass
class Page:
    documents: list[dict]
    bookmark: Any
    reached_end: bool


def page_frame(frame: DataFrame, filter_doc: Any, size: int = 0, skip: int = 0, bookmark: Any = None) -> DataFrame:
    """The page after a bookmark (the last _id seen, as collected); size 0 is unlimited. Skip counts on the first page only."""
    found = matching(frame, filter_doc)
    if bookmark is not None:
        last = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(bookmark, frame.schema[ID].dataType)]) if is_tagged(frame.schema[ID].dataType) else F.lit(bookmark)
        found = found.filter(quoted(ID) > last)
        skip = 0
    if access_path(filter_doc).kind == "id_lookup":
        skip = 0
    found = found.orderBy(quoted(ID))
    found = found.offset(skip) if skip else found
    return found.limit(size) if size else found


def page(frame: DataFrame, filter_doc: Any, size: int = 0, skip: int = 0, bookmark: Any = None) -> Page:
    """Collects one page, looking one document ahead to know whether it is the last."""
    found = page_frame(frame, filter_doc, size + 1 if size else 0, skip, bookmark)
    rows = found.collect()  # a page, or what the client asked for without a limit
    shown = rows[:size] if size else rows
    last = shown[-1][ID] if shown else bookmark
    return Page([read_row(r, found.schema) for r in shown], tuple(last) if hasattr(last, "asDict") else last, len(rows) <= len(shown))


@dataclass
class FindCursor:
    namespace: str
    frame: Callable[[], DataFrame]
    filter_doc: Any
    batch_size: int = 0
    remaining: int | None = None
    bookmark: Any = None
    tailable: bool = False
    await_data: bool = False
    single_batch: bool = False

    def next_page(self, batch_size: int | None = None, skip: int = 0) -> tuple[Page, bool]:
        """The next page, and whether the cursor stays open."""
        size = self.batch_size if batch_size is None else batch_size
        if self.remaining is not None:
            size = min(size, self.remaining) if size else self.remaining
        found = page(self.frame(), self.filter_doc, size, skip, self.bookmark)
        self.bookmark = found.bookmark
        if self.remaining is not None:
            self.remaining -= len(found.documents)
        done = self.single_batch or self.remaining == 0
        return found, not done and (self.tailable or not found.reached_end)


@dataclass
class MaterializedCursor:
    namespace: str
    documents: list[dict]
    batch_size: int = 0
    at: int = 0

    def next_page(self, batch_size: int | None = None, skip: int = 0) -> tuple[Page, bool]:
        size = self.batch_size if batch_size is None else batch_size
        end = self.at + size if size else len(self.documents)
        shown = self.documents[self.at : end]
        self.at += len(shown)
        return Page(shown, self.at, self.at >= len(self.documents)), self.at < len(self.documents)


@dataclass
class CursorManager:
    """Open cursors by number."""

    _open: dict[int, FindCursor | MaterializedCursor] = field(default_factory=dict)
    _next: int = 1
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def create(self, cursor: FindCursor | MaterializedCursor) -> int:
        with self._lock:
            number, self._next = self._next, self._next + 1
            self._open[number] = cursor
            return number

    def take(self, number: int) -> FindCursor | MaterializedCursor:
        with self._lock:
            if number not in self._open:
                raise ProtocolError(f"cursor not found: {number}")
            return self._open.pop(number)

    def restore(self, number: int, cursor: FindCursor | MaterializedCursor) -> None:
        with self._lock:
            self._open[number] = cursor

    def kill(self, number: int) -> bool:
        with self._lock:
            return self._open.pop(number, None) is not None


def batch_size(value: Any) -> int:
    """0, negative, absent or no whole number: unlimited."""
    return at_least_zero(value)
