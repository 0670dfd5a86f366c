"""Token counts of a byte-level BPE vocabulary without building identifiers.

A text is cut at the vocabulary's special strings and then into pieces by the byte-level pattern. A
piece starts as one symbol per byte in a doubly linked list; a heap holds the adjacent pairs that have
a merge rank. The lowest rank, leftmost first, is popped and merged until none is left. The count is the
number of initial symbols minus the merges. Pieces and runs of them repeat, so each worker keeps bounded memos of counts.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted row by row; an
empty table gives no rows; other columns are not read. Whole texts of any length are counted.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Memo, typed, utf8

#: The public byte-level pattern, and the bytes that it shows as themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: White space besides the ASCII kinds; texts that hold any are cut by the full pattern at once.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: A run of other characters with the space before it, or the space between runs: no piece crosses these cuts.
RUN = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
#: Texts that are not cut before each blank: neighbouring or final blanks, other white space, and the mark used to cut.
UNEVEN = "[ \t\n\r\x0b\x0c][ \t\n\r\x0b\x0c]|[ \t\n\r\x0b\x0c]$|[" + ODD_SPACE.pattern[1:-1] + "\0]"
#: Runs, and pieces, remembered in a generation.
MEMO = 400_000
#: Documents whose runs are looked up together.
SLICE = 1500


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: shown bytes as themselves, the rest from U+0100 on."""
    rest = [b for b in range(256) if b not in set(SHOWN)]
    return {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Mergers of this worker process, by digest of their file; they keep their memo from task to task.
MERGERS: dict[str, PairMerger] = {}


def merger_of(spec: str) -> PairMerger:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in MERGERS:
        MERGERS[name] = PairMerger(spec)
    return MERGERS[name]


class PairMerger:
    """Counts tokens of pieces under a ranked merge table."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        self.split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters, number = byte_letters(), {}
        self.start = [number.setdefault(letters[b], len(number)) for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ids = [number.setdefault(x, len(number)) for x in (left, right, left + right)]
            self.merges.setdefault((ids[0], ids[1]), (rank, ids[2]))
        self.pattern = regex.compile(PATTERN)
        self.runs, self.pieces = Memo({}), Memo({})

    def count_piece(self, piece: bytes) -> int:
        """Initial symbols minus merges, by a heap over a linked list."""
        n = len(piece)
        if n < 2:
            return n
        merges = self.merges
        symbol = [self.start[b] for b in piece]
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if hit := merges.get((symbol[i], symbol[i + 1])):
                heap.append((hit[0], i, symbol[i], symbol[i + 1], hit[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            if symbol[i] != left or (j := following[i]) >= n or symbol[j] != right:
                continue  # one of the pair has gone into another merge
            symbol[i], symbol[j] = new, -1
            after = following[i] = following[j]
            merged += 1
            if after < n:
                before[after] = i
                if hit := merges.get((new, symbol[after])):
                    heapq.heappush(heap, (hit[0], i, new, symbol[after], hit[1]))
            if (prior := before[i]) >= 0 and (hit := merges.get((symbol[prior], new))):
                heapq.heappush(heap, (hit[0], prior, symbol[prior], new, hit[1]))
        return n - merged

    def count_known(self, piece: str) -> int:
        try:
            return self.pieces[piece]
        except KeyError:
            n = self.count_piece(utf8(piece))
            if len(piece) <= 32:
                if len(self.pieces) >= MEMO:
                    self.pieces = Memo(self.pieces)
                self.pieces[piece] = n
            return n

    def count_run(self, run: str) -> int:
        try:
            return self.runs[run]
        except KeyError:
            total = sum(map(self.count_known, self.pattern.findall(run)))
            if len(run) <= 64:
                if len(self.runs) >= MEMO:
                    self.runs = Memo(self.runs)
                self.runs[run] = total
            return total

    def count(self, text: str) -> int:
        total = 0
        if self.split is not None and any(x in text for x in self.special):
            total = len(self.split.findall(text))
            return total + sum(map(self.count_plain, self.split.split(text)))
        return self.count_plain(text)

    def count_plain(self, text: str) -> int:
        if ODD_SPACE.search(text):
            return sum(map(self.count_known, self.pattern.findall(text)))
        return sum(map(self.count_run, RUN.findall(text)))


def count_all(merger: PairMerger, texts: pa.Array) -> np.ndarray:
    """Token counts of a column of texts.

    Where blanks stand alone and none ends the text, a piece boundary is before every blank: such texts are cut there, and
    each distinct run is looked up once. The others are counted one by one.
    """
    texts = pc.fill_null(texts, "")
    apart = pc.match_substring_regex(texts, UNEVEN)
    if merger.special:
        apart = pc.or_(apart, pc.match_substring_regex(texts, "|".join(map(re.escape, merger.special))))
    counts = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
        counts[i] = merger.count(texts[i].as_py())
    plain = pc.invert(apart)
    split = pc.split_pattern(pc.replace_substring_regex(texts.filter(plain), "([ \t\n\r\x0b\x0c])", "\0\\1"), "\0")
    numbered = split.flatten().dictionary_encode()
    found = np.array(list(map(merger.count_run, numbered.dictionary.to_pylist())), np.int64)
    total = np.r_[0, np.cumsum(found[numbered.indices.to_numpy()])]
    bounds = split.offsets.to_numpy()
    counts[plain.to_numpy(zero_copy_only=False)] = total[bounds[1:]] - total[bounds[:-1]]
    return counts


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row; `vocabulary`: path of a byte-level BPE .json.

    The vocabulary is a file of fixed size (about 2 MB) that the driver reads and broadcasts.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = count_all(merger, part.column(1))
                size = pc.fill_null(pc.binary_length(part.column(1)), 0)
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    return typed(docs.select(id_col, text_col), run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
