"""Repeated byte strings across documents, by LCP intervals of bucketed enhanced suffix arrays.

Every string of LENGTH bytes has an anchor: of the GRAM-byte strings within it, the leftmost one of least hash.
Equal strings have equal anchors at equal places. The strings of a document that follow one another and
have one anchor make a piece, of at most MOST bytes. So a repeat can be found among pieces of one anchor:

1. Workers send anchor hashes, each once per slice of documents, to the range of the hash; those seen in two
   documents are written there as a sorted hash array.
2. Workers send the pieces of such anchors, each distinct piece once per slice with its first document.
   The task of a range takes equal pieces together. Where an anchor has different pieces, their suffixes of
   at least LENGTH bytes are sorted with the lengths of their common prefixes, and a stack scan builds the
   tree of common-prefix intervals. An interval whose occurrences have different bytes to the left is a
   maximal repeat; its group is all its occurrences, and its first document the least of theirs.
   Pieces and their groups' first documents are written as sorted hash arrays.
3. Workers look up their documents' pieces and know which bytes an earlier document has as well.

A passage that a third of all documents share is one row per slice. What stands at its edges differs from document to
document, so one anchor can have very many different pieces. The pieces of an anchor that more than OFTEN documents
have are cut into their single strings, each under its own hash: equal strings still meet, others are apart. So a group
is at most OFTEN pieces, or one string per slice. A long document is read in blocks, whose edges only cut pieces, which
step 2 takes care of.

Defined results: null text counts as empty; a null id counts as the largest; rows of one id never mark each
other; strings are judged on the input, and overlaps count; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_size, stream_groups, typed, utf8
from .store import Ranges, blobs, get, new_store, put, runs, squeeze, squeeze_sorted, summed, unsqueeze, unsqueeze_sorted

LENGTH, GRAM = 50, 25
GRAMS = LENGTH - GRAM + 1
#: Longest piece: GRAMS strings that follow one another.
MOST = LENGTH + GRAMS - 1
SLICE, BLOCK, HELD = 4_000_000, 1_000_000, 1_500_000
#: Bytes of units that a worker gathers before it sends them.
SENT = 12_000_000
#: Documents that may have an anchor whose pieces are kept together.
OFTEN = 5_000
LAST = 2**63 - 1
BASE = 0x9E3779B97F4A7C15
STIR = np.uint64(0xD6E8FEB86659FD93)
POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    if not POWERS or len(POWERS[0]) < n:
        POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 2**64))]
    return POWERS[0][:n], POWERS[1][:n]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of `width` bytes, by where it begins."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= STIR
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes, and for each string of LENGTH bytes where its anchor begins."""
    h = window_hashes(data, GRAM)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    span = 1
    while 2 * span <= GRAMS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < GRAMS:
        least = np.minimum(least[: len(least) - (GRAMS - span)], least[GRAMS - span :])
    return h, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def evened(hashes: np.ndarray) -> np.ndarray:
    """A one-to-one function that spreads anchors' hashes, which are small ones by their choice, evenly over all numbers."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * STIR
    return hashes ^ (hashes >> np.uint64(29))


class Slice:
    """Some whole documents as one array of bytes, with their pieces."""

    def __init__(self, rows: pa.Table) -> None:
        ids, texts = rows.column(0).to_pylist(), [utf8(x) for x in rows.column(1).to_pylist()]
        self.rows, self.ids, self.raw = rows, ids, b"".join(texts)
        self.key = np.array([LAST if x is None else x for x in ids], np.int64)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        data = np.frombuffer(self.raw, np.uint8)
        # strings that begin here lie within a document
        edge = np.zeros(len(data) + 1, np.int32)
        fit = self.size >= LENGTH
        np.add.at(edge, self.start[fit], 1)
        np.add.at(edge, (self.start + self.size - LENGTH + 1)[fit], -1)
        within = np.cumsum(edge[:-1]) > 0
        first, end, hashes = [], [], []
        for at in range(0, len(data) - LENGTH + 1, BLOCK):
            h, anchor = anchors(data[at : at + BLOCK + LENGTH - 1])
            anchor = np.where(within[at : at + len(anchor)], anchor, -1)
            fresh = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            stop = np.r_[fresh[1:], len(anchor)]
            real = anchor[fresh] >= 0
            first.append(fresh[real] + at)
            end.append(stop[real] + at + LENGTH - 1)
            hashes.append(evened(h[anchor[fresh[real]]]))
        none = np.zeros(0, np.int64)
        self.first, self.end = np.concatenate([none, *first]), np.concatenate([none, *end])
        self.hash = np.concatenate([none.astype(np.uint64), *hashes])
        self.doc = np.searchsorted(self.start, self.first, side="right") - 1


class Units:
    """The pieces of a slice whose anchor repeats, or for a frequent anchor their single strings, in the order of their range."""

    def __init__(self, part: Slice, known: Ranges) -> None:
        order = np.argsort(part.hash)
        shard, place = known.place(part.hash[order])
        often = known.read("often", shard, place) > 0
        plain, cut = order[(place >= 0) & ~often], order[(place >= 0) & often]
        n = part.end[cut] - part.first[cut] - LENGTH + 1
        begin = np.repeat(part.first[cut], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.first, self.end = np.concatenate([part.first[plain], begin]), np.concatenate([part.end[plain], begin + LENGTH])
        self.doc = np.concatenate([part.doc[plain], np.repeat(part.doc[cut], n)])
        raw, of = part.raw, xxhash.xxh64_intdigest
        self.content = np.fromiter((of(raw[a:b]) for a, b in zip(self.first.tolist(), self.end.tolist())), np.uint64, len(self.first))
        self.key = np.concatenate([part.hash[plain], self.content[len(plain) :]])
        self.shard = (self.key >> np.uint64(64 - known.bits)).astype(np.int64)
        self.pick(np.argsort(self.shard, kind="stable"))

    def pick(self, which: np.ndarray) -> None:
        for name in ("first", "end", "doc", "content", "key", "shard"):
            setattr(self, name, getattr(self, name)[which])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    return map(Slice, by_size(batches, 1, SLICE))


def repeated_anchors(docs: DataFrame, store: str, bits: int, often: int) -> Ranges:
    """Ranges "anchor": hashes of the anchors that two documents have, with "often": whether more than `often` have it."""
    shift = np.uint64(64 - bits)

    def sent(held: list) -> pa.RecordBatch:
        keys, times = summed(*map(np.concatenate, zip(*held)))
        return blobs((keys >> shift).astype(np.int64), keys, times)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in slices(batches):
            order = np.argsort(part.hash, kind="stable")
            keys, ids = part.hash[order], part.key[part.doc[order]]
            if not len(keys):
                continue
            fresh = np.r_[True, keys[1:] != keys[:-1]]
            other = fresh | np.r_[True, ids[1:] != ids[:-1]]
            begin = np.flatnonzero(fresh)
            held.append((keys[begin], np.add.reduceat(other.astype(np.int64), begin)))
            n += len(begin)
            if n > HELD:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in stream_groups(batches, ["shard"]):
            keys = np.concatenate([unsqueeze_sorted(x) for x in rows.column("keys").to_pylist()])
            keys, times = summed(keys, np.concatenate([unsqueeze(x) for x in rows.column("c0").to_pylist()]).astype(np.int64))
            put(store, f"anchor-{shard}", keys[times > 1])
            put(store, f"often-{shard}", (times > often)[times > 1].astype(np.uint8))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "size": [int((times > 1).sum())]})

    sent_rows = typed(docs, count, "shard int, keys binary, c0 binary")
    done = typed(sent_rows.repartition("shard").sortWithinPartitions("shard"), write, "shard int, size long").collect()  # a row per range
    return Ranges(store, "anchor", bits, {r["shard"]: r["size"] for r in done})


class Outgoing:
    """Distinct units of several slices, until there are enough of them to send."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.data: list[bytes] = []
        self.size = 0

    def add(self, part: Slice, units: Units) -> None:
        ids = part.key[units.doc]
        if not len(ids):
            return
        order = np.lexsort((ids, units.content))
        units.pick(order)
        ids = ids[order]
        fresh = np.flatnonzero(np.r_[True, units.content[1:] != units.content[:-1]])
        several = ids[fresh] != np.maximum.reduceat(ids, fresh)
        units.pick(fresh)
        self.parts.append((units.shard, units.key, units.content, ids[fresh], several, units.end - units.first))
        self.data += [part.raw[a:b] for a, b in zip(units.first.tolist(), units.end.tolist())]
        self.size += int(self.parts[-1][5].sum())

    def sent(self) -> pa.RecordBatch:
        """A row per range: key, first document, length (+128 if in several documents) and bytes of its units, compressed."""
        shard, key, content, ids, several, length = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((ids, content))
        fresh = np.flatnonzero(np.r_[True, content[order[1:]] != content[order[:-1]]])
        several = np.logical_or.reduceat(several[order], fresh) | (ids[order[fresh]] != np.maximum.reduceat(ids[order], fresh))
        one = order[fresh]
        marked = (length[one] + 128 * several).astype(np.uint8)
        by = np.lexsort((key[one], shard[one]))
        one, marked = one[by], marked[by]
        out: dict[str, list] = {"shard": [], "keys": [], "ids": [], "sizes": [], "data": []}
        for s, a, b in runs(shard[one]):
            out["shard"].append(s)
            out["keys"].append(squeeze_sorted(key[one[a:b]]))
            out["ids"].append(squeeze(ids[one[a:b]]))
            out["sizes"].append(squeeze(marked[a:b]))
            out["data"].append(zstandard.ZstdCompressor(level=1).compress(b"".join([self.data[i] for i in one[a:b].tolist()])))
        self.__init__()
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in out.items()})


def pieces(docs: DataFrame, known: Ranges) -> DataFrame:
    """Compressed rows of distinct units by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Outgoing()
        for part in slices(batches):
            out.add(part, Units(part, known))
            if out.size > SENT:
                yield out.sent()
        if out.size:
            yield out.sent()

    return typed(docs, run, "shard int, keys binary, ids binary, sizes binary, data binary")


def prefix_intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last + 1) of each common-prefix interval of at least `least`; common[i] is that of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common, 0]):
        begin = i
        while stack and stack[-1][0] > c:
            length, begin = stack.pop()
            yield length, begin, i + 1
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, begin))


def maximal_groups(data: np.ndarray, size: np.ndarray, group: np.ndarray, least: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats among the rows of each group: their length, and the rows and offsets of all occurrences.

    data has a row of bytes per piece, filled up with zeros; size is its length; group is ascending.
    """
    n = np.maximum(size - least + 1, 0)
    row = np.repeat(np.arange(len(size)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    # only strings that occur twice in a group can be in an interval
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(data.shape[1] - 1, BASE, np.uint64)])
    sums = np.zeros((len(data), data.shape[1] + 1), np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[:, 1:])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(data.shape[1] - 1, pow(BASE, -1, 2**64), np.uint64)])
    label = (sums[row, offset + least] - sums[row, offset]) * down[offset]
    order = np.lexsort((label, group[row]))
    same = (label[order[1:]] == label[order[:-1]]) & (group[row[order[1:]]] == group[row[order[:-1]]])
    twice = np.zeros(len(row), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    row, offset = row[twice], offset[twice]
    if not len(row):
        return
    # the suffix array: sorted suffixes, and the common prefix of each with the next
    width = -(-data.shape[1] // 8) * 8
    wide = np.zeros((len(data), 2 * width), np.uint8)
    wide[:, : data.shape[1]] = data
    suffix = np.lib.stride_tricks.sliding_window_view(wide, width, axis=1)[row, offset]
    words = np.ascontiguousarray(suffix).view(">u8")
    order = np.lexsort([*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group[row]])
    row, offset, suffix = row[order], offset[order], suffix[order]
    differ = suffix[1:] != suffix[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    left_over = size[row] - offset
    common = np.minimum(common, np.minimum(left_over[1:], left_over[:-1]))
    common[group[row[1:]] != group[row[:-1]]] = 0
    before = np.where(offset > 0, data[row, offset - 1].astype(np.int64), -1 - np.arange(len(row)))  # where a piece begins nothing is known: differs from all
    for length, a, b in prefix_intervals(common.tolist(), least):
        if (before[a:b] != before[a]).any():
            yield length, row[a:b], offset[a:b]


def blocks_of_groups(key: np.ndarray, most: int = 8_000) -> Iterator[slice]:
    """Slices of an ascending key of about `most` rows that cut no group in two."""
    edge = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)] if len(key) else np.zeros(1, np.int64)
    at = 0
    while at < len(key):
        end = int(edge[max(np.searchsorted(edge, at + most, "right") - 1, np.searchsorted(edge, at, "right"))])
        yield slice(at, end)
        at = end


def first_documents(docs: DataFrame, store: str, known: Ranges) -> Ranges:
    """Ranges "piece": sorted hashes of pieces, with "low", "high" (strings of the piece, by where they begin) and "doc", which has them."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in stream_groups(batches, ["shard"]):
            column = lambda name, f: [f(x) for x in rows.column(name).to_pylist()]
            anchor, ids, sizes = np.concatenate(column("keys", unsqueeze_sorted)), np.concatenate(column("ids", unsqueeze)), np.concatenate(column("sizes", unsqueeze))
            raw = b"".join(column("data", zstandard.ZstdDecompressor().decompress))
            several, sizes = sizes >= 128, (sizes & 127).astype(np.int64)
            end = np.cumsum(sizes)
            of = xxhash.xxh64_intdigest
            content = np.fromiter((of(raw[b - n : b]) for b, n in zip(end.tolist(), sizes.tolist())), np.uint64, len(sizes))
            order = np.lexsort((ids, content))
            fresh = np.flatnonzero(np.r_[True, content[order[1:]] != content[order[:-1]]])
            shared = np.logical_or.reduceat(several[order], fresh) | (ids[order[fresh]] != np.maximum.reduceat(ids[order], fresh))
            one = order[fresh]  # of each distinct piece, the row of its first document
            anchor, ids, sizes, content, end = anchor[one], ids[one], sizes[one], content[one], end[one]
            found = [(content[shared], np.zeros(shared.sum(), np.int64), sizes[shared] - LENGTH, ids[shared])]
            by = np.argsort(anchor, kind="stable")
            several_pieces = np.flatnonzero(anchor[by[1:]] == anchor[by[:-1]])
            by = by[np.union1d(several_pieces, several_pieces + 1)]
            later: list[tuple] = []
            for part in blocks_of_groups(anchor[by]):
                rows = by[part]
                data = np.zeros((len(rows), MOST), np.uint8)
                data[np.arange(MOST) < sizes[rows, None]] = np.frombuffer(b"".join([raw[b - n : b] for b, n in zip(end[rows].tolist(), sizes[rows].tolist())]), np.uint8)
                group = np.cumsum(np.r_[False, anchor[rows[1:]] != anchor[rows[:-1]]])
                for length, at, offset in maximal_groups(data, sizes[rows], group):
                    own = ids[rows[at]]
                    late = own > (least := own.min())
                    if late.any():
                        later.append((rows[at[late]], offset[late], offset[late] + length - LENGTH, np.full(late.sum(), least)))
            if later:
                at, low, high, least = map(np.concatenate, zip(*later))
                found.append((content[at], low, high, least))
            content, low, high, first = map(np.concatenate, zip(*found))
            order = np.argsort(content, kind="stable")
            for name, values in (("piece", content), ("low", low.astype(np.uint8)), ("high", high.astype(np.uint8)), ("doc", first)):
                put(store, f"{name}-{shard}", values[order])
            yield pa.RecordBatch.from_pydict({"shard": [shard], "size": [len(content)]})

    rows = pieces(docs, known).repartition("shard").sortWithinPartitions("shard")
    done = typed(rows, write, "shard int, size long").collect()  # a row per range
    return Ranges(store, "piece", known.bits, {r["shard"]: r["size"] for r in done})


def found_in(part: Slice, known: Ranges, firsts: Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of a slice that an earlier document has: number of the document within the slice, begin, end (in the slice), earlier document."""
    units, out = Units(part, known), []
    for s, a, b in runs(units.shard):
        if not firsts.sizes.get(s):
            continue
        held = get(firsts.store, f"piece-{s}")
        left, right = np.searchsorted(held, units.content[a:b], "left"), np.searchsorted(held, units.content[a:b], "right")
        n = right - left
        at = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(np.arange(a, b), n)
        first = get(firsts.store, f"doc-{s}")[at]
        earlier = first < part.key[units.doc[own]]
        at, own = at[earlier], own[earlier]
        out.append((units.doc[own], units.first[own] + get(firsts.store, f"low-{s}")[at], units.first[own] + get(firsts.store, f"high-{s}")[at] + LENGTH, first[earlier]))
    none = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out))) if out else (none,) * 4


def removed(part: Slice, known: Ranges, firsts: Ranges) -> np.ndarray:
    """Which bytes of a slice an earlier document has as well."""
    _, begin, end, _ = found_in(part, known, firsts)
    edge = np.zeros(len(part.raw) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def with_repeats(docs: DataFrame, each: Callable[[Slice, Ranges, Ranges], dict], schema: str | StructType, often: int) -> DataFrame:
    """each() of every slice of docs, whose first columns are doc_id and text."""
    spark = docs.sparkSession
    store = new_store(spark, "repeats")
    bits = max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    texts = docs.select("doc_id", "text")
    known = repeated_anchors(texts, store, bits, often)
    firsts = first_documents(texts, store, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict(each(part, known, firsts))

    return typed(docs, run, schema)


def occurrences(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """doc_id, begin, end, first_doc_id: spans of a document that an earlier one has, each with that one; spans may overlap."""

    def each(part: Slice, known: Ranges, firsts: Ranges) -> dict:
        doc, begin, end, first = found_in(part, known, firsts)
        return {"doc_id": [part.ids[i] for i in doc], "begin": begin - part.start[doc], "end": end - part.start[doc], "first_doc_id": first}

    return with_repeats(docs.select("doc_id", "text"), each, "doc_id long, begin long, end long, first_doc_id long", often)


def kept_parts(part: Slice, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Of each document of a slice: bytes removed, their runs, and the bytes left."""
    data = np.frombuffer(part.raw, np.uint8)
    for a, n in zip(part.start.tolist(), part.size.tolist()):
        own = gone[a : a + n]
        count = int(np.count_nonzero(own))
        spans = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if count else 0
        yield count, spans, data[a : a + n][~own].tobytes() if count else part.raw[a : a + n]


def kept_bytes(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of every row."""

    def each(part: Slice, known: Ranges, firsts: Ranges) -> dict:
        count, spans, kept = zip(*kept_parts(part, removed(part, known, firsts)))
        return {"doc_id": part.ids, "n_bytes": part.size, "n_removed": count, "n_spans": spans, "kept": pa.array(kept, pa.binary())}

    return with_repeats(docs.select("doc_id", "text"), each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", often)


def without_repeats(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """docs with the text that is left; characters cut in two are dropped, a text without repeats stays as it is, null too.

    Other columns pass through, except n_chars, if there, which follows the text. Documents of which only blanks are
    left, though they had a word, go.
    """
    ordered = docs.select("doc_id", "text", *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])

    def each(part: Slice, known: Ranges, firsts: Ranges) -> dict:
        texts = part.rows.column(1).to_pylist()
        count, _, kept = zip(*kept_parts(part, removed(part, known, firsts)))
        new = [k.decode("utf-8", "ignore") if n else x for x, n, k in zip(texts, count, kept)]
        stay = [not n or bool(k.strip()) for n, k in zip(count, kept)]
        rows = part.rows.set_column(1, "text", pa.array(new, pa.string()))
        if "n_chars" in rows.column_names:
            at = rows.column_names.index("n_chars")
            lengths = [len(x) if n else old for x, n, old in zip(new, count, rows.column(at).to_pylist())]
            rows = rows.set_column(at, "n_chars", pa.array(lengths, rows.schema.field(at).type))
        return rows.filter(pa.array(stay)).combine_chunks().to_pydict()

    return with_repeats(ordered, each, ordered.schema, often).select(*[F.col(f"`{c}`") for c in docs.columns])
