"""Interpolated modified Kneser-Ney scores of texts under a bigram model of the corpus.

Counting. Workers count words by 64-bit hash; Spark adds the counts up, and tasks write them as sorted hash
arrays, one per range of hashes. A word's number is its place in that order. Then workers count word pairs:
a pair of numbers times an odd constant is the pair's hash, sorted pieces of hashes and counts go to the task of
their range, which merges them into a sorted hash array. Ranges of such hashes are even however frequent a word
is. From the merged pairs come, for each word, the sums that the model needs: as a context its count and
its numbers of followers seen once, twice and more often; as a follower its number of distinct contexts.

Scoring. Workers memory-map the arrays from the shared folder and look up the words and pairs of a slice of
documents, in sorted order. p(w|h) = max(c(hw) - D, 0) / c(h) + g(h) p(w), with Chen and Goodman's three
discounts, and p(w) is the discounted share of w among distinct pairs, interpolated with 1 / (V + 1).

The model grows with the corpus: no count is cut off; counts that need it take 64 bits. A pair's key holds the numbers of
its words in 32 bits each; a corpus of more distinct words than that is refused with an error. The driver holds a few numbers
per range.

Defined results: null text counts as empty: its only token is the end; a null id counts as the empty text when
documents are dealt to training; repeated rows count twice and are scored row by row; without training
documents every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stream_groups, typed, utf8
from .store import Ranges, blobs, get, narrow, new_store, put, remove, summed, unsqueeze, unsqueeze_sorted

FOLDS, HELD_OUT = 7, 2
#: A text cannot hold these as words, for they hold a space.
END, START = b" end", b" start"
#: Odd, so that multiplication modulo 2**64 can be undone.
MIX = np.uint64(0x9E3779B97F4A7C15)
UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
UNKNOWN = np.uint32(0xFFFFFFFF)
#: Words are fewer than pairs by far; with so many bits less their ranges are, too, and tasks send fewer pieces.
WORD_BITS_LESS = 3
#: Tokens that are looked up together, and pairs that a worker adds up before it sends them.
SLICE, HELD = 600_000, 2_000_000


def held_out(doc_id: int | None) -> bool:
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class Words(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Slice:
    """The tokens of some documents as numbers into a list of distinct words."""

    def __init__(self, ids: list, texts: list[list[bytes]]) -> None:
        words = Words({END: 0})
        number = words.__getitem__
        self.ids, self.train = ids, np.array([not held_out(x) for x in ids], bool)
        self.size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.tokens = np.zeros(int(self.size.sum()), np.int64)
        at = 0
        for t in texts:
            self.tokens[at : at + len(t)] = list(map(number, t))
            at += len(t) + 1
        self.start = np.cumsum(self.size) - self.size
        of = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((of(w) for w in words), np.uint64, len(words))

    def pairs(self, numbers: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token its context's and its own number in the vocabulary; `first` stands before a text."""
        second = numbers[self.tokens]
        before = np.empty_like(second)
        before[1:] = second[:-1]
        before[self.start] = first
        return before, second


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    ids, texts, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = utf8(text).lower().split()
                ids.append(doc_id)
                texts.append(words)
                n += len(words)
                if n >= SLICE:
                    yield Slice(ids, texts)
                    ids, texts, n = [], [], 0
    if ids:
        yield Slice(ids, texts)


def vocabulary(docs: DataFrame, store: str, bits: int) -> tuple[Ranges, int]:
    """The training words as Ranges "word" with "count"; the number of training tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in slices(batches):
            in_train = np.repeat(part.train, part.size)
            c = np.bincount(part.tokens[in_train], minlength=len(part.hashes))
            held.append((part.hashes[c > 0], c[c > 0]))
            n += len(held[-1][0])
            if n > HELD:
                yield sent(*summed(*map(np.concatenate, zip(*held))))
                held, n = [], 0
        if held:
            yield sent(*summed(*map(np.concatenate, zip(*held))))

    def sent(hashes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"hash": hashes.view(np.int64), "n": counts})

    counts = typed(docs, count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("shard", F.shiftrightunsigned("hash", 64 - bits).cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in stream_groups(batches, ["shard"]):
            hashes, n = rows.column("hash").to_numpy().view(np.uint64), rows.column("n").to_numpy()
            order = np.argsort(hashes)
            put(store, f"word-{shard}", hashes[order])
            put(store, f"count-{shard}", n[order])
            yield pa.RecordBatch.from_pydict({"shard": [shard], "size": [len(n)], "total": [int(n.sum())]})

    done = typed(counts.repartition("shard").sortWithinPartitions("shard"), write, "shard int, size long, total long").collect()  # a row per range
    return Ranges(store, "word", bits, {r["shard"]: r["size"] for r in done}), sum(r["total"] for r in done)


def numbered_apart(words: int) -> None:
    """Refuses a vocabulary whose numbers, with that of a text's start, would reach UNKNOWN."""
    if words >= int(UNKNOWN):
        raise OverflowError(f"{words} distinct words; pairs are numbered for fewer than {int(UNKNOWN)}")


def numbered(words: Ranges, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary numbers of hashes (UNKNOWN if not there), and the range and place that they were found at, all in the hashes' order."""
    order = np.argsort(hashes)
    shard, place = words.place(hashes[order])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    numbers = np.where(place >= 0, words.offset[shard] + place, int(UNKNOWN))
    return numbers[back], shard[back], place[back]


def unblob(rows: pa.Table, columns: int) -> tuple[np.ndarray, ...]:
    """The merged keys of a range and the sums of their columns."""
    keys = np.concatenate([unsqueeze_sorted(x) for x in rows.column("keys").to_pylist()])
    return summed(keys, *(np.concatenate([unsqueeze(x) for x in rows.column(f"c{i}").to_pylist()]).astype(np.int64) for i in range(columns)))


def pair_counts(docs: DataFrame, words: Ranges, bits: int) -> DataFrame:
    """Compressed pieces (shard, keys, c0) of training pairs and counts, by range of the pair's hash."""
    shift, first = np.uint64(64 - bits), int(words.offset[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in slices(batches):
            in_train = np.repeat(part.train, part.size)
            if not in_train.any():
                continue
            numbers, _, _ = numbered(words, part.hashes)
            before, second = part.pairs(numbers, first)
            keys = (before[in_train].astype(np.uint64) << np.uint64(32)) | second[in_train].astype(np.uint64)
            keys.sort()
            fresh = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            held.append((keys[fresh] * MIX, np.diff(np.r_[fresh, len(keys)])))
            n += len(fresh)
            if n > HELD:
                keys, counts = summed(*map(np.concatenate, zip(*held)))
                yield blobs((keys >> shift).astype(np.int64), keys, counts)
                held, n = [], 0
        if held:
            keys, counts = summed(*map(np.concatenate, zip(*held)))
            yield blobs((keys >> shift).astype(np.int64), keys, counts)

    return typed(docs, run, "shard int, keys binary, c0 binary")


def count_pairs(docs: DataFrame, store: str, words: Ranges, bits: int) -> DataFrame:
    """Writes the pairs as Ranges "pair" with "times"; rows of sums by word, and of counts of counts."""
    schema = "shard int, keys binary, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, pair_shard int, n_pairs long, ones long, twos long, threes long, fours long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in stream_groups(batches, ["shard"]):
            keys, times = unblob(rows, 1)
            put(store, f"pair-{shard}", keys)
            put(store, f"times-{shard}", narrow(times))
            plain = keys * UNMIX
            h, w = (plain >> np.uint64(32)).astype(np.int64), (plain & np.uint64(0xFFFFFFFF)).astype(np.int64)
            none = np.zeros(len(h), np.int64)
            one = none + 1
            # context: count, followers seen once, twice, more; follower: contexts
            by_word = summed(np.concatenate([h, w]), *(np.concatenate(x) for x in ((times, none), ((times == 1) * 1, none), ((times == 2) * 1, none), ((times > 2) * 1, none), (none, one))))
            part = np.searchsorted(words.offset, by_word[0], side="right") - 1
            part[by_word[0] == words.offset[-1]] = 2**words.bits  # the start of a text
            batch = blobs(part, by_word[0].astype(np.uint64), *by_word[1:])
            extra = {"pair_shard": shard, "n_pairs": len(keys), **{k: int((times == i).sum()) for i, k in enumerate(("ones", "twos", "threes", "fours"), 1)}}
            rest = {k: pa.array([v] + [None] * (batch.num_rows - 1), pa.int64()) for k, v in extra.items()}
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | rest)

    pieces = pair_counts(docs, words, bits)
    return typed(pieces.repartition("shard").sortWithinPartitions("shard"), run, schema)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of things seen once, twice, three and four times."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def word_sums(by_word: DataFrame, store: str, words: Ranges) -> list:
    """Writes, beside each range of words, the context and follower sums; a row of totals per range."""
    schema = "shard int, total long, ones long, twos long, threes long, fours long, more long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in stream_groups(batches, ["shard"]):
            numbers, *sums = unblob(rows, 5)
            size = words.sizes.get(shard, 0) if shard < 2**words.bits else 1
            at = numbers.astype(np.int64) - int(words.offset[shard])
            for name, values in zip(("seen", "once", "twice", "often", "contexts"), sums):
                whole = np.zeros(size, np.int64)
                whole[at] = values
                put(store, f"{name}-{shard}", whole)
            c = sums[4][sums[4] > 0]
            yield pa.RecordBatch.from_pydict({"shard": [shard], "total": [int(c.sum())], **{k: [int((c == i).sum())] for i, k in enumerate(("ones", "twos", "threes", "fours"), 1)}, "more": [int((c > 2).sum())]})

    columns = ["shard", "keys", "c0", "c1", "c2", "c3", "c4"]
    return typed(by_word.select(*columns).repartition("shard").sortWithinPartitions("shard"), run, schema).collect()  # a row per range


class Model:
    """What workers need to score: the arrays' places, and a few numbers."""

    def __init__(self, words: Ranges, pairs: Ranges, n_tokens: int, high: tuple, low: tuple, distinct: int, low_rest: float) -> None:
        self.words, self.pairs, self.n_tokens, self.high, self.low = words, pairs, n_tokens, high, low
        self.distinct, self.low_rest, self.v = distinct, low_rest, int(words.offset[-1])

    def score(self, part: Slice) -> dict[str, list]:
        words, n = self.words, len(part.hashes)
        numbers, shard, place = numbered(words, part.hashes)
        order = np.argsort(shard, kind="stable")
        read = {}
        for name in ("count", "seen", "once", "twice", "often", "contexts"):
            read[name] = np.zeros(n + 1, np.int64)
            read[name][:n][order] = words.read(name, shard[order], place[order])
        if self.v:  # the start of a text is word n of this slice
            for name in ("seen", "once", "twice", "often"):
                read[name][n] = get(words.store, f"{name}-{2**words.bits}")[0]
        c = read["contexts"]
        taken = np.select([c == 0, c == 1, c == 2], [0.0, *self.low[:2]], self.low[2])
        low = np.maximum(c - taken, 0) / max(self.distinct, 1) + self.low_rest / (self.v + 1)
        seen = np.maximum(read["seen"], 1)
        back_off = np.where(read["seen"] > 0, (self.high[0] * read["once"] + self.high[1] * read["twice"] + self.high[2] * read["often"]) / seen, 1.0)
        before, second = part.pairs(np.arange(n), n)
        local = before * (n + 1) + second
        distinct, back = np.unique(local, return_inverse=True)
        h, w = distinct // (n + 1), distinct % (n + 1)
        number = np.r_[numbers, self.v].astype(np.uint64)
        keys = ((number[h] << np.uint64(32)) | number[w]) * MIX
        by_key = np.argsort(keys)
        pair_shard, pair_place = self.pairs.place(keys[by_key])
        times = np.empty(len(keys), np.int64)
        times[by_key] = self.pairs.read("times", pair_shard, pair_place)
        taken = np.select([times == 0, times == 1, times == 2], [0.0, *self.high[:2]], self.high[2])
        p = np.maximum(times - taken, 0) / seen[h] + back_off[h] * low[w]
        base = np.log10((read["count"][:n] + 1) / (self.n_tokens + self.v + 1))
        add = lambda x: np.add.reduceat(x, part.start)
        known = (read["count"][:n] > 0).astype(np.int64)
        return {
            "doc_id": part.ids, "held_out": ~part.train, "n_tokens": part.size, "n_known": add(known[part.tokens]),
            "train_tokens": np.full(len(part.ids), self.n_tokens), "base_score": add(base[part.tokens]), "score": add(np.log10(p)[back]),
        }


def fit(docs: DataFrame) -> Model:
    """Counts the training documents of docs(doc_id, text) into a model in the shared folder."""
    spark = docs.sparkSession
    store = new_store(spark, "ngrams")
    bits = max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    words, n_tokens = vocabulary(docs, store, max(4, bits - WORD_BITS_LESS))
    numbered_apart(int(words.offset[-1]))
    by_word = count_pairs(docs, store, words, bits).persist()
    try:
        found = by_word.filter("pair_shard is not null").select("pair_shard", "n_pairs", "ones", "twos", "threes", "fours").collect()  # a row per range
        sums = word_sums(by_word, store, words)
    finally:
        by_word.unpersist()
    pairs = Ranges(store, "pair", bits, {r["pair_shard"]: r["n_pairs"] for r in found})
    of = ("ones", "twos", "threes", "fours")
    high = discounts([sum(r[k] for r in found) for k in of])
    low = discounts([sum(r[k] for r in sums) for k in of])
    distinct = sum(r["total"] for r in sums)
    rest = sum(d * sum(r[k] for r in sums) for d, k in zip(low, ("ones", "twos", "more"))) / distinct if distinct else 1.0
    return Model(words, pairs, n_tokens, high, low, distinct, rest)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_pydict(model.score(part))

    scores = cut(typed(docs, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    remove(model.words.store)  # several times the scores' size
    return scores
