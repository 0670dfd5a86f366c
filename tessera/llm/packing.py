"""Packing documents into fixed windows by the sum-of-squares rule.

A document's identifiers are cut into full windows and a rest. The rest goes into an open window, or a
new one, such that the sum of squares of the numbers of open windows at each fill level becomes
smallest; an array holds these numbers. No other cut is made.

1. Each partition packs its own documents as they come, so no identifiers are shuffled. An open window holds only what
   the result says of its pieces, so their number needs no limit. The windows that become full are done.
2. What a partition leaves open, its pieces one by one, goes to a second round with that of other partitions: as many
   packers as pieces ask for, some GROUP pieces each. They take the pieces in falling order of size, by the same rule, which
   leaves few windows open; those are closed as they are, padded. On the documents of scale 0.1 that is 0.3 to 0.5 per cent
   of all windows, in one partition as in 200.

Windows are named by the partition or packer, so names agree in a rerun.

Defined results: null text counts as empty and gives the end id alone; repeated rows are packed as separate
documents; an empty table gives no rows; whole texts of any length are used; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, typed

WINDOW = 2048
END = 1
#: Pieces that a packer of the second round takes, about.
GROUP = 8000
#: Windows that a packer can name, as a power of two; the second round's names lie above all others.
NAMES, SECOND = 36, 1 << 62
#: Words remembered in a generation, of which there are two; some 150 bytes each.
MEMO = 800_000
#: Marks that the pattern always parts from letters before them, and that join no character.
STOPS = ".,;:!?"
#: A stop between a letter and a blank; these letters neither compose with nor lower to anything that a stop joins.
PAUSE = "([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,]) "
#: Texts in which lowering A-Z beforehand could name a special string, or change what composes.
AS_IT_IS = "<\\||[\u0300-\u036f]"
LETTERED = re.compile(rf"^(([^\W\d_]+)([{STOPS}]*))$", re.M)
#: Documents whose words are looked up together.
SLICE = 1000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Encoders of this worker process, by digest of their file; they keep their memo from task to task.
ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def plain_letters(word: str) -> bool:
    """Whether a word is of letters that neither composing nor lowering turns into anything but letters."""
    return word.isalpha() and is_normalized("NFC", word) and word.lower().isalpha()


class WordEncoder:
    """Identifiers of texts under a vocabulary that never joins characters across white space, so words can be remembered."""

    def __init__(self, spec: str, most: int = MEMO) -> None:
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_str(spec), Memo({"": b""})
        suffix = json.loads(spec)["model"].get("end_of_word_suffix") or ""
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)  # identifiers that end a word; without such a suffix none
        self.ends[[i for name, i in names.items() if suffix and name.endswith(suffix)]] = True

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit identifiers of each text; null is the empty text.

        The distinct words of all texts are looked up once, and their identifiers dealt out by word.
        """
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        column = pc.if_else(pc.match_substring_regex(column, AS_IT_IS), column, pc.ascii_lower(column))
        column = pc.replace_substring_regex(pc.replace_substring(column, "\n", " "), PAUSE, r"\1 \2 ")
        split = pc.split_pattern(column, " ")
        numbered = split.flatten().dictionary_encode()
        words, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        if len(self.memo) + len(words) > self.most:
            self.memo = Memo(self.memo)
        self.learn(self.unknown(set(words)))
        found = list(map(self.memo.__getitem__, words))
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, count = (np.cumsum(size) - size)[number], size[number]
        end = np.cumsum(count)
        dealt = ids[np.repeat(first - (end - count), count) + np.arange(len(count) and end[-1])]
        bounds = np.r_[0, end][split.offsets.to_numpy()].tolist()
        return [dealt[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def unknown(self, words: set[str]) -> set[str]:
        memo, older = self.memo, self.memo.older
        return {w for w in words if w not in memo and w not in older}

    def learn(self, new: set[str]) -> None:
        """Adds words to the memo. Letters with stops behind them are encoded apart, as the vocabulary's pattern splits them."""
        memo = self.memo
        lettered = LETTERED.findall("\n".join(new))
        made = [(word, stem.lower(), tail) for word, stem, tail in lettered if stem.isascii()]
        if len(made) < len(lettered):
            made += [x for x in lettered if not x[1].isascii() and plain_letters(x[1])]
        letters = list(self.unknown({stem for _, stem, _ in made}))
        other = list(self.unknown(new.difference(word for word, _, _ in made).union(tail for _, _, tail in made)))
        for at in range(0, len(letters), 4000):
            part = letters[at : at + 4000]
            [found] = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            end = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(end) == len(part):
                raw = ids.tobytes()
                memo.update((w, raw[a:b]) for w, a, b in zip(part, [0, *end], end))
            else:  # the library's letters differ from Python's in one of these
                other += part
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                memo[word] = np.array(found.ids, "<u4").tobytes()
        memo.update((word, memo[stem] + memo[tail]) for word, stem, tail in made)


def encoder(spec: str, most: int) -> WordEncoder:
    name = hashlib.sha256(spec.encode()).hexdigest(), most
    if name not in ENCODERS:
        ENCODERS[name] = WordEncoder(spec, most)
    return ENCODERS[name]


class Packer:
    """Sum-of-squares packing of pieces (doc_id, start, length, ids_crc32, doc_tokens); full windows come out as rows."""

    def __init__(self, first_id: int, window: int = WINDOW) -> None:
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, np.int64)  # open windows at each fill level
        self.open: list[list[list[tuple]]] = [[] for _ in range(window)]
        self.rows: list[tuple] = []

    def level_for(self, size: int) -> int:
        """The fill level at which a piece of this size adds least to the sum of squares; 0: a new window."""
        top = self.window - size
        here, there = self.count[1 : top + 1], self.count[size + 1 :]
        change = 2 * (there - here) + 2
        change[-1:] = 1 - 2 * here[-1:]  # the window becomes full and leaves the array
        change[here == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(change[::-1].argmin()) if len(change) else -1
        return best + 1 if best >= 0 and change[best] <= 2 * self.count[size] + 1 else 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """A document's identifiers: full windows, and a rest to be placed."""
        total, step = len(ids) // 4, self.window
        for start in range(0, total, step):
            part = ids[4 * start : 4 * (start + step)]
            self.place((doc_id, start, len(part) // 4, crc32(part), total))

    def place(self, piece: tuple) -> None:
        size = piece[2]
        if size == self.window:
            self.close([piece])
            return
        level = self.level_for(size)
        held: list[tuple] = []
        if level:
            held = self.open[level].pop()
            self.count[level] -= 1
        held.append(piece)
        if level + size == self.window:
            self.close(held)
        else:
            self.open[level + size].append(held)
            self.count[level + size] += 1

    def close(self, held: list[tuple]) -> None:
        offset = 0
        for piece in held:
            self.rows.append((*piece, self.next_id, offset))
            offset += piece[2]
        self.next_id += 1

    def leave(self) -> None:
        """Gives out the pieces of open windows, without a place."""
        self.rows += [(*piece, None, None) for level in self.open for held in level for piece in held]

    def close_open(self) -> None:
        """Closes the open windows as they are."""
        for level in self.open:
            for held in level:
                self.close(held)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(names)})


def second_round(left: DataFrame, window: int, group: int) -> DataFrame:
    """The pieces that the partitions left open, packed again in falling order of size; closed at last as they are."""
    packers = max(1, -(-left.count() // group))
    dealt = left.withColumn("packer", F.pmod(F.xxhash64("part", "place"), F.lit(packers)).cast("int"))
    order = ["packer", F.desc("length"), "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, at = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for own, *piece in zip(batch.column("packer").to_pylist(), *columns):
                if own != at:
                    if packer:
                        packer.close_open()
                        yield packer.taken()
                    packer, at = Packer(SECOND + (own << NAMES), window), own
                packer.place(tuple(piece))
            yield packer.taken()
        if packer:
            packer.close_open()
            yield packer.taken()

    sorted_ = dealt.repartition(packers, "packer").sortWithinPartitions(*order)
    return typed(sorted_.select(*[x.split()[0] for x in SCHEMA.split(", ")][:5], "packer"), run, SCHEMA)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, memo: int = MEMO, group: int = GROUP) -> DataFrame:
    """The pieces of all documents with their place; `vocabulary`: path of a tokenizer file; `memo`: words that a worker remembers in a generation.

    The file has a fixed size (about 2 MB); the driver reads and broadcasts it.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, packer, place = encoder(spec.value, memo), Packer(part << NAMES, window), 0

        def numbered() -> pa.RecordBatch:
            nonlocal place
            out = packer.taken()
            place += out.num_rows
            places = pa.array(range(place - out.num_rows, place), pa.int64())
            return out.append_column("part", pa.array([part] * out.num_rows, pa.int32())).append_column("place", places)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                for doc_id, ids in zip(rows.column(0).to_pylist(), words.encode(rows.column(1))):
                    packer.add(doc_id, ids + last)
                yield numbered()
        packer.leave()
        yield numbered()

    placed = cut(typed(docs.select("doc_id", "text"), run, f"{SCHEMA}, part int, place long"))
    done = placed.filter("sequence_id is not null").drop("part", "place")
    return done.unionByName(second_round(placed.filter("sequence_id is null"), window, group))
