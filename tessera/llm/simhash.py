"""SimHash near-duplicates through a Gray-order hierarchical index.

Equal fingerprints are one code. Two codes that differ in at most 3 bits agree on one of four blocks of
bits, so a code goes to four groups, one for each block's pattern: these patterns are the index's
uppermost nodes. In a group that is still large the remaining bits are cut in four again, so its codes go to
four smaller groups; after a few levels so few bits are left that a group cannot be large. Within a group the
codes are sorted by Gray rank and runs of neighbours are joined into nodes, level by level. A node holds the
bits on which all its codes agree, less those that its parent holds. A search goes down from the
group's node, adds up the differing bits on its way and leaves a whole node as soon as they exceed 3.

Linked codes of a group are reduced to a spanning forest before they leave the task, and the components
of all links come from star steps over the table of links. Links name codes, so that texts without an id link
like others; a component is named by its smallest id at the end.

Texts of a given similarity of their shingles are wider apart: at 0.8 of five words, 4 to 14 bits. An index of that
radius would have 15 blocks of some 4 bits, which separate nothing. one_of_each() with a similarity therefore takes the
index's links, and links of equal codes, as candidates, checks them by their whole sets of shingles, and has shingle_dups find what lies beyond
the radius, so that no pair of that similarity is lost.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; ties and repeated
rows share a code; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aligned, cut, majority, map_rows, shingle_hashes, typed
from .components import components, merge_labels
from .shingle_dups import classes_of

SHINGLE = 3
MAX_BITS = 3
#: A group of more codes is cut into finer ones.
GROUP = 4096
FANOUT = 8
#: Query and node pairs that a search holds at once, about.
FRONTIER = 2_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row."""
    return map_rows(docs.select("doc_id", "text"), lambda rows: {"doc_id": rows["doc_id"], "fp": [fingerprint(x, shingle) for x in rows["text"]]}, "doc_id long, fp long")


def set_fingerprints(texts: DataFrame, shingle: int) -> DataFrame:
    """node, fp of texts(node, text), each shingle counted once, as in the similarity of sets."""
    one = lambda text: majority(hashes) if len(hashes := np.unique(shingle_hashes(text, shingle))) else 0
    return map_rows(texts, lambda rows: {"node": rows["node"], "fp": list(map(one, rows["text"]))}, "node long, fp long")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(fp: Column) -> Column:
    """Place of a code in the reflected Gray order, shifted so that signed order is right."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def signed(bits: int) -> int:
    return bits - 2**64 if bits >= 2**63 else bits


def quarters(mask: int) -> list[int]:
    """The masks that add to `mask` one of four runs of the bits that it leaves open."""
    open_ = [b for b in range(63, -1, -1) if not mask >> b & 1]
    n, parts = len(open_), MAX_BITS + 1
    return [mask | sum(1 << b for b in open_[n * i // parts : n * (i + 1) // parts]) for i in range(parts)]


def with_pattern(codes: DataFrame, masks: list[int]) -> DataFrame:
    """codes(fp, node) once for each mask, with the pattern of bits under it."""
    by = F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask")
    return codes.select("fp", "node", by).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


def grouped(codes: DataFrame, limit: int = GROUP) -> DataFrame:
    """fp, node, mask, pattern: groups of at least two codes, cut finer while they hold more than `limit`."""
    done = None
    rows = with_pattern(codes, quarters(0))
    while True:
        rows = cut(rows)
        sizes = rows.groupBy(F.col("mask").alias("g_mask"), F.col("pattern").alias("g_pattern")).agg(F.count("*").alias("n")).filter("n > 1")
        large = [r[0] for r in sizes.filter(F.col("n") > limit).select("g_mask").distinct().collect()]  # masks, of which a level has 4 ** level
        large = [m for m in large if 64 - (m % 2**64).bit_count() > 12]  # fewer open bits: no more than `limit` codes
        sized = rows.join(sizes, (F.col("mask") == F.col("g_mask")) & (F.col("pattern") == F.col("g_pattern")))
        split = F.col("mask").isin(large) & (F.col("n") > limit) if large else F.lit(False)
        ready = sized.filter(~split).select("fp", "node", "mask", "pattern")
        done = ready if done is None else done.union(ready)
        if not large:
            return done
        finer = F.create_map(*[x for m in large for x in (F.lit(m), F.array(*[F.lit(signed(q)) for q in quarters(m % 2**64)]))])
        rows = sized.filter(split).select("fp", "node", F.explode(finer[F.col("mask")]).alias("mask")).withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask")))


class GrayIndex:
    """Codes in groups, each group sorted by Gray rank, under nodes that hold shared bit patterns."""

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        self.codes = codes
        #: from the leaves up: bits under the mask, mask, first child, end of children, last code + 1
        ones, zeros, group_of, last = codes.copy(), ~codes, group, np.arange(1, len(codes) + 1)
        self.levels = [(ones, ~np.zeros_like(codes), None, last)]
        while len(group_of) and (group_of[1:] == group_of[:-1]).any():
            fresh = np.flatnonzero(np.r_[True, group_of[1:] != group_of[:-1]])
            place = np.arange(len(group_of)) - np.repeat(fresh, np.diff(np.r_[fresh, len(group_of)]))
            first = np.flatnonzero(place % FANOUT == 0)
            end = np.r_[first[1:], len(group_of)]
            ones, zeros = np.bitwise_and.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
            last, group_of = last[end - 1], group_of[first]
            self.levels.append((ones, ones | zeros, (first, end), last))
        self.root = np.searchsorted(group_of, group) if len(group_of) else np.zeros(0, np.int64)

    def links(self, queries: np.ndarray, most: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """All (query, later code of its group) that differ in at most `most` bits."""
        q, node = queries, self.root[queries]
        ones, held, children, _ = self.levels[-1]
        away = np.bitwise_count((self.codes[q] ^ ones[node]) & held[node])
        for level in range(len(self.levels) - 1, 0, -1):
            first, end = self.levels[level][2]
            parent_held = self.levels[level][1][node]
            ones, held, _, last = self.levels[level - 1]
            n = end[node] - first[node]
            at = np.repeat(np.arange(len(q)), n)
            child = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[node][at]
            later = last[child] > q[at] + 1
            at, child = at[later], child[later]
            away_child = away[at] + np.bitwise_count((self.codes[q[at]] ^ ones[child]) & held[child] & ~parent_held[at])
            near = away_child <= most
            q, node, away = q[at[near]], child[near], away_child[near]
        apart = node > q
        return q[apart], node[apart]


def spanning_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches sorted by mask, pattern and Gray rank: links a, b that connect what is linked within a group."""
    for part in aligned(batches, ["mask", "pattern"]):
        codes = part.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        nodes = part.column("node").to_numpy()
        mask, pattern = part.column("mask").to_numpy(), part.column("pattern").to_numpy()
        group = np.cumsum(np.r_[False, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])])
        index, label = GrayIndex(codes, group), np.arange(len(codes))
        work = np.cumsum(np.bincount(group)[group])
        for lo in range(0, int(work[-1]) + 1, FRONTIER):
            a, b = np.searchsorted(work, [lo, lo + FRONTIER], side="left")
            if b > a:
                label = merge_labels(label, *index.links(np.arange(a, b)))
        joined = np.flatnonzero(label != np.arange(len(label)))
        if len(joined):
            yield pa.RecordBatch.from_pydict({"a": nodes[joined], "b": nodes[label[joined]]})


def near_links(codes: DataFrame, limit: int = GROUP) -> DataFrame:
    """a, b: links between nodes of codes(fp, node), enough to connect all codes that differ in 3 bits or fewer."""
    rows = grouped(codes, limit).withColumn("rank", gray_rank(F.col("fp")))
    sorted_ = rows.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern", "rank")
    return typed(sorted_, spanning_links, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = GROUP) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs(doc_id, text)."""
    marked = cut(fingerprints(docs, shingle))
    codes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    classes = components(near_links(codes.select("fp", F.col("fp").alias("node")), limit))
    classed = codes.join(classes, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("c_fp"), "least", F.coalesce("component", "fp").alias("class"))
    code_class = classed.drop("least").join(classed.groupBy("class").agg(F.min("least").alias("component_id")), "class")
    joined = marked.join(code_class, F.col("fp") == F.col("c_fp"))
    return joined.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def near_pairs(marked: DataFrame) -> DataFrame:
    """a, b: pairs of nodes of marked(node, fp), enough to connect all whose fingerprints are equal or differ in 3 bits or fewer."""
    codes = cut(marked.groupBy("fp").agg(F.min("node").alias("code")))
    equal = marked.join(codes, "fp").filter("node <> code").select(F.col("code").alias("a"), F.col("node").alias("b"))
    near = near_links(codes.withColumnRenamed("code", "node")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(near)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs without the near-duplicates: of each class one row of its smallest id stays. Rows without an id stay, since none can name them.

    Classes are those of near_duplicates(); with `similarity`, of texts whose sets of shingles have that Jaccard similarity. Then equal texts are
    one node, named by a 64-bit hash; case and blanks do not matter; a text of fewer words than a shingle is one shingle; null, empty and blank texts are equal.
    """
    if similarity is None:
        first = near_duplicates(docs.select("doc_id", "text"), shingle).filter("doc_id = component_id").select("doc_id").distinct()
    else:
        texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
        of = texts.select("node", "text")
        nodes = texts.groupBy("node").agg(F.min("doc_id").alias("least"))
        marked = cut(set_fingerprints(of, shingle).distinct())
        classed = nodes.join(classes_of(of, marked, near_pairs(marked), shingle, similarity), "node", "left")
        first = classed.groupBy(F.coalesce("component", "node").alias("class")).agg(F.min("least").alias("doc_id")).select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
