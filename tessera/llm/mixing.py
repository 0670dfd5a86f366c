"""Mixing sources to target weights by exact word budgets.

Each document gets a hash-random key, a fixed function of its id. Within a source the documents are
ordered by that key; the range of keys is cut into blocks, as many as the source needs to keep a block
small, so that a source with most of the rows is spread as well. Sums per block and their prefix sums
say where a block begins in its source's order. A source whose budget is e times its size and a rest
takes every document e times, and the rest from the front of the order: blocks that end before the
rest are taken whole, blocks that begin after it not at all, and only in the one block that holds the
cut are documents sorted and summed up one by one. The document at the cut gives just the words
that are missing, so each source ends exactly at its rounded target.

Targets: sources by code point, null last, weigh 1, 2, 3 and again; together they get all words. A target
stops at EPOCHS times its source's size; what is over goes to the others by weight until none is above.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its own; ties in
the key are ordered by id and size; repeated rows count and are taken as separate documents; an empty
table gives no rows; other columns are not read. The driver holds one (source, size) pair per source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, local_rows, word_count

WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Documents in a block, about.
BLOCK = 2_000
#: Up to so many short rows a table of sources or of blocks is broadcast.
BROADCAST_SOURCES = 10_000
SEED = "mix-1"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> dict[str | None, Fraction]:
    """The words that each source is to give; exact."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    limit = {s: Fraction(epochs * n) for s, n in ordered}
    rest, open_, out = Fraction(sum(n for _, n in ordered)), [s for s, _ in ordered], {}
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > limit[s]]
        if not full:
            return out | {s: share * weight[s] for s in open_}
        out |= {s: limit[s] for s in full}
        rest -= sum(limit[s] for s in full)
        open_ = [s for s in open_ if s not in set(full)]
    return out


def key() -> Column:
    """A number in [0, 2^63) that is a fixed random function of the id."""
    return F.xxhash64(F.lit(SEED), F.col("doc_id")).bitwiseAND(F.lit(2**63 - 1))


def first_words(text: Column, n: Column) -> Column:
    """The beginning of a text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each but the first begins with blanks
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK, rows: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: words that the mix takes of each document; rows: also `row`, all its columns."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    narrow = cut(sized.drop("row"))
    sums = narrow.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # one row per source
    goal = targets([(r["source"], r["size"]) for r in sums], weights, epochs)
    plan = []
    for r in sums:
        words = int(goal[r["source"]] + Fraction(1, 2))
        whole, rest = divmod(words, r["size"]) if r["size"] else (0, 0)
        plan.append((r["source"], r["size"], float(goal[r["source"]]), whole, rest, max(1, -(-r["n"] // block))))
    schema = "p_source string, source_size long, target double, whole long, rest long, blocks long"
    few = len(plan) <= BROADCAST_SOURCES
    plan_df = F.broadcast(local_rows(docs.sparkSession, plan, schema)) if few else docs.sparkSession.createDataFrame(plan, schema)
    same = F.col("source").eqNullSafe(F.col("p_source"))

    def keyed(frame: DataFrame) -> DataFrame:
        with_key = frame.join(plan_df, same).withColumn("key", key())
        return with_key.withColumn("block", F.floor(F.col("key") / F.lit(2.0**63) * F.col("blocks")))

    in_order = Window.partitionBy("p_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edge = keyed(narrow).groupBy("p_source", "block").agg(F.sum("size").alias("b_size"))
    edge = cut(edge.select("p_source", F.col("block").alias("b_block"), "b_size", F.coalesce(F.sum("b_size").over(in_order), F.lit(0)).alias("begins")))
    edge = F.broadcast(edge) if sum(p[-1] for p in plan) <= BROADCAST_SOURCES else edge  # a row per block
    placed = keyed(sized if rows else narrow).drop("p_source").join(edge, same & (F.col("block") == F.col("b_block")))
    out = ["doc_id", "source", "size", "source_size", "target", *(["row"] if rows else [])]
    left = F.col("rest") - F.col("begins")
    at_cut = (left > 0) & (left < F.col("b_size"))
    plain = placed.filter(~at_cut).select(*out, (F.col("whole") * F.col("size") + F.when(left > 0, F.col("size")).otherwise(F.lit(0))).alias("taken"))
    by_key = Window.partitionBy("p_source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(by_key), F.lit(0))
    partly = F.greatest(F.lit(0), F.least(F.col("size"), left - before))
    cut_block = placed.filter(at_cut).select(*out, (F.col("whole") * F.col("size") + partly).cast("long").alias("taken"))
    return plain.unionByName(cut_block)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken, the last one cut after the words that are taken; n_chars, if there, follows."""
    taken = mix(docs, weights, epochs, rows=True).filter("taken > 0")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("long") - 1), lambda i: F.least(F.col("size"), F.col("taken") - i * F.col("size")))
    each = taken.select("row", "size", F.explode(parts).alias("part"))
    text = F.when(F.col("part") < F.col("size"), first_words(F.col("row.text"), F.col("part"))).otherwise(F.col("row.text"))
    each = each.select("row", "size", "part", text.alias("cut_text"))
    own = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("cut_text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("part") < F.col("size"), F.length("cut_text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return each.select(*[own[c].alias(c) for c in docs.columns])
