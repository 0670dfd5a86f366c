"""Quality rules with adaptive thresholds.

Every document gets a few measures, each a count k beside a size n. They are compared on a logarithmic scale:
ln((k + 1/2) / (n + 1/2)) for a rate, ln((k + 1/2) / (n - k + 1/2)) for a share, where a count of nothing says the less
the shorter the document is. Words repeat as passages of some ten words, so half a count of those is 5. The measures of the documents that pass the base rules are summarised per (language,
source) in a quantile sketch: counts of buckets of fixed width on that scale. Adding two sketches is adding
their counts, so partial sketches merge in any order to the same result, and a rerun agrees.

No threshold is a fixed cutoff. A group's sketch is blended with its language's, which counts for PRIOR documents, and
a language's with the whole table's likewise, so that a group of few documents leans on its language and one of many
stands for itself, without a switch at some size. From the blended sketch come the median and, on the upper side, the
distances to two upper quantiles, each divided by its distance in a normal distribution; the larger is the spread. Bad documents may be up to 15
per cent of a group without moving these quantiles. A group that is mostly copies of one document has no spread of its own, so half
the spread is the least that documents of its language have about their own groups' medians (a sketch as well, of distances). The fence is

    median + FENCE * max(spread, half the spread within the language's groups)

and a document is rejected if a measure lies above it (for word length, also if it lies below the fence of the
lower side, from the lower quantiles). The fences are joined back to the documents' measures.

Defined results: null text counts as empty; null language or source is a group of its own; ties have
equal measures and so equal verdicts; repeated rows are judged row by row; an empty table gives no rows;
columns other than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, map_rows, typed, utf8

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Spreads from the median; a normal distribution has three in a million beyond.
FENCE = 4.5
#: Documents that a language's sketch counts for in a group's, and the whole table's in a language's.
PRIOR = 50
#: Quantiles on either side of the median and their distances from it in a normal distribution.
TAILS = {0.75: 0.6745, 0.85: 1.0364}
#: Half a count, and half a repeated passage, in words.
HALF, HALF_PASSAGE = 0.5, 5.0
#: Width of a bucket; a measure is known to one per cent.
STEP = 0.01
#: Running sums of weights are equal within this share of the total.
EQUAL = 1e-9
#: Up to so many (language, source) groups the fences are broadcast, some 500 bytes each.
BROADCAST_GROUPS = 10_000
#: Up to so many languages their sketches are broadcast, some 50 KB each.
BROADCAST_LANGUAGES = 200

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"


def repeated_words(words: list[bytes]) -> int:
    """Words within 3-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v < 2_000_000:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        pairs = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        key = pairs[:-1] * v + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks of a whole text."""
    text = text or ""
    raw = utf8(text)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r"),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count("!") + text.count("?"),
    )


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def each(rows: dict[str, list]) -> dict[str, list]:
        counts = list(zip(*map(measure, rows["text"]))) or [[]] * len(names)
        return {"doc_id": rows["doc_id"], "lang": rows["lang"], "source": rows["source"], **dict(zip(names, map(list, counts)))}

    return map_rows(docs.select("doc_id", "lang", "source", "text"), each, f"doc_id long, lang string, source string, {COUNTS}")


def with_counts(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), lang, source and the counts."""
    names = [x.split()[0] for x in COUNTS.split(", ")]
    nested = docs.select(F.struct("*").alias("row"), "lang", "source")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field(at).to_pylist()
            found = list(zip(*map(measure, texts))) or [[]] * len(names)
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("row", "lang", "source")} | {k: pa.array(x, pa.int64()) for k, x in zip(names, found)})

    return typed(nested, run, StructType([*nested.schema, *StructType.fromDDL(COUNTS)]))


def measures() -> dict[str, Column]:
    """The measures on their logarithmic scale."""
    rate = lambda k, n: F.log((F.col(k) + HALF) / (F.col(n) + HALF))
    share = lambda k, n, half=HALF: F.log((F.col(k) + half) / (F.col(n) - F.col(k) + half))
    return {
        "symbols_per_word": rate("n_symbols", "n_words"),
        "chars_per_word": rate("word_chars", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words", HALF_PASSAGE),
        "upper_share": share("n_upper", "word_chars"),
        "marks_per_word": rate("n_marks", "n_words"),
    }


def sketches(features: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the mergeable sketch of each group's documents that pass the base rules; one row per bucket in use."""
    named = F.array(*[F.struct(F.lit(k).alias("measure"), F.floor(v / STEP).cast("int").alias("bucket")) for k, v in measures().items()])
    return features.filter(~base_failed()).select("lang", "source", F.explode(named).alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of larger groups; each as an array h of (bucket, weight) in order, with its total."""
    summed = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").cast("double").alias("w"))
    return summed.groupBy(*by, "measure").agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("h"), F.sum("w").alias("total"))


def blended(own: Column, wide: Column, wide_total: Column) -> Column:
    """A sketch with a wider one added, which counts for PRIOR documents."""
    return F.sort_array(F.concat(own, F.transform(wide, lambda x: F.struct(x["bucket"].alias("bucket"), (PRIOR * x["w"] / wide_total).alias("w")))))


def quantiles(h: Column, total: Column) -> Column:
    """The buckets at which a sketch reaches each quantile, as an array: the median, then each of TAILS below and above."""
    points = [0.5, *(x for q in TAILS for x in (1 - q, q))]

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["w"]
        at = [F.coalesce(acc["at"][i], F.when(seen >= (q - EQUAL) * total, x["bucket"])) for i, q in enumerate(points)]
        return F.struct(seen.alias("seen"), F.array(*at).alias("at"))

    start = F.struct(F.lit(0.0).alias("seen"), F.array(*[F.lit(None).cast("int")] * len(points)).alias("at"))
    return F.aggregate(h, start, step, lambda acc: acc["at"])


def spread(at: Column, side: int, middle: Column) -> Column:
    """The larger of the tails' distances from the middle on one side (-1 or 1), each as a share of a normal distribution's."""
    return F.greatest(*[side * (at[1 + 2 * i + (side > 0)] - middle) / away for i, away in enumerate(TAILS.values())])


def with_language(groups: DataFrame, of: DataFrame) -> DataFrame:
    """groups beside the row of their language and measure in `of`, whose columns get the prefix l_."""
    of = of.select(*[F.col(c).alias(f"l_{c}") for c in of.columns])
    few = of.count() <= BROADCAST_LANGUAGES * len(measures())
    same = F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure"))
    return groups.join(F.broadcast(of) if few else of, same)


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, fence: a map of measure to (low, high) for each group."""
    all_ = merged(sketch, []).select("measure", F.col("h").alias("a_h"), F.col("total").alias("a_total"))  # six rows
    by_lang = merged(sketch, ["lang"]).join(F.broadcast(all_), "measure")
    by_lang = cut(by_lang.select("lang", "measure", blended(F.col("h"), F.col("a_h"), F.col("a_total")).alias("h"), (F.col("total") + PRIOR).alias("total")))
    groups = with_language(merged(sketch, ["lang", "source"]), by_lang)
    groups = cut(groups.select("lang", "source", "measure", "h", quantiles(blended(F.col("h"), F.col("l_h"), F.col("l_total")), F.col("total") + PRIOR).alias("at")))
    apart = groups.select("lang", "measure", "at", F.explode("h").alias("x")).select("lang", "measure", (F.col("x.bucket") - F.col("at")[0]).alias("bucket"), F.col("x.w").alias("n"))
    typical = cut(merged(apart, ["lang"]).select("lang", "measure", quantiles(F.col("h"), F.col("total")).alias("at")))
    joined = with_language(groups, typical)
    width = {side: FENCE * F.greatest(spread(F.col("at"), side, F.col("at")[0]), spread(F.col("l_at"), side, F.lit(0)) / 2) for side in (-1, 1)}
    low, high = STEP * (F.col("at")[0] - width[-1]), STEP * (F.col("at")[0] + width[1] + 1)  # the outer ends of the buckets
    return joined.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct(low.alias("low"), high.alias("high"))))).alias("fence"))


def thresholds(features: DataFrame) -> DataFrame:
    """lang, source, fence of each group."""
    return cut(fences(cut(sketches(features))))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdicts(features: DataFrame, limits: DataFrame) -> DataFrame:
    """features with base_failed, outlier (measures beyond their fence) and kept."""
    few = limits.count() <= BROADCAST_GROUPS  # a short row per language and source
    limits = limits.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), "fence")
    same = F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))
    with_limits = features.join(F.broadcast(limits) if few else limits, same, "left")
    beyond = [F.when(v > F.col("fence")[k]["high"], F.lit(k)) for k, v in measures().items()]
    beyond.append(F.when(measures()["chars_per_word"] < F.col("fence")["chars_per_word"]["low"], F.lit("short_words")))
    out = with_limits.select(*features.columns, base_failed().alias("base_failed"), F.array_compact(F.array(*beyond)).alias("outlier"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("outlier") == 0))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, outlier, kept of every row."""
    features = cut(document_features(docs))
    return verdicts(features, thresholds(features))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, as they are."""
    limits = thresholds(document_features(docs))
    return verdicts(with_counts(docs), limits).filter("kept").select("row.*")
