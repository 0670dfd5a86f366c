"""The pipeline: each stage against a brute-force version on its own input, and runs over odd and empty tables."""

import collections
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import mixing, queries, shingle_dups
from tessera.llm.common import cut, release
from tessera.llm.components import components as component_frame
from tests.llm.conftest import COLUMNS, components, sentence
from tests.llm.test_operators import plain_counts


def rows(frame):
    return [r.asDict() for r in frame.collect()]


def as_text(found):
    return sorted(str(sorted(r.items(), key=str)) for r in found)


@pytest.fixture(scope="module")
def stages(spark, given):
    """Input of each stage, and the last one's output."""
    frames = [given]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(cut(stage(spark, frames[-1], "/root/testdata/sf0.001")))
    return frames


def test_columns_and_registration(stages, given):
    assert all(f.columns == given.columns for f in stages[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "packing"]
    assert [sum(n.startswith(f"op{i}_") for n in queries.QUERIES) for i in range(1, 11)] == [1] * 10


def test_quality_stage(stages):
    before, after = rows(stages[0]), rows(stages[1])
    verdict = {r["doc_id"]: r["kept"] for r in queries.quality.judge(stages[0]).collect()}
    assert as_text(after) == as_text([r for r in before if verdict[r["doc_id"]]])
    counts = {r["doc_id"]: plain_counts(r["text"]) for r in before}
    assert all(counts[r["doc_id"]][0] >= 50 and 2 * counts[r["doc_id"]][4] <= counts[r["doc_id"]][0] for r in after)


def five_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def without_near_copies(before):
    """Rows in order of their ids without those of an earlier one's class, by all pairs."""
    sets = [five_words(r["text"]) for r in before]
    group = components(len(before), [(i, j) for i in range(len(before)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    return [r for i, r in enumerate(before) if r["doc_id"] is None or group[i] == i]


def test_near_duplicate_stage(stages):
    before = sorted(rows(stages[1]), key=lambda r: r["doc_id"])
    assert as_text(rows(stages[2])) == as_text(without_near_copies(before))


@pytest.mark.parametrize("which", ["odd", "given", "none", "copies", "crowd"])
def test_near_duplicates_by_five_words(request, spark, which):
    """All pairs of similarity 0.8 or more by brute force; the copies are a text with one to eight words replaced, one copy without an id; the crowd's have one to four words replaced anywhere."""
    if which == "crowd":
        base, draw = sentence(12, 90).split(), np.random.default_rng(3)
        crowd = [{int(at): f"w{i}" for at in draw.integers(0, 90, i % 4 + 1)} for i in range(150)]
        frame = spark.createDataFrame([(i, " ".join(x.get(at, w) for at, w in enumerate(base)), "en", "s", 1) for i, x in enumerate(crowd)], COLUMNS)
    elif which == "copies":
        base = sentence(11, 200).split()
        copies = [(100 - c if c != 2 else None, " ".join(base[: 20 * c] + [f"w{c}"] * c + base[21 * c :]), "en", "s", 1) for c in range(9)]
        frame = spark.createDataFrame(copies, COLUMNS)
    else:
        frame = request.getfixturevalue(which)
    before = sorted(rows(frame), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert as_text(rows(corpus_pipeline.drop_near_duplicates(spark, frame, ""))) == as_text(without_near_copies(before))


def test_repeats_stage(stages):
    before = sorted(rows(stages[2]), key=lambda r: r["doc_id"])
    first, want = {}, []
    for r in before:
        raw = r["text"].encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], r["doc_id"])
    for r in before:
        raw = r["text"].encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < r["doc_id"]:
                gone[k : k + 50] = True
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        if left.strip() or not gone.any():
            text = left.decode("utf-8", "ignore")
            want.append(r | {"text": text, "n_chars": len(text) if gone.any() else r["n_chars"]})
    assert as_text(rows(stages[3])) == as_text(want)


def test_mixing_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    size = lambda r: len(r["text"].encode().split())
    sizes, taken, times = collections.Counter(), collections.Counter(), collections.Counter()
    text = {r["doc_id"]: r["text"] for r in before}
    for r in before:
        sizes[r["source"]] += size(r)
    for r in after:
        taken[r["source"]] += size(r)
        times[r["doc_id"]] += 1
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    goal = mixing.targets(list(sizes.items()))
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes) and max(times.values()) <= 3


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows(stages[4]))
    found = rows(stages[5])
    assert sum(r["length"] for r in found) == want and max(r["offset"] + r["length"] for r in found) <= 2048


def test_run(spark, stages, odd, none, tmp_path):
    pieces = rows(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))
    total = lambda found: sorted((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0)
    assert total(pieces) == total(rows(stages[5]))
    for name, frame in (("odd", odd), ("none", none)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert (corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").count() > 0) == (name == "odd")


def test_pairs_across_classes(rng=np.random.default_rng(5)):
    """All pairs of different classes in each group, by brute force; with a limit, each row outside the largest class has its nearest."""
    for rows, classes in ((60, 4), (200, 40), (5, 1)):
        gram = np.sort(rng.integers(0, 6, rows))
        part = {"gram": gram, "n": rng.integers(20, 30, rows), "place": rng.integers(0, 3, rows), "class": rng.integers(0, classes, rows)}
        part["fp"] = rng.integers(0, 2**22, rows).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        sizes = np.diff(np.r_[first, rows])
        a, b = np.triu_indices(rows, 1)
        ok = (gram[a] == gram[b]) & (part["class"][a] != part["class"][b]) & shingle_dups.may_be_similar(part, a, b, 0.8, shingle_dups.WIDE)
        expected = set(zip(a[ok].tolist(), b[ok].tolist()))

        def pairs(nearest):
            found = [x for a, b in shingle_dups.across(part, first, sizes, 0.8, nearest) for x in zip(a.tolist(), b.tolist())]
            return found, {(min(x), max(x)) for x in found}

        found, whole = pairs(None)
        assert whole == expected and len(found) == len(whole)
        found, some = pairs(2)
        assert some <= expected and max(collections.Counter(x for x, _ in found).values(), default=0) <= 2
        group = np.repeat(np.arange(len(first)), sizes)
        away = lambda x, y: int(part["fp"][x] ^ part["fp"][y]).bit_count()
        for q in shingle_dups.outside_largest(part["class"], group).tolist():
            partners = [y if x == q else x for x, y in expected if q in (x, y)]
            assert sorted(away(q, x) for y, x in found if y == q) == sorted(away(q, x) for x in partners)[:2]


def test_steps_of_components_leave_one_checkpoint(spark):
    release(cut(spark.range(1)))
    at = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(at.iterdir())
    chain = spark.range(64).selectExpr("id as a", "id + 1 as b")
    found = component_frame(chain)
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(1, 65)}
    assert len(set(at.iterdir()) - before) == 1
    release(found)
    assert set(at.iterdir()) == before
    kept = cut(spark.range(3))
    release(spark.range(5))
    assert kept.count() == 3
