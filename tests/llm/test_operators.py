"""Each operator against a brute-force version, on given documents and on odd ones."""

import collections
import hashlib
import math
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import html_text, kneser_ney, mixing, packing, quality, simhash, store, suffix_repeats, token_counts, url_rules, vector_dups
from tessera.llm.components import components as connected
from tests.llm.conftest import components, odd_documents

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def by_id(frame, key="doc_id"):
    return sorted((r.asDict() for r in frame.collect()), key=lambda r: (r[key] is None, r[key] or 0))


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


# 1


def url_answer(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return (host, path, best and best[0] + best[1], best[2] if best else "allow")


@pytest.mark.parametrize("rules", [url_rules.RULES, [], [("com", "/", "block"), ("a.com", "/", "allow"), ("b.a.com", "/x", "block"), ("b.a.com", "/x", "allow"), ("com", "/x/y", "allow"), ("aa.com", "/", "block"), ("a-b.com", "/", "block")]])
def test_url_filters(spark, rules):
    urls = ["http://a.com/x", "https://B.A.com/x/y?q#f", "http://c.b.a.com/x/yz", "http://a.com", "http://a.com?x", "a.com/x", None, "", "http://aa.com/", "http://a-b.com/", "http://x.example.net/en/1", "http://EXAMPLE.net/fr", "http://m.example.com/de/2#z", "http://q.org/fr/", "http://org/fr/3", "http://net/", "http://x..net/", "http://é.net/", "://net/", "http://a.com:80/x", "x://y://net/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string, stack string")
    got = url_rules.filter_urls(pages, url_rules.rules_frame(spark, rules)) if rules else url_rules.filter_urls(pages, spark.createDataFrame([], "r_host string, r_path string, r_verdict string"))
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in by_id(got, "page_id")] == [url_answer(u, rules) for u in urls + urls[:5]]
    assert url_rules.filter_urls(pages.limit(0), url_rules.rules_frame(spark, url_rules.RULES)).count() == 0


def test_url_filters_use_no_python(spark, sf_dir):
    plan = url_rules.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_rules.rules_frame(spark, url_rules.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# 2


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("which", ["odd", "given"])
def test_simhash(request, which):
    frame = request.getfixturevalue(which)
    rows = texts(frame)
    codes = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3]
    group = components(len(rows), links)
    least = {}
    for g, (i, _) in zip(group, rows):
        least[g] = min(x for x in (least.get(g), i) if x is not None) if (least.get(g), i) != (None, None) else None
    want = collections.Counter((i, f"{c:016x}", least[g]) for (i, _), c, g in zip(rows, codes, group))
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()) == want


def test_simhash_empty_and_one_of_each(none, odd):
    assert simhash.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.one_of_each(odd).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14] and kept.count(None) == 2  # 5 and 6 are empty as 4 is


def test_simhash_links_through_rows_without_id(spark, monkeypatch):
    """Named codes 4 bits apart that a null-id code connects, an id above 2 ** 53, and near codes that nobody names."""
    code = {"a": 0x5555555555555555, "bridge": 0x5555555555555556, "b": 0x555555555555555A, "c": -1, "d": -2}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: docs.select("doc_id", F.col("text").cast("long").alias("fp")))
    rows = [(2**53 + 1, code["a"]), (None, code["bridge"]), (2**53 + 3, code["b"]), (None, code["c"]), (None, code["d"]), (5, 0x0F0F0F0F0F0F0F0F)]
    frame = spark.createDataFrame([(i, str(c)) for i, c in rows], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == collections.Counter([(2**53 + 1, 2**53 + 1), (None, 2**53 + 1), (2**53 + 3, 2**53 + 1), (None, None), (None, None), (5, 5)])


def test_dense_codes_in_small_groups(spark):
    """Groups above the limit are cut finer and lose no link."""
    pick = np.random.default_rng(3)
    centre = int(pick.integers(0, 2**63))
    codes = {centre}
    while len(codes) < 400:
        code = centre
        for b in pick.integers(0, 64, pick.integers(1, 7)):
            code ^= 1 << int(b)
        codes.add(code)
    codes = sorted(codes)
    frame = spark.createDataFrame([(simhash.signed(c), i) for i, c in enumerate(codes)], "fp long, node long")
    links = [(i, j) for i in range(400) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3]
    found = simhash.near_links(frame, limit=16)
    assert all((codes[r.a] ^ codes[r.b]).bit_count() <= 64 for r in found.collect())
    group = dict((r.node, r.component) for r in connected(found).collect())
    assert [group.get(i, i) for i in range(400)] == components(400, links)


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


def plain_model(rows):
    tokens = [(i, (t or "").encode().lower().split() + [b" end"]) for i, t in rows]
    train = [w for i, w in tokens if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    one, two = collections.Counter(), collections.Counter()
    for w in train:
        one.update(w)
        two.update(zip([b" start", *w], w))
    n, v = sum(one.values()), len(one)
    before, after, kinds = collections.Counter(b for _, b in two), collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), c in two.items():
        after[a] += c
        kinds[a][min(c, 3) - 1] += 1
    of = lambda c: kneser_ney.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    high, low, cut = of(two), of(before), lambda d, c: d[min(c, 3) - 1] if c else 0
    rest = sum(low[min(c, 3) - 1] for c in before.values()) / len(two) if two else 1
    p1 = lambda w: max(before[w] - cut(low, before[w]), 0) / max(len(two), 1) + rest / (v + 1)

    def p2(a, w):
        c = two[a, w]
        return (max(c - cut(high, c), 0) + sum(x * y for x, y in zip(high, kinds[a])) * p1(w)) / after[a] if after[a] else p1(w)

    return tokens, one, n, v, p2


@pytest.mark.parametrize("which", ["odd", "given"])
def test_scores(request, which):
    frame = request.getfixturevalue(which)
    tokens, one, n, v, p2 = plain_model(texts(frame))
    got = kneser_ney.score(frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    want = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p2(a, x)) for a, x in zip([b" start", *w], w))) for i, w in tokens]
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    words = [*one, b"?never"]
    for context in (b" start", tokens[0][1][0], b"?never"):
        assert sum(p2(context, w) for w in words) == pytest.approx(1)


def test_scores_without_training(spark, none):
    assert kneser_ney.score(none).count() == 0
    held = next(i for i in range(100) if kneser_ney.held_out(i))
    [r] = kneser_ney.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_counts_above_32_bits():
    keys = np.array([3, 5, 9], np.uint64)
    batch = store.blobs(np.zeros(3, np.int64), keys, np.array([1, 2**32 + 7, 2**40]), np.array([1, 2, 3]))
    found, large, small = kneser_ney.unblob(pa.Table.from_batches([batch, batch]), 2)
    assert (found.tolist(), large.tolist(), small.tolist()) == ([3, 5, 9], [2, 2**33 + 14, 2**41], [2, 4, 6])
    assert store.narrow(np.array([2**32 - 1])).dtype == np.uint32 and store.narrow(np.array([2**32])).tolist() == [2**32]
    kneser_ney.numbered_apart(2**32 - 2)
    with pytest.raises(OverflowError):
        kneser_ney.numbered_apart(2**32 - 1)


def test_fetched_arrays_are_bounded(tmp_path, monkeypatch):
    """From a store that cannot be mapped a worker holds a bounded number of bytes and fetches again what went."""
    arrays = {f"a-{i}": np.arange(1000) + i for i in range(6)}
    for name, x in arrays.items():
        store.put(f"file://{tmp_path}", name, x)
    monkeypatch.setattr(store, "MOST_FETCHED", 20_000)
    monkeypatch.setattr(store.pafs, "LocalFileSystem", type("Other", (), {}))
    for name in [*arrays, *reversed(arrays)]:
        assert (store.get(f"file://{tmp_path}", name) == arrays[name]).all() and sum(store.FETCHED.values()) <= 20_000
    for name in list(store.FETCHED):
        store.let_go(name)


def test_held_out_score_beats_the_base(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = kneser_ney.score(frame).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.9 * r[1]


# 4


def test_targets():
    sizes = [("b", 100), ("a", 10), (None, 40), ("c", 50)]
    got = mixing.targets(sizes)  # a, b, c, null weigh 1, 2, 3, 1; a would get 200/7, c 600/7
    assert sum(got.values()) == 200 and all(got[s] <= 3 * n for s, n in sizes)
    assert got["a"] == pytest.approx(200 / 7) and got["c"] == pytest.approx(600 / 7)
    got = mixing.targets([("a", 1), ("b", 1), ("c", 98)])
    assert (got["a"], got["b"], got["c"]) == (3, 3, 94)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0}


@pytest.mark.parametrize("which", ["odd", "given"])
def test_mixing(request, which):
    frame = request.getfixturevalue(which)
    for block in (2, 100_000):
        got = mixing.mix(frame, block=block).collect()
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame, block=2).collect()))  # blocks and reruns change nothing
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] >= 0
    goal = mixing.targets(list(sizes.items()))
    assert sum(sizes.values()) == sum(len((t or "").encode().split()) for _, t in texts(frame)) and len(got) == frame.count()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == float(goal[r["source"]])
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    mixed = mixing.mixed(frame)
    assert mixed.columns == frame.columns
    words = collections.Counter()
    for r in mixed.select("source", "text", "n_chars").collect():
        words[r["source"]] += len(r["text"].encode().split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_mixing_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


# 5


def test_embeddings(spark):
    pick = np.random.default_rng(1)
    centres = pick.standard_normal((60, 16))
    vectors = [(c + 0.12 * pick.standard_normal(16)).tolist() for c in centres for _ in range(4)]
    vectors += [vectors[0]] * 5 + [[-x for x in vectors[0]], [2 * x for x in vectors[0]], None, [], [0.0] * 16, [-0.0] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    rows = [(i, v, "x", 0) for i, v in enumerate(vectors)]
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, links string, node int")
        x = [None if not v or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, np.float32 if kind == "float" else float).astype(float) for v in vectors]
        near = [(i, j) for i in range(len(x)) for j in range(i) if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] / math.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9]
        degree = collections.Counter(i for pair in near for i in pair)
        group = components(len(x), near)
        for block in (2000, 3):
            got = by_id(vector_dups.near_vectors(frame, recall=0.9999, block=block), "vec_id")
            assert [(r["n_links"], r["component_id"], r["kept"]) for r in got] == [(degree[i], group[i], group[i] == i) for i in range(len(x))]
    assert vector_dups.near_vectors(frame.limit(0)).count() == 0


def test_embeddings_link_through_rows_without_id(spark):
    """A null-id vector connects two named ones that are too far apart; vectors that nobody names link too."""
    turn = lambda degrees, at: [0.0] * at + [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))] + [0.0] * (6 - at)
    rows = [(7, turn(0, 0)), (None, turn(20, 0)), (2**53 + 1, turn(40, 0)), (None, turn(0, 2)), (None, turn(20, 2)), (9, turn(0, 4)), (None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dups.near_vectors(frame, recall=0.9999).collect())
    assert got == collections.Counter([(7, 1, 7), (None, 2, 7), (2**53 + 1, 1, 7), (None, 1, None), (None, 1, None), (9, 0, 9), (None, 0, None)])


@pytest.mark.parametrize("order", [[0, 20, 40], [0, 40, 20], [20, 40, 0], [40, 20, 0]])
def test_a_block_keeps_its_links_connected(order):
    """Whichever of a chain's three vectors has the largest number, the block connects them all."""
    x = np.array([[math.cos(math.radians(d)), math.sin(math.radians(d))] for d in order])
    table = pa.table({"node": list(range(3)), "size": [1] * 3, "side": [0] * 3, "vector": [r.tobytes() for r in x]})
    assert len(set(vector_dups.compare(table, 0, True, 0.9, "<f8", *vector_dups.plan(3))[2].tolist())) == 1


def test_blocks_of_a_large_bucket(spark):
    """All vectors of one bucket in blocks of three: as in one piece."""
    pick = np.random.default_rng(2)
    reps = spark.createDataFrame([(i, 1, (np.ones(8) + 0.2 * pick.standard_normal(8)).tolist()) for i in range(40)], "node long, size long, vector array<double>")
    plan = vector_dups.plan(40)
    sums = [sorted(map(tuple, vector_dups.linked(reps, 0.9, *plan, block=b).groupBy("node").agg(F.sum("links"), F.min("least")).collect())) for b in (3, 1000)]
    assert sums[0] == sums[1] and len(sums[0]) == 40


def test_embeddings_of_any_length(spark):
    """Neither large nor tiny norms lose a link."""
    rows = [(i, [x * y for y in (0.6, 0.8, -0.1)]) for i, x in enumerate([1.0, 1e200, 1e-200, 5e-320, 1e308])] + [(5, [1.0, 0.0, 0.0])]
    got = by_id(vector_dups.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=0.9999), "vec_id")
    assert [(r["n_links"], r["component_id"]) for r in got] == [(4, 0)] * 5 + [(0, 5)]


# 6


def plain_repeats(rows):
    first, out = {}, []
    ids = [2**63 - 1 if i is None else i for i, _ in rows]
    raw = [(t or "").encode() for _, t in rows]
    for i, b in zip(ids, raw):
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    for (name, _), i, b in zip(rows, ids, raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((name, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def digest(frame):
    return sorted(map(str, (tuple(r) for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())))


@pytest.mark.parametrize("which", ["odd", "given"])
def test_repeats(request, which):
    frame = request.getfixturevalue(which)
    want = sorted(map(str, plain_repeats(texts(frame))))
    assert digest(suffix_repeats.kept_bytes(frame)) == want
    assert digest(suffix_repeats.kept_bytes(frame, often=2)) == want  # frequent anchors in single strings


def test_repeats_in_periodic_and_overlapping_texts(spark, monkeypatch):
    pick = np.random.default_rng(4)
    base = "".join(pick.choice(list("ab "), 400))
    rows = [(i, base[int(a) : int(a) + int(n)] + "".join(pick.choice(list("ab"), 5)) + base[int(b) : int(b) + 60]) for i, (a, n, b) in enumerate(zip(pick.integers(0, 300, 40), pick.integers(40, 120, 40), pick.integers(0, 340, 40)))]
    rows += [(100 + i, "x" * n) for i, n in enumerate((49, 50, 51, 200))] + [(110, "xy" * 60), (111, "yx" * 60), (112, "abc" * 40 + "d"), (113, "bca" * 40)]
    rows = rows[::-1]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, plain_repeats(rows)))
    assert digest(suffix_repeats.kept_bytes(frame)) == want == digest(suffix_repeats.kept_bytes(frame, often=3))
    monkeypatch.setattr(suffix_repeats, "BLOCK", 64)  # edges of blocks within documents
    assert all(len(suffix_repeats.Slice(t).first) for t in [__import__("pyarrow").table({"doc_id": [1], "text": ["x" * 500]})])


def test_interval_tree():
    common = [3, 5, 5, 2, 0, 4]
    assert sorted(suffix_repeats.prefix_intervals(common, 2)) == [(2, 0, 5), (3, 0, 4), (4, 5, 7), (5, 1, 4)]
    rows = [b"zabcde1", b"zabcde2", b"yabcde3", b"yabc4"]
    data = np.zeros((4, 7), np.uint8)
    for i, r in enumerate(rows):
        data[i, : len(r)] = list(r)
    found = {(n, frozenset(zip(a.tolist(), b.tolist()))) for n, a, b in suffix_repeats.maximal_groups(data, np.array([len(r) for r in rows]), np.zeros(4, int), least=3)}
    # maximal repeats with all occurrences: zabcde; abcde in three; abc in four; yabc
    assert found == {(6, frozenset({(0, 0), (1, 0)})), (5, frozenset({(0, 1), (1, 1), (2, 1)})), (3, frozenset({(0, 1), (1, 1), (2, 1), (3, 1)})), (4, frozenset({(2, 0), (3, 0)}))}


def test_without_repeats(odd, none):
    left = suffix_repeats.without_repeats(odd)
    assert left.columns == odd.columns and suffix_repeats.without_repeats(none).count() == 0 == suffix_repeats.occurrences(none).count()
    got = {(r["doc_id"], r["text"]) for r in left.collect()}
    assert 2 not in {i for i, _ in got} and (4, None) in got and (5, "") in got and (13, "one") in got
    spans = suffix_repeats.occurrences(odd).filter("doc_id = 2").agg(F.min("begin"), F.max("end"), F.min("first_doc_id"), F.max("first_doc_id")).first()
    assert tuple(spans) == (0, len(odd_documents()[0][1]), 1, 1)


# 7


@pytest.mark.parametrize("which", ["odd", "given"])
def test_packing(request, which):
    frame = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(WORD)
    pieces = packing.pack(frame, WORD).collect()
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        documents[p["doc_id"]].append(p)
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    whole = collections.defaultdict(list)
    for i, t in texts(frame):
        whole[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    assert set(whole) == set(documents)
    for i, copies in whole.items():
        spans = collections.Counter((p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in documents[i])
        assert sum(n * k[1] for k, n in spans.items()) == sum(map(len, copies))
        for start, length, crc, total in spans:
            assert any(len(c) == total and zlib.crc32(c[start : start + length].tobytes()) == crc for c in copies)
    used = sum(p["length"] for p in pieces)
    assert len(sequences) <= used / 2048 + 8


def test_packer_minimises_the_sum_of_squares():
    pick = np.random.default_rng(6)
    packer = packing.Packer(0, window=12)
    for i in range(300):
        size = int(pick.integers(1, 12))
        before = packer.count.copy()
        level = packer.level_for(size)

        def after(h):
            c = before.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 12
            return int((c[:12] ** 2).sum())

        options = [0, *(h for h in range(1, 12 - size + 1) if before[h])]
        assert level in options and after(level) == min(map(after, options))
        packer.add(i, np.zeros(size, "<u4").tobytes())
    packer.close_open()
    assert sum(r[2] for r in packer.rows) == sum(r[4] for r in {r[0]: r for r in packer.rows}.values())


@pytest.mark.parametrize("parts", [1, 8, 32, 200])
def test_packing_of_many_partitions(spark, parts):
    """Small partitions pad no more than one: a document is cut at full windows only, and one window in a hundred would be too many for padding."""
    pieces = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(parts), WORD).collect()
    used, windows = sum(p["length"] for p in pieces), collections.Counter()
    for p in pieces:
        windows[p["sequence_id"]] += p["length"]
        assert p["start"] % 2048 == 0 and p["length"] == min(2048, p["doc_tokens"] - p["start"])
    assert max(windows.values()) <= 2048 and len(windows) <= 1.02 * used / 2048 + 10


def test_packing_nothing(none):
    assert packing.pack(none, WORD).count() == 0


# 8


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=9><li>a<li value=3>b<li>c</ol>", "9. a\n3. b\n4. c"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><tr><th rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<table><td>only</table>", "only"), ("<table><caption>t</caption><tr><td>a</table>", "t\na"), ("a<br>b<br/>c</br>d", "a\nb\nc\nd"), ("<pre> x\n  y </pre>z", " x\n  y\n\nz"),
        ("<head><title>no</title><style>no</style></head><body>yes<script>'</p>no'</script>", "yes"), ("<p hidden>no</p><p style='DISPLAY : none'>no</p>yes", "yes"),
        ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"), ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
        ("&lt;b&gt; &amp &eacute;&nbsp;x", "<b> & é x"), ("a <!-- no > --> b<!-- open", "a b"), ("1 < 2 <3 & 4", "1 < 2 <3 & 4"), ("<a title='>' href=x>y</a>", "y"), ("yes<a href='open", "yes"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<blockquote>q</blockquote>e", "  q\n\ne"), ("<textarea> k\n&amp;</textarea>", " k\n&"), ("<svg><title>no</title><path/>no<text>yes</text></svg><math><mi>x</mi><annotation>no</annotation></math>", "yes\nx"), ("<object data=a>no</object><object>yes</object>", "yes"),
        ("<table><tr style=visibility:hidden><td>no<td style=visibility:visible>yes<tbody style=display:none><tr><td>no</table>", "yes"), ("<noscript>no</noscript><template>no</template>t", "t"), ("<b>a</b><i>b</i> c", "ab c"),
    ],
)
def test_rendering(page, text):
    assert html_text.visible_text(page) == text


class Walker(HTMLParser):
    """Visible text by another parser, without layout: only the marks of list items."""

    SKIPPED = {"head", "title", "script", "style", "template", "noscript", "datalist", "iframe", "noembed", "noframes", "audio", "video", "canvas"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in html_text.VOID:
            return
        if tag == "li":
            while self.open and self.open[-1][0] not in ("ul", "ol", "menu", "dir"):
                self.open.pop()
        style = (given.get("style") or "").replace(" ", "").lower()
        hidden = bool(self.open and self.open[-1][1]) or tag in self.SKIPPED or "hidden" in given or "display:none" in style or (tag == "dialog" and "open" not in given)
        closed = [i for i, x in enumerate(self.open) if x[0] == "details" and x[3]]
        hidden = hidden or bool(closed and not any(x[0] == "summary" for x in self.open[closed[-1] + 1 :]) and tag != "summary")
        unseen = bool(self.open and self.open[-1][2])
        if "visibility:" in style:
            unseen = "visibility:visible" not in style
        self.open.append([tag, hidden, unseen, tag == "details" and "open" not in given, int(given.get("start") or 1)])
        if tag == "li" and not hidden:
            outer = self.open[-2] if len(self.open) > 1 else [""] * 5
            number = int(given.get("value") or (outer[4] if outer[0] == "ol" else 1))
            if outer[0] == "ol":
                outer[4] = number + 1
            self.found.append(["mark", f"{number}." if outer[0] == "ol" else "-"])

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        top = self.open[-1] if self.open else ["", False, False, False, 1]
        if not top[1] and not top[2] and not top[3]:
            self.found.append(["text", "".join(data.split())])

    def text(self):
        self.close()
        out, mark = [], ""
        for kind, x in self.found:  # an item without text has no mark
            if kind == "mark":
                mark += x
            elif x:
                out.append(mark + x)
                mark = ""
        return "".join(out)


def test_rendering_keeps_the_text_that_another_parser_sees():
    """The characters of every page, blanks apart, in their order; tables are compared without order, as cells stand side by side."""
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").column("html").to_pylist()
    for page in pages:
        walker = Walker()
        walker.feed(page or "")
        got, want = "".join(html_text.visible_text(page).split()), walker.text()
        assert collections.Counter(got) == collections.Counter(want) if "<table" in (page or "") else got == want


def test_rendering_odd_pages(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000 + "after"
    assert html_text.visible_text(deep).split() == ["deep", "after"]
    assert html_text.visible_text("<table><tr><td>" * 300 + "x").strip() == "x"
    deep = "<div>" * 5000
    assert html_text.visible_text(deep + "<p hidden>secret</p>shown") == "shown"
    assert html_text.visible_text(deep + "<details><summary>s</summary>secret</details>shown") == "s\nshown"
    assert html_text.visible_text(deep + "<div style='visibility:hidden'>" + deep + "no<b style='visibility:visible'>yes") == "yes"
    assert html_text.visible_text(deep + "<pre> x\n  y </pre><ul><li>z<ul><li>w") == " x\n  y\n\n- z\n  - w"
    items = html_text.visible_text("<ul><li>x" * 5000).split("\n")
    assert len(items) == 5000 and items[1] == "  - x" and items[-1] == " " * 80 + "- x"
    assert html_text.visible_text("<table>" + "<tr><td rowspan=1000>a" * 50 + "<tr><td colspan=1000>b<td>c").split() == ["a"] * 50 + ["b", "c"]
    assert html_text.visible_text("<b a='" * 5000) == "" and html_text.visible_text("<p>" * 5000 + "z") == "z"
    long = "<p>" + "word " * 200_000
    frame = spark.createDataFrame([(1, long, "t"), (2, None, "t"), (3, "", "t"), (3, "", "t"), (None, "<p>é", "t")], "page_id long, html string, text string")
    got = by_id(html_text.extract(frame), "page_id")
    assert [(r["page_id"], r["n_lines"], r["n_bytes"]) for r in got] == [(1, 1, 999_999), (2, 0, 0), (3, 0, 0), (3, 0, 0), (None, 1, 2)] and got[4]["text"] == "é"
    assert html_text.extract(frame.limit(0)).count() == 0


# 9


def plain_counts(text):
    text = text or ""
    words = [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("which", ["odd", "given"])
def test_quality(request, which):
    frame = request.getfixturevalue(which)
    got = quality.judge(frame)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = [(i, *(c := plain_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in texts(frame)]
    rows = got.collect()
    assert sorted(map(str, [(r["doc_id"], *(r[n] for n in names), r["base_failed"]) for r in rows])) == sorted(map(str, want))
    assert all(not (r["kept"] and r["base_failed"]) and r["kept"] == (not r["base_failed"] and not r["outlier"]) for r in rows)
    kept = quality.kept_documents(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, (tuple(r) for r in kept.select("doc_id", "text").collect()))) == sorted(str((i, t)) for (i, t) in texts(got.filter("kept").select("doc_id").join(frame, got["doc_id"].eqNullSafe(frame["doc_id"])).select(frame["doc_id"], "text").distinct()) for _ in range(2 if which == "odd" and i == 9 else 1))


def test_quality_nothing(none):
    assert quality.judge(none).count() == 0 and quality.kept_documents(none).count() == 0


def test_quality_keeps_clean_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").groupBy("quality", "kept", "base_failed").count().collect()
    n = collections.Counter({(r["quality"], r["kept"], r["base_failed"]): r["count"] for r in rows})
    assert n[1, False, False] <= 0.01 * n[1, True, False] and n[0, True, False] <= 0.1 * n[0, False, False]


def plain_measures(r):
    rate, share = (lambda k, n: math.log((k + 0.5) / (n + 0.5))), (lambda k, n, half=0.5: math.log((k + half) / (n - k + half)))
    return {
        "symbols_per_word": rate(r["n_symbols"], r["n_words"]), "chars_per_word": rate(r["word_chars"], r["n_words"]), "dup_line_share": share(r["n_dup_lines"], r["n_lines"]),
        "repeat_share": share(r["n_repeat_words"], r["n_words"], 5), "upper_share": share(r["n_upper"], r["word_chars"]), "marks_per_word": rate(r["n_marks"], r["n_words"]),
    }


def plain_fences(rows):
    """Fences of each (lang, source) by plain counting: every document a weight of one, the wider sketch's weights added."""
    good = [r for r in rows if r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]]
    sketch = collections.defaultdict(collections.Counter)
    for r in good:
        for m, v in plain_measures(r).items():
            for key in ((), (r["lang"],), (r["lang"], r["source"])):
                sketch[m, key][math.floor(v / 0.01)] += 1

    def blended(m, key):
        out = collections.Counter(sketch[m, key])
        if key:
            wide = blended(m, key[:-1])
            for b, w in wide.items():
                out[b] += 50 * w / sum(wide.values())
        return out

    def at(weights, q):
        seen = 0
        for b in sorted(weights):
            seen += weights[b]
            if seen >= (q - 1e-9) * sum(weights.values()):
                return b

    def wide(weights, side, middle):
        return max(side * (at(weights, 0.5 + side * (q - 0.5)) - middle) / d for q, d in ((0.75, 0.6745), (0.85, 1.0364)))

    own = {(m, key): blended(m, key) for m, key in list(sketch) if len(key) == 2}
    apart = collections.defaultdict(collections.Counter)
    for m, key in own:
        for b, w in sketch[m, key].items():
            apart[m, key[0]][b - at(own[m, key], 0.5)] += w
    out = {}
    for (m, key), weights in own.items():
        middle = at(weights, 0.5)
        far = {s: quality.FENCE * max(wide(weights, s, middle), wide(apart[m, key[0]], s, 0) / 2) for s in (-1, 1)}
        out[*key, m] = (0.01 * (middle - far[-1]), 0.01 * (middle + far[1] + 1))
    return out


def made_up(groups, seed=5):
    """Counts of documents; each group (lang, source, documents, symbols per word, share of bad ones)."""
    pick, rows = np.random.default_rng(seed), []
    for lang, source, n, rate, bad in groups:
        for i in range(n):
            words = int(pick.integers(50, 900))
            rows.append((len(rows), lang, source, words, int(words * pick.normal(5, 0.1)), 2 * words if i < bad * n else int(pick.poisson(rate * words)), 0, int(pick.integers(0, 3)), int(pick.integers(1, 20)), int(words * pick.uniform(0.05, 0.1)), int(pick.poisson(0.01 * words))))
    return rows


FEATURES = f"doc_id long, lang string, source string, {quality.COUNTS}"


def test_fences_by_plain_counting(spark):
    """Groups of 1, 199, 200 and more documents, and of no language or source; sources of other tails get other fences."""
    groups = [("en", "one", 1, 0.01, 0), ("en", "a", 199, 0.1, 0.05), ("en", "b", 200, 0.1, 0.05), ("en", "calm", 1500, 0.05, 0.1), ("en", "lively", 1500, 0.3, 0.1), ("de", "a", 40, 0.01, 0), (None, "a", 3, 0.5, 0), ("en", None, 30, 0.01, 0)]
    frame = spark.createDataFrame(made_up(groups), FEATURES)
    want = plain_fences([r.asDict() for r in frame.collect()])
    got = {(r["lang"], r["source"], m): tuple(f) for r in quality.thresholds(frame).collect() for m, f in r["fence"].items()}
    assert set(got) == set(want) and len(got) == 6 * len(groups)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    high = {g: got["en", g, "symbols_per_word"][1] for g in ("a", "b", "calm", "lively")}
    assert high["lively"] > high["calm"] + 0.5 and abs(high["a"] - high["b"]) < 0.5  # no step at some size
    judged = quality.verdicts(frame, quality.thresholds(frame)).groupBy("source", (F.col("n_symbols") == 2 * F.col("n_words")).alias("bad"), "kept").count().collect()
    n = collections.Counter({(r["source"], r["bad"], r["kept"]): r["count"] for r in judged})
    assert all(not n[s, True, True] and n[s, False, False] <= 0.01 * n[s, False, True] for s in ("a", "b", "calm", "lively"))


def test_sketches_merge(spark):
    """The sketch of a whole is the sum of its parts' sketches."""
    frame = spark.createDataFrame(made_up([("en", "a", 300, 0.01, 0.1), ("en", "b", 100, 0.05, 0)]), FEATURES)
    halves = [quality.sketches(frame.filter(f"doc_id % 2 = {i}")) for i in (0, 1)]
    as_set = lambda f: {(r["measure"], tuple(map(tuple, r["h"])), r["total"]) for r in quality.merged(f, ["lang"]).collect()}
    assert as_set(halves[0].unionByName(halves[1])) == as_set(quality.sketches(frame))


# 10


@pytest.mark.parametrize("which", ["odd", "given"])
def test_token_counts(request, which):
    frame = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(BYTE)
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in texts(frame)]
    got = token_counts.token_counts(frame, BYTE).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_token_counts_of_odd_strings(none):
    import random

    pick, tokenizer, counter = random.Random(9), Tokenizer.from_file(BYTE), token_counts.PairMerger(open(BYTE).read())
    letters = " \t\n\r\x0b\x0c\xa0 ab'sZ1½é\u0301\U0001f600.,<|>-\x1c\x85\u200b\u3000\ufeff"
    strings = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|>" * 3, "x" * 20_000, " " * 5000, "ab" * 4000 + "<|endoftext|>\n\n"]
    want = [len(e.ids) for e in tokenizer.encode_batch(strings, add_special_tokens=False)]
    assert [counter.count(s) for s in strings] == want
    words = ["ab", "'s", "don't", "1.5", "é", "\U0001f600", "x" * 70, "\0", "a\0b", "<|endoftext|>", "\u2003"]
    spaced = ["".join(pick.choice(words) + pick.choice(" \n\t ") for _ in range(pick.randint(0, 12))) + pick.choice(["", "z"]) for _ in range(2000)]
    want += [len(e.ids) for e in tokenizer.encode_batch(spaced, add_special_tokens=False)]
    assert token_counts.count_all(counter, __import__("pyarrow").array([*strings, *spaced, None])).tolist() == [*want, 0]
    assert token_counts.token_counts(none, BYTE).count() == 0


