import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as columns of a table they must not matter.
CLASHES = ["size", "row", "kept", "fp", "node", "key", "block", "taken", "part", "counts", "fence", "component_id", "hash", "shard"]


def sentence(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdeiou") for _ in range(pick.randint(2, 7))) for _ in range(n))


def odd_documents():
    base = sentence(1, 90)
    near = base.replace(base.split()[40], "changed", 1)
    shared = sentence(2, 60)
    return [
        (1, base, "en", "s1"), (2, base, "en", "s2"), (3, near, "en", "s1"), (4, None, "en", "s1"), (5, "", "de", None), (6, " \t\n ", None, "s2"),
        (7, sentence(3, 30_000) + "\n" + shared, "en", "s1"), (8, sentence(4, 70) + "\n" + shared + "\n" + sentence(5, 70), None, None),
        (9, "ab" * 30_000, "en", "s3"), (9, "ab" * 30_000, "en", "s3"), (10, "# * # $ " * 60, "en", "s1"), (11, "the cat sat " * 40, "fr", "s3"),
        (12, "Üñî çødé \U0001f600 日本語 e\u0301 <|endoftext|> I'll\u00a0do\u2003it\r\n" + sentence(6, 55), "fr", "s4"), (13, "one", "en", "s4"), (14, "a\0b a\0b a\0b " + sentence(8, 80), "en", "s1"),
        (None, sentence(7, 80), "en", "s2"), (None, shared, "en", "s2"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, la, s, None if t is None else len(t)) + ("x",) * len(CLASHES) for i, t, la, s in odd_documents()]
    return spark.createDataFrame(rows, COLUMNS + "".join(f", {c} string" for c in CLASHES)).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def components(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
