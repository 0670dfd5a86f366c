"""Filters, stages and updates: against a plain model on random documents, and by the plans they give."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import DocumentValidationError
from tessera.functions import keys
from tessera.functions.cells import json_document
from tessera.model import kind_of, read_row
from tessera.operators import reads, writes
from tessera.plans.filters import access_path, predicate
from tessera.plans.pipeline import aggregate
from tessera.plans.updates import updated
from tessera.sources.tables import table

FIELDS = ["a", "b"]
VALUES = [None, True, False, 0, 1, -3, 1.0, 2.5, "", "1", "x'\"\\"]


def same(x, y):
    return kind_of(x) == kind_of(y) and x == y


def matches(document, filter_doc):
    return all(k in document and same(document[k], v) for k, v in filter_doc.items())


def applied(document, change):
    new = dict(document)
    for k, v in change.get("$set", {}).items():
        new[k] = v
    for k in change.get("$unset", {}):
        new.pop(k, None)
    for k, v in change.get("$inc", {}).items():
        if kind_of(v) in (3, 4):
            old = new.get(k)
            total = (float(old) if kind_of(old) in (3, 4) else 0.0) + v
            new[k] = total if math.isfinite(total) else 0
    return new


def tidy(documents):
    return sorted((json.dumps(sorted((k, kind_of(v), repr(v)) for k, v in d.items())) for d in documents))


def rows(frame):
    return [read_row(r, frame.schema) for r in frame.collect()]


@pytest.fixture(scope="module")
def sample(spark):
    pick = random.Random(5)
    documents = [{"_id": i, **{f: pick.choice(VALUES) for f in FIELDS if pick.random() < 0.8}} for i in range(120)]
    return documents, writes.documents_frame(spark, documents, FIELDS).cache()


def test_filters_against_a_model(sample):
    documents, frame = sample
    pick = random.Random(7)
    wanted = [{f: pick.choice(VALUES) for f in FIELDS[: pick.randint(1, 2)]} for _ in range(25)]
    flags = frame.select("_id.n", *[predicate(frame.schema, f).alias(f"f{i}") for i, f in enumerate(wanted)]).collect()
    for i, f in enumerate(wanted):
        assert {r["n"] for r in flags if r[f"f{i}"]} == {d["_id"] for d in documents if matches(d, f)}
        assert all(r[f"f{i}"] is not None for r in flags)
    assert tidy(rows(reads.find(frame, wanted[0]))) == tidy(d for d in documents if matches(d, wanted[0]))


def test_updates_and_deletes_against_a_model(sample):
    documents, frame = sample
    pick = random.Random(11)
    for _ in range(8):
        f = {pick.choice(FIELDS): pick.choice(VALUES)}
        change = {op: {pick.choice(FIELDS): pick.choice([*VALUES, 1e308])} for op in pick.sample(["$set", "$unset", "$inc"], 2)}
        many = pick.random() < 0.6
        hit = [d["_id"] for d in documents if matches(d, f)]
        hit = hit if many else hit[:1]
        got = writes.update(frame, f, change, many)
        assert tidy(rows(got.after)) == tidy(applied(d, change) if d["_id"] in hit else d for d in documents)
        assert {d["_id"] for d in rows(got.changed)} == set(hit)
        assert tidy(rows(writes.delete(frame, f, many).after)) == tidy(d for d in documents if d["_id"] not in hit)


def test_plain_columns(spark):
    frame = spark.createDataFrame([(1, "a", None), (2, None, 3), (3, "b", 4)], "_id long, s string, n int")
    assert [d["_id"] for d in rows(writes.delete(frame, {"s": "a"}).after.orderBy("_id"))] == [2, 3]  # a null is not a match, and stays
    assert [d["_id"] for d in rows(reads.find(frame, {"s": None}))] == [2]
    gone = updated(frame, predicate(frame.schema, {"_id": 1}), {"$unset": {"n": 1, "s": 1}})
    assert rows(reads.find(gone, {"s": None})) == [{"_id": 2, "s": None, "n": 3}] and rows(gone.filter("_id = 1")) == [{"_id": 1}]
    again = updated(gone, predicate(gone.schema, {"_id": 1}), {"$set": {"s": 5}, "$inc": {"n": 2}})
    assert rows(again.filter("_id = 1")) == [{"_id": 1, "s": 5, "n": 2.0}]
    assert rows(reads.distinct(gone, "s").orderBy("value")) == [{"value": None}, {"value": "b"}]
    assert [r[0] for r in frame.select(json_document(frame.schema)).collect()] == ['{"_id":1,"s":"a","n":null}', '{"_id":2,"s":null,"n":3}', '{"_id":3,"s":"b","n":4}']
    for bad in ({"$set": {"city": 1}}, {"$set": {"s": [1]}}, {"$set": {"_id": 2}}, {"city": 1}):
        with pytest.raises(DocumentValidationError):
            updated(frame, F.lit(True), bad)
    with pytest.raises(Exception, match="scalar"):
        writes.update(gone, {}, {"$push": {"s": "x"}})
    assert rows(writes.update(frame, {"_id": 1}, {"$push": {"s": "x"}}).after.filter("_id = 1"))[0]["s"] == "a"


def test_id_ranges_and_paths(spark):
    ids = [-1, 0, 1, 254, 255, 256, 257, 65536]
    frame = spark.createDataFrame([(i,) for i in ids], "_id long")
    assert [r[0] for r in reads.find(frame, {"_id": {"$gt": 254}}).orderBy("_id").collect()] == [255, 256, 257, 65536]  # numeric order
    assert reads.count(frame, {"_id": {"$gte": "a"}}).first()[0] == 0 and reads.count(frame, {"_id": {"$gt": None}}).first()[0] == 8
    for bad in ({"_id": {"$lt": 1}}, {"_id": {}}, {"_id": {"$gt": 1, "$gte": 1}}, 5):
        with pytest.raises(DocumentValidationError):
            reads.find(frame, bad)
    assert access_path({}).kind == "table_scan" and access_path({"_id": 1}).kind == "id_lookup" and access_path({"_id": {"$gt": 1}}).kind == "id_range"
    assert access_path({"a": 1, "b": 2}, {"b_1": "b", "a_1": "a"}).index == "a_1" and access_path({"a": [1]}, {"a_1": "a"}).kind == "table_scan"


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    frame = table(spark, sf_dir, "customer")
    plan = lambda f: f._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan(reads.find(frame, {"c_mktsegment": "BUILDING"}))
    assert "GreaterThan(c_custkey,5)" in plan(reads.find(frame, {"_id": {"$gt": 5}}))
    staged = plan(aggregate(frame, [{"$match": {"c_mktsegment": "BUILDING"}}, {"$project": {"c_name": 1, "_id": 0}}]))
    assert "EqualTo(c_mktsegment,BUILDING)" in staged and "ReadSchema: struct<c_name:string,c_mktsegment:string>" in staged
    assert "ReadSchema: struct<>" in plan(reads.count(frame))
    assert "TakeOrderedAndProject" in plan(reads.find(frame, None, skip=5, limit=10))
    assert "Exchange" not in plan(updated(frame, predicate(frame.schema, {"c_nationkey": 1}), {"$inc": {"c_acctbal": 1}}))


def test_keys_and_wire_values():
    scalars = [None, False, True, -2, -1, 1, 2, math.pi, "", "a", "aa", "b"]
    for v in scalars:
        assert keys.id_of(keys.id_key(v)) == v and keys.index_id(keys.index_key(v, 7)) == 7
        low, high = keys.index_bounds(v)
        assert low <= keys.index_key(v, "any") <= high
    numbers = [-math.inf, -2.5, -1, -0.0, 0.5, 1, 2, 1e300]
    assert sorted(numbers, key=lambda x: keys.sortable_double(float(x))) == numbers
    assert keys.index_prefix([1]) is None and keys.index_id(b"") is None and keys.index_id(b"\x09") is None
    one, two = keys.object_id(), keys.object_id()
    assert len(one) == 24 and one != two and one[:18] == two[:18]
    assert keys.from_wire({"a": math.nan, "b": b"x", "c": [math.inf, 2**70], "d": keys.ObjectId("ab")}) == {"a": 0, "b": None, "c": [0, None], "d": "ab"}
    assert keys.checksum(b"123456789") == 0xCBF43926
