"""Engine, commands, paging, transactions, change log and follower on small documents."""

import json

import pytest

from tessera.commands import Commands
from tessera.config import EngineConfig, ReplicationConfig, Role
from tessera.engine import Engine, Follower
from tessera.errors import ConflictError, DocumentValidationError, NotLeaderError, ProtocolError, StorageError, TransactionStateError
from tessera.model import OPLOG, Namespace, read_row

NS = Namespace("test", "users")


def docs(frame):
    return [read_row(r, frame.schema) for r in frame.orderBy("_id").collect()]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/db")


@pytest.fixture
def commands(engine):
    c = Commands(engine)
    assert c.run({"create": "users", "storageColumns": ["name", "age"]}, "test") == {"ok": 1.0}
    return c


def test_crud_and_strict_values(commands, engine):
    r = commands.run({"insert": "users", "documents": [{"_id": 1, "name": "alice", "age": 1}, {"_id": 2, "name": "bob", "age": 1.0}, {"_id": 3, "name": None, "age": "1"}, {"_id": 4, "age": True}]}, "test")
    assert r == {"ok": 1.0, "n": 4, "insertedIds": {"0": 1, "1": 2, "2": 3, "3": 4}}
    ids = lambda f: [d["_id"] for d in commands.run({"find": "users", "filter": f}, "test")["cursor"]["firstBatch"]]
    assert ids({"age": 1}) == [1] and ids({"age": 1.0}) == [2] and ids({"age": "1"}) == [3] and ids({"age": True}) == [4]
    assert ids({"name": None}) == [3]  # a missing field is not null
    assert ids({"_id": {"$gt": 2}}) == [3, 4] and ids({"_id": {"$gte": 2}, "name": "bob"}) == [2] and ids({"age": {"$gt": 0}}) == []
    assert commands.run({"count": "users", "query": {"age": 1}}, "test")["n"] == 1
    assert commands.run({"distinct": "users", "key": "name"}, "test")["values"] == ["alice", "bob", None]  # as a scan meets them
    assert commands.run({"find": "users", "filter": {"_id": {"$lt": 2}}}, "test")["ok"] == 0.0
    assert commands.run({"update": "users", "updates": [{"q": {"_id": 1}, "u": {"$set": {"name": "al"}, "$inc": {"age": 2}}}, {"q": {}, "u": {"$unset": {"age": 1}}, "multi": True}]}, "test") == {"ok": 1.0, "n": 5, "nModified": 5}
    assert docs(engine.session().frame(NS))[0] == {"_id": 1, "name": "al"}
    assert commands.run({"delete": "users", "deletes": [{"q": {"name": "bob"}, "limit": 0}]}, "test")["n"] == 1
    assert [d["_id"] for d in docs(engine.session().frame(NS))] == [1, 3, 4]


def test_insert_stops_at_a_duplicate(commands, engine):
    r = commands.run({"insert": "users", "documents": [{"_id": i} for i in (1, 2, 2, 3)]}, "test")
    assert r["ok"] == 0.0 and "duplicate key" in r["errmsg"]
    assert [d["_id"] for d in docs(engine.session().frame(NS))] == [1, 2]
    assert commands.run({"insert": "users", "documents": [{"_id": 9, "city": "x"}]}, "test")["ok"] == 0.0
    assert commands.run({"insert": "users", "documents": [{"_id": 9, "name": ["x"]}]}, "test")["ok"] == 0.0
    assert commands.run({"insert": "nowhere", "documents": [{"_id": 9}]}, "test")["ok"] == 0.0
    assert commands.run({"find": "nowhere"}, "test")["cursor"] == {"id": 0, "ns": "test.nowhere", "firstBatch": []}


def test_paging(commands, engine):
    commands.run({"insert": "users", "documents": [{"_id": i, "name": str(i)} for i in range(10)]}, "test")

    def pages(**more):
        r = commands.run({"find": "users", **more}, "test")["cursor"]
        out = [[d["_id"] for d in r["firstBatch"]]]
        while r["id"]:
            r = commands.run({"getMore": r["id"], "collection": "users"}, "test")["cursor"]
            out.append([d["_id"] for d in r["nextBatch"]])
        return out

    assert pages(batchSize=3) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    assert pages(batchSize=10) == [list(range(10))] == pages(batchSize=11) == pages(batchSize=0) == pages(batchSize=-1)
    assert pages(batchSize=3, limit=4) == [[0, 1, 2], [3]]
    assert pages(batchSize=4, skip=2) == [[2, 3, 4, 5], [6, 7, 8, 9]]
    assert pages(batchSize=2, singleBatch=True) == [[0, 1]]
    assert pages(filter={"_id": 3}, skip=1) == [[3]]  # an equality on _id ignores the skip
    r = commands.run({"find": "users", "batchSize": 1}, "test")["cursor"]["id"]
    assert commands.run({"killCursors": "users", "cursors": [r, 999, "x"]}, "test") == {"ok": 1.0, "cursorsKilled": [r], "cursorsNotFound": [999], "cursorsAlive": [], "cursorsUnknown": ["x"]}
    assert commands.run({"getMore": r, "collection": "users"}, "test")["ok"] == 0.0
    assert commands.run({"getMore": 0, "collection": "users"}, "test")["cursor"]["nextBatch"] == []
    r = commands.run({"aggregate": "users", "pipeline": [{"$match": {"name": "1"}}, {"$count": "n"}]}, "test")
    assert r["cursor"]["firstBatch"] == [{"n": 1}]
    r = commands.run({"aggregate": "users", "pipeline": [{"$skip": 6}, {"$project": {"name": 1, "_id": 0}}]}, "test")
    assert [d["name"] for d in r["cursor"]["firstBatch"]] == ["6", "7", "8", "9"]
    a = commands.run({"aggregate": "users", "pipeline": [], "cursor": {"batchSize": 6}}, "test")["cursor"]
    assert len(a["firstBatch"]) == 6 and len(commands.run({"getMore": a["id"], "collection": "users"}, "test")["cursor"]["nextBatch"]) == 4


def test_catalog_and_errors(commands, engine):
    assert commands.run({"createIndexes": "users", "indexes": [{"key": {"name": 1}}]}, "test")["numIndexesAfter"] == 2
    assert commands.run({"createIndexes": "users", "indexes": [{"key": {"name": 1}, "name": "name_1"}]}, "test")["ok"] == 1.0  # the same again
    for spec in ({"key": {"city": 1}}, {"key": {"name": -1}}, {"key": {"name": 1, "age": 1}}):
        assert commands.run({"createIndexes": "users", "indexes": [spec]}, "test")["ok"] == 0.0
    assert engine.session().open_index_cursor(NS, "name_1").columns == ["name", "_id"]
    with pytest.raises(StorageError):
        engine.session().open_index_cursor(NS, "none")
    assert [i["name"] for i in commands.run({"listIndexes": "users"}, "test")["cursor"]["firstBatch"]] == ["_id_", "name_1"]
    assert [c["name"] for c in commands.run({"listCollections": 1}, "test")["cursor"]["firstBatch"]] == ["users"]
    assert commands.run({"listCollections": 1}, "test")["cursor"]["ns"] == "test.$cmd.listCollections"
    assert [d["name"] for d in commands.run({"listDatabases": 1}, "admin")["databases"]] == ["local", "test"]
    assert commands.run({"listDatabases": 1}, "test")["ok"] == 0.0
    commands.run({"insert": "users", "documents": [{"name": "x"}]}, "test")
    assert commands.run({"collStats": "users"}, "test") == {"ok": 1.0, "ns": "test.users", "count": 1, "size": 0, "avgObjSize": 0.0, "storageSize": 0, "nindexes": 2, "totalIndexSize": 0}
    s = commands.run({"dbStats": 1}, "test")
    assert (s["collections"], s["objects"], s["indexes"]) == (1, 1, 1)
    assert commands.run({"create": "users", "storageColumns": []}, "test")["ok"] == 0.0
    assert commands.run({"create": "other"}, "test")["ok"] == 0.0
    assert commands.run({"create": "oplog.rs", "storageColumns": []}, "local")["ok"] == 0.0
    assert commands.run({"zzz": 1}, "test") == {"ok": 0.0, "errmsg": "Command not found"}
    for name in ("hello", "isMaster", "PING", "buildInfo", "serverStatus", "connectionStatus"):
        assert commands.run({name: 1}, "test")["ok"] == 1.0
    assert commands.run({"ping": 1})["ok"] == 0.0
    assert len(commands.legacy_query("test.users", {})["cursor"]["firstBatch"]) == 1 and commands.legacy_query("test.$cmd", {"ping": 1})["ok"] == 1.0
    for bad in ("", "a.b", "x" * 64, "a b"):
        with pytest.raises(DocumentValidationError):
            Namespace(bad, "c")
    assert Namespace.parse("a.x.y").collection == "x.y" and Namespace("x" * 63, "c")


def test_transactions_versions_and_audit(commands, engine, spark):
    s = engine.session()
    before = engine.store.manifest().version
    with pytest.raises(ValueError, match="stop"), s.transaction():
        s.insert_one(NS, {"_id": 1})
        assert s.count(NS) == 1 and engine.session().count(NS) == 0
        raise ValueError("stop")
    assert s.count(NS) == 0 and engine.store.manifest().version == before
    with s.transaction():
        s.insert_one(NS, {"_id": 1, "name": "a"})
        s.update(NS, {"_id": 1}, {"$set": {"age": 5}})
        with pytest.raises(TransactionStateError), s.transaction():
            pass
    assert engine.store.manifest().version == before + 1
    assert s.with_transaction(lambda x: x.count(NS)) == 1
    old = engine.session(before)
    assert old.count(NS) == 0 and engine.session(before + 1).count(NS) == 1  # reads as of a version
    with pytest.raises(TransactionStateError):
        old.insert_one(NS, {"_id": 7})
    log = docs(s.change_log())
    assert [(e["_id"], e["op"], e["ns"]) for e in log] == [(1, "c", "test.users"), (2, "i", "test.users"), (3, "u", "test.users")]
    assert log[2]["o"] == '{"_id":1,"name":"a","age":5}' and log[2]["o2"] == '{"_id":1}'
    assert engine.store.audit()["missing"] == []
    assert [k for k, _ in engine.store.manifest().collections["test.users"]["segments"]] == ["rows", "images"]
    assert engine.checkpoint(keep=1) and [k for k, _ in engine.store.manifest().collections["test.users"]["segments"]] == ["rows"]
    assert docs(s.frame(NS)) == [{"_id": 1, "name": "a", "age": 5}] and engine.store.audit() == {"missing": [], "orphans": []}
    assert Engine(spark, engine.store.path).session().count(NS) == 1  # reopened
    with pytest.raises(StorageError):
        engine.session(before).count(NS)


def test_writers_conflict(commands, engine):
    one, two = engine.session(), engine.session()
    with pytest.raises(ConflictError), one.transaction():
        one.insert_one(NS, {"_id": 1})
        two.insert_one(NS, {"_id": 2})
    assert [d["_id"] for d in docs(engine.session().frame(NS))] == [2]
    assert [e["op"] for e in docs(engine.session().change_log())] == ["c", "i"]


def test_torn_manifest(commands, engine, spark):
    engine.session().insert_one(NS, {"_id": 1})
    engine.store.folder.publish(f"manifests/{engine.store.manifest().version + 1:020d}.json", b'{"version": 9, "coll')
    again = Engine(spark, engine.store.path)
    assert again.session().count(NS) == 1  # the last whole state
    again.session().insert_one(NS, {"_id": 2})
    assert Engine(spark, engine.store.path).session().count(NS) == 2


def test_log_rows_left_where_they_were_staged(commands, engine, spark):
    """A writer that ends between publishing and moving its log rows loses nothing."""
    engine.session().insert_one(NS, {"_id": 1})
    name = engine.store.manifest().log[-1]
    engine.store.folder.rename(name, engine.store.staged_log(name.rsplit("-", 1)[1]))
    assert [e["op"] for e in docs(engine.session().change_log())] == ["c"]
    assert engine.checkpoint() is not None
    assert [e["op"] for e in docs(Engine(spark, engine.store.path).session().change_log())] == ["c", "i"]


def test_many_segments(commands, engine, monkeypatch):
    monkeypatch.setattr("tessera.engine.MAX_SEGMENTS", 3)
    s, model = engine.session(), {}
    for i in range(4):
        s.insert_many(NS, [{"_id": 10 * i + k, "age": k} for k in range(3)])
        model |= {10 * i + k: k for k in range(3)}
        s.update(NS, {"age": 1}, {"$set": {"age": 7 + i}}, many=True)
        model = {k: 7 + i if v == 1 else v for k, v in model.items()}
        s.delete(NS, {"age": 7 + i}, many=False)
        del model[min(k for k, v in model.items() if v == 7 + i)]
        assert {d["_id"]: d["age"] for d in docs(s.frame(NS))} == model
        assert len(engine.store.manifest().collections["test.users"]["segments"]) <= 4


def test_rewritten_rows_stay_within_their_bound(commands, engine):
    """However often all documents are written, a read folds twice as many rows as there are; the log keeps every change."""
    s, store = engine.session(), engine.store
    s.insert_many(NS, [{"_id": i, "age": 0} for i in range(20)])
    model, log = {i: 0 for i in range(20)}, [("i", i) for i in range(20)]

    def same():
        assert {d["_id"]: d["age"] for d in docs(s.frame(NS))} == model
        assert sum(store.read(path).count() for _, path in store.manifest().collections["test.users"]["segments"]) <= 40

    for i in range(1, 7):
        assert s.update(NS, {"_id": {"$gt": i}}, {"$set": {"age": i}}, many=True) == 19 - i
        model |= {k: i for k in range(i + 1, 20)}
        log += [("u", k) for k in range(i + 1, 20)]
        same()
    for found, gone in (({"_id": {"$gt": 2}}, range(3, 20)), ({"_id": 1}, [1])):
        assert s.delete(NS, found) == len(gone)
        model = {k: v for k, v in model.items() if k not in gone}
        log += [("d", k) for k in gone]
        same()
    entries = docs(s.change_log())[1:]
    assert [e["_id"] for e in entries] == list(range(2, len(log) + 2))
    assert [(e["op"], json.loads(e["o"])["_id"]) for e in entries] == log


def test_many_changes_are_not_broadcast(commands, engine, monkeypatch):
    """However small their files: a column of one value takes next to no room there."""
    monkeypatch.setattr("tessera.sources.store.FEW", 5, raising=False)
    s = engine.session()
    s.insert_many(NS, [{"_id": i, "age": 0} for i in range(20)])
    plan = lambda: s.frame(NS)._jdf.queryExecution().executedPlan().toString()
    s.update(NS, {"_id": {"$gt": 14}}, {"$set": {"age": 1}}, many=True)
    assert "BroadcastHashJoin" in plan()
    s.update(NS, {"_id": {"$gt": 13}}, {"$set": {"age": 2}}, many=True)
    assert "SortMergeJoin" in plan() and "Broadcast" not in plan()
    assert [d["age"] for d in docs(s.frame(NS))] == [0] * 14 + [2] * 6


def test_update_that_meets_nothing(commands, engine):
    s = engine.session()
    s.insert_one(NS, {"_id": 1, "age": 1})
    before = engine.store.manifest().version
    assert s.update(NS, {"_id": 9}, {"$set": {"age": 2}}, many=True) == 0 == s.update(NS, {"_id": 9}, {"$set": {"city": 2}}) == s.delete(NS, {"_id": 9})
    assert engine.store.manifest().version == before and engine.store.audit() == {"missing": [], "orphans": []}
    with pytest.raises(DocumentValidationError):
        s.update(NS, {"_id": 1}, {"$set": {"city": 2}})


def test_log_text_of_values(commands, engine):
    held = [{"_id": i, "name": v} for i, v in enumerate(["", " ~[]!#", 'q"', "b\\", "x\n", "\u00e9\u20ac", "\x7f\x01", True, False, -5, 2**62, 1.5, None])]
    engine.session().insert_many(NS, held)
    assert [json.loads(e["o"]) for e in docs(engine.session().change_log())[1:]] == held


def test_raw_objects(engine):
    s = engine.session()
    s.create_file("file:kv")
    s.create_file("file:kv")
    c = s.open_file_cursor("file:kv")
    with s.transaction():
        for i in range(8):
            c.insert(b"k%02d" % i, b"v%02d" % i)
    c.set_range(b"k02", b"k06")
    assert [k for k, _ in c] == [b"k02", b"k03", b"k04", b"k05"] and c.next() is None
    c.reset()
    assert c.next() == (b"k02", b"v02") and c.get(b"k07") == b"v07" and c.get(b"zz") is None
    with pytest.raises(StorageError):
        c.insert(b"k01", b"x")
    with pytest.raises(StorageError):
        c.update(b"zz", b"x")
    with pytest.raises(StorageError):
        c.delete(b"zz")
    c.update(b"k03", b"new")
    c.delete(b"k04")
    assert [e for e in c] == [(b"k02", b"v02"), (b"k03", b"new"), (b"k05", b"v05")]
    s.create_table("table:t", ["_id", "a"])
    with pytest.raises(StorageError):
        s.create_table("table:t", ["_id", "b"])
    with pytest.raises(StorageError):
        s.open_table_cursor("table:none")


def test_tailing(commands, engine):
    assert commands.run({"find": "users", "tailable": True}, "test")["ok"] == 0.0
    assert commands.run({"find": "oplog.rs", "awaitData": True}, "local")["ok"] == 0.0
    r = commands.run({"find": "oplog.rs", "filter": {}, "tailable": True, "awaitData": True, "batchSize": 10}, "local")["cursor"]
    assert len(r["firstBatch"]) == 1 and r["id"]
    assert commands.run({"getMore": r["id"], "collection": "oplog.rs", "maxTimeMS": 50}, "local")["cursor"] == {"id": r["id"], "ns": "local.oplog.rs", "nextBatch": []}
    commands.run({"insert": "users", "documents": [{"_id": 1}, {"_id": 2}]}, "test")
    more = commands.run({"getMore": r["id"], "collection": "oplog.rs"}, "local")["cursor"]
    assert [e["_id"] for e in more["nextBatch"]] == [2, 3] and more["id"] == r["id"]


def test_follower(commands, engine, spark, tmp_path):
    follower_config = EngineConfig(replication=ReplicationConfig(Role.SECONDARY, "b", "a:1", "a:1"))
    other = Engine(spark, f"file://{tmp_path}/other", follower_config)
    with pytest.raises(NotLeaderError):
        other.session().insert_one(NS, {"_id": 1})
    reply = Commands(other).run({"insert": "users", "documents": [{"_id": 1}]}, "test")
    assert (reply["code"], reply["primary"]) == (10107, "a:1")
    run = lambda c: commands.run(c, "test")
    run({"insert": "users", "documents": [{"_id": 1, "name": "alice", "age": 30}, {"_id": 2, "name": 'b"\\b', "age": 4.0}, {"_id": "x", "name": None}]})
    run({"createIndexes": "users", "indexes": [{"key": {"name": 1}}]})
    f = Follower(engine, other)
    top = f.catch_up()
    assert top == f.catch_up() == engine.store.manifest().last_index  # again changes nothing
    assert docs(other.session().frame(NS)) == docs(engine.session().frame(NS))
    assert other.session().indexes(NS) == {"name_1": "name"}
    run({"update": "users", "updates": [{"q": {"_id": 1}, "u": {"$inc": {"age": 1}}}]})
    run({"delete": "users", "deletes": [{"q": {"_id": 2}, "limit": 1}]})
    q = f.follow(f"file://{tmp_path}/progress")
    q.awaitTermination(120)
    assert docs(other.session().frame(NS)) == docs(engine.session().frame(NS)) == [{"_id": 1, "name": "alice", "age": 31.0}, {"_id": "x", "name": None}]
    assert engine.followers["b"]["applied"] == (1, engine.store.manifest().last_index)
    assert commands.run({"replSetUpdatePosition": 1, "member": "c", "lastApplied": {"term": 1, "index": 2}}, "admin")["ok"] == 1.0
    assert engine.followers["c"] == {"applied": (1, 2)}
    assert commands.run({"replSetUpdatePosition": 1, "member": "c", "lastApplied": {"term": 1}}, "admin")["ok"] == 0.0


def test_log_has_gaps_and_order(commands, engine):
    commands.run({"insert": "users", "documents": [{"_id": i, "age": 1} for i in (3, 1, 2)]}, "test")
    commands.run({"update": "users", "updates": [{"q": {}, "u": {"$set": {"age": 50}}, "multi": True}]}, "test")
    log = docs(engine.session().change_log())
    assert [e["_id"] for e in log] == list(range(1, 8)) and [e["o2"] for e in log[4:]] == [f'{{"_id":{i}}}' for i in (1, 2, 3)]
    assert engine.session().find(OPLOG, {"_id": {"$gt": 5}}).count() == 2
    with pytest.raises(ProtocolError):
        commands.cursors.take(12345)
