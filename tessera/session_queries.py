"""Registered queries of what sessions and commands do: cursors, errors, roles, versions, recovery, keys.

The customers, and for repeated writes the orders, are loaded into an engine's own store, and read back through it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commands import Commands
from .config import EngineConfig, ReplicationConfig, Role
from .engine import Engine, Follower
from .errors import ConflictError, EngineError, StorageError
from .functions import keys
from .model import Namespace
from .operators import kv
from .plans.filters import access_path, normalized
from .queries import _kv, add, catalog, collection, replied, values

CUSTOMERS, ORDERS = Namespace("tpch", "customer"), Namespace("tpch", "orders")
#: Engines that are only read, by application and folder of tables.
READ_ONLY: dict[tuple[str, str], Commands] = {}

FIELDS = ["_id", "c_name", "c_nationkey", "c_mktsegment"]
_text_columns = "CAST(c_custkey AS VARCHAR) AS _id, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment"


def loaded(spark: SparkSession, d: str) -> Commands:
    """Commands on a fresh engine that holds the customers."""
    commands = catalog(spark)
    commands.engine.session().insert_frame(CUSTOMERS, collection(spark, d, "customer"))
    return commands


def read_only(spark: SparkSession, d: str) -> Commands:
    key = spark.sparkContext.applicationId, d
    if key not in READ_ONLY:
        READ_ONLY[key] = loaded(spark, d)
    return READ_ONLY[key]


def plain(frame: DataFrame) -> DataFrame:
    """The customers of a store as columns of their own kinds."""
    return frame.select(F.col("_id.n").alias("_id"), F.col("c_name.s").alias("c_name"), F.col("c_nationkey.n").alias("c_nationkey"), F.col("c_mktsegment.s").alias("c_mktsegment"))


_plain = "SELECT CAST(c_custkey AS BIGINT) AS _id, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment FROM customer"


def rows_of(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([tuple(str(v) for v in r) for r in rows], ", ".join(f"{n} string" for n in names.split(", ")))


def add_rows(name: str, names: str, query: Callable[[SparkSession, str], list[tuple]], expected: list[tuple]) -> None:
    add(name, lambda spark, d: rows_of(spark, names, query(spark, d)), values(names, expected))


def fetched(commands: Commands, first: dict, collection_name: str) -> list[list[dict]]:
    """All batches of a cursor that a command opened."""
    cursor = commands.run(first, "tpch")["cursor"]
    out = [cursor["firstBatch"]]
    while cursor["id"]:
        cursor = commands.run({"getMore": cursor["id"], "collection": collection_name}, "tpch")["cursor"]
        out.append(cursor["nextBatch"])
    return out


def batches(spark: SparkSession, d: str, command: dict) -> DataFrame:
    """A cursor's documents, each with the number of its batch and its place in it."""
    found = fetched(read_only(spark, d), command, "customer")
    return replied(spark, [x | {"batch": i, "place": j} for i, part in enumerate(found) for j, x in enumerate(part)], [*FIELDS, "batch", "place"])


def batches_sql(size: int, where: str = "TRUE") -> str:
    return f"SELECT {_text_columns}, CAST((n - 1) // {size} AS VARCHAR) AS batch, CAST((n - 1) % {size} AS VARCHAR) AS place FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE {where})"


# scans
add("find_unknown_collection", lambda spark, d: read_only(spark, d).engine.session().find(Namespace("tpch", "nowhere"), {"a": 1}).select(F.col("_id.n").alias("_id")), "SELECT CAST(c_custkey AS BIGINT) AS _id FROM customer WHERE FALSE")
add("legacy_find", lambda spark, d: replied(spark, read_only(spark, d).legacy_query("tpch.customer", {"c_mktsegment": "BUILDING"})["cursor"]["firstBatch"], FIELDS), f"SELECT {_text_columns} FROM customer WHERE c_mktsegment = 'BUILDING'")
add("index_cursor", lambda spark, d: read_only(spark, d).engine.session().open_index_cursor(CUSTOMERS, "c_mktsegment_1").select(F.col("c_mktsegment.s").alias("c_mktsegment"), F.col("_id.n").alias("_id")), "SELECT c_mktsegment, CAST(c_custkey AS BIGINT) AS _id FROM customer")
add("kv_point_get", lambda spark, d: rows_of(spark, "value", [(kv.KvCursor(lambda: _kv(spark, d), lambda k, v: None).get(b"Customer#000000100").decode(),)]), "SELECT c_mktsegment AS value FROM customer WHERE c_name = 'Customer#000000100'")


def walked(spark: SparkSession, d: str) -> list[tuple]:
    """A raw cursor's entries in a range, read again from its start after a reset."""
    cursor = kv.KvCursor(lambda: _kv(spark, d), lambda k, v: None)
    cursor.set_range(b"Customer#000000100", b"Customer#000000120")
    first = cursor.next()
    cursor.reset()
    return [(i, k.decode(), v.decode(), (k, v) == first) for i, (k, v) in enumerate(cursor)]


add("kv_cursor_walk", lambda spark, d: rows_of(spark, "place, key, value, first", walked(spark, d)), "SELECT CAST(n - 1 AS VARCHAR) AS place, c_name AS key, c_mktsegment AS value, CASE WHEN n = 1 THEN 'True' ELSE 'False' END AS first FROM (SELECT *, row_number() OVER (ORDER BY c_name) AS n FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000120')")


def file_entries(spark: SparkSession, d: str) -> list[tuple]:
    session = catalog(spark).engine.session()
    session.create_file("file:entries")
    cursor = session.open_file_cursor("file:entries")
    with session.transaction():
        for i in range(6):
            cursor.insert(b"k%d" % i, b"v%d" % i)
    cursor.update(b"k3", b"new")
    cursor.delete(b"k4")
    refused = []
    for change in (lambda: cursor.insert(b"k1", b""), lambda: cursor.update(b"k9", b""), lambda: cursor.delete(b"k9")):
        try:
            change()
        except StorageError as e:
            refused.append((str(e), ""))
    cursor.set_range(b"k2", b"k6")
    return [(k.decode(), v.decode()) for k, v in cursor] + refused


add_rows("file_cursor", "key, value", file_entries, [("k2", "v2"), ("k3", "new"), ("k5", "v5"), ("duplicate key error", ""), ("key not found", ""), ("key not found", "")])

# find, getMore, killCursors
add("find_in_order_ignores_sort_and_projection", lambda spark, d: batches(spark, d, {"find": "customer", "filter": {"c_mktsegment": "BUILDING"}, "sort": {"c_name": -1}, "projection": {"c_name": 1}}), batches_sql(10**9, "c_mktsegment = 'BUILDING'"))
add("get_more_batches", lambda spark, d: batches(spark, d, {"find": "customer", "filter": {"_id": {"$gt": 300}}, "batchSize": 400}), batches_sql(400, "c_custkey > 300"))
add("find_single_batch", lambda spark, d: batches(spark, d, {"find": "customer", "batchSize": 50, "singleBatch": True}), batches_sql(50, "c_custkey <= (SELECT max(c_custkey) FROM (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 50))"))
add("aggregate_cursor_batches", lambda spark, d: batches(spark, d, {"aggregate": "customer", "pipeline": [{"$match": {"c_mktsegment": "MACHINERY"}}], "cursor": {"batchSize": 70}}), batches_sql(70, "c_mktsegment = 'MACHINERY'"))


def killed(spark: SparkSession, d: str) -> list[tuple]:
    commands = read_only(spark, d)
    number = commands.run({"find": "customer", "batchSize": 1}, "tpch")["cursor"]["id"]
    reply = commands.run({"killCursors": "customer", "cursors": [number, 10**9, "x"]}, "tpch")
    after = commands.run({"getMore": number, "collection": "customer"}, "tpch")
    return [("killed", reply["cursorsKilled"] == [number]), ("not found", reply["cursorsNotFound"]), ("unknown", reply["cursorsUnknown"]), ("then", after["errmsg"] == f"cursor not found: {number}")]


add_rows("kill_cursors", "what, reply", killed, [("killed", "True"), ("not found", "[1000000000]"), ("unknown", "['x']" .replace("'", "''")), ("then", "True")])


def awaited(spark: SparkSession, d: str) -> list[tuple]:
    """A tailing cursor over the change log: waits in vain, then has what was inserted."""
    commands = loaded(spark, d)
    first = commands.run({"find": "oplog.rs", "filter": {"ns": "tpch.nation"}, "tailable": True, "awaitData": True}, "local")["cursor"]
    empty = commands.run({"getMore": first["id"], "collection": "oplog.rs", "maxTimeMS": 10}, "local")["cursor"]
    commands.run({"insert": "nation", "documents": [{"_id": 1}, {"_id": 2}]}, "tpch")
    more = commands.run({"getMore": first["id"], "collection": "oplog.rs"}, "local")["cursor"]
    return [("first", [e["op"] for e in first["firstBatch"]]), ("then", empty["nextBatch"]), ("later", [e["o"] for e in more["nextBatch"]]), ("open", more["id"] == first["id"])]


add_rows("await_data", "what, reply", awaited, [("first", "[''c'']"), ("then", "[]"), ("later", """[''{"_id":1}'', ''{"_id":2}'']"""), ("open", "True")])


# commands and errors
def replies(spark: SparkSession, d: str, commands: list[tuple[dict, str]], names: list[str]) -> list[tuple]:
    run = read_only(spark, d).run
    return [(i, *((r := run(c, db)).get(n) for n in names)) for i, (c, db) in enumerate(commands)]


_connection = ["hello", "isMaster", "PING", "buildInfo", "serverStatus", "connectionStatus"]
add_rows("connection_commands", "place, ok", lambda spark, d: replies(spark, d, [({n: 1}, "admin") for n in _connection], ["ok"]), [(str(i), "1.0") for i in range(len(_connection))])
_wrong = [
    ({"find": "customer", "filter": {"_id": {"$lt": 5}}}, "DocumentValidationError"), ({"find": "customer", "filter": {"_id": {"$gt": 1, "$gte": 2}}}, "DocumentValidationError"), ({"find": 5}, "ProtocolError"),
    ({"getMore": 999, "collection": "customer"}, "ProtocolError"), ({"find": "customer", "tailable": True}, "ProtocolError"), ({"find": "customer", "awaitData": True}, "ProtocolError"),
    ({"insert": "nowhere", "documents": [{"_id": 1}]}, "StorageError"), ({"insert": "customer", "documents": [{"_id": 1}]}, "StorageError"), ({"insert": "customer", "documents": [{"_id": -1, "city": "x"}]}, "DocumentValidationError"),
    ({"insert": "customer", "documents": [{"_id": -1, "c_name": [1]}]}, "DocumentValidationError"), ({"createIndexes": "customer", "indexes": [{"key": {"c_name": -1}}]}, "DocumentValidationError"), ({"create": "customer", "storageColumns": []}, "StorageError"),
    ({"create": "new"}, "DocumentValidationError"), ({"zzz": 1}, "None"), ({"listDatabases": 1}, "ProtocolError"), ({"replSetUpdatePosition": 1}, "ProtocolError"),
]
add_rows("error_documents", "place, ok, name", lambda spark, d: replies(spark, d, [(c, "tpch") for c, _ in _wrong], ["ok", "codeName"]), [(str(i), "0.0", n) for i, (_, n) in enumerate(_wrong)])
_filters = [None, {}, {"_id": 5}, {"_id": {"$gt": 5}}, {"_id": {"$gte": 5}, "a": 1}, {"a": 1}, {"a": [1]}, {"b": 1}]
add_rows("filters_normalised", "place, fields, path", lambda spark, d: [(i, ",".join(normalized(f)), access_path(f, {"by_a": "a"}).kind) for i, f in enumerate(_filters)], [("0", "", "table_scan"), ("1", "", "table_scan"), ("2", "_id", "id_lookup"), ("3", "_id", "id_range"), ("4", "_id,a", "id_range"), ("5", "a", "index_equality"), ("6", "a", "table_scan"), ("7", "b", "table_scan")])


def updated_by_command(spark: SparkSession, d: str) -> DataFrame:
    """Two statements in one command, with the number that it reports."""
    commands = loaded(spark, d)
    n = commands.run({"update": "customer", "updates": [{"q": {"c_mktsegment": "BUILDING"}, "u": {"$set": {"c_name": "x"}}, "multi": True}, {"q": {"c_mktsegment": "MACHINERY"}, "u": {"$set": {"c_name": "y"}}}]}, "tpch")
    return plain(commands.engine.session().frame(CUSTOMERS)).withColumn("n", F.lit(n["n"])).withColumn("modified", F.lit(n["nModified"]))


_changed = "CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY') THEN 'y' ELSE c_name END"
_number = "(SELECT count(*) + 1 FROM customer WHERE c_mktsegment = 'BUILDING')"
add("update_command", updated_by_command, f"SELECT CAST(c_custkey AS BIGINT) AS _id, {_changed} AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, {_number} AS n, {_number} AS modified FROM customer")


# replication
def follower_of(source: Engine) -> Engine:
    return Engine(source.spark, f"{source.store.path}-follower", EngineConfig(replication=ReplicationConfig(Role.SECONDARY, "b", "a:1", source.store.path)))


def followed_by_address(spark: SparkSession, d: str) -> DataFrame:
    """A follower that knows its source by the address of its store only; applied twice."""
    source = loaded(spark, d).engine
    source.session().update(CUSTOMERS, {"c_mktsegment": "BUILDING"}, {"$set": {"c_name": "x"}}, many=True)
    source.session().delete(CUSTOMERS, {"_id": {"$gt": 1000}})
    target = follower_of(source)
    for _ in range(2):
        Follower(source.store.path, target).catch_up()
    return plain(target.session().frame(CUSTOMERS))


add("follower_of_customers", followed_by_address, _plain.replace("c_name,", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE c_name END AS c_name,") + " WHERE c_custkey <= 1000")


def conflicts(spark: SparkSession, d: str) -> list[tuple]:
    """What a follower refuses: an insert beside another document, an update of one that is not there. The same document and an absent key to delete are fine."""
    out = []
    for held, change in (({"_id": 1, "c_name": "other"}, None), ({"_id": 1, "c_name": "a"}, None), (None, "update"), (None, "delete")):
        source = catalog(spark).engine
        target = follower_of(source)
        session = source.session()
        log = session.change_log()
        Follower(source, target).apply(log)
        session.insert_one(CUSTOMERS, {"_id": 1, "c_name": "a"})
        if held:
            with target.session().transaction() as txn:
                txn.add(CUSTOMERS.full_name, "rows", _documents(spark, held))
        if change:
            first = source.store.manifest().last_index
            session.update(CUSTOMERS, {"_id": 1}, {"$set": {"c_name": "b"}}) if change == "update" else session.delete(CUSTOMERS, {"_id": 1})
            log = session.change_log().filter(F.col("_id") > first)
        else:
            log = session.change_log()
        try:
            Follower(source, target).apply(log)
            out.append((len(out), "applied"))
        except StorageError as e:
            out.append((len(out), str(e)))
    return out


def _documents(spark: SparkSession, document: dict) -> DataFrame:
    from .operators.writes import documents_frame
    from .queries import COLUMNS

    return documents_frame(spark, [document], COLUMNS["customer"][1:])


add_rows("apply_conflicts", "place, outcome", conflicts, [("0", "change log inserts another document under a key that is held"), ("1", "applied"), ("2", "change log updates a document that is not there"), ("3", "applied")])


def positions(spark: SparkSession, d: str) -> list[tuple]:
    commands = catalog(spark)
    for command in ({"lastWritten": {"term": 1, "index": 7}}, {"lastApplied": {"term": 1, "index": 5}}, {"lastApplied": {"term": 1}}):
        commands.run({"replSetUpdatePosition": 1, "member": "c", **command}, "admin")
    return [(k, *v) for k, v in sorted(commands.engine.followers["c"].items())]


add_rows("follower_positions", "what, term, place", positions, [("applied", "1", "5"), ("written", "1", "7")])


def refused(spark: SparkSession, d: str) -> list[tuple]:
    """Writes to an engine that follows."""
    commands = Commands(follower_of(catalog(spark).engine))
    wanted = [{"insert": "customer", "documents": [{"_id": 1}]}, {"update": "customer", "updates": [{"q": {}, "u": {"$set": {"c_name": "x"}}}]}, {"delete": "customer", "deletes": [{"q": {}}]}, {"create": "new", "storageColumns": []}]
    return [(i, (r := commands.run(c, "tpch"))["code"], r["codeName"], r["primary"]) for i, c in enumerate(wanted)] + [(9, commands.run({"hello": 1}, "admin")["isWritablePrimary"], "", "")]


add_rows("writes_refused_by_role", "place, code, name, hint", refused, [(str(i), "10107", "NotWritablePrimary", "a:1") for i in range(4)] + [("9", "False", "", "")])


def configured(spark: SparkSession, d: str) -> list[tuple]:
    path, config = EngineConfig.from_arguments(["--db-path", "p", "--role", "secondary", "--sync-source", "s", "--node-name", "n"])
    out = [(path, config.replication.role.value, config.replication.sync_source, config.replication.node_name)]
    try:
        EngineConfig.from_arguments(["--role", "secondary"])
    except EngineError as e:
        out.append((type(e).__name__, "", "", ""))
    return out


add_rows("engine_configuration", "path, role, source, node", configured, [("p", "secondary", "s", "n"), ("DocumentValidationError", "", "", "")])


# transactions, versions, recovery
def versions(spark: SparkSession, d: str) -> DataFrame:
    """The customers as they were before a delete, read by version."""
    engine = loaded(spark, d).engine
    before = engine.store.manifest().version
    engine.session().delete(CUSTOMERS, {"c_mktsegment": "BUILDING"})
    now = plain(engine.session().frame(CUSTOMERS)).withColumn("state", F.lit("now"))
    return now.unionByName(plain(engine.session(before).frame(CUSTOMERS)).withColumn("state", F.lit("before")))


add("historical_version", versions, f"SELECT *, 'before' AS state FROM ({_plain}) UNION ALL SELECT *, 'now' FROM ({_plain}) WHERE c_mktsegment <> 'BUILDING'")


def seen(spark: SparkSession, d: str) -> DataFrame:
    """Counts inside an open transaction, beside it, after it was dropped and after a second one was kept."""
    engine = loaded(spark, d).engine
    session, out = engine.session(), []
    try:
        with session.transaction():
            session.delete(CUSTOMERS, {"c_mktsegment": "BUILDING"})
            out += [("inside", session.count(CUSTOMERS)), ("beside", engine.session().count(CUSTOMERS))]
            raise StorageError("given up")
    except StorageError:
        out.append(("dropped", engine.session().count(CUSTOMERS)))
    session.with_transaction(lambda s: s.delete(CUSTOMERS, {"c_mktsegment": "BUILDING"}))
    return spark.createDataFrame([*out, ("kept", engine.session().count(CUSTOMERS))], "state string, n long")


add("transaction_visibility", seen, " UNION ALL ".join(f"SELECT '{s}' AS state, count(*) AS n FROM customer" + (" WHERE c_mktsegment <> 'BUILDING'" if s in ("inside", "kept") else "") for s in ("inside", "beside", "dropped", "kept")))


def raced(spark: SparkSession, d: str) -> DataFrame:
    """Of two writers from one state the first to publish stays; the other leaves no trace."""
    engine = loaded(spark, d).engine
    one, two, outcome = engine.session(), engine.session(), "both"
    try:
        with one.transaction():
            one.delete(CUSTOMERS, {"c_mktsegment": "MACHINERY"})
            two.delete(CUSTOMERS, {"c_mktsegment": "BUILDING"})
    except ConflictError:
        outcome = "conflict"
    return plain(engine.session().frame(CUSTOMERS)).withColumn("outcome", F.lit(outcome))


add("writers_conflict", raced, f"SELECT *, 'conflict' AS outcome FROM ({_plain}) WHERE c_mktsegment <> 'BUILDING'")


def recovered(spark: SparkSession, d: str) -> DataFrame:
    """Reopened after a torn manifest, log rows left where they were staged, and a checkpoint."""
    engine = loaded(spark, d).engine
    engine.session().delete(CUSTOMERS, {"c_mktsegment": "BUILDING"})
    store = engine.store
    name = store.manifest().log[-1]
    store.folder.rename(name, store.staged_log(name.rsplit("-", 1)[1]))
    store.folder.publish(f"manifests/{store.manifest().version + 1:020d}.json", b'{"version": 9, "coll')
    again = Engine(spark, store.path)
    n = again.session().change_log().filter("op = 'd'").count()
    again.checkpoint()
    report = again.store.audit()
    state = ",".join(k for k, _ in again.store.manifest().collections[CUSTOMERS.full_name]["segments"])
    return plain(Engine(spark, store.path).session().frame(CUSTOMERS)).withColumn("deleted", F.lit(n)).withColumn("state", F.lit(f"{state} {len(report['missing'])} {len(report['orphans'])}"))


add("recovery_and_checkpoint", recovered, f"SELECT *, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS deleted, 'rows 0 0' AS state FROM ({_plain}) WHERE c_mktsegment <> 'BUILDING'")


def audited(spark: SparkSession, d: str) -> list[tuple]:
    """A store that lost a segment is not opened; a folder that no state names is reported."""
    engine = loaded(spark, d).engine
    engine.store.write(spark.range(1))
    out = [("orphans", len(Engine(spark, engine.store.path).orphans))]
    engine.store.folder.delete(engine.store.manifest().collections[CUSTOMERS.full_name]["segments"][0][1])
    try:
        Engine(spark, engine.store.path)
    except StorageError as e:
        out.append(("missing", str(e).startswith("snapshots are missing")))
    return out


add_rows("startup_audit", "what, found", audited, [("orphans", "1"), ("missing", "True")])

#: Writes beyond the number of segments at which changes are folded.
ROUNDS = 20


def rewritten(spark: SparkSession, d: str) -> DataFrame:
    """The orders after many updates, a delete and an insert of some of the deleted ones, read back in one pass."""
    session = catalog(spark).engine.session()
    orders = collection(spark, d, "orders").select("_id", "o_custkey", "o_orderstatus", "o_orderpriority")
    session.insert_frame(ORDERS, orders)
    for i in range(ROUNDS):
        session.update(ORDERS, {"_id": {"$gt": 100 * i}}, {"$set": {"o_custkey": i}}, many=True)
    session.delete(ORDERS, {"o_orderstatus": "F"})
    session.insert_frame(ORDERS, orders.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"))
    frame = session.frame(ORDERS)
    return frame.select(F.col("_id.n").alias("_id"), F.col("o_custkey.n").alias("o_custkey"), F.col("o_orderstatus.s").alias("o_orderstatus"))


_last = f"CASE WHEN o_orderstatus = 'F' OR o_orderkey <= 0 THEN CAST(o_custkey AS BIGINT) ELSE least({ROUNDS - 1}, CAST(ceil(o_orderkey / 100.0) AS BIGINT) - 1) END"
add("stored_many_updates", rewritten, f"SELECT CAST(o_orderkey AS BIGINT) AS _id, {_last} AS o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT'")


# identifiers and keys
def keyed(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the stored key of its identifier, and its index key read back, within the index's bounds."""
    id_key = F.udf(lambda n: keys.id_key(n).hex(), "string")
    index_key = F.udf(lambda s, n: bytearray(keys.index_key(s, n)), "binary")
    back, inside = F.udf(keys.index_id, "long"), F.udf(lambda s, k: keys.index_bounds(s)[0] <= bytes(k) < keys.index_bounds(s)[1], "boolean")
    rows = collection(spark, d, "customer").select(F.col("_id").cast("long").alias("_id"), id_key(F.col("_id")).alias("id_key"), index_key("c_mktsegment", "_id").alias("index_key"), "c_mktsegment")
    return rows.select("_id", "id_key", back("index_key").alias("index_id"), inside("c_mktsegment", "index_key").alias("within"))


def extremes(spark: SparkSession, d: str) -> DataFrame:
    """Of each nation the balances of least and greatest sortable bytes."""
    ordered = F.udf(lambda x: bytearray(keys.sortable_double(x)), "binary")
    return collection(spark, d, "customer").withColumn("bytes", ordered("c_acctbal")).groupBy("c_nationkey").agg(F.min_by("c_acctbal", "bytes").alias("low"), F.max_by("c_acctbal", "bytes").alias("high"))


_little_endian = " || ".join(f"lower(printf('%02X', (c_custkey >> {8 * i}) & 255))" for i in range(8))
add("key_encodings", keyed, f"SELECT CAST(c_custkey AS BIGINT) AS _id, '12000000125f696400' || {_little_endian} || '00' AS id_key, CAST(c_custkey AS BIGINT) AS index_id, TRUE AS within FROM customer")
add("sortable_doubles", extremes, "SELECT c_nationkey, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_nationkey")
add_rows("wire_values", "place, stored", lambda spark, d: [(i, keys.from_wire(v)) for i, v in enumerate([keys.ObjectId("ab"), 1, 1.5, True, None, "x", float("nan"), 2**70, {"a": [float("inf")]}])], [("0", "ab"), ("1", "1"), ("2", "1.5"), ("3", "True"), ("4", "None"), ("5", "x"), ("6", "0"), ("7", "None"), ("8", "{''a'': [0]}")])
add_rows("default_identifiers", "length, hexadecimal, distinct_ids, checksum", lambda spark, d: [(len(x), int(x, 16) >= 0, len({keys.object_id() for _ in range(100)}), keys.checksum(b"123456789")) for x in [keys.with_id({})["_id"]]], [("24", "True", "100", str(0xCBF43926))])
