"""Registered queries of the document engine over the given tables, each with its SQL.

A query whose result depends on order sits on a unique key. Names follow the operator that they show.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commands import Commands
from .config import EngineConfig, ReplicationConfig, Role
from .engine import Engine, Follower
from .errors import StorageError
from .functions.cells import json_document, quoted
from .model import ID, Namespace
from .operators import cursors, kv, reads, writes
from .plans.filters import predicate
from .plans.pipeline import aggregate
from .plans.updates import updated
from .sources.files import Folder, shared_folder
from .sources.tables import table
from .streaming import changelog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Columns of the tables used here, key first.
COLUMNS = {
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def collection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's columns as listed, as a collection."""
    return table(spark, sf_dir, name).select(ID, *COLUMNS[name][1:])


def sql_columns(name: str, replaced: dict[str, str] | None = None) -> str:
    key, *rest = COLUMNS[name]
    replaced = replaced or {}
    return ", ".join([f"{key} AS _id", *(f"{replaced[c]} AS {c}" if c in replaced else c for c in rest)])


def sql(name: str, where: str = "", replaced: dict[str, str] | None = None) -> str:
    return f"SELECT {sql_columns(name, replaced)} FROM {name}" + (f" WHERE {where}" if where else "")


def add(name: str, query: Query, oracle: str | None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def add_find(name: str, source: str, filter_doc: Any, where: str, tail: str = "", **options: Any) -> None:
    add(name, lambda spark, d: reads.find(collection(spark, d, source), filter_doc, **options), f"{sql(source, where)} {tail}".strip())


# scans and filters
for _source in COLUMNS:
    add_find(f"find_all_{_source}", _source, None, "")
add_find("find_id_point", "customer", {"_id": 42}, "c_custkey = 42")
add_find("find_id_point_and_field", "customer", {"_id": 42, "c_mktsegment": "BUILDING"}, "c_custkey = 42 AND c_mktsegment = 'BUILDING'")
add_find("find_id_gt", "customer", {"_id": {"$gt": 1000}}, "c_custkey > 1000")
add_find("find_id_gte", "customer", {"_id": {"$gte": 1000}}, "c_custkey >= 1000")
add_find("find_id_gt_double_bound", "customer", {"_id": {"$gt": 999.5}}, "c_custkey > 999.5")
add_find("find_id_type_mismatch", "customer", {"_id": "42"}, "FALSE")
add_find("find_eq_indexed", "customer", {"c_mktsegment": "BUILDING"}, "c_mktsegment = 'BUILDING'")
add_find("find_eq_unindexed", "part", {"p_size": 15}, "p_size = 15")
add_find("find_conjunction", "orders", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
add_find("find_id_gt_and_eq", "orders", {"_id": {"$gt": 500}, "o_orderstatus": "O"}, "o_orderkey > 500 AND o_orderstatus = 'O'")
add_find("find_type_mismatch", "part", {"p_retailprice": 900}, "FALSE")
add_find("find_type_match_double", "part", {"p_retailprice": 900.0}, "p_retailprice = 900.0")
add_find("find_int_field_double_literal", "part", {"p_size": 15.0}, "FALSE")
add_find("find_operator_literal", "part", {"p_size": {"$gt": 10}}, "FALSE")
add_find("find_array_literal", "part", {"p_size": [15]}, "FALSE")
add_find("find_null_literal", "customer", {"c_mktsegment": None}, "c_mktsegment IS NULL")
add_find("find_undeclared_field", "customer", {"city": "x"}, "FALSE")
add_find("find_documents_by_lang_and_source", "documents", {"lang": "de", "source": "src0"}, "lang = 'de' AND source = 'src0'")
add_find("find_string_props", "events", {"event_type": "purchase"}, "event_type = 'purchase'")

# order, skip, limit, paging
add_find("find_skip", "nation", None, "", "ORDER BY n_nationkey LIMIT 1000 OFFSET 20", skip=20)
add_find("find_limit", "orders", None, "", "ORDER BY o_orderkey LIMIT 100", limit=100)
add_find("find_skip_limit", "customer", {"c_mktsegment": "MACHINERY"}, "c_mktsegment = 'MACHINERY'", "ORDER BY c_custkey LIMIT 10 OFFSET 5", skip=5, limit=10)
add_find("find_negative_skip_and_limit", "region", None, "", "", skip=-3, limit=-1)
add_find("find_id_point_ignores_skip", "customer", {"_id": 42}, "c_custkey = 42", "", skip=1)


def pages(frame: DataFrame, filter_doc: Any, size: int, limit: int | None = None) -> list[cursors.Page]:
    """All pages of a cursor, one query each."""
    cursor, out = cursors.FindCursor("", lambda: frame, filter_doc, size, limit), []
    while True:
        found, more = cursor.next_page()
        out.append(found)
        if not more:
            return out


def paged(spark: SparkSession, d: str, source: str, filter_doc: Any, size: int, limit: int | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    frame = collection(spark, d, source)
    rows = [tuple(x.get(c) for c in frame.columns) for p in pages(frame, filter_doc, size, limit)[first:last] for x in p.documents]
    return spark.createDataFrame(rows, frame.schema)


add("find_paged_concat", lambda spark, d: paged(spark, d, "nation", None, 7), sql("nation"))
add("find_paged_with_limit", lambda spark, d: paged(spark, d, "nation", None, 4, limit=10), f"{sql('nation')} ORDER BY n_nationkey LIMIT 10")
add("find_page_2", lambda spark, d: paged(spark, d, "customer", {"_id": {"$gt": 1400}}, 10, limit=20, first=1, last=2), f"{sql('customer', 'c_custkey > 1400')} ORDER BY c_custkey LIMIT 10 OFFSET 10")
add("find_resumed_after_bookmark", lambda spark, d: cursors.page_frame(collection(spark, d, "orders"), {"o_orderstatus": "F"}, 25, bookmark=5000), f"{sql('orders', 'o_orderkey > 5000 AND ' + chr(111) + '_orderstatus = ' + repr('F'))} ORDER BY o_orderkey LIMIT 25")

# count, distinct, statistics
add("count_all", lambda spark, d: reads.count(collection(spark, d, "orders")), "SELECT count(*) AS n FROM orders")
add("count_filtered", lambda spark, d: reads.count(collection(spark, d, "orders"), {"o_orderstatus": "F"}), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
add("count_empty", lambda spark, d: reads.count(collection(spark, d, "orders"), {"o_orderstatus": "?"}), "SELECT count(*) AS n FROM orders WHERE FALSE")
add("count_id_range", lambda spark, d: reads.count(collection(spark, d, "events"), {"_id": {"$gte": 100}}), "SELECT count(*) AS n FROM events WHERE event_id >= 100")
add("distinct_key", lambda spark, d: reads.distinct(collection(spark, d, "customer"), "c_mktsegment"), "SELECT DISTINCT c_mktsegment AS value FROM customer")
add("distinct_filtered", lambda spark, d: reads.distinct(collection(spark, d, "orders"), "o_orderpriority", {"o_orderstatus": "P"}), "SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'P'")
add("distinct_default_id", lambda spark, d: reads.distinct(collection(spark, d, "nation")), "SELECT DISTINCT n_nationkey AS value FROM nation")
add("distinct_unknown_key", lambda spark, d: reads.distinct(collection(spark, d, "nation"), "city"), "SELECT CAST(NULL AS VARCHAR) AS value FROM nation WHERE FALSE")
add("coll_stats", lambda spark, d: reads.collection_stats(collection(spark, d, "part"), "tpch.part", 1), 'SELECT \'tpch.part\' AS ns, count(*) AS "count", CAST(0 AS BIGINT) AS size, CAST(0 AS DOUBLE) AS "avgObjSize", CAST(0 AS BIGINT) AS "storageSize", 2 AS nindexes, CAST(0 AS BIGINT) AS "totalIndexSize" FROM part')
add(
    "db_stats",
    lambda spark, d: reads.database_stats({n: collection(spark, d, n) for n in COLUMNS}, "tpch", 3, spark),
    f"SELECT 'tpch' AS db, {len(COLUMNS)} AS collections, CAST(sum(n) AS BIGINT) AS objects, CAST(0 AS DOUBLE) AS \"avgObjSize\", CAST(0 AS BIGINT) AS \"dataSize\", CAST(0 AS BIGINT) AS \"storageSize\", 3 AS indexes, CAST(0 AS BIGINT) AS \"indexSize\" FROM ("
    + " UNION ALL ".join(f"SELECT count(*) AS n FROM {n}" for n in COLUMNS) + ")",
)


# aggregation stages
def add_pipeline(name: str, source: str, stages: list, oracle: str) -> None:
    add(name, lambda spark, d: aggregate(collection(spark, d, source), stages), oracle)


_building = "c_mktsegment = 'BUILDING'"
add_pipeline("agg_match", "customer", [{"$match": {"c_mktsegment": "BUILDING"}}], sql("customer", _building))
add_pipeline("agg_match_empty", "nation", [{"$match": {}}], sql("nation"))
add_pipeline("agg_match_id", "customer", [{"$match": {"_id": 7}}], sql("customer", "c_custkey = 7"))
add_pipeline("agg_match_id_op_matches_nothing", "customer", [{"$match": {"_id": {"$gt": 7}}}], sql("customer", "FALSE"))
add_pipeline("agg_limit", "orders", [{"$limit": 30}], f"{sql('orders')} ORDER BY o_orderkey LIMIT 30")
add_pipeline("agg_limit_negative_is_none", "nation", [{"$limit": -1}], sql("nation"))
add_pipeline("agg_limit_double_is_none", "nation", [{"$limit": 3.0}], sql("nation"))
add_pipeline("agg_skip", "nation", [{"$skip": 20}], f"{sql('nation')} ORDER BY n_nationkey LIMIT 1000 OFFSET 20")
add_pipeline("agg_skip_negative_drops_all", "nation", [{"$skip": -1}], sql("nation", "FALSE"))
add_pipeline("agg_count", "customer", [{"$match": {"c_mktsegment": "BUILDING"}}, {"$count": "total"}], f"SELECT count(*) AS total FROM customer WHERE {_building}")
add_pipeline("agg_count_empty", "customer", [{"$match": {"c_mktsegment": "?"}}, {"$count": "total"}], "SELECT count(*) AS total FROM customer WHERE FALSE")
add_pipeline("agg_project_incl", "customer", [{"$project": {"c_name": 1, "c_nationkey": True}}], "SELECT c_name, c_nationkey, c_custkey AS _id FROM customer")
add_pipeline("agg_project_no_id", "customer", [{"$project": {"c_name": 1, "_id": 0}}], "SELECT c_name FROM customer")
add_pipeline("agg_project_false_keeps_id", "nation", [{"$project": {"n_name": 1, "_id": False}}], "SELECT n_name, n_nationkey AS _id FROM nation")
add_pipeline("agg_project_double_is_no_inclusion", "nation", [{"$project": {"n_name": 1.0, "n_regionkey": 1}}], "SELECT n_regionkey, n_nationkey AS _id FROM nation")
add_pipeline("agg_project_exclusion_only_id", "nation", [{"$project": {"n_name": 0}}], "SELECT n_nationkey AS _id FROM nation")
add_pipeline("agg_multi_key_stage", "customer", [{"$project": {"c_name": 1}, "$skip": 2, "$limit": 5, "$match": {"c_mktsegment": "BUILDING"}}], f"SELECT c_name, c_custkey AS _id FROM (SELECT * FROM customer WHERE {_building} ORDER BY c_custkey LIMIT 5) ORDER BY c_custkey LIMIT 1000 OFFSET 2")
add_pipeline("agg_multi_key_count_wins", "nation", [{"$project": {"n_name": 1}, "$count": "n", "$limit": 9}], "SELECT least(count(*), 9) AS n FROM nation")
add_pipeline("agg_unknown_stage_ignored", "nation", [{"$sort": {"n_name": 1}}, "x", {"$match": {"n_regionkey": 1}}], sql("nation", "n_regionkey = 1"))
add_pipeline("agg_full_pipeline", "orders", [{"$match": {"o_orderstatus": "F"}}, {"$skip": 10}, {"$limit": 40}, {"$project": {"o_custkey": 1, "o_orderpriority": 1}}], "SELECT o_custkey, o_orderpriority, o_orderkey AS _id FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 40 OFFSET 10)")


# writes
def add_update(name: str, source: str, filter_doc: Any, change: Any, where: str, replaced: dict[str, str], many: bool = True) -> None:
    key = COLUMNS[source][0]
    first = f"{key} = (SELECT min({key}) FROM {source} WHERE {where})"
    case = {c: f"CASE WHEN {where if many else first} THEN {new} ELSE {old} END" for c, (new, old) in ((c, v if isinstance(v, tuple) else (v, c)) for c, v in replaced.items())}
    add(name, lambda spark, d: writes.update(collection(spark, d, source), filter_doc, change, many).after, sql(source, "", case))


add_update("update_set_many", "customer", {"c_mktsegment": "BUILDING"}, {"$set": {"c_name": "x", "c_nationkey": 7}}, _building, {"c_name": "'x'", "c_nationkey": "7"})
add_update("update_set_one", "customer", {"c_mktsegment": "BUILDING"}, {"$set": {"c_acctbal": 1.5}}, _building, {"c_acctbal": "1.5"}, many=False)
add_update("update_set_null", "nation", {"n_regionkey": 2}, {"$set": {"n_name": None}}, "n_regionkey = 2", {"n_name": "NULL"})
add_update("update_inc", "customer", {"c_nationkey": 3}, {"$inc": {"c_acctbal": 10}}, "c_nationkey = 3", {"c_acctbal": "c_acctbal + 10.0"})
add_update("update_inc_int_becomes_double", "part", {"p_size": 15}, {"$inc": {"p_size": 1}}, "p_size = 15", {"p_size": ("CAST(p_size AS DOUBLE) + 1.0", "CAST(p_size AS DOUBLE)")})
add_update("update_inc_text_operand_ignored", "nation", {}, {"$inc": {"n_regionkey": "1"}}, "TRUE", {})
add_update("update_multi_ops", "supplier", {"s_nationkey": 5}, {"$inc": {"s_acctbal": 2.5}, "$set": {"s_name": "s", "s_acctbal": 1.0}, "other": 1}, "s_nationkey = 5", {"s_name": "'s'", "s_acctbal": "1.0 + 2.5"})
add_update("update_no_match", "nation", {"n_name": "?"}, {"$set": {"n_name": "x"}}, "FALSE", {})
add_update("update_not_an_object", "nation", {}, 5, "TRUE", {})


def present(frame: DataFrame) -> DataFrame:
    """Rows as JSON documents, so that a missing field shows as left out."""
    return frame.select(quoted(ID), json_document(frame.schema).alias("document"))


def json_sql(name: str, fields: dict[str, str], source: str | None = None) -> str:
    """A DuckDB expression for the JSON text of a row; a field whose expression is NULL is left out."""
    parts = ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '\"{c}\":' || CAST({v} AS VARCHAR) END" for c, v in fields.items())
    return f"SELECT {COLUMNS[name][0]} AS _id, '{{' || concat_ws(',', {parts}) || '}}' AS document FROM {source or name}"


_q = lambda c: f"to_json({c})"
_nation = {"_id": "n_nationkey", "n_name": _q("n_name"), "n_regionkey": "n_regionkey"}
add("update_unset", lambda spark, d: present(updated(n := collection(spark, d, "nation"), predicate(n.schema, {"n_regionkey": 1}), {"$unset": {"n_name": ""}})), json_sql("nation", _nation | {"n_name": f"CASE WHEN n_regionkey <> 1 THEN {_q('n_name')} END"}))
add("update_replace", lambda spark, d: present(updated(n := collection(spark, d, "nation"), predicate(n.schema, {"n_regionkey": 1}), {"n_name": "r", "_id": 99})), json_sql("nation", _nation | {"n_name": f"CASE WHEN n_regionkey = 1 THEN '\"r\"' ELSE {_q('n_name')} END", "n_regionkey": "CASE WHEN n_regionkey <> 1 THEN n_regionkey END"}))
add("update_inc_missing", lambda spark, d: present(updated(m := updated(n := collection(spark, d, "nation"), predicate(n.schema, {"n_regionkey": 1}), {"$unset": {"n_regionkey": 1}}), predicate(m.schema, {}), {"$inc": {"n_regionkey": 2}})), json_sql("nation", _nation | {"n_regionkey": "CASE WHEN n_regionkey = 1 THEN 2.0 ELSE n_regionkey + 2.0 END"}))
add("update_set_other_kind", lambda spark, d: present(updated(n := collection(spark, d, "nation"), predicate(n.schema, {"n_regionkey": 1}), {"$set": {"n_regionkey": "one"}})), json_sql("nation", _nation | {"n_regionkey": "CASE WHEN n_regionkey = 1 THEN '\"one\"' ELSE CAST(n_regionkey AS VARCHAR) END"}))
add("find_after_unset_null_is_not_missing", lambda spark, d: reads.count(updated(n := collection(spark, d, "nation"), predicate(n.schema, {"n_regionkey": 1}), {"$unset": {"n_name": ""}}), {"n_name": None}), "SELECT CAST(0 AS BIGINT) AS n")
add("distinct_after_unset_skips_missing", lambda spark, d: reads.distinct(updated(n := collection(spark, d, "nation"), predicate(n.schema, {"n_regionkey": 1}), {"$unset": {"n_name": ""}}), "n_name"), "SELECT DISTINCT n_name AS value FROM nation WHERE n_regionkey <> 1")
add("update_push_array", lambda spark, d: pushed(spark, d, {"$push": {"tags": "c"}}), "SELECT n_nationkey AS _id, CASE WHEN n_regionkey = 1 THEN 'a,b,a,c' ELSE 'a,b,a' END AS tags FROM nation")
add("update_pull_array", lambda spark, d: pushed(spark, d, {"$pull": {"tags": "a"}}), "SELECT n_nationkey AS _id, CASE WHEN n_regionkey = 1 THEN 'b' ELSE 'a,b,a' END AS tags FROM nation")


def pushed(spark: SparkSession, d: str, change: dict) -> DataFrame:
    """Array operators on an array column, which a DataFrame can hold though stored documents can't."""
    frame = collection(spark, d, "nation").withColumn("tags", F.array(F.lit("a"), F.lit("b"), F.lit("a")))
    return updated(frame, predicate(frame.schema, {"n_regionkey": 1}), change).select(ID, F.array_join("tags", ",").alias("tags"))


add("delete_many", lambda spark, d: writes.delete(collection(spark, d, "customer"), {"c_mktsegment": "BUILDING"}).after, sql("customer", "c_mktsegment <> 'BUILDING'"))
add("delete_one", lambda spark, d: writes.delete(collection(spark, d, "customer"), {"c_mktsegment": "BUILDING"}, many=False).after, sql("customer", f"c_custkey <> (SELECT min(c_custkey) FROM customer WHERE {_building})"))
add("delete_none", lambda spark, d: writes.delete(collection(spark, d, "customer"), {"c_mktsegment": "?"}).after, sql("customer"))
add("delete_all", lambda spark, d: writes.delete(collection(spark, d, "customer"), {}).after, sql("customer", "FALSE"))
add("delete_by_id_range", lambda spark, d: writes.delete(collection(spark, d, "orders"), {"_id": {"$gt": 1000}}).after, sql("orders", "o_orderkey <= 1000"))


def shifted(spark: SparkSession, d: str, by: int) -> DataFrame:
    nation = collection(spark, d, "nation")
    return nation.withColumn(ID, (F.col(ID) + by).cast(nation.schema[ID].dataType))


add("insert_rows", lambda spark, d: writes.insert_rows(collection(spark, d, "nation"), shifted(spark, d, 100)).after, f"{sql('nation')} UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
add("insert_duplicate_rejected", lambda spark, d: writes.insert_rows(collection(spark, d, "nation"), shifted(spark, d, 0)).after, sql("nation"))
add("insert_partly_duplicate", lambda spark, d: writes.insert_rows(collection(spark, d, "nation"), shifted(spark, d, 20)).after, f"{sql('nation')} UNION ALL SELECT n_nationkey + 20, n_name, n_regionkey FROM nation WHERE n_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
add("upsert_images", lambda spark, d: writes.upsert_images(collection(spark, d, "nation"), shifted(spark, d, 20)), "SELECT n_nationkey AS _id, n_name, n_regionkey FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey + 20, n_name, n_regionkey FROM nation")
add("remove_keys", lambda spark, d: writes.remove_keys(collection(spark, d, "nation"), shifted(spark, d, 20)), sql("nation", "n_nationkey < 20"))


# catalog
def catalog(spark: SparkSession) -> Commands:
    """Commands on a fresh engine that declares the tables as collections of two databases, with two indexes."""
    engine = Engine(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")
    with (session := engine.session()).transaction():
        for name, columns in COLUMNS.items():
            session.create_collection(Namespace("corpus" if name == "documents" else "tpch", name), columns[1:])
        session.create_index(Namespace("tpch", "customer"), {"key": {"c_mktsegment": 1}})
        session.create_index(Namespace("tpch", "customer"), {"key": {"c_name": 1}, "name": "by_name"})
    return Commands(engine)


def replied(spark: SparkSession, documents: list[dict], names: list[str]) -> DataFrame:
    """Reply documents as rows; nested ones as JSON text."""
    text = lambda v: json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v)
    return spark.createDataFrame([tuple(text(x[n]) for n in names) for x in documents], ", ".join(f"{n} string" for n in names))


def values(names: str, rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows) + f") t({names})"


add("list_databases", lambda spark, d: replied(spark, catalog(spark).run({"listDatabases": 1}, "admin")["databases"], ["name"]), values("name", [("corpus",), ("local",), ("tpch",)]))
add("list_collections", lambda spark, d: replied(spark, catalog(spark).run({"listCollections": 1}, "tpch")["cursor"]["firstBatch"], ["name", "type", "idIndex"]), values("name, type, \"idIndex\"", [(n, "collection", '{"v":2,"key":{"_id":1},"name":"_id_"}') for n in COLUMNS if n != "documents"]))
add("list_indexes", lambda spark, d: replied(spark, catalog(spark).run({"listIndexes": "customer"}, "tpch")["cursor"]["firstBatch"], ["name", "key", "ns"]), values("name, key, ns", [("_id_", '{"_id":1}', "tpch.customer"), ("by_name", '{"c_name":1}', "tpch.customer"), ("c_mktsegment_1", '{"c_mktsegment":1}', "tpch.customer")]))


def stored(spark: SparkSession, d: str, change: Callable[[Any, Namespace], Any]) -> DataFrame:
    """The nations after a change through an engine's own store, as JSON documents."""
    session, namespace = catalog(spark).engine.session(), Namespace("tpch", "nation")
    session.insert_frame(namespace, collection(spark, d, "nation"))
    change(session, namespace)
    return present(session.frame(namespace)).select(F.col("_id.n").alias("_id"), "document")


_stored = {"_id": "n_nationkey", "n_name": _q("n_name"), "n_regionkey": "n_regionkey"}
add("stored_insert", lambda spark, d: stored(spark, d, lambda s, n: None), json_sql("nation", _stored))
add("stored_update_inc", lambda spark, d: stored(spark, d, lambda s, n: s.update(n, {"n_regionkey": 1}, {"$inc": {"n_regionkey": 1}}, many=True)), json_sql("nation", _stored | {"n_regionkey": "CASE WHEN n_regionkey = 1 THEN '2.0' ELSE CAST(n_regionkey AS VARCHAR) END"}))
add("stored_delete_one", lambda spark, d: stored(spark, d, lambda s, n: s.delete(n, {"n_regionkey": 1}, many=False)), json_sql("nation", _stored, "(SELECT * FROM nation WHERE n_nationkey <> (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1))"))
add("stored_transaction_dropped", lambda spark, d: stored(spark, d, dropped), json_sql("nation", _stored))


def dropped(session: Any, namespace: Namespace) -> None:
    """A transaction that fails leaves no trace."""
    try:
        with session.transaction():
            session.delete(namespace, {})
            raise StorageError("given up")
    except StorageError:
        pass


def followed(spark: SparkSession, d: str) -> DataFrame:
    """A second engine that applied the first one's change log, twice."""
    source = catalog(spark).engine
    session, namespace = source.session(), Namespace("tpch", "nation")
    session.insert_frame(namespace, collection(spark, d, "nation"))
    session.update(namespace, {"n_regionkey": 1}, {"$set": {"n_name": "x"}}, many=True)
    session.delete(namespace, {"n_regionkey": 2})
    target = Engine(spark, f"{source.store.path}-follower", EngineConfig(replication=ReplicationConfig(Role.SECONDARY, "b", None, source.store.path)))
    follower = Follower(source, target)
    follower.catch_up()
    follower.catch_up()
    return present(target.session().frame(namespace)).select(F.col("_id.n").alias("_id"), "document")


add("follower_state", followed, json_sql("nation", _stored | {"n_name": "CASE WHEN n_regionkey = 1 THEN '\"x\"' ELSE to_json(n_name) END"}, "(SELECT * FROM nation WHERE n_regionkey <> 2)"))


# change log
def log_of(spark: SparkSession, d: str) -> DataFrame:
    """The log of one collection's life: all nations inserted, region 1 renamed, region 2 deleted."""
    nation = collection(spark, d, "nation")
    first = changelog.entries(nation, "i", "tpch.nation", 1)
    n, renamed = nation.count(), writes.update(nation, {"n_regionkey": 1}, {"$set": {"n_name": "x"}})
    second = changelog.entries(renamed.changed, "u", "tpch.nation", n + 1)
    third = changelog.entries(writes.delete(renamed.after, {"n_regionkey": 2}).changed, "d", "tpch.nation", n + 1 + renamed.changed.count())
    return first.unionByName(second).unionByName(third)


_doc = "'{\"_id\":' || n_nationkey || ',\"n_name\":' || {name} || ',\"n_regionkey\":' || n_regionkey || '}'"
_key = "'{\"_id\":' || n_nationkey || '}'"
_insert = f"SELECT row_number() OVER (ORDER BY n_nationkey) AS _id, CAST(1 AS BIGINT) AS term, 'i' AS op, 'tpch.nation' AS ns, {_doc.replace('{name}', 'to_json(n_name)')} AS o, CAST(NULL AS VARCHAR) AS o2 FROM nation"
_update = f"SELECT (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY n_nationkey), 1, 'u', 'tpch.nation', {_doc.replace('{name}', chr(39) + chr(34) + 'x' + chr(34) + chr(39))}, {_key} FROM nation WHERE n_regionkey = 1"
_delete = f"SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM nation WHERE n_regionkey = 1) + row_number() OVER (ORDER BY n_nationkey), 1, 'd', 'tpch.nation', {_key}, NULL FROM nation WHERE n_regionkey = 2"
_log = f"({_insert} UNION ALL {_update} UNION ALL {_delete})"
_state = "SELECT n_nationkey AS _id, CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2"
add("oplog_insert", lambda spark, d: changelog.entries(collection(spark, d, "nation"), "i", "tpch.nation", 1), _insert)
add("oplog_update_many", lambda spark, d: log_of(spark, d).filter("op = 'u'"), f"SELECT * FROM {_log} WHERE op = 'u'")
add("oplog_delete_many", lambda spark, d: log_of(spark, d).filter("op = 'd'"), f"SELECT * FROM {_log} WHERE op = 'd'")
add("oplog_after", lambda spark, d: changelog.after(log_of(spark, d), 20, 8), f"SELECT * FROM {_log} WHERE _id > 20 ORDER BY _id LIMIT 8")
add("oplog_counts_by_op", lambda spark, d: log_of(spark, d).groupBy("op").agg(F.count("*").alias("n")), f"SELECT op, count(*) AS n FROM {_log} GROUP BY op")
add("oplog_insert_orders", lambda spark, d: changelog.entries(collection(spark, d, "orders").select(ID, "o_custkey"), "i", "tpch.orders", 1).select(ID, "o"), "SELECT row_number() OVER (ORDER BY o_orderkey) AS _id, '{\"_id\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || '}' AS o FROM orders")
add("oplog_apply_equals_table", lambda spark, d: changelog.replayed(collection(spark, d, "nation").limit(0), log_of(spark, d), "tpch.nation"), _state)
add("oplog_apply_twice", lambda spark, d: changelog.replayed(changelog.replayed(collection(spark, d, "nation").limit(0), log_of(spark, d), "tpch.nation"), log_of(spark, d), "tpch.nation"), _state)


def streamed(spark: SparkSession, d: str) -> DataFrame:
    """The log written in three steps, tailed as a stream after each, its images kept as the follower's state."""
    root = f"{shared_folder(spark)}/changes-{uuid.uuid4().hex}"
    folder, log, state = Folder(spark, root), log_of(spark, d), {}
    folder.make("log")
    base = collection(spark, d, "nation").limit(0)

    def apply(batch: DataFrame, number: int) -> None:
        held = spark.read.parquet(state["path"]) if state else base
        path = f"{root}/state-{uuid.uuid4().hex}"
        changelog.replayed(held, batch, "tpch.nation").write.parquet(path)
        state["path"] = path

    for op in ("i", "u", "d"):
        log.filter(F.col("op") == op).write.mode("append").parquet(f"{root}/log")
        changelog.tail(spark, f"{root}/log", f"{root}/progress", apply).awaitTermination()
    return spark.read.parquet(state["path"])


add("oplog_stream_apply", streamed, _state)

# raw key ranges
_kv = lambda spark, d: collection(spark, d, "customer").select(F.encode("c_name", "utf-8").alias("key"), F.encode("c_mktsegment", "utf-8").alias("value"))
_text = lambda f: f.select(F.decode("key", "utf-8").alias("key"), F.decode("value", "utf-8").alias("value"))
add("kv_range_scan", lambda spark, d: _text(kv.key_range(_kv(spark, d), b"Customer#000000100", b"Customer#000000200")), "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000200'")
add("kv_range_scan_open", lambda spark, d: _text(kv.key_range(_kv(spark, d), b"Customer#000000100")), "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_name >= 'Customer#000000100'")
add("lineitem_rows", lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").filter(F.col("l_returnflag") == "R"), "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
add("conversation_by_id", lambda spark, d: reads.find(table(spark, d, "conversations"), {"_id": "3-0"}), "SELECT conv_id || '-' || turn AS _id, conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 0")
