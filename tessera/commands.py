"""Command documents in, reply documents out: the in-process form of the server's command surface."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from . import __version__
from .config import Role
from .engine import Engine, parse_namespace
from .errors import DocumentValidationError, EngineError, NotLeaderError, ProtocolError
from .functions.keys import ObjectId, from_wire, object_id, to_wire
from .model import ID, OPLOG, Namespace, database_name, read_row
from .operators import reads
from .operators.cursors import CursorManager, FindCursor, MaterializedCursor, batch_size
from .plans.pipeline import aggregate, whole_number

OK = {"ok": 1.0}
#: Milliseconds that a tailing cursor waits when it isn't told.
DEFAULT_WAIT_MS = 1000


def cursor_id(value: Any) -> int | None:
    n = whole_number(value)
    return n if n is not None and n >= 0 else None


class Commands:
    """Runs commands against one engine."""

    def __init__(self, engine: Engine) -> None:
        self.engine, self.cursors = engine, CursorManager()
        self._handlers: dict[str, Callable[[str, dict], dict]] = {
            "hello": self._hello, "ismaster": self._hello, "ping": lambda db, c: dict(OK), "buildinfo": self._build_info,
            "serverstatus": self._server_status, "connectionstatus": self._connection_status, "listdatabases": self._list_databases,
            "listcollections": self._list_collections, "createcollection": self._create, "create": self._create, "dbstats": self._db_stats,
            "collstats": self._coll_stats, "insert": self._insert, "find": self._find, "update": self._update, "delete": self._delete,
            "listindexes": self._list_indexes, "createindexes": self._create_indexes, "getmore": self._get_more, "killcursors": self._kill_cursors,
            "count": self._count, "distinct": self._distinct, "aggregate": self._aggregate, "replsetupdateposition": self._update_position,
        }

    def run(self, command: dict, database: str | None = None) -> dict:
        """The reply; a failure is a reply too. The first key that names a command decides, whatever its case."""
        try:
            db = database if database is not None else command.get("$db")
            if not isinstance(db, str):
                raise ProtocolError("command document is missing $db")
            database_name(db)
            for key in command:
                if key.lower() in self._handlers:
                    return to_wire(self._handlers[key.lower()](db, command))
            return {"ok": 0.0, "errmsg": "Command not found"}
        except NotLeaderError as e:
            reply = {"ok": 0.0, "errmsg": str(e), "code": 10107, "codeName": "NotWritablePrimary"}
            return reply | ({"primary": e.leader_hint} if e.leader_hint else {})
        except EngineError as e:
            return {"ok": 0.0, "errmsg": str(e), "code": 8000, "codeName": type(e).__name__}

    def legacy_query(self, collection: str, query: dict) -> dict:
        """A query message: a command if sent to `db.$cmd`, else a find whose filter is the whole document, all in one batch."""
        database, _, name = collection.partition(".")
        if name == "$cmd":
            return self.run(query, database)
        try:
            frame = self.engine.session().find(Namespace.parse(collection), from_wire(query))
            return OK | {"cursor": {"id": 0, "ns": collection, "firstBatch": self._documents(frame)}}
        except EngineError as e:
            return {"ok": 0.0, "errmsg": str(e), "code": 8000, "codeName": type(e).__name__}

    @staticmethod
    def _name(database: str, command: dict, field: str) -> Namespace:
        value = next((v for k, v in command.items() if k.lower() == field.lower()), None)
        return parse_namespace(database, value)

    @staticmethod
    def _document(command: dict, field: str) -> dict | None:
        value = command.get(field)
        return from_wire(value) if isinstance(value, dict) else None

    @staticmethod
    def _documents(frame: DataFrame) -> list[dict]:
        """All documents, as the client asked for them, in _id order."""
        ordered = frame.orderBy(ID) if ID in frame.columns else frame
        return [to_wire(read_row(r, frame.schema)) for r in ordered.collect()]

    def _first_batch(self, namespace: str, documents: list[dict], size: int) -> dict:
        cursor = MaterializedCursor(namespace, documents, size)
        found, more = cursor.next_page()
        return OK | {"cursor": {"id": self.cursors.create(cursor) if more else 0, "ns": namespace, "firstBatch": found.documents}}

    @staticmethod
    def _size(command: dict) -> int:
        nested = command.get("cursor")
        return batch_size(nested.get("batchSize")) if isinstance(nested, dict) and "batchSize" in nested else batch_size(command.get("batchSize"))

    # connection

    def _hello(self, database: str, command: dict) -> dict:
        replication = self.engine.config.replication
        writable = replication.role is Role.PRIMARY
        reply = OK | {
            "isMaster": writable, "isWritablePrimary": writable, "helloOk": True, "maxBsonObjectSize": 16 * 2**20, "maxMessageSizeBytes": 48_000_000, "maxWriteBatchSize": 100_000,
            "localTime": datetime.datetime.now(datetime.timezone.utc).isoformat(), "minWireVersion": 0, "maxWireVersion": 13, "readOnly": not writable, "logicalSessionTimeoutMinutes": 30, "connectionId": 1, "compression": [],
        }
        return reply | ({"primary": replication.primary_hint} if replication.primary_hint else {})

    def _build_info(self, database: str, command: dict) -> dict:
        return OK | {"version": __version__, "versionArray": [int(x) for x in __version__.split(".")], "gitVersion": "unknown", "modules": [], "sysInfo": "spark " + self.engine.spark.version, "javascriptEngine": "none", "openssl": {}, "buildEnvironment": {}, "bits": 64, "debug": False}

    def _server_status(self, database: str, command: dict) -> dict:
        return OK | {"host": "localhost", "version": __version__, "process": "tessera", "pid": 1, "uptime": 0.0, "connections": {"current": 1, "available": 1000}}

    def _connection_status(self, database: str, command: dict) -> dict:
        return OK | {"authInfo": {"authenticatedUsers": [], "authenticatedUserRoles": []}}

    # catalog

    def _list_databases(self, database: str, command: dict) -> dict:
        if database != "admin":
            raise ProtocolError("listDatabases must run against the admin database")
        return OK | {"databases": [{"name": n, "sizeOnDisk": 0, "empty": False} for n in self.engine.session().databases()], "totalSize": 0, "totalSizeMb": 0}

    def _list_collections(self, database: str, command: dict) -> dict:
        session = self.engine.session()
        listed = []
        for name in session.collections(database):
            held = session.known(Namespace(database, name))
            listed.append({"name": name, "type": "collection", "options": held["options"], "info": {"readOnly": False, "uuid": held["uuid"]}, "idIndex": {"v": 2, "key": {ID: 1}, "name": "_id_"}})
        return self._first_batch(f"{database}.$cmd.listCollections", listed, self._size(command))

    def _create(self, database: str, command: dict) -> dict:
        name = next((v for k, v in command.items() if k.lower() in ("createcollection", "create")), None)
        if not isinstance(name, str):
            raise DocumentValidationError("createCollection requires a collection name")
        columns = command.get("storageColumns")
        if not isinstance(columns, list) or not all(isinstance(c, str) for c in columns):
            raise DocumentValidationError("createCollection requires storageColumns, an array of strings")
        self.engine.session().create_collection(Namespace(database, name), columns)
        return dict(OK)

    def _list_indexes(self, database: str, command: dict) -> dict:
        namespace = self._name(database, command, "listIndexes")
        held = self.engine.session().indexes(namespace)
        listed = [{"v": 2, "key": {f: 1}, "name": n, "ns": namespace.full_name} for n, f in [("_id_", ID), *held.items()]]
        return self._first_batch(namespace.full_name, listed, self._size(command))

    def _create_indexes(self, database: str, command: dict) -> dict:
        namespace = self._name(database, command, "createIndexes")
        specs = [s for s in command.get("indexes") or [] if isinstance(s, dict)]
        for spec in specs:
            self.engine.session().create_index(namespace, spec)
        total = len(self.engine.session().indexes(namespace)) + 1
        return OK | {"numIndexesBefore": total - len(specs), "numIndexesAfter": total, "createdCollectionAutomatically": False}

    def _db_stats(self, database: str, command: dict) -> dict:
        session = self.engine.session()
        names = [Namespace(database, c) for c in session.collections(database)]
        frames = {n.full_name: session.frame(n) for n in names}
        row = reads.database_stats(frames, database, sum(len(session.indexes(n)) for n in names), self.engine.spark).first()
        return OK | row.asDict()

    def _coll_stats(self, database: str, command: dict) -> dict:
        namespace, session = self._name(database, command, "collStats"), self.engine.session()
        return OK | reads.collection_stats(session.frame(namespace), namespace.full_name, len(session.indexes(namespace))).first().asDict()

    # documents

    def _insert(self, database: str, command: dict) -> dict:
        """Reports the identifiers as stored."""
        namespace = self._name(database, command, "insert")
        documents = [from_wire({ID: ObjectId(object_id())} | d if ID not in d else d) for d in command.get("documents") or [] if isinstance(d, dict)]
        done = self.engine.session().insert_many(namespace, documents) if documents else []
        return OK | {"n": len(done), "insertedIds": {str(i): d[ID] for i, d in enumerate(done)}}

    def _update(self, database: str, command: dict) -> dict:
        namespace, n = self._name(database, command, "update"), 0
        for u in command.get("updates") or []:
            if isinstance(u, dict):
                n += self.engine.session().update(namespace, self._document(u, "q"), self._document(u, "u"), u.get("multi") is True)
        return OK | {"n": n, "nModified": n}

    def _delete(self, database: str, command: dict) -> dict:
        namespace, n = self._name(database, command, "delete"), 0
        for d in command.get("deletes") or []:
            if isinstance(d, dict):
                n += self.engine.session().delete(namespace, self._document(d, "q"), whole_number(d.get("limit")) != 1)
        return OK | {"n": n}

    def _find(self, database: str, command: dict) -> dict:
        """Reads filter, skip, limit, batchSize, singleBatch, tailable and awaitData; a sort or projection is not looked at."""
        namespace = self._name(database, command, "find")
        tailable, await_data = command.get("tailable") is True, command.get("awaitData") is True
        if await_data and not tailable:
            raise ProtocolError("awaitData requires tailable=true")
        if tailable and namespace != OPLOG:
            raise ProtocolError("tailable and awaitData are only supported on local.oplog.rs")
        limit = reads.at_least_zero(command.get("limit"))
        cursor = FindCursor(namespace.full_name, lambda: self.engine.session().frame(namespace), self._document(command, "filter"), self._size(command), limit or None, None, tailable, await_data, command.get("singleBatch") is True)
        found, open_ = cursor.next_page(skip=reads.at_least_zero(command.get("skip")))
        return OK | {"cursor": {"id": self.cursors.create(cursor) if open_ else 0, "ns": namespace.full_name, "firstBatch": found.documents}}

    def _get_more(self, database: str, command: dict) -> dict:
        number = cursor_id(next(v for k, v in command.items() if k.lower() == "getmore"))
        if not number:
            namespace = self._name(database, command, "collection")
            return OK | {"cursor": {"id": 0, "ns": namespace.full_name, "nextBatch": []}}
        cursor = self.cursors.take(number)
        size = batch_size(command["batchSize"]) if "batchSize" in command else None
        if isinstance(cursor, FindCursor) and cursor.await_data:
            self._await_log(cursor, command.get("maxTimeMS"))
        found, open_ = cursor.next_page(size)
        if open_:
            self.cursors.restore(number, cursor)
        return OK | {"cursor": {"id": number if open_ else 0, "ns": cursor.namespace, "nextBatch": found.documents}}

    def _await_log(self, cursor: FindCursor, wait_ms: Any) -> None:
        """Waits until the change log has gone beyond the cursor, or the time is over."""
        wait = whole_number(wait_ms)
        end = time.monotonic() + (DEFAULT_WAIT_MS if wait is None or wait < 0 else wait) / 1000
        while self.engine.store.manifest().last_index <= (cursor.bookmark or 0) and time.monotonic() < end:
            time.sleep(0.02)

    def _kill_cursors(self, database: str, command: dict) -> dict:
        reply = OK | {"cursorsKilled": [], "cursorsNotFound": [], "cursorsAlive": [], "cursorsUnknown": []}
        for given in command.get("cursors") or []:
            number = cursor_id(given)
            if number is None:
                reply["cursorsUnknown"].append(given)
            else:
                reply["cursorsKilled" if number and self.cursors.kill(number) else "cursorsNotFound"].append(number)
        return reply

    def _count(self, database: str, command: dict) -> dict:
        return OK | {"n": self.engine.session().count(self._name(database, command, "count"), self._document(command, "query"))}

    def _distinct(self, database: str, command: dict) -> dict:
        key = command.get("key") if isinstance(command.get("key"), str) else ID
        collection = self.engine.session().frame(self._name(database, command, "distinct"))
        frame = reads.distinct_in_order(collection, key, self._document(command, "query"))
        return OK | {"values": [to_wire(read_row(r, frame.schema)["value"]) for r in frame.collect()]}

    def _aggregate(self, database: str, command: dict) -> dict:
        namespace = self._name(database, command, "aggregate")
        stages = [from_wire(s) for s in command.get("pipeline") or []]
        frame = aggregate(self.engine.session().frame(namespace).orderBy(ID), stages)  # stages keep the order
        return self._first_batch(namespace.full_name, [to_wire(read_row(r, frame.schema)) for r in frame.collect()], self._size(command))

    # replication

    def _update_position(self, database: str, command: dict) -> dict:
        if not isinstance(command.get("member"), str):
            raise ProtocolError("replSetUpdatePosition requires member")
        self.engine.follower_progress(command["member"], self._optime(command.get("lastWritten")), self._optime(command.get("lastApplied")))
        return dict(OK)

    @staticmethod
    def _optime(value: Any) -> tuple[int, int] | None:
        if value is None:
            return None
        if not isinstance(value, dict):
            raise ProtocolError("replSetUpdatePosition optime must be a document")
        parts = [whole_number(value.get(k)) for k in ("term", "index")]
        for name, n in zip(("term", "index"), parts):
            if n is None or n < 0:
                raise ProtocolError(f"replSetUpdatePosition optime is missing {name}")
        return parts[0], parts[1]
