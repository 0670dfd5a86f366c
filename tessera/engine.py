"""The engine: sessions and transactions over a snapshot store, with a catalog and a change log.

All writes of a transaction are staged as DataFrames and become visible together when its manifest is published. The change
log's rows are part of the same commit.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig, Role
from .errors import DocumentValidationError, EngineError, NotLeaderError, ProtocolError, StorageError, TransactionStateError
from .functions.cells import quoted
from .functions.keys import with_id
from .model import ID, OPLOG, RESERVED, Namespace, storage_columns
from .operators import kv, reads, writes
from .plans.pipeline import aggregate
from .sources.store import GONE, IMAGES, LOG, ROWS, Manifest, SnapshotStore
from .streaming import changelog

#: The changes of a collection of more segments are folded by the next write; the rows that it began with stay, unless the changes are more.
MAX_SEGMENTS = 16


class Engine:
    """A store opened for reading and, on a primary, writing."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None) -> None:
        self.spark, self.config = spark, config or EngineConfig()
        self.store = SnapshotStore(spark, path)
        self.followers: dict[str, dict] = {}
        self.store.settle_log(self.store.manifest())
        report = self.store.audit()
        if report["missing"]:
            raise StorageError(f"snapshots are missing: {report['missing']}")
        self.orphans = report["orphans"]

    def session(self, version: int | None = None) -> Session:
        """A session on the newest state, or pinned to an older version, which can only be read."""
        return Session(self, version)

    @property
    def log_path(self) -> str:
        return f"{self.store.path}/{LOG}"

    def checkpoint(self, keep: int = 1) -> list[str]:
        """Writes each collection of several segments as one, then drops what older versions alone hold; returns the folders dropped."""
        with self.session().transaction() as txn:
            for name, held in txn.new.collections.items():
                if len(held["segments"]) > 1:
                    txn.compact(name)
        return self.store.vacuum(keep)

    def frame_of(self, manifest: Manifest, name: str) -> DataFrame | None:
        """A collection or raw object as a state holds it; None if the state doesn't know it."""
        held = manifest.collections.get(name)
        if held is None:
            return None
        raw = held["kind"] == "raw"
        empty = self.spark.createDataFrame([], kv.SCHEMA) if raw else reads.empty(self.spark, held["columns"])
        counted = held.get("counted")
        return self.store.folded(held["segments"], empty, "key" if raw else ID, counted and counted.get(IMAGES, 0) + counted.get(GONE, 0))

    def require_primary(self) -> None:
        r = self.config.replication
        if r.role is not Role.PRIMARY:
            raise NotLeaderError(r.primary_hint)

    def follower_progress(self, member: str, written: tuple[int, int] | None, applied: tuple[int, int] | None) -> None:
        self.followers.setdefault(member, {}).update({k: v for k, v in (("written", written), ("applied", applied)) if v is not None})


class Transaction:
    """Staged changes on top of one manifest: segments written, not yet named by any published state."""

    def __init__(self, session: Session) -> None:
        self.engine, self.base = session.engine, session.engine.store.manifest()
        self.new: Manifest = self.base.copy()
        self.raw: dict[str, dict[bytes, bytes | None]] = {}
        self.log: list[DataFrame] = []
        self.next_index = self.base.last_index + 1
        self.open = True

    def frame(self, name: str) -> DataFrame | None:
        frame = self.engine.frame_of(self.new, name)
        return kv.merged(frame, self.raw[name]) if self.raw.get(name) else frame

    def add(self, name: str, kind: str, frame: DataFrame) -> None:
        path = self.engine.store.write(frame)
        self.attach(name, kind, path, self.engine.store.read(path).count())

    def attach(self, name: str, kind: str, path: str, n: int) -> None:
        """Adds a segment of n rows. Changes that outgrow the added rows are written as one segment with them, which costs a multiple of the changes
        at most and keeps what a read folds within twice the rows; the changes of many small segments are taken together, at their own cost.
        """
        held = self.new.collections[name]
        held["segments"].append([kind, path])
        counted = held.setdefault("counted", {})
        counted[kind] = counted.get(kind, 0) + n
        if counted.get(IMAGES, 0) + counted.get(GONE, 0) > counted.get(ROWS, 0):
            self.compact(name)
        elif len(held["segments"]) > MAX_SEGMENTS:
            first, *changes = held["segments"]
            held["segments"] = [first, *self.engine.store.folded_changes(changes, "key" if held["kind"] == "raw" else ID)]

    def compact(self, name: str) -> None:
        """Writes a collection as one segment."""
        store, held = self.engine.store, self.new.collections[name]
        path = store.write(self.engine.frame_of(self.new, name))
        held["segments"], held["counted"] = [[ROWS, path]], {ROWS: store.read(path).count()}

    def record(self, change: writes.Change, namespace: Namespace) -> int:
        """Stages a statement's changed documents, in files by ranges of _id, and its log rows; returns how many documents changed."""
        store, held = self.engine.store, self.new.collections[namespace.full_name]
        counted = held.get("counted", {})
        whole = change.flagged is not None and 2 * (counted.get(IMAGES, 0) + counted.get(GONE, 0)) > counted.get(ROWS, 0)
        if whole:  # so many changes were there before that all rows are written, at twice their cost at most
            parts = store.write_parts(self.in_order(writes.as_tagged(change.flagged), writes.CHANGED, ID), writes.CHANGED)
            path, rest = parts.get(True), parts.get(False)
        else:
            path, rest = store.write(self.in_order(writes.as_tagged(change.changed), ID)), None
        n = store.read(path).count() if path else 0
        if not n:
            for name in filter(None, (path, rest)):
                store.folder.delete(name)
            return 0
        self.log.append(changelog.entries(store.read(path), change.op, namespace.full_name, self.next_index, self.new.term, ranged=True))
        self.next_index += n
        if whole:
            kept = [name for name in (path if change.op == "u" else None, rest) if name]
            held["segments"], held["counted"] = [[ROWS, name] for name in kept], {ROWS: sum(store.read(name).count() for name in kept)}
        else:
            self.attach(namespace.full_name, {"i": ROWS, "u": IMAGES, "d": GONE}[change.op], path, n)
        return n

    @staticmethod
    def in_order(frame: DataFrame, *names: str) -> DataFrame:
        """Partitions that are ranges, each in order."""
        return frame.repartitionByRange(*map(quoted, names)).sortWithinPartitions(*map(quoted, names))

    def define(self, op: str, namespace: Namespace, definition: dict) -> None:
        self.log.append(changelog.definition_entry(self.engine.spark, op, namespace.full_name, definition, self.next_index, self.new.term))
        self.next_index += 1

    def commit(self) -> Manifest:
        store, spark = self.engine.store, self.engine.spark
        for name, pending in self.raw.items():
            written, gone = kv.changes(spark, pending)
            if written is not None:
                self.add(name, IMAGES, written)
            if gone is not None:
                self.add(name, GONE, gone)
        if self.log:
            first, last, own = self.base.last_index + 1, self.next_index - 1, uuid.uuid4().hex
            rows = reduce(DataFrame.unionByName, self.log)
            rows.write.parquet(f"{store.path}/{store.staged_log(own)}")
            self.new.log = [n for n in self.base.log if not store.folder.exists(n)] + [f"{LOG}/{first:020d}-{last:020d}-{own}"]
            self.new.last_index = last
            published = store.commit(self.base, self.new)
            store.settle_log(published)  # seen by readers of the folder only now
            return published
        return store.commit(self.base, self.new) if self.new != self.base else self.base


class Session:
    """Reads see the open transaction, else the newest (or the pinned) state. A write outside a transaction is one by itself."""

    def __init__(self, engine: Engine, version: int | None = None) -> None:
        self.engine, self.spark, self.version = engine, engine.spark, version
        self._txn: Transaction | None = None

    # transactions

    @contextmanager
    def transaction(self) -> Iterator[Transaction]:
        if self.version is not None:
            raise TransactionStateError("a pinned session only reads")
        if self._txn is not None:
            raise TransactionStateError("a transaction is open already")
        self._txn = Transaction(self)
        try:
            yield self._txn
            self._txn.commit()
        finally:
            self._txn.open = False
            self._txn = None

    def with_transaction(self, f: Callable[[Session], Any]) -> Any:
        """f(session): committed if it returns, dropped if it raises."""
        with self.transaction():
            return f(self)

    @contextmanager
    def _writing(self) -> Iterator[Transaction]:
        if self._txn is not None:
            yield self._txn
        else:
            with self.transaction() as txn:
                yield txn

    def manifest(self) -> Manifest:
        return self._txn.new if self._txn else self.engine.store.manifest(self.version)

    # catalog

    def definition(self, namespace: Namespace) -> dict | None:
        return self.manifest().collections.get(namespace.full_name)

    def known(self, namespace: Namespace) -> dict:
        held = self.definition(namespace)
        if held is None:
            raise StorageError(f"unknown collection {namespace.full_name}")
        return held

    def create_collection(self, namespace: Namespace, columns: list[str], collection_uuid: str | None = None, logged: bool = True) -> None:
        if logged:
            self.engine.require_primary()
        if namespace in RESERVED:
            raise StorageError(f"namespace {namespace.full_name} is reserved")
        columns = storage_columns(columns)
        with self._writing() as txn:
            held = txn.new.collections.get(namespace.full_name)
            if held is not None:
                if collection_uuid and held["uuid"] == collection_uuid and held["columns"] == columns:
                    return
                raise StorageError(f"collection {namespace.full_name} exists already")
            own = collection_uuid or str(uuid.uuid4())
            txn.new.collections[namespace.full_name] = {"kind": "documents", "uuid": own, "columns": columns, "indexes": {}, "options": {"storageColumns": columns}, "segments": []}
            if logged:
                txn.define("c", namespace, {"storageColumns": columns, "collectionUuid": own})

    def create_index(self, namespace: Namespace, spec: dict, logged: bool = True) -> str:
        """A named single-field ascending index. Scans need none: it records the choice and shows in the catalog."""
        if logged:
            self.engine.require_primary()
        key = spec.get("key")
        if not isinstance(key, dict) or len(key) != 1:
            raise DocumentValidationError("an index has a key of exactly one field")
        [(field, direction)] = key.items()
        if isinstance(direction, bool) or direction != 1:
            raise DocumentValidationError("only ascending indexes are supported")
        name = spec.get("name") or f"{field}_1"
        with self._writing() as txn:
            held = txn.new.collections.get(namespace.full_name)
            if held is None:
                raise StorageError(f"unknown collection {namespace.full_name}")
            if field not in held["columns"]:
                raise DocumentValidationError(f"index field {field} is not a declared storage column")
            if name in held["indexes"]:
                if held["indexes"][name] != field:
                    raise StorageError(f"index {name} exists already with another key")
                return name
            held["indexes"][name] = field
            if logged:
                txn.define("ci", namespace, {"name": name, "indexedField": field})
        return name

    def databases(self) -> list[str]:
        return sorted({Namespace.parse(n).database for n, c in self.manifest().collections.items() if c["kind"] == "documents"} | {OPLOG.database})

    def collections(self, database: str) -> list[str]:
        named = [Namespace.parse(n) for n, c in self.manifest().collections.items() if c["kind"] == "documents"]
        return sorted(n.collection for n in named if n.database == database)

    def indexes(self, namespace: Namespace) -> dict[str, str]:
        held = self.definition(namespace)
        return dict(sorted(held["indexes"].items())) if held else {}

    # reads

    def frame(self, namespace: Namespace) -> DataFrame:
        """A collection's documents; empty if it is unknown. local.oplog.rs is the change log."""
        if namespace == OPLOG:
            return self.change_log()
        found = self._txn.frame(namespace.full_name) if self._txn is not None else self.engine.frame_of(self.manifest(), namespace.full_name)
        return reads.empty(self.spark) if found is None else found

    def change_log(self) -> DataFrame:
        folders = self.engine.store.log_folders(self.manifest().last_index)
        if not folders:
            return self.spark.createDataFrame([], changelog.SCHEMA)
        return self.spark.read.schema(changelog.SCHEMA).parquet(*[f"{self.engine.store.path}/{f}" for f in folders])

    def find(self, namespace: Namespace, filter_doc: Any = None, skip: int = 0, limit: int = 0) -> DataFrame:
        return reads.find(self.frame(namespace), filter_doc, skip, limit)

    def count(self, namespace: Namespace, filter_doc: Any = None) -> int:
        return reads.count(self.frame(namespace), filter_doc).first()["n"]

    def distinct(self, namespace: Namespace, key: str = ID, filter_doc: Any = None) -> DataFrame:
        return reads.distinct(self.frame(namespace), key, filter_doc)

    def aggregate(self, namespace: Namespace, stages: list) -> DataFrame:
        return aggregate(self.frame(namespace), stages)

    # writes

    def insert_many(self, namespace: Namespace, documents: list[dict]) -> list[dict]:
        """Inserts in order; at the first failure the ones before it stay and the failure is raised."""
        self.engine.require_primary()
        held = self.known(namespace)
        with self._writing() as txn:
            change, accepted, failure = writes.insert_documents(txn.frame(namespace.full_name), documents, held["columns"])
            if accepted:
                txn.record(change, namespace)
        if failure:
            raise failure
        return accepted

    def insert_one(self, namespace: Namespace, document: dict) -> dict:
        return self.insert_many(namespace, [with_id(document)])[0]

    def insert_frame(self, namespace: Namespace, rows: DataFrame) -> int:
        """Bulk load of a DataFrame with an _id column; rows whose _id is there already are left out."""
        self.engine.require_primary()
        held = self.known(namespace)
        unknown = set(rows.columns) - {ID, *held["columns"]}
        if ID not in rows.columns or unknown:
            raise DocumentValidationError(f"rows need _id and declared columns only; undeclared: {sorted(unknown)}")
        with self._writing() as txn:
            own = txn.frame(namespace.full_name)
            new = writes.as_tagged(rows)
            for c in held["columns"]:
                if c not in new.columns:
                    new = new.withColumn(c, writes.tagged_missing())
            return txn.record(writes.insert_rows(own, new.select(*own.columns)), namespace)

    def update(self, namespace: Namespace, filter_doc: Any, change: Any, many: bool = False) -> int:
        """Documents matched, which all count as modified."""
        self.engine.require_primary()
        self.known(namespace)
        with self._writing() as txn:
            frame = txn.frame(namespace.full_name)
            try:
                changes = writes.update(frame, filter_doc, change, many)
            except EngineError:
                if not reads.matching(frame, filter_doc).limit(1).count():
                    return 0  # what no document meets is not looked at further
                raise
            return txn.record(changes, namespace)

    def delete(self, namespace: Namespace, filter_doc: Any, many: bool = True) -> int:
        self.engine.require_primary()
        self.known(namespace)
        with self._writing() as txn:
            return txn.record(writes.delete(txn.frame(namespace.full_name), filter_doc, many), namespace)

    # raw objects

    def _create_raw(self, uri: str, columns: list[str] | None) -> None:
        if not re.fullmatch(r"(file|table):.+", uri):
            raise StorageError(f"not a file: or table: address: {uri}")
        with self._writing() as txn:
            held = txn.new.collections.get(uri)
            if held is not None:
                if held["columns"] != columns:
                    raise StorageError(f"{uri} exists with other columns")
                return
            txn.new.collections[uri] = {"kind": "raw", "uuid": str(uuid.uuid4()), "columns": columns, "indexes": {}, "options": {}, "segments": []}

    def create_file(self, uri: str) -> None:
        self._create_raw(uri, None)

    def create_table(self, uri: str, columns: list[str]) -> None:
        """The first column is the key and must be _id."""
        if not columns or columns[0] != ID:
            raise StorageError("a table's key column is _id")
        self._create_raw(uri, [ID, *storage_columns(columns[1:])])

    def open_cursor(self, uri: str) -> kv.KvCursor:
        if self.manifest().collections.get(uri, {}).get("kind") != "raw":
            raise StorageError(f"unknown object {uri}")

        def frame() -> DataFrame:
            return self._txn.frame(uri) if self._txn is not None else self.engine.frame_of(self.manifest(), uri)

        def write(key: bytes, value: bytes | None) -> None:
            with self._writing() as txn:
                txn.raw.setdefault(uri, {})[key] = value

        return kv.KvCursor(frame, write)

    open_file_cursor = open_table_cursor = open_cursor

    def open_index_cursor(self, namespace: Namespace, index: str) -> DataFrame:
        """An index as its field and _id in key order."""
        indexes = self.indexes(namespace)
        if index not in indexes:
            raise StorageError(f"unknown index {index}")
        return self.frame(namespace).select(indexes[index], ID).orderBy(indexes[index], ID)


class Follower:
    """Applies another engine's change log to an own store, once per entry however often it is read.

    The source is an engine, or the address of its store, which another process may be writing.
    """

    def __init__(self, source: Engine | str, target: Engine) -> None:
        self.source = source if isinstance(source, Engine) else Engine(target.spark, source)
        self.target = target

    def applied_index(self) -> int:
        return (self.target.store.manifest().applied or [0, 0])[1]

    def apply(self, batch: DataFrame, _: int = 0) -> int:
        """Applies the entries of a batch beyond the last applied one, with that mark, in one commit.

        Definitions are few and are read one by one. Documents are folded to the last image of each key. A key that the batch first
        inserts may be held with the same document only, one that it first updates must be held; else nothing of the batch is applied.
        """
        session = self.target.session()
        todo = batch.filter(F.col(ID) > self.applied_index()).persist()
        try:
            top = todo.agg({ID: "max"}).first()[0]
            if top is None:
                return self.applied_index()
            with session.transaction() as txn:
                for e in todo.filter("op in ('c', 'ci')").orderBy(ID).collect():
                    self._define(session, e)
                for (name,) in todo.filter("op in ('i', 'u', 'd')").select("ns").distinct().collect():
                    held = txn.new.collections.get(name)
                    if held is None:
                        raise StorageError(f"change log names unknown collection {name}")
                    writes.check_applicable(todo, name, txn.frame(name), held["columns"])
                    images, gone = writes.last_states(todo, name, held["columns"])
                    txn.add(name, IMAGES, images)
                    txn.add(name, GONE, gone)
                term = todo.filter(todo[ID] == top).first()["term"]
                txn.new.applied = [term, top]
                txn.new.last_index = top
        finally:
            todo.unpersist()
        self.source.follower_progress(self.target.config.replication.node_name, (term, top), (term, top))
        return top

    def _define(self, session: Session, entry: Any) -> None:
        namespace, o = Namespace.parse(entry["ns"]), json.loads(entry["o"])
        if entry["op"] == "c":
            session.create_collection(namespace, o["storageColumns"], o["collectionUuid"], logged=False)
        else:
            session.create_index(namespace, {"key": {o["indexedField"]: 1}, "name": o["name"]}, logged=False)

    def catch_up(self) -> int:
        """Applies all that the source's log has."""
        return self.apply(self.source.session().change_log())

    def follow(self, checkpoint: str, await_data: bool = False):
        """Tails the source's log as a stream."""
        return changelog.tail(self.target.spark, self.source.log_path, checkpoint, lambda batch, n: self.apply(batch, n) and None, await_data)


def parse_namespace(database: str, collection: Any) -> Namespace:
    if not isinstance(collection, str):
        raise ProtocolError("command requires a string collection name")
    return Namespace(database, collection)
