"""Versioned snapshots. A manifest names the version of every collection; publishing the next one is the commit.

A collection is a list of segments: rows that were added, images that replace or add documents by key, and keys that
are gone. A write adds a segment of what it changed, and folds the changes, without the first rows, when there are many; reading folds them
with the rows, and a checkpoint writes one segment in their place.

Readers pin a manifest and so see one state of all collections. A writer prepares new snapshot folders, then publishes manifest
N + 1, which fails if another writer has done so. What a failed writer prepared is never named and goes with
the next vacuum. Opening a store is reading its last whole manifest; there is nothing to replay.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, StorageError
from ..functions.cells import quoted
from .files import Folder

MANIFESTS, DATA, LOG = "manifests", "data", "changelog"
#: Kinds of segments.
ROWS, IMAGES, GONE = "rows", "images", "gone"
#: So many changed keys fit in the driver and in every executor.
FEW = 100_000
#: Columns added while segments are folded.
PLACE, CHANGED_KEY, CHANGED_AT = "__place", "__changed_key", "__changed_at"


@dataclass
class Manifest:
    version: int = 0
    collections: dict[str, dict] = field(default_factory=dict)  # by full name: kind, uuid, columns, indexes, options, segments
    log: list[str] = field(default_factory=list)  # the last folders of the change log, which may still be where they were staged
    last_index: int = 0
    term: int = 1
    applied: list[int] | None = None  # term and index of what a follower has applied

    def to_bytes(self) -> bytes:
        return json.dumps(self.__dict__, sort_keys=True).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Manifest:
        return cls(**json.loads(data))

    def copy(self) -> Manifest:
        return copy.deepcopy(self)


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.folder.make(MANIFESTS)
        if not self.versions():
            self.folder.publish(self._name(0), Manifest().to_bytes())

    @staticmethod
    def _name(version: int) -> str:
        return f"{MANIFESTS}/{version:020d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names(MANIFESTS) if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The state as of a version; by default the last whole one."""
        if version is not None:
            if not self.folder.exists(self._name(version)):
                raise StorageError(f"version {version} is not kept")
            return Manifest.from_bytes(self.folder.read(self._name(version)))
        for v in reversed(self.versions()):
            if (found := self._whole(v)) is not None:
                return found  # a torn one is passed over; the one before it is the state
        raise StorageError("no manifest")

    def _whole(self, version: int) -> Manifest | None:
        try:
            return Manifest.from_bytes(self.folder.read(self._name(version)))
        except (ValueError, TypeError):
            return None

    def whole_versions(self) -> list[int]:
        return [v for v in self.versions() if self._whole(v) is not None]

    def write(self, frame: DataFrame) -> str:
        """A new snapshot folder's name, not yet part of any state."""
        name = f"{DATA}/{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.path}/{name}")
        return name

    def write_parts(self, frame: DataFrame, flag: str) -> dict[bool, str]:
        """Writes the rows where a flag is set and the others, which come in its order, as two folders in one pass; one without rows is left out."""
        name = f"{DATA}/{uuid.uuid4().hex}"
        frame.write.partitionBy(flag).parquet(f"{self.path}/{name}")
        parts = {}
        for value in (True, False):
            if self.folder.exists(part := f"{name}/{flag}={str(value).lower()}"):
                parts[value] = f"{DATA}/{uuid.uuid4().hex}"
                self.folder.rename(part, parts[value])
        self.folder.delete(name)
        return parts

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def folded(self, segments: list, empty: DataFrame, key: str, n_changes: int | None = None) -> DataFrame:
        """What the segments amount to: rows are added, images replace what has their key, gone keys are taken out.

        One pass: every row with its segment's place, less those whose key a later segment changed. Filters reach the segments' scans.
        Only few changes may be broadcast: files say little of their rows, as a column of one value takes next to no room there.
        """
        rows, changes = [], []
        for place, (kind, paths) in enumerate(self.joined_rows(segments)):
            part = self.spark.read.parquet(*[f"{self.path}/{p}" for p in paths]).withColumn(PLACE, F.lit(place))
            if kind != GONE:
                rows.append(part)
            if kind != ROWS:
                changes.append(part.select(quoted(key).alias(CHANGED_KEY), F.col(PLACE).alias(CHANGED_AT)))
        if not rows:
            return empty
        frame = reduce(DataFrame.unionByName, rows)
        if changes:
            last = reduce(DataFrame.unionByName, changes)
            if len(changes) > 1:
                last = last.groupBy(CHANGED_KEY).agg(F.max(CHANGED_AT).alias(CHANGED_AT))  # a row meets one change of its key, not each
            later = (quoted(key) == F.col(CHANGED_KEY)) & (F.col(PLACE) < F.col(CHANGED_AT))
            few = n_changes is not None and n_changes <= FEW
            frame = frame.join(last if few else last.hint("merge"), later, "left_anti")
        return frame.drop(PLACE)

    @staticmethod
    def joined_rows(segments: list) -> list[tuple[str, list[str]]]:
        """Segments with neighbouring ones of added rows taken together."""
        out: list[tuple[str, list[str]]] = []
        for kind, path in segments:
            if out and kind == ROWS == out[-1][0]:
                out[-1][1].append(path)
            else:
                out.append((kind, [path]))
        return out

    def folded_changes(self, segments: list, key: str) -> list[list[str]]:
        """Writes segments as two: the last images of the keys that they leave, and the keys that are gone. Costs what the segments hold."""
        parts = []
        for place, (kind, paths) in enumerate(self.joined_rows(segments)):
            part = self.spark.read.parquet(*[f"{self.path}/{p}" for p in paths])
            parts.append(part.select(quoted(key).alias(CHANGED_KEY), F.struct(*map(quoted, part.columns)).alias("row"), F.lit(kind).alias("kind"), F.lit(place).alias(PLACE)))
        shape = next((p.schema["row"].dataType for p, (kind, _) in zip(parts, self.joined_rows(segments)) if kind != GONE), parts[0].schema["row"].dataType)
        alike = [p if p.schema["row"].dataType == shape else p.withColumn("row", F.lit(None).cast(shape)) for p in parts]
        last = reduce(DataFrame.unionByName, alike).groupBy(CHANGED_KEY).agg(F.max_by(F.struct("row", "kind"), PLACE).alias("last"))
        last = self.read(self.write(last))
        images = last.filter(F.col("last.kind") != GONE).select("last.row.*")
        gone = last.filter(F.col("last.kind") == GONE).select(F.col(CHANGED_KEY).alias(key))
        return [[IMAGES, self.write(images)], [GONE, self.write(gone)]]

    def commit(self, base: Manifest, new: Manifest) -> Manifest:
        new.version = base.version + 1
        while self.folder.exists(self._name(new.version)) and self._whole(new.version) is None:
            new.version += 1  # torn, nobody's state
        if not self.folder.publish(self._name(new.version), new.to_bytes()):
            raise ConflictError("another writer published first")
        return new

    def referenced(self, manifests: list[Manifest]) -> set[str]:
        return {path for m in manifests for c in m.collections.values() for _, path in c["segments"]}

    def log_folders(self, last_index: int) -> list[str]:
        """Folders of the change log up to an index, in order, by their names."""
        names = sorted(n for n in self.folder.names(LOG) if not n.startswith(("_", ".")))
        return [f"{LOG}/{n}" for n in names if int(n.split("-")[1]) <= last_index]

    def log_gaps(self) -> list[str]:
        """Folders of the change log that don't begin where the one before ends."""
        names = sorted(n for n in self.folder.names(LOG) if not n.startswith(("_", ".")))
        return [f"{LOG}/{b}" for a, b in zip(names, names[1:]) if int(b.split("-")[0]) != int(a.split("-")[1]) + 1]

    def missing_log(self, manifests: list[Manifest]) -> set[str]:
        return {n for m in manifests for n in m.log if not self.folder.exists(n)}

    @staticmethod
    def staged_log(own: str) -> str:
        return f"{DATA}/{own}"

    def settle_log(self, manifest: Manifest) -> None:
        """Moves published log rows that are still where they were staged into the log folder, the last ones first."""
        self.folder.make(LOG)
        for name in reversed(manifest.log):
            if self.folder.exists(name):
                break
            self.folder.rename(self.staged_log(name.rsplit("-", 1)[1]), name)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Drops all but the last `keep` manifests and the snapshot folders that none of these names."""
        versions = self.whole_versions()
        kept = versions[-max(1, keep) :]
        manifests = [self.manifest(v) for v in kept]
        named = self.referenced(manifests) | {self.staged_log(n.rsplit("-", 1)[1]) for n in self.missing_log(manifests)}
        gone = [f"{DATA}/{n}" for n in self.folder.names(DATA) if f"{DATA}/{n}" not in named]
        for v in versions[: -max(1, keep)]:
            self.folder.delete(self._name(v))
        for name in gone:
            self.folder.delete(name)
        return gone

    def audit(self) -> dict[str, list[str]]:
        """Named folders that are missing, and folders that nothing names."""
        manifests = [self.manifest(v) for v in self.whole_versions()]
        named = self.referenced(manifests) | {n for m in manifests for n in m.log}
        there = {f"{d}/{n}" for d in (DATA, LOG) for n in self.folder.names(d) if not n.startswith(("_", "."))}
        return {"missing": sorted(named - there) + self.log_gaps(), "orphans": sorted(n for n in there - named if n.startswith(DATA))}
