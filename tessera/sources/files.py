"""Small files in a store that Spark reaches: manifests are written whole and appear at once.

That needs a rename that is one step and refuses a name that is held; stores of the schemes in RENAMES have it. Others, where a
rename is a copy, are refused for writing, as two writers could both publish.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import StorageError


#: Schemes of stores with such a rename.
RENAMES = {"file", "hdfs", "viewfs", "abfs", "abfss", "ofs", "o3fs"}


class Folder:
    """A folder, through the Hadoop file system of its path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self.path = spark._jvm, path.rstrip("/")
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._root)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self, name: str = "") -> list[str]:
        at = self._path(name) if name else self._root
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> bool:
        """Writes a new file; False if it is there already. Readers see all of it or nothing."""
        scheme = self._fs.getUri().getScheme()
        if scheme not in RENAMES:
            raise StorageError(f"a store of scheme {scheme} cannot publish in one step; use one of {sorted(RENAMES)}")
        own = f".{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(own), False)
        try:
            stream.write(data)
        finally:
            stream.close()
        if not self.exists(name) and self._fs.rename(self._path(own), self._path(name)):
            return True
        self._fs.delete(self._path(own), False)
        return False

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only for a session that runs on it alone."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise StorageError("spark.checkpoint.dir is not set: on a cluster it names the folder that driver and executors share")
    return given or f"file://{tempfile.gettempdir()}/tessera-checkpoints"


def materialized(frame: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, so that reading it twice gives the same rows in the same partitions."""
    sc = frame.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()
