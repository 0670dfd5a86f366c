"""Arrays in the cluster's shared folder, written by tasks and memory-mapped by workers.

A name is written to a temporary file and moved, so a task that runs again leaves the same file. Where the shared folder is
mounted on the workers its files are mapped in place; from any other store a worker fetches a file, maps it and unlinks it,
so nothing stays in its own folder. It holds MOST_FETCHED bytes of such copies at most: the longest held goes first, and is
fetched again when it is needed. Lookups go through the ranges in order, so that is once per slice of documents at worst.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import SparkSession

from .common import folder

#: Arrays that this worker process has mapped, up to a number that a system allows; the longest held goes first.
MOST_MAPPED = 16_384
MAPPED: dict[tuple[str, str], np.ndarray] = {}
#: Bytes of arrays that a worker process has copied from a store that it cannot map.
MOST_FETCHED = 2**30
FETCHED: dict[tuple[str, str], int] = {}


def new_store(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder under the shared checkpoint folder; removed when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/tessera-{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toString()
    atexit.register(remove, uri)
    return uri


def remove(uri: str) -> None:
    """Deletes a store that no frame reads any more; called again, it does nothing."""
    try:
        fs, path = _opened(uri)
        fs.delete_dir(path)
    except (OSError, pa.ArrowInvalid):
        pass  # the cluster's own cleaning may have come first


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def put(uri: str, name: str, array: np.ndarray) -> None:
    fs, path = _opened(uri)
    if fs.get_file_info(f"{path}/{name}.npy").type != pafs.FileType.NotFound:
        return  # a task that ran before has written the same
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    fs.move(own, f"{path}/{name}.npy")


def let_go(name: tuple[str, str]) -> None:
    MAPPED.pop(name, None)
    FETCHED.pop(name, None)


def get(uri: str, name: str) -> np.ndarray:
    if (uri, name) not in MAPPED:
        for old in [k for k in MAPPED if k[0].rsplit("-", 1)[0] == uri.rsplit("-", 1)[0] and k[0] != uri]:
            let_go(old)  # a former run's
        while len(MAPPED) >= MOST_MAPPED:
            let_go(next(iter(MAPPED)))
        fs, path = _opened(uri)
        if isinstance(fs, pafs.LocalFileSystem):
            MAPPED[uri, name] = np.load(f"{path}/{name}.npy", mmap_mode="r")
        else:
            fetch(fs, f"{path}/{name}.npy", (uri, name))
    return MAPPED[uri, name]


def fetch(fs: pafs.FileSystem, path: str, name: tuple[str, str]) -> None:
    """Copies a file, maps the copy and unlinks it, after making room for it."""
    size = fs.get_file_info(path).size
    while FETCHED and sum(FETCHED.values()) + size > MOST_FETCHED:
        let_go(next(iter(FETCHED)))
    handle, own = tempfile.mkstemp(suffix=".npy")
    try:
        with fs.open_input_stream(path) as source, os.fdopen(handle, "wb") as out:
            while block := source.read(1 << 22):
                out.write(block)
        MAPPED[name], FETCHED[name] = np.load(own, mmap_mode="r"), size
    finally:
        os.unlink(own)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits, or in 64 if one needs them."""
    return counts.astype(np.uint32 if not len(counts) or int(counts.max()) < 2**32 else np.uint64)


def squeeze(array: np.ndarray) -> bytes:
    """A whole-number array as compressed bytes, its bytes dealt by place so that small numbers take little room."""
    array = np.ascontiguousarray(array)
    planes = array.view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(array.dtype.char.encode() + np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:1].decode())
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1).T).view(kind).ravel()


def squeeze_sorted(array: np.ndarray) -> bytes:
    """Ascending numbers, by their differences."""
    return squeeze(np.diff(array, prepend=array.dtype.type(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    steps = unsqueeze(data)
    return np.cumsum(steps, dtype=steps.dtype)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, with the sums of their counts."""
    if not len(keys):
        return (keys, *counts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    fresh = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[fresh], *(np.add.reduceat(c[order], fresh) for c in counts))


def runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else np.zeros(0, np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(shard)]):
        yield int(shard[a]), a, b


class Ranges:
    """Sorted hash arrays in files, one for each range of the hash's upper bits."""

    def __init__(self, store: str, name: str, bits: int, sizes: dict[int, int]) -> None:
        self.store, self.name, self.bits, self.sizes = store, name, bits, sizes
        self.offset = np.zeros(2**bits + 1, np.int64)
        self.offset[1:] = np.cumsum([sizes.get(i, 0) for i in range(2**bits)])

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range and place of each of the ascending hashes; place -1 for those not there."""
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        places = np.full(len(hashes), -1, np.int64)
        for s, a, b in runs(shard):
            if self.sizes.get(s):
                held = get(self.store, f"{self.name}-{s}")
                at = np.searchsorted(held, hashes[a:b])
                at[at == len(held)] = 0
                places[a:b] = np.where(held[at] == hashes[a:b], at, -1)
        return shard, places

    def read(self, what: str, shard: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Values of a further array that lies beside the hashes; 0 for place -1. shard is ascending."""
        out = np.zeros(len(shard), np.int64)
        for s, a, b in runs(shard):
            there = places[a:b] >= 0
            if there.any():
                out[a:b][there] = get(self.store, f"{what}-{s}")[places[a:b][there]]
        return out


def blobs(shard: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per range: its ascending keys and their columns, compressed."""
    out: dict[str, list] = {"shard": [], "keys": [], **{f"c{i}": [] for i in range(len(columns))}}
    for s, a, b in runs(shard):
        out["shard"].append(s)
        out["keys"].append(squeeze_sorted(keys[a:b]))
        for i, c in enumerate(columns):
            out[f"c{i}"].append(squeeze(narrow(c[a:b])))
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "shard" else pa.binary()) for k, v in out.items()})
