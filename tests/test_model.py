"""Names, cells, documents, settings and files."""

import pytest

from tessera.config import EngineConfig, ReplicationConfig, Role
from tessera.errors import DocumentValidationError
from tessera.model import Namespace, cell, check_document, kind_of, storage_columns
from tessera.sources.files import Folder
from tessera.sources.tables import KEYS, table


def test_kinds_and_cells():
    assert [kind_of(v) for v in (None, True, 1, 1.0, "a", [1], {}, 2**63)] == [1, 2, 3, 4, 5, None, None, None]
    assert cell(True) == (2, True, None, None, None) and cell(None) == (1, None, None, None, None) and cell(None, missing=True)[0] == 0
    with pytest.raises(DocumentValidationError):
        cell([1])


def test_declared_columns():
    assert storage_columns(["a", "b c"]) == ["a", "b c"]
    for bad in (["a", "a"], [""], ["_id"], ["a.b"], [1]):
        with pytest.raises(DocumentValidationError):
            storage_columns(bad)
    assert check_document({"_id": 1, "a": None}, ["a"])
    for bad in ({"a": 1}, {"_id": 1, "z": 1}, {"_id": {}}, [1]):
        with pytest.raises(DocumentValidationError):
            check_document(bad, ["a"])
    for bad in ("nodot", ".c", "d."):
        with pytest.raises(DocumentValidationError):
            Namespace.parse(bad)


def test_settings(monkeypatch):
    monkeypatch.setenv("TESSERA_NODE_NAME", "n7")
    path, config = EngineConfig.from_arguments(["--db-path", "/x", "--role", "secondary", "--sync-source", "a:1"])
    assert (path, config.replication.role, config.replication.node_name, config.replication.sync_source) == ("/x", Role.SECONDARY, "n7", "a:1")
    with pytest.raises(DocumentValidationError):
        ReplicationConfig(Role.SECONDARY)


def test_folder(spark, tmp_path):
    f = Folder(spark, f"file://{tmp_path}/x")
    assert f.publish("a", b"1") and not f.publish("a", b"2") and f.read("a") == b"1" and f.names() == ["a"]
    f.make("d")
    assert f.rename("a", "d/b") and f.exists("d/b") and not f.exists("a")
    f.delete("d")
    assert f.names() == []


@pytest.mark.parametrize("name", sorted(KEYS))
def test_keys_are_unique(spark, sf_dir, name):
    frame = table(spark, sf_dir, name)
    assert frame.columns[0] == "_id" and frame.select("_id").distinct().count() == frame.count()
