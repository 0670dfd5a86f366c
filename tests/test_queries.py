"""Every registered query of the engine against its SQL in DuckDB, and the registry without the training-text folder."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tessera.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir_module):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir_module}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf_dir_module():
    return "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(None if x != x else x for x in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, sf_dir_module, name):
    assert rows(QUERIES[name](spark, sf_dir_module).toPandas()) == rows(db.execute(ORACLES[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registry_without_the_training_text_folder(tmp_path):
    """The rest imports and registers its queries if those files are deleted."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in ("tessera", "corpus_pipeline.py", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    (tmp_path / "tessera").mkdir()
    for name in os.listdir(f"{root}/tessera"):
        if name != "llm":
            os.symlink(f"{root}/tessera/{name}", tmp_path / "tessera" / name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code.replace("sys.path.insert(0, '.')", f"sys.path.insert(0, {str(tmp_path)!r})")], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(QUERIES)), "False", "False"]
