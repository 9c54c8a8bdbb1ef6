"""Every query of the reference's operators against its SQL, and the entry points with and without the other subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from quillgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in registry.SQL:
        assert df.columns
        return
    cursor = duck.execute(registry.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    expected = sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr) == expected


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "Title", "Journal", "Year", "n_citations"]
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data subpackage and the corpus pipeline everything else still imports."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("quillgraph.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert len(e.queries()) > 40 and not any(n.startswith("op") for n in e.queries()), e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
