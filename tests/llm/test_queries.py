"""Registered queries: the ten operators over whole tables, their SQL, and the pipeline's place."""

from __future__ import annotations

import __spark_entry__ as entry
import duckdb
import pytest
from quillgraph.llm import queries


def test_registration():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    tidy = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    expected = sorted(map(tidy, cursor.fetchall()))
    assert sorted(map(tidy, queries.QUERIES[name](spark, sf_dir).select(*columns).collect())) == expected
    assert expected
