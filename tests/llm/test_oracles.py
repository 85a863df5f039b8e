"""The queries with SQL twins against DuckDB over the smallest whole tables."""

import duckdb
import pytest

from neurofold.llm import queries as Q
from neurofold.llm.oracles import ORACLE_SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(c) for c in columns]
    twin = [tuple(r[i] for i in order) for r in found.fetchall()]
    rows = Q.QUERIES[name](spark, SMALL)
    assert sorted(rows.columns) == columns
    plain = lambda rs: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rs), key=str)
    assert plain(map(tuple, rows.select(columns).collect())) == plain(twin)
