"""Every engine query against its SQL twin in DuckDB; those without one must give rows of a stable schema."""

import duckdb
import pytest
from conftest import sf

from neurofold.queries import ORACLE_SQL, QUERIES

SMALL = sf("0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else str(v)
    return sorted(columns), sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)
    else:
        assert len(df.columns) == len(set(df.columns))
