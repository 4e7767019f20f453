"""Every text query that has SQL against it in DuckDB, on the smallest tables."""

import duckdb
import pytest

from shopfloor.llm import queries

TABLES = "documents benchmark conversations labels".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    answer = duck.execute(queries.ORACLES[name])
    kinds = {x[0]: str(x[1]) for x in answer.description}
    names = [x[0] for x in answer.description]
    wanted = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in answer.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    assert got == wanted and got
