import duckdb
import pytest

import __spark_entry__ as entry
from meshjoin.plans import queries as engine

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_engine_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "part"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(engine.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    want = want.fetchall()
    df = engine.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
