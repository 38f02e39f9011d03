import duckdb
import pytest

import __spark_entry__ as entry
from tierflow.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    if name in ORACLE:
        want = duck.execute(f"SELECT * FROM ({ORACLE[name]}) LIMIT 0")
        assert columns == sorted(d[0] for d in want.description)
        assert got == sorted(map(str, duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
