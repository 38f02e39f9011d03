import duckdb
import pytest

from tierflow.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert got == sorted(map(str, duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()))
