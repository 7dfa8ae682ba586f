import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    """Bit for bit, in any order of rows."""
    duck = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, df.select(columns).collect()), key=key) == sorted(expected, key=key)
