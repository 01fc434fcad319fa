import glob
import os

import duckdb
import pytest

from loam.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in cursor.fetchall()), key=str)
    df = queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str) == want
