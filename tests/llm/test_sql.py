"""Every query of the subpackage that has SQL against it in DuckDB, over the smallest tables."""

import duckdb
import pytest

from sievemill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    want = sorted(str([str(row[names.index(x)]) for x in columns]) for row in out.fetchall())
    assert sorted(str([str(r[c]) for c in columns]) for r in df.collect()) == want
