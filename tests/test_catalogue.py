"""Every catalogue query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from sievemill.plans import casework, catalogue, workflow  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 8) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = c.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    want = sorted(str([plain(row[names.index(x)]) for x in columns]) for row in out.fetchall())
    assert got == want
