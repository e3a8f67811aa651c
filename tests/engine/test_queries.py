import duckdb
import pytest

from netlens.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    assert shown(tuple(r) for r in df.select(*columns).collect()) == shown(tuple(r[names.index(c)] for c in columns) for r in told.fetchall())
