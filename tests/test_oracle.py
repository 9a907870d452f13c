"""Each registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from concordia.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    ours = plain(df.select(*cols).collect())
    sql = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert ours == plain(sql)
    assert ours


def test_every_query_runs(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, DATA).limit(1).count() <= 1
