from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import value


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    order = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in order) for r in df.collect())
    cur = db.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == order
    assert got == Counter(tuple(value(r[cols.index(c)]) for c in order) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "rrf_score", "rank"]


def test_every_core_query_has_sql():
    from lexweave.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
