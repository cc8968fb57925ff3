import duckdb
import pytest

from tabularium.llm import queries
from tabularium.session import TABLES
from tools.check import normal

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_and_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rel = con.sql(queries.ORACLES[name])
    assert columns == sorted(rel.columns)
    order = [rel.columns.index(c) for c in columns]
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got and normal(got) == normal([tuple(r[i] for i in order) for r in rel.fetchall()])


def test_every_twin_belongs_to_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
