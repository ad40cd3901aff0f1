"""Every named query against its SQL, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from keepsake.plans import all_queries, all_sql  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_agrees_with_sql(spark, duck, name):
    df = all_queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert costly not in plan
    found = table(df.columns, [tuple(r) for r in df.collect()])
    if name in all_sql():
        answer = duck.execute(all_sql()[name])
        assert found == table([c[0] for c in answer.description], answer.fetchall())


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
