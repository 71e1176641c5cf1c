import math
import os

import duckdb
import pytest

from palaver.plans import views

SF = "/root/testdata/sf0.001"


def norm(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) and not math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(views.queries()))
def test_query_equals_sql(spark, name):
    df = views.queries()[name](spark, SF)
    sql = views.oracle_sql().get(name)
    rows = df.collect()
    if sql is None:
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = [tuple(r[c] for c in order) for r in rows]
    at = [want.columns.index(c) for c in order]
    assert norm(got) == norm([tuple(r[i] for i in at) for r in want.fetchall()])
