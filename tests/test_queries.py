"""Every core query against its SQL on the small tables."""

import math

import duckdb
import pytest

from loomgraph import queries as Q

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return "nan"
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "part", "events", "documents", "embeddings", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, db, name):
    frame = Q.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((plain(tuple(r[c] for c in columns)) for r in frame.collect()), key=repr)
    if name not in Q.oracle_sql():
        assert got
        return
    answer = db.sql(Q.oracle_sql()[name])
    at = [answer.columns.index(c) for c in columns]
    assert sorted(answer.columns) == columns
    assert got == sorted((plain(tuple(r[i] for i in at)) for r in answer.fetchall()), key=repr)


def test_random_values_stay_in_range(spark):
    rows = Q.queries()["random_values"](spark, SF).collect()
    again = Q.queries()["random_values"](spark, SF).drop("now").collect()
    assert all(1 <= r["f"] < 2 and r["i"] in range(1, 7) and r["at"] == 0 and r["word"] for r in rows)
    assert len({r["f"] for r in rows}) > 100 and 0 < sum(r["b"] for r in rows) < len(rows) / 2
    assert sorted(tuple(r) for r in again) == sorted(tuple(v for k, v in r.asDict().items() if k != "now") for r in rows)
