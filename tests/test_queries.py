"""Every registered query against its SQL twin on DuckDB."""

import math

import duckdb
import pytest

from vigil.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}" if v != int(v) else str(int(v))
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_matches_sql(spark, db, name):
    query, sql = REGISTRY[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    out = db.execute(sql)
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())


def test_queries_without_sql(spark):
    for name in ("r09_verify_briefs", "m18_components", "q_stream_signal_counts"):
        assert REGISTRY[name][0](spark, SF).count() > 0
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert REGISTRY["q_stream_signal_counts"][0](spark, SF).agg({"n": "sum"}).first()[0] == events
