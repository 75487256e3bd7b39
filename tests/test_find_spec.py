"""The registered query by name against its SQL: a command's purpose that mentions a rule doesn't name it."""

import os

import duckdb
import pytest

from loregraph.plans import document_registry as D

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{file}'")
    return con


def test_same_rows_as_sql(spark, con):
    assert con.execute("SELECT count(*) FROM nation WHERE n_nationkey % 10 = 2").fetchone()[0]  # commands that mention BR-2
    found = D.find_spec(spark, DIR)
    wanted = con.execute(D.SQL["find_spec"])
    assert found.columns == [c[0] for c in wanted.description]
    assert [tuple(r) for r in found.collect()] == wanted.fetchall()
