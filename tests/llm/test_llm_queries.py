"""Registered queries on the smallest tables: SQL where there is one, else a row for each row (test_llm.py holds the operators against brute force)."""

import os
from collections import Counter

import duckdb
import pytest

from colinear.llm import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    relation = con.sql(q.oracle_sql()[name])
    at = [relation.columns.index(c) for c in cols]
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(tuple(r[i] for i in at) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_has_a_row_for_each_input_row(spark, name):
    n = q.queries()[name](spark, SF).count()
    table = "pages" if name.startswith("op1_") else "documents"
    if name.startswith("op5_"):
        assert 0 < n < spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        assert n == spark.read.parquet(f"{SF}/{table}.parquet").count()
