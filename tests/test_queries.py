"""Every domain query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from colinear import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(map(_norm, r)) for r in df.select(*cols).collect())
    relation = duck.sql(q.oracle_sql()[name])
    at = [relation.columns.index(c) for c in cols]
    assert sorted(relation.columns) == cols
    assert got == Counter(tuple(_norm(r[i]) for i in at) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_query_runs(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def test_star_consensus_equals_brute_force(spark, duck):
    from test_operators import star_brute

    rows = duck.sql(q.sql("SELECT split_part(acr, '_', 1) AS cluster, acr, list(split_part(motif, '-', 1) ORDER BY pos) AS motifs, acr = min(acr) OVER (PARTITION BY split_part(acr, '_', 1)) AS is_center FROM acr_motif GROUP BY acr")).fetchall()
    got = {r.cluster: r.tokens for r in q.queries()["q_star_consensus"](spark, SF).collect()}
    assert got == star_brute(rows, 1, lambda t: 5.0) and got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
