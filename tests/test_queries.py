"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pytest

from trovelight.plans import connector_queries, hierarchy_queries, machine_queries, publishing_queries, relational_queries, revision_queries, search_queries, workbench_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ALL = {**search_queries.QUERIES, **relational_queries.QUERIES, **workbench_queries.QUERIES, **publishing_queries.QUERIES, **machine_queries.QUERIES, **hierarchy_queries.QUERIES, **connector_queries.QUERIES, **revision_queries.QUERIES}
ORACLES = {**search_queries.ORACLES, **relational_queries.ORACLES, **workbench_queries.ORACLES, **publishing_queries.ORACLES, **machine_queries.ORACLES, **hierarchy_queries.ORACLES, **connector_queries.ORACLES, **revision_queries.ORACLES}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def text(row):
    return str(tuple(round(x, 5) if isinstance(x, float) else x for x in row))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, con, name):
    got = ALL[name](spark, sf_dir).collect()
    if name not in ORACLES:
        assert got
        return
    rel = con.sql(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert not got or sorted(got[0].asDict()) == sorted(cols)
    assert sorted(text(r) for r in rel.fetchall()) == sorted(text([r[c] for c in cols]) for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
