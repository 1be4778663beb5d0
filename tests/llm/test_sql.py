"""Registered queries that SQL can express, on the smallest tables."""

import duckdb
import pytest

from ferrule.llm import queries
from ferrule.plans.compare import same_result
from tests.llm.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_SMALL}/{table}.parquet')")
    got = queries.QUERIES[name](spark, SF_SMALL).toPandas()
    assert same_result(got, con.execute(queries.ORACLE[name]).df())
