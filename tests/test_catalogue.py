"""Every registered query against its DuckDB SQL on the smallest table."""

import duckdb
import pandas as pd
import pytest

from scriptorium import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame):
    names = sorted(frame.columns)
    said = lambda v: "-" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return names, sorted(tuple(said(v) for v in row) for row in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas().astype(object)
    want = duck.execute(catalogue.oracle_sql()[name]).df().astype(object)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", ["openalex_records", "pubmed_records", "classified_records"])
def test_costly_rows_of_a_small_file_are_spread(spark, name):
    """One task doesn't map all rows of a table that is a single small file."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
