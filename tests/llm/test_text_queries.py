import os

import duckdb
import pytest
from tallyspring.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "token_budgets"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, FOLDER), c.execute(queries.SQL[name])
    columns = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(columns) and sorted(map(tuple, got.select(*columns).collect())) == sorted(expected.fetchall())


def test_composition_counts_what_is_found(spark):
    found, counted = queries.p8_found(spark, FOLDER), queries.p8_composition(spark, FOLDER)
    by_subject = {}
    for r in found.collect():
        by_subject[r.subject] = by_subject.get(r.subject, 0) + 1
    assert {r.subject: r.documents for r in counted.collect()} == by_subject


def test_columns(spark):
    assert queries.p6_ids(spark, FOLDER).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert queries.p8_found(spark, FOLDER).columns == ["doc_id", "subject"]


def test_the_entry_has_them():
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
