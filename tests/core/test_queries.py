"""Every registered query against its SQL, and none of them empty."""

import duckdb
import pytest

from textloom.plans.catalog import QUERIES
from textloom.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings", "events"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def said(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(said, r)) for r in frame.select(*columns).collect())
    assert got
    if name in ORACLE:
        relation = duck.sql(ORACLE[name])
        assert sorted(relation.columns) == columns
        assert got == sorted(tuple(map(said, r)) for r in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["strong_block", "reference_page", "complete_fields", "excluded_content", "url_is_html", "url_relevant", "url_same_site"])
def test_both_outcomes(spark, name):
    frame = QUERIES[name](spark, SF)
    flag = [c for c, t in frame.dtypes if t == "boolean"][0]
    assert {r[0] for r in frame.select(flag).distinct().collect()} >= {True, False}


def test_stream_is_the_batch(spark):
    row = QUERIES["stream_equals_batch"](spark, SF).first()
    assert row.streamed == row.batch > 0
    assert row.different == 0
