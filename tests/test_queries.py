"""Every registered query against its SQL twin on the given tables."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from rinkspark.plans.queries import QUERIES

TABLES = "orders lineitem events documents labels part embeddings"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE_DIR}/{t}.parquet'")
    return connection


def sorted_rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    cells = [[None if pd.isna(v) else v for v in pdf[c].tolist()] for c in pdf.columns]
    return sorted(zip(*cells), key=lambda r: tuple((v is not None, v) for v in r))


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(oracle_sql()) and set(QUERIES) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["video_id", "frame_idx", "n_evidence", "best_score"] and df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, db, name):
    got = queries()[name](spark, SMOKE_DIR).toPandas()
    want = db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert sorted_rows(got) == sorted_rows(want)
