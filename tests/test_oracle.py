"""Each registered query with SQL gives what DuckDB gives for it."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from trendloom.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.01")


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def form(v):
        if pd.isna(v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return sorted(tuple(map(form, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    ours = QUERIES[name](spark, str(DATA)).toPandas()
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_rows_only(spark):
    names = set(QUERIES) - set(SQL)
    assert names == {"rise_classifier", "pca_kmeans", "hashed_text_vectors", "sentence_split", "brand_context_extract", "brand_tables_context", "series_forecast_trend", "taxonomy_vectors", "density_clusters"}
    told = QUERIES["rise_classifier"](spark, str(DATA)).collect()
    assert len(told) == 5 and all(0 <= r["rise_score"] <= 1 and not math.isnan(r["p2"]) for r in told)
