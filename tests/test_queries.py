"""Every query with SQL gives the same rows in Spark and in DuckDB; the others give rows."""

import os

import duckdb
import pytest

from framelake.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, db, name):
    ours, theirs = catalogue.QUERIES[name](spark, DIR).toPandas(), db.sql(catalogue.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b) > 0
    assert ((a.astype(str) == b.astype(str)).all(axis=1)).all()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_gives_finite_rows(spark, name):
    rows = catalogue.QUERIES[name](spark, DIR).toPandas()
    assert len(rows) > 0
    assert not rows.select_dtypes("number").isna().any().any()


def test_masks_take_every_frame(spark, tmp_path):
    """A pixel that is invalid in one frame with t % 8 <> 0 only."""
    frame = [[0.0] * 64 for _ in range(9)]
    frame[3][10] = -3.0
    rows = [(t, x, 0) for t, x in enumerate(frame)] + [(9, [0.0] * 64, 1), (16, [0.0] * 64, 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    apart = catalogue.QUERIES["mask_temporal_and"](spark, str(tmp_path)).where("val = 0").collect()
    assert [(r["rec_id"], r["y"], r["x"]) for r in apart] == [("0", 1, 2)]
    assert [(r["y"], r["x"]) for r in catalogue.QUERIES["mask_session_and"](spark, str(tmp_path)).where("val = 0").collect()] == [(1, 2)]
