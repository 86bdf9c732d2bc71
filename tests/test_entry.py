"""The registry, and queries against their SQL on the smallest tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["exact_knn_cosine", "centroid_by_label", "balanced_range_packing", "compression_gain", "ambient_delta_codes", "axis_quantile_bins"])
def test_against_sql(spark, name):
    import duckdb

    from vectorgrove import queries

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (got, want))
    assert (a.astype(str) == b.astype(str)).all().all()
