"""Chunks of tables that don't divide evenly, against the SQL of their queries."""

import duckdb
import numpy as np
import pytest

from vectorgrove import queries


def _written(folder, n, dims=3, seed=4):
    """Embeddings with ties in their first components."""
    x = np.random.default_rng(seed).integers(0, 5, (n, dims)) / 4 + np.arange(dims)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    if n:
        con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(i, v.tolist(), i % 3) for i, v in enumerate(x)])
    con.execute(f"COPY embeddings TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("n", [0, 19, 56])
def test_hybrid_coarse(spark, tmp_path, n):
    con = _written(tmp_path, n)
    want = con.execute(queries.ORACLES["hybrid_coarse"]).fetchall()
    assert sorted(queries.QUERIES["hybrid_coarse"](spark, str(tmp_path)).collect(), key=lambda r: r[0]) == sorted(want)


def test_hybrid_coarse_refuses_fewer_vectors_than_chunks(spark, tmp_path):
    _written(tmp_path, 7)
    with pytest.raises(ValueError, match="7 vectors for 10"):
        queries.QUERIES["hybrid_coarse"](spark, str(tmp_path))


@pytest.mark.parametrize("n", [0, 5, 7, 54])
def test_recursive_balanced(spark, tmp_path, n):
    con = _written(tmp_path, n)
    want = con.execute(queries.ORACLES["recursive_balanced"]).fetchall()
    assert sorted(queries.QUERIES["recursive_balanced"](spark, str(tmp_path)).collect(), key=lambda r: r[0]) == sorted(want)


def test_recursive_balanced_refuses_fewer_vectors_than_parts(spark, tmp_path):
    _written(tmp_path, 3)
    with pytest.raises(ValueError, match="3 vectors for 4"):
        queries.QUERIES["recursive_balanced"](spark, str(tmp_path))
