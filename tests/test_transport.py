"""Least-cost assignment with bounds, against all assignments and against the whole problem in memory."""

import itertools

import numpy as np
import pytest

from vectorgrove.operators import clustering, transport


def _total(cost, held):
    return int((cost * np.array(held)).sum())


def test_solved_is_cheapest():
    r = np.random.default_rng(3)
    for trial in range(60):
        n, k = 6, 3
        cost = r.integers(0, 5 if trial % 2 else 1 << 40, (n, k))
        low, high = [(1, 3), (2, 2), (0, 4), (0, 6)][trial % 4]
        held = np.array(transport.solved(cost, low, high).held)
        best = min(sum(int(cost[i, c]) for i, c in enumerate(p)) for p in itertools.product(range(k), repeat=n) if all(low <= p.count(c) <= high for c in range(k)))
        assert (held.sum(1) == 1).all() and (low <= held.sum(0)).all() and (held.sum(0) <= high).all()
        assert _total(cost, held) == best


@pytest.mark.parametrize("most", [60, 400])
def test_boxes_find_what_the_whole_problem_gives(spark, monkeypatch, most):
    """Few rows at a time come to the driver; each vector is there once or, of some, many times."""
    monkeypatch.setattr(transport, "MAX_OPEN", most)
    monkeypatch.setattr(transport, "GUESSED_BY", 50)
    r = np.random.default_rng(most)
    x = r.normal(size=(300, 4)) + [2, 0, 0, 0]
    x = np.concatenate([x, *([x[:5]] * 60)]) if most == 400 else x
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    centers, n = r.normal(size=(4, 4)), len(x)
    cost = transport.costs(x, centers)
    for low, high in ((n // 8, -(-n // 3)), (n // 4, n // 4)):
        want = _total(cost, transport.solved(cost, low, high).held)
        found = transport.least_cost(df, centers, low, high, "vec_id", "embedding")
        got = {r.vec_id: r.cluster_id for r in found.assign(df, centers, "vec_id", "embedding").collect()}
        owner = np.array([got[i] for i in range(n)])
        assert len(got) == n and all(low <= (owner == c).sum() <= high for c in range(4))
        assert int(cost[np.arange(n), owner].sum()) == want


def test_balanced_clusters_of_more_vectors_than_one_solve_took(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(4200, 3)) + np.repeat(r.normal(size=(3, 3)) * 3, 1400, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    _, members = clustering.balanced(df, 3, 1000, 1500)
    sizes = [c["count"] for c in members.groupBy("cluster_id").count().collect()]
    assert sum(sizes) == 4200 and all(1000 <= s <= 1500 for s in sizes)


def test_query_places_all_vectors(spark, tmp_path):
    from vectorgrove import queries

    r = np.random.default_rng(1)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(r.normal(size=(48, 3)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["balanced_clustering"](spark, str(tmp_path)).toPandas()
    assert sorted(got["vec_id"]) == list(range(48)) and got.groupby("cluster_id").size().between(6, 16).all()
