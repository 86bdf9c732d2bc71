"""Grouping strategies, summaries and packers of bounded tables."""

import numpy as np
import pytest

from vectorgrove.operators import hierarchy as H


@pytest.mark.parametrize("strategy", H.STRATEGIES)
def test_strategies_cover_all_nodes(strategy):
    x = np.random.default_rng(2).normal(size=(23, 4))
    groups = H.group(x, np.ones(23), strategy, 2, 5, level=1)
    assert sorted(i for g in groups for i in g) == list(range(23))
    assert all(2 <= len(g) <= 5 for g in groups)


def test_build_and_refinement(spark):
    x = np.random.default_rng(3).normal(size=(12, 3))
    leaves = spark.createDataFrame([(i, v.tolist(), 4, 0.5) for i, v in enumerate(x)], "cluster_id long, centroid array<double>, members long, dispersion double")
    nodes = H.build(leaves, "ward", 2, 4)
    rows = nodes.collect()
    roots = [r for r in rows if r.parent is None]
    assert len(roots) == 1 and roots[0].members == 48
    beta = H.refinement(nodes).collect()
    assert len(beta) == len(rows) - 1 and all(b.beta >= 0 for b in beta)
    assert H.depth_bound(12, 4) == 2 and H.depth_bound(16, 4) == 2


def test_summaries(spark):
    x = np.random.default_rng(4).normal(size=(30, 3)) * [5, 1, 1]
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, c long, embedding array<double>").repartition(4)
    parts = {r.cluster_id: r for r in H.exact_summaries(df, "c").collect()}
    for c, r in parts.items():
        own = x[np.arange(30) % 3 == c]
        assert np.allclose(r.centroid, own.mean(0)) and abs(r.variance - H.dispersion(own)) < 1e-9
        assert abs(abs(np.dot(r.direction, H.principal_direction(own, own.mean(0)))) - 1) < 1e-6
    mean, variance = H.composed(np.array([10, 10, 10]), np.array([parts[c].centroid for c in range(3)]), np.array([parts[c].variance for c in range(3)]))
    assert np.allclose(mean, x.mean(0)) and abs(variance - H.dispersion(x)) < 1e-9
    assert H.relative_error(mean, mean) == 0 and H.relative_error(mean, np.zeros(3)) == np.inf


def test_packers(spark):
    assert H.segmented([0, 0, 0, 1, 1, 1, 1, 2, 2], 4) == [3, 4, 2]
    with pytest.raises(ValueError):
        H.segmented([0], 4)
    df = spark.createDataFrame([(i, [float(i // 3 * 10 + i % 3)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert H.neighborhood_groups(df, 3)["cluster_id"].tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_groups_grow_by_the_best_node_left(metric):
    """As trying each node that is left would have it; some nodes are there twice."""
    x = np.random.default_rng(6).normal(size=(40, 3))
    x[20:25] = x[10:15]
    cost = {
        "greedy-pack": lambda g, i: H.distances(x[g[:1]], x[i : i + 1], metric)[0, 0],
        "ward": lambda g, i: H.dispersion(x[[*g, i]], metric) * (len(g) + 1),
        "beta-aware": lambda g, i: H.dispersion(x[[*g, i]], metric) / H.dispersion(x, metric),
    }
    for strategy, of in cost.items():
        left, want = list(range(40)), []
        for size in H.group_sizes(40, 2, 6):
            g = [left.pop(0)]
            while len(g) < size:
                g.append(min(left, key=lambda i: (round(of(g, i), 9), i)))
                left.remove(g[-1])
            want.append(sorted(g))
        assert H.group(x, np.ones(40), strategy, 2, 6, metric) == want
    order, left = [0], list(range(1, 40))
    while left:
        order.append(min(left, key=lambda i: (round(H.distances(x[order[-1:]], x[i : i + 1], metric)[0, 0], 9), i)))
        left.remove(order[-1])
    assert H.metric_walk(x, metric) == order


def test_hierarchies_over_many_leaves(spark):
    """More leaves than may be sent as queries of neighbours."""
    n = 20_000
    x = np.random.default_rng(7).normal(size=(n, 2))
    leaves = spark.createDataFrame([(i, v.tolist(), 1, 0.0) for i, v in enumerate(x)], "cluster_id long, centroid array<double>, members long, dispersion double")
    nodes = H.build_each(leaves, ("recursive-top-down", "greedy-pack"), 2, 5).where("parent IS NULL").collect()
    assert sorted((r.strategy, r.members) for r in nodes) == [("greedy-pack", n), ("recursive-top-down", n)]
