"""Hierarchies from below, cell replay, block entries and PCA maps on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorgrove.operators import affine, assembly, pca
from vectorgrove.sources import entries as typed
from vectorgrove.sources.blocks import block_id, branch_bytes


def units(spark, vectors, items=None):
    return spark.createDataFrame([(i, 1 if items is None else items[i], [float(x) for x in v]) for i, v in enumerate(vectors)], "unit long, items long, vector array<float>")


def test_agglomeration_merges_singletons_and_weights_means(spark):
    vectors = np.arange(14, dtype=float).reshape(7, 2)
    items = [1, 2, 3, 4, 5, 6, 7]
    groups = {0: 5, 1: 5, 2: 6, 3: 6, 4: 6, 5: 9, 6: 1}

    def grouping(layer, level):
        if level:
            return layer.select("unit", F.lit(0).alias("grp"))
        return spark.createDataFrame(list(groups.items()), "unit long, grp long")

    nodes = assembly.agglomerate(units(spark, vectors, items), grouping, 4).collect()
    parent = {r.unit: r.parent for r in nodes if r.level == 0}
    assert parent == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2}
    (root,) = [r for r in nodes if r.parent is None]
    assert (root.level, root.unit, root.items) == (2, 0, 28)
    assert np.allclose(root.vector, np.average(vectors, axis=0, weights=items), atol=1e-4)


def test_agglomeration_without_shrinking_goes_by_the_bound(spark):
    alone = lambda layer, level: layer.select("unit", F.col("unit").alias("grp"))
    nodes = assembly.agglomerate(units(spark, np.ones((11, 2))), alone, 3).groupBy("level").count()
    assert {r.level: r["count"] for r in nodes.collect()} == {0: 11, 1: 4, 2: 2, 3: 1}
    assert assembly.agglomerate(units(spark, np.ones((1, 2))), alone, 3).collect()[0].parent is None
    with pytest.raises(ValueError):
        assembly.agglomerate(units(spark, np.ones((2, 2))), alone, 1)


def test_hybrid_goes_by_items(spark):
    name = lambda k: lambda layer, level: layer.select("unit", F.lit(k).alias("grp"))
    pick = assembly.hybrid(name(1), name(2), 4)
    assert {r.grp for r in pick(units(spark, np.ones((4, 1))), 0).collect()} == {1}
    assert {r.grp for r in pick(units(spark, np.ones((2, 1)), [1, 4]), 0).collect()} == {2}


def test_replay_of_cells(spark):
    rows = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 7), ("c", 8)], "cell string, idx long")
    counts = spark.createDataFrame([("a", 1, 3), ("a", 0, 2), ("b", 4, 0), ("b", 5, 1)], "cell string, child int, n long")
    got = {r.idx: r.child for r in assembly.replayed(rows, counts).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: None, 7: 5, 8: None}


def test_total_order_tells_zeros_apart(spark):
    df = spark.createDataFrame([(0, 0.0), (1, -0.0), (2, 1.0), (3, -1.0)], "id long, x double")
    assert [r.id for r in df.orderBy(*assembly.total_order(F.col("x"))).collect()] == [3, 1, 0, 2]


def test_harvest_wants_enough(spark):
    df = spark.createDataFrame([("b", False), ("a", True), ("c", False)], "entity_id string, synthetic boolean")
    assert [r.entity_id for r in assembly.harvested(df, 2).collect()] == ["b", "c"]
    with pytest.raises(ValueError):
        assembly.harvested(df, 3)


def test_entries_of_branches_and_broken_blocks(spark):
    pairs = sorted((np.array([i, 1], "<f4").tobytes(), bytes([i]) * 32) for i in range(3))  # the order of a branch is that of bytes
    data = branch_bytes(1, 2, "f32le", pairs)
    table = lambda key, b: spark.createDataFrame([(key, b)], "block_id binary, bytes binary")
    rows = typed.entries(table(block_id(data), data)).collect()
    assert [(r.pos, r.embedding, bytes(r.child), r.metadata) for r in rows] == [(i, np.frombuffer(e, "<f4").tolist(), c, None) for i, (e, c) in enumerate(pairs)]
    for key, b in ((bytes(32), data), (block_id(data), None)):
        with pytest.raises(Exception, match="block"):
            typed.entries(table(key, b)).collect()


def test_maps_between_models():
    r = np.random.default_rng(4)
    x, y, z = (r.normal(size=(60, 5)) @ r.normal(size=(5, 5)) + r.normal(size=5) for _ in range(3))
    a, b, c = (pca.from_moments(pca.Moments.of(m)) for m in (x, y, z))
    assert np.allclose(affine.rebased(a.apply(x), a, b), b.apply(x))
    assert np.allclose(affine.chained([affine.delta(a, b), affine.delta(b, c)]).apply(a.apply(x)), c.apply(x))
    few = a.truncate(2)
    with pytest.raises(ValueError):
        affine.delta(few, b)
    assert np.allclose(affine.rebased(few.apply(x), few, b, exact=False), b.apply(few.reconstruct(few.apply(x))))
    for bits in (8, 16):
        near = affine.dequantized(a, *affine.quantized(a, bits))
        assert np.abs(near.basis - a.basis).max() < 2.0 ** (1 - bits)
    with pytest.raises(ValueError):
        affine.quantized(a, 4)
