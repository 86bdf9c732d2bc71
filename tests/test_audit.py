"""Hashes, fingerprints, trees, alignment and profiles on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorgrove.operators import identity, panel, trees
from vectorgrove.plans import indexer
from vectorgrove.plans.profiles import profile
from vectorgrove.sources.blocks import BlockTable
from vectorgrove.streaming.accumulate import StreamingPca


def plain_hash(vector, seed, start, factor, bits, before):
    h = (start ^ seed) & (2**64 - 1)
    for w in np.array(vector, np.float32).view(np.uint32).tolist():
        turn = lambda x: (x << bits | x >> (64 - bits)) & (2**64 - 1)
        h = (turn(h ^ w) if before else turn(h) ^ w) * factor % 2**64
    return h


def test_hashes_and_their_order(spark):
    r = np.random.default_rng(1)
    vectors = r.normal(size=(40, 5)).astype(np.float32)
    want = [plain_hash(v, 7, *identity.EMBEDDING_HASH, True) for v in vectors]
    assert identity.hashes(vectors, 7).tolist() == want
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    chunks = {x.vec_id: x.chunk for x in identity.shuffled_chunks(df, 8).collect()}
    order = sorted(range(40), key=lambda i: (want[i], i))
    assert chunks == {i: k // 8 for k, i in enumerate(order)}
    got = {x.vec_id: x.c for x in df.select("vec_id", identity.fixture_cluster(F.col("embedding"), 6, 3).alias("c")).collect()}
    assert got == {i: plain_hash(v, 3, *identity.FIXTURE_HASH, False) % 6 for i, v in enumerate(vectors)}


def test_fingerprints_see_order_and_content(spark):
    df = spark.range(1000).withColumn("t", F.col("id").cast("string"))
    one = identity.whole(identity.fingerprint(df, ["id"], F.col("t"), 16), 4)
    assert one == identity.whole(identity.fingerprint(df.repartition(7), ["id"], F.col("t"), 16), 4)
    changed = df.withColumn("t", F.when(F.col("id") == 500, "x").otherwise(F.col("t")))
    moved = df.withColumn("id", 999 - F.col("id"))
    for other in (changed, moved, df.where("id < 999")):
        again = identity.whole(identity.fingerprint(other, ["id"], F.col("t"), 16), 4)
        assert again != one
        with pytest.raises(identity.ReplayMismatch):
            identity.require_same_pass(one, again)
    assert identity.whole(identity.fingerprint(df.limit(0), ["id"], F.col("t"))) is None


def test_traversal_of_shared_children_and_cycles(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    found = {x.node: (x.depth, x["references"], x.children) for x in trees.traverse(edges, spark.createDataFrame([("r",)], "node string")).collect()}
    assert found == {"r": (0, 0, 2), "a": (1, 2, 1), "b": (1, 1, 1), "c": (2, 2, 1)}
    assert {x.node for x in trees.root_of(edges).collect()} == {"r", "x"}
    assert [x.parent for x in trees.over_cap(edges, 1).collect()] == ["r"]
    assert trees.balanced_tree(spark.range(1), ["id"], 4).count() == 0


def test_alignment(spark):
    df = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(5)], "vec_id long, embedding array<float>")
    made = panel.aligned(df, 4).where("synthetic").collect()
    assert len(made) == 3 and all(abs(np.linalg.norm(r.embedding) - 5) < 1e-9 for r in made)
    assert panel.aligned(df, 5, "strict").count() == 5
    for leaf, policy in ((4, "strict"), (5, "padding")):
        with pytest.raises(ValueError):
            panel.aligned(df, leaf, policy)
    with pytest.raises(ValueError):
        panel.require_spec((2, "f32le"), (3, "f32le"))


def test_quantized_halves_go_to_even(spark):
    row = spark.createDataFrame([([127.0, 0.5, 1.5, -2.5, 0.0],), ([0.0, 0.0],)], "v array<double>").select(panel.quantized(F.col("v")).alias("q")).select("q", panel.dequantized(F.col("q")).alias("b")).collect()
    assert row[0].q.codes == [127, 0, 2, -2, 0] and row[1].q.codes == [0, 0] and row[1].q.scale == 1.0 and row[0].b[0] == 127.0


def test_profiles_build_different_indexes(spark):
    r = np.random.default_rng(4)
    items = [(i, v.tolist(), {"a": "b"}, "text/plain", b"x") for i, v in enumerate(r.normal(size=(300, 4)).astype(np.float32))]
    leaves = indexer.leaves(spark.createDataFrame(items, "idx long, embedding array<float>, metadata map<string,string>, media_type string, body binary"))
    built = {v: indexer.build(leaves, v, 1024) for v in ("0.1.0", "0.8.0")}
    assert built["0.1.0"].root != built["0.8.0"].root
    assert built["0.1.0"].root == indexer.build(leaves.repartition(5), "0.1.0", 1024).root
    for index in built.values():
        assert trees.over_cap(index.edges, index.bound).count() == 0
        assert index.edges.where("child_level = 0").select("child").distinct().count() == 300
    assert profile("0.1.0").algorithm == "spherical-kmeans"


def test_greedy_packing():
    x = np.array([[0.0], [10.0], [1.0], [11.0], [2.0]])
    assert indexer._packed(x, 3).tolist() == [0, 1, 0, 1, 0]
    assert indexer._packed(x, 2).tolist() == [0, 1, 0, 1, 2]


def test_compaction_and_recovery(spark, tmp_path):
    table = BlockTable(spark, str(tmp_path / "t"))
    table.put(spark.createDataFrame([(bytes([i]), bytes([i, i])) for i in range(20)], "block_id binary, bytes binary"))
    table.compact(1)
    assert table.ids().count() == 20
    (tmp_path / "t").rename(tmp_path / "t.old")
    table.recover()
    assert table.ids().count() == 20


def test_streaming_moments_survive_a_restart(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = str(tmp_path / "moments")
    first = StreamingPca(path)
    first.update(df.where("vec_id < 30"), 0)
    again = StreamingPca(path)
    again.update(df.where("vec_id >= 30"), 1)
    again.update(df.where("vec_id >= 30"), 1)
    model = again.model(spark)
    assert np.allclose(model.mean, np.array([v for _, v in rows]).mean(0))
