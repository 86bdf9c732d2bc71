"""Operators outside the optional subpackages: codecs, stores, clustering invariants, index and search."""

import itertools
import zipfile

import numpy as np
import pytest

from vectorgrove.functions import cbor, codecs
from vectorgrove.operators import aggregates, clustering, evaluation, neighbors, pca
from vectorgrove.plans import indexer, profiles, search
from vectorgrove.sources import blocks
from vectorgrove.streaming.accumulate import StreamingPca


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(200, 6)) + np.repeat(r.normal(size=(4, 6)) * 4, 50, axis=0)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()


def table(df):
    return neighbors.collected(df, "vec_id", "embedding")


def test_cbor_is_canonical():
    value = {10: [1.5, -1, 1 << 40], "b": {"long key": None, "a": True}, 0: b"\x00"}
    data = cbor.encode(value)
    assert cbor.decode(data) == value
    assert data.startswith(b"\xa3\x00\x41\x00\x0a")
    for bad in (b"\x18\x01", b"\xa2\x01\x01\x01\x02", b"\x01\x01", b"\x9f\xff", b"\xfb" + b"\x3f\xf8" + b"\x00" * 6):
        with pytest.raises(ValueError):
            cbor.decode(bad)


def test_payload_codecs():
    x = np.random.default_rng(1).normal(size=(30, 7)).astype(np.float32)
    for policy in codecs.POLICIES:
        payloads, descriptor = codecs.encode_block(x, policy, 12)
        back = codecs.decode_block(payloads, 7, descriptor)
        assert np.abs(back - x).max() < (1e-5 if "uniform" not in policy and "variable" not in policy else 0.05)
    with pytest.raises(ValueError):
        codecs.unpack(b"\xff", np.array([3]))
    assert codecs.variable_bits(np.array([0.0, 1.0, 3.0]), 4).sum() == 12
    assert codecs.pack(codecs.codes(np.array([1.0, -1.0]), np.array([1.0, 1.0]), 2), np.array([2, 2])) == bytes([0b0111])


def test_blocks():
    data = blocks.branch_bytes(1, 2, "i8", [(b"\x05\x00", b"b" * 32), (b"\x01\x00", b"a" * 32)])
    found = blocks.parse(data, blocks.block_id(data))
    assert [e[0] for e in found["entries"]] == [b"\x01\x00", b"\x05\x00"]
    with pytest.raises(ValueError):
        blocks.parse(data, b"\x00" * 32)
    with pytest.raises(ValueError):
        blocks.branch_bytes(1, 2, "i8", [(b"\x05\x00", b"b" * 32)] * 2)
    n = blocks.capacity(64, 8192)
    entries = [(bytes(256), i.to_bytes(32)) for i in range(n + 1)]
    assert len(blocks.branch_bytes(1, 64, "f32le", entries[:n])) <= 8192 < len(blocks.branch_bytes(1, 64, "f32le", entries))


def test_stores(spark, tmp_path):
    data = [blocks.leaf_bytes(1, bytes([i, 0, 0, 0]), {"n": i}, "text/plain", b"x") for i in range(5)]
    rows = [(bytearray(blocks.block_id(d)), bytearray(d)) for d in data]
    store = blocks.BlockTable(spark, str(tmp_path / "table"))
    assert store.ids().count() == 0
    frame = spark.createDataFrame(rows, blocks.BLOCKS)
    store.put(frame.limit(3))
    store.put(frame)
    assert store.blocks().count() == 5 == store.ids().count()
    store.compact(1)
    assert store.blocks().count() == 5
    missing = spark.createDataFrame([(bytearray(32),), (rows[0][0],)], "block_id binary")
    assert sorted(r.bytes is None for r in store.get(missing).collect()) == [False, True]
    other = spark.createDataFrame([(rows[0][0], bytearray(b"other"))], blocks.BLOCKS)
    assert {bytes(r.block_id): bytes(r.bytes) for r in blocks.overlay([other, frame]).collect()}[bytes(rows[0][0])] == b"other"
    assert blocks.verified(frame).count() == 5
    with pytest.raises(Exception, match="match"):
        blocks.verified(other).collect()
    for d in data:
        name = blocks.block_id(d).hex()
        (tmp_path / "fs" / name[:2] / name[2:4]).mkdir(parents=True)
        (tmp_path / "fs" / name[:2] / name[2:4] / f"{name}.cbor").write_bytes(d)
        with zipfile.ZipFile(tmp_path / "a.zip", "a") as z:
            z.writestr(f"{name[:2]}/{name[2:4]}/{name}.cbor", d)
    for found in (blocks.read_sharded(spark, str(tmp_path / "fs")), blocks.read_archive(spark, str(tmp_path / "a.zip"))):
        assert {bytes(r.block_id): bytes(r.bytes) for r in found.collect()} == {blocks.block_id(d): d for d in data}


def test_pca(spark, vectors):
    _, x = table(vectors)
    m = pca.fit(vectors)
    assert np.allclose(np.cov(x, rowvar=False), m.basis @ np.diag(m.variance) @ m.basis.T)
    assert m.orthonormality_error() < 1e-9 and m.rank == 6 and abs(m.cumulative_variance() - 1) < 1e-12
    assert all(c[np.argmax(np.abs(c))] > 0 for c in m.basis.T)
    assert np.allclose(m.reconstruct(m.apply(x)), x)
    parts = [pca.Moments.of(p) for p in np.array_split(x, 3)]
    merged = parts[0].merge(parts[1]).merge(parts[2])
    assert np.allclose(merged.scatter, pca.Moments.of(x).scatter)
    sizes = pca.chunk(vectors, 7).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in sizes) == [28, 28, 28, 29, 29, 29, 29]
    same = spark.createDataFrame([(i, [5.0, 5.0]) for i in range(4)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        pca.chunk(same, 2)
    with pytest.raises(ValueError):
        pca.fit(same.limit(1))


def test_clusterings(spark, vectors):
    model = clustering.spherical_kmeans(vectors, 4)
    assert model.assign(vectors).groupBy("cluster_id").count().count() == 4 and 0 <= model.quality < 1
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.cluster_id for r in clustering.spherical_kmeans(two, 2).assign(two).orderBy("vec_id").collect()] == [0, 1]
    _, members = clustering.balanced_clustering(two, 2)
    assert members["cluster_id"].tolist() == [0, 1]
    _, members = clustering.balanced_clustering(vectors, 4, 40, 60)
    assert members.groupby("cluster_id").size().between(40, 60).all()
    with pytest.raises(ValueError):
        clustering.balanced_clustering(vectors, 4, 60, 60)
    four = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [10.0, 0.0]), (3, [11.0, 0.0])], "vec_id long, embedding array<float>")
    found = clustering.directional_pca(four, 2, 1)
    assert [r.cluster_id for r in found.assign(four).orderBy("vec_id").collect()] == [0, 0, 1, 1]
    same = spark.createDataFrame([(i, [5.0, 5.0]) for i in range(4)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="rank 0"):
        clustering.directional_pca(same, 2)


def test_balanced_assignment_is_cheapest():
    r = np.random.default_rng(3)
    for _ in range(20):
        cost = r.random((6, 3))
        got = clustering.balanced_assignment(cost, 1, 3)
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.product(range(3), repeat=6) if all(1 <= p.count(c) <= 3 for c in range(3)))
        assert abs(cost[np.arange(6), got].sum() - best) < 1e-9


def test_bins():
    assert clustering.log_bits(np.array([8.0, 1.0, 0.0]), 8) == [4, 2, 1] or np.prod(clustering.log_bits(np.array([8.0, 1.0, 0.0]), 8)) == 8
    with pytest.raises(ValueError):
        clustering.log_bits(np.array([1.0]), 6)
    cuts = clustering.valley_cuts(np.array([9, 9, 0, 0, 9, 9]), 0.0, 6.0, 2)
    assert len(cuts) == 1 and 2 <= cuts[0] <= 4


def test_metrics(spark):
    members = spark.createDataFrame([("a", 0, False), ("b", 0, False), ("c", 1, False), ("p", 1, True)], "entity_id string, cluster_id long, synthetic boolean")
    near = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "p")], "entity_id string, neighbor_id string")
    assert evaluation.same_leaf_coherence(members, near).first().coherence == 0.5
    assert evaluation.same_leaf_coherence(members, near.limit(0)).first().coherence == 0
    occ = aggregates.occupancy(members, 3, "cluster_id", "synthetic")
    assert [(r.total, r.real, r.synthetic) for r in occ.orderBy("cluster_id").collect()] == [(2, 2, 0), (2, 1, 1), (0, 0, 0)]
    assert [r["rank"] for r in evaluation.ranked(spark.createDataFrame([("b", 1.0), ("a", 1.0)], "id string, score double")).orderBy("id").collect()] == [1, 2]


def test_profiles():
    assert len(profiles.PROFILES) == 37 and profiles.profile("0.8.0").rank_zero_fallback and profiles.profile("0.4.9").exact
    with pytest.raises(ValueError):
        profiles.profile("9.9.9")


@pytest.mark.parametrize("version", ["0.4.0", "0.6.1", "0.8.0"])
def test_index_and_search(spark, vectors, version):
    items = vectors.selectExpr("vec_id AS idx", "embedding", "map('n', string(vec_id)) AS metadata", "'text/plain' AS media_type", "encode('x', 'utf-8') AS body")
    leaves = indexer.leaves(items)
    index = indexer.build(leaves, version, 1024)
    stored = {bytes(r.block_id): blocks.parse(bytes(r.bytes), bytes(r.block_id)) for r in index.blocks.collect()}
    seen, todo, found = set(), [index.root], 0
    while todo:
        b = todo.pop()
        assert b not in seen
        seen.add(b)
        if stored[b]["level"]:
            todo += [e[1] for e in stored[b]["entries"]]
        else:
            found += 1
    assert found == 200 and seen == set(stored)
    assert indexer.build(leaves.repartition(3), version, 1024).root == index.root
    queries = vectors.where("vec_id % 40 = 0").selectExpr("vec_id AS qid", "embedding AS target")
    ids = {r.idx: bytes(r.child) for r in leaves.collect()}
    results, told = search.best_first(index, queries, 500, 5)
    top = {(r.qid, r.position): bytes(r.leaf) for r in results.collect()}
    assert all(top[q, 0] == ids[q] for q in range(0, 200, 40)) and len(top) == 25
    assert {r.termination for r in told.collect()} == {"success"}
    beam = search.greedy_beam(index, queries, 500, 5).collect()
    exact = {(r.qid, r.rk): r.id for r in neighbors.knn(vectors, vectors.where("vec_id % 40 = 0"), 5, exclude_self=False).collect()}
    if version == "0.4.0":
        assert {(r.qid, r.rk): bytes(r.leaf) for r in beam} == {k: ids[i] for k, i in exact.items()}
    few, told = search.best_first(index, queries, 1, 500)
    assert few.count() == 0 and {r.termination for r in told.collect()} == {"exhausted"}
    with pytest.raises(ValueError):
        search.best_first(index, queries, 0, 5)


@pytest.mark.parametrize("tops", [60, 40])
def test_large_partitions_split_as_small_ones(spark, tops):
    """All vectors equal, or so many at the top of the only axis that no cut lies below it."""
    rows = spark.createDataFrame([(i, "p0", [float(i < tops), 0.0]) for i in range(60)], "idx long, part string, embedding array<float>")
    p = profiles.profile("0.8.0")
    large = {r.idx: r.next for r in indexer._split_large(rows, "p0", 60, 2 if tops < 60 else 8, p).collect()}
    assert large == {r.idx: r.next for r in indexer._split(rows, 2 if tops < 60 else 8, p).collect()}
    assert len(large) == 60 and len(set(large.values())) > 1
    if tops == 60:
        with pytest.raises(ValueError, match="rank 0"):
            indexer._split_large(rows, "p0", 60, 8, profiles.profile("0.7.0"))


def test_neighbours_of_more_queries_than_a_block(spark, vectors, monkeypatch):
    monkeypatch.setattr(neighbors, "MAX_BROADCAST_ROWS", 100)
    monkeypatch.setattr(neighbors.collected, "__defaults__", (100,))
    ids, x = vectors.toPandas()["vec_id"].to_numpy(), np.array(vectors.toPandas()["embedding"].tolist(), np.float64)
    d = neighbors.distances(x, x, "cosine")
    np.fill_diagonal(d, np.inf)
    want = {(int(ids[q]), rk + 1): int(ids[i]) for q in range(200) for rk, i in enumerate(np.lexsort((ids, d[q]))[:3])}
    assert {(r.qid, r.rk): r.id for r in neighbors.knn(vectors, vectors, 3).collect()} == want


@pytest.mark.parametrize("version", ["0.2.0", "0.3.10", "0.4.9"])
def test_exact_profiles_refuse_fewer_cells(version):
    x = np.array([[float(i < 40), 0.0] for i in range(60)])
    p = profiles.profile(version)
    assert p.exact
    with pytest.raises(ValueError, match="cells for 4 clusters"):
        indexer._split_small(x, 4, p)


def test_streaming_pca(spark, vectors, tmp_path):
    vectors.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(vectors.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    acc = StreamingPca()
    acc.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert len(acc.by_batch) > 1 and np.allclose(acc.model().variance, pca.fit(vectors).variance)
