"""Exact top-k against brute force, on ties, repeats, nulls, big numbers, and how much is read."""

import numpy as np
import pytest

from vectorgrove.llm import topk


def brute(ints, qid, q, k):
    return [(i, -s) for s, i in sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), i) for i, v in ints.items() if i != qid)[:k]]


@pytest.mark.parametrize("group", [8192, 2])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 37)
    monkeypatch.setattr(topk, "GROUP_QUERIES", group)
    r = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 6)))]
    rows += [(300 + i, rows[0][1]) for i in range(20)] + [(400, None), (401, [float("nan")] * 6), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (rows[5][0], rows[5][1]), (403, [1.0]), (404, [])]
    table = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "vec_id long, embedding array<double>, score long, rank int, dims int")
    vectors = topk.components(table.repartition(3))
    found = topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()
    ints = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows if i is not None and i < 400}
    for q in (i for i in ints if i % 50 == 0):
        assert [(x.rank, x.vec_id, x.score) for x in sorted((x for x in found if x.query_id == q), key=lambda x: x.rank)] == [(n + 1, i, s) for n, (i, s) in enumerate(brute(ints, q, ints[q], 5))]
    assert topk.exact_top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert topk.exact_top_k(vectors, vectors.limit(0)).count() == 0


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [(i + 1) * 2**55, (-1) ** i * 2**40]) for i in range(6)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    found = sorted(topk.exact_top_k(vectors, vectors.where("vec_id = 0"), 3).collect(), key=lambda x: x["rank"])
    assert [x.vec_id for x in found] == [1, 2, 3] and {x.score for x in found} == {2**63 - 1}
    lists = topk.Lists(np.arange(6), np.array([v for _, v in rows]))
    got = lists.top(np.array([0]), np.array([rows[0][1]]), 3, [-(2**200)])
    assert [(i, s) for _, i, s in got] == brute(dict(rows), 0, rows[0][1], 3)


@pytest.mark.parametrize("power", [1, 3])
def test_block_stops_early_and_right(power):
    r = np.random.default_rng(9)
    x = np.floor(r.normal(size=(2000, 4)) ** power * 50).astype(np.int64)
    lists = topk.Lists(np.arange(2000), x)
    for q in range(5):
        got = lists.top(np.array([q]), x[q : q + 1], 3, [-(2**200)])
        assert [(i, s) for _, i, s in got] == brute(dict(enumerate(x)), q, x[q], 3)
    assert lists.read < 0.6 * lists.offered
    # with the k-th best score known from other blocks, nothing is read where the lists begin under it
    read = lists.read
    assert lists.top(np.array([0]), x[:1], 3, [10**9]) == [] and lists.read == read


def test_bounds_pass_from_block_to_block():
    best = topk.Best(2, {7: 5})
    assert best.floor(7) == 5
    best.add([(7, 1, 9), (7, 2, 8), (7, 3, 9)])
    assert best.floor(7) == 9 and best.rows() == [(7, 1, 9), (7, 3, 9)]
    best.add([(7, 0, 9)])
    assert best.rows() == [(7, 0, 9), (7, 1, 9)]
