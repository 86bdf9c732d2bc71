"""Steps of a search that go over batches, and frontiers without leaves that can't be results."""

import numpy as np
import pandas as pd

from vectorgrove.plans import indexer, search


def test_candidates_of_a_query_over_two_batches():
    r = np.random.default_rng(3)
    rows = pd.DataFrame([(q, bytes([q, c]), 1, r.normal(size=3).tolist()) for q in range(3) for c in range(4)], columns=["qid", "child", "depth", "embedding"])
    of = lambda *frames: pd.concat(search._geometry(2)(iter(frames)))["child"].tolist()
    whole = of(rows)
    assert of(rows[:6], rows[6:7], rows[7:]) == whole and len(whole) == 6
    assert whole[::2] == [bytes([q, 0]) for q in range(3)]


def test_frontier_keeps_no_more_leaves_than_results(spark, monkeypatch):
    """A root over 30 leaves and a branch that is never worth a visit; two results are asked for."""
    schema = "parent binary, level int, pos int, child binary, child_level int, embedding array<float>"
    leaves = [(b"root", 2, i, bytes([i]), 0, [1.0, i / 10]) for i in range(30)]
    edges = spark.createDataFrame([*leaves, (b"root", 2, 30, b"branch", 1, [-1.0, 0.0]), (b"branch", 1, 0, b"x", 0, [-1.0, 0.1])], schema)
    kept, keep = [], search.checkpoint_in_place
    monkeypatch.setattr(search, "checkpoint_in_place", lambda df: kept.append(keep(df)) or kept[-1])
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, target array<float>")
    results, told = search.best_first(indexer.Index(b"root", None, edges), queries, 4, 2)
    assert [(r.position, bytes(r.leaf)) for r in results.orderBy("position").collect()] == [(0, b"\x00"), (1, b"\x01")]
    assert told.first().visited == 1 and kept[-1].where("level = 0").count() == 2


def test_sizes_of_blocks_that_were_made_twice(spark):
    made = spark.createDataFrame([(b"a", b"xyz"), (b"b", b"x"), (b"a", b"xyz")], "block_id binary, bytes binary")
    got = indexer.Index(b"a", made.dropDuplicates(["block_id"]), None, 2, made).sizes().collect()
    assert sorted((bytes(r.block_id), r.size) for r in got) == [(b"a", 3), (b"b", 1)]
