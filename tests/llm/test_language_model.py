"""Deleted interpolation against a version with plain dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from vectorgrove.llm import language_model as lm

WORDS = ["the", "The", "of", "a", "river", "stone", "é", "漢字", "x1", "end", "\x00", "walks", "light"]


def texts(n, seed=3):
    r = random.Random(seed)
    out = [None, "", "  ", "only", "long " * 4000, "same words here", "same words here"]
    while len(out) < n:
        out.append(" ".join(r.choices(WORDS + [f"rare{r.randrange(400)}"], k=r.randint(0, 40))))
    return out


def tokens_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute_scores(rows):
    """Scores of (id, text) rows, with counts, bins and expectation maximisation in plain loops."""
    folds = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 for i, _ in rows]
    words, pairs = {False: Counter(), True: Counter()}, {False: Counter(), True: Counter()}
    for (_, text), f in zip(rows, folds, strict=True):
        if f != 2:
            t = tokens_of(text)
            words[f == 3].update(t)
            pairs[f == 3].update(zip([None, *t], t, strict=False))
    rest, all_words, all_pairs = words[False], words[False] + words[True], pairs[False] + pairs[True]

    def shares(before, word, uni, bi):
        n = sum(uni.values())
        context = uni[before]
        return (bi[before, word] / context if context else 0.0), uni[word] / max(n, 1), min(context.bit_length(), lm.BUCKETS - 1)

    v = len(rest)
    bins = {}
    for (_, text), f in zip(rows, folds, strict=True):
        if f == 3:
            t = tokens_of(text)
            for before, word in zip([None, *t], t, strict=False):
                p2, p1, b = shares(before, word, rest, pairs[False])
                step = lambda p: 0 if not p else 1 + int(min(max(float(np.log(p / (1 / (v + 1)))) * 8, 0), 320))
                cell = bins.setdefault((b, step(p2), step(p1)), [0, 0.0, 0.0])
                cell[0] += 1
                cell[1] += p2
                cell[2] += p1
    weights = [[0.0, 0.9, 0.1]] + [[0.4, 0.5, 0.1] for _ in range(lm.BUCKETS - 1)]
    for _ in range(lm.ROUNDS):
        if not bins:
            break
        seen = [[0.0, 1.0, 1.0] if not b else [1.0, 1.0, 1.0] for b in range(lm.BUCKETS)]
        seen = [[s * q for s, q in zip(row, (0.4, 0.5, 0.1), strict=True)] for row in seen]
        for (b, _, _), (n, p2, p1) in bins.items():
            part = [w * p for w, p in zip(weights[b], (p2 / n, p1 / n, 1 / (v + 1)), strict=True)]
            for k in range(3):
                seen[b][k] += n * part[k] / sum(part)
        weights = [[x / sum(row) for x in row] for row in seen]
    out = []
    for _, text in rows:
        t, score = tokens_of(text), 0.0
        for before, word in zip([None, *t], t, strict=False):
            p2, p1, b = shares(before, word, all_words, all_pairs)
            score += math.log10(weights[b][0] * p2 + weights[b][1] * p1 + weights[b][2] / (len(all_words) + 1))
        out.append(score)
    return out


@pytest.mark.parametrize("chunk_bytes, part_rows", [(12_000_000, 500_000), (3_000, 40)])
def test_scores_equal_brute_force(spark, monkeypatch, chunk_bytes, part_rows):
    monkeypatch.setattr(lm, "PART_ROWS", part_rows)
    rows = [(i if i != 11 else None, t) for i, t in enumerate(texts(150))]
    rows += rows[5:9]
    docs = spark.createDataFrame([(i, t, 1, 2.0, 3) for i, t in rows], "doc_id long, text string, chunk int, key double, part int").repartition(3)
    found = lm.score_documents(docs, chunk_bytes=chunk_bytes).collect()
    want = sorted(((-1 if i is None else i), s) for (i, _), s in zip(rows, brute_scores(rows), strict=True))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.score) for r in found)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-9)


def test_without_training_documents(spark):
    # crc32("7") and crc32("12") leave 2
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    found = lm.score_documents(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found} == {(True, 3, 0, 0, 0.0)}


def test_varints():
    x = np.array([0, 1, 127, 128, 2**32, 2**62, 300])
    raw, ends = lm.varints(x)
    back, last = lm.unvarint(raw)
    assert back.tolist() == x.tolist() and (last + 1).tolist() == ends.tolist()
    assert lm.unvarint(lm.varints(x[:0])[0])[0].tolist() == []
    assert lm.unpack(lm.pack(-x)).tolist() == (-x).tolist()


def test_totals_beyond_32_bits():
    big = 2**33
    data = lambda words, counts: lm.varints(np.array([*np.diff(words, prepend=0), *counts]))[0].tobytes()
    rows = pa.Table.from_pylist(
        [{"key": 5, "chunk": 2, "data": data([1, 9], [big, 1])}, {"key": 5, "chunk": 3, "data": data([9], [big + 7])}, {"key": 6, "chunk": 4, "data": data([9], [3])}], schema=lm.PAIRS
    )
    found = {r["chunk"]: lm.unvarint(np.frombuffer(r["data"], np.uint8))[0].tolist() for r in lm.pair_totals(rows).to_pylist()}
    assert found == {2: [big, big + 8], 3: [big + 8, big + 7]}
    hashes = lm.pack(np.diff(np.array([3, 2**63 + 5], np.uint64), prepend=np.uint64(0)))
    frame = lm.word_totals(pd.DataFrame({"part": [0, 0], "chunk": [2, 3], "hashes": [hashes, hashes], "counts": [lm.pack(np.array([big, 1])), lm.pack(np.array([big, 2]))]}), 1)
    assert frame[["n", "v", "n_learning", "v_learning"]].iloc[-1].tolist() == [2 * big + 3, 2, big + 1, 2]
    assert lm.unpack(frame["data"].iloc[0]).reshape(3, -1).tolist() == [[0, 1], [2 * big, 3], [big, 2]]


@pytest.mark.parametrize("sub_count", [1, 5, 200_000])
def test_pair_totals_over_chunks(monkeypatch, sub_count):
    """The whole exchange in one process, with common words before dealt to several owners."""
    monkeypatch.setattr(lm, "SUB_COUNT", sub_count)
    docs = [(i, i % 7, t or "") for i, t in enumerate(texts(60, 8))]
    rows = []
    for number in range(4):
        for odd in (0, 1):
            b = lm._Builder()
            for i, f, t in docs:
                if i % 4 == number and (f == 3) == odd:
                    b.add(i, f, t)
            if b.ids:
                rows.append(dict(zip(("chunk", "documents", "words", "tokens"), (number * 2 + odd, *b.row()), strict=True)))
    sent = pd.DataFrame([w for r in rows for w in lm.Chunk(r, 2, pairs=False).word_rows(3)], columns=["part", "chunk", "hashes", "counts"])
    answers = pd.concat([lm.word_totals(g, 3) for _, g in sent.groupby("part")])
    tables = []
    for r in rows:
        c = lm.Chunk(r, 2)
        c.answered([(a.part, a.data) for a in answers[answers.chunk == r["chunk"]].itertuples()])
        tables.append(lm.pair_rows(c))
    every = pa.concat_tables(tables).sort_by([("key", "ascending")])
    totals = pa.Table.from_batches(list(lm._summed(every.to_batches(max_chunksize=7))), schema=lm.ANSWERS)
    counts, learning = Counter(), Counter()
    for _, f, t in docs:
        w = lm.words_of(t)
        (counts.update(zip([lm.END, *w], w, strict=False)) if f != 2 else None)
        (learning.update(zip([lm.END, *w], w, strict=False)) if f == 3 else None)
    word_of = {lm._hash_word(w): w for _, _, t in docs for w in lm.words_of(t)}
    for r in rows:
        mine = [{"part": a.part, "key": None, "data": a.data} for a in answers[answers.chunk == r["chunk"]].itertuples()]
        mine += [{"part": None, "key": a["key"], "data": a["data"]} for a in totals.to_pylist() if a["chunk"] == r["chunk"]]
        right = pa.Table.from_pylist(mine, schema=pa.schema([("part", pa.int32()), ("key", pa.int64()), ("data", pa.binary())]))
        c = lm._met(pa.Table.from_pylist([r], schema=lm.CHUNKS), right, 2)
        for a, b, n, k in zip(c.pair_before, c.pair_word, c.pair_total, c.pair_learning, strict=True):
            pair = word_of[int(c.hashes[a])], word_of[int(c.hashes[b])]
            assert n == counts[pair]
            if r["chunk"] & 1:
                assert k == learning[pair]


def test_joined_totals():
    """Totals for the same chunk share a row, in and out of which they come whole."""
    r = random.Random(5)
    keys = sorted(r.sample(range(2**62), 700) + [0, 2**63 - 1])
    rows = [{"chunk": c, "key": k, "data": bytes(r.choices(range(256), k=r.choice([1, 5, 300])))} for k in keys for c in r.sample(range(2, 9), 3)]
    batches = pa.Table.from_pylist(rows, schema=lm.ANSWERS).to_batches(max_chunksize=90)
    found = pa.Table.from_batches(list(lm.joined(iter(batches), 1000)))
    # 2106 totals, looked through 1080 and 1026 at a time
    assert found.num_rows == 14
    for c in range(2, 9):
        mine = found.filter(np.array(found.column("chunk")) == c)
        assert lm.apart(mine).to_pylist() == [{"key": x["key"], "data": x["data"]} for x in rows if x["chunk"] == c]
    assert not list(lm.joined(iter([]), 1000))


@pytest.mark.parametrize("joined_rows", [1, 50, 200_000])
def test_scores_from_joined_totals(spark, monkeypatch, joined_rows):
    """However many totals share a row, the scores are those of brute force; the stored totals are fewer than the chunks' keys."""
    stored = []
    real = lm.checkpoint
    monkeypatch.setattr(lm, "checkpoint", lambda df: stored.append(real(df)) or stored[-1])
    monkeypatch.setattr(lm, "JOINED_ROWS", joined_rows)
    rows = list(enumerate(texts(150)))
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_bytes=3_000).collect()
    assert np.allclose([r.score for r in sorted(found, key=lambda r: r.doc_id)], brute_scores(rows), rtol=1e-9)
    totals = stored[-1].count()
    chunks = stored[0].where("chunk IS NOT NULL").select("chunk").distinct().count()
    assert chunks > 5 and (joined_rows < 200_000 or totals <= 4 * chunks)
