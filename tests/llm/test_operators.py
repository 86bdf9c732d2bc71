"""Small tests of the corpus operators: against brute force, libraries and exact round trips, on nulls, empty tables and ties."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from vectorgrove.llm import language_model, mpeg_audio, neardup, packing, quality, sentencepiece_bpe, sharding, toxicity, warc
from vectorgrove.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
WORDS = ["the", "Of", "ing", "ation", "réeux", "ß", "x1", "don't", "a.", "ZZ", "漢字", "🙂", "<|endoftext|>"]


def some_texts(n, seed=0):
    r = random.Random(seed)
    out = [None, "", " ", "one", "one two three four", "a\x00b\x01c", "x" * 5000, "　wide　space\x1c."]
    while len(out) < n:
        out.append(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 60))))
    return out + out[8:12]


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, some_texts(60)).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_media_round_trip(spark, docs):
    rows = {r.doc_id: r for r in mpeg_audio.read(mpeg_audio.store(docs)).collect()}
    for d in docs.collect():
        raw = (d.text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = rows[d.doc_id]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.duration_samples == len(payload) and r.n_frames * 576 == len(payload)
    assert mpeg_audio.read(mpeg_audio.store(empty(spark))).count() == 0


def test_media_damage():
    payload = mpeg_audio.payload_of(bytes(range(256)) * 9)
    data = mpeg_audio.encode(payload, 2304)
    good = mpeg_audio.parse(data)
    assert good.payload == payload and good.crc_bad == 0 and good.table == "Xing" and good.table_frames == good.frames
    junk = mpeg_audio.parse(data[: good.offsets[1]] + b"junk\xff\xe0\x00" + data[good.offsets[1] :])
    assert junk.payload == payload and junk.junk == 7
    broken = bytearray(data)
    broken[good.offsets[2] + 4] ^= 1
    assert mpeg_audio.parse(bytes(broken)).crc_bad == 1
    assert mpeg_audio.parse(b"").frames == 0 and mpeg_audio.parse(b"\xff" * 100).frames == 0
    layer1 = mpeg_audio.parse_header(0xFFFF1000 | 4 << 12)
    assert layer1.layer == 1 and layer1.samples == 384


def test_sentencepiece_equals_library(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in sentencepiece_bpe.encode_documents(docs, path, with_ids=True).collect()}
    for d in docs.collect():
        ids = library.encode(d.text or "", add_eos=True)
        assert rows[d.doc_id].ids == ids and rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    codec = sentencepiece_bpe.codec_of(open(path, "rb").read())
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice(["a", "th", " ", "  ", "é", "漢", "\n", "▁", "🙂", "1", "==", ".", "'s"]) for _ in range(r.randint(0, 20)))
        assert codec.encode(text) == library.encode(text, add_eos=True)
        ids = [r.choice([0, 1, 2, 3 + r.randrange(256), r.randrange(32000)]) for _ in range(5)]
        assert codec.decode(ids) == library.decode(ids)


def test_common_pieces_outlast_the_memory(monkeypatch):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepiece_bpe.Codec(f.read())
    monkeypatch.setattr(sentencepiece_bpe, "CACHED_WORDS", 8)
    looked, real = [], codec._tokens_of
    monkeypatch.setattr(codec, "_tokens_of", lambda word: looked.append(word) or real(word))
    texts = [f"river stone word{i} river" for i in range(60)]
    want = [real(("▁" + t).replace(" ", "▁")) for t in (*texts, " ".join(texts))]
    assert [codec.encode(t, end=False) for t in (*texts, " ".join(texts))] == want
    assert looked.count("▁river") == looked.count("▁stone") == 1 and len(codec._words) + len(codec._older) <= 16


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 1]
        for p in sorted(by[d.doc_id], key=lambda p: p.piece):
            part = ids[p.start : p.start + p.length]
            assert p.start == p.piece * 64 and p.length == min(64, len(ids) - p.start)
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_fullest_combination():
    r = random.Random(2)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(6)}
        room = r.randint(1, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        found = packing.fullest(counts, room)
        assert sum(k * n for k, n in found) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in found)


def test_sharding(spark, docs):
    hot = docs.union(frame(spark, ["hot text"] * 150, 1000))
    rows = sharding.shard_documents(hot, shards=5).collect()
    assert len(rows) == hot.count()
    sizes, largest = Counter(), max(r["size"] for r in rows)
    for r in rows:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 5
    assert all(abs(s - mean) <= 2 * largest for s in sizes.values()) and set(sizes) <= set(range(5))
    for shard in sizes:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    texts = {d.doc_id: d.text for d in hot.collect()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
    assert sharding.shard_documents(empty(spark)).count() == 0


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block_rows", [1024, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block_rows)
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = list(some_texts(20))
    for n in (60, 100):
        base = [r.choice(words) for _ in range(n)]
        for _ in range(40):
            copy = list(base)
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(n)] = r.choice(words)
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else "  ".join(copy))
    passage = " ".join(r.choice(words) for _ in range(60))
    texts += [passage + " " + " ".join(r.choice(words) for _ in range(120)) for _ in range(15)]
    docs = frame(spark, texts)
    rows = neardup.near_duplicates(docs).collect()
    want = brute_components(dict(enumerate(texts)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows if x.doc_id is not None} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in rows if x.doc_id is not None)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, (_, c) in want.items() if c == i} | {None}


@pytest.mark.parametrize("changed, gone", [(9, True), (11, True), (12, False)])
def test_pipeline_links_from_80_percent(spark, changed, gone):
    import corpus_pipeline

    # the last ``changed`` words differ, and with them as many of 100 shingles
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words), " ".join(words[: 104 - changed] + [f"v{i}" for i in range(changed)])]
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(100)} for t in texts)
    assert (100 * len(a & b) >= 80 * len(a | b)) == gone and 100 * len(a & b) < 85 * len(a | b)
    docs = frame(spark, texts)
    kept = {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()}
    assert kept == ({0, None} if gone else {0, 1, None})
    assert neardup.keep_one(docs).count() == 3


def test_few_near_duplicates_are_missed():
    for percent, least in neardup.MATCHES.items():
        p = percent / 100
        assert sum(math.comb(neardup.K, i) * p**i * (1 - p) ** (neardup.K - i) for i in range(least)) < 1e-6


def test_keep_one_beside_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(i, text, 1, 2, 3, 4) for i in (4, 2, 9)], "doc_id long, text string, gone int, _Gone int, cls int, component int")
    assert [(r.doc_id, r.gone) for r in neardup.keep_one(docs).collect()] == [(2, 1)]


def test_near_duplicates_without_rows(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, j) for j in range(51, 90)] + [(7, 7), (None, 3), (101, 100)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(31)} | {i: 50 for i in range(50, 90)} | {100: 100, 101: 100}
    assert found == want


def test_language_model(spark, docs):
    rows = {r.doc_id: r for r in language_model.score_documents(docs, chunk_bytes=2000).collect()}
    tokens, counts = {}, Counter()
    for d in docs.collect():
        text = re.sub("[A-Z]", lambda m: m[0].lower(), d.text or "")
        tokens[d.doc_id] = [*re.findall("[^\x20\x09-\x0d]+", text), None]
        if zlib.crc32(str(d.doc_id if d.doc_id is not None else "").encode()) % 7 != 2:
            counts.update(tokens[d.doc_id])
    n, v = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.train_tokens == n
        assert (r.n_tokens, r.n_known) == (len(words), sum(counts[w] > 0 for w in words))
        assert r.score < 0
    whole = {r.doc_id: r.score for r in language_model.score_documents(docs).collect()}
    assert all(math.isclose(whole[i], rows[i].score, rel_tol=1e-6) for i in rows)
    assert language_model.score_documents(empty(spark)).count() == 0


def labelled(spark, n=400):
    r = random.Random(6)
    plain = ["river", "stone", "walks", "under", "light", "garden", "the", "and", "slow"]
    bad = ["grumblefoot", "vilewort", "snarkling"]
    docs, labels = [], []
    for i in range(n):
        toxic, poor = i % 4 == 0, i % 5 == 0
        words = [r.choice(plain) for _ in range(40)]
        if toxic:
            for _ in range(4):
                words[r.randrange(40)] = r.choice(bad)
        docs.append((i, " ".join(w + "###" if poor else w for w in words), "en", "s", None, 0.5))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame([*docs, (n, None, None, None, None, None)], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    for column, module in (("quality", quality), ("toxic", toxicity)):
        model = module.fit(docs, labels)
        rows = module.score_documents(docs, model).collect()
        assert len(rows) == 401 and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        held = [r for r in rows if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id][column] for r in held) >= 0.95 * len(held)
    kept = quality.keep_good(docs, quality.fit(docs, labels))
    assert kept.columns == docs.columns and kept.count() < 401


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark, 10)
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()} == {0}
    assert {r.predicted for r in quality.score_documents(docs, quality.fit(docs, none)).collect()} == {1}
    assert quality.score_documents(empty(spark), quality.fit(docs, labels)).count() == 0


def test_revisits(spark):
    tag = {"etag": '"1"'}
    rows = [
        (1, "http://www.A.com/x/?utm_a=1&b=2&a=1#f", 10, "response", 200, "d1", {"etag": '"1"', "server": "s", "date": "old"}),
        (2, "https://a.com:443/x?a=1&b=2", 20, "revisit", 304, None, {"etag": 'W/"1"', "date": "new", "server": "t"}),
        (3, "https://a.com/x?a=1&b=2", 10, "revisit", 304, None, tag),
        (4, "https://a.com/x?a=1&b=2", 30, "revisit", 304, None, {"etag": '"2"'}),
        (5, "https://a.com/x?a=1&b=2", 30, "revisit", 304, None, None),
        (6, "https://a.com/x?a=1&b=2", 15, "response", 404, "d6", tag),
        (7, None, 30, "revisit", 304, None, tag),
        (8, "https://a.com/x?a=1&b=2", None, "revisit", 304, None, tag),
    ]
    hot = [(100 + i, "http://hot/", 100 + i, "response" if i % 3 == 0 else "revisit", 200, f"h{i}", tag) for i in range(90)]
    schema = "record_id long, url string, date long, kind string, status int, digest string, headers map<string,string>"
    for parts in (1, 7):
        found = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows + hot, schema), parts).collect()}
        assert {i: (found[i].outcome, found[i].refers_to) for i in (2, 3, 4, 5, 7, 8)} == {2: ("resolved", 1), 3: ("missing", None), 4: ("mismatch", None), 5: ("unvalidated", 1), 7: ("missing", None), 8: ("missing", None)}
        assert found[2].headers == {"etag": 'W/"1"', "server": "s", "date": "new"} and found[2].digest == "d1"
        assert all(found[100 + i].refers_to == 100 + i - i % 3 for i in range(90) if i % 3)
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_archive_records(spark, tmp_path):
    http = b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(http) + http + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record * 2 + record[:60])
    rows = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.kind, r.status, r.headers) for r in rows] == [("revisit", 304, {"etag": '"1"'})] * 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs = docs.drop("score")
    twin = docs.where("doc_id in (1, 2, 3)").selectExpr("doc_id + 5000 as doc_id", "text", "lang", "source", "n_chars")
    docs.union(twin).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    good = {i for i in range(400) if i % 4 and i % 5}
    assert len(good & ids) >= 0.98 * len(good) and len(ids - good) <= 5
    assert not ids & {5001, 5002, 5003}
