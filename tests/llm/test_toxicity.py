"""The label model against plain loops, voters on small texts, and fitting over partitions against fitting in one place."""

import numpy as np
import pytest

from vectorgrove.llm import toxicity as tx


def sampled(n=3000, seed=5):
    """Votes of seven voters: two good ones, a copy of the second, noise, one that often says nothing, and two good ones more."""
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.3).astype(int)
    flip = lambda p: np.where(r.random(n) < p, 1 - y, y)
    a, b, noise = flip(0.1), flip(0.15), r.integers(0, 2, n)
    copy = np.where(r.random(n) < 0.03, 1 - b, b)
    seldom = np.where(r.random(n) < 0.6, tx.ABSTAIN, flip(0.05))
    return y, np.column_stack([a, b, copy, noise, seldom, flip(0.08), flip(0.1)])


def test_posterior_and_counts_in_plain_loops():
    _, votes = sampled(40)
    model = tx.LabelModel(0.3, [-1, 0, 1, 1, 2, 0, 5], np.random.default_rng(1).dirichlet([1, 1, 1], size=(7, 2, 3)))
    weight = np.arange(40.0)
    want, joint = [], np.zeros((2, 21, 21))
    for row, w in zip(votes, weight, strict=True):
        p = [0.7, 0.3]
        for y in (0, 1):
            for j, parent in enumerate(model.parents):
                p[y] *= model.chance[j, y, row[parent] if parent >= 0 else 0, row[j]]
        want.append(p[1] / sum(p))
        for y in (0, 1):
            for i in range(7):
                for j in range(7):
                    joint[y, 3 * i + row[i], 3 * j + row[j]] += w * p[y] / sum(p)
    assert np.allclose(model.posterior(votes), want)
    assert np.allclose(model.expected(votes, weight), joint)


def test_accuracies_and_correlations_are_found():
    y, votes = sampled()
    model = tx.fit_label_model(votes, np.ones(len(votes)), 0.2)
    assert abs(model.prior - y.mean()) < 0.05
    assert model.parents[1] == 2 or model.parents[2] == 1
    strongest = max(model.correlations, key=lambda c: c[2])
    assert set(strongest[:2]) == {1, 2}
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.9
    # chances of the first voter, which has no parent
    assert abs(model.chance[0, 1, 0, tx.TOXIC] - 0.9) < 0.06 and abs(model.chance[0, 0, 0, tx.TOXIC] - 0.1) < 0.06


def test_likelihood_never_falls():
    _, votes = sampled(500)
    model, last = tx.started(7, 0.3), -np.inf
    for _ in range(10):
        likelihood = 0.0
        for row in votes:
            p = [1 - model.prior, model.prior]
            for k in (0, 1):
                for j in range(7):
                    p[k] *= model.chance[j, k, 0, row[j]]
            likelihood += np.log(sum(p))
        # smoothing towards the start costs a little
        assert likelihood > last - 1
        last = likelihood
        model = tx.improved(model, model.expected(votes, np.ones(500)), False)


@pytest.mark.parametrize(
    "text, name", [("some sl*g here", "masked"), ("s l u g s", "spaced"), ("what?! no", "marks"), ("sluuuuug", "stretched"), ("you are slug", "addressed"), ("slug slug", "repeated"), ("HE SAID LOUD THINGS TO ALL OF THEM", "shouting")]
)
def test_pattern_voters(text, name):
    voting = tx.Voting({"0slug": 4.0})
    votes, features = voting.seen(text)
    assert votes[tx.VOTERS.index(name)] == tx.TOXIC and len(features) == tx.FEATURES
    assert voting.seen("plain words " * 20)[0][tx.VOTERS.index(name)] == tx.ABSTAIN


def test_shouting_counts_letters_of_whole_texts():
    voting, at = tx.Voting({"0slug": 4.0}), tx.VOTERS.index("shouting")
    loud = "HE SAID LOUD THINGS TO ALL OF THEM " * 20
    r = np.random.default_rng(8)
    texts = ["then " + loud, "quiet words " * 17 + loud, loud + "quiet words " * 400, "ÀÉÎÕÜÑÇ " * 9 + "été ", "ÀÉÎÕÜÑÇ " * 9 + "àéîõüñç " * 10, "A" * 20, "A" * 21, "A" * 21 + "b" * 21]
    texts += ["".join(r.choice(list("ABCdefÀßéΩω1 ǅ字ª"), 90)) for _ in range(200)]
    for text in texts:
        capitals = sum(c.isupper() for c in text)
        want = capitals > 20 and capitals > sum(c.islower() for c in text)
        assert (voting.seen(text)[0][at] == tx.TOXIC) == want, text
    assert voting.seen(texts[0])[0][at] == tx.TOXIC != voting.seen(texts[2])[0][at]


def test_lexicon_voters_abstain_below_the_share():
    voting = tx.Voting({"0slug": 4.0, "1slug": 2.0})
    votes = {n: dict(zip(tx.VOTERS, voting.seen("slug " + "word " * n)[0], strict=True)) for n in (1, 1000)}
    assert votes[1]["word"] == tx.TOXIC and votes[1000]["word"] == tx.ABSTAIN and votes[1]["begin-5"] == tx.CLEAN
    assert dict(zip(tx.VOTERS, voting.seen("sl0w r1ver")[0], strict=True))["unmasked"] == tx.CLEAN
    assert dict(zip(tx.VOTERS, tx.Voting({"0idiot": 4.0}).seen("1d10t")[0], strict=True))["unmasked"] == tx.TOXIC
    assert len(tx.VOTERS) >= 20 and voting.seen("")[0][-1] == tx.ABSTAIN


def test_patterns_have_numbers():
    r = np.random.default_rng(3)
    votes = r.integers(0, 3, (50, len(tx.VOTERS)))
    assert (tx.votes_of(tx.pattern_number(votes)) == votes).all()


def test_nulls_long_texts_and_clashing_names(spark):
    rows = [(i, ("vilewort slow river " if i % 3 == 0 else "river stone walks ") * (5000 if i == 7 else 4), i, "x") for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:3], (None, "vilewort", 1, "y"), (90, None, 1, "y")], "doc_id long, text string, label int, votes string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 7) for i in range(60)] + [(None, 1, 7), (3, None, 7)], "doc_id long, toxic int, label int")
    model = tx.fit(docs, labels)
    found = tx.score_documents(docs, model).collect()
    assert len(found) == 65 and {r.predicted for r in found if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 3 == 0} == {1}
    assert {r.predicted for r in found if r.doc_id in (7, 90)} == {0}
    kept = tx.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(60) if i % 3} | {90}
    assert tx.score_documents(docs.limit(0), model).count() == 0
    assert {r.predicted for r in tx.score_documents(docs, tx.fit(docs.limit(0), labels)).collect()} == {0}


def test_texts_are_looked_at_once(spark, monkeypatch):
    rows = [(i, ("vilewort slow river " if i % 3 == 0 else "river stone walks ") * 4, 1) for i in range(60)]
    docs = spark.createDataFrame([*rows, *rows[:3], (None, "vilewort", 1), (90, None, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    want = sorted(tx.score_documents(docs, tx.fit(docs, labels)).collect(), key=key)
    looks, real = [], tx.look_at
    monkeypatch.setattr(tx, "look_at", lambda *a: looks.append(a) or real(*a))
    monkeypatch.setattr(tx, "score_documents", None)
    found = sorted(tx.fit_and_score(docs, labels).collect(), key=key)
    assert len(looks) == 1 and len(found) == 65 and len({r.held_out for r in found}) == 2
    assert [(r.doc_id, r.held_out, r.predicted) for r in found] == [(r.doc_id, r.held_out, r.predicted) for r in want]
    assert np.allclose([r.score for r in found], [r.score for r in want], atol=1e-9)
    monkeypatch.undo()
    assert tx.fit_and_score(docs.limit(0), labels).count() == 0


def test_common_words_outlast_the_memory(monkeypatch):
    monkeypatch.setattr(tx, "CACHED_WORDS", 8)
    voting, looked, real = tx.Voting({"0slug": 4.0}), [], tx.Voting._looked_up
    monkeypatch.setattr(tx.Voting, "_looked_up", lambda self, word: looked.append(word) or real(self, word))
    for i in range(100):
        votes, _ = voting.seen(f"slug word{i} river")
        assert votes[0] == tx.TOXIC
    assert looked.count("slug") == looked.count("river") == 1 and len(voting) + len(voting.older) <= 16
