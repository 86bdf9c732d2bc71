"""Quality classification by pairwise ranking (Bradley-Terry).

Each pair has a document labelled good and one labelled bad; the chance that
the good one is preferred is the logistic function of the difference of their
scores, which are linear in the features, so the weights are fitted by
logistic loss on feature differences.  The bar is the quantile of the
training scores that leaves as many below as there are bad labels.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from vectorgrove.llm.labelled import MAX_LABELLED, features_of, filtered, labelled_sample, scored, sigmoid

#: Pairs in which each labelled document of the rarer label takes part.
PAIRS_EACH = 40
MAX_PAIRS = 200_000
BAR = 0.3

_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLUSTERS = re.compile(r"[^\w\s]{2,}")


def text_features(text: str) -> np.ndarray:
    """Shares and counts of characters, words and repetitions, on logarithmic scales."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    m = max(1, len(words))
    capitals = int(counts[65:91].sum())
    letters = capitals + int(counts[97:123].sum())
    marks = counts[_MARKS]
    same = sum(map(str.__eq__, words, words[1:]))
    tally: dict[str, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = text.split("\n")
    clusters = len(_CLUSTERS.findall(text))
    share = np.array(
        [
            capitals / max(1, letters),
            counts[48:58].sum() / n,
            marks.sum() / n,
            counts[128:].sum() / n,
            counts[10] / n,
            len(tally) / m,
            max(tally.values(), default=0) / m,
            same / m,
            clusters / m,
            1 - len(set(lines)) / len(lines),
            len(raw) / m / 20,
        ]
    )
    amount = np.array([len(raw), len(words), len(lines), same, clusters, capitals, letters])
    return np.concatenate([share, np.sqrt(share), np.log1p(amount) / 5, np.log1p(1000 * marks / n) / 3, [1.0]])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bar: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, and BAR where the raw score is at the quantile."""
        return sigmoid(self.slope * (self.raw(x) - self.bar) + np.log(BAR / (1 - BAR)))


def fit_pairs(x: np.ndarray, label: np.ndarray, seed: int = 3, steps: int = 400, ridge: float = 1e-3) -> QualityModel:
    """Without both labels every document scores alike, above the bar."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    d = x.shape[1]
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(d), -1.0 if len(good) or not len(bad) else 1.0, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    pairs = min(MAX_PAIRS, PAIRS_EACH * min(len(good), len(bad)) + len(good) + len(bad))
    better = good[np.arange(pairs) % len(good)]
    worse = bad[rng.integers(0, len(bad), pairs)]
    difference = z[better] - z[worse]
    w, speed = np.zeros(d), np.zeros(d)
    for step in range(steps):
        loss = sigmoid(-(difference @ w))
        gradient = -(difference.T @ loss) / pairs + ridge * w
        speed = 0.9 * speed - 0.3 * gradient
        w = w + speed
    raw = z @ w
    bar = float(np.quantile(raw, len(bad) / len(label)))
    # the slope of a logistic fit through the bar
    t, offset, slope = raw - bar, np.log(BAR / (1 - BAR)), 1.0
    for _ in range(50):
        p = sigmoid(slope * t + offset)
        slope -= float(np.clip((t @ (p - label) + 1e-3 * slope) / (t * t @ (p * (1 - p)) + 1e-3), -1, 1))
    return QualityModel(mean, scale, w, bar, max(slope, 1e-3))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> QualityModel:
    return fit_pairs(*features_of(labelled_sample(docs, labels, label, most=most), text_features))


def score_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Scores of whole texts; a null text counts as empty, repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]) -> np.ndarray:
        return shared.value.score(np.array([text_features(t) for t in texts]))

    return scored(docs, score, BAR)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents, with all their columns, that score BAR or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: shared.value.score(np.array([text_features(t) for t in texts])) >= BAR)
