"""Toxicity by weak supervision.

Many voters look at a document, and each says toxic, clean or nothing.
Lexicon voters know words, beginnings and endings of words, words without
vowels and without doubled letters, and masked spellings; which ones is
induced from labelled documents.  Pattern voters look for masked or spaced
letters, shouting, runs of marks, stretched words, and at where known words
stand: beside a second person, close together, repeated, at the start or end.

A generative model of the votes, fitted without labels by expectation
maximisation over the vote patterns of all documents outside the held-out
fold, estimates what each voter says of both classes and, by a dependence of
each voter on one other (the tree of largest conditional mutual information),
their correlations.  A linear classifier is then trained on the posterior
labels of all these documents.  Both are fitted by sums over the data that are
bounded in number, so nothing is drawn or cut but the labelled documents that
lexicons are induced from; these also give the share of toxic documents, and
the slope and offset that make the classifier's scores probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectorgrove.llm.common import byte_batches, checkpoint, fold
from vectorgrove.llm.labelled import MAX_LABELLED, filtered, labelled_sample, sampled_labels, scored, sigmoid

BEGINNINGS, ENDINGS = (4, 5, 6, 7, 8), (5, 6)
LEXICONS = ("word", *(f"begin-{n}" for n in BEGINNINGS), *(f"end-{n}" for n in ENDINGS), "skeleton", "squeezed", "unmasked")
PATTERNS = ("masked", "spaced", "shouting", "marks", "stretched", "addressed", "close", "repeated", "opening", "closing", "strong")
#: Lexicon voters, pattern voters, and one that says clean of texts without anything known.
VOTERS = (*LEXICONS, *PATTERNS, "nothing-known")
#: Words a worker remembers, and as many from before; more only cost time.
CACHED_WORDS = 300_000
#: A lexicon says toxic from this share of known words on, nothing below it, and clean without any; documents of fewer words count as MIN_WORDS.
SHARE, MIN_WORDS = 0.008, 25
#: Logarithm of how much commoner in toxic text a lexicon's keys are, at least.
RATIO = 3.6
#: Words that count as near each other, and as the start or end of a text.
NEAR, ENDS = 10, 20
#: Logarithm of how much commoner in toxic text a strong word is.
STRONG = 3.4
BAR = 0.5
EM_ROUNDS, NEWTON_STEPS = 24, 8
CLEAN, TOXIC, ABSTAIN = 0, 1, 2

# Second persons of the languages at hand.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie ihnen usted ustedes tú ti tus su".split())
# Letters that digits and marks stand for in masked spellings.
UNMASK = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

_LETTERS = re.compile(r"[^\W\d_]+").findall
_VOWELS = str.maketrans(dict.fromkeys("aeiouyàáâäåæèéêëìíîïòóôöøùúûüœ"))
_DOUBLE = re.compile(r"(.)\1").search
_DOUBLED = re.compile(r"(.)\1+")
_MASKED = re.compile(r"(?<=[^\W\d_])[*#@$%]+[^\W\d_]").search
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?!\w)").search
# what spaced letters contain, and most texts don't
_LONE = re.compile(r"[ .\-_][^\W\d_][ .\-_][^\W\d_][ .\-_]").search
_ODD = re.compile(r"[*#@$%!?]").search
_MARKS = re.compile(r"[!?]{2,}").search
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}").search
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+").findall
_NO_CAPITALS, _NO_SMALL = (bytes(i for i in range(256) if not first <= i < first + 26) for first in b"Aa")


def shouted(text: str) -> bool:
    """Whether a whole text has more than 20 capitals, and more of them than small letters."""
    data = text.encode("utf-8", "surrogatepass")
    capitals, small = (len(data.translate(None, other)) for other in (_NO_CAPITALS, _NO_SMALL))
    # each character beyond ASCII takes a byte more, at least
    if capitals + len(data) - len(text) <= max(20, small):
        return False
    others = "".join(_BEYOND_ASCII(text)) if len(data) > len(text) else ""
    capitals += sum(map(str.isupper, others))
    return capitals > 20 and capitals > small + sum(map(str.islower, others))


def skeleton(word: str) -> str:
    """The word without vowels; empty where that leaves too little, or everything."""
    bare = word.translate(_VOWELS)
    return bare if 2 < len(bare) < len(word) else ""


def keys_of(word: str) -> list[str]:
    """Lexicon keys of a word in lower case, the lexicon's number in front of each."""
    keys = ["0" + word, *(f"{1 + i}{word[:n]}" for i, n in enumerate(BEGINNINGS) if len(word) > n)]
    keys += [f"{1 + len(BEGINNINGS) + i}{word[-n:]}" for i, n in enumerate(ENDINGS) if len(word) > n]
    if bare := skeleton(word):
        keys.append("8" + bare)
    squeezed = _DOUBLED.sub(r"\1", word)
    if squeezed != word:
        keys.append("9" + squeezed)
    return keys


def _key_counts(sample: DataFrame) -> DataFrame:
    """key, documents and words with it by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = list(held.values())
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *cols], ["key", "d0", "d1", "w0", "w1"])
            held.clear()
            return out

        for whole in batches:
            for b in byte_batches(whole, "text"):
                for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                    counts: dict[str, int] = {}
                    for word in _LETTERS((text or "").lower()):
                        counts[word] = counts.get(word, 0) + 1
                    keys: dict[str, int] = {}
                    for word, n in counts.items():
                        for k in keys_of(word):
                            keys[k] = keys.get(k, 0) + n
                    for k, n in keys.items():
                        row = held.get(k)
                        if row is None:
                            row = held[k] = [0, 0, 0, 0]
                        row[label] += 1
                        row[2 + label] += n
                if len(held) > 200_000:
                    yield flush()
        yield flush()

    rows = sample.mapInArrow(run, "key string, d0 long, d1 long, w0 long, w1 long")
    return rows.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("d0", "d1", "w0", "w1")))


def induce(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED) -> tuple[dict[str, float], float]:
    """Lexicon keys with the logarithm of how much commoner they are in toxic text, and the share of toxic labels.

    All keys that qualify are taken; they are bounded as the labelled
    documents are, of which about ``most`` count.
    """
    sample = labelled_sample(docs, labels, label, most=most)
    by = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = by.get(0, 0), by.get(1, 0)
    if not n1:
        return {}, 0.0
    counts = _key_counts(sample)
    ratio = F.log((F.col("w1") + 0.5) / (F.col("w0") + 0.5) * ((n0 + 1) / (n1 + 1)))
    least = max(3, n1 // 200)
    by_documents = (F.col("d1") / n1) > 8 * (F.col("d0") + 1) / (n0 + 1)
    chosen = counts.where((F.col("d1") >= least) & by_documents).withColumn("weight", ratio).where(F.col("weight") > RATIO)
    return {r.key: r.weight for r in chosen.select("key", "weight").collect()}, n1 / (n0 + n1)


class Voting(dict):
    """For each word in lower case as split at white space, the lexicons that know it, its weight and its patterns, or None."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        #: Words remembered before the present ones.
        self.older: dict[str, tuple | None] = {}
        #: What lexicons know of words of letters inside other words.
        self.parts: dict[str, list[tuple[int, float]]] = {}
        self.by = [{k[1:]: w for k, w in lexicon.items() if int(k[0]) == i} for i in range(10)]
        #: First and last letters of known words, which squeezing leaves as they are.
        self.first_last = {k[0] + k[-1] for i in (0, 9) for k in self.by[i] if k}
        #: What all known beginnings and endings begin and end with.
        self.starts = {k[: BEGINNINGS[0]] for by in self.by[1 : 1 + len(BEGINNINGS)] for k in by}
        self.finishes = {k[-ENDINGS[0] :] for by in self.by[1 + len(BEGINNINGS) : 8] for k in by}

    def _known(self, word: str, doubled: bool) -> list[tuple[int, float]]:
        """The lexicons that know a word of letters, each with the weight there."""
        by = self.by
        found = [(0, w)] if (w := by[0].get(word)) is not None else []
        if word[: BEGINNINGS[0]] in self.starts:
            found += [(1 + i, w) for i, n in enumerate(BEGINNINGS) if len(word) > n and (w := by[1 + i].get(word[:n])) is not None]
        if word[-ENDINGS[0] :] in self.finishes:
            first = 1 + len(BEGINNINGS)
            found += [(first + i, w) for i, n in enumerate(ENDINGS) if len(word) > n and (w := by[first + i].get(word[-n:])) is not None]
        if by[8] and (w := by[8].get(word.translate(_VOWELS))) is not None and skeleton(word):
            found.append((8, w))
        if doubled and word[0] + word[-1] in self.first_last:
            squeezed = _DOUBLED.sub(r"\1", word)
            # a squeezed word may be a known one
            found += [(9, w) for i in (9, 0) if (w := by[i].get(squeezed)) is not None]
        return found

    def __missing__(self, word: str):
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        value = self[word] = self.older[word] if word in self.older else self._looked_up(word)
        return value

    def _looked_up(self, word: str):
        found, patterns, doubled = [], (), _DOUBLE(word) is not None
        if word.isalpha():
            found = self._known(word, doubled)
        else:
            for part in _LETTERS(word):
                if part in self.parts:
                    found += self.parts[part]
                    continue
                known = self._known(part, doubled and _DOUBLE(part) is not None)
                if len(self.parts) >= CACHED_WORDS:
                    self.parts.clear()
                self.parts[part] = known
                found += known
            inner = word.strip("#%&.,;:!?*$\"'()[]|")
            if not inner.isalpha():
                plain = inner.translate(UNMASK)
                w = self.by[0].get(plain) if plain != inner else None
                if w is not None:
                    found.append((len(LEXICONS) - 1, w))
            if _ODD(word):
                patterns = tuple(i for i, of in ((0, _MASKED), (3, _MARKS)) if of(word))
        if doubled and _STRETCHED(word):
            patterns += (4,)
        if not found and not patterns:
            return None
        kinds = np.zeros(len(LEXICONS))
        kinds[[kind for kind, _ in found]] = 1
        return kinds, max((w for _, w in found), default=0.0), patterns

    def seen(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Each voter's vote, and features."""
        words = text.lower().split()
        m = len(words)
        marked = [(i, h) for i, h in enumerate(map(self.__getitem__, words)) if h is not None]
        hits = [(i, h) for i, h in marked if h[1]]
        lexicons = np.sum([h[0] for _, h in hits], axis=0) if hits else np.zeros(len(LEXICONS))
        share = lexicons / max(m, MIN_WORDS)
        weight = sum(h[1] for _, h in hits)
        pattern = np.zeros(len(PATTERNS))
        for _, h in marked:
            for i in h[2]:
                pattern[i] = 1
        pattern[1] = _LONE(text) is not None and _SPACED(text) is not None
        pattern[2] = shouted(text)
        if hits:
            places = [i for i, _ in hits]
            pattern[5] = any(w.strip(".,;:!?") in SECOND_PERSON for i in places for w in words[max(0, i - 3) : i + 4])
            pattern[6] = any(b - a <= NEAR for a, b in zip(places, places[1:], strict=False))
            pattern[7] = len({words[i] for i in places}) < len(places)
            pattern[8] = places[0] < ENDS <= m
            pattern[9] = places[-1] >= m - ENDS > 0
            pattern[10] = max(h[1] for _, h in hits) >= STRONG
        votes = np.empty(len(VOTERS), np.int64)
        votes[: len(LEXICONS)] = np.where(lexicons == 0, CLEAN, np.where(share >= SHARE, TOXIC, ABSTAIN))
        votes[len(LEXICONS) : -1] = np.where(pattern > 0, TOXIC, ABSTAIN)
        votes[-1] = CLEAN if not hits and m >= MIN_WORDS else ABSTAIN
        total = weight / max(m, MIN_WORDS)
        features = np.concatenate([np.log1p(1000 * share), pattern, [np.log1p(1000 * total), np.log1p(weight), np.log1p(m), float(weight > 0)]])
        return votes, features.astype(np.float32)


FEATURES = len(LEXICONS) + len(PATTERNS) + 4


def one_hot(votes: np.ndarray) -> np.ndarray:
    """A column for each voter and vote."""
    return (votes[:, :, None] == np.arange(3)).reshape(len(votes), -1).astype(float)


@dataclass
class LabelModel:
    """P(toxic) and, for each voter, class and vote of its parent, the chances of its votes."""

    prior: float
    parents: list[int]
    #: [voter, class, parent's vote, vote]; without a parent it doesn't depend on that.
    chance: np.ndarray
    correlations: list[tuple[int, int, float]] = field(default_factory=list)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = []
        for y, p in ((0, 1 - self.prior), (1, self.prior)):
            log = np.full(len(votes), np.log(max(p, 1e-12)))
            for j, parent in enumerate(self.parents):
                at = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
                log += np.log(self.chance[j, y][at, votes[:, j]])
            logs.append(log)
        return sigmoid(logs[1] - logs[0])

    def expected(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """By class, how often two voters say what, each pair of votes weighted by the posterior: all that fitting needs."""
        post, x = self.posterior(votes), one_hot(votes)
        return np.stack([(x * (weight * p)[:, None]).T @ x for p in (1 - post, post)])


def tree(joint: np.ndarray) -> tuple[list[int], list[tuple[int, int, float]]]:
    """Parents in the tree of largest mutual information between votes, given the class."""
    m = joint.shape[1] // 3
    table = joint.reshape(2, m, 3, m, 3).transpose(0, 1, 3, 2, 4) + 1e-6
    mass = table.sum((3, 4), keepdims=True)
    table = table / mass
    part = table * np.log(table / table.sum(4, keepdims=True) / table.sum(3, keepdims=True))
    info = (part.sum((3, 4)) * mass[..., 0, 0] / mass[..., 0, 0].sum(0)).sum(0)
    parents, inside = [-1] * m, [0]
    while len(inside) < m:
        i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda ij: info[ij])
        parents[j] = i
        inside.append(j)
    return parents, [(i, j, float(info[i, j])) for i in range(m) for j in range(i)]


def started(m: int, prior: float) -> LabelModel:
    """Voters taken as fairly accurate and independent."""
    chance = np.empty((m, 2, 3, 3))
    chance[:, 0], chance[:, 1] = [0.75, 0.05, 0.2], [0.2, 0.5, 0.3]
    return LabelModel(float(np.clip(prior, 1e-3, 0.5)), [-1] * m, chance)


def improved(model: LabelModel, joint: np.ndarray, with_tree: bool) -> LabelModel:
    """The model that expected counts make likeliest, drawn a little to the start."""
    m = len(model.parents)
    parents, info = tree(joint) if with_tree else (model.parents, model.correlations)
    table = joint.reshape(2, m, 3, m, 3)
    chance, begin = np.empty((m, 2, 3, 3)), started(m, 0.5).chance
    for j, parent in enumerate(parents):
        for y in (0, 1):
            seen = table[y, parent, :, j, :] if parent >= 0 else np.tile(np.diag(table[y, j, :, j, :]), (3, 1))
            chance[j, y] = (seen + begin[j, y]) / (seen.sum(1, keepdims=True) + 1)
    toxic = joint[1, :3, :3].sum() / max(joint[:, :3, :3].sum(), 1e-12)
    chance = chance.clip(1e-4, 1)
    return LabelModel(float(np.clip(toxic, 1e-3, 0.5)), parents, chance / chance.sum(-1, keepdims=True), info)


def fit_label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = EM_ROUNDS) -> LabelModel:
    """Expectation maximisation over weighted vote patterns in one place."""
    model = started(votes.shape[1], prior)
    for step in range(rounds):
        model = improved(model, model.expected(votes, weight), step >= rounds // 3)
    return model


def newton_sums(x: np.ndarray, target: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Curvature, and gradient in the last column, of the expected logistic loss, summed over rows."""
    p = sigmoid(x @ w)
    return np.column_stack([(x * (p * (1 - p) + 1e-6)[:, None]).T @ x, x.T @ (p - target)])


def calibration(raw: np.ndarray, label: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Slope and offset that turn the classifier's logits into those of labels, by logistic loss with a little weight on leaving them."""
    a = np.array([1.0, 0.0])
    z = np.column_stack([raw, np.ones(len(raw))])
    for _ in range(steps):
        p = sigmoid(z @ a)
        curvature = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2)
        a = a - np.linalg.solve(curvature, z.T @ (p - label) + (a - [1.0, 0.0])).clip(-1, 1)
    return float(max(a[0], 1e-3)), float(a[1])


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    labels: LabelModel | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])


_voting: dict[int, Voting] = {}


def _voting_of(lexicon: dict[str, float]) -> Voting:
    key = zlib.crc32(repr(sorted(lexicon.items())).encode())
    if key not in _voting:
        _voting.clear()
        _voting[key] = Voting(lexicon)
    return _voting[key]


def pattern_number(votes: np.ndarray) -> np.ndarray:
    """Two bits for each voter."""
    return (votes << 2 * np.arange(votes.shape[1])).sum(1)


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] >> 2 * np.arange(len(VOTERS)) & 3


#: Documents looked at, all of them held out or none; ids are a list, patterns 64-bit integers and features 32-bit floats.
BLOCKS = pa.schema([("held_out", pa.bool_()), ("ids", pa.list_(pa.int64())), ("patterns", pa.binary()), ("features", pa.binary())])


def look_at(docs: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Patterns and features of whole texts (null: empty), in blocks."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = _voting_of(shared.value)
        for whole in batches:
            for b in byte_batches(whole, "text"):
                seen = [voting.seen(t or "") for t in b.column("text").to_pylist()]
                patterns = pattern_number(np.array([v for v, _ in seen]))
                features = np.array([x for _, x in seen])
                held = b.column("held_out").to_numpy(zero_copy_only=False)
                for part in (False, True):
                    at = np.flatnonzero(held == part)
                    if len(at):
                        row = part, b.column("doc_id").take(pa.array(at)).to_pylist(), patterns[at].tobytes(), features[at].tobytes()
                        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

    return rows.mapInArrow(run, "held_out boolean, ids array<long>, patterns binary, features binary")


def _features(block: bytes) -> np.ndarray:
    return np.frombuffer(block, np.float32).reshape(-1, FEATURES)


def _summed(blocks: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over a table's batches of arrays of one shape, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            total += of(b)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["at", "value"])

    total = np.zeros(shape).reshape(-1)
    for r in blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r.value
    return total.reshape(shape)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on all documents outside the held-out fold, with lexicons from about ``most`` labelled ones of these.

    Without toxic labels, without words that tell them, or without documents,
    no document is taken as toxic.  Null texts count as empty and null ids as
    outside the fold if that of an empty text is; repeated rows count each.
    Columns but those named are not read, whatever their names.
    """
    lexicon, prior = induce(docs, labels, label, most)
    if not lexicon:
        return nothing_toxic(lexicon)
    blocks = checkpoint(look_at(docs.where(fold(id_col, 5) != 0), lexicon, id_col, text_col))
    return fit_blocks(blocks, lexicon, prior, sampled_labels(labels, label, id_col, most))


def nothing_toxic(lexicon: dict[str, float]) -> ToxicityModel:
    return ToxicityModel(lexicon, None, np.zeros(FEATURES), np.ones(FEATURES), np.append(np.zeros(FEATURES), -3.0))


def fit_blocks(blocks: DataFrame, lexicon: dict[str, float], prior: float, known: DataFrame) -> ToxicityModel:
    """The same from what was looked at in documents outside the held-out fold; ``known`` are a bounded number of labels."""
    m, d = len(VOTERS), FEATURES

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            patterns, n = np.unique(np.concatenate([np.frombuffer(p, np.int64) for p in b.column("patterns").to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(n.astype(np.int64))], ["pattern", "n"])

    patterns = blocks.mapInArrow(counted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = checkpoint(patterns).coalesce(16)
    model = started(m, prior)
    for step in range(EM_ROUNDS):
        now = model
        joint = _summed(patterns, lambda b: now.expected(votes_of(b.column("pattern").to_numpy()), b.column("n").to_numpy().astype(float)), (2, 3 * m, 3 * m))  # noqa: B023
        if not joint.any():
            return nothing_toxic(lexicon)
        model = improved(model, joint, step >= EM_ROUNDS // 3)
        # the share of toxic documents is known from labels, and would otherwise drift to whatever else voters agree on
        model.prior = float(np.clip(prior, 1e-3, 0.5))

    def features(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for p, x in zip(b.column("patterns").to_pylist(), b.column("features").to_pylist(), strict=True):
            yield np.frombuffer(p, np.int64), _features(x).astype(float)

    moments = _summed(blocks, lambda b: sum(np.stack([np.full(d, len(x)), x.sum(0), (x * x).sum(0)]) for _, x in features(b)), (3, d))
    rows = moments[0, 0]
    mean = moments[1] / rows
    scale = np.sqrt(np.maximum(moments[2] / rows - mean**2, 0)) + 1e-3
    w = np.zeros(d + 1)
    ridge = np.append(np.full(d, 1e-3), 0) * rows
    for _ in range(NEWTON_STEPS):

        def part(b: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            total = np.zeros((d + 1, d + 2))
            for p, x in features(b):
                total += newton_sums(np.column_stack([(x - mean) / scale, np.ones(len(x))]), model.posterior(votes_of(p)), w)
            return total

        sums = _summed(blocks, part, (d + 1, d + 2))
        w = w - np.linalg.solve(sums[:, :-1] + np.diag(ridge + 1e-6), sums[:, -1] + ridge * w).clip(-2, 2)
    x, y = _labelled(blocks, known)
    slope, offset = calibration(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ w, y)
    return ToxicityModel(lexicon, model, mean, scale, np.append(w[:-1] * slope, w[-1] * slope + offset))


def _labelled(blocks: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the documents with known labels, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in zip(b.column("ids").to_pylist(), b.column("features").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([row.tobytes() for row in _features(x)], pa.binary())], ["doc_id", "x"])

    # known labels are bounded in number, so they may be sent to every executor
    rows = blocks.mapInArrow(run, "doc_id long, x binary").join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "label", "x")
    rows = rows.toArrow().sort_by([("doc_id", "ascending")])
    return _features(b"".join(rows["x"].to_pylist())).astype(float), np.array(rows["label"].to_pylist(), np.int64)


def fit_and_score(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """What ``score_documents`` gives with the model of ``fit``, but each text is looked at once."""
    lexicon, prior = induce(docs, labels, label, most)
    if not lexicon:
        return score_documents(docs, nothing_toxic(lexicon), id_col, text_col)
    blocks = checkpoint(look_at(docs, lexicon, id_col, text_col))
    model = fit_blocks(blocks.where(~F.col("held_out")), lexicon, prior, sampled_labels(labels, label, id_col, most))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held, ids, x in zip(*(b.column(c).to_pylist() for c in ("held_out", "ids", "features")), strict=True):
                s = shared.value.score(_features(x))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), held)), pa.array(s, pa.float64()), pa.array((s >= BAR).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return blocks.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of whole texts; a null text counts as empty, repeated rows are scored each, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: list[str]) -> np.ndarray:
        voting = _voting_of(shared.value.lexicon)
        return shared.value.score(np.array([voting.seen(t)[1] for t in texts]))

    return scored(docs, score, BAR, id_col, text_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score under BAR."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str]) -> np.ndarray:
        voting = _voting_of(shared.value.lexicon)
        return shared.value.score(np.array([voting.seen(t)[1] for t in texts])) < BAR

    return filtered(docs, keep, text_col)
