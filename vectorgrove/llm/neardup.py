"""MinHash near-duplicates by an inverted join of signature coordinates.

Documents of equal shingle sets form a class, and classes are compared.  A
signature has K coordinates, and each coordinate and value a posting of the
classes with it.  Two sets of the wanted similarity seldom agree in fewer than
MATCHES of K = 32 coordinates, and then share one of the K - MATCHES + 1 rarest
coordinate-values of both: only these prefixes are posted.  Collisions are
counted for pairs within a posting; the values outside the prefixes, whose
postings are long, are not merged but looked up in both signatures.  A pair is
counted in one of the postings it shares.  Long postings are dealt into blocks.

Pairs from MATCHES on are confirmed on full sets, in two rounds.  In the first
each class is compared with the partner before it that it collides with most,
which joins most of a group of copies with as many pairs as classes.  In the
second all other pairs count whose classes aren't connected yet: postings of
one component are skipped, and in others the classes outside their largest
component meet all classes.  Components come last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vectorgrove.llm.common import byte_batches, checkpoint, fresh_name
from vectorgrove.llm.components import connected_components

WIDTH = 5
PERCENT = 85
K = 32
#: Matches from which a pair is compared, by the least similarity in percent; the chance that a pair has fewer is under 1e-6.
MATCHES = {80: 13, 85: 15}
#: A block of a posting has about this many classes, and shingles, at most; they are dealt into blocks by hash.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
#: Sets of so many shingles are small.
SMALL_SET = 2000
#: Pairs that a task counts at a time, about.
BATCH_PAIRS = 400_000
#: Keys with the most rows, at most so many, have the numbers that concern them sent to every task in place of their rows to one.
HOT_KEYS = 100_000
CACHED_WORDS = 300_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**63, K, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h)
    with np.errstate(over="ignore"):
        if n < WIDTH:
            mixed = np.uint64(n)
            for v in h:
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + v
            mixed = np.array([mixed], np.uint64)
        else:
            mixed = np.full(n - WIDTH + 1, WIDTH, np.uint64)
            for i in range(WIDTH):
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[i : n - WIDTH + 1 + i]
        mixed ^= mixed >> np.uint64(30)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate-values: the least of each hash function's values, its last bits replaced by the coordinate."""
    out = np.empty(K, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(K):
            out[k] = ((shingles ^ _OFFSETS[k]) * _FACTORS[k]).min()
    return (out & ~np.uint64(K - 1) | np.arange(K, dtype=np.uint64)).view(np.int64)


def _pack(shingles: np.ndarray) -> bytes:
    """48 bits of each hash, which within a pair of sets of n give a false match with a chance of n^2 / 2^48."""
    high = shingles >> np.uint64(16)
    return (high >> np.uint64(16)).astype("<u4").tobytes() + (high & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(data, "<u2", n, 4 * n)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set, and the signature (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_batches(whole, "text"):
                n, keys, rows = [], [], []
                for text in b.column("text").to_pylist():
                    s = shingle_set(text or "")
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    rows.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig array<long>")


def met(rows: DataFrame, numbers: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Rows with the numbers of their key (rows of other keys go), where no task gets all rows of a key with many.

    ``size`` is each key's number of rows, and ``total`` their sum at most, so
    that the hot keys sent to every task are at most HOT_KEYS.
    """
    least = max(200, total // HOT_KEYS + 1)
    others = [c for c in numbers.columns if c != key]
    hot = numbers.where(F.col(size) >= least).withColumnRenamed(key, "_hot")
    cold = numbers.where(F.col(size) < least).withColumnRenamed(key, "_cold")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    found = marked.where("_hot IS NOT NULL").drop("_hot")
    rest = marked.where("_hot IS NULL").drop("_hot", *others)
    return found.unionByName(rest.join(cold, F.col(key) == F.col("_cold")).drop("_cold"))


def prefix_postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """token, df, cls, n, sig, mask: each class under those of its K - MATCHES + 1 rarest coordinate-values that others have too.

    mask has a bit for each coordinate in the class's prefix.
    """
    prefix = K - MATCHES[percent] + 1
    tokens = classes.select("cls", F.explode("sig").alias("token"))
    shared = checkpoint(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    total = shared.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    common = met(tokens, shared, "token", "df", total).groupBy(F.col("cls").alias("of")).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"))
    # values of a class alone come first in its prefix
    common = common.withColumn("own", F.lit(prefix - K) + F.size("common")).where("own > 0").select("of", F.slice("common", 1, F.col("own")).alias("common"))
    mask = F.expr(f"aggregate(common, 0L, (acc, c) -> acc | shiftleft(1L, cast(pmod(c.token, {K}) as int)))")
    joined = classes.select("cls", "n", "sig").join(common, F.col("cls") == F.col("of"))
    return joined.select("cls", "n", "sig", mask.alias("mask"), F.explode("common").alias("c")).select("c.token", "c.df", "cls", "n", "sig", "mask")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """cls and set of the classes wanted (cls), with their full shingle sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    needed = texts.join(wanted, F.col("id") == F.col("cls")).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_batches(whole, "text"):
                packed = pa.array([_pack(shingle_set(t)) for t in b.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("cls"), packed], ["cls", "set"])

    return needed.mapInArrow(run, "cls long, set binary")


PAIRS = pa.schema([("task", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("matches", pa.int32())])
#: Sides of a task's rows: those of PROBE meet those of MEMBER and OUTSIDER, those of BOTH each other.
PROBE, MEMBER, OUTSIDER, BOTH = 0, 1, 2, 3


def candidates(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of different components, smaller class first, in the tasks of some rows that collide in MATCHES coordinates or more, and in how many.

    Rows are in order of task and side.  Of the postings that a pair shares
    only the one of the lowest coordinate counts it.
    """
    task, token, cls, n, mask, side, of = (rows.column(c).to_numpy() for c in ("task", "token", "cls", "n", "mask", "side", "component"))
    sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, K) if len(task) else np.zeros((0, K), np.int64)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(task)) + 1]).astype(np.int64)
    ends = np.append(starts[1:], len(task))
    # probes come first in a task, and meet the rows behind them
    behind = np.where((side == PROBE) | (side == BOTH), np.repeat(ends, ends - starts) - np.arange(len(task)) - 1, 0)
    out, at = [], 0
    grown = np.cumsum(behind)
    while at < len(task):
        to = max(at + 1, int(np.searchsorted(grown, (grown[at - 1] if at else 0) + BATCH_PAIRS, "right")))
        left = np.repeat(np.arange(at, to), behind[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(behind[at:to]) - behind[at:to], behind[at:to])
        at = to
        x, y = side[left], side[right]
        # two probes meet where the larger one is an outsider
        both = (x == BOTH) | (y == MEMBER) | (y == OUTSIDER) & (cls[left] < cls[right])
        small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        some = np.flatnonzero(both & (of[left] != of[right]) & (cls[left] != cls[right]) & (100 * small >= percent * large))
        left, right = left[some], right[some]
        matches = np.zeros(len(left), np.int32)
        shared = np.zeros(len(left), np.int64)
        for k in range(K):
            same = sig[left, k] == sig[right, k]
            matches += same
            shared |= same.astype(np.int64) << k
        shared &= mask[left] & mask[right]
        here = np.int64(1) << (token[left] & (K - 1))
        some = np.flatnonzero((matches >= MATCHES[percent]) & (shared & -shared == here))
        out.append((left[some], right[some], matches[some]))
    left, right, matches = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
    swap = cls[left] > cls[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    return left, right, matches


def best_partners(rows: pa.Table, percent: int) -> pa.Table:
    """In each task, the candidate before each class that it collides with most."""
    left, right, matches = candidates(rows, percent)
    task, cls = rows.column("task").to_numpy(), rows.column("cls").to_numpy()
    order = np.lexsort((cls[left], -matches, cls[right], task[right]))
    left, right, matches = left[order], right[order], matches[order]
    first = np.concatenate([[True], (np.diff(cls[right]) != 0) | (np.diff(task[right]) != 0)])[: len(left)]
    left, right, matches = left[first], right[first], matches[first]
    cols = task[left], cls[left], cls[right], matches.astype(np.int32)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PAIRS, strict=True)], schema=PAIRS)


def colliding(rows: pa.Table, percent: int) -> pa.Table:
    """The rows that are in some candidate pair."""
    left, right, _ = candidates(rows, percent)
    return rows.take(np.unique(np.concatenate([left, right])))


ROWS = "task long, token long, cls long, n long, sig array<long>, mask long, side int, component long"


def _by_task(rows: DataFrame, of: Callable[[pa.Table], pa.Table], spec: str, sized: str | None = None) -> DataFrame:
    """What ``of`` makes of rows in order of task and side, whole tasks at a time; a task's rows are bounded in number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for b in byte_batches(whole, sized) if sized else [whole] * (whole.num_rows > 0):
                task = b.column("task").to_numpy()
                cut = int(np.searchsorted(task, task[-1]))
                if held and (cut or task[0] != held[-1].column("task")[0].as_py()):
                    yield from of(pa.Table.from_batches([*held, b.slice(0, cut)])).to_batches()
                    held = []
                elif cut:
                    yield from of(pa.Table.from_batches([b.slice(0, cut)])).to_batches()
                held.append(b.slice(cut))
        if held:
            yield from of(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("task").sortWithinPartitions("task", "side").mapInArrow(run, spec)


class Sets:
    """Packed sets by class; the smaller ones are kept as sets of Python, which meet each other sooner."""

    def __init__(self, packed: dict[int, bytes]):
        self.packed, self.small = packed, {}

    def common(self, x: int, y: int) -> tuple[int, int]:
        """Sizes of the intersection and of the union."""
        a, b = self.packed[x], self.packed[y]
        if max(len(a), len(b)) <= 6 * SMALL_SET:
            for c, data in ((x, a), (y, b)):
                if c not in self.small:
                    self.small[c] = frozenset(_unpack(data).tolist())
            both = len(self.small[x] & self.small[y])
        else:
            both = len(np.intersect1d(_unpack(a), _unpack(b), assume_unique=True))
        return both, (len(a) + len(b)) // 6 - both


def merged(pairs: list[tuple[int, int, int, int, int]], sets: Sets, percent: int = PERCENT) -> dict[int, int]:
    """The smallest component each is joined with by links among pairs (matches, class, class, and the components of both).

    Pairs connected when their turn comes, by falling matches, aren't compared.
    """
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        parent.setdefault(x, x)
        while (up := parent[x]) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for _, x, y, of_x, of_y in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        a, b = find(of_x), find(of_y)
        if a != b:
            both, either = sets.common(x, y)
            if 100 * both >= percent * either:
                parent[max(a, b)] = min(a, b)
    return {c: find(c) for c in parent if find(c) != c}


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(found: dict[int, int]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], schema=LINKS)


def _sets_of(table: pa.Table) -> Sets:
    return Sets(dict(zip(table.column("cls").to_pylist(), table.column("set").to_pylist(), strict=True)))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: components joined by given pairs that full sets confirm.  A task gets the set of a class once or twice, however many pairs it is in."""
    nothing = F.lit(None).cast("long")
    ends = pairs.select("task", F.col("a").alias("of"), nothing.alias("partner"), F.lit(0).alias("matches")).dropDuplicates()
    ends = ends.union(pairs.select("task", "b", "a", "matches")).withColumn("side", F.lit(BOTH))
    needed = ends.join(sets, F.col("of") == F.col("cls")).select("task", "side", "cls", "partner", "matches", "set")

    def run(table: pa.Table) -> pa.Table:
        given = table.filter(table.column("partner").combine_chunks().is_valid())
        listed = [(m, a, b, a, b) for m, a, b in zip(*(given.column(c).to_pylist() for c in ("matches", "partner", "cls")), strict=True)]
        return _links(merged(listed, _sets_of(table), percent))

    return _by_task(needed, run, "a long, b long", "set")


def _compared(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: components joined by candidates, counted again among colliding rows, that full sets confirm; pairs are formed inside the tasks only."""
    needed = rows.join(sets.withColumnRenamed("cls", "of"), F.col("cls") == F.col("of")).drop("of")

    def run(table: pa.Table) -> pa.Table:
        left, right, matches = candidates(table, percent)
        cls, of = table.column("cls").to_pylist(), table.column("component").to_pylist()
        listed = [(m, cls[i], cls[j], of[i], of[j]) for i, j, m in zip(left.tolist(), right.tolist(), matches.tolist(), strict=True)]
        return _links(merged(listed, _sets_of(table), percent))

    return _by_task(needed, run, "a long, b long", "set")


def _components(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """node, component of every class that is linked with another."""
    postings = checkpoint(prefix_postings(classes, percent))
    size = F.ceil(F.col("df") / BLOCK_ROWS).cast("int")
    dealt = F.xxhash64("token", F.pmod(F.xxhash64("cls"), size))
    fields = ["token", "cls", F.col("n").cast("long").alias("n"), "sig", "mask"]
    begun = postings.select(dealt.alias("task"), *fields, F.lit(BOTH).alias("side"), F.col("cls").alias("component"))
    first = _by_task(begun, lambda rows: best_partners(rows, percent), "task long, a long, b long, matches int")
    # of all postings the partner with the most matches; a class is in few
    first = first.groupBy("b").agg(F.max(F.struct("matches", (-F.col("a")).alias("less"), "task")).alias("m"))
    first = checkpoint(first.select("m.task", (-F.col("m.less")).alias("a"), "b", "m.matches"))
    sets = checkpoint(_sets(docs, postings.select("cls").dropDuplicates(), id_col, text_col))
    links = checkpoint(_confirmed(first, sets, percent))
    known = connected_components(links)

    names = known.select(F.col("node").alias("of"), "component")
    current = checkpoint(postings.join(names, F.col("cls") == F.col("of"), "left").withColumn("component", F.coalesce("component", "cls")).drop("of"))
    by = current.groupBy("token", "component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).groupBy("token")
    largest = F.max(F.struct("members", "component", "shingles"))
    open_ = by.agg(F.sum("members").alias("size"), F.sum("shingles").alias("shingles"), largest.alias("m"), F.count("*").alias("of_token")).where("of_token > 1")
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    probing = blocks(F.col("size") - F.col("m.members"), F.col("shingles") - F.col("m.shingles"))
    open_ = checkpoint(open_.select("token", "size", F.col("m.component").alias("main"), blocks(F.col("size"), F.col("shingles")).alias("blocks"), probing.alias("probing")))
    total = open_.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return known
    rows = met(current, open_, "token", "size", total)
    h = F.xxhash64("cls")
    apart = F.col("component") != F.col("main")
    probes = rows.where(apart).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.pmod(h, F.col("probing"))).withColumn("side", F.lit(PROBE))
    members = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("probing") - 1))).withColumn("y", F.pmod(h, F.col("blocks"))).withColumn("side", F.when(apart, OUTSIDER).otherwise(MEMBER))
    columns = [F.xxhash64("token", F.col("x").cast("long"), F.col("y").cast("long")).alias("task"), *fields, "side", "component"]
    # classes of a task that collide with others of it, no more than its rows
    second = probes.select(*columns).unionByName(members.select(*columns))
    second = checkpoint(_by_task(second, lambda rows: colliding(rows, percent), ROWS))
    more = checkpoint(_compared(second, sets, percent))
    if more.isEmpty():
        return known
    return connected_components(links.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; sets of ``percent`` similarity or more are linked.

    A null text counts as empty; texts without words have no shingles and are
    linked with nothing, and with fewer words than WIDTH the whole sequence is
    the one shingle.  Rows that share an id count as one document.  A null id
    takes no part: its component is null and it is kept.  An empty table gives
    no rows; columns but the two named are not read, whatever their names.
    """
    if percent not in MATCHES:
        raise ValueError(f"no number of matches for {percent} percent")
    rows = checkpoint(signed(docs, id_col, text_col))
    with_id = rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = with_id.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").alias("cls"), F.col("n_shingles").alias("n"), "sig")).alias("c"))
    classes = checkpoint(classes.select("set_key", "c.cls", "c.n", "c.sig"))
    components = _components(docs, classes, id_col, text_col, percent)
    of_key = classes.select(F.col("set_key").alias("k"), "cls").join(components, F.col("cls") == F.col("node"), "left")
    of_key = of_key.select("k", F.coalesce("component", "cls").alias("found"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(of_key, F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, without those whose component has a smaller id; rows that share an id go or stay together."""
    name = fresh_name(docs, "gone")
    gone = near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(F.col("doc_id").alias(name)).dropDuplicates()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
