"""Registry of named queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vectorgrove.functions import vectors as V
from vectorgrove.operators import aggregates, clustering, evaluation, hierarchy, neighbors, pca
from vectorgrove.plans import indexer, search
from vectorgrove.session import checkpoint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register(
    "exact_knn_cosine",
    """
SELECT qid, rk, vec_id, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rk FROM (
    SELECT a.vec_id AS qid, b.vec_id,
      list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rk <= 10
""",
)
def exact_knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each query vector, by cosine."""
    e = embeddings(spark, sf_dir)
    found = neighbors.knn(e, e.where("vec_id % 100 = 0"), 10, "cosine")
    return found.select("qid", "rk", F.col("id").alias("vec_id"), F.round(1 - F.col("distance"), 6).alias("sim"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))


_EXPLODED = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings"


@register(
    "exact_knn_euclidean",
    """
SELECT qid, rk, id, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM (
    SELECT a.vec_id AS qid, b.vec_id AS id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)) WHERE rk <= 10
""",
)
def exact_knn_euclidean(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return neighbors.knn(e, e.where("vec_id % 100 = 0"), 10, "euclidean").withColumn("distance", F.round("distance", 6))


@register(
    "heldout_top10",
    """
SELECT qid, rk, id, round(d, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM (
    SELECT a.vec_id AS qid, b.vec_id AS id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
    FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0)) WHERE rk <= 10
""",
)
def heldout_top10(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    found = neighbors.knn(e.where("vec_id % 100 <> 0"), e.where("vec_id % 100 = 0"), 10, "cosine")
    return found.withColumn("distance", F.round("distance", 6))


@register(
    "vector_norms",
    "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
)
def vector_norms(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@register(
    "normalized_components",
    f"""WITH x AS ({_EXPLODED}), n AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY vec_id)
SELECT x.vec_id, CAST(pos AS BIGINT) AS pos, round(x / norm, 6) AS x FROM x JOIN n ON x.vec_id = n.vec_id""",
)
def normalized_components(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.normalize(F.col("embedding"))).alias("pos", "x"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register("centroid_by_label", f"SELECT label::BIGINT AS label, CAST(pos AS BIGINT) AS pos, round(avg(x), 6) AS mean FROM ({_EXPLODED}) GROUP BY label, pos")
def centroid_by_label(spark, sf_dir):
    c = aggregates.centroids(embeddings(spark, sf_dir), "embedding", ["label"])
    return c.select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@register(
    "weighted_centroid",
    f"SELECT label::BIGINT AS label, CAST(pos AS BIGINT) AS pos, round(sum(x * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1), 6) AS mean FROM ({_EXPLODED}) GROUP BY label, pos",
)
def weighted_centroid(spark, sf_dir):
    c = aggregates.centroids(embeddings(spark, sf_dir), "embedding", ["label"], F.col("vec_id") % 7 + 1)
    return c.select("label", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"))


@register(
    "covariance_matrix",
    f"""WITH x AS ({_EXPLODED}) SELECT CAST(a.pos AS BIGINT) AS i, CAST(b.pos AS BIGINT) AS j, round(covar_samp(a.x, b.x), 8) AS cov
FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY a.pos, b.pos""",
)
def covariance_matrix(spark, sf_dir):
    cov = pca.moments(embeddings(spark, sf_dir)).covariance()
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i long, j long, cov double").withColumn("cov", F.round("cov", 8))


@register(
    "cluster_occupancy",
    """SELECT c.cluster_id, count(vec_id) AS total, count(vec_id) FILTER (vec_id % 5 <> 0) AS "real", count(vec_id) FILTER (vec_id % 5 = 0) AS synthetic
FROM (SELECT unnest(range(12)) AS cluster_id) c LEFT JOIN embeddings e ON e.label = c.cluster_id GROUP BY c.cluster_id""",
)
def cluster_occupancy(spark, sf_dir):
    e = embeddings(spark, sf_dir).withColumn("synthetic", F.col("vec_id") % 5 == 0)
    return aggregates.occupancy(e, 12, "label", "synthetic")


@register(
    "occupancy_stats",
    """SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS stddev, min(n) AS least, max(n) AS largest
FROM (SELECT count(vec_id) AS n FROM (SELECT unnest(range(12)) AS c) LEFT JOIN embeddings ON label = c GROUP BY c)""",
)
def occupancy_stats(spark, sf_dir):
    s = aggregates.occupancy_stats(aggregates.occupancy(embeddings(spark, sf_dir), 12, "label"))
    return s.select(F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "least", "largest")


@register(
    "balanced_range_packing",
    "SELECT vec_id, ntile(CAST(ceil((SELECT count(*) FROM embeddings) / 32.0) AS BIGINT)) OVER (ORDER BY label, vec_id) - 1 AS leaf FROM embeddings",
)
def balanced_range_packing(spark, sf_dir):
    return aggregates.balanced_ranges(embeddings(spark, sf_dir).select("vec_id", "label"), ["label", "vec_id"], 32).select("vec_id", "leaf")


@register("exact_chunks", "SELECT vec_id, CAST((row_number() OVER (ORDER BY label, vec_id) - 1) // 25 AS BIGINT) AS chunk FROM embeddings")
def exact_chunks(spark, sf_dir):
    return aggregates.exact_chunks(embeddings(spark, sf_dir).select("vec_id", "label"), ["label", "vec_id"], 25).select("vec_id", "chunk")


@register(
    "axis_quantile_bins",
    """WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, row_number() OVER (ORDER BY embedding[1]) AS r, count(*) OVER () AS n FROM embeddings),
c AS (SELECT x AS cut FROM v WHERE r IN (SELECT CAST(ceil(b * n / 8.0) AS BIGINT) FROM (SELECT unnest(range(1, 8)) AS b), (SELECT max(n) AS n FROM v)))
SELECT vec_id, (SELECT count(*) FROM c WHERE c.cut < v.x) AS bin FROM v""",
)
def axis_quantile_bins(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    x = F.get("embedding", F.lit(0)).cast("double")
    return e.select("vec_id", aggregates.bin_of(x, aggregates.quantile_cuts(e, x, 8)).alias("bin"))


@register(
    "histogram_buckets",
    """WITH v AS (SELECT embedding[2]::DOUBLE AS x FROM embeddings), m AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT CAST(floor((x - lo) / (hi - lo) * 63 + 0.5) AS BIGINT) AS bucket, count(*) AS n FROM v, m GROUP BY 1""",
)
def histogram_buckets(spark, sf_dir):
    return aggregates.histogram(embeddings(spark, sf_dir), F.get("embedding", F.lit(1)), 64)


@register(
    "compression_gain",
    f"""WITH x AS ({_EXPLODED}),
l AS (SELECT x, min(x) OVER (PARTITION BY label, pos) AS lo, max(x) OVER (PARTITION BY label, pos) AS hi FROM x),
g AS (SELECT x, min(x) OVER (PARTITION BY pos) AS lo, max(x) OVER (PARTITION BY pos) AS hi FROM x)
SELECT round(1 - (SELECT sum(CASE WHEN hi > lo THEN (x - (lo + floor((x - lo) / (hi - lo) * 255 + 0.5) / 255 * (hi - lo))) ** 2 ELSE 0 END) FROM l)
 / (SELECT sum(CASE WHEN hi > lo THEN (x - (lo + floor((x - lo) / (hi - lo) * 255 + 0.5) / 255 * (hi - lo))) ** 2 ELSE 0 END) FROM g), 6) AS gain""",
)
def compression_gain(spark, sf_dir):
    x = aggregates.exploded(embeddings(spark, sf_dir), "embedding", "vec_id", "label")
    return evaluation.compression_gain(x, "label").select(F.round("gain", 6).alias("gain"))


@register(
    "same_leaf_coherence",
    """WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM (
  SELECT a.vec_id AS qid, b.vec_id AS id, a.label AS la, b.label AS lb, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rk <= 10)
SELECT round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS coherence FROM k""",
)
def same_leaf_coherence(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    near = neighbors.knn(e, e, 10).select(F.col("qid").alias("entity_id"), F.col("id").alias("neighbor_id"))
    members = e.select(F.col("vec_id").alias("entity_id"), F.col("label").alias("cluster_id"))
    return evaluation.same_leaf_coherence(members, near).select(F.round("coherence", 6).alias("coherence"))


@register(
    "tnn_recall",
    """WITH e AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM (SELECT a.vec_id AS qid, b.vec_id AS id,
  1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)),
f AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rk FROM (SELECT a.vec_id AS qid, b.vec_id AS id,
  1 - list_cosine_similarity(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id))
SELECT f.qid, round(count(e.id) / 10.0, 6) AS recall FROM f LEFT JOIN e ON e.qid = f.qid AND e.id = f.id AND e.rk <= 10 WHERE f.rk <= 10 GROUP BY f.qid""",
)
def tnn_recall(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    half = e.withColumn("embedding", F.slice("embedding", 1, 32))
    found = neighbors.knn(half, half.where("vec_id % 100 = 0"), 10)
    return evaluation.tnn_recall(found, neighbors.knn(e, e.where("vec_id % 100 = 0"), 10), 10).select("qid", F.round("recall", 6).alias("recall"))


@register(
    "nearest_label_centroid",
    f"""WITH x AS ({_EXPLODED}), c AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM x GROUP BY label, pos) GROUP BY label)
SELECT vec_id, CAST(label AS BIGINT) AS cluster_id FROM (SELECT e.vec_id, c.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], c.c), c.label) AS r
FROM embeddings e, c) WHERE r = 1""",
)
def nearest_label_centroid(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    c = aggregates.centroids(e, "embedding", ["label"]).toPandas().pivot(index="label", columns="pos", values="mean").sort_index()
    return neighbors.assign_nearest(e, c.to_numpy(), "squared", "vec_id", "embedding").select("vec_id", F.element_at(F.array(*map(F.lit, c.index.tolist())), (F.col("cluster_id") + 1).cast("int")).cast("long").alias("cluster_id"))


@register(
    "packing_gates",
    """WITH l AS (SELECT vec_id, ntile(CAST(ceil((SELECT count(*) FROM embeddings) / 32.0) AS BIGINT)) OVER (ORDER BY label, vec_id) AS leaf FROM embeddings),
o AS (SELECT min(n) AS lo, max(n) AS hi FROM (SELECT count(*) AS n FROM l GROUP BY leaf))
SELECT 'exact_leaf_occupancy' AS gate, lo = 32 AND hi = 32 AS passed FROM o UNION ALL SELECT 'leaf_size_at_least', lo >= 16 FROM o UNION ALL SELECT 'leaf_size_at_most', hi <= 32 FROM o
UNION ALL SELECT 'complete_coverage', (SELECT count(DISTINCT vec_id) FROM l) = (SELECT count(*) FROM embeddings) UNION ALL SELECT 'one_cluster_per_entity', (SELECT count(*) = count(DISTINCT vec_id) FROM l) UNION ALL SELECT 'no_empty_declared_clusters', lo > 0 FROM o""",
)
def packing_gates(spark, sf_dir):
    leaves = balanced_range_packing(spark, sf_dir)
    members = leaves.select(F.col("vec_id").alias("entity_id"), F.col("leaf").alias("cluster_id"))
    occ = aggregates.occupancy(members, -(-leaves.count() // 32))
    return evaluation.gates(members, occ, embeddings(spark, sf_dir), 32)


for _family, _formula in {
    "well-clustered": "25.0 * (i % 4) + 0.05 * pos + 0.01 * (i // 4)",
    "weak-uniform": "((i * (pos + 3) + 17 * pos) % 97) / 97.0",
    "anisotropic": "CASE WHEN pos = 0 THEN 12.0 * i / 500 WHEN pos = 1 THEN 3 * sin(6.283185307179586 * (i / 500.0)) ELSE 0.2 * i / 500 * (pos + 1) END",
    "near-duplicate": "4.0 * (i % 5) + 0.25 * pos + 0.0005 * (i // 5)",
}.items():
    register(
        f"synthetic_{_family.replace('-', '_')}",
        f"SELECT i, CAST(pos AS BIGINT) AS pos, round(CAST({_formula} AS DOUBLE), 6) AS x FROM (SELECT unnest(range(500)) AS i), (SELECT unnest(range(4)) AS pos)",
    )(lambda spark, sf_dir, f=_family: evaluation.synthetic_corpus(spark, f, 500, 4).select("i", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")))


@register("pca_transform")
def pca_transform(spark, sf_dir):
    """Coordinates on the first eight principal directions."""
    e = embeddings(spark, sf_dir)
    out = pca.transform(e, pca.fit(e, k=8)).select("vec_id", F.posexplode("coords").alias("axis", "y"))
    return out.select("vec_id", F.col("axis").cast("long").alias("axis"), F.round("y", 6).alias("y"))


@register("pca_chunking")
def pca_chunking(spark, sf_dir):
    return pca.chunk(embeddings(spark, sf_dir), 10)


@register("spherical_kmeans")
def spherical_kmeans(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return clustering.spherical_kmeans(e, 8, 10).assign(e).withColumn("distance", F.round("distance", 6))


@register("balanced_clustering")
def balanced_clustering(spark, sf_dir):
    """Capacity-constrained clusters of all vectors."""
    e = embeddings(spark, sf_dir)
    n = e.count()
    return clustering.balanced(e, 4, n // 8, -(-n // 3))[1].select("vec_id", "cluster_id")


@register("directional_pca")
def directional_pca(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return clustering.directional_pca(e, 16).assign(e).withColumn("distance", F.round("distance", 6))


@register("adaptive_planning")
def adaptive_planning(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    policy = clustering.AdaptivePolicy()
    return spark.createDataFrame([(i, policy.choose(e, 8)) for i in range(2)], "boundary long, algorithm string")


@register(
    "hybrid_coarse",
    """WITH a AS (SELECT vec_id, embedding[1] AS x, embedding[2] AS y, count(*) OVER () AS n, row_number() OVER (ORDER BY embedding[1], embedding[2], vec_id) - 1 AS p FROM embeddings),
g AS (SELECT *, CASE WHEN p // (n // 10) < 4 THEN 0 WHEN p // (n // 10) < 7 THEN 1 ELSE 2 END AS grp FROM a)
SELECT vec_id, CAST((row_number() OVER (ORDER BY grp, y, x, vec_id) - 1) // (n // 10) AS BIGINT) AS cluster_id FROM g""",
)
def hybrid_coarse(spark, sf_dir):
    return clustering.hybrid_coarse(embeddings(spark, sf_dir), 10)


@register(
    "recursive_balanced",
    f"""WITH v0 AS ({_EXPLODED}), a0 AS (SELECT pos FROM v0 GROUP BY pos ORDER BY var_pop(x) DESC, pos LIMIT 1),
p0 AS (SELECT vec_id, (row_number() OVER (ORDER BY x, vec_id) - 1) // ((SELECT count(*) FROM embeddings) // 2) AS part FROM v0 WHERE pos = (SELECT pos FROM a0)),
v1 AS (SELECT v0.*, part FROM v0 JOIN p0 USING (vec_id)),
a1 AS (SELECT part, pos FROM (SELECT part, pos, row_number() OVER (PARTITION BY part ORDER BY var_pop(x) DESC, pos) AS r FROM v1 GROUP BY part, pos) WHERE r = 1)
SELECT vec_id, CAST((row_number() OVER (ORDER BY part, x, vec_id) - 1) // ((SELECT count(*) FROM embeddings) // 4) AS BIGINT) AS cluster_id FROM v1 JOIN a1 USING (part, pos)""",
)
def recursive_balanced(spark, sf_dir):
    return clustering.recursive_balanced(embeddings(spark, sf_dir), 4)


@register(
    "morton_chunks",
    "WITH m AS (SELECT vec_id, floor((embedding[1]::DOUBLE - min(embedding[1]) OVER ()) / (max(embedding[1]) OVER () - min(embedding[1]) OVER ()::DOUBLE) * 65535 + 0.5)::BIGINT AS cx, floor((embedding[2]::DOUBLE - min(embedding[2]) OVER ()) / (max(embedding[2]) OVER () - min(embedding[2]) OVER ()::DOUBLE) * 65535 + 0.5)::BIGINT AS cy FROM embeddings), c AS (SELECT vec_id, "
    + " + ".join(f"(((cx >> {i}) & 1) << {2 * i}) + (((cy >> {i}) & 1) << {2 * i + 1})" for i in range(16))
    + " AS code FROM m) SELECT vec_id, code, ntile(10) OVER (ORDER BY code, vec_id) - 1 AS cluster_id FROM c",
)
def morton_chunks(spark, sf_dir):
    return clustering.morton_chunks(embeddings(spark, sf_dir), 10)


@register(
    "farthest_points",
    """WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b),
f AS (SELECT min(vec_id) AS p FROM embeddings), s AS (SELECT b AS p FROM d WHERE a = (SELECT p FROM f) ORDER BY d DESC, b LIMIT 1),
t AS (SELECT b AS p FROM d WHERE a IN (SELECT p FROM f UNION ALL SELECT p FROM s) GROUP BY b ORDER BY min(d) DESC, b LIMIT 1)
SELECT 0::BIGINT AS step, p AS vec_id FROM f UNION ALL SELECT 1, p FROM s UNION ALL SELECT 2, p FROM t""",
)
def farthest_points(spark, sf_dir):
    ids, _ = clustering.farthest_points(embeddings(spark, sf_dir), 3)
    return spark.createDataFrame(list(enumerate(ids)), "step long, vec_id long")


def _index(spark: SparkSession, sf_dir: str, version: str = "0.8.0") -> indexer.Index:
    """Index of the embeddings, with the texts of documents of the same number as content."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.col("text").cast("binary").alias("body"))
    e = embeddings(spark, sf_dir).join(docs, F.col("vec_id") == F.col("d"), "left")
    items = e.select(F.col("vec_id").alias("idx"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"), F.lit("text/plain").alias("media_type"), "body")
    return indexer.build(indexer.leaves(items), version)


@register("index_blocks")
def index_blocks(spark, sf_dir):
    """Ids and sizes of all blocks of the index."""
    return _index(spark, sf_dir).sizes().select(F.hex("block_id").alias("block_id"), "size")


@register("index_level_stats")
def index_level_stats(spark, sf_dir):
    return indexer.level_stats(_index(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("target"))


@register("search_best_first")
def search_best_first(spark, sf_dir):
    results, _ = search.best_first(_index(spark, sf_dir), _targets(spark, sf_dir), 4, 10)
    return results.select("qid", "position", F.hex("leaf").alias("leaf"), F.round("score", 6).alias("score"))


@register("search_geometry_aware")
def search_geometry_aware(spark, sf_dir):
    _, told = search.best_first(_index(spark, sf_dir), _targets(spark, sf_dir), 4, 10, "geometry-aware")
    return told


@register("search_greedy_beam")
def search_greedy_beam(spark, sf_dir):
    found = search.greedy_beam(_index(spark, sf_dir), _targets(spark, sf_dir), 4, 10)
    return found.select("qid", "rk", F.hex("leaf").alias("leaf"), F.round("score", 6).alias("score"))


@register("content_ids", "SELECT sha256(text) AS content_id, count(*) AS documents FROM documents GROUP BY 1")
def content_ids(spark, sf_dir):
    """Content addresses of documents: equal texts share one."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_id")).agg(F.count("*").alias("documents"))


@register(
    "ambient_delta_codes",
    f"""WITH x AS ({_EXPLODED}), d AS (SELECT vec_id, label, pos, x - (avg(x) OVER (PARTITION BY label, pos))::FLOAT::DOUBLE AS d FROM x),
s AS (SELECT *, (max(abs(d)) OVER (PARTITION BY label, pos) / 127)::FLOAT::DOUBLE AS scale FROM d)
SELECT vec_id, CAST(pos AS BIGINT) AS pos, CAST(greatest(-127, least(127, round_even(d / scale, 0))) AS BIGINT) AS code FROM s""",
)
def ambient_delta_codes(spark, sf_dir):
    """Eight-bit codes of differences from the centroid of each label's block."""
    w = Window.partitionBy("label", "pos")
    x = aggregates.exploded(embeddings(spark, sf_dir), "embedding", "vec_id", "label")
    d = x.withColumn("d", F.col("x") - F.avg("x").over(w).cast("float").cast("double"))
    s = d.withColumn("scale", (F.max(F.abs("d")).over(w) / 127).cast("float").cast("double"))
    code = F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(F.col("d") / F.col("scale"))))
    return s.select("vec_id", F.col("pos").cast("long").alias("pos"), code.cast("long").alias("code"))


def _label_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf clusters: chunks of 25 vectors in order of label and id, with centroid, members and dispersion."""
    e = embeddings(spark, sf_dir)
    chunks = exact_chunks(spark, sf_dir).select(F.col("vec_id").alias("v"), "chunk")
    s = hierarchy.exact_summaries(e.join(chunks, F.col("vec_id") == F.col("v")), "chunk")
    return s.select("cluster_id", "centroid", "members", F.col("variance").alias("dispersion"))


@register("hierarchy_refinement")
def hierarchy_refinement(spark, sf_dir):
    """Refinement ratios of hierarchies by all strategies over the same leaves."""
    leaves = checkpoint(_label_leaves(spark, sf_dir))
    beta = hierarchy.refinement(hierarchy.build_each(leaves, hierarchy.STRATEGIES, 2, 5), "strategy")
    return beta.select("strategy", "node", "parent", F.round("beta", 6).alias("beta"))


@register(
    "label_dispersion",
    f"""WITH x AS ({_EXPLODED}), m AS (SELECT *, avg(x) OVER (PARTITION BY label, pos) AS mean FROM x)
SELECT CAST(label AS BIGINT) AS cluster_id, count(DISTINCT vec_id) AS members, round(sum((x - mean) ** 2) / count(DISTINCT vec_id), 6) AS variance FROM m GROUP BY label""",
)
def label_dispersion(spark, sf_dir):
    s = hierarchy.exact_summaries(embeddings(spark, sf_dir), "label")
    return s.select("cluster_id", "members", F.round("variance", 6).alias("variance"))
