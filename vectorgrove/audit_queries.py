"""Queries of identity, trees, alignment, quantization, scores and index profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectorgrove.functions import vectors as V
from vectorgrove.operators import aggregates, identity, panel, trees
from vectorgrove.queries import _index, embeddings, register, table


@register(
    "dataset_fingerprint",
    """WITH r AS (SELECT sha256(CAST(doc_id AS VARCHAR) || chr(31) || coalesce(text, '')) AS d, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
SELECT CAST(p // 256 AS BIGINT) AS chunk, sha256(string_agg(d, '' ORDER BY p)) AS digest FROM r GROUP BY p // 256""",
)
def dataset_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return identity.fingerprint(docs, ["doc_id"], F.concat(F.col("doc_id").cast("string"), F.lit("\x1f"), F.col("text")), 256)


@register("shuffled_chunks")
def shuffled_chunks(spark, sf_dir):
    return identity.shuffled_chunks(embeddings(spark, sf_dir), 32)


@register("fixture_assignment")
def fixture_assignment(spark, sf_dir):
    return embeddings(spark, sf_dir).select("vec_id", identity.fixture_cluster(F.col("embedding"), 8, 7).alias("cluster_id"))


@register(
    "replay_differences",
    """WITH a AS (SELECT vec_id, label FROM embeddings), b AS (SELECT vec_id, CASE WHEN vec_id % 97 = 5 THEN label + 1 ELSE label END AS label FROM embeddings)
SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS missing, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS added""",
)
def replay_differences(spark, sf_dir):
    """What a second pass with some changed labels has and hasn't."""
    a = embeddings(spark, sf_dir).select("vec_id", "label")
    return identity.differences(a, a.withColumn("label", F.col("label") + (F.col("vec_id") % 97 == 5).cast("long")))


_LEVELS = """WITH RECURSIVE lv AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY label, vec_id) - 1 AS spot, (SELECT count(*) FROM embeddings) AS n FROM embeddings
  UNION ALL
  SELECT DISTINCT level + 1, CASE WHEN spot < (n % g) * (n // g + 1) THEN spot // (n // g + 1) ELSE n % g + (spot - (n % g) * (n // g + 1)) // (n // g) END, g
  FROM (SELECT *, (n + 7) // 8 AS g FROM lv WHERE n > 1)),
e AS (SELECT level, spot, CASE WHEN spot < (n % g) * (n // g + 1) THEN spot // (n // g + 1) ELSE n % g + (spot - (n % g) * (n // g + 1)) // (n // g) END AS up FROM (SELECT *, (n + 7) // 8 AS g FROM lv WHERE n > 1))"""


@register(
    "tree_traversal",
    _LEVELS
    + """
SELECT CAST(lv.level AS VARCHAR) || '-' || CAST(lv.spot AS VARCHAR) AS node, CAST((SELECT max(level) FROM lv) - lv.level AS INTEGER) AS depth,
  CAST(CASE WHEN lv.n > 1 THEN 1 ELSE 0 END AS BIGINT) AS "references", coalesce(c.children, 0) AS children
FROM lv LEFT JOIN (SELECT level + 1 AS level, up, count(*) AS children FROM e GROUP BY ALL) c ON c.level = lv.level AND c.up = lv.spot""",
)
def tree_traversal(spark, sf_dir):
    """All nodes of a balanced tree over the embeddings, found from its root."""
    edges = trees.balanced_tree(embeddings(spark, sf_dir), ["label", "vec_id"], 8)
    return trees.traverse(edges, trees.root_of(edges))


@register(
    "tree_over_cap",
    _LEVELS + " SELECT CAST(level + 1 AS VARCHAR) || '-' || CAST(up AS VARCHAR) AS parent, count(*) AS children FROM e GROUP BY level, up HAVING count(*) > 7",
)
def tree_over_cap(spark, sf_dir):
    return trees.over_cap(trees.balanced_tree(embeddings(spark, sf_dir), ["label", "vec_id"], 8), 7)


@register("largest_blocks", "SELECT row_number() OVER (ORDER BY size DESC, block_id) AS rank, block_id, size FROM (SELECT doc_id AS block_id, strlen(coalesce(text, '')) AS size FROM documents) ORDER BY size DESC, block_id LIMIT 20")
def largest_blocks(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return trees.largest(sizes, 20)


@register(
    "hierarchy_violations",
    """WITH n AS (SELECT count(*) AS n FROM embeddings), x AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings),
b AS (SELECT count_if(vec_id % 50 = 3) AS lost, count_if(vec_id % 40 = 7 AND vec_id % 50 <> 3) AS twice FROM x)
SELECT 'one_root' AS rule, 0 AS broken UNION ALL SELECT 'root_covers_all', 0 UNION ALL SELECT 'items_in_range', 0 UNION ALL SELECT 'parent_exists', 1
UNION ALL SELECT 'terminal_has_items', 1 UNION ALL SELECT 'terminal_has_no_children', 0 UNION ALL SELECT 'inner_has_children', 0
UNION ALL SELECT 'items_in_a_child', lost FROM b UNION ALL SELECT 'items_from_parent', 0 UNION ALL SELECT 'items_in_one_child', count_if(vec_id % 40 = 7 AND vec_id % 50 <> 3 AND label <> 0) FROM x""",
)
def hierarchy_violations(spark, sf_dir):
    """Rules broken by a hierarchy of labels that lost some items, has some twice, and has a partition without items or parent."""
    x = aggregates.rank_in_order(embeddings(spark, sf_dir).select("vec_id", "label"), ["vec_id"]).withColumnRenamed("place", "idx")
    name = F.concat(F.lit("p0."), F.col("label").cast("string"))
    parts = x.select(name.alias("pid"), F.lit("p0").alias("parent"), F.lit(True).alias("terminal")).distinct()
    parts = parts.union(spark.createDataFrame([("p0", None, False), ("stray", "p9", True)], "pid string, parent string, terminal boolean"))
    kept = x.where("vec_id % 50 <> 3")
    items = x.select(F.lit("p0").alias("pid"), "idx").union(kept.select(name, "idx")).union(kept.where("vec_id % 40 = 7 AND label <> 0").select(F.lit("p0.0"), "idx"))
    return trees.violations(parts, items, x.count())


@register(
    "aligned_padding",
    """WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT count(*) AS n, max(list_max(list_transform(e, lambda x: abs(x)))) AS m FROM r),
l AS (SELECT sqrt(list_inner_product(e, e)) AS length, row_number() OVER (ORDER BY sqrt(list_inner_product(e, e)), CAST(vec_id AS VARCHAR)) - 1 AS p, count(*) OVER () AS c FROM r),
t AS (SELECT length FROM l WHERE p = c // 2),
p AS (SELECT k, list_transform(range(64), lambda j: greatest(1.0, m) + 10.0 + k + j * 0.125) AS raw FROM n, (SELECT unnest(range(1000)) AS k) WHERE k < ((n + 47) // 48) * 48 - n)
SELECT 'synthetic-' || lpad(CAST(k AS VARCHAR), 6, '0') AS entity_id, j - 1 AS pos, round(raw[j] * length / sqrt(list_inner_product(raw, raw)), 6) AS x FROM p, t, (SELECT unnest(range(1, 65)) AS j)""",
)
def aligned_padding(spark, sf_dir):
    """Components of the vectors that fill the embeddings up to leaves of 48."""
    made = panel.aligned(embeddings(spark, sf_dir), 48).where("synthetic")
    return aggregates.exploded(made, "embedding", "entity_id").select("entity_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@register(
    "padding_concentration",
    """WITH m AS (SELECT label AS c, vec_id % 9 = 2 AS synthetic FROM embeddings)
SELECT CAST(sum(CASE WHEN synthetic THEN 1 ELSE 0 END) AS BIGINT) AS synthetic, count(DISTINCT CASE WHEN synthetic THEN c END) AS clusters,
  CAST(ceil(sum(CASE WHEN synthetic THEN 1 ELSE 0 END) / 16.0) AS BIGINT) AS least, count(DISTINCT CASE WHEN synthetic THEN c END) = ceil(sum(CASE WHEN synthetic THEN 1 ELSE 0 END) / 16.0) AS met FROM m""",
)
def padding_concentration(spark, sf_dir):
    members = embeddings(spark, sf_dir).select(F.col("label").alias("cluster_id"), (F.col("vec_id") % 9 == 2).alias("s"))
    return panel.padding_concentration(aggregates.occupancy(members, 10, synthetic_col="s"), 16)


@register(
    "quantized_vectors",
    """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) > 0 THEN list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127.0 ELSE 1.0 END AS s FROM embeddings)
SELECT vec_id, round(s, 9) AS scale, CAST(generate_subscripts(e, 1) - 1 AS BIGINT) AS pos, CAST(round_even(unnest(e) / s, 0) AS INTEGER) AS code FROM s""",
)
def quantized_vectors(spark, sf_dir):
    q = embeddings(spark, sf_dir).select("vec_id", panel.quantized(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.posexplode("q.codes").alias("pos", "code")).withColumn("pos", F.col("pos").cast("long"))


@register(
    "chunk_lookup",
    """WITH k AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS key FROM embeddings), c AS (SELECT key, (row_number() OVER (ORDER BY key, vec_id) - 1) // 32 AS chunk FROM k),
b AS (SELECT chunk, max(key) AS bound FROM c GROUP BY chunk), u AS (SELECT bound FROM b WHERE chunk < (SELECT max(chunk) FROM b))
SELECT k.vec_id, (SELECT count(*) FROM u WHERE u.bound < k.key) AS chunk FROM k""",
)
def chunk_lookup(spark, sf_dir):
    keys = embeddings(spark, sf_dir).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("key"))
    return keys.select("vec_id", panel.chunk_of(F.col("key"), panel.chunk_bounds(keys, "key", "vec_id", 32)).alias("chunk"))


@register(
    "embedding_validity",
    """SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AS directed FROM embeddings""",
)
def embedding_validity(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.select("vec_id", ((F.size("embedding") == 64) & finite).alias("valid"), (V.norm(F.col("embedding")) > 0).alias("directed"))


@register(
    "panel_scores",
    """WITH m AS (SELECT 'label' || CAST(label AS VARCHAR) AS candidate, avg(CAST(embedding[1] AS DOUBLE)) AS a, avg(CAST(embedding[2] AS DOUBLE)) AS b FROM embeddings GROUP BY label)
SELECT candidate, round(a + 0.5 * b, 6) AS score FROM m""",
)
def panel_scores(spark, sf_dir):
    """Weighted sums of two metrics of ten candidates."""
    e = embeddings(spark, sf_dir)
    name = F.concat(F.lit("label"), F.col("label").cast("string"))
    metric = lambda kind, i: e.groupBy(name.alias("candidate")).agg(F.avg(F.get("embedding", F.lit(i)).cast("double")).alias("value")).withColumn("metric", F.lit(kind))
    both = metric("coherence", 0).unionByName(metric("compression_gain", 1)).unionByName(metric("other", 2))
    return panel.weighted_scores(both).withColumn("score", F.round("score", 6))


@register(
    "beam_reports",
    """WITH r AS (SELECT label % 3 + 1 AS beam_width, vec_id % 17 AS visited, vec_id % 5 AS depth, (vec_id % 10) / 10.0 AS recall, vec_id % 4 = 0 AS ok FROM embeddings)
SELECT CAST(beam_width AS BIGINT) AS beam_width, count(*) AS queries, round(avg(visited), 6) AS visited, round(avg(depth), 6) AS depth, round(avg(recall), 6) AS recall, count_if(ok) AS succeeded, count_if(NOT ok) AS exhausted FROM r GROUP BY beam_width""",
)
def beam_reports(spark, sf_dir):
    runs = embeddings(spark, sf_dir).select(
        (F.col("label") % 3 + 1).alias("beam_width"), (F.col("vec_id") % 17).alias("visited"), (F.col("vec_id") % 5).alias("depth"), (F.col("vec_id") % 10 / 10.0).alias("recall"),
        F.when(F.col("vec_id") % 4 == 0, "success").otherwise("exhausted").alias("termination"),
    )
    return panel.beam_reports(runs).select("beam_width", "queries", *(F.round(c, 6).alias(c) for c in ("visited", "depth", "recall")), "succeeded", "exhausted")


def _register_profile(version: str) -> None:
    @register(
        "index_profile_" + version.replace(".", "_"),
        "SELECT count(*) AS items, count(*) AS reached, 0 AS missing_blocks, 0 AS over_cap, 1 AS roots FROM embeddings",
    )
    def index_profile(spark, sf_dir):
        """Items and leaves reached from the root, children without blocks, blocks beyond the bound, and roots."""
        index = _index(spark, sf_dir, version)
        edges = index.edges.select(F.hex("parent").alias("parent"), F.hex("child").alias("child"), "child_level")
        reached = trees.traverse(edges, trees.root_of(edges))
        leaves = reached.where("children = 0").agg(F.count("*").alias("reached"))
        there = index.blocks.select(F.hex("block_id").alias("b"))
        missing = edges.join(there, F.col("child") == F.col("b"), "left_anti").agg(F.count("*").alias("missing_blocks"))
        over = trees.over_cap(edges, index.bound).agg(F.count("*").alias("over_cap"))
        roots = trees.root_of(edges).agg(F.count("*").alias("roots"))
        return embeddings(spark, sf_dir).agg(F.count("*").alias("items")).join(leaves).join(missing).join(over).join(roots)  # one row each


for _version in ("0.1.0", "0.4.1", "0.8.0"):
    _register_profile(_version)
