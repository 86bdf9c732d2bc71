"""Queries of hierarchies from below, cell replay, blocks and their entries, PCA maps and repeat runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vectorgrove.operators import affine, aggregates, assembly, identity, panel, pca
from vectorgrove.queries import embeddings, register
from vectorgrove.session import checkpoint, ensure_checkpoint_dir, remove
from vectorgrove.sources import entries as typed
from vectorgrove.sources.blocks import BlockTable, overlay


def _units(spark, sf_dir):
    return embeddings(spark, sf_dir).select(F.col("vec_id").cast("long").alias("unit"), F.lit(1).cast("long").alias("items"), F.col("embedding").alias("vector"))


_FIRST = "g AS (SELECT label * 1000000 + vec_id // 97 AS grp, count(*) AS n FROM embeddings GROUP BY 1)"


@register(
    "agglomerative_hierarchy",
    f"""WITH RECURSIVE {_FIRST}, lv AS (SELECT 1 AS level, count_if(n > 1) AS nodes FROM g UNION ALL SELECT level + 1, (nodes + 7) // 8 FROM lv WHERE nodes > 1)
SELECT CAST(0 AS INTEGER) AS level, count(*) AS nodes, count(*) AS items, 0 AS orphans FROM embeddings
UNION ALL SELECT CAST(level AS INTEGER), nodes, (SELECT count(*) FROM embeddings), CAST(CASE WHEN nodes = 1 THEN 1 ELSE 0 END AS BIGINT) FROM lv""",
)
def agglomerative_hierarchy(spark, sf_dir):
    """By level: nodes, items that they stand for, and nodes without a parent."""
    labels = embeddings(spark, sf_dir).select(F.col("vec_id").alias("v"), "label")

    def grouping(layer, level):
        if level:
            return layer.select("unit", F.lit(0).alias("grp"))
        return layer.join(labels, F.col("unit") == F.col("v")).select("unit", (F.col("label") * 1000000 + F.floor(F.col("unit") / 97)).alias("grp"))

    nodes = assembly.agglomerate(_units(spark, sf_dir), grouping, 8)
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("items").alias("items"), F.count_if(F.col("parent").isNull()).alias("orphans"))


@register(
    "agglomerative_first_groups",
    f"""WITH {_FIRST}, big AS (SELECT grp FROM g ORDER BY n DESC, grp LIMIT 1),
m AS (SELECT vec_id, CASE WHEN g.n = 1 THEN (SELECT grp FROM big) ELSE g.grp END AS grp FROM embeddings e JOIN g ON g.grp = e.label * 1000000 + e.vec_id // 97)
SELECT vec_id AS unit, min(vec_id) OVER (PARTITION BY grp) AS parent FROM m""",
)
def agglomerative_first_groups(spark, sf_dir):
    """Each vector's parent, groups of one being part of the largest group."""
    first = embeddings(spark, sf_dir).select(F.col("vec_id").alias("unit"), (F.col("label") * 1000000 + F.floor(F.col("vec_id") / 97)).alias("grp"))
    merged = checkpoint(assembly.with_singletons_merged(first)[0])
    parents = merged.groupBy(F.col("grp").alias("g")).agg(F.min("unit").alias("parent"))
    return merged.join(parents, F.col("grp") == F.col("g")).select("unit", "parent")


@register(
    "hybrid_hierarchy",
    """WITH RECURSIVE lv AS (SELECT 0 AS level, count(*) AS nodes FROM embeddings UNION ALL
  SELECT level + 1, CASE WHEN level = 0 THEN (SELECT count(DISTINCT label) FROM embeddings) ELSE (nodes + 3) // 4 END FROM lv WHERE nodes > 1)
SELECT CAST(level AS INTEGER) AS level, nodes FROM lv""",
)
def hybrid_hierarchy(spark, sf_dir):
    """Nodes by level where large layers are grouped by label and others, all of a table that small, by nothing."""
    labels = checkpoint(embeddings(spark, sf_dir).select(F.col("vec_id").alias("v"), "label"))
    nothing = lambda layer, level: layer.select("unit", F.lit(0).alias("grp"))
    by_label = lambda layer, level: layer.join(labels, F.col("unit") == F.col("v")).select("unit", F.col("label").alias("grp"))
    phase = assembly.hybrid(nothing, by_label, 1)
    nodes = assembly.agglomerate(_units(spark, sf_dir), lambda layer, level: (phase if level == 0 else nothing)(layer, level), 4)
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"))


@register(
    "cell_replay",
    """WITH c AS (SELECT vec_id AS idx, label AS cell, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT idx, cell, CAST(CASE WHEN p < n // 2 THEN 0 WHEN p < n // 2 + n // 3 THEN 1 END AS INTEGER) AS child FROM c""",
)
def cell_replay(spark, sf_dir):
    """Half of each cell's items go to its first child, a third to the second, none has room for the rest."""
    rows = embeddings(spark, sf_dir).select(F.col("label").alias("cell"), F.col("vec_id").alias("idx"))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("m"))
    half, third = sizes.select("cell", F.lit(0).alias("child"), F.floor(F.col("m") / 2).alias("n")), sizes.select("cell", F.lit(1), F.floor(F.col("m") / 3))
    return assembly.replayed(rows, checkpoint(half.union(third)))


@register("harvested_entities", "SELECT CAST(vec_id AS VARCHAR) AS entity_id, label FROM embeddings ORDER BY 1 LIMIT 100")
def harvested_entities(spark, sf_dir):
    """The first hundred real entities of the aligned corpus, with their labels."""
    corpus = panel.aligned(embeddings(spark, sf_dir), 48)
    labels = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("v"), "label")
    return assembly.harvested(corpus, 100).join(labels, F.col("entity_id") == F.col("v")).select("entity_id", "label")


@register("determinism_check", "SELECT 0 AS missing, 0 AS added")
def determinism_check(spark, sf_dir):
    """Two runs of chunking in the order of hashes, the second on rows dealt otherwise."""
    deals = iter((3, 5))
    return assembly.repeated_differences(lambda: identity.shuffled_chunks(embeddings(spark, sf_dir).repartition(next(deals)), 32))


@register(
    "planning_averages",
    "SELECT label AS planner, count(*) FILTER (vec_id % 3 <> 0) AS runs, round(avg(CASE WHEN vec_id % 3 <> 0 THEN CAST(embedding[1] AS DOUBLE) END), 6) AS quality FROM embeddings GROUP BY label",
)
def planning_averages(spark, sf_dir):
    quality = F.when(F.col("vec_id") % 3 != 0, F.get("embedding", F.lit(0)).cast("double"))
    runs = embeddings(spark, sf_dir).select(F.col("label").alias("planner"), quality.alias("quality"))
    return assembly.planning_averages(runs).withColumn("quality", F.round("quality", 6))


@register("total_order_rank", "SELECT vec_id, row_number() OVER (ORDER BY CAST(embedding[1] AS DOUBLE), vec_id) - 1 AS place FROM embeddings")
def total_order_rank(spark, sf_dir):
    keys = embeddings(spark, sf_dir).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    first, second = assembly.total_order(F.col("x"))
    return aggregates.rank_in_order(keys.select("vec_id", first.alias("a"), second.alias("b")), ["a", "b", "vec_id"]).select("vec_id", "place")


def _leaves(spark, sf_dir):
    meta = F.create_map(F.lit("vec_id"), F.col("vec_id").cast("string"))
    rows = embeddings(spark, sf_dir).select("embedding", meta.alias("metadata"), F.lit("text/plain").alias("media_type"), F.col("label").cast("string").alias("body"))
    return typed.leaves(rows)


@register(
    "block_entries",
    """SELECT vec_id, CAST(0 AS INTEGER) AS level, 'f32le' AS encoding, 'text/plain' AS media_type, CAST(label AS VARCHAR) AS body,
  CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings""",
)
def block_entries(spark, sf_dir):
    """Components and contents of leaves that were encoded, checked against their ids and decoded."""
    e = typed.entries(_leaves(spark, sf_dir))
    vec_id = F.element_at("metadata", F.lit("vec_id")).cast("long").alias("vec_id")
    out = e.select(vec_id, "level", "encoding", "media_type", F.col("body").cast("string").alias("body"), F.posexplode("embedding").alias("pos", "x"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@register(
    "store_put_get",
    """SELECT vec_id, vec_id % 2 = 0 OR vec_id % 3 = 0 AS found, (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0) AS stored,
  CASE WHEN vec_id % 3 = 0 THEN 'second' WHEN vec_id % 2 = 0 THEN 'first' END AS layer FROM embeddings""",
)
def store_put_get(spark, sf_dir):
    """What gets of all ids find after two overlapping puts, how many blocks are stored, and the layer of an overlay that has each."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}"
    blocks = checkpoint(_leaves(spark, sf_dir))
    ids = checkpoint(typed.entries(blocks).select("block_id", F.element_at("metadata", F.lit("vec_id")).cast("long").alias("vec_id")))
    store = BlockTable(spark, folder)
    mine = [ids.where(F.col("vec_id") % k == 0).select(F.col("block_id").alias("b")) for k in (2, 3)]
    puts = [blocks.join(m, F.col("block_id") == F.col("b")).drop("b") for m in mine]
    for p in puts:
        store.put(p)
    got = checkpoint(store.get(ids).select(F.col("block_id").alias("g"), F.col("bytes").isNotNull().alias("found")))
    stored = store.blocks().count()
    tagged = [p.select("block_id", F.lit(name).cast("binary").alias("bytes")) for p, name in zip(puts, ("first", "second"), strict=True)]
    layers = overlay([tagged[1], tagged[0]]).select(F.col("block_id").alias("o"), F.col("bytes").cast("string").alias("layer"))
    remove(spark, folder)
    out = ids.join(got, F.col("block_id") == F.col("g")).join(layers, F.col("block_id") == F.col("o"), "left")
    return out.select("vec_id", "found", F.lit(stored).cast("long").alias("stored"), "layer")


@register("pca_rebase", "SELECT vec_id, true AS close FROM embeddings")
def pca_rebase(spark, sf_dir):
    """Whether coordinates moved from the model of even labels to that of all vectors are those of the latter."""
    e = embeddings(spark, sf_dir)
    some, whole = pca.fit(e.where("label % 2 = 0")), pca.fit(e)
    shared = spark.sparkContext.broadcast((affine.encoder(some).then(affine.delta(some, whole)), whole))

    def run(frames):
        for x in frames:
            v = pca.matrix(x["embedding"])
            moved, model = shared.value
            x["close"] = abs(moved.apply(v) - model.apply(v)).max(axis=1) < 1e-6
            yield x[["vec_id", "close"]]

    return e.select("vec_id", "embedding").mapInPandas(run, "vec_id long, close boolean")
