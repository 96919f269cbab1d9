"""Property graph as edge tables: shared-entity and mention neighbours, bounded expansion, reachability.

A traversal is a loop over at most four levels; each level is joins and a per-node top-n
window, cut by a reliable checkpoint.  Seeds carry a ``query_id``, so all questions advance
together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.plans.settings import Expansion
from dossier.plans.shared import cut

SHARED_BASE, CITES_BASE, CITED_BASE = 0.2, 1.0, 0.9


def unique_owners(identifiers: DataFrame) -> DataFrame:
    """(number_norm, document_id) of the identifiers that exactly one document has."""
    one = identifiers.groupBy("number_norm").agg(F.min("document_id").alias("document_id"), F.countDistinct("document_id").alias("n"))
    return one.where("n = 1").select("number_norm", "document_id")


def both_directions(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """Each edge as a step from either end; ``forward`` tells its direction."""
    kept = edges.columns
    out = edges.select(F.col(source).alias("at"), F.col(target).alias("to"), F.lit(True).alias("forward"), *kept)
    return out.unionByName(edges.select(F.col(target).alias("at"), F.col(source).alias("to"), F.lit(False).alias("forward"), *kept))


def shared_neighbours(seeds: DataFrame, entities: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, seed, related, strength): documents that share entities (document_id, etype, entity_key) with a seed."""
    mine = seeds.join(entities.withColumnRenamed("document_id", "seed"), "seed")
    theirs = entities.select(F.col("document_id").alias("related"), "etype", "entity_key")
    met = mine.join(theirs, ["etype", "entity_key"]).where("related <> seed")
    strength = met.groupBy("query_id", "seed", "related").agg(F.countDistinct("etype", "entity_key").alias("strength"))
    return _best(strength, most, F.desc("strength"), "seed", "related")


def cited_neighbours(seeds: DataFrame, mentions: DataFrame, owners: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, seed, related): the only owners of the identifiers a seed mentions."""
    hits = seeds.join(mentions.withColumnRenamed("document_id", "seed"), "seed").join(owners.withColumnRenamed("document_id", "related"), "number_norm")
    return _best(hits.where("related <> seed").select("query_id", "seed", "related").distinct(), most, "seed", "related")


def citing_neighbours(seeds: DataFrame, mentions: DataFrame, owners: DataFrame, most: int | None = None) -> DataFrame:
    """(query_id, seed, related): the documents that mention an identifier only the seed owns."""
    hits = seeds.join(owners.withColumnRenamed("document_id", "seed"), "seed").join(mentions.withColumnRenamed("document_id", "related"), "number_norm")
    return _best(hits.where("related <> seed").select("query_id", "seed", "related").distinct(), most, "seed", "related")


def _best(df: DataFrame, most: int | None, *order) -> DataFrame:
    if most is None:
        return df
    return df.withColumn("__n", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def saturating(strength, base: Column) -> Column:
    """Sum of base times strength (at least 1), never above 1."""
    return F.least(F.lit(1.0), F.sum(base * F.greatest(F.lit(1), strength)))


def expand_documents(seeds: DataFrame, entities: DataFrame, mentions: DataFrame, owners: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """(query_id, document_id, graph_score, relations, seeds, evidence): one hop from the seeds (query_id, seed).

    Verified relations score 1 and may lead to another seed; other neighbours never are seeds.
    """
    most = 3 * limit
    shared = shared_neighbours(seeds, entities, most).select("query_id", "seed", "related", F.lit("shared_metadata").alias("kind"), F.lit(SHARED_BASE).alias("base"), "strength")
    cites = cited_neighbours(seeds, mentions, owners, most).select("query_id", "seed", "related", F.lit("cites").alias("kind"), F.lit(CITES_BASE).alias("base"), F.lit(1).alias("strength"))
    cited = citing_neighbours(seeds, mentions, owners, most).select("query_id", "seed", "related", F.lit("cited_by").alias("kind"), F.lit(CITED_BASE).alias("base"), F.lit(1).alias("strength"))
    plain = shared.unionByName(cites).unionByName(cited)
    plain = plain.join(seeds.select("query_id", F.col("seed").alias("related")), ["query_id", "related"], "left_anti")
    plain = plain.withColumn("score", F.col("base") * F.greatest(F.lit(1), F.col("strength"))).withColumn("evidence", F.lit(None).cast("string"))
    steps = both_directions(relations).where("at <> to")
    known = steps.join(owners.select(F.col("document_id").alias("target_id")), "target_id", "left_semi")
    verified = seeds.join(known, seeds["seed"] == known["at"]).select(
        "query_id", "seed", F.col("to").alias("related"), F.col("kind"), F.lit(1.0).alias("score"), F.to_json(F.struct("source_id", "target_id", "kind", F.col("evidence"))).alias("evidence")
    )
    rows = plain.select("query_id", "seed", "related", "kind", "score", "evidence").unionByName(verified)
    out = rows.groupBy("query_id", F.col("related").alias("document_id")).agg(
        F.least(F.lit(1.0), F.sum("score")).alias("graph_score"), F.sort_array(F.collect_set("kind")).alias("relations"),
        F.sort_array(F.collect_set("seed")).alias("seeds"), F.sort_array(F.collect_set("evidence")).alias("evidence"),
    )
    return _best(out, limit, F.desc(F.size("evidence") > 0), F.desc("graph_score"), "document_id")


def as_of(moment: str) -> Column:
    """Edges known to hold at an ISO date; all of them for ''."""
    if not moment:
        return F.lit(True)
    begun = (F.col("valid_from") == "") | (F.col("valid_from") <= moment)
    return (F.col("temporal_status") == "known") & begun & ((F.col("valid_to") == "") | (F.lit(moment) < F.col("valid_to")))


def usable_edges(edges: DataFrame, settings: Expansion, current: DataFrame | None = None, ready: DataFrame | None = None, moment: str = "") -> DataFrame:
    """Edges of the mode's kinds with enough confidence, valid at ``moment``, whose endpoints are unchanged (``current``: id, structure_hash) and ready."""
    kept = edges.where(F.col("kind").isin(settings.kinds) & (F.col("confidence") >= settings.confidence))
    if "valid_from" in edges.columns:
        kept = kept.where(as_of(moment))
    if current is not None:
        for end in ("source", "target"):
            now = current.select(F.col("id").alias(f"{end}_id"), F.col("structure_hash").alias(f"{end}_hash"))
            kept = kept.join(now, [f"{end}_id", f"{end}_hash"], "left_semi")
    if ready is not None:
        for end in ("source_id", "target_id"):
            kept = kept.join(ready.select(F.col("id").alias(end)), end, "left_semi")
    return kept


def siblings(provisions: DataFrame, with_chunks: DataFrame, most: int) -> DataFrame:
    """(at, to, distance): the nearest other articles of the same parent that have chunks."""
    articles = provisions.where("level = 'Article'").select("id", "parent_id", "start_pos")
    other = articles.join(with_chunks.select(F.col("article_id").alias("id")).distinct(), "id", "left_semi")
    other = other.select(F.col("id").alias("to"), "parent_id", F.col("start_pos").alias("there"))
    near = articles.join(other, "parent_id").where("id <> to").select(F.col("id").alias("at"), "to", F.abs(F.col("start_pos") - F.col("there")).alias("distance"))
    rank = F.row_number().over(W.partitionBy("at").orderBy("distance", "to"))
    return near.withColumn("n", rank).where(F.col("n") <= most).drop("n")


def expand_articles(seeds: DataFrame, edges: DataFrame, settings: Expansion, structural: DataFrame | None = None) -> DataFrame:
    """(query_id, node, score, path, depth, structural): bounded expansion of the seeds (query_id, node).

    Each level takes every node's best edges before looking whether they lead anywhere new,
    keeps the best way to each new node, and stops at the question's budget.  Later levels
    never change an earlier one.  Steps after the first are damped by ``decay``.
    """
    weights = F.create_map(*(F.lit(x) for kind, w in settings.weights.items() for x in (kind, float(w))))
    steps = both_directions(edges.select("source_id", "target_id", "kind", "confidence"))
    steps = steps.withColumn("gain", F.coalesce(weights[F.col("kind")], F.lit(0.0)) * F.col("confidence"))
    order = W.partitionBy("at").orderBy(F.desc("gain"), "to", "kind")
    steps = steps.withColumn("n", F.row_number().over(order)).where(F.col("n") <= settings.per_node_limit)
    steps = steps.select("at", "to", "gain", F.array(F.struct("source_id", "target_id", "kind")).alias("hop"), F.lit(False).alias("structural"))
    if settings.structural and structural is not None:
        empty = F.expr("CAST(array() AS array<struct<source_id:string,target_id:string,kind:string>>)")
        steps = steps.unionByName(structural.select("at", "to", F.lit(settings.weights["STRUCTURAL"]).alias("gain"), empty.alias("hop"), F.lit(True).alias("structural")))
    steps = cut(steps)
    path = F.expr("CAST(array() AS array<struct<source_id:string,target_id:string,kind:string>>)")
    visited = cut(seeds.select("query_id", "node").distinct())
    frontier = visited.select("query_id", "node", F.lit(1.0).alias("score"), path.alias("path"))
    found = frontier.where(F.lit(False)).select("query_id", "node", "score", "path", F.lit(0).alias("depth"), F.lit(False).alias("structural"))
    if settings.mode == "M0":
        return found
    for depth in range(1, settings.depth + 1):
        damping = 1.0 if depth == 1 else settings.decay
        reached = frontier.withColumnRenamed("node", "at").join(steps, "at").select(
            "query_id", F.col("to").alias("node"), (F.col("score") * F.col("gain") * damping).alias("score"), F.concat("path", "hop").alias("path"), "structural"
        )
        fresh = reached.where("score > 0").join(visited, ["query_id", "node"], "left_anti")
        best = fresh.groupBy("query_id", "node").agg(F.max_by(F.struct("score", "path", "structural"), F.struct("score", (~F.col("structural")).alias("s"), F.to_json("path").alias("p"))).alias("x"))
        best = best.select("query_id", "node", "x.score", "x.path", "x.structural")
        used = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("used"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node"))
        best = best.join(used, "query_id", "left").withColumn("n", rank).where(F.col("n") + F.coalesce("used", F.lit(0)) <= settings.candidate_budget)
        level = cut(best.select("query_id", "node", "score", "path", F.lit(depth).alias("depth"), "structural"))
        if not level.limit(1).count():
            break
        found = cut(found.unionByName(level))
        visited = cut(visited.unionByName(level.select("query_id", "node")))
        frontier = level.select("query_id", "node", "score", "path")
    return found


def reachable(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(query_id, node, depth): all nodes within ``depth`` undirected steps, with the least number of steps; seeds have 0."""
    steps = both_directions(edges.select("source_id", "target_id")).select("at", "to").distinct()
    visited = cut(seeds.select("query_id", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for level in range(1, depth + 1):
        reached = frontier.withColumnRenamed("node", "at").join(steps, "at").select("query_id", F.col("to").alias("node")).distinct()
        frontier = cut(reached.join(visited, ["query_id", "node"], "left_anti").withColumn("depth", F.lit(level)))
        visited = cut(visited.unionByName(frontier))
    return visited


def shuffled_edges(edges: DataFrame, seed: int) -> DataFrame:
    """Control graph: the same sources and targets (so the same degrees), newly paired at random; self-loops and repeated edges stay.

    The targets are ordered by a seeded hash of their whole edge and its place, so those of one source, and equal edges, are spread.
    """
    placed = cut(edges.select("target_id", "source_id", "kind").withColumn("__at", F.monotonically_increasing_id()))
    left = _numbered(edges.drop("target_id"), F.xxhash64("source_id", "kind", F.lit(seed)), "source_id", "kind")
    right = _numbered(placed, F.xxhash64("source_id", "kind", "target_id", "__at", F.lit(seed + 1)), "target_id", "__at")
    return left.join(right.select("target_id", "__n"), "__n").drop("__n")


def _numbered(df: DataFrame, *order) -> DataFrame:
    """Rows numbered in order without one global task: ranges are numbered apart and shifted by the counts before them."""
    parts = df.sparkSession.sparkContext.defaultParallelism
    ranged = cut(df.withColumn("__o", order[0]).repartitionByRange(parts, "__o", *order[1:]).withColumn("__p", F.spark_partition_id()))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__p", (F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) - F.col("__c")).alias("__b"))
    local = ranged.withColumn("__l", F.row_number().over(W.partitionBy("__p").orderBy("__o", *order[1:])))
    return local.join(F.broadcast(before), "__p").withColumn("__n", F.col("__l") + F.col("__b")).drop("__o", "__p", "__l", "__b")


def concept_candidates(concepts: DataFrame, most: int) -> DataFrame:
    """(source_id, target_id, overlap): articles that share concepts (article_id, concept_key), ``most`` a source and concept."""
    left = concepts.select(F.col("article_id").alias("source_id"), "concept_key").distinct()
    # Targets are taken in the order of their ids: beyond one more than wanted none of a concept is ever taken.
    first = F.row_number().over(W.partitionBy("concept_key").orderBy("target_id"))
    right = concepts.select(F.col("article_id").alias("target_id"), "concept_key").distinct().withColumn("n", first).where(F.col("n") <= most + 1).drop("n")
    met = left.join(right, "concept_key").where("source_id <> target_id")
    capped = met.withColumn("n", F.row_number().over(W.partitionBy("source_id", "concept_key").orderBy("target_id"))).where(F.col("n") <= most)
    return capped.groupBy("source_id", "target_id").agg(F.countDistinct("concept_key").alias("overlap"))


def graph_stats(**tables: DataFrame) -> DataFrame:
    """(label, n): the number of rows of each table."""
    out = None
    for label, df in sorted(tables.items()):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = row if out is None else out.unionByName(row)
    return out
