"""Candidate relations between documents or articles: signals, fusion, shortlists and sampling.

Signals are one long table (source_id, target_id, signal, score, rank, source_chunk, target_chunk).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.plans.shared import cut

COLUMNS = ("source_id", "target_id", "signal", "score", "rank", "source_chunk", "target_chunk")


def signals(*parts: DataFrame) -> DataFrame:
    """Union of signal tables; missing columns become null."""
    def whole(df: DataFrame) -> DataFrame:
        kinds = {"score": "double", "rank": "int"}
        return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))
    return reduce(DataFrame.unionByName, map(whole, parts))


def merge_signals(long: DataFrame) -> DataFrame:
    """(source_id, target_id, scores, ranks, chunks, rank_score): best score and rank of each signal, distinct chunk pairs."""
    each = long.groupBy("source_id", "target_id", "signal").agg(
        F.max("score").alias("score"), F.min("rank").alias("rank"),
        F.sort_array(F.collect_set(F.when(F.col("source_chunk").isNotNull(), F.struct("source_chunk", "target_chunk")))).alias("chunks"),
    )
    out = each.groupBy("source_id", "target_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "score")))).alias("scores"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("signal", "rank"))))).alias("ranks"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("signal", "chunks")))).alias("chunks"),
        F.coalesce(F.sum(F.lit(1.0) / (60 + F.col("rank"))), F.lit(0.0)).alias("rank_score"),
    )
    return out


def shortlist(merged: DataFrame, number: int, explicit: str = "reference", entity: str = "entity") -> DataFrame:
    """All explicit candidates, and the ``number`` best others of each source by fused rank, shared entities, target."""
    named = merged.withColumn("explicit", F.map_contains_key("scores", F.lit(explicit)))
    shared = F.coalesce(F.col("scores")[entity], F.lit(0.0))
    rank = F.row_number().over(W.partitionBy("source_id", "explicit").orderBy(F.desc("rank_score"), F.desc(shared), "target_id"))
    return named.withColumn("place", rank).where(F.col("explicit") | (F.col("place") <= number))


def _turns(merged: DataFrame, explicit: str, order: str) -> DataFrame:
    """(source_id, target_id, explicit, order, turn): each row's place among the explicit or the other ones, without a task that holds all."""
    rows = cut(merged.select("source_id", "target_id", explicit, order).orderBy(explicit, F.desc(order), "source_id", "target_id"))
    placed = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    counts = sorted(placed.groupBy("__part", explicit).agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n")).collect())  # two rows for each partition
    before: dict = {}
    shifts = []
    for part, side, first, n in counts:
        shifts.append((part, side, before.get(side, 0) - first + 1))
        before[side] = before.get(side, 0) + n
    shift = F.lit(0).cast("bigint")
    if shifts:
        known = F.create_map(*(F.lit(x) for part, side, n in shifts for x in (f"{part} {str(side).lower()}", n)))
        shift = known[F.concat_ws(" ", "__part", explicit)]
    return placed.withColumn("turn", F.col("__at") + shift).drop("__part", "__at")


def interleave(merged: DataFrame, limit: int | None, explicit: str = "explicit", order: str = "rank_score") -> DataFrame:
    """Explicit and other pairs in turn, each undirected pair once, at most ``limit``; all of them, in no order, if it is None.

    A pair has at most two rows on each side, so the first ``2 * limit`` of each side are enough; they are found partition by partition.
    """
    pair = F.sort_array(F.array("source_id", "target_id"))
    first = F.row_number().over(W.partitionBy("pair").orderBy("turn", F.desc(explicit), "source_id"))
    if limit is None:
        once = _turns(merged, explicit, order).withColumn("pair", pair).withColumn("n", first).where("n = 1")
        return merged.join(once.select("source_id", "target_id", "turn"), ["source_id", "target_id"])
    rows = [F.desc(order), "source_id", "target_id"]
    merged = merged.where(explicit).orderBy(*rows).limit(2 * limit).unionByName(merged.where(~F.col(explicit)).orderBy(*rows).limit(2 * limit))
    turn = F.row_number().over(W.partitionBy(explicit).orderBy(F.desc(order), "source_id", "target_id"))
    ordered = merged.withColumn("turn", turn)
    once = ordered.withColumn("pair", pair).withColumn("n", first).where("n = 1").drop("n", "pair")
    return once.orderBy("turn", F.desc(explicit)).limit(limit)


def representatives(chunked: DataFrame, number: int) -> DataFrame:
    """``number`` chunks of each document spread evenly over its articles, or over all chunks where it has none."""
    article = F.col("section").startswith("Điều")
    by = W.partitionBy("document_id")
    kept = chunked.withColumn("__any", F.max(article).over(by)).where(article | ~F.col("__any"))
    placed = kept.withColumn("__i", F.row_number().over(by.orderBy("chunk_index", "id")) - 1).withColumn("__m", F.count(F.lit(1)).over(by))
    last = F.least(F.lit(number), F.col("__m")) - 1
    wanted = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.floor(k * (F.col("__m") - 1) / max(1, number - 1)))
    return placed.where(F.array_contains(wanted, F.col("__i").cast("bigint"))).drop("__any", "__i", "__m")


def hash_sample(articles: DataFrame, number: int, key: str = "id") -> DataFrame:
    """The ``number`` rows with the least SHA-256 of their key: the same rows on every run."""
    return articles.orderBy(F.sha2(F.col(key), 256), key).limit(number)


def reference_candidates(mentions: DataFrame, owners: DataFrame) -> DataFrame:
    """Signal ``reference``: a document mentions an identifier that one other document owns."""
    hits = mentions.withColumnRenamed("document_id", "source_id").join(owners.withColumnRenamed("document_id", "target_id"), "number_norm")
    return hits.where("source_id <> target_id").select("source_id", "target_id", F.lit("reference").alias("signal"), F.lit(1.0).alias("score")).distinct()


def entity_candidates(entities: DataFrame, per_entity: int, number: int) -> DataFrame:
    """Signal ``entity``: documents that share entities, ``per_entity`` targets each, counted after that cap, ``number`` a source."""
    left = entities.select(F.col("document_id").alias("source_id"), "etype", "entity_key").distinct()
    # Targets are taken in the order of their ids: beyond one more than the cap none of an entity is ever taken.
    first = F.row_number().over(W.partitionBy("etype", "entity_key").orderBy("target_id"))
    right = entities.select(F.col("document_id").alias("target_id"), "etype", "entity_key").distinct().withColumn("n", first).where(F.col("n") <= per_entity + 1).drop("n")
    met = left.join(right, ["etype", "entity_key"]).where("source_id <> target_id")
    capped = met.withColumn("n", F.row_number().over(W.partitionBy("source_id", "etype", "entity_key").orderBy("target_id"))).where(F.col("n") <= per_entity)
    overlap = capped.groupBy("source_id", "target_id").agg(F.countDistinct("etype", "entity_key").cast("double").alias("score"))
    rank = F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    return overlap.withColumn("n", rank).where(F.col("n") <= number).select("source_id", "target_id", F.lit("entity").alias("signal"), "score")
