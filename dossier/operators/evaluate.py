"""Ranking metrics, mode summaries, ablations, coverage subsets and paired bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("hit", "precision", "recall", "mrr", "ndcg", "f1")


def score_rankings(rankings: DataFrame, gold: DataFrame, k: int, keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Metrics at ``k`` of ranked items (keys, item, rank) against gold (qid, item); repeated items count once, at their best rank.

    A question without gold is an error.
    """
    answers = gold.select("qid", "item").distinct()
    size = answers.groupBy("qid").agg(F.count(F.lit(1)).alias("gold"))
    once = rankings.groupBy(*keys, "item").agg(F.min("rank").alias("first"))
    placed = once.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("first", "item"))).where(F.col("place") <= k)
    hits = placed.join(answers.withColumn("right", F.lit(1)), ["qid", "item"], "left").groupBy(*keys).agg(
        F.count("right").alias("hits"), F.min(F.when(F.col("right") == 1, F.col("place"))).alias("best"),
        F.coalesce(F.sum(F.when(F.col("right") == 1, 1 / F.log2(F.col("place") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    every = rankings.select(*keys).distinct()
    joined = every.join(hits, list(keys), "left").join(size, "qid", "left")
    joined = joined.withColumn("gold", F.when(F.col("gold") > 0, F.col("gold")).otherwise(F.raise_error(F.concat(F.lit("no gold for "), F.col("qid").cast("string")))))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("gold")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    precision, recall = F.coalesce(F.col("hits"), F.lit(0)) / k, F.coalesce(F.col("hits"), F.lit(0)) / F.col("gold")
    return joined.select(
        *keys, F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"), precision.alias("precision"), recall.alias("recall"),
        F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
    )


def mode_summary(scores: DataFrame, mode: str = "mode", latency: str = "latency_ms") -> DataFrame:
    """Means of the metrics, median and nearest-rank 95th percentile of the latency, by mode."""
    return scores.groupBy(mode).agg(
        F.count(F.lit(1)).alias("questions"), *(F.avg(m).alias(m) for m in METRICS if m in scores.columns),
        F.expr(f"percentile({latency}, 0.5)").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})").alias("p95"),
    )


def against_baseline(items: DataFrame, gold: DataFrame, baseline: str, mode: str = "mode") -> DataFrame:
    """(qid, mode, recovered, lost, added): gold items gained and lost, and items new, against the baseline mode of the question."""
    sets = items.groupBy("qid", mode).agg(F.collect_set("item").alias("items"))
    base = sets.where(F.col(mode) == baseline).select("qid", F.col("items").alias("base"))
    right = gold.groupBy("qid").agg(F.collect_set("item").alias("gold"))
    both = sets.join(base, "qid").join(right, "qid")
    gained, gone = F.array_except("items", "base"), F.array_except("base", "items")
    return both.select(
        "qid", mode, F.size(F.array_intersect(gained, F.col("gold"))).alias("recovered"), F.size(F.array_intersect(gone, F.col("gold"))).alias("lost"), F.size(gained).alias("added")
    )


def subset_means(scores: DataFrame, subsets: dict[str, Column], mode: str = "mode") -> DataFrame:
    """(mode, subset, questions, metrics): means over the questions of each subset; null where it is empty."""
    out = None
    for name, inside in subsets.items():
        row = scores.groupBy(mode).agg(F.count_if(inside).alias("questions"), *(F.avg(F.when(inside, F.col(m))).alias(m) for m in METRICS if m in scores.columns))
        row = row.withColumn("subset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def law_recall(ranked: DataFrame, gold: DataFrame, laws: DataFrame, total: bool = True) -> DataFrame:
    """(mode, qid, law_hit, laws_missing, recall) of rankings (mode, qid, item) on the level of laws (item, law_id).

    With ``total``, a gold item without a law is an error; an item of a ranking without one counts for no law.
    """
    wanted = gold.select("qid", "item").distinct().join(laws.select("item", "law_id").distinct(), "item", "left")
    if total:
        wanted = wanted.withColumn("law_id", F.coalesce("law_id", F.raise_error(F.concat(F.lit("no law for "), F.col("item").cast("string")))))
    wanted = wanted.select("qid", "law_id").distinct()
    found = ranked.join(laws.select("item", "law_id").distinct(), "item").select("mode", "qid", "law_id", F.lit(1).alias("met")).distinct()
    each = ranked.select("mode", "qid").distinct().join(wanted, "qid").join(found, ["mode", "qid", "law_id"], "left")
    out = each.groupBy("mode", "qid").agg(F.count("met").alias("hits"), F.count(F.lit(1)).alias("laws"))
    return out.select("mode", "qid", (F.col("hits") > 0).alias("law_hit"), (F.col("laws") - F.col("hits")).alias("laws_missing"), (F.col("hits") / F.col("laws")).alias("recall"))


def miss_stages(gold: DataFrame, indexed: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(qid, item, stage) of every gold item: how far it came, ``not_indexed``, ``not_candidate``, ``not_selected`` or ``found``."""
    known = lambda df, *on: df.select(*on).distinct().withColumn("__" + "_".join(on), F.lit(True))
    rows = gold.select("qid", "item").distinct().join(known(indexed, "item"), "item", "left")
    rows = rows.join(known(candidates, "qid", "item").withColumnRenamed("__qid_item", "__c"), ["qid", "item"], "left")
    rows = rows.join(known(selected, "qid", "item").withColumnRenamed("__qid_item", "__s"), ["qid", "item"], "left")
    stage = F.when(F.col("__s"), "found").when(F.col("__c"), "not_selected").when(F.col("__item"), "not_candidate").otherwise("not_indexed")
    return rows.select("qid", "item", stage.alias("stage"))


def covered_questions(gold: DataFrame, available: DataFrame) -> DataFrame:
    """(qid, covered): whether all of a question's gold items are available (item)."""
    held = gold.select("qid", "item").distinct().join(available.select("item", F.lit(1).alias("__held")).distinct(), "item", "left")
    return held.groupBy("qid").agg((F.count("__held") == F.count(F.lit(1))).alias("covered"))


def failure_summary(rows: DataFrame, mode: str = "mode", group: str = "grp") -> DataFrame:
    """Zero-hit and incomplete questions and mean recall, by mode over all and by mode and group."""
    return rows.groupingSets([[mode], [mode, group]], mode, group).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(F.col("recall") == 0).alias("zero_hit"), F.count_if(F.col("recall") < 1).alias("incomplete"), F.avg("recall").alias("recall")
    )


def most_common(df: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` values by count; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(top)


def unambiguous(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct pairs whose left value has one right value and whose right value has one left value."""
    once = pairs.select(left, right).distinct()
    lefts = once.groupBy(left).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(left)
    rights = once.groupBy(right).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(right)
    return once.join(lefts, left, "left_semi").join(rights, right, "left_semi")


def mapped_passages(passages: DataFrame, articles: DataFrame, law: str = "law_id", least: int = 30) -> DataFrame:
    """(item_id, outcome, article_id): the one article of the same law that holds each passage (item_id, law, body); outcome mapped, ambiguous, no_exact_article_match or multiple_original_ids."""
    held = passages.where(F.length("body") >= least).join(articles.withColumnRenamed("body", "whole"), law).where(F.contains(F.col("whole"), F.col("body")))
    per = held.groupBy("item_id").agg(F.countDistinct("article_id").alias("n"), F.min("article_id").alias("article_id"))
    shared = per.where("n = 1").groupBy("article_id").agg(F.count(F.lit(1)).alias("items"))
    joined = passages.select("item_id").distinct().join(per, "item_id", "left").join(shared, "article_id", "left")
    outcome = F.when(F.col("n").isNull(), "no_exact_article_match").when(F.col("n") > 1, "ambiguous").when(F.col("items") > 1, "multiple_original_ids").otherwise("mapped")
    return joined.select("item_id", outcome.alias("outcome"), F.when(outcome == "mapped", F.col("article_id")).alias("article_id"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired_bootstrap(differences: DataFrame, column: str = "difference", draws: int = 2_000, seed: int = 20261113) -> DataFrame:
    """(mean, lower, upper): 95 % interval of the mean difference.

    Each row's part in a draw is a Poisson(1) number from a seeded hash of the row and its place, so
    equal rows are drawn apart and the rows are never gathered: a draw is a weighted mean, and each
    batch of rows gives one sum a draw.
    """
    place = F.xxhash64(F.struct(*differences.columns), F.monotonically_increasing_id())
    rows = differences.where(F.col(column).isNotNull()).select(place.alias("h"), F.col(column).cast("double").alias("d"))
    seeds = _mix(np.arange(1, draws + 1, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))
    terms = np.cumprod([0.36787944117144233, *(1 / k for k in range(1, 9))])
    steps = (np.cumsum(terms) * 2.0**32).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighed, weights, seen = np.zeros(draws), np.zeros(draws, np.int64), False
        for batch in batches:
            for start in range(0, batch.num_rows, 4_000):
                part, seen = batch.slice(start, 4_000), True
                hashes, values = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
                for k in range(0, draws, 50):
                    unit = (_mix(hashes[None, :] ^ seeds[k : k + 50, None]) >> np.uint64(32)).astype(np.uint32)
                    w = np.zeros(unit.shape, np.uint8)
                    for step in steps:
                        w += unit >= step
                    weighed[k : k + 50] += w @ values
                    weights[k : k + 50] += w.sum(axis=1, dtype=np.int64)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(weighed), pa.array(weights)], names=["draw", "wd", "w"])

    sums = rows.mapInArrow(run, "draw bigint, wd double, w bigint")
    means = sums.groupBy("draw").agg((F.sum("wd") / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    bounds = means.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY m)").alias("lower"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY m)").alias("upper"))
    return rows.agg(F.avg("d").alias("mean")).crossJoin(bounds)
