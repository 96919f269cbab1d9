"""Retrieval pipelines for many questions at once: merged scores, budgeted selection, article ranks, answers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as X
from dossier.plans.settings import Expansion


def budget_select(hits: DataFrame, order: list[Column], k: int, most_chars: int, per_document: int | None = None, group: str = "query_id") -> DataFrame:
    """Rows taken greedily in ``order``: a row that would exceed the characters or its document's cap is skipped and uses nothing.

    ``hits`` has (group, id, document_id, chars).  A group's rows stream through one task in
    their order; only what is taken so far is kept, so a group may have any number of rows.
    """
    rows = hits.where(F.col(group).isNotNull() & (F.col("chars") <= most_chars))
    ordered = rows.repartition(group).sortWithinPartitions(group, *order, "id")
    at = {name: ordered.columns.index(name) for name in (group, "document_id", "chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, documents = None, 0, Counter()
        for batch in batches:
            taken, places = [], []
            columns = (batch.column(at[name]).to_pylist() for name in (group, "document_id", "chars"))
            for n, (asked, document, chars) in enumerate(zip(*columns)):
                if asked != now:
                    now, used, documents = asked, 0, Counter()
                full = per_document is not None and document is not None and documents[document] >= per_document
                if documents.total() >= k or full or used + int(chars) > most_chars:
                    continue
                used += int(chars)
                documents[document or ""] += 1
                taken.append(n)
                places.append(documents.total())
            kept = batch.take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.int32())], names=[*batch.schema.names, "place"])

    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField("place", T.IntegerType())]))


def distinct_seeds(hits: DataFrame, number: int, key: str = "document_id") -> DataFrame:
    """(query_id, seed, place): the first distinct documents of a ranking."""
    first = hits.groupBy("query_id", F.col(key).alias("seed")).agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "seed"))).where(F.col("place") <= number).drop("rank")


def merged_scores(seed_hits: DataFrame, neighbour_hits: DataFrame, evidence_hits: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(query_id, id, document_id, chars, vector_score, final_score, is_evidence): the best of each chunk; evidence overwrites.

    Seeds score by similarity, neighbours by 3/4 similarity and 1/4 graph score.
    """
    similar = F.greatest(F.lit(0.0), F.col("score"))
    seeds = seed_hits.withColumn("final_score", similar).withColumn("is_evidence", F.lit(False))
    graph = neighbours.select("query_id", "document_id", "graph_score")
    near = neighbour_hits.join(graph, ["query_id", "document_id"]).withColumn("final_score", 0.75 * similar + 0.25 * F.col("graph_score")).withColumn("is_evidence", F.lit(False))
    proof = evidence_hits.withColumn("final_score", similar).withColumn("is_evidence", F.lit(True))
    columns = ["query_id", "id", "document_id", "chars", F.col("score").alias("vector_score"), "final_score", "is_evidence"]
    union = seeds.select(*columns).unionByName(near.select(*columns)).unionByName(proof.select(*columns))
    row = F.struct("document_id", "chars", "vector_score", "final_score", "is_evidence")
    best = union.groupBy("query_id", "id").agg(F.max_by(row, F.struct("is_evidence", "final_score")).alias("x"))
    return best.select("query_id", "id", "x.*")


def retrieve(seed_hits: DataFrame, neighbour_hits: DataFrame, evidence_hits: DataFrame, neighbours: DataFrame, k: int, most_chars: int, per_document: int) -> DataFrame:
    """Document retrieval: merged scores, evidence first, under the budgets."""
    merged = merged_scores(seed_hits, neighbour_hits, evidence_hits, neighbours)
    return budget_select(merged, [F.desc("is_evidence"), F.desc("final_score")], k, most_chars, per_document)


def kept_labels(neighbours: DataFrame, selected_evidence: DataFrame) -> DataFrame:
    """Neighbour labels: lower-case ones stay; upper-case kinds only with selected evidence (query_id, document_id, kind)."""
    proof = selected_evidence.groupBy("query_id", "document_id").agg(F.collect_set("kind").alias("__kinds"))
    joined = neighbours.join(proof, ["query_id", "document_id"], "left")
    keep = F.filter("relations", lambda r: (r == F.lower(r)) | F.coalesce(F.array_contains(F.col("__kinds"), r), F.lit(False)))
    return joined.withColumn("relations", keep).drop("__kinds")


def capped_candidates(seeds: DataFrame, graph: DataFrame, rest: DataFrame, budget: int) -> DataFrame:
    """(query_id, article_id, origin): seeds in order, then graph candidates by score, then the rest, each article once, within ``budget``."""
    part = lambda df, origin, order: df.select("query_id", "article_id", F.lit(origin).alias("origin"), order.alias("o"))
    union = part(seeds, 0, F.col("place").cast("double")).unionByName(part(graph, 1, -F.col("score"))).unionByName(part(rest, 2, F.col("place").cast("double")))
    once = union.groupBy("query_id", "article_id").agg(F.min(F.struct("origin", "o")).alias("x"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("x.origin", "x.o", "article_id"))
    return once.withColumn("n", rank).where(F.col("n") <= budget).select("query_id", "article_id", "x.origin")


def article_scores(candidates: DataFrame, settings: Expansion) -> DataFrame:
    """Final score of candidates (rank, cosine, overlap, graph_score; null where not ranked or not reached by the graph)."""
    hybrid = F.coalesce(F.lit(1.0) / (60 + F.col("rank")), F.lit(0.0))
    shared = 0.7 * F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))) + 0.15 * F.coalesce("overlap", F.lit(0.0))
    bonus = settings.graph_weight * F.coalesce("graph_score", F.lit(0.0))
    if settings.scoring == "legacy":
        score = F.when(F.col("graph_score").isNotNull(), F.greatest(61 * hybrid, shared) + bonus).otherwise(61 * hybrid)
    else:
        score = shared + bonus if settings.scoring == "shared_path" else shared
    return candidates.withColumn("score", score)


def retrieve_articles(candidates: DataFrame, settings: Expansion, k: int, most_chars: int) -> DataFrame:
    """Ranked articles under the character budget; candidates as for ``article_scores``, with article_id and chars."""
    scored = article_scores(candidates, settings).withColumn("id", F.col("article_id")).withColumn("document_id", F.col("article_id"))
    return budget_select(scored, [F.desc("score")], k, settings.context_chars or most_chars).drop("id", "document_id")


def first_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, article_id, rank): each article by its first chunk in a ranking."""
    return hits.where("article_id <> ''").groupBy("query_id", "article_id").agg(F.min("rank").alias("rank"))


def sources(selected: DataFrame) -> DataFrame:
    """Answer sources S1, S2, ... in the order of selection, scores rounded to six places."""
    return selected.withColumn("label", F.concat(F.lit("S"), F.col("place"))).withColumn("final_score", F.round("final_score", 6))


def context(labelled: DataFrame) -> DataFrame:
    """(query_id, context, labels): the prompt context of each question; its rows are bounded by the budget."""
    block = F.concat_ws("\n", F.concat(F.lit("["), "label", F.lit("] "), F.col("title")), F.col("text"))
    rows = labelled.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", block.alias("b"), "label"))).alias("rows"))
    return rows.select("query_id", F.array_join(F.col("rows.b"), "\n\n").alias("context"), F.col("rows.label").alias("labels"))


def checked_answers(answers: DataFrame) -> DataFrame:
    """Answers (query_id, answer, labels) with cited and unknown labels and a warning where needed."""
    cited = answers.withColumn("c", X.citations("answer", "labels"))
    warning = F.when(F.size("c.invalid") > 0, "unknown sources").when(F.size("c.valid") == 0, "no source cited").otherwise("")
    return cited.select(*answers.columns, F.col("c.valid").alias("cited"), F.col("c.invalid").alias("unknown"), warning.alias("warning"))
