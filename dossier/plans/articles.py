"""Article retrieval and article relations as whole pipelines, for all questions or sources at once.

Retrieval: hybrid pool, seed articles, bounded expansion, confirmation of every path by the
quotes of its relations, one candidate budget, cosine of all candidates, score, character
budget.  Relations: candidates by four signals, interleaved within a global limit, proposed by
a model, validated by quotes and scope, reviewed by a second call.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import candidates, chunking, evaluate, graph, retrieve, search, tfidf, validate
from dossier.plans.pipelines import Chat, cached_responses
from dossier.plans.settings import Expansion
from dossier.plans.shared import cut, join_checked


class Corpus(NamedTuple):
    """``points`` (id, document_id, text, embedding), ``mapping`` (chunk_id, article_id) and relations ``edges`` with their quotes and chunks."""

    points: DataFrame
    mapping: DataFrame
    edges: DataFrame
    structural: DataFrame | None = None


class Retrieved(NamedTuple):
    """``selected`` (query_id, article_id, id, score, place, ...), all scored ``candidates``, and the ``grounds`` of selected articles."""

    selected: DataFrame
    candidates: DataFrame
    seeds: DataFrame
    grounds: DataFrame


def hybrid_pool(corpus: Corpus, questions: DataFrame, size: int) -> DataFrame:
    """(query_id, id, rank): the frozen ranking that configurations share."""
    return cut(search.hybrid(corpus.points, questions, size, size).select("query_id", "id", "rank"))


def _ungrounded(corpus: Corpus) -> DataFrame:
    """(source_id, target_id, kind) of the relations whose quotes are not in their chunks."""
    hops = corpus.edges.select("source_id", "target_id", "kind", "source_chunk_id", "target_chunk_id", "evidence", "target_evidence")
    good = F.lit(True)
    for end, quote in (("source", "evidence"), ("target", "target_evidence")):
        side = corpus.points.select(F.col("id").alias(f"{end}_chunk_id"), F.col("text").alias(f"__{end}"))
        hops = hops.join(side, f"{end}_chunk_id", "left")
        good = good & F.coalesce(F.contains(F.col(f"__{end}"), F.col(quote)), F.lit(False))
    return hops.groupBy("source_id", "target_id", "kind").agg(F.max(good).alias("good")).where("NOT good").drop("good")


def retrieve_articles(corpus: Corpus, questions: DataFrame, config: Expansion, k: int, pool: DataFrame | None = None, moment: str = "") -> Retrieved:
    """Articles for questions (query_id, text, embedding); null and blank questions have no rows.

    An article is known by the chunk of its best rank, or, where a confirmed path leads to it, by its chunk that is
    nearest to the question.  A path whose relation isn't quoted in its chunks leads nowhere.
    """
    if not 0 < k <= config.candidate_budget:
        raise ValueError("k must be positive and at most the candidate budget")
    questions = cut(questions.where("query_id IS NOT NULL AND trim(text) <> ''"))
    pool = hybrid_pool(corpus, questions, config.hybrid_pool or config.candidate_budget) if pool is None else pool
    owned = corpus.mapping.withColumnRenamed("chunk_id", "id")
    ranked = pool.join(owned, "id")
    first = cut(ranked.groupBy("query_id", "article_id").agg(F.min(F.struct("rank", "id")).alias("x")).select("query_id", "article_id", "x.rank", "x.id"))
    seeds = cut(retrieve.distinct_seeds(first, config.seed_limit, "article_id").withColumnRenamed("seed", "article_id"))
    starts = seeds.select("query_id", F.col("article_id").alias("node"))
    found = graph.expand_articles(starts, graph.usable_edges(corpus.edges, config, moment=moment), config, corpus.structural)
    # Seeds have their places; discoveries share what is left of the one budget.
    taken = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("taken"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("depth", F.desc("score"), "node"))
    found = found.withColumn("place", place).join(taken, "query_id").where(F.col("place") <= config.candidate_budget - F.col("taken"))
    bad = _ungrounded(corpus).select(F.struct("source_id", "target_id", "kind").alias("hop"), F.lit(1).alias("bad"))
    lost = found.select("query_id", "node", F.explode("path").alias("hop")).join(bad, "hop").select("query_id", "node").distinct()
    found = cut(found.join(lost, ["query_id", "node"], "left_anti"))
    chunks = found.select("query_id", F.col("node").alias("article_id"), "place").join(owned, "article_id")
    near = F.row_number().over(W.partitionBy("query_id").orderBy("place", "id"))
    wanted = chunks.withColumn("n", near).where(F.col("n") <= 2 * config.candidate_budget)
    best = search.confirm(corpus.points, wanted, questions).join(wanted.select("query_id", "id", "article_id"), ["query_id", "id"])
    best = cut(best.groupBy("query_id", "article_id").agg(F.max_by("id", F.struct("score", "id")).alias("id")))
    reached = best.join(found.select("query_id", F.col("node").alias("article_id"), "score", "path"), ["query_id", "article_id"])
    kept = retrieve.capped_candidates(seeds, reached.select("query_id", "article_id", "score"), first.select("query_id", "article_id", F.col("rank").alias("place")), config.candidate_budget)
    rows = kept.select("query_id", "article_id").join(first.select("query_id", "article_id", F.col("id").alias("__own")), ["query_id", "article_id"], "left")
    ranks = first.select("query_id", "article_id", "rank")
    rows = rows.join(reached.select("query_id", "article_id", F.col("id").alias("__reached"), F.col("score").alias("graph_score")), ["query_id", "article_id"], "left")
    rows = rows.join(ranks, ["query_id", "article_id"], "left").withColumn("id", F.coalesce("__reached", "__own")).drop("__reached", "__own")
    rows = cut(rows)
    cosine = search.confirm(corpus.points, rows, questions).withColumnRenamed("score", "cosine")
    rows = rows.join(cosine, ["query_id", "id"]).where(~F.isnan("cosine")).join(corpus.points.select("id", "document_id", "text", F.length("text").alias("chars")), "id")
    rows = rows.join(questions.select("query_id", F.col("text").alias("question")), "query_id").withColumn("overlap", X.token_overlap(F.col("question"), "text"))
    scored = cut(retrieve.article_scores(rows.drop("question"), config))
    limit = config.context_chars or (1 << 31) - 1
    named = scored.withColumnsRenamed({"id": "chunk_id", "document_id": "law_id"}).withColumn("id", F.col("article_id")).withColumn("document_id", F.col("article_id"))
    selected = cut(retrieve.budget_select(named, [F.desc("score")], k, limit).drop("id", "document_id"))
    hops = reached.select("query_id", "article_id", F.explode("path").alias("hop")).select("query_id", "article_id", "hop.*")
    grounds = hops.join(selected.select("query_id", "article_id"), ["query_id", "article_id"], "left_semi").join(corpus.edges, ["source_id", "target_id", "kind"])
    shown = selected.select("query_id", F.col("chunk_id").alias("source_chunk_id"), "place")
    return Retrieved(selected, scored, seeds, grounds.join(shown, ["query_id", "source_chunk_id"]).select("query_id", "place", "source_id", "target_id", "kind", "source_chunk_id", "evidence").distinct())


#: The seven configurations of an experiment over two frozen pools, by name; ``shuffled`` takes the control graph.
CONFIGURATIONS: dict[str, dict] = {
    "hybrid": {"mode": "M0"}, "hybrid_larger": {"mode": "M0", "candidate_budget": 120}, "hybrid_shared": {"mode": "M0", "scoring": "shared"},
    "graph_shared": {"mode": "M2", "scoring": "shared"}, "graph_shared_path": {"mode": "M2", "scoring": "shared_path"}, "graph_legacy": {"mode": "M2"},
    "shuffled_shared": {"mode": "M2", "scoring": "shared"},
}
EXPERIMENT_CHARS, BASELINE = 18_000, "hybrid"


def configurations(corpus: Corpus, questions: DataFrame, gold: DataFrame, available: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(mode, qid, metrics, candidate_recall, complete, covered, recovered, lost, added, reached_1, reached_2) of all configurations.

    ``gold`` has (qid, item), ``available`` the items that can be found (item).
    """
    control = corpus._replace(edges=cut(graph.shuffled_edges(corpus.edges, seed)))
    pools: dict[int, DataFrame] = {}
    rankings, pooled, reached = [], [], []
    for mode, given in CONFIGURATIONS.items():
        config = Expansion(context_chars=EXPERIMENT_CHARS, **given)
        size = config.candidate_budget
        pools[size] = pools.get(size) or hybrid_pool(corpus, questions, size)
        over = control if mode.startswith("shuffled") else corpus
        got = retrieve_articles(over, questions, config, k, pools[size])
        name = F.lit(mode).alias("mode")
        rankings.append(got.selected.select(F.col("query_id").alias("qid"), F.col("article_id").alias("item"), F.col("place").alias("rank"), name))
        pooled.append(got.candidates.select(F.col("query_id").alias("qid"), F.col("article_id").alias("item"), name))
        near = graph.reachable(got.seeds.select("query_id", F.col("article_id").alias("node")), over.edges, 2)
        reached.append(near.select(F.col("query_id").alias("qid"), F.col("node").alias("item"), "depth", name))
    union = lambda parts: cut(reduce(DataFrame.unionByName, parts))
    ranked, wanted = union(rankings), cut(gold.select("qid", "item").distinct())
    scores = evaluate.score_rankings(ranked, wanted, k, ("qid", "mode"))
    number = wanted.groupBy("qid").agg(F.count(F.lit(1)).alias("gold"))
    part = lambda df, name, column: df.where(column).join(wanted, ["qid", "item"], "left_semi").groupBy("mode", "qid").agg(F.countDistinct("item").alias(name))
    near = union(reached)
    out = scores.join(number, "qid").join(evaluate.against_baseline(ranked, wanted, BASELINE), ["qid", "mode"], "left").join(evaluate.covered_questions(wanted, available), "qid")
    for rows, name, column in ((union(pooled), "__pooled", F.lit(True)), (near, "reached_1", F.col("depth") <= 1), (near, "reached_2", F.lit(True))):
        out = out.join(part(rows, name, column), ["mode", "qid"], "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("candidate_recall", F.col("__pooled") / F.col("gold")).withColumn("complete", F.col("recall") == 1).drop("__pooled", "gold")


def answer_prompts(selected: DataFrame, titles: DataFrame, grounds: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, request, labels): sources S1, S2, ... and the evidence lines of relations whose quote stands in a source, each relation once."""
    shown = selected.join(titles.select(F.col("document_id").alias("law_id"), "title", "number"), "law_id", "left")
    block = F.concat(
        F.lit("[S"), F.col("place"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("number", F.lit("?")), F.lit(" | "), F.col("article_id"), F.lit("\n"), F.col("text"),
    )
    sources = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", block.alias("b"), F.concat(F.lit("S"), F.col("place")).alias("label")))).alias("s"))
    quoted = grounds.join(selected.select("query_id", "place", "text"), ["query_id", "place"]).where(F.contains(F.col("text"), F.col("evidence")))
    once = quoted.groupBy("query_id", "source_id", "target_id", "kind").agg(F.min(F.struct("place", "evidence")).alias("e"))
    line = F.concat(F.lit("[S"), F.col("e.place"), F.lit("] "), "source_id", F.lit(" --"), "kind", F.lit("--> "), "target_id", F.lit("; "), F.col("e.evidence"))
    lines = once.groupBy("query_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    rows = questions.select("query_id", "text").join(sources, "query_id").join(lines, "query_id", "left")
    request = F.concat_ws("\n\n", F.trim("text"), F.array_join("s.b", "\n\n"), F.array_join(F.coalesce("lines", F.array()), "\n"))
    return rows.select("query_id", request.alias("request"), F.col("s.label").alias("labels"))


def relation_candidates(chunks: DataFrame, mapping: DataFrame, points: DataFrame, owners: DataFrame, sources: DataFrame, concepts: DataFrame | None = None, number: int = 20, per_article: int = 3, features: int = 50_000) -> DataFrame:
    """Merged candidates (source_id, target_id, scores, chunks, rank_score, explicit) of the ``sources`` (article_id), by reference, vectors, words and concepts."""
    owned = cut(mapping.select("chunk_id", "article_id"))
    mine = cut(owned.join(sources, "article_id", "left_semi"))
    first = owned.groupBy(F.col("article_id").alias("target_id")).agg(F.min("chunk_id").alias("target_chunk"))
    bodies = cut(join_checked(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "body"), mine, "chunk_id", "inner", mine.count(), 128))
    named = chunking.named_articles(bodies.select(F.col("chunk_id").alias("id"), "document_id", F.col("body").alias("text")))
    named = named.join(owners.withColumnRenamed("document_id", "owner"), "number_norm", "left")
    target = F.concat(F.when(F.col("number_norm") == "", F.col("document_id")).otherwise(F.col("owner")), F.lit(":article:"), "article")
    reference = named.withColumn("target_id", target).join(mine.withColumnRenamed("article_id", "source_id"), "chunk_id").join(first, "target_id")
    reference = reference.select("source_id", "target_id", F.lit("reference").alias("signal"), F.lit(1.0).alias("score"), F.col("chunk_id").alias("source_chunk"), "target_chunk")
    place = F.row_number().over(W.partitionBy("article_id").orderBy("chunk_index", "chunk_id"))
    asked = bodies.withColumn("n", place).where(F.col("n") <= per_article).select("chunk_id").join(points.select(F.col("id").alias("chunk_id"), "embedding"), "chunk_id")
    hits = search.dense_topk(points, asked.withColumnRenamed("chunk_id", "query_id"), 2 * number)
    dense = hits.join(mine.select(F.col("chunk_id").alias("query_id"), F.col("article_id").alias("source_id")), "query_id").join(owned.select(F.col("chunk_id").alias("id"), F.col("article_id").alias("target_id")), "id")
    dense = dense.select("source_id", "target_id", F.lit("dense").alias("signal"), "score", "rank", F.col("query_id").alias("source_chunk"), F.col("id").alias("target_chunk"))
    texts = join_checked(chunks.select("id", F.col("body").alias("text")), owned.select(F.col("chunk_id").alias("id"), F.col("article_id").alias("document_id")), "id", "inner", owned.count(), 128)
    vectors = tfidf.fit_vectors(texts.where("trim(text) <> ''"), tfidf.word_tokens("text"), 1, 2, ["id", "document_id"], features=features)
    asked = vectors.join(F.broadcast(sources.select(F.col("article_id").alias("document_id"))), "document_id", "left_semi")
    lexical = tfidf.best_pairs(vectors, number, asked).select(
        F.col("source_document").alias("source_id"), F.col("target_document").alias("target_id"), F.lit("lexical").alias("signal"), "score", "rank",
        F.col("source_id").alias("source_chunk"), F.col("target_id").alias("target_chunk"),
    )
    parts = [reference, dense, lexical]
    if concepts is not None:
        met = graph.concept_candidates(concepts, number).join(sources.withColumnRenamed("article_id", "source_id"), "source_id", "left_semi").join(first, "target_id")
        own = first.withColumnsRenamed({"target_id": "source_id", "target_chunk": "source_chunk"})
        parts.append(met.join(own, "source_id").select("source_id", "target_id", F.lit("concept").alias("signal"), F.lit(1.0).alias("score"), "source_chunk", "target_chunk"))
    merged = candidates.merge_signals(candidates.signals(*parts).where("source_id <> target_id"))
    return merged.withColumn("explicit", F.map_contains_key("scores", F.lit("reference")))


def requests(pairs: DataFrame, chunks: DataFrame, mapping: DataFrame) -> DataFrame:
    """``pairs`` with the ``request`` of each: both articles with up to two of the chunks that made them candidates, else their first.

    An article's bodies are one row, so that a pair meets them by its ends and no body is gathered again for each pair.
    """
    pairs = cut(pairs)
    owned = mapping.select("chunk_id", "article_id")
    body = join_checked(chunks.select(F.col("id").alias("chunk_id"), "chunk_index", "body"), owned, "chunk_id", "inner", owned.count(), 128)
    whole = body.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", "body"))).alias("bodies"), F.min_by("chunk_id", "chunk_index").alias("first"))
    met = F.flatten(F.transform(F.array(*(F.col("chunks")[s] for s in ("reference", "dense", "lexical", "concept"))), lambda c: F.slice(F.coalesce(c, F.array().cast("array<struct<source_chunk:string,target_chunk:string>>")), 1, 2)))
    out = pairs
    for end in ("target", "source"):
        used = pairs.select(F.col(f"{end}_id").alias("article_id")).distinct()
        side = whole.join(used, "article_id", "left_semi").select(F.col("article_id").alias(f"{end}_id"), F.col("bodies").alias(f"__{end}"), F.col("first").alias(f"__{end}_first"))
        out = out.join(side, f"{end}_id")

    def shown(end: str) -> Column:
        ids = F.slice(F.array_distinct(F.transform(met, lambda c: c[f"{end}_chunk"])), 1, 2)
        ids = F.when(F.size(ids) > 0, ids).otherwise(F.array(f"__{end}_first"))
        held = F.filter(ids, lambda c: F.map_contains_key(f"__{end}", c))
        return F.transform(held, lambda c: F.struct(F.col(f"{end}_id").alias("article_id"), c.alias("chunk_id"), F.col(f"__{end}")[c].alias("body")))

    both = F.sort_array(F.array_distinct(F.concat(shown("source"), shown("target"))))
    request = F.to_json(F.struct("source_id", "target_id", both.alias("chunks"))).alias("request")
    return out.select(*pairs.columns, request)


RESPONSE = f"relations array<struct<{', '.join(p.replace(' ', ': ', 1) for p in validate.PROPOSAL.split(', '))}>>, facts array<struct<article_id: string, chunk_id: string, kind: string, name: string, evidence: string>>"


class Built(NamedTuple):
    relations: DataFrame
    facts: DataFrame
    cache: DataFrame
    reviews: DataFrame


def build_article_relations(documents: DataFrame, chunks: DataFrame, mapping: DataFrame, owners: DataFrame, provisions: DataFrame, pairs: DataFrame, chat: Chat, review: Chat, cache: DataFrame | None = None, reviews: DataFrame | None = None, least: float = 0.8) -> Built:
    """Relations and facts of candidate ``pairs`` (source_id, target_id, chunks), and both grown caches.

    Stated citations need no model.  A proposed relation must be valid, within the scope it names, and supported by the
    review; an unreadable or missing response supports nothing.  Only requests that a cache lacks reach a model.
    """
    if not 0 <= least <= 1:
        raise ValueError("least must lie in [0, 1]")
    stated = chunking.article_citations(chunks, mapping, owners).withColumn("bridge", validate.no_bridge())
    stated = validate.article_relations(stated, chunks, mapping, documents, owners, least)
    said, grown = cached_responses(requests(pairs.select("source_id", "target_id", "chunks"), chunks, mapping).select("source_id", "target_id", "request"), cache, chat)
    read = cut(said.select(F.col("source_id").alias("__source"), F.col("target_id").alias("__target"), F.from_json(X.model_json("raw"), RESPONSE).alias("r")))
    proposed = read.select("__source", "__target", F.explode("r.relations").alias("p")).select("__source", "__target", "p.*")
    ends = F.array_sort(F.array("source_id", "target_id")) == F.array_sort(F.array("__source", "__target"))
    valid = validate.article_relations(proposed.where(ends).drop("__source", "__target"), chunks, mapping, documents, owners, least)
    valid = cut(validate.scope_matches(valid, provisions))
    audit = valid.withColumn("request", F.to_json(F.struct("kind", "evidence", "target_evidence", "source_id", "target_id")))
    judged, judgements = cached_responses(audit, reviews, review)
    supported = F.try_variant_get(F.try_parse_json(X.model_json("raw")), "$.supported", "boolean")
    kept = judged.where(F.coalesce(supported, F.lit(False))).select(*valid.columns)
    facts = validate.facts(read.select(F.col("r.facts").alias("facts")), chunks, mapping)
    every = stated.withColumn("method", F.lit("stated")).unionByName(kept.withColumn("method", F.lit("model")))
    # A stated citation is kept before a proposed one of the same key.
    key = ["source_id", "target_id", "kind", "source_chunk_id", "target_chunk_id"]
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.col("method") == "stated"), "evidence"))
    return Built(every.withColumn("__n", rank).where("__n = 1").drop("__n"), facts.dropDuplicates(["id"]), grown, judgements)

