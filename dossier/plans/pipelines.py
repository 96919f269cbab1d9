"""Whole pipelines with injected models: answers, relation building with a response cache, mode ablation, health."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import evaluate, graph, retrieve, validate
from dossier.plans.settings import MODES, Expansion
from dossier.plans.shared import cut
from dossier.sources import sinks

Chat = Callable[[list[str]], list[str]]


def ask(requests: DataFrame, chat: Chat) -> DataFrame:
    """(key, request, raw): the model's response to each request, one call for each Arrow batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = chat(frame["request"].tolist())
            if len(said) != len(frame):
                raise ValueError(f"{len(said)} responses to {len(frame)} requests")
            yield frame.assign(raw=said)

    return requests.select("key", "request").mapInPandas(run, "key string, request string, raw string")


def cached_responses(requests: DataFrame, cache: DataFrame | None, chat: Chat) -> tuple[DataFrame, DataFrame]:
    """The requests with their responses, and the grown cache; only requests that it lacks reach the model."""
    fresh = cut(ask(sinks.missing_responses(requests, cache), chat))
    grown = fresh if cache is None else cache.unionByName(fresh)
    return requests.withColumn("key", F.sha2("request", 256)).join(grown.select("key", "raw"), "key"), grown


def answer(selected: DataFrame, questions: DataFrame, chat: Chat) -> DataFrame:
    """(query_id, answer, labels, cited, unknown, warning) from selected rows (query_id, place, title, text, final_score)."""
    contexts = retrieve.context(retrieve.sources(selected)).join(questions.select("query_id", "question"), "query_id")
    prompts = contexts.withColumn("request", F.concat_ws("\n\n", "context", F.col("question"))).withColumn("key", F.sha2("request", 256))
    said = ask(prompts.select("key", "request").dropDuplicates(["key"]), chat)
    return retrieve.checked_answers(prompts.join(said.select("key", F.col("raw").alias("answer")), "key").select("query_id", "answer", "labels"))


def quoting_responder(asked: list[str]) -> list[str]:
    """A deterministic stand-in for a model: proposes that the source sets a condition for the target, quoting the beginning of both."""
    out = []
    for request in map(json.loads, asked):
        by = {c["article_id"]: c for c in request["chunks"]}
        if len(by) < 2:
            out.append("{}")
            continue
        source, target = by[request["source_id"]], by[request["target_id"]]
        quotes = [" ".join(c["body"].split(" ")[:12]) for c in (source, target)]
        bridge = {"source_quote": quotes[0], "target_quote": quotes[1], "explanation": "the first quote states when the second one applies"}
        relation = {"source_id": request["source_id"], "target_id": request["target_id"], "kind": "SETS_CONDITION_FOR", "source_chunk_id": source["chunk_id"], "target_chunk_id": target["chunk_id"]}
        relation |= {"evidence": source["body"], "target_evidence": target["body"], "confidence": "0.9", "bridge": bridge}
        out.append(json.dumps({"relations": [relation], "facts": []}, ensure_ascii=False))
    return out


def embed_chunks(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], dimension: int, progress: Callable[[int], None] | None = None) -> DataFrame:
    """(id, embedding) of chunks (id, text), one model call for each Arrow batch; null texts count as empty.

    A response of another length or dimension, or with values that aren't finite, is an error.  ``progress`` is told, where
    the batch is, how many rows it had.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = model([t or "" for t in frame["text"]])
            if len(vectors) != len(frame) or any(len(v) != dimension or not all(map(math.isfinite, v)) for v in vectors):
                raise ValueError(f"the model gave {len(vectors)} vectors for {len(frame)} texts, or some of another dimension than {dimension}")
            if progress:
                progress(len(frame))
            yield pd.DataFrame({"id": frame["id"], "embedding": vectors})

    kind = chunks.schema["id"].dataType.simpleString()
    return chunks.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>")


def response_schema(chunk_aliases: list[str], relations: int = 2, facts: int = 3) -> dict:
    """JSON schema of a response: only these chunk aliases, and at most so many relations and facts."""
    if not chunk_aliases or relations < 1 or facts < 0:
        raise ValueError("a response needs aliases and at least one relation")
    chunk, text = {"type": "string", "enum": sorted(set(chunk_aliases))}, {"type": "string"}
    relation = {"kind": text, "source_chunk_id": chunk, "target_chunk_id": chunk, "evidence": text, "target_evidence": text, "confidence": {"type": "number"}}
    fact = {"chunk_id": chunk, "kind": {"type": "string", "enum": list(validate.FACT_KINDS)}, "name": text, "evidence": text}
    many = lambda properties, most: {"type": "array", "maxItems": most, "items": {"type": "object", "properties": properties, "required": sorted(properties)}}
    return {"type": "object", "properties": {"relations": many(relation, relations), "facts": many(fact, facts)}, "required": ["relations", "facts"]}


def build_document_relations(candidates: DataFrame, chunks: DataFrame, numbers: DataFrame, chat: Chat, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Verified relations of candidates (source_id, target_id, request), and the grown cache."""
    said, grown = cached_responses(candidates, cache, chat)
    named = said.withColumnsRenamed({"source_id": "candidate_source", "target_id": "candidate_target"})
    proposals = validate.parse_proposals(named).withColumnsRenamed({f"p_{c}": c for c in ("source_id", "target_id", "kind", "source_chunk_id", "target_chunk_id", "evidence")})
    return validate.document_relations(proposals, chunks, numbers), grown


def ablation(hybrid: DataFrame, edges: DataFrame, gold: DataFrame, k: int, most_chars: int, settings: dict | None = None, structural: DataFrame | None = None) -> DataFrame:
    """(mode, qid, metrics, recovered, lost, added): all modes over one frozen ranking.

    ``hybrid`` has (query_id, article_id, rank, cosine, overlap, chars); articles reached only by
    the graph need their chars, so they are taken where another question ranks them, else as 0.
    """
    ranked = cut(hybrid)
    seeds = retrieve.distinct_seeds(ranked, (settings or {}).get("seed_limit", 5), "article_id").select("query_id", F.col("seed").alias("node"))
    sizes = ranked.groupBy("article_id").agg(F.max("chars").alias("size"))
    out = None
    for mode in MODES:
        config = Expansion(mode=mode, **(settings or {}))
        reached = graph.expand_articles(seeds, graph.usable_edges(edges, config), config, structural)
        reached = reached.select("query_id", F.col("node").alias("article_id"), F.col("score").alias("graph_score"))
        rows = ranked.join(reached, ["query_id", "article_id"], "full").join(sizes, "article_id", "left")
        rows = rows.withColumn("chars", F.coalesce("chars", "size", F.lit(0))).drop("size")
        chosen = retrieve.retrieve_articles(rows, config, k, most_chars).select(F.col("query_id").alias("qid"), F.col("article_id").alias("item"), F.col("place").alias("rank"), F.lit(mode).alias("mode"))
        out = chosen if out is None else out.unionByName(chosen)
    chosen = cut(out)
    scores = evaluate.score_rankings(chosen, gold, k, ("qid", "mode"))
    return scores.join(evaluate.against_baseline(chosen, gold, "M0"), ["qid", "mode"])


def health(spark: SparkSession, **probes: Callable[[], object]) -> dict[str, str]:
    """The state of the engine and of each injected service; one that fails doesn't hide the others."""
    out = {}
    for name, probe in {"engine": lambda: spark.range(1).count(), **probes}.items():
        try:
            probe()
            out[name] = "ok"
        except Exception as error:  # noqa: BLE001
            out[name] = f"{type(error).__name__}: {error}"
    return out


def provenance(candidate: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Candidates with their scores and ``extra`` as one JSON text."""
    own = F.to_json(F.struct("source_id", "target_id", "rank_score"))
    given = F.to_json(F.create_map(*(F.lit(x) for pair in extra.items() for x in pair))) if extra else F.lit("{}")
    return candidate.withColumn("provenance", X.merge_json(own, given))
