import json

import pytest

from dossier.plans import pipelines


def test_answers(spark):
    selected = spark.createDataFrame([("q", 1, "T", "Nội dung", 0.5)], "query_id string, place int, title string, text string, final_score double")
    questions = spark.createDataFrame([("q", "Hỏi?")], "query_id string, question string")
    got = pipelines.answer(selected, questions, lambda texts: ["Theo [S1]." for _ in texts]).first()
    assert got.cited == ["S1"] and got.warning == ""


def test_relations_use_the_cache(spark):
    response = {"source_id": "d1", "target_id": "d2", "kind": "REPEALS", "source_chunk_id": "c1", "target_chunk_id": "", "evidence": "Bãi bỏ Quyết định số 46/2008/QĐ-UBND"}
    candidates = spark.createDataFrame([("d1", "d2", "r1"), ("d2", "d1", "r2")], "source_id string, target_id string, request string")
    chunks = spark.createDataFrame([("c1", "d1", "Điều 1. Bãi bỏ Quyết định số 46/2008/QĐ-UBND.")], "id string, document_id string, body string")
    numbers = spark.createDataFrame([("d2", "46/2008/QĐ-UBND")], "document_id string, number_norm string")
    said = json.dumps(response)
    found, cache = pipelines.build_document_relations(candidates, chunks, numbers, lambda texts: [said if t == "r1" else "none" for t in texts])
    assert [(r.source_id, r.target_id, r.kind) for r in found.collect()] == [("d1", "d2", "REPEALS")]

    def broken(texts):
        raise AssertionError("asked again")

    again, _ = pipelines.build_document_relations(candidates, chunks, numbers, broken, cache)
    assert again.count() == 1


def test_ablation(spark):
    hybrid = spark.createDataFrame([("q", "a1", 1, 0.2, 0.0, 5), ("q", "a2", 2, 0.1, 0.0, 5)], "query_id string, article_id string, rank int, cosine double, overlap double, chars int")
    edges = spark.createDataFrame([("a1", "a3", "SPECIFIES", 1.0)], "source_id string, target_id string, kind string, confidence double")
    gold = spark.createDataFrame([("q", "a3")], "qid string, item string")
    got = {r["mode"]: r for r in pipelines.ablation(hybrid, edges, gold, 3, 100).collect()}
    assert set(got) == {"M0", "M1", "M2", "M3", "M4"} and got["M0"].hit == 0 and got["M3"].hit == got["M4"].hit == 1 and got["M3"].recovered == 1 and got["M2"].added == 0


def test_schema_and_health(spark):
    assert pipelines.response_schema(["b", "a"])["properties"]["relations"]["maxItems"] == 2
    with pytest.raises(ValueError):
        pipelines.response_schema([])
    state = pipelines.health(spark, model=lambda: 1 / 0)
    assert state["engine"] == "ok" and state["model"].startswith("ZeroDivisionError")


def test_embedding_is_batched_and_checked(spark):
    chunks = spark.createDataFrame([("a", "xy"), ("b", None)], "id string, text string")
    got = pipelines.embed_chunks(chunks, lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    assert {r.id: r.embedding for r in got.collect()} == {"a": [2.0, 1.0], "b": [0.0, 1.0]}
    assert pipelines.embed_chunks(chunks.limit(0), lambda texts: [], 2).count() == 0
    for wrong in (lambda texts: [], lambda texts: [[1.0]] * len(texts), lambda texts: [[1.0, float("nan")]] * len(texts)):
        with pytest.raises(Exception, match="the model gave"):
            pipelines.embed_chunks(chunks, wrong, 2).collect()
