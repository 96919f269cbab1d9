import json

import pytest
from pyspark.sql import functions as F

from dossier.operators import chunking as C
from dossier.operators import graph, validate
from dossier.plans import articles
from dossier.plans.settings import Expansion

TEXTS = {
    "a": "Điều 1. Thuyền phải có giấy phép neo đậu. Điều 2. Theo Điều 1 Luật 7/2020/QH1 thì phải nộp phí bến.",
    "b": "Điều 1. Phí bến được thu mỗi tháng tại cảng. Điều 2. Kho hàng ở phía tây.",
    "c": "Điều 1. Chợ họp vào sáng sớm mùa hè. Điều 2. Người bán phải giữ vệ sinh chung.",
}
NUMBERS = {"a": "1/2021/NĐ-A", "b": "7/2020/QH1", "c": "9/2019/QĐ-C"}


@pytest.fixture(scope="module")
def base(spark):
    rows = [(k, f"Tên {k}", NUMBERS[k], t, "2020-01-01", None, None) for k, t in TEXTS.items()]
    documents = spark.createDataFrame(rows, "id string, title string, number string, full_text string, effective_date string, expiry_date string, status string")
    chunks, provisions = C.chunk_documents(documents), C.parse_structure(documents)
    mapping = C.map_chunks(provisions, chunks)
    owners = graph.unique_owners(spark.createDataFrame([(n, k) for k, n in NUMBERS.items()], "number_norm string, document_id string"))
    # Vectors: one direction for each document, the second article a little aside.
    vector = F.array(*((F.col("document_id") == k).cast("double") + 0.1 * F.col("chunk_index") * F.lit(n) for n, k in enumerate(TEXTS)))
    points = chunks.select("id", "document_id", "text", vector.alias("embedding"))
    return documents, chunks, provisions, mapping, owners, points


def edges(base):
    documents, chunks, _, mapping, owners, _ = base
    proposed = C.article_citations(chunks, mapping, owners).withColumn("bridge", validate.no_bridge())
    return validate.article_relations(proposed, chunks, mapping, documents, owners)


def test_path_brings_its_article(spark, base):
    corpus = articles.Corpus(base[5], base[3], edges(base))
    asked = spark.createDataFrame([(1, "giấy phép neo đậu thuyền", [1.0, 0.0, 0.0]), (2, " ", [1.0, 0.0, 0.0]), (3, "nộp phí theo luật", [1.0, 0.0, 0.0])], "query_id int, text string, embedding array<double>")
    got = articles.retrieve_articles(corpus, asked, Expansion(mode="M2", candidate_budget=4, seed_limit=1, hybrid_pool=4), 3)
    rows = {(r.query_id, r.article_id): r for r in got.selected.collect()}
    assert {q for q, _ in rows} == {1, 3} and rows[3, "b:article:1"].graph_score > 0
    assert {r.evidence[:6] for r in got.grounds.where("query_id = 3").collect()} == {"Theo Đ"}
    # A relation whose quote isn't in its chunk leads nowhere.
    false = corpus._replace(edges=corpus.edges.withColumn("evidence", F.lit("không có")))
    bad = articles.retrieve_articles(false, asked, Expansion(mode="M2", candidate_budget=4, seed_limit=1, hybrid_pool=4), 3)
    assert not bad.candidates.where("graph_score IS NOT NULL").count() and not bad.grounds.count()
    none = articles.retrieve_articles(corpus, asked, Expansion(mode="M0", candidate_budget=4), 3)
    assert not none.candidates.where("graph_score IS NOT NULL").count()
    with pytest.raises(ValueError):
        articles.retrieve_articles(corpus, asked, Expansion(candidate_budget=4), 5)
    assert articles.retrieve_articles(corpus, asked.limit(0), Expansion(mode="M2", candidate_budget=4), 3).selected.count() == 0


def test_prompts_have_evidence_lines(spark, base):
    corpus = articles.Corpus(base[5], base[3], edges(base))
    asked = spark.createDataFrame([(3, "nộp phí theo luật", [1.0, 0.0, 0.0])], "query_id int, text string, embedding array<double>")
    got = articles.retrieve_articles(corpus, asked, Expansion(mode="M2", candidate_budget=4, seed_limit=1), 3)
    titles = base[0].select(F.col("id").alias("document_id"), "title", "number")
    prompt = articles.answer_prompts(got.selected, titles, got.grounds, asked).first()
    assert "a:article:2 --CITES--> b:article:1; Theo Điều 1" in prompt.request and prompt.labels[0] == "S1" and "Tên a" in prompt.request


def test_seven_configurations(spark, base):
    corpus = articles.Corpus(base[5], base[3], edges(base))
    asked = spark.createDataFrame([(3, "nộp phí theo luật", [1.0, 0.0, 0.0])], "query_id int, text string, embedding array<double>")
    gold = spark.createDataFrame([(3, "a:article:2"), (3, "b:article:1")], "qid int, item string")
    got = {r["mode"]: r for r in articles.configurations(corpus, asked, gold, gold.select("item"), 3).collect()}
    assert set(got) == set(articles.CONFIGURATIONS) and all(r.covered for r in got.values())
    assert got["graph_shared"].reached_1 == 2 and got["hybrid"].recovered == got["hybrid"].lost == 0 and got["hybrid_larger"].candidate_recall == 1


def test_relations_are_proposed_validated_and_reviewed(spark, base):
    documents, chunks, provisions, mapping, owners, points = base
    sources = spark.createDataFrame([("a:article:2",), ("b:article:1",)], "article_id string")
    found = articles.relation_candidates(chunks, mapping, points, owners, sources).collect()
    pairs = {(r.source_id, r.target_id): r for r in found}
    assert pairs["a:article:2", "b:article:1"].explicit and "dense" in pairs["a:article:2", "a:article:1"].scores and "lexical" in pairs["b:article:1", "a:article:2"].scores

    def chat(asked):
        out = []
        for request in map(json.loads, asked):
            by = {c["article_id"]: c for c in request["chunks"]}
            source, target = by[request["source_id"]], by[request["target_id"]]
            relation = {
                "source_id": request["source_id"], "target_id": request["target_id"], "kind": "SETS_CONDITION_FOR", "source_chunk_id": source["chunk_id"],
                "target_chunk_id": target["chunk_id"], "evidence": source["body"], "target_evidence": target["body"], "confidence": 0.9,
                "bridge": {"source_quote": source["body"][:30], "target_quote": target["body"][:30], "explanation": "một hai ba bốn năm sáu bảy tám"},
            }
            fact = {"article_id": request["source_id"], "chunk_id": source["chunk_id"], "kind": "OBLIGATION", "name": "phí bến", "evidence": source["body"]}
            out.append(json.dumps({"relations": [relation], "facts": [fact]}, ensure_ascii=False))
        return out

    merged = spark.createDataFrame([r for r in found if (r.source_id, r.target_id) in {("a:article:2", "a:article:1"), ("a:article:2", "b:article:1")}], articles.relation_candidates(chunks, mapping, points, owners, sources).schema)
    built = articles.build_article_relations(documents, chunks, mapping, owners, provisions, merged, chat, lambda asked: [json.dumps({"supported": "b:article:1" in a}) for a in asked])
    got = {(r.source_id, r.target_id, r.kind, r.method) for r in built.relations.collect()}
    assert got == {("a:article:2", "b:article:1", "CITES", "stated"), ("a:article:2", "b:article:1", "SETS_CONDITION_FOR", "model")}
    assert {r.name for r in built.facts.collect()} == {"phí bến"} and built.cache.count() == built.reviews.count() == 2

    def never(asked):
        raise AssertionError("the cache has all")

    again = articles.build_article_relations(documents, chunks, mapping, owners, provisions, merged, never, never, built.cache, built.reviews)
    assert again.relations.count() == 2


def test_scope_looks_at_the_targets_own_article(spark):
    rows = [("s", "t:article:5", "CITES", "c", "d", said, "phí bến") for said in ("Điều 3 và khoản 2 Điều 5", "khoản 1 Điều 5", "Điều 5")]
    relations = spark.createDataFrame(rows, "source_id string, target_id string, kind string, source_chunk_id string, target_chunk_id string, evidence string, target_evidence string")
    provisions = spark.createDataFrame([("t:article:5", "Clause", "1", "1. Phí  bến: phí bến"), ("t:article:5", "Clause", "2", "2. Khác")], "parent_id string, level string, label string, text string")
    kept = []
    for row in relations.collect():
        kept += [r.evidence for r in validate.scope_matches(spark.createDataFrame([row], relations.schema), provisions).collect()]
    assert kept == ["khoản 1 Điều 5", "Điều 5"]
