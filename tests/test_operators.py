import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import candidates, evaluate, graph, heavy, orphans, retrieve, search, tfidf, validate
from dossier.plans.settings import Expansion
from dossier.plans.shared import earliest_rows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


rows_of = rows


def test_dense_search(spark):
    points = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 0.0], "x"), ("c", [1.0, 0.0], "y")], "id string, embedding array<float>, status string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert rows(search.dense_topk(points, asked, 2), "id", "score") == [("a", 1.0), ("c", 1.0)]
    assert search.dense_topk(points, asked, 5, predicate=F.col("status") == "none").count() == 0
    assert search.check_dimension(points, "embedding") == 2
    with pytest.raises(ValueError):
        search.check_dimension(points, "embedding", 3)


def test_hybrid_modes(spark):
    points = spark.createDataFrame([("a", "hồ sơ đất", [1.0, 0.0]), ("b", "thuế phí", [0.0, 1.0]), ("c", None, [0.5, 0.5])], "id string, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "thuế", [1.0, 0.0])], "query_id int, text string, embedding array<float>")
    assert [r.id for r in search.search(points, asked, "bm25").collect()] == ["b"]
    assert {r.id for r in search.search(points, asked).collect()} == {"a", "b", "c"}
    assert search.search(points, asked, "hybrid", predicate=F.col("id") == "zzz").count() == 0
    assert search.search(points, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        search.search(points.drop("text"), asked, "bm25")
    with pytest.raises(ValueError):
        search.search(points, asked, "best")


def test_block_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(search, "POINT_ROWS", 9)
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=6).round(1).tolist() for _ in range(60)] + [[0.0] * 6, None, [1.0, None, 0.0, 0.0, 0.0, 0.0]]
    vectors += vectors[:20]  # ties
    words = [" ".join(f"w{k}" for k in rng.integers(0, 25, size=rng.integers(0, 12))) for _ in vectors[:-1]] + [None]
    rows = [(k, v, w) for k, (v, w) in enumerate(zip(vectors, words))]
    points = spark.createDataFrame(rows, "id int, embedding array<double>, text string").repartition(5)
    asked = points.where("id % 4 = 0").withColumnRenamed("id", "query_id")
    full = np.array([[x or 0.0 for x in v] if v else [0.0] * 6 for v in vectors])
    norms = np.linalg.norm(full, axis=1, keepdims=True)
    unit = np.divide(full, norms, out=np.zeros_like(full), where=norms > 0)
    expected = []
    for q in range(0, len(rows), 4):
        scores = (unit @ unit[q]).round(9)
        expected += [(q, p, n) for n, p in enumerate(sorted(range(len(rows)), key=lambda p: (-scores[p], p))[:5], 1)]
    assert rows_of(search.dense_topk(points, asked, 5), "query_id", "id", "rank") == sorted(expected)
    texts = [(w or "").split() for w in words]
    df = {t: sum(t in w for w in texts) for w in texts for t in w}
    expected = []
    for q in range(0, len(rows), 4):
        scores = {}
        for p, own in enumerate(texts):
            for t in set(texts[q]) & set(own):
                tf = own.count(t)
                scores[p] = scores.get(p, 0) + math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / 256))
        expected += [(q, p, n) for n, p in enumerate(sorted(scores, key=lambda p: (-round(scores[p], 9), p))[:5], 1)]
    assert rows_of(search.bm25_topk(points, asked, 5), "query_id", "id", "rank") == sorted(expected)


def test_index_recall(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 8))
    points = spark.createDataFrame([(k, (middles[k % 20] + 0.3 * rng.normal(size=8)).tolist()) for k in range(3_000)], "id int, embedding array<double>")
    cells = search.fit_cells(points, cells=20, sample=1_000)
    index = search.index_cells(points, cells)
    asked = points.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = set(rows_of(search.indexed_topk(index, cells, asked, 10), "query_id", "id"))
    exact = set(rows_of(search.dense_topk(points, asked, 10), "query_id", "id"))
    assert index.count() == 3_000 and cells.probes < 10 and len(found & exact) >= 0.9 * len(exact)
    assert search.indexed_topk(index.limit(0), cells, asked, 10).count() == 0 and search.fit_cells(points.limit(0)).probes == 1


def test_fusion_and_page(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    got = {r.id: r.score for r in search.fuse(a, a.where("id = 'y'")).collect()}
    assert got["x"] == pytest.approx(1 / 61) and got["y"] == pytest.approx(2 / 62)
    assert search.page(a, 1, "x").count() == 1
    with pytest.raises(ValueError):
        search.page(a, 0)


def test_tfidf(spark):
    same = spark.createDataFrame([("a", "hồ sơ"), ("b", "hồ sơ")], "id string, text string")
    weights = tfidf.fit_or_relax(same, tfidf.word_grams("text"))
    assert rows(tfidf.best_targets(tfidf.similar_pairs(weights), 3), "source_id", "target_id", "rank") == [("a", "b", 1), ("b", "a", 1)]
    apart = spark.createDataFrame([("a", "hồ"), ("b", "sơ")], "id string, text string")
    assert tfidf.similar_pairs(tfidf.fit_or_relax(apart, tfidf.word_grams("text"))).count() == 0
    assert rows(same.limit(1).select(F.explode(tfidf.char_grams("text", 5, 5)).alias("g")), "g") == [("hồ sơ",)]


def test_best_pairs_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(tfidf, "SCORE_NUMBERS", 40)
    made = [(f"t{k}", f"d{k // 2}", " ".join(f"w{(k * k * 7 + j * j * (k % 5 + 1)) % 23}" for j in range(6))) for k in range(40)] + [("n1", "n", None), (None, "d1", "w1 w2")]
    texts = spark.createDataFrame(made, "id string, document_id string, text string").repartition(3)
    weights = tfidf.fit(texts, tfidf.word_grams("text", 1, 1), features=None).cache()
    group = texts.select("id", "document_id")
    for number in (1, 3, 100):
        alone = tfidf.best_targets(tfidf.similar_pairs(weights).withColumn("score", F.round("score", 6)), number)
        got = tfidf.best_pairs(tfidf.vector_rows(weights), number, decimals=6)
        assert rows(got, "source_id", "target_id", "score", "rank") == rows(alone, "source_id", "target_id", "score", "rank")
    vectors = tfidf.vector_rows(weights).drop("document_id").join(group, "id")
    asked = vectors.where("document_id IN ('d1', 'd2', 'd9')")
    every = tfidf.similar_pairs(weights, group, asked.select("document_id").distinct()).groupBy("source_document", "target_document").agg(F.round(F.max("score"), 6).alias("score"))
    got = tfidf.best_pairs(vectors, 4, asked, 6)
    assert rows(got, "source_document", "target_document", "score", "rank") == rows(tfidf.best_targets(every, 4, "source_document", "target_document"), "source_document", "target_document", "score", "rank")
    scores = {(r.source_id, r.target_id): round(r.score, 6) for r in tfidf.similar_pairs(weights).collect()}
    assert all(scores[r.source_id, r.target_id] == r.score for r in got.collect())


def test_vectors_are_those_of_the_long_table(spark):
    said = ["hồ sơ và hồ sơ", "Hồ sơ của bến", None, "bến", "hồ của sơ và bến", "", "mỏ"]
    texts = spark.createDataFrame([(f"t{k}", f"d{k // 2}", t) for k, t in enumerate(said)], "id string, document_id string, text string").repartition(2)
    for options in ({}, {"features": 3}, {"max_df": 0.3}, {"min_df": 9}):
        long = tfidf.fit_or_relax(texts, tfidf.word_grams("text", 1, 2), **options)
        got = tfidf.fit_vectors(texts, tfidf.word_tokens("text"), 1, 2, ["id", "document_id"], **options)
        sums = lambda df: {(r.source_id, r.target_id): round(r.score, 9) for r in tfidf.similar_pairs(df).collect()}
        assert sums(got.select("id", F.explode(F.arrays_zip("terms", "w")).alias("v")).select("id", "v.terms", "v.w").toDF("id", "term", "w")) == sums(long)
        assert got.count() == long.select("id").distinct().count()


def test_pairs_of_texts_are_never_rows(spark):
    from dossier import queries

    plan = queries.q_tfidf_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


EDGE = "source_id string, target_id string, kind string, confidence double"


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b", "CITES", 1.0), ("b", "c", "CITES", 1.0)], EDGE)
    seeds = spark.createDataFrame([("q", "c")], "query_id string, node string")
    assert rows(graph.reachable(seeds, edges, 1), "node", "depth") == [("b", 1), ("c", 0)]
    assert rows(graph.reachable(seeds, edges, 2), "node", "depth") == [("a", 2), ("b", 1), ("c", 0)]


def test_expansion_scores(spark):
    edges = spark.createDataFrame([("a", "b", "CITES", 1.0), ("b", "c", "CITES", 1.0)], EDGE)
    seeds = spark.createDataFrame([("q", "c")], "query_id string, node string")
    got = {r.node: r for r in graph.expand_articles(seeds, edges, Expansion(mode="M2")).collect()}
    assert got["b"].score == pytest.approx(0.35) and got["a"].score == pytest.approx(0.079625)
    assert [(h.source_id, h.target_id) for h in got["a"].path] == [("b", "c"), ("a", "b")]
    assert graph.expand_articles(seeds, edges, Expansion(mode="M0")).count() == 0
    assert graph.expand_articles(seeds, edges, Expansion(candidate_budget=1)).count() == 1
    near = spark.createDataFrame([("c", "s")], "at string, to string")
    assert {r.node for r in graph.expand_articles(seeds, edges, Expansion(mode="M1"), near).collect()} >= {"s"}


def test_usable_edges(spark):
    edges = spark.createDataFrame([("a", "b", "CITES", 0.95, "2026-01-01", "2027-01-01", "known", "h1", "h2")], EDGE + ", valid_from string, valid_to string, temporal_status string, source_hash string, target_hash string")
    assert graph.usable_edges(edges, Expansion(), moment="2026-06-01").count() == 1
    assert graph.usable_edges(edges, Expansion(), moment="2027-01-01").count() == 0
    assert graph.usable_edges(edges, Expansion(confidence=0.99)).count() == 0
    now = spark.createDataFrame([("a", "h1"), ("b", "changed")], "id string, structure_hash string")
    assert graph.usable_edges(edges, Expansion(), now).count() == 0


def test_document_expansion(spark):
    seeds = spark.createDataFrame([("q", "d1")], "query_id string, seed string")
    entities = spark.createDataFrame([("d1", "agency", "x"), ("d2", "agency", "x")], "document_id string, etype string, entity_key string")
    mentions = spark.createDataFrame([("d1", "n3")], "document_id string, number_norm string")
    owners = graph.unique_owners(spark.createDataFrame([("d3", "n3"), ("d4", "n4"), ("d5", "n4")], "document_id string, number_norm string"))
    relations = spark.createDataFrame([("d1", "d3", "REPEALS", "quote")], "source_id string, target_id string, kind string, evidence string")
    got = {r.document_id: r for r in graph.expand_documents(seeds, entities, mentions, owners, relations, 5).collect()}
    assert got["d2"].graph_score == pytest.approx(0.2) and got["d3"].graph_score == 1.0 and got["d3"].relations == ["REPEALS", "cites"] and len(got["d3"].evidence) == 1


def test_shuffled_keeps_degrees(spark):
    edges = spark.createDataFrame([("a", "x", "K"), ("a", "y", "K"), ("b", "x", "K")], "source_id string, target_id string, kind string")
    got = graph.shuffled_edges(edges, 42)
    assert rows(got, "source_id") == rows(edges, "source_id") and rows(got, "target_id") == rows(edges, "target_id")


def test_budget_skips_and_goes_on(spark):
    hits = spark.createDataFrame([("q", "a", "d1", 3, 9), ("q", "b", "d2", 9, 8), ("q", "c", "d1", 2, 7), ("q", "d", "d1", 1, 6)], "query_id string, id string, document_id string, chars int, s int")
    got = retrieve.budget_select(hits, [F.desc("s")], 3, 6, 2)
    assert rows(got, "place", "id") == [(1, "a"), (2, "c")]
    assert retrieve.budget_select(hits, [F.desc("s")], 3, 1, 2).select("id").collect()[0].id == "d"


def test_merged_scores(spark):
    schema = "query_id string, id string, document_id string, chars int, score double"
    seeds = spark.createDataFrame([("q", "c1", "d1", 1, 0.95)], schema)
    near = spark.createDataFrame([("q", "c2", "d2", 1, 0.8)], schema)
    proof = spark.createDataFrame([("q", "c1", "d1", 1, 0.1)], schema)
    neighbours = spark.createDataFrame([("q", "d2", 1.0)], "query_id string, document_id string, graph_score double")
    got = {r.id: r for r in retrieve.merged_scores(seeds, near, proof, neighbours).collect()}
    assert got["c2"].final_score == pytest.approx(0.85) and got["c1"].final_score == pytest.approx(0.1) and got["c1"].is_evidence


def test_article_scores(spark):
    df = spark.createDataFrame([("q", "a1", 1, 0.2, 0.0, None), ("q", "a3", None, 0.9, 1.0, 0.35)], "query_id string, article_id string, rank int, cosine double, overlap double, graph_score double")
    legacy = {r.article_id: r.score for r in retrieve.article_scores(df, Expansion()).collect()}
    shared = {r.article_id: r.score for r in retrieve.article_scores(df, Expansion(scoring="shared")).collect()}
    assert legacy["a1"] == pytest.approx(1.0) and shared["a3"] == pytest.approx(0.7 * 0.9 + 0.15) and legacy["a3"] == pytest.approx(shared["a3"] + 0.15 * 0.35)


def test_answers(spark):
    df = spark.createDataFrame([("q", "Theo [S1] và [S9].", ["S1", "S2"]), ("r", "Không rõ.", ["S1"])], "query_id string, answer string, labels array<string>")
    assert rows(retrieve.checked_answers(df), "query_id", "warning") == [("q", "unknown sources"), ("r", "no source cited")]


def test_metrics(spark):
    gold = spark.createDataFrame([("q", 1), ("q", 2)], "qid string, item int")
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 1, 2), ("q", 2, 3)], "qid string, item int, rank int")
    assert all(v == pytest.approx(1.0) for v in list(evaluate.score_rankings(ranked, gold, 2).first())[1:])
    half = evaluate.score_rankings(ranked.where("item = 1"), gold, 2).first()
    assert (half.precision, half.recall, half.f1) == (0.5, 0.5, 0.5) and half.ndcg == pytest.approx(1 / (1 + 1 / math.log2(3)))
    with pytest.raises(Exception, match="no gold"):
        evaluate.score_rankings(ranked, gold.limit(0), 2).collect()


def test_bootstrap(spark):
    ones = spark.createDataFrame([(k, 1.0) for k in range(50)], "qid int, difference double")
    assert tuple(evaluate.paired_bootstrap(ones, draws=100).first()) == (1.0, 1.0, 1.0)
    mixed = evaluate.paired_bootstrap(spark.createDataFrame([(k, float(k % 2)) for k in range(200)], "qid int, difference double"), draws=200).first()
    assert mixed.lower < mixed["mean"] == 0.5 < mixed.upper


def test_mapping_outcomes(spark):
    long = "x" * 40
    passages = spark.createDataFrame([("i1", "l", long + "a"), ("i2", "l", long + "b"), ("i3", "l", "y" * 40), ("i4", "l", long)], "item_id string, law_id string, body string")
    articles = spark.createDataFrame([("a1", "l", long + "a"), ("a2", "l", long + "b")], "article_id string, law_id string, body string")
    assert rows(evaluate.mapped_passages(passages, articles), "item_id", "outcome") == [("i1", "mapped"), ("i2", "mapped"), ("i3", "no_exact_article_match"), ("i4", "ambiguous")]


def test_heavy(spark):
    df = spark.createDataFrame([("a b a b", None), ("a b", "b a")], "x string, y string")
    assert [(r.gram, r.n) for r in heavy.heavy_exact(df, ["x", "y"], 2, 2).collect()] == [(r.gram, r.n) for r in heavy.heavy_sketch(df, ["x", "y"], 2, 2).collect()] == [("a b", 3), ("b a", 2)]


def test_candidates(spark):
    base = "source_id string, target_id string, signal string, score double, rank int"
    long = candidates.signals(spark.createDataFrame([("a", "b", "dense", 0.5, 1), ("a", "b", "lexical", 0.4, 2), ("a", "c", "dense", 0.9, 3)], base), spark.createDataFrame([("a", "d", "reference", 1.0)], "source_id string, target_id string, signal string, score double"))
    merged = candidates.merge_signals(long)
    got = {r.target_id: r.rank_score for r in merged.collect()}
    assert got["b"] == pytest.approx(1 / 61 + 1 / 62) and got["d"] == 0
    assert rows(candidates.shortlist(merged, 1), "target_id") == [("b",), ("d",)]
    turns = spark.createDataFrame([("a", "b", True, 0.1), ("b", "a", False, 0.9), ("c", "d", False, 0.5)], "source_id string, target_id string, explicit boolean, rank_score double")
    assert len(candidates.interleave(turns, 5).collect()) == 2
    chunks = spark.createDataFrame([("d", f"d:{k}", k, "Điều 1") for k in range(5)], "document_id string, id string, chunk_index int, section string")
    assert rows(candidates.representatives(chunks, 3), "chunk_index") == [(0,), (2,), (4,)]
    assert rows(candidates.representatives(chunks.where("chunk_index < 2"), 3), "chunk_index") == [(0,)]


def test_interleave_without_a_limit_keeps_every_pair(spark):
    made = {(f"a{k * 7 % 31}", f"a{k * 11 % 37}"): (k % 3 == 0, float(k % 13)) for k in range(900)}
    made = [(*pair, *x) for pair, x in made.items() if pair[0] != pair[1]]
    merged = spark.createDataFrame(made, "source_id string, target_id string, explicit boolean, rank_score double").repartition(5)
    every = candidates.interleave(merged, None)
    assert {tuple(sorted(r[:2])) for r in every.collect()} == {tuple(sorted(r[:2])) for r in made} and every.count() > 200
    names = ("source_id", "target_id", "explicit", "turn")
    assert rows(every, *names) == rows(candidates.interleave(merged, len(made)), *names)
    assert candidates.interleave(merged.where("false"), None).count() == 0


PROPOSED = "candidate_source string, candidate_target string, source_id string, target_id string, kind string, source_chunk_id string, target_chunk_id string, evidence string"
GOOD = ("d1", "d2", "d1", "d2", "REPEALS", "c1", "", "Bãi bỏ Quyết định số 46/2008/QĐ-UBND")


@pytest.mark.parametrize(
    "change, kept",
    [({}, 1), ({2: "d2"}, 0), ({3: "d1"}, 0), ({4: "NONE"}, 0), ({5: "c9"}, 0), ({6: "c1"}, 0), ({7: "Bãi bỏ"}, 0), ({7: " "}, 0), ({4: "AMENDS"}, 0), ({7: "invented 46/2008/QĐ-UBND"}, 0), ({4: None}, 0)],
)
def test_document_relations(spark, change, kept):
    row = tuple(change.get(k, v) for k, v in enumerate(GOOD))
    chunks = spark.createDataFrame([("c1", "d1", "Điều 1. Bãi bỏ Quyết định số 46/2008/QĐ-UBND."), ("c2", "d2", "khác")], "id string, document_id string, body string")
    numbers = spark.createDataFrame([("d2", "46/2008/QĐ-UBND"), ("d1", "1/2026/QĐ-UBND")], "document_id string, number_norm string")
    assert validate.document_relations(spark.createDataFrame([row], PROPOSED), chunks, numbers).count() == kept


def test_validity(spark):
    columns = ["2025-01-01", "", "Còn hiệu lực", "2026-01-02", "", "Còn hiệu lực"]
    def span(kind="CITES", **change):
        values = [change.get(f"v{k}", v) for k, v in enumerate(columns)]
        return spark.range(1).select(validate.validity(F.lit(kind), *(F.lit(v) for v in values)).alias("v")).first().v
    assert (span().valid_from, span().temporal_status) == ("2026-01-02", "known")
    assert span(v0="không rõ").temporal_status == "unknown" and span("REPEALS").temporal_status == "unknown" and span(v2="Hết hiệu lực").temporal_status == "unknown"
    assert span(v1="2025-06-01").empty and not span(v1="2026-06-01").empty


def test_facts(spark):
    fact = lambda kind, name, evidence: ("a", "c", kind, name, evidence)
    proposed = spark.createDataFrame([([fact("OBLIGATION", "nộp hồ sơ", "Phải nộp hồ sơ"), fact("DEFINES", "hồ sơ", "nộp hồ sơ"), fact("OBLIGATION", "khác", "Phải nộp hồ sơ"), fact("ENTITY", "trách nhiệm", "trách nhiệm")],)], "facts array<struct<article_id:string,chunk_id:string,kind:string,name:string,evidence:string>>")
    chunks = spark.createDataFrame([("c", "Phải nộp hồ sơ, trách nhiệm.")], "id string, body string")
    mapping = spark.createDataFrame([("c", "a")], "chunk_id string, article_id string")
    assert rows(validate.facts(proposed, chunks, mapping), "kind", "name") == [("OBLIGATION", "nộp hồ sơ")]


def test_scope(spark):
    relation = "source_id string, target_id string, kind string, source_chunk_id string, target_chunk_id string, evidence string, target_evidence string"
    made = lambda quote: spark.createDataFrame([("s", "d:article:5", "CITES", "c", "t", "theo khoản 3 và khoản 4 Điều 5", quote)], relation)
    provisions = spark.createDataFrame([("Clause", "d:article:5", "1", "1. Một điều."), ("Clause", "d:article:5", "3", "3. Ba điều.")], "level string, parent_id string, label string, text string")
    assert validate.scope_matches(made("Một điều."), provisions).count() == 0 and validate.scope_matches(made("Ba điều."), provisions).count() == 1


def test_orphans(spark):
    t = lambda d: datetime(2025, 1, d)
    documents = spark.createDataFrame([("a", t(2)), ("a", t(9)), ("b", t(1)), (None, t(1))], "id string, loaded_at timestamp")
    states = spark.createDataFrame([("a", "ready", t(3)), ("a", "removed", t(5)), ("a", "ready", t(8)), ("zz", "ready", t(1))], "document_id string, index_status string, changed_at timestamp")
    spans = orphans.presence(documents, states).select(F.lit("t").alias("table_name"), F.col("id").alias("key"), "start", "end")
    asked = [(str(k), key, day) for k, (key, day) in enumerate([("a", 1), ("a", 2), ("a", 4), ("a", 5), ("a", 7), ("a", 8), ("b", 1), ("none", 4), ("", 4), (None, 4)])]
    refs = spark.createDataFrame([("t", i, "2025-01", key, t(d)) for i, key, d in asked], "table_name string, ref_id string, period string, key string, when timestamp")
    refs = refs.withColumn("at", orphans.micros("when"))
    for task_rows in (1, 400_000):
        assert rows(orphans.orphan_references(refs, spans, task_rows), "ref_id") == [("0",), ("3",), ("4",), ("7",)]
    assert orphans.orphan_references(refs, spans.limit(0)).count() == 8
    assert orphans.orphan_references(refs.limit(0), spans).count() == 0


def test_earliest_rows(spark, tmp_path):
    data = [("a", 2, "late"), ("a", 1, "early"), ("b", None, "x"), (None, 1, "no id"), ("a", 1, "early")]
    spark.createDataFrame(data, "id string, loaded_at int, v string").write.parquet(str(tmp_path / "t"))
    assert rows(earliest_rows(spark.read.parquet(str(tmp_path / "t"))), "id", "v") == [("a", "early"), ("b", "x")]
