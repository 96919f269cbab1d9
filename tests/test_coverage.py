"""Operators that no registered query calls, and cases of those that have one."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import evaluate, graph, heavy, retrieve, search, validate
from dossier.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_last_of_repeated_rows_wins(spark):
    old = spark.createDataFrame([("a", 1), ("c", 9)], "id string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 5), ("a", 3), (None, 1), (None, 2)], "id string, n int").coalesce(1)
    assert {(r.id, r.n) for r in sinks.upsert(old, new, "id").collect()} == {("a", 3), ("b", 5), ("c", 9), (None, 2)}
    assert rows(sinks.upsert(None, new.limit(0), "id"), "id") == []


def test_buckets_are_replaced_alone(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    first = spark.createDataFrame([(f"d{k}", k) for k in range(200)], "document_id string, n int")
    store.replace("t", first, first)
    before = store._manifest("t")
    change = spark.createDataFrame([("d7", 700)], "document_id string, n int")
    store.replace("t", change, change.unionByName(spark.createDataFrame([("d9", 0)], "document_id string, n int")))
    got = dict(rows(store.read("t"), "document_id", "n"))
    assert len(got) == 199 and got["d7"] == 700 and "d9" not in got
    changed = {b for b, p in store._manifest("t").items() if before.get(b) != p}
    assert 1 <= len(changed) <= 2 and store._manifests("t") == [1, 2]
    store.replace("t", change.limit(0), first)
    assert store.read("t").count() == 0
    # A table written whole moves into buckets.
    store.write("u", first)
    store.replace("u", change, change)
    assert store.read("u").count() == 200


def test_proposals_of_a_wrong_type_are_null(spark):
    good = {"source_id": "a", "confidence": 0.9, "bridge": {"source_quote": "x y z"}}
    raw = [json.dumps(good), json.dumps({"source_id": 5, "evidence": ["x"], "confidence": "0.5", "bridge": "no"}), "no json", None, "[]"]
    got = validate.parse_proposals(spark.createDataFrame([(k, r) for k, r in enumerate(raw)], "n int, raw string")).orderBy("n").collect()
    assert got[0].p_source_id == "a" and got[0].p_confidence == "0.9" and got[0].p_bridge.source_quote == "x y z" and got[0].p_bridge.target_quote is None
    assert got[1].p_source_id is got[1].p_evidence is got[1].p_bridge is None and got[1].p_confidence == "0.5"
    assert all(r.p_source_id is None for r in got[2:])


def test_paths_need_all_their_quotes(spark):
    path = "array<struct<source_chunk_id:string,target_chunk_id:string,evidence:string,target_evidence:string>>"
    data = [("q", "good", [("c1", "c2", "một", "hai")]), ("q", "bad", [("c1", "c2", "một", "hai"), ("c2", "c1", "ba", "một")]), ("q", "lost", [("c1", "c9", "một", "hai")]), ("q", "none", [])]
    bodies = spark.createDataFrame([("q", "c1", "một x"), ("q", "c2", "hai y")], "query_id string, id string, text string")
    assert rows(validate.confirmed_paths(spark.createDataFrame(data, f"query_id string, node string, path {path}"), bodies), "node") == [("good",), ("none",)]


def test_labels_ranks_and_caps(spark):
    near = spark.createDataFrame([("q", "d", ["AMENDS", "REPEALS", "cites"]), ("q", "e", ["AMENDS"])], "query_id string, document_id string, relations array<string>")
    proof = spark.createDataFrame([("q", "d", "AMENDS")], "query_id string, document_id string, kind string")
    assert {r.document_id: r.relations for r in retrieve.kept_labels(near, proof).collect()} == {"d": ["AMENDS", "cites"], "e": []}
    hits = spark.createDataFrame([("q", "a", 2), ("q", "a", 1), ("q", "", 3)], "query_id string, article_id string, rank int")
    assert rows(retrieve.first_ranks(hits), "article_id", "rank") == [("a", 1)]
    part = lambda data: spark.createDataFrame(data, "query_id string, article_id string, place int")
    found = spark.createDataFrame([("q", "g", 0.5), ("q", "a", 0.9)], "query_id string, article_id string, score double")
    kept = retrieve.capped_candidates(part([("q", "a", 1)]), found, part([("q", "z", 1), ("q", "y", 2), ("q", "a", 3)]), 3)
    assert rows(kept, "article_id", "origin") == [("a", 0), ("g", 1), ("z", 2)]


def test_search_helpers(spark):
    chunks = spark.createDataFrame([("b:0", "b", 0, "Điều 3"), ("a:1", "a", 1, "Điều 2"), ("a:0", "a", 0, "Toàn văn")], "id string, document_id string, chunk_index int, section string")
    assert [r.id for r in search.scroll(chunks).collect()] == ["a:0", "a:1", "b:0"]
    assert [r.id for r in search.scroll(chunks, spark.createDataFrame([("b",)], "document_id string")).collect()] == ["b:0"]
    mapping = spark.createDataFrame([("a:1", "a:article:2:occurrence:1")], "chunk_id string, article_id string")
    assert rows(search.article_of(chunks, mapping), "id", "article_id") == [("a:0", ""), ("a:1", "a:article:2:occurrence:1"), ("b:0", "b:article:3")]


def test_concepts_and_shuffled_pairs(spark):
    concepts = spark.createDataFrame([(f"a{k:02}", "x") for k in range(30)] + [("a01", "y"), ("a02", "y")], "article_id string, concept_key string")
    got = {(r.source_id, r.target_id): r.overlap for r in graph.concept_candidates(concepts, 3).collect()}
    assert {t for s, t in got if s == "a00"} == {"a01", "a02", "a03"} and {t for s, t in got if s == "a29"} == {"a00", "a01", "a02"} and got["a01", "a02"] == 2
    edges = spark.createDataFrame([(f"s{k % 20}", f"t{k % 50}", "K") for k in range(1000)], "source_id string, target_id string, kind string")
    mixed = graph.shuffled_edges(edges, 42)
    assert mixed.select("source_id", "target_id").distinct().count() > 500  # the edges have 100


def test_heavy_sketch_recounts_all_candidates(spark):
    words = " ".join(w for k in range(50) for w in [f"a{k}", f"b{k}"] for _ in range(1 + k % 7))
    df = spark.createDataFrame([(words,), (words,), (None,)], "text string")
    assert heavy.heavy_sketch(df, ["text"], 1, 20, 1_000).collect() == heavy.heavy_exact(df, ["text"], 1, 20).collect()


def test_law_level_and_stages(spark):
    ranked = spark.createDataFrame([("m", 1, "a"), ("m", 2, "x")], "mode string, qid int, item string")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "qid int, item string")
    laws = spark.createDataFrame([("a", "l1"), ("b", "l2")], "item string, law_id string")
    assert rows(evaluate.law_recall(ranked, gold, laws), "qid", "law_hit", "laws_missing", "recall") == [(1, True, 1, 0.5), (2, False, 1, 0.0)]
    with pytest.raises(Exception, match="no law for b"):
        evaluate.law_recall(ranked, gold, laws.where("item = 'a'")).collect()
    items = laws.select("item")
    got = evaluate.miss_stages(gold, items, spark.createDataFrame([(1, "a"), (1, "b")], "qid int, item string"), ranked.select("qid", "item"))
    assert rows(got, "qid", "item", "stage") == [(1, "a", "found"), (1, "b", "not_selected"), (2, "b", "not_candidate")]
    assert rows(evaluate.covered_questions(gold, items.where("item = 'b'")), "qid", "covered") == [(1, False), (2, True)]


def test_equal_rows_are_drawn_apart(spark):
    same = spark.createDataFrame([(1.0,)] * 200 + [(-1.0,)] * 200, "difference double")
    got = evaluate.paired_bootstrap(same, draws=400).first()
    assert got["mean"] == 0 and -0.2 < got.lower < -0.05 and 0.05 < got.upper < 0.2


def test_small_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, ["x"]), ("b", 1, None)], "gram string, n int, tags array<string>")
    sinks.append_lines(df.select("gram", "n"), str(tmp_path / "lines"))
    sinks.append_lines(df.select("gram", "n"), str(tmp_path / "lines"))
    assert readers.json_lines(spark, str(tmp_path / "lines"), "gram string, n int").count() == 4
    sinks.gram_report(df, str(tmp_path / "grams"))
    lines = "".join(p.read_text() for p in (tmp_path / "grams").glob("*.csv")).splitlines()
    assert lines == ["rank\tcount\tphrase", "1\t2\ta", "2\t1\tb"]
    sinks.flat_report(df, str(tmp_path / "flat"))
    assert spark.read.option("header", True).csv(str(tmp_path / "flat")).where("gram = 'a'").first().tags == '["x"]'
    sinks.write_report_json(str(tmp_path / "r.json"), {"a": "đ"})
    with pytest.raises(FileExistsError):
        sinks.write_report_json(str(tmp_path / "r.json"), {})
    state = spark.createDataFrame([("d", "h"), ("e", "i")], "document_id string, index_hash string")
    assert rows(readers.index_hashes(state, state.where("document_id = 'e'")), "index_hash") == [("i",)]
    links = spark.createDataFrame([("c1", "a1"), ("c2", "a1"), ("c2", "a2")], "chunk_id string, article_id string")
    assert rows(readers.unambiguous_articles(links), "chunk_id") == [("c1",)]
    known = spark.createDataFrame([("a1", "d", "h1"), ("a2", "e", "h2")], "id string, document_id string, structure_hash string")
    chunks = spark.createDataFrame([("c1", "d"), ("c2", "e")], "id string, document_id string")
    assert rows(sinks.link_article_chunks(links, known, chunks), "chunk_id", "article_id") == [("c1", "a1"), ("c2", "a2")]
    relations = spark.createDataFrame([("a1", "a2", "CITES", "c1", "c2"), ("a1", "a2", "CITES", "c9", "c2")], "source_id string, target_id string, kind string, source_chunk_id string, target_chunk_id string")
    merged = sinks.merge_article_relations(None, relations, links, known)
    assert rows(merged, "source_chunk_id", "source_hash", "target_hash") == [("c1", "h1", "h2")] and sinks.merge_article_relations(merged, relations, links, known).count() == 1
    facts = spark.createDataFrame([("f1", "a1", "k", "DEFINES"), ("f2", "a1", "k", "PENALTY")], "id string, article_id string, concept_key string, kind string")
    every, named = sinks.merge_facts(None, facts)
    assert every.count() == 2 and rows(named, "kind") == [("DEFINES",)]
    alias = spark.createDataFrame([("A0",), ("A9",), (None,)], "c string").select(X.resolve_alias("c", {"A0": "d1"}).alias("x"))
    assert [r.x for r in alias.collect()] == ["d1", "", ""]


def test_folder_is_required_on_a_cluster(spark, monkeypatch):
    from dossier.plans import shared

    class Context:
        master, applicationId = "spark://x", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="must name a folder"):
        shared.shared_folder(Session())
    assert shared.spill_folder(spark).startswith("/") and F is not None
