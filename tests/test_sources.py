import json

import pytest
from pyspark.sql import functions as F

from dossier.plans.settings import Settings
from dossier.sources import readers, sinks
from dossier.streaming import ingest

HEADER = ",".join(name for name, _, _ in readers.DOCUMENT_COLUMNS)


def write_documents(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [HEADER + ",Thừa"]
    for r in rows:
        lines.append(",".join('"' + str(r.get(name, "")).replace('"', '""') + '"' for name, _, _ in readers.DOCUMENT_COLUMNS) + ",x")
    path.write_text("﻿" + "\n".join(lines), encoding="utf-8")


def sample(k):
    change = f" Bãi bỏ toàn bộ Quyết định số 01/2026/QĐ-UBND." if k == 3 else ""
    return {
        "ID": f"sample-00{k}", "Title": "  Văn   bản mẫu  ", "Số hiệu": f"0{k}/2026/QĐ-UBND", "Cơ quan ban hành": "Cơ quan mẫu", "Ngày ban hành": "01/02/2026", "Ngày hết hiệu lực": "--",
        "Toàn văn": f"Căn cứ Luật số 29/2013/QH13. Điều 1. Quy định quản lý nhiệm vụ khoa học.{change} Điều 2. Tổ chức thực hiện nhiệm vụ khoa học.",
    }


def test_csv(spark, tmp_path):
    long = {**sample(1), "Toàn văn": "Nội dung\n" * 20_000}
    write_documents(tmp_path / "d.csv", [long, sample(2)])
    got = readers.documents_csv(spark, str(tmp_path / "d.csv")).orderBy("id").collect()
    assert got[0].title == "Văn bản mẫu" and got[0].issued_date == "2026-02-01" and got[0].expiry_date == "" and len(got[0].full_text) > 100_000 and len(got) == 2
    (tmp_path / "bad.csv").write_text("ID,Title\n1,x\n")
    with pytest.raises(ValueError, match="missing required columns"):
        readers.documents_csv(spark, str(tmp_path / "bad.csv"))
    write_documents(tmp_path / "blank.csv", [{**sample(1), "ID": " "}])
    with pytest.raises(Exception, match="no ID"):
        readers.documents_csv(spark, str(tmp_path / "blank.csv")).collect()


def test_dataset(spark, tmp_path):
    write_documents(tmp_path / "departments/a.csv", [sample(1)])
    write_documents(tmp_path / "departments/b.csv", [sample(2)])
    (tmp_path / "contexts").mkdir()
    (tmp_path / "contexts/c1.json").write_text(json.dumps({"name": "Tên", "passage": "Nội  dung"}))
    (tmp_path / "matches.jsonl").write_text(json.dumps({"source": "ViLegalExperts", "output_file": "out/c1.json", "law_id": "5/2020/NĐ-CP"}) + "\n" + json.dumps({"source": "x", "output_file": "c2.json", "law_id": "1"}))
    (tmp_path / "metadata_matches.jsonl").write_text(json.dumps({"context_file": "c1.json", "law_id": "5/2020/NĐ-CP", "example_metadata": {"agency": "Bộ"}}))
    got = {r.id: r for r in readers.documents_dataset(spark, str(tmp_path)).collect()}
    assert set(got) == {"sample-001", "sample-002", "vilegal:c1"} and got["vilegal:c1"].number == "5/2020/NĐ-CP" and got["vilegal:c1"].agency == "Bộ" and got["vilegal:c1"].full_text == "Nội dung"
    write_documents(tmp_path / "departments/c.csv", [sample(2)])
    with pytest.raises(ValueError, match="duplicate"):
        readers.documents_dataset(spark, str(tmp_path))


def test_evaluation_and_corpus(spark, tmp_path):
    (tmp_path / "e.csv").write_text('qid,question,relevant_aids\n1,Câu hỏi,"[""5"", ""5"", ""6""]"\n')
    assert readers.evaluation_csv(spark, str(tmp_path / "e.csv")).first().gold == ["5", "6"]
    (tmp_path / "f.csv").write_text('qid,question,relevant_aids\n1,x,"[]"\n')
    with pytest.raises(ValueError):
        readers.evaluation_csv(spark, str(tmp_path / "f.csv"))
    text = "[{'aid': 1, 'content_Article': 'Một “hai”'} {'aid': 2, 'content_Article': 'Ba'}]"
    df = spark.createDataFrame([("l", text)], "law_id string, content string")
    assert [(r.aid, r.content) for r in readers.corpus(df).collect()] == [("1", 'Một"hai"'), ("2", "Ba")]
    assert readers.aid_laws(df).count() == 2
    with pytest.raises(Exception, match="unreadable"):
        readers.corpus(df.withColumn("content", F.concat("content", F.lit(" MISSING")))).collect()
    with pytest.raises(ValueError, match="duplicate article ids: 1, 2"):
        readers.corpus(df.unionByName(df))
    with pytest.raises(ValueError, match="empty"):
        readers.corpus(df.limit(0))


def test_written_objects():
    assert readers.written_objects(r"""[{"aid": 7, 'content_Article': "a 'b' \"c\" \n\d"}, ]""") == [("7", "a 'b' \"c\" \n\\d")]
    for wrong in ("[{'aid': 1}]", "[{'aid': 'x', 'content_Article': 'y'}]", "[{'id': 1, 'content_Article': 'y'}]", "[{'aid': 1, 'content_Article': 'y}]", "[x]"):
        with pytest.raises(ValueError):
            readers.written_objects(wrong)


def test_laws_of_articles_are_total(spark):
    laws = spark.createDataFrame([("1", "l1"), ("1", "l1"), ("2", "l2"), ("2", "l3")], "aid string, law_id string")
    wanted = spark.createDataFrame([("1",), ("2",), ("3",)], "aid string")
    assert readers.require_laws(wanted.where("aid = '1'"), laws).first().law_id == "l1"
    for aid, said in (("2", "several laws for 2"), ("3", "no law for 3")):
        with pytest.raises(Exception, match=said):
            readers.require_laws(wanted.where(F.col("aid") == aid), laws).collect()
    tags = spark.createDataFrame([("Cơ cấu tổ chức của Sở?",), ("Phí bao nhiêu?",), (None,)], "q string").select(readers.organisation_question("q").alias("t"))
    assert [r.t for r in tags.collect()] == [True, False, False]


def test_corpus_fields(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.csv").write_text("t,u\nmột,\nhai,ba\n")
    assert readers.corpus_fields(spark, str(tmp_path), ["t", "u"]).count() == 3


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    store.write("t", df)
    with pytest.raises(FileExistsError):
        store.write("t", df, recreate=False)
    store.write("t", sinks.upsert(store.read("t"), spark.createDataFrame([("a", 2), ("b", 3)], "id string, n int"), "id"))
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 2), ("b", 3)]
    store.reset("t")
    assert not store.exists("t")


def test_relations_are_guarded_and_invalidated(spark):
    new = spark.createDataFrame([("d3", "d1", "CITES", "c3"), ("d3", "d2", "CITES", "c3"), ("d3", "d1", "CITES", "c9")], "source_id string, target_id string, kind string, source_chunk_id string")
    chunks = spark.createDataFrame([("c3", "d3")], "id string, document_id string")
    ready = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "document_id string")
    owners = spark.createDataFrame([("n1", "d1"), ("n2", "d2"), ("n2", "d4")], "number_norm string, document_id string")
    got = sinks.merge_relations(None, new, chunks, ready, owners)
    assert [(r.source_id, r.target_id) for r in got.collect()] == [("d3", "d1")]
    again = sinks.merge_relations(got, new, chunks, ready, owners)
    assert again.count() == 1
    for gone in ("d1", "d3"):
        assert sinks.invalidate({"relations": again}, spark.createDataFrame([(gone,)], "document_id string"))["relations"].count() == 0


def test_structure_changes(spark):
    schema = "id string, document_id string, parent_id string, level string, label string, text string"
    old = spark.createDataFrame([("d:1", "d", "d", "Article", "Điều 1", "x"), ("e:1", "e", "e", "Article", "Điều 1", "y")], schema)
    new = old.withColumn("text", F.when(F.col("id") == "e:1", "z").otherwise(F.col("text")))
    merged, changed = sinks.merge_structure(old, new)
    assert [r.document_id for r in changed.collect()] == ["e"] and merged.count() == 2


def test_cache_and_concepts(spark):
    requests = spark.createDataFrame([("a",), ("a",), ("b",)], "request string")
    cache = sinks.missing_responses(requests.where("request = 'a'"), None)
    assert [r.request for r in sinks.missing_responses(requests, cache).collect()] == ["b"]
    chunks = spark.createDataFrame([("c", "d", "Doanh nghiệp nhỏ")], "id string, document_id string, body string")
    proposals = spark.createDataFrame([("d", "c", "Doanh nghiệp", "me"), ("d", "c", "khác", "me"), ("d", "c", "nhỏ", "")], "document_id string, source_chunk_id string, phrase string, reviewed_by string")
    assert [r.name for r in sinks.reviewed_concepts(proposals, chunks).collect()] == ["Doanh nghiệp"]


def test_snapshot_is_checked(spark):
    documents = spark.createDataFrame([("d", "t")], "id string, title string")
    chunks = spark.createDataFrame([("c", "d")], "id string, document_id string")
    relations = spark.createDataFrame([], "source_id string, target_id string, kind string")
    post = spark.createDataFrame([("c", "x", 1)], "id string, term string, tf int")
    assert set(sinks.snapshot_tables(documents, chunks, relations, post)) == {"documents", "chunks", "relations", "postings"}
    with pytest.raises(ValueError):
        sinks.snapshot_tables(documents.limit(0), chunks, relations, post)


def test_ingest_is_idempotent_and_repairs(spark, tmp_path):
    write_documents(tmp_path / "d.csv", [sample(1), sample(2), sample(3)])
    documents = readers.documents_csv(spark, str(tmp_path / "d.csv"))
    store = sinks.Store(spark, str(tmp_path / "store"))
    settings = Settings(chunk_chars=400, chunk_overlap=40)
    assert ingest.run(spark, store, documents, settings) == 3
    assert store.read("chunks").count() == 9 and ingest.run(spark, store, documents, settings) == 0
    store.write("chunks", store.read("chunks").where("NOT (document_id = 'sample-002' AND chunk_index = 1)"))
    assert ingest.run(spark, store, documents, settings) == 1 and store.read("chunks").count() == 9
    changed = documents.withColumn("title", F.when(F.col("id") == "sample-001", "Khác").otherwise(F.col("title")))
    assert [r.id for r in ingest.stale(changed, store.read("state"), settings).collect()] == ["sample-001"]
    assert ingest.run(spark, store, changed, settings) == 1 and store.read("state").count() == 3


def test_stream(spark, tmp_path):
    write_documents(tmp_path / "d.csv", [sample(1), sample(2)])
    documents = readers.documents_csv(spark, str(tmp_path / "d.csv"))
    documents.write.parquet(str(tmp_path / "in"))
    store = sinks.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        query = ingest.stream(spark, str(tmp_path / "in"), documents.schema.simpleString()[7:-1].replace(":", " "), store, str(tmp_path / "ck"))
        query.awaitTermination(120)
    assert store.read("state").count() == 2
