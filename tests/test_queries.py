from datetime import datetime

import pytest

from dossier import queries


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def write(spark, folder, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_hybrid_finds_every_document(spark, tmp_path):
    ids = [0, 100, 250, 500, 600, 1001]
    folder = write(
        spark, tmp_path, documents=([(i, f"chung riêng{i}") for i in ids], "doc_id bigint, text string"),
        embeddings=([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>"),
    )
    got = queries.q_hybrid(spark, folder)
    asked = [0, 100, 500, 600]
    assert rows(got, "query_id", "id") == [(q, i) for q in asked for i in ids]


def test_retrieve_follows_relations_to_their_evidence(spark, tmp_path):
    header = "Tên\nSố hiệu: x\nMục: y\n"
    chunks = [("100:0", "100", header + "Văn bản hỏi"), ("7:0", "7", header + "Không nói gì"), ("7:1", "7", header + "Bãi bỏ 5/2020/QĐ-A"), *((f"{k}:0", f"{k}", header + f"Khác {k}") for k in range(11, 60))]
    documents = [("100", "5/2020/QĐ-A", None, None), ("7", "6/2020/QĐ-A", None, None)]
    folder = write(
        spark, tmp_path, document_chunk=(chunks, "id string, document_id string, text string"), legal_document=(documents, "id string, number string, agency string, signer string"),
        embeddings=([(0, [1.0, 0.5])], "vec_id bigint, embedding array<float>"),
        mention=([("7", "5/2020/QĐ-A", "5/2020/QĐ-A", ["cites", "repeals"], datetime(2025, 1, 1))], "document_id string, number string, number_norm string, kinds array<string>, extracted_at timestamp"),
    )
    got = queries.q_retrieve(spark, folder)
    # All chunks of documents divisible by 100 ask; evidence comes first.
    assert rows(got.select("query_id").distinct(), "query_id") == [("100:0",)]
    assert rows(got.where("place = 1"), "id") == [("7:1",)]


def test_budget_goes_on_behind_many_rows_that_do_not_fit(spark, tmp_path):
    sizes = [17_000, *[2_000] * 80, 900]
    folder = write(spark, tmp_path, documents=([(k, "s", f"l{k}", n) for k, n in enumerate(sizes)], "doc_id bigint, source string, law_id string, n_chars bigint"))
    assert rows(queries.q_budget_select(spark, folder), "place", "id") == [(1, "0"), (2, "81")]


def test_bootstrap_takes_all_orders(spark, tmp_path):
    folder = write(spark, tmp_path, orders=([(k, 150_000.0 + k) for k in range(1, 401)], "o_orderkey bigint, o_totalprice double"))
    got = queries.q_bootstrap(spark, folder).first()
    # 2,000 draws: the bounds of the normal approximation, 115.5 / sqrt(400) = 5.77 a standard error.
    assert got["mean"] == 200.5 and got.lower == pytest.approx(200.5 - 1.96 * 5.77, abs=1.2) and got.upper == pytest.approx(200.5 + 1.96 * 5.77, abs=1.2)


def test_shortlist_has_candidates_that_only_vectors_find(spark, tmp_path):
    at = datetime(2025, 1, 1)
    documents = [(i, i, "văn bản", None, None, at) for i in ("3", "4", "5", "x")]
    folder = write(
        spark, tmp_path, legal_document=(documents, "id string, number string, full_text string, agency string, signer string, loaded_at timestamp"),
        mention=([], "document_id string, number_norm string"),
        # The vector of a document is that of its number's rest: "3" and "x" have the first one.
        embeddings=([(0, [1.0, 0.0]), (1, [1.0, 0.2]), (2, [-1.0, 0.0])], "vec_id bigint, embedding array<float>"),
    )
    got = queries.q_candidate_shortlist(spark, folder)
    assert rows(got.where("place = 1"), "source_id", "target_id") == [("3", "x"), ("4", "3"), ("5", "4"), ("x", "3")]
