"""Own small texts; expected values follow from the written rules of sections, windows, hierarchy and references."""

import random
import re

import pytest

from dossier.operators import chunking as C
from dossier.operators import graph, validate


def labels(text):
    return [label for label, _ in C.sections(text)]


def test_sections():
    assert labels("Xét đề nghị của Sở. Điều 3. Chợ được mở hằng ngày. Điều 4: Phí vào chợ.") == ["Phần mở đầu", "Điều 3", "Điều 4"]
    assert labels("Theo Điều 7 Nghị định 5/2021/NĐ-CP thì đóng cửa. Điều 1. Chợ.") == ["Phần mở đầu", "Điều 1"]
    assert labels("Điều   8a . Chợ") == ["Điều 8a"]
    assert C.sections("không có mục") == [("Toàn văn", "không có mục")] and C.sections("") == [("Toàn văn", "")]


def test_headings_behind_titles():
    assert labels("Điều 4. Bến xe. Mục 3 BẾN THUYỀN VÀ CẦU Điều 5. Giờ mở. Điều 6. Giá vé.") == ["Điều 4", "Điều 5", "Điều 6"]
    assert labels("Mục 3 Bến thuyền Điều 5. Giờ mở.") == ["Toàn văn"]
    assert labels("Chương II Điều 5. Giờ mở. theo Điều 6 đã nêu.") == ["Phần mở đầu", "Điều 5"]


def simple_windows(text, size, overlap):
    """The rule written out step by step, for comparison."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while True:
        limit = min(start + size, len(text))
        ends = [m.end() for m in re.finditer(r"[.;!?](?:\s+|$)", text[start:limit]) if m.end() >= int(size * 0.6)] if limit < len(text) else []
        end = start + ends[-1] if ends else limit
        out.append(text[start:end].strip())
        if end == len(text):
            return [w for w in out if w]
        wanted = max(start + 1, end - overlap)
        start = next((k for k in range(wanted, end) if text[k].isspace()), wanted)


def test_windows_follow_the_rule():
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("ab. ;\n!x") for _ in range(rng.randint(0, 160)))
        size = rng.randint(5, 50)
        overlap = rng.randint(0, size - 1)
        assert C.windows(text, size, overlap) == simple_windows(text, size, overlap)
    assert "".join(C.windows("y" * 700, 90, 0)) == "y" * 700


def test_chunks():
    made = C.chunks("v9", "Tên", "2/2020", "Điều 2. " + "Thuyền neo ở bến phía đông. " * 70, 400, 50)
    assert len(made) > 3 and {c[3] for c in made} == {"Điều 2"} and [c[0] for c in made] == [f"v9:{k}" for k in range(len(made))]
    assert all(len(c[4]) <= 400 and c[4] == c[4].strip() and c[4].startswith("Tên\nSố hiệu: 2/2020\nMục: Điều 2\n") for c in made)
    assert [c[4] for c in C.chunks("v", "", "7", "", 300, 10)] == ["Số hiệu: 7\nMục: Toàn văn"]
    for size, overlap in ((0, 0), (50, 50), (50, -1)):
        with pytest.raises(ValueError):
            C.chunks("v", "", "", "x", size, overlap)


def test_hierarchy():
    text = "Chương iv. Điều 2. Bến. 1. Neo thuyền; a) Dây dài. B) Không. Điều 3. Phí."
    rows = {r[0]: r for r in C.structure("v", text)}
    assert set(rows) == {"v:chapter:IV:1", "v:article:2", "v:article:3", "v:article:2:clause:1", "v:article:2:clause:1:point:a"}
    assert {r[2] for r in rows.values() if r[3] == "Article"} == {"v:chapter:IV:1"} and rows["v:chapter:IV:1"][4] == "Chương iv"
    clause, point = rows["v:article:2:clause:1"], rows["v:article:2:clause:1:point:a"]
    assert clause[2] == "v:article:2" and clause[5].startswith("1. Neo") and text[clause[6]] == " "
    assert point[2] == clause[0] and point[5] == "a) Dây dài. B) Không."


def test_repeated_articles_are_all_told_apart():
    rows = C.structure("v", "Điều 5. Một bến. Điều 5. Phụ lục kèm theo. Điều 6. Khác.")
    assert [r[0] for r in rows] == ["v:article:5:occurrence:1", "v:article:5:occurrence:2", "v:article:6"]


def test_chapters_inside_sentences_and_repeated_numbers():
    rows = C.structure("v", "Chương 1. Điều 2. Làm theo Chương 9 đã nêu. Điều 3. Phí. Chương 1. Điều 4. Hết.")
    assert [(r[0], r[2]) for r in rows if r[3] == "Article"] == [("v:article:2", "v:chapter:1:1"), ("v:article:3", "v:chapter:1:1"), ("v:article:4", "v:chapter:1:2")]
    assert not [r for r in C.structure("v", "Điều 1. Bến. 1. Một. 1. Hai.") if r[3] == "Clause"]
    assert not [r for r in C.structure("v", "Điều 1. Bến. 1. Một; a) x; a) y. 2. Hai.") if r[3] == "Point"]


def test_structure_slices():
    text = "Mở đầu. Chương I. Điều 1. Một. 1. Hai. 2. Ba; a) Bốn; b) Năm. Điều 2. Sáu.  "
    assert all(text[r[6] : r[7]].strip() == r[5].strip() for r in C.structure("d", text))


def test_references():
    text = "Theo Luật số 3/2015/QH12, bãi bỏ Thông tư 7/2011/TT-BX. Xem thêm 7/2011/TT-BX và 9/2022/QĐ-X."
    found = list(C.references(text, " 9/2022/qđ-x."))
    assert {n for n, *_ in found} == {"3/2015/QH12", "7/2011/TT-BX"} and all(text[a:b] == t for _, a, b, t, _ in found)
    assert not list(C.references("Ký ngày 03/04/2025."))
    assert C.normal_number("7/2011/QĐ-X") == C.normal_number("7/2011/QD̵-x".replace("D̵", "Đ")) and C.normal_number("1/Á") == C.normal_number("1/Á")


def test_mentions(spark):
    text = "Theo Luật số 3/2015/QH12. " + "y" * 200 + " Bãi bỏ Thông tư 7/2011/TT-BX. Thông tư 7/2011/TT-BX nữa. Nghị định 1/2000/NĐ-CP."
    df = spark.createDataFrame([("d", text, None, "clash"), ("e", None, "1", "clash")], "id string, full_text string, number string, kinds string")
    got = {r.number_norm: r for r in C.mentions(df).collect()}
    assert got["7/2011/TT-BX"].mention_count == 2 and "repeals" in got["7/2011/TT-BX"].kinds and got["3/2015/QH12"].kinds == ["cites"] and len(got) == 3
    # Reading stops where the second number is first met.
    assert {(r.number_norm, r.mention_count) for r in C.mentions(df, 2).collect()} == {("3/2015/QH12", 1), ("7/2011/TT-BX", 1)}


def test_cited_articles():
    said = C.cited_articles("c", "d", "Bỏ Điều 2 của Luật này và Điều 3 đã nêu; giữ Điều 4 Thông tư này. Theo Điều 5, Điều 6 Luật 3/2015/QH12. Điều 7 Luật 3/2015/QH12 và 4/2016/QH12.")
    assert [(number, article, place) for _, _, number, article, _, place in said] == [("", "2", 0), ("", "4", 1), ("3/2015/QH12", "5", 2), ("3/2015/QH12", "6", 2)]


def test_article_citations(spark):
    texts = {
        "a": "Điều 1. Bỏ Điều 2 của Quyết định này. Sửa Điều 2 của Quyết định này. Điều 2. Bến thuyền phía đông.",
        "b": "Điều 1. Theo Điều 2 của Luật Bến. Theo Điều 2 Quyết định 1/2026/QĐ-A. Điều 2. Khác.",
        "c": "Điều 1. Một. Điều 1. Hai. Theo Điều 9 của Luật này.",
    }
    numbers = {"a": "1/2026/QĐ-A", "b": "2/2026/QĐ-B", "c": None}
    df = spark.createDataFrame([(k, "T", numbers[k], t, None, None, None) for k, t in texts.items()], "id string, title string, number string, full_text string, effective_date string, expiry_date string, status string")
    chunks, provisions = C.chunk_documents(df), C.parse_structure(df)
    mapping = C.map_chunks(provisions, chunks)
    assert not [r for r in mapping.collect() if r.chunk_id.startswith("c:")]
    owners = graph.unique_owners(spark.createDataFrame([(numbers[k], k) for k in "ab"], "number_norm string, document_id string"))
    proposed = C.article_citations(chunks, mapping, owners)
    got = {(r.source_id, r.target_id): r for r in proposed.collect()}
    assert set(got) == {("a:article:1", "a:article:2"), ("b:article:1", "a:article:2")}
    # The last sentence of the chunk is the evidence.
    assert got["a:article:1", "a:article:2"].evidence == "Sửa Điều 2 của Quyết định này." and got["b:article:1", "a:article:2"].target_evidence.startswith("Điều 2. Bến")
    kept = validate.article_relations(proposed.withColumn("bridge", validate.no_bridge()), chunks, mapping, df, owners)
    assert {(r.source_id, r.target_id) for r in kept.collect()} == set(got)


@pytest.mark.parametrize("make", [C.parse_structure, C.chunk_documents, C.mentions])
def test_empty_tables(spark, make):
    assert make(spark.createDataFrame([], "id string, title string, number string, full_text string")).count() == 0
