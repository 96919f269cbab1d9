import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.functions import textform
from dossier.functions.textform import consistent_form, is_plain, number_key
from dossier.plans.settings import Expansion, Settings


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value, expected", [("  Văn   bản mẫu  ", "Văn bản mẫu"), ("a \n b", "a b"), (None, "")])
def test_text(spark, value, expected):
    assert one(spark, X.text(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("value, expected", [("--", ""), ("N/A", ""), (" Null ", ""), ("x", "x"), (None, "")])
def test_optional(spark, value, expected):
    assert one(spark, X.optional(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize("value, expected", [("01/02/2026", "2026-02-01"), ("1/2/2026", "2026-02-01"), ("2026-2-1", "2026-02-01"), ("31/02/2026", "31/02/2026"), ("1/2/26", "1/2/26"), ("--", "")])
def test_date(spark, value, expected):
    assert one(spark, X.date(F.lit(value))) == expected


@pytest.mark.parametrize("value, expected", [("2026-01-02", "2026-01-02"), ("2026", ""), ("2026-02-31", ""), (None, "")])
def test_iso_date(spark, value, expected):
    assert one(spark, X.iso_date(F.lit(value).cast("string"))) == expected


def test_number_norm(spark):
    assert one(spark, X.number_norm(F.lit(" 46 / 2008 / qđ - ubnd "))) == "46/2008/QĐ-UBND"


def test_entity_key_and_point_id(spark):
    assert one(spark, X.entity_key(F.lit("  Bộ  Y TẾ "))) == "bộ y tế"
    assert one(spark, X.point_id(F.lit("d:0"))) == one(spark, X.point_id(F.lit("d:0")))


def test_chunk_body(spark):
    assert one(spark, X.chunk_body(F.lit("T\nSố hiệu: 1\nMục: Điều 1\nNội dung\nSố hiệu: 2"))) == "Nội dung\nSố hiệu: 2"


def test_article_id(spark):
    assert one(spark, X.article_id(F.lit("d"), F.lit("Điều 12A"))) == "d:article:12a"
    assert one(spark, X.article_id(F.lit("d"), F.lit("Phần mở đầu"))) == ""


@pytest.mark.parametrize(
    "raw, good",
    [('{"a": 1}', True), ('text\n```json\n{"a": 1}\n```', True), ('```json\n{"a": 1}\n``` more', False), ('```json\n{"a": 1}', False), ('```\n{}\n```\n```\n{}\n```', False), ("text", False)],
)
def test_model_json(spark, raw, good):
    assert (one(spark, X.model_json(F.lit(raw))) is not None) == good


def test_ngrams_stay_within_fields(spark):
    assert one(spark, X.ngrams(F.lit("Một hai, ba-bốn"), 2)) == ["một hai", "hai ba-bốn"]
    assert one(spark, X.ngrams(F.lit("một"), 2)) == []


def test_condition(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, s string")
    assert [r.n for r in df.where(X.condition({"must_not": [{"key": "s", "match": "a"}]})).orderBy("n").collect()] == [2, 3]
    assert [r.n for r in df.where(X.condition({"should": [{"key": "s", "any": ["b"]}, {"key": "n", "lte": 1}]})).orderBy("n").collect()] == [1, 3]
    with pytest.raises(ValueError):
        X.condition({"must": [{"key": "s"}]})
    assert df.where(X.filters(s="", n=None)).count() == 3


def test_merge_json_right_wins(spark):
    assert '"a":"2"' in one(spark, X.merge_json(F.lit('{"a":"1","b":"1"}'), F.lit('{"a":"2"}')))


@pytest.mark.parametrize(
    "text, form",
    [
        ("vό̛і", "với"), ("(“Рассвет полей”)", "(“Рассвет полей”)"), ("hệ số α.", "hệ số α."), ("25 m² – 3", "25 m² – 3"), ("Chương Ⅱ.", "Chương II."),
        ("１８/２００７/ＱＨ３８", "18/2007/QH38"), ("đɑ̂̀u", "đầu"), ("a  b​", "a  b"), ("NĐ‑CP", "NĐ-CP"), ("ðồng Ðiều Ɖơn", "đồng Điều Đơn"), ("", ""), ("\u0000x", "x"),
    ],
)
def test_consistent_form(text, form):
    assert consistent_form(text) == form
    assert consistent_form(form) == form


def test_consistent_form_of_null_and_long():
    assert consistent_form(None) is None
    assert consistent_form("vі " * 100_000) == "vi " * 100_000


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_form_is_stable_and_plain_is_unchanged(text):
    form = consistent_form(text)
    assert consistent_form(form) == form
    if is_plain(text):
        assert form == text


def test_number_key():
    assert number_key(" (18 / 2007 / qh38. ") == number_key("１８/２００７/ＱＨ３８") == "18/2007/QH38"
    assert number_key("26/2021/QĐ–UBND") == "26/2021/QĐ-UBND"
    assert number_key(" ") == "" and number_key(None) is None


@pytest.mark.parametrize("wrong", [{"mode": "M5"}, {"depth": 0}, {"depth": 5}, {"confidence": 1.5}, {"decay": float("nan")}, {"hybrid_pool": 1}, {"context_chars": 0}, {"seed_limit": 0}, {"scoring": "x"}])
def test_expansion_is_checked(wrong):
    with pytest.raises(ValueError):
        Expansion(**wrong)


def test_settings(tmp_path):
    (tmp_path / "env").write_text("CHUNK_CHARS=900\nTOP_K=3\n")
    assert Settings.read(str(tmp_path / "env"), {"TOP_K": "4"}) == Settings(chunk_chars=900, top_k=4)
    with pytest.raises(ValueError):
        Settings(chunk_overlap=5000)
    assert Expansion(mode="M0").kinds == [] and "CITES" in Expansion(mode="M2").kinds and not Expansion(mode="M3").structural


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab іоạ́̂\u200b\u00a0１Ⅱ\n가\u1100\u1161ΑL\ud800é😀", max_size=160), max_size=4))
def test_forms_around_odd_characters_equal_whole_forms(texts):
    expected = [textform._whole_form(t) for t in texts]
    assert [textform.consistent_form(t) for t in texts] == expected == textform.consistent_forms(texts)


def test_forms_of_lists():
    assert textform.consistent_forms([]) == [] and textform.consistent_forms([None, "", "ａ"]) == [None, "", "a"]
