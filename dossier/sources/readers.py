"""Sources: document CSV files, JSON and JSONL contexts, evaluation sets, corpora, snapshots, catalogs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.plans.shared import cut

# Columns of a document CSV, the field each becomes, and how it is normalised.
DOCUMENT_COLUMNS = (
    ("ID", "id", X.text), ("Title", "title", X.text), ("Toàn văn", "full_text", X.text), ("Số hiệu", "number", X.text),
    ("Loại văn bản", "document_type", X.text), ("Ngành", "sector", X.text), ("Ngày ban hành", "issued_date", X.date), ("Lĩnh vực", "field", X.text),
    ("Ngày có hiệu lực", "effective_date", X.date), ("Tình trạng hiệu lực", "status", X.text), ("Ngày hết hiệu lực", "expiry_date", X.date),
    ("Cơ quan ban hành", "agency", X.optional), ("Chức danh", "signer_position", X.optional), ("Người ký", "signer", X.optional),
)
FIELDS = tuple(field for _, field, _ in DOCUMENT_COLUMNS)
CSV = {"header": True, "multiLine": True, "escape": '"', "maxCharsPerColumn": -1, "encoding": "UTF-8"}


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")


def _csv(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    df = spark.read.options(**(CSV | options)).csv(paths)
    return df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})


def documents_csv(spark: SparkSession, paths: list[str] | str, limit: int | None = None) -> DataFrame:
    """Normalised documents; a blank id is an error when its row is read; extra columns are dropped."""
    raw = _csv(spark, paths)
    require_columns(raw, (name for name, _, _ in DOCUMENT_COLUMNS))
    raw = raw if limit is None else raw.limit(limit)
    df = raw.select(*(make(F.col(f"`{name}`")).alias(field) for name, field, make in DOCUMENT_COLUMNS))
    return df.withColumn("id", F.when(F.col("id") != "", F.col("id")).otherwise(F.raise_error(F.lit("a document has no ID"))))


def duplicate_ids(documents: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of the ids that several rows have."""
    return documents.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def documents_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files under ``folder/departments`` and the JSON contexts beside them; an id in two rows is an error."""
    documents = documents_csv(spark, f"{folder}/departments/*.csv")
    contexts = f"{folder}/contexts"
    path = spark._jvm.org.apache.hadoop.fs.Path(contexts)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        documents = documents.unionByName(context_documents(spark, folder))
    again = duplicate_ids(documents).limit(5).collect()
    if again:
        raise ValueError(f"duplicate ids: {', '.join(r['id'] for r in again)}")
    return documents


def matches(spark: SparkSession, folder: str, source: str = "ViLegalExperts") -> DataFrame:
    """(context_file, law_id) of each context that has exactly one law; several are an error."""
    rows = spark.read.schema("source string, output_file string, law_id string").json(f"{folder}/matches.jsonl").where(F.col("source") == source)
    rows = rows.select(F.element_at(F.split("output_file", "/"), -1).alias("context_file"), "law_id")
    laws = rows.groupBy("context_file").agg(F.countDistinct("law_id").alias("n"), F.min("law_id").alias("law_id"))
    return laws.withColumn("law_id", F.when(F.col("n") == 1, F.col("law_id")).otherwise(F.raise_error(F.concat(F.lit("several laws for "), "context_file")))).drop("n")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(context_file, law_id, example_metadata): the last line for each key."""
    schema = "context_file string, law_id string, example_metadata map<string,string>"
    rows = spark.read.schema(schema).json(f"{folder}/metadata_matches.jsonl").select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    return rows.groupBy("context_file", "law_id").agg(F.max_by("example_metadata", "at").alias("example_metadata"))


def context_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of ``contexts/*.json`` that have a law, with metadata where there is some; the id is ``vilegal:`` and the file's stem."""
    raw = spark.read.option("wholetext", True).text(f"{folder}/contexts/*.json").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("context_file"), "value")
    parsed = raw.withColumn("x", F.from_json("value", "name string, passage string"))
    joined = parsed.join(matches(spark, folder), "context_file").join(metadata(spark, folder), ["context_file", "law_id"], "left")
    known = lambda name: F.coalesce(F.col("example_metadata")[name], F.lit(""))
    own = {"id": F.concat(F.lit("vilegal:"), F.regexp_replace("context_file", r"\.json$", "")), "title": X.text("x.name"), "full_text": X.text("x.passage"), "number": X.text("law_id")}
    made = {"issued_date": X.date, "effective_date": X.date, "expiry_date": X.date}
    return joined.select(*((own[f] if f in own else made.get(f, X.optional)(known(f))).alias(f) for f in FIELDS))


def evaluation_csv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, gold): distinct gold ids in order; blank questions or ids, empty gold and repeated qids are errors."""
    raw = _csv(spark, path)
    require_columns(raw, ("qid", "question"))
    name = next((c for c in ("relevant_aids", "relevant_article_ids") if c in raw.columns), None)
    if name is None:
        raise ValueError("missing required columns: relevant_aids")
    gold = F.array_distinct(F.transform(F.from_json(name, "array<string>"), F.trim))
    df = raw.select(F.trim("qid").alias("qid"), X.text("question").alias("question"), gold.alias("gold"))
    bad = F.col("gold").isNull() | (F.size("gold") == 0) | F.exists("gold", lambda g: g.isNull() | g.isin("", "true", "false")) | (F.col("question") == "")
    wrong = df.agg(F.count_if(bad).alias("bad"), (F.count(F.lit(1)) - F.countDistinct("qid")).alias("again")).first()
    if wrong["bad"] or wrong["again"]:
        raise ValueError(f"{wrong['bad']} unusable and {wrong['again']} repeated questions")
    return df


ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _quoted(text: str, at: int) -> tuple[str, int]:
    """The string that a quote at ``at`` begins, without its escapes, and the place behind it."""
    quote, out = text[at], []
    at += 1
    while at < len(text) and text[at] != quote:
        if text[at] == "\\" and at + 1 < len(text):
            at += 1
            out.append(ESCAPES.get(text[at], text[at] if text[at] in "\\'\"" else "\\" + text[at]))
        else:
            out.append(text[at])
        at += 1
    if at >= len(text):
        raise ValueError("a string isn't closed")
    return "".join(out), at + 1


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, value) of the strings, numbers and marks of a written-out array; blanks are passed over."""
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text[at] in "'\"":
            value, at = _quoted(text, at)
            yield "string", value
        elif text[at].isdigit():
            end = at
            while end < len(text) and text[end].isdigit():
                end += 1
            yield "number", text[at:end]
            at = end
        elif text[at] in "[]{}:,":
            yield text[at], text[at]
            at += 1
        else:
            raise ValueError(f"unreadable corpus content: {text[at : at + 40]}")


# Fixed value: an object of the array, as the kinds of its tokens; the keys are named.
OBJECT, KEYS = ("{", "string", ":", "number", ",", "string", ":", "string", "}"), ("aid", "content_Article")


def written_objects(text: str) -> list[tuple[str, str]]:
    """(aid, content) of the objects of a written-out array; anything between them but brackets and commas is an error."""
    tokens, out, at = list(_tokens(text)), [], 0
    while at < len(tokens):
        if tokens[at][0] == "{":
            part = tokens[at : at + len(OBJECT)]
            if tuple(kind for kind, _ in part) != OBJECT or (part[1][1], part[5][1]) != KEYS:
                raise ValueError(f"unreadable corpus content: {''.join(v for _, v in part)[:40]}")
            out.append((part[3][1], part[7][1]))
            at += len(OBJECT)
        elif tokens[at][0] in "[],":
            at += 1
        else:
            raise ValueError(f"unreadable corpus content: {tokens[at][1][:40]}")
    return out


def corpus(df: DataFrame) -> DataFrame:
    """(law_id, aid, content) of rows whose ``content`` is an array of written-out objects.

    Anything between the objects, an aid that stands twice, and a corpus without any object are errors.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(law, aid, body) for law, text in zip(frame["law_id"], frame["content"]) for aid, body in written_objects(text or "")]
            yield pd.DataFrame(rows, columns=["law_id", "aid", "content"])

    rows = cut(df.select("law_id", "content").mapInPandas(read, "law_id string, aid string, content string"))
    again = duplicate_ids(rows, "aid").limit(5).collect()
    if again:
        raise ValueError(f"duplicate article ids: {', '.join(r['aid'] for r in again)}")
    if rows.isEmpty():
        raise ValueError("the corpus is empty")
    return rows.select("law_id", "aid", X.body_text("content").alias("content"))


def aid_laws(df: DataFrame) -> DataFrame:
    """(aid, law_id) of all article ids that stand in ``content``."""
    return df.select("law_id", F.explode(F.regexp_extract_all("content", F.lit(r"['\"]aid['\"]:\s*(\d+)"), F.lit(1))).alias("aid")).select("aid", "law_id")


def corpus_fields(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """(field, value) of the chosen non-empty columns of all CSV files under ``folder``, however deep."""
    raw = _csv(spark, folder, recursiveFileLookup=True, pathGlobFilter="*.csv")
    require_columns(raw, columns)
    long = raw.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in columns))).alias("x")).select("x.*")
    return long.where("value IS NOT NULL AND value <> ''")


def snapshot(spark: SparkSession, folder: str, schema: str, table: str) -> DataFrame:
    """A snapshot table (id, payload JSON) with its payload as columns."""
    return spark.read.parquet(f"{folder}/{table}").select("id", F.from_json("payload", schema).alias("p")).select("id", "p.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def index_hashes(state: DataFrame, ids: DataFrame) -> DataFrame:
    """(document_id, index_hash) of the documents asked for."""
    return state.join(ids.select("document_id"), "document_id", "left_semi").select("document_id", "index_hash")


def unambiguous_articles(links: DataFrame) -> DataFrame:
    """(chunk_id, article_id) of the chunks with exactly one article."""
    return links.groupBy("chunk_id").agg(F.countDistinct("article_id").alias("n"), F.min("article_id").alias("article_id")).where("n = 1").drop("n")


# Fixed value: what questions about the organisation of a body speak of.
ORGANISATION = r"vị trí và chức năng|cơ cấu tổ chức|hệ thống tổ chức|trực thuộc|nhiệm vụ và quyền hạn"


def organisation_question(question) -> Column:
    """Whether a question asks how a body is organised; false for null."""
    return F.lower(F.coalesce(F.col(question) if isinstance(question, str) else question, F.lit(""))).rlike(ORGANISATION)


def require_laws(wanted: DataFrame, laws: DataFrame, key: str = "aid") -> DataFrame:
    """``wanted`` with the law of each key; a key without one, or with several, is an error when its row is read."""
    one = laws.groupBy(key).agg(F.countDistinct("law_id").alias("__n"), F.min("law_id").alias("law_id"))
    said = F.concat(F.when(F.col("__n").isNull(), "no law for ").otherwise("several laws for "), F.col(key).cast("string"))
    return wanted.join(one, key, "left").withColumn("law_id", F.when(F.col("__n") == 1, F.col("law_id")).otherwise(F.raise_error(said))).drop("__n")
