"""Problem 4: visually identical text with different characters.

DuckDB runs inside each Arrow batch; the whole rule is one SQL expression of
``nfc_normalize``, ``translate`` and regular expressions.  There is no shuffle:
each batch is normalised where it was read.

Defined results: a null text stays null and counts as unchanged, an empty text
stays empty; repeated rows are each answered; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import textform
from dossier.plans.shared import table


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(chars)) + "]"


def form_sql(text: str) -> str:
    """SQL expression of DuckDB for the consistent form of the expression ``text``."""
    single, mixed = textform.single_map(), textform.mixed_map()
    gone = _class(c for c, to in single.items() if not to)
    one = {c: to for c, to in single.items() if len(to) == 1}
    many = {c: to for c, to in single.items() if len(to) > 1}
    drawn = f"translate(regexp_replace({text}, '{gone}', '', 'g'), {_quote(''.join(one))}, {_quote(''.join(one.values()))})"
    wide = "d0"
    for c, to in many.items():
        wide = f"replace({wide}, {_quote(c)}, {_quote(to)})"
    drawn = f"list_transform([{drawn}], lambda d0: CASE WHEN regexp_matches(d0, '{_class(many)}') THEN {wide} ELSE d0 END)[1]"
    run = textform.WORD_RUN[1:-2]
    look = _class(mixed)
    words = (
        f"array_to_string(list_transform(regexp_extract_all(d1, '[{run}]+|[^{run}]+'), lambda w: "
        f"CASE WHEN regexp_matches(w, '{look}') AND regexp_matches(w, '{textform.LATIN}') "
        f"THEN translate(w, {_quote(''.join(mixed))}, {_quote(''.join(mixed.values()))}) ELSE w END), '')"
    )
    formed = f"list_transform([{drawn}], lambda d1: nfc_normalize(CASE WHEN regexp_matches(d1, '{look}') THEN {words} ELSE d1 END))[1]"
    safe = textform.safe_class("\\x{{{:X}}}")
    return f"CASE WHEN regexp_matches({text}, '[^{safe}]') THEN {formed} ELSE {text} END"


def _batches(names: list[str], keep_text: bool, form: str):
    columns = ", ".join(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1})
        out = f"{columns}, form" if keep_text else columns
        where = "" if keep_text else "WHERE form <> text"
        for batch in batches:
            if batch.num_rows:
                con.register("batch", pa.Table.from_batches([batch]))
                got = con.sql(f"SELECT {out} FROM (SELECT *, {form} AS form FROM batch) {where}").to_arrow_table()
                con.unregister("batch")
                yield from got.to_batches()

    return run


def consistent_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, form): the consistent form of each row's text."""
    df = df.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    return df.mapInArrow(_batches(["item_id"], True, form_sql("text")), "item_id string, form string")


def changed_items(df: DataFrame, table_name: str, id_col: str, text_col: str) -> DataFrame:
    """(table_name, item_id) of the items whose text differs from its consistent form, each once."""
    df = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    df = df.select(F.lit(table_name).alias("table_name"), F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    found = df.mapInArrow(_batches(["table_name", "item_id"], False, form_sql("text")), "table_name string, item_id string")
    return found.distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = changed_items(table(spark, sf_dir, "legal_document"), "legal_document", "id", "full_text")
    return documents.unionByName(changed_items(table(spark, sf_dir, "provision"), "provision", "id", "text"))


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every text of both tables, repeated rows included."""
    forms = consistent_texts(table(spark, sf_dir, "legal_document"), "id", "full_text").withColumn("table_name", F.lit("legal_document"))
    other = consistent_texts(table(spark, sf_dir, "provision"), "id", "text").withColumn("table_name", F.lit("provision"))
    return forms.unionByName(other).select("table_name", "item_id", "form")
