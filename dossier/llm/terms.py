"""Problem 6: frequency of every distinct word, and the words too rare or too common.

Words are maximal runs of letters and digits of the consistent form, lower-cased.  A task reads
its texts as arrays of word hashes; DuckDB counts each slice's words and adds the slices up in a
table of the task that spills to disk beyond its memory, so a word that stands everywhere leaves
the task as one row.  The words are then partitioned by bits of their hash (recursive radix
partitioning through Spark's shuffle files on disk); a partition with more rows than LEAF_ROWS is
split by its next bits, and each leaf streams into DuckDB, which aggregates it out of core: batch
by batch into a table with a memory limit that spills to the shared folder.  Rows of a leaf that
no bits can split (one word alone) are dealt out in parts, and the sums of the parts are added
up at the end.

Within a task words are told apart by a 64-bit hash, across tasks by themselves.

Defined results: each non-null id counts once with its earliest row; null title or
text counts as empty; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.textform import consistent_form, consistent_forms
from dossier.llm.neardup import _word_table, word_hashes
from dossier.plans.shared import cut, earliest_rows, spill_folder, table

WORD = re.compile(r"[^\W_]+")
#: Texts that are read as one array, and memory of a task's tables; what exceeds it is spilled.
SLICE, MEMORY = 256, "256MB"
#: Rows that one leaf may have before it is split by further bits.
LEAF_ROWS = 1_000_000
#: Bits of the first split, of each further split, and the most that are used.
FIRST_BITS, NEXT_BITS, MOST_BITS = 5, 4, 29
#: Occurrences up to which a word is rare; share of the ids above which it is common.
RARE_COUNT, COMMON_SHARE = 2, 0.3
COUNTS = "term string, uses bigint, holders bigint"


def words_of(text: str) -> list[str]:
    """The words of a text in order."""
    return WORD.findall(consistent_form(text).lower())


@contextmanager
def _database(spill: str):
    """A DuckDB of one thread with MEMORY, which spills to an own folder in ``spill``; without one it has no limit but the leaf's size."""
    folder = os.path.join(spill, uuid.uuid4().hex) if spill else ""
    con = duckdb.connect(config={"threads": 1, "temp_directory": folder} | ({"memory_limit": MEMORY} if spill else {}))
    try:
        yield con
    finally:
        con.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _word_rows(texts: list[str]) -> tuple[str, pa.Table]:
    """The joined texts, and (h, d, a, b) of each word: its hash, its text and its place."""
    joined = "\x00".join(f or "" for f in consistent_forms(texts)).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = _word_table()[np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        inside[k] = chr(codes[k]).isalnum()
    starts, ends, hashes = word_hashes(codes, inside)
    text = np.searchsorted(np.flatnonzero(codes == 0), starts).astype(np.int32)
    return joined, pa.table({"h": hashes.view(np.int64), "d": text, "a": starts, "b": ends})


SLICE_COUNTS = """SELECT h, sum(n)::BIGINT AS uses, count(*) AS holders, min(place) AS place
    FROM (SELECT h, d, count(*) AS n, min(struct_pack(a := a, b := b)) AS place FROM words GROUP BY h, d) GROUP BY h"""


def _reduce(spill: str):
    """One row for each word of a task; a row without word holds the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database(spill) as con:
            con.execute("CREATE TABLE counted (h BIGINT, term VARCHAR, uses BIGINT, holders BIGINT)")
            number = 0
            for whole in batches:
                number += whole.num_rows
                for start in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(start, SLICE)
                    joined, words = _word_rows([f"{t or ''} {x or ''}" for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])
                    counts = con.sql(SLICE_COUNTS).to_arrow_table()
                    at = counts.column("place").combine_chunks()
                    terms = [joined[a:b] for a, b in zip(at.field("a").to_pylist(), at.field("b").to_pylist())]
                    counts = counts.drop_columns("place").append_column("term", pa.array(terms, pa.string()))
                    con.execute("INSERT INTO counted SELECT h, term, uses, holders FROM counts")
            yield pa.RecordBatch.from_pylist([{"term": None, "uses": 0, "holders": number}], pa.schema([("term", pa.string()), ("uses", pa.int64()), ("holders", pa.int64())]))
            yield from con.sql("SELECT any_value(term) AS term, sum(uses)::BIGINT AS uses, sum(holders)::BIGINT AS holders FROM counted GROUP BY h").to_arrow_reader(50_000)

    return run


def _aggregate(spill: str):
    """The sums of a leaf: its rows stream into a table that may exceed the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database(spill) as con:
            con.execute("CREATE TABLE leaf (term VARCHAR, uses BIGINT, holders BIGINT)")
            for batch in batches:
                rows = pa.Table.from_batches([batch])  # noqa: F841 (read by name)
                con.execute("INSERT INTO leaf SELECT term, uses, holders FROM rows")
            yield from con.sql("SELECT term, sum(uses)::BIGINT AS uses, sum(holders)::BIGINT AS holders FROM leaf GROUP BY term").to_arrow_reader(50_000)

    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def radix_leaves(df: DataFrame, key: Column, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``df`` with a column ``leaf`` of hash bits, with more bits where a partition has more than ``leaf_rows``.

    ``df`` should be cheap to read again (a checkpoint).  What comes to the driver is one
    number for each oversized partition of a level.
    """
    hashed = F.xxhash64(key)
    bits = FIRST_BITS
    df = df.withColumn("__hash", hashed)
    level = F.concat(F.lit(f"{bits}:"), F.col("__hash").bitwiseAND((1 << bits) - 1).cast("string"))
    df = df.withColumn("leaf", level)
    while True:
        large = {r["leaf"]: r["count"] for r in df.groupBy("leaf").count().where(F.col("count") > leaf_rows).collect()}
        large = {leaf: n for leaf, n in large.items() if leaf.startswith(f"{bits}:")}
        if not large:
            break
        bits += NEXT_BITS
        deeper = F.concat(F.lit(f"{bits}:"), F.col("__hash").bitwiseAND((1 << bits) - 1).cast("string"))
        if bits > MOST_BITS:
            parts = max(-(-n // leaf_rows) for n in large.values())
            deeper = F.concat(F.col("leaf"), F.lit("/"), (F.rand(17) * parts).cast("int").cast("string"))
        df = df.withColumn("leaf", F.when(F.col("leaf").isin(list(large)), deeper).otherwise(F.col("leaf")))
        if bits > MOST_BITS:
            break
    return df.drop("__hash")


def term_counts(df: DataFrame, title: str = "title", text: str = "full_text", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(term, uses, holders) of all rows of ``df``; the row with a null term has the number of rows in ``holders``."""
    spill = spill_folder(df.sparkSession)
    reduced = cut(df.select(title, text).mapInArrow(_reduce(spill), COUNTS))
    leaves = radix_leaves(reduced, F.col("term"), leaf_rows)
    summed = leaves.groupBy("leaf").applyInArrow(_aggregate(spill), COUNTS)
    return summed.groupBy("term").agg(F.sum("uses").alias("uses"), F.sum("holders").alias("holders"))


def marked_terms(counts: DataFrame, rare: int = RARE_COUNT, common: float = COMMON_SHARE) -> DataFrame:
    """(term, uses, holders, rare, common) of every word."""
    total = counts.where("term IS NULL").select(F.col("holders").alias("__rows"))
    words = counts.where("term IS NOT NULL").crossJoin(F.broadcast(total))
    return words.select(
        "term", "uses", "holders",
        (F.col("uses") <= rare).alias("rare"), (F.col("holders") > common * F.col("__rows")).alias("common"),
    )


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(term_counts(earliest_rows(table(spark, sf_dir, "legal_document"))))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return p6_terms(spark, sf_dir).select("term", F.explode(marks).alias("mark"))
