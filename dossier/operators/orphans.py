"""Problem 5: references to records that do not exist.

A reference has a key and a time; a parent has a key and the span of time in which it is
present.  Keys are range-partitioned by their 64-bit hash.  The spans of a range are first
merged to the union for each key, in parts if a range is large, so that a key shared by a
third of all parents becomes a few spans.  References of a range are dealt to as many tasks
as their number needs, so a key that a third of all rows refer to is no hot task.  A task
holds its parents as sorted arrays and probes a batch of references by two binary searches
(key hash, then key and time); a hit is confirmed on the key itself.

Defined results: null or blank references are no case; a reference without time or id is
left out; repeated rows give one result row; with an empty parent table every reference is
an orphan; of several states at one instant ``removed`` outranks ``ready``, that ``building``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.textform import number_key
from dossier.plans.shared import cut, table

#: References probed, and parent spans merged, by one task.
TASK_ROWS = 400_000
#: Least number of hash ranges; more are used as the tables grow.
RANGES = 12
ENDLESS = (1 << 62) - 1
SPACES = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"


def stripped(column: str) -> Column:
    """Text without surrounding white space of any kind."""
    return F.regexp_replace(column, f"^{SPACES}|{SPACES}$", "")


def micros(column: str) -> Column:
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def number_keys(df: DataFrame, column: str, out: str = "key") -> DataFrame:
    """``df`` with the comparison key of a written number in the string column ``out``."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(batch.schema.get_field_index(column)).dictionary_encode()
            keys = pa.array([number_key(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{kinds}, `{out}` string")


def presence(documents: DataFrame, states: DataFrame) -> DataFrame:
    """(id, start, end): the spans, in microseconds and open at the end, in which each document is present.

    A document is present from its earliest ``loaded_at`` on, except while its latest state is
    ``removed``.  States are ordered within months, and months within documents, so that one
    document with very many states is no hot task.
    """
    loaded = documents.where("id IS NOT NULL AND loaded_at IS NOT NULL").groupBy("id").agg(F.min(micros("loaded_at")).alias("loaded"))
    states = states.where("document_id IS NOT NULL AND changed_at IS NOT NULL").select(
        F.col("document_id").alias("id"), micros("changed_at").alias("at"), F.date_trunc("month", "changed_at").alias("month"),
        F.coalesce("index_status", F.lit("")).alias("status"),
    )
    states = states.groupBy("id", "month", "at").agg(F.max("status").alias("status"))
    months = states.groupBy("id", "month").agg(F.min("at").alias("first"))
    months = months.withColumn("following", F.lead("first").over(W.partitionBy("id").orderBy("month"))).select("id", "month", "following")
    inner = states.withColumn("next", F.lead("at").over(W.partitionBy("id", "month").orderBy("at"))).join(months, ["id", "month"])
    spans = inner.where("status <> 'removed'").select("id", F.col("at").alias("start"), F.coalesce("next", "following", F.lit(ENDLESS)).alias("end"))
    first = states.groupBy("id").agg(F.min("at").alias("first"))
    before = loaded.join(first, "id", "left").select("id", F.col("loaded").alias("start"), F.coalesce("first", F.lit(ENDLESS)).alias("end"))
    after = spans.join(loaded, "id").select("id", F.greatest("start", "loaded").alias("start"), "end")
    return before.unionByName(after).where("start < end")


def _union(keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the overlapping or touching spans of each key code; sorted by key and start."""
    order = np.lexsort((start, keys))
    keys, start, end = keys[order], start[order], end[order]
    # Within a key the running largest end; codes lift each key above the one before.
    _, dense = np.unique(keys, return_inverse=True)
    ends = np.unique(end)
    lifted = dense.astype(np.int64) * (len(ends) + 1) + np.searchsorted(ends, end)
    running = np.maximum.accumulate(lifted) - dense.astype(np.int64) * (len(ends) + 1)
    reach = ends[running]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (start[1:] > reach[:-1])
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(keys) - 1)
    return keys[fresh], start[fresh], reach[last]


def _merge(spans: pa.Table) -> pa.Table:
    names = ["range", "key", "start", "end"]
    spans = spans.select(names)
    if not spans.num_rows:
        return spans
    coded = spans["key"].combine_chunks().dictionary_encode()
    codes, start, end = _union(coded.indices.to_numpy().astype(np.int64), spans["start"].to_numpy(), spans["end"].to_numpy())
    ranges = pa.array(np.full(len(codes), spans["range"][0].as_py(), dtype=np.int64))
    return pa.Table.from_arrays([ranges, coded.dictionary.take(pa.array(codes)), pa.array(start), pa.array(end)], names=names)


def _probe(references: pa.Table, parents: pa.Table) -> pa.Table:
    """The references that no parent span of their key holds."""
    kept = ["table_name", "ref_id", "period"]
    if not references.num_rows or not parents.num_rows:
        return references.select(kept)
    names = parents["key"].combine_chunks().dictionary_encode()
    codes, start, end = _union(names.indices.to_numpy().astype(np.int64), parents["start"].to_numpy(), parents["end"].to_numpy())
    # First search: the hash of the key among the sorted hashes of the parents' keys.
    hashes = np.zeros(len(names.dictionary), dtype=np.int64)
    hashes[names.indices.to_numpy()] = parents["hash"].to_numpy()
    by_hash = np.argsort(hashes, kind="stable")
    ordered = hashes[by_hash]
    wanted = references["hash"].to_numpy()
    place = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    code = by_hash[place].astype(np.int64)
    keys = references["key"].combine_chunks()
    same = pc.equal(names.dictionary.take(pa.array(code)), keys).to_numpy(zero_copy_only=False)
    if len(np.unique(ordered)) < len(ordered):
        exact = pc.index_in(keys, value_set=names.dictionary)
        code = exact.fill_null(0).to_numpy().astype(np.int64)
        same = exact.is_valid().to_numpy(zero_copy_only=False)
    # Second search: the last span of the key that starts at or before the reference's time.
    times = np.unique(start)
    lift = len(times) + 1
    spans = codes * lift + np.searchsorted(times, start)
    at = references["at"].to_numpy()
    found = np.searchsorted(spans, code * lift + np.searchsorted(times, at, side="right") - 1, side="right") - 1
    inside = same & (found >= 0) & (codes[found] == code) & (start[found] <= at) & (at < end[found])
    return references.select(kept).filter(pa.array(~inside))


def _ranged(df: DataFrame, ranges: int) -> DataFrame:
    """Columns ``hash`` of the key and ``range``, its contiguous share of the hash space."""
    hashed = F.xxhash64("table_name", "key")
    width = (1 << 64) // ranges + 1
    return df.withColumn("hash", hashed).withColumn("range", F.floor(F.col("hash") / F.lit(float(width))).cast("bigint"))


def orphan_references(references: DataFrame, parents: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The orphans among ``references`` (table_name, ref_id, period, key, at), each once.

    ``parents`` (table_name, key, start, end) holds the spans in which each key of each
    referring table has a target.
    """
    references = cut(references.where("key IS NOT NULL AND key <> '' AND at IS NOT NULL AND ref_id IS NOT NULL").distinct())
    parents = cut(parents.where("key IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL"))
    ranges = max(RANGES, 2 * references.count() // task_rows, 2 * parents.count() // task_rows)
    references, parents = _ranged(references, ranges), _ranged(parents, ranges)
    # Some ranges hold more: the number of parts is counted, one row for each range.
    parts = cut(references.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("parts")))
    lots = parents.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("lots"))
    spans = (
        parents.join(lots, "range")
        .withColumn("lot", F.pmod(F.xxhash64("key", "start", "end"), "lots"))
        .select("range", "lot", F.concat_ws("\u001f", "table_name", "key").alias("key"), "start", "end")
        .groupBy("range", "lot").applyInArrow(_merge, "range bigint, key string, start bigint, end bigint")
    )
    copies = parts.select("range", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    spans = spans.join(copies, "range").withColumn("hash", F.xxhash64("key"))
    probes = (
        references.join(parts.select(F.col("range").alias("__range"), "parts"), F.col("range") == F.col("__range"))
        .withColumn("part", F.pmod(F.xxhash64("ref_id"), "parts").cast("int")).drop("__range", "parts")
        .withColumn("key", F.concat_ws("\u001f", "table_name", "key")).withColumn("hash", F.xxhash64("key"))
    )
    return probes.groupBy("range", "part").cogroup(spans.groupBy("range", "part")).applyInArrow(
        _probe, "table_name string, ref_id string, period string"
    )


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents, states = table(spark, sf_dir, "legal_document"), table(spark, sf_dir, "ingest_state")
    present = cut(presence(documents.select("id", "loaded_at"), states))
    numbers = number_keys(documents.where("number IS NOT NULL AND id IS NOT NULL").select("id", "number").distinct(), "number").select("id", "key").distinct()
    instruments = number_keys(table(spark, sf_dir, "instrument").select("number_norm"), "number_norm")
    parents = (
        present.select(F.lit("document_chunk").alias("table_name"), F.col("id").alias("key"), "start", "end")
        .unionByName(present.join(numbers, "id").select(F.lit("mention").alias("table_name"), "key", "start", "end"))
        .unionByName(instruments.select(F.lit("mention").alias("table_name"), "key", F.lit(-ENDLESS).alias("start"), F.lit(ENDLESS).alias("end")))
    )
    chunks = table(spark, sf_dir, "document_chunk").select(
        F.lit("document_chunk").alias("table_name"), F.col("id").alias("ref_id"), F.date_format("indexed_at", "yyyy-MM").alias("period"),
        stripped("document_id").alias("key"), micros("indexed_at").alias("at"),
    )
    mentions = number_keys(table(spark, sf_dir, "mention").select("mention_id", "number_norm", "extracted_at"), "number_norm").select(
        F.lit("mention").alias("table_name"), F.col("mention_id").cast("string").alias("ref_id"),
        F.date_format("extracted_at", "yyyy-MM").alias("period"), "key", micros("extracted_at").alias("at"),
    )
    return chunks.unionByName(mentions), parents


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    references, parents = _inputs(spark, sf_dir)
    return orphan_references(references, parents).distinct()


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, period, orphans): the report for each table and month."""
    return p5_found(spark, sf_dir).groupBy("table_name", "period").agg(F.count(F.lit(1)).alias("orphans"))
