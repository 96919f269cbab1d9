"""Incremental, idempotent ingestion: only new, changed or incomplete documents are worked on.

``run`` handles one batch; ``stream`` feeds it from a file source.  The state table is
written last, so a batch that broke off is simply found pending again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators import chunking
from dossier.plans.settings import Settings
from dossier.plans.shared import cut
from dossier.sources import sinks
from dossier.sources.readers import FIELDS

VERSION = "1"
Embedder = Callable[[DataFrame], DataFrame]


def with_hash(documents: DataFrame, settings: Settings) -> DataFrame:
    return documents.withColumn("index_hash", X.index_hash(VERSION, X.fingerprint(*FIELDS), settings.embedding_model, settings.chunk_chars, settings.chunk_overlap))


def pending(documents: DataFrame, state: DataFrame | None, counts: DataFrame | None) -> DataFrame:
    """Documents that have no ready state with this hash, or whose stored chunks are fewer or more than the state says."""
    if state is None:
        return documents
    stored = state.where("index_status = 'ready'").select(F.col("document_id").alias("id"), "index_hash", "chunk_count")
    if counts is not None:
        held = counts.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("held"))
        stored = stored.join(held, "id", "left").where(F.coalesce("held", F.lit(0)) == F.col("chunk_count"))
    return documents.join(stored.select("id", "index_hash"), ["id", "index_hash"], "left_anti")


def stale(documents: DataFrame, state: DataFrame, settings: Settings) -> DataFrame:
    """Ids that are missing from the state, not ready or out of date: a relation build must not start with any."""
    return pending(with_hash(documents, settings), state, None).select("id")


def stub_embedding(chunks: DataFrame, dimension: int = 16) -> DataFrame:
    """(id, embedding): deterministic vectors for tests, from hashes of the text."""
    unit = lambda k: (F.pmod(F.xxhash64("text", k), F.lit(2001)) - 1000).cast("float") / F.lit(1000.0).cast("float")
    return chunks.select("id", F.transform(F.sequence(F.lit(1), F.lit(dimension)), unit).cast("array<float>").alias("embedding"))


def run(spark: SparkSession, store: sinks.Store, documents: DataFrame, settings: Settings | None = None, embed: Embedder = stub_embedding) -> int:
    """Ingest one batch into ``store``; the number of documents worked on."""
    settings = settings or Settings()
    state = store.read("state") if store.exists("state") else None
    old_chunks = store.read("chunks") if store.exists("chunks") else None
    work = cut(pending(with_hash(documents.dropDuplicates(["id"]), settings), state, old_chunks))
    number = work.count()
    if not number:
        return 0
    ids = work.select(F.col("id").alias("document_id"))
    chunks = cut(chunking.chunk_documents(work, settings.chunk_chars, settings.chunk_overlap))
    fresh = {
        "chunks": sinks.points(chunks, embed(chunks), work.drop("index_hash")),
        "mentions": chunking.mentions(work),
        "provisions": chunking.parse_structure(work),
        "entities": sinks.entities(work),
        "identifiers": sinks.identifiers(work),
    }
    for name, rows in fresh.items():
        store.replace(name, rows, ids)
    if store.exists("relations"):
        store.write("relations", sinks.invalidate({"relations": store.read("relations")}, ids)["relations"])
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    done = work.select(F.col("id").alias("document_id"), "index_hash").join(counts, "document_id", "left")
    done = done.select("document_id", F.lit("ready").alias("index_status"), "index_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.current_timestamp().alias("changed_at"))
    store.replace("state", done, ids)
    return number


def stream(spark: SparkSession, source: str, schema: str, store: sinks.Store, checkpoint: str, settings: Settings | None = None, embed: Embedder = stub_embedding):
    """A query that ingests the document files of ``source`` as they arrive; each batch is idempotent."""
    incoming = spark.readStream.schema(schema).parquet(source)
    writer = incoming.writeStream.foreachBatch(lambda batch, _: run(spark, store, batch, settings, embed) and None)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
