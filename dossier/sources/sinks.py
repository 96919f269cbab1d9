"""Sinks: keyed upserts, invalidation and guarded merges as DataFrames, and crash-safe table writes.

A table is a folder of versions and numbered manifests, each the list of the version folders that
make up the table.  A write completes a new version, writes its manifest under another name and
renames it, so a reader sees the old or the new table and never half of one.  A table in buckets
is rewritten only in the buckets that change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.operators.search import check_dimension

RELATION_KEY = ("source_id", "target_id", "kind")
#: Buckets of a table that grows by documents.
BUCKETS = 64


class Store:
    """Named parquet tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _file(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _manifests(self, name: str) -> list[int]:
        fs, path = self._file(f"{self.folder}/{name}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, name: str) -> dict[str, str]:
        numbers = self._manifests(name)
        if not numbers:
            raise FileNotFoundError(f"no table {name}")
        return json.loads(self.spark.read.text(f"{self.folder}/{name}/manifests/{numbers[-1]}", wholetext=True).first()[0])

    def _publish(self, name: str, manifest: dict[str, str]) -> None:
        number = max(self._manifests(name), default=0) + 1
        fs, path = self._file(f"{self.folder}/{name}/manifests/_{uuid.uuid4().hex}")
        fs.mkdirs(path.getParent())
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if not fs.rename(path, self._file(f"{self.folder}/{name}/manifests/{number}")[1]):
            raise OSError(f"table {name} was changed by another writer")

    def exists(self, name: str) -> bool:
        return bool(self._manifests(name))

    def read(self, name: str, buckets: Iterable[str] | None = None) -> DataFrame:
        """The table, or only the given buckets of it."""
        manifest = self._manifest(name)
        paths = {p for b, p in manifest.items() if buckets is None or b in buckets}
        df = self.spark.read.parquet(*(f"{self.folder}/{name}/{p}" for p in sorted(paths or set(manifest.values()))))
        return df if paths else df.limit(0)

    def write(self, name: str, df: DataFrame, recreate: bool = True, partition_by: list[str] | None = None) -> None:
        """A new version of the table, complete before it is seen; refused if one exists and ``recreate`` is false."""
        if not recreate and self.exists(name):
            raise FileExistsError(f"table {name} exists")
        version = uuid.uuid4().hex
        df.write.partitionBy(*(partition_by or [])).parquet(f"{self.folder}/{name}/{version}")
        self._publish(name, {"all": version})

    def replace(self, name: str, rows: DataFrame, gone: DataFrame, key: str = "document_id") -> None:
        """``rows`` take the place of the rows whose ``key`` is in ``gone``; only the buckets of these keys are read and written."""
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("string")
        old = self._manifest(name) if self.exists(name) else {}
        touched = {r[0] for r in gone.select(bucket).unionByName(rows.select(bucket)).distinct().collect()}  # at most BUCKETS
        if "all" in old:
            touched = {str(b) for b in range(BUCKETS)}
        kept = touched if "all" not in old else None
        if old and (kept is None or kept & old.keys()):
            rows = delete(self.read(name, kept), gone, key).unionByName(rows, allowMissingColumns=True)
        version = uuid.uuid4().hex
        path = f"{self.folder}/{name}/{version}"
        rows.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
        fs, where = self._file(path)
        fresh = {f.getPath().getName().split("=")[1] for f in fs.listStatus(where) if "=" in f.getPath().getName()}
        manifest = {b: p for b, p in old.items() if b not in touched and b != "all"} | {b: f"{version}/__bucket={b}" for b in fresh}
        if manifest:
            self._publish(name, manifest)
        else:
            self.write(name, rows.limit(0))  # an empty table keeps its columns

    def reset(self, *names: str) -> None:
        for name in names:
            fs, path = self._file(f"{self.folder}/{name}")
            fs.delete(path, True)


def upsert(old: DataFrame | None, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; of repeated new rows the last one (in the order they are read) counts."""
    row = F.struct(*new.columns)
    new = new.withColumn("__at", F.monotonically_increasing_id()).groupBy(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys))).agg(F.max_by(row, "__at").alias("__row")).select("__row.*")
    if old is None:
        return new
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    return old.join(gone.select(key), key, "left_anti")


def latest(batches: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    row = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return batches.withColumn("__n", row).where("__n = 1").drop("__n")


def points(chunks: DataFrame, vectors: DataFrame, documents: DataFrame, dimension: int | None = None) -> DataFrame:
    """Chunk index rows: point id, vector, and the document's filter columns; chunks and vectors must correspond one to one."""
    check_dimension(vectors, "embedding", dimension)
    counts = chunks.agg(F.count(F.lit(1)).alias("n")).crossJoin(vectors.agg(F.count(F.lit(1)).alias("m"))).first()
    if counts["n"] != counts["m"]:
        raise ValueError(f"{counts['n']} chunks but {counts['m']} vectors")
    payload = documents.select(F.col("id").alias("document_id"), *(c for c in documents.columns if c not in ("id", "full_text", "document_id")))
    return chunks.join(vectors, "id").join(payload, "document_id").withColumn("point_id", X.point_id("id"))


def entities(documents: DataFrame) -> DataFrame:
    """(document_id, etype, entity_key, name, position): agency, sector, field and signer of each document."""
    kinds = (("agency", "agency"), ("sector", "sector"), ("field", "field"), ("person", "signer"))
    rows = F.array(*(F.struct(F.lit(k).alias("etype"), X.optional(c).alias("name"), (X.optional("signer_position") if k == "person" else F.lit(None).cast("string")).alias("position")) for k, c in kinds))
    long = documents.select(F.col("id").alias("document_id"), F.explode(rows).alias("x")).select("document_id", "x.*").where("name <> ''")
    return long.select("document_id", "etype", X.entity_key("name").alias("entity_key"), "name", "position")


def identifiers(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("document_id"), X.number_norm(X.compose(X.optional("number"))).alias("number_norm")).where("number_norm <> ''").distinct()


def invalidate(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """Tables without the state of ``documents`` (document_id): own rows, and relations from or to them; shared entities stay."""
    out = {}
    for name, df in tables.items():
        for column in ("source_id", "target_id") if name == "relations" else ("document_id",):
            df = df.join(documents.select(F.col("document_id").alias(column)), column, "left_anti")
        out[name] = df
    return out


def merge_relations(old: DataFrame | None, new: DataFrame, chunks: DataFrame, ready: DataFrame, owners: DataFrame) -> DataFrame:
    """Upsert of relations whose source has the chunk, whose ends are ready and whose target alone owns its identifier."""
    kept = new.join(chunks.select(F.col("id").alias("source_chunk_id"), F.col("document_id").alias("source_id")), ["source_chunk_id", "source_id"], "left_semi")
    for end in ("source_id", "target_id"):
        kept = kept.join(ready.select(F.col("document_id").alias(end)), end, "left_semi")
    alone = owners.groupBy("number_norm").agg(F.countDistinct("document_id").alias("n"), F.min("document_id").alias("target_id")).where("n = 1")
    return upsert(old, kept.join(alone.select("target_id").distinct(), "target_id", "left_semi"), *RELATION_KEY)


def structure_hash(provisions: DataFrame) -> DataFrame:
    """(document_id, structure_hash) of each document's whole hierarchy."""
    row = F.concat_ws(X.SEPARATOR, "id", "parent_id", "level", "label", "text")
    return provisions.groupBy("document_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2(row, 256))), "|"), 256).alias("structure_hash"))


def merge_structure(old: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hierarchy with changed documents replaced, and the ids of those that changed."""
    fresh = structure_hash(new)
    changed = fresh if old is None else fresh.join(structure_hash(old), ["document_id", "structure_hash"], "left_anti")
    changed = changed.select("document_id")
    rows = new.join(changed, "document_id", "left_semi")
    return (rows if old is None else old.join(changed, "document_id", "left_anti").unionByName(rows)), changed


def merge_article_relations(old: DataFrame | None, new: DataFrame, mapping: DataFrame, articles: DataFrame) -> DataFrame:
    """Upsert by key; both ends must own their chunks; each row carries the current hashes of its ends (articles: id, structure_hash)."""
    for end in ("source", "target"):
        owned = mapping.select(F.col("article_id").alias(f"{end}_id"), F.col("chunk_id").alias(f"{end}_chunk_id"))
        new = new.join(owned, [f"{end}_id", f"{end}_chunk_id"], "left_semi")
        new = new.join(articles.select(F.col("id").alias(f"{end}_id"), F.col("structure_hash").alias(f"{end}_hash")), f"{end}_id")
    key = X.fingerprint("source_id", "target_id", "kind", "source_chunk_id", "target_chunk_id")
    return upsert(old, new.withColumn("key", key), "key")


def merge_facts(old: DataFrame | None, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All facts, and the (article_id, concept_key, kind) links of those that define or regulate."""
    every = upsert(old, new, "id")
    return every, every.where(F.col("kind").isin("DEFINES", "REGULATES")).select("article_id", "concept_key", "kind").distinct()


def reviewed_concepts(proposals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Concepts (document_id, source_chunk_id, phrase, reviewed_by) whose phrase stands in the chunk and that have a reviewer."""
    body = chunks.select(F.col("id").alias("source_chunk_id"), "document_id", "body")
    kept = proposals.join(body, ["source_chunk_id", "document_id"]).where((F.trim("reviewed_by") != "") & (F.trim("phrase") != "") & F.contains(F.col("body"), F.col("phrase")))
    return kept.select("document_id", F.lit("concept").alias("etype"), X.entity_key("phrase").alias("entity_key"), F.col("phrase").alias("name"), "source_chunk_id", "reviewed_by")


def link_article_chunks(links: DataFrame, articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links whose article and chunk are of one document."""
    a = articles.select(F.col("id").alias("article_id"), F.col("document_id").alias("__a"))
    c = chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("__c"))
    return links.join(a, "article_id").join(c, "chunk_id").where("__a = __c").select("chunk_id", "article_id").distinct()


def report(df: DataFrame, path: str) -> None:
    """A JSON report that never replaces another."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def flat_report(df: DataFrame, path: str) -> None:
    """A CSV report, nested values as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*(F.to_json(c).alias(c) if c in nested else c for c in df.columns)).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def gram_report(ranked: DataFrame, path: str) -> None:
    """Rank, count and phrase, separated by tabs, with a header."""
    rank = F.row_number().over(W.orderBy(F.desc("n"), "gram"))
    ranked.select(rank.alias("rank"), F.col("n").alias("count"), F.col("gram").alias("phrase")).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def missing_responses(requests: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Requests (request) without a cached response, with their key."""
    keyed = requests.withColumn("key", F.sha2("request", 256)).dropDuplicates(["key"])
    return keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def snapshot_tables(documents: DataFrame, chunks: DataFrame, relations: DataFrame, postings: DataFrame) -> dict[str, DataFrame]:
    """Snapshot tables (id, payload) with an inverted index; broken links are an error."""
    for name, child, key in (("chunk", chunks, "document_id"), ("posting", postings.select(F.col("id").alias("chunk_id")), "chunk_id")):
        parents = documents.select(F.col("id").alias(key)) if key == "document_id" else chunks.select(F.col("id").alias(key))
        lost = child.join(parents, key, "left_anti").limit(1).count()
        if lost:
            raise ValueError(f"a {name} has no parent")
    whole = lambda df: df.select("id", F.to_json(F.struct(*(c for c in df.columns if c != "id"))).alias("payload"))
    relations = relations.withColumn("id", X.fingerprint(*RELATION_KEY))
    return {"documents": whole(documents), "chunks": whole(chunks), "relations": whole(relations), "postings": postings}


def write_report_json(path: str, values: dict) -> None:
    """A small driver-side report; refuses to replace a file."""
    with open(path, "x", encoding="utf-8") as out:
        json.dump(values, out, ensure_ascii=False, indent=2)
