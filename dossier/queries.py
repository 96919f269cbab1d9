"""Queries of the core, one or more for each operator family, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.functions import textform
from dossier.operators import candidates, chunking, evaluate, graph, heavy, orphans, retrieve, search, tfidf, validate
from dossier.plans import articles, pipelines
from dossier.plans.settings import Expansion
from dossier.plans.shared import cut, earliest_rows, table
from dossier.sources import sinks
from dossier.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p5_found": orphans.p5_found,
    "p5_periods": orphans.p5_periods,
}
ORACLES: dict[str, str] = {}

# Fixed value of the oracles: white space as RE2 writes it.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
QUESTIONS = ((1, "hợp đồng lao động và trợ cấp thôi việc"), (2, "quyết định thi hành án và hòa giải"), (3, "software and digital signature"))


def _text(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


def _optional(c: str) -> str:
    return f"CASE WHEN lower({_text(c)}) IN ('', '--', 'null', 'none', 'n/a') THEN '' ELSE {_text(c)} END"


def _number(c: str) -> str:
    return rf"regexp_replace(regexp_replace(upper(coalesce({c}, '')), '^[ .,;:()\[\]]+|[ .,;:()\[\]]+$', '', 'g'), '{WS}+', '', 'g')"


def _number_key(c: str) -> str:
    """The key of a written number in SQL; look-alike letters are replaced as in words that have Latin letters."""
    one = {k: v for k, v in (textform.single_map() | textform.mixed_map()).items() if len(v) == 1}
    gone = "".join(f"\\x{{{ord(k):X}}}" for k, v in textform.single_map().items() if not v)
    quoted = lambda chars: "'" + "".join(chars).replace("'", "''") + "'"
    drawn = f"translate(regexp_replace({c}, '[{gone}]', '', 'g'), {quoted(one)}, {quoted(one.values())})"
    dashed = f"regexp_replace(upper(nfc_normalize({drawn})), '[\\p{{Pd}}−]', '-', 'g')"
    return f"trim(regexp_replace({dashed}, '{WS}+', '', 'g'), '.,;:()[]')"


def query(sql: str | None = None):
    """Register a function as the query of its name, with its SQL where SQL can say it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


ORPHANS = f"""loaded AS (SELECT id, min(loaded_at) AS since FROM legal_document WHERE id IS NOT NULL GROUP BY id),
    states AS (SELECT document_id AS id, index_status, changed_at, lead(changed_at) OVER (PARTITION BY document_id ORDER BY changed_at, index_status) AS until FROM ingest_state WHERE changed_at IS NOT NULL),
    present AS (SELECT id, since, (SELECT min(changed_at) FROM states s WHERE s.id = l.id) AS until FROM loaded l
      UNION ALL SELECT id, greatest(since, changed_at), until FROM loaded JOIN states USING (id) WHERE index_status IS DISTINCT FROM 'removed'),
    keys AS (SELECT DISTINCT id, {_number_key('number')} AS key FROM legal_document WHERE id IS NOT NULL AND number IS NOT NULL),
    instruments AS (SELECT {_number_key('number_norm')} AS key FROM instrument),
    mentions AS (SELECT mention_id, {_number_key('number_norm')} AS key, extracted_at AS t FROM mention),
    chunks AS (SELECT id AS chunk_id, regexp_replace(document_id, '^{WS}+|{WS}+$', '', 'g') AS key, indexed_at AS t FROM document_chunk),
    orphans AS (SELECT DISTINCT 'document_chunk' AS table_name, chunk_id AS ref_id, strftime(t, '%Y-%m') AS period FROM chunks c WHERE key <> '' AND t IS NOT NULL AND chunk_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM present p WHERE p.id = c.key AND p.since <= t AND (p.until IS NULL OR t < p.until))
      UNION SELECT 'mention', mention_id::VARCHAR, strftime(t, '%Y-%m') FROM mentions m WHERE key <> '' AND t IS NOT NULL AND key NOT IN (SELECT key FROM instruments)
        AND NOT EXISTS (SELECT 1 FROM keys k JOIN present p USING (id) WHERE k.key = m.key AND p.since <= t AND (p.until IS NULL OR t < p.until)))"""
ORACLES["p5_found"] = f"WITH {ORPHANS} SELECT * FROM orphans"
ORACLES["p5_periods"] = f"WITH {ORPHANS} SELECT table_name, period, count(*) AS orphans FROM orphans GROUP BY ALL"


def r6(c: Column) -> Column:
    return F.round(c, 6)


COSINE = "coalesce(round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6), 0)"


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS score FROM embeddings q, embeddings e WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 10")
def q_dense_topk(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    top = search.dense_topk(points, points.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, "vec_id")
    return top.select("query_id", F.col("vec_id").alias("id"), r6(F.col("score")).alias("score"))


@query(f"SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS score FROM embeddings q, embeddings e WHERE q.vec_id = 0 AND e.label = 3 ORDER BY score DESC, id LIMIT 10")
def q_dense_filtered(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    asked = points.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = search.dense_topk(points, asked, 10, "vec_id", predicate=search.X.condition({"must": [{"key": "label", "match": 3}]}))
    return top.select("query_id", F.col("vec_id").alias("id"), r6(F.col("score")).alias("score"))


@query(f"""SELECT query_id, id, score FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS n FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) WHERE n <= 5""")
def q_knn_join(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    top = search.dense_topk(points, points.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, "vec_id")
    return top.select("query_id", F.col("vec_id").alias("id"), r6(F.col("score")).alias("score"))


@query(f"""SELECT id, {_text('title')} AS title, {_optional('agency')} AS agency,
    coalesce(strftime(CASE WHEN regexp_full_match({_optional('issued_date')}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({_optional('issued_date')}, '%d/%m/%Y')
      WHEN regexp_full_match({_optional('issued_date')}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({_optional('issued_date')}, '%Y-%m-%d') END, '%Y-%m-%d'), {_optional('issued_date')}) AS issued_date
    FROM legal_document""")
def q_normalize(spark, sf_dir):
    df = table(spark, sf_dir, "legal_document")
    return df.select("id", X.text("title").alias("title"), X.optional("agency").alias("agency"), X.date("issued_date").alias("issued_date"))


@query("SELECT id, sha256(concat_ws(chr(31), coalesce(id, ''), coalesce(title, ''), coalesce(full_text, ''), coalesce(number, ''))) AS hash FROM legal_document")
def q_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "legal_document").select("id", X.fingerprint("id", "title", "full_text", "number").alias("hash"))


@query(f"SELECT id, {_number('number')} AS number_norm FROM legal_document")
def q_number_norm(spark, sf_dir):
    return table(spark, sf_dir, "legal_document").select("id", X.number_norm("number").alias("number_norm"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'vi' AND source IS NOT NULL AND NOT (n_chars < 500 OR n_chars IS NULL)")
def q_filter_pushdown(spark, sf_dir):
    tree = {"must": [{"key": "lang", "match": "vi"}], "must_not": [{"should": [{"key": "n_chars", "lte": 499}]}]}
    return table(spark, sf_dir, "documents").where(X.condition(tree) & F.col("source").isNotNull() & F.col("n_chars").isNotNull()).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM subject_label)")
def q_membership(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "subject_label").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT DISTINCT id AS document_id FROM legal_document d WHERE NOT EXISTS (SELECT 1 FROM ingest_state s WHERE s.document_id = d.id AND s.index_status = 'removed')")
def q_missing_state(spark, sf_dir):
    removed = table(spark, sf_dir, "ingest_state").where("index_status = 'removed'").select("document_id").distinct()
    return sinks.delete(table(spark, sf_dir, "legal_document").select(F.col("id").alias("document_id")).distinct(), removed)


@query("SELECT id, count(*) AS n FROM legal_document GROUP BY id HAVING count(*) > 1")
def q_duplicate_ids(spark, sf_dir):
    return table(spark, sf_dir, "legal_document").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT id, title, loaded_at FROM legal_document QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1")
def q_earliest(spark, sf_dir):
    return earliest_rows(table(spark, sf_dir, "legal_document")).select("id", "title", "loaded_at")


@query("""SELECT document_id, index_status, chunk_count, changed_at FROM ingest_state
    QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY changed_at DESC, index_status DESC) = 1""")
def q_latest_state(spark, sf_dir):
    return sinks.latest(table(spark, sf_dir, "ingest_state"), ["document_id"], [F.desc("changed_at"), F.desc("index_status")])


GRAMS = """SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS gram FROM
    (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[-''’][\\p{L}\\p{N}]+)*') AS w FROM documents)) GROUP BY gram ORDER BY n DESC, gram LIMIT 50"""


@query(GRAMS)
def q_ngram_topk(spark, sf_dir):
    return heavy.heavy_exact(table(spark, sf_dir, "documents"), ["text"], 2, 50)


@query(GRAMS)
def q_ngram_sketch(spark, sf_dir):
    return heavy.heavy_sketch(table(spark, sf_dir, "documents"), ["text"], 2, 50, 100_000)


BM25 = """post AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM
      (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents)) GROUP BY doc_id, term),
    asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM
      (VALUES (1, 'hợp đồng lao động và trợ cấp thôi việc'), (2, 'quyết định thi hành án và hòa giải'), (3, 'software and digital signature')) v(query_id, text)),
    idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
    bm AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / 256.0))) AS score FROM post JOIN asked USING (term) JOIN idf USING (term) GROUP BY query_id, doc_id)"""


def _questions(spark) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS), "query_id int, text string")


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 20")
def q_bm25_topk(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return search.bm25_topk(documents, _questions(spark), 20, "doc_id").select("query_id", F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"))


VECTORS = "pts AS (SELECT doc_id, embedding FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings))"


def _points(spark, sf_dir) -> DataFrame:
    """Every document with its text and a vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return cut(documents.withColumn("vec_id", F.pmod("id", F.lit(vectors.count()))).join(vectors, "vec_id").drop("vec_id"))


@query(f"""WITH {BM25}, {VECTORS}, a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 30),
    d AS (SELECT q.vec_id AS query_id, doc_id, coalesce(round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9), 0) AS score FROM embeddings q, pts p WHERE q.vec_id IN (1, 2, 3)),
    b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM d QUALIFY rank <= 30)
    SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, doc_id""")
def q_rrf_fusion(spark, sf_dir):
    points = _points(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("query_id"), "embedding").where("query_id IN (1, 2, 3)")
    fused = search.fuse(search.bm25_topk(points, _questions(spark), 30), search.dense_topk(points, asked, 30))
    return fused.select("query_id", F.col("id").alias("doc_id"), r6(F.col("score")).alias("score"))


@query("""WITH t AS (SELECT DISTINCT context_id, name FROM context_record WHERE name IS NOT NULL),
    c AS (SELECT context_id, term, count(*) AS tf FROM (SELECT context_id, unnest(regexp_extract_all(lower(name), '\\S+')) AS term FROM t) GROUP BY ALL),
    i AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM t)),
    r AS (SELECT context_id, term, (1 + ln(tf)) * idf AS raw FROM c JOIN i USING (term)), n AS (SELECT context_id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY 1),
    w AS (SELECT context_id, term, raw / norm AS w FROM r JOIN n USING (context_id))
    SELECT source_id, target_id, score, rank FROM (SELECT a.context_id AS source_id, b.context_id AS target_id, round(sum(a.w * b.w), 6) AS score,
      row_number() OVER (PARTITION BY a.context_id ORDER BY round(sum(a.w * b.w), 6) DESC, b.context_id) AS rank FROM w a JOIN w b ON a.term = b.term AND a.context_id <> b.context_id
      GROUP BY a.context_id, b.context_id) WHERE rank <= 3""")
def q_tfidf_pairs(spark, sf_dir):
    texts = table(spark, sf_dir, "context_record").where("name IS NOT NULL").select(F.col("context_id").alias("id"), "name").distinct()
    weights = cut(tfidf.fit(texts, tfidf.word_grams("name", 1, 1), features=None))
    best = tfidf.best_pairs(cut(tfidf.vector_rows(weights)), 3, decimals=6)
    return best.select("source_id", "target_id", "score", "rank")


@query("""WITH t AS (SELECT number_norm AS id, lower(title) AS v FROM instrument WHERE title IS NOT NULL),
    c AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(list_transform(range(1, length(v) - 1), lambda k: substr(v, k, 3)), list_transform(range(1, length(v) - 2), lambda k: substr(v, k, 4)),
      list_transform(range(1, length(v) - 3), lambda k: substr(v, k, 5)))) AS term FROM t) GROUP BY id, term),
    i AS (SELECT term, ln((1 + (SELECT count(*) FROM t)) / (1.0 + count(*))) + 1 AS idf FROM c GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM t)),
    r AS (SELECT id, term, (1 + ln(tf)) * idf AS raw FROM c JOIN i USING (term)), n AS (SELECT id, sqrt(sum(raw * raw)) AS norm FROM r GROUP BY id), w AS (SELECT id, term, raw / norm AS w FROM r JOIN n USING (id)),
    p AS (SELECT a.id AS source_id, b.id AS target_id, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.term = b.term AND a.id <> b.id GROUP BY a.id, b.id)
    SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM p QUALIFY rank <= 3""")
def q_tfidf_char_suggestions(spark, sf_dir):
    texts = table(spark, sf_dir, "instrument").select(F.col("number_norm").alias("id"), "title")
    scored = tfidf.similar_pairs(cut(tfidf.fit(texts.where("title IS NOT NULL"), tfidf.char_grams("title"), features=30_000)))
    return tfidf.best_targets(scored.withColumn("score", r6(F.col("score"))), 3)


ENTITY = f"""ent AS (SELECT DISTINCT id AS document_id, etype, lower(name) AS entity_key FROM (SELECT id, 'agency' AS etype, {_optional('agency')} AS name FROM legal_document
    UNION ALL SELECT id, 'signer', {_optional('signer')} FROM legal_document) WHERE name <> '' AND id IS NOT NULL)"""
SEEDS = "seeds AS (SELECT DISTINCT id AS seed FROM legal_document WHERE regexp_full_match(id, '\\d+') AND try_cast(id AS BIGINT) % 100 = 0)"


def _entities(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "legal_document").where("id IS NOT NULL")
    part = lambda c: df.select(F.col("id").alias("document_id"), F.lit(c).alias("etype"), F.lower(X.optional(c)).alias("entity_key"))
    return part("agency").unionByName(part("signer")).where("entity_key <> ''").distinct()


def _seeds(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "legal_document").where(F.col("id").rlike(r"^\d+$") & (F.expr("try_cast(id AS bigint) % 100") == 0)).select(F.col("id").alias("seed")).distinct()
    return ids.withColumn("query_id", F.col("seed"))


@query(f"WITH {ENTITY}, {SEEDS} SELECT seed, b.document_id AS related, count(DISTINCT a.etype || chr(31) || a.entity_key) AS strength FROM seeds JOIN ent a ON a.document_id = seed JOIN ent b USING (etype, entity_key) WHERE b.document_id <> seed GROUP BY ALL")
def q_shared_metadata(spark, sf_dir):
    return graph.shared_neighbours(_seeds(spark, sf_dir), _entities(spark, sf_dir)).select("seed", "related", "strength")


OWNERS = f"own AS (SELECT n AS number_norm, min(id) AS document_id FROM (SELECT DISTINCT id, {_number('number')} AS n FROM legal_document) WHERE n <> '' GROUP BY n HAVING count(DISTINCT id) = 1)"


def _identifiers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "legal_document").select(F.col("id").alias("document_id"), X.number_norm("number").alias("number_norm")).where("number_norm <> ''").distinct()


@query(f"WITH {OWNERS} SELECT number_norm, document_id FROM own")
def q_unique_owner(spark, sf_dir):
    return graph.unique_owners(_identifiers(spark, sf_dir))


@query(f"WITH {OWNERS}, {SEEDS} SELECT DISTINCT seed, own.document_id AS related FROM seeds JOIN mention m ON m.document_id = seed JOIN own ON own.number_norm = m.number_norm WHERE own.document_id <> seed")
def q_cites(spark, sf_dir):
    found = graph.cited_neighbours(_seeds(spark, sf_dir), table(spark, sf_dir, "mention").select("document_id", "number_norm"), graph.unique_owners(_identifiers(spark, sf_dir)))
    return found.select("seed", "related")


@query(f"WITH {OWNERS}, {SEEDS} SELECT DISTINCT seed, m.document_id AS related FROM seeds JOIN own ON own.document_id = seed JOIN mention m ON m.number_norm = own.number_norm WHERE m.document_id <> seed")
def q_cited_by(spark, sf_dir):
    found = graph.citing_neighbours(_seeds(spark, sf_dir), table(spark, sf_dir, "mention").select("document_id", "number_norm"), graph.unique_owners(_identifiers(spark, sf_dir)))
    return found.select("seed", "related")


@query(f"""WITH {ENTITY}, {OWNERS}, {SEEDS},
    sh AS (SELECT seed, b.document_id AS related, count(*) AS strength FROM seeds JOIN ent a ON a.document_id = seed JOIN ent b USING (etype, entity_key) WHERE b.document_id <> seed GROUP BY seed, b.document_id
      QUALIFY row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, b.document_id) <= 36),
    ci AS (SELECT seed, own.document_id AS related FROM seeds JOIN mention m ON m.document_id = seed JOIN own ON own.number_norm = m.number_norm WHERE own.document_id <> seed GROUP BY ALL),
    cb AS (SELECT seed, m.document_id AS related FROM seeds JOIN own ON own.document_id = seed JOIN mention m ON m.number_norm = own.number_norm WHERE m.document_id <> seed GROUP BY ALL),
    rel AS (SELECT DISTINCT m.document_id AS source_id, own.document_id AS target_id, upper(kinds[1]) AS kind FROM mention m JOIN own ON own.number_norm = m.number_norm WHERE kinds[1] <> 'cites' AND m.document_id <> own.document_id),
    found AS (SELECT seed, related, 'shared_metadata' AS kind, 0.2 * strength AS score, 0 AS proof FROM sh
      UNION ALL SELECT seed, related, 'cites', 1.0, 0 FROM (SELECT * FROM ci QUALIFY row_number() OVER (PARTITION BY seed ORDER BY related) <= 36)
      UNION ALL SELECT seed, related, 'cited_by', 0.9, 0 FROM (SELECT * FROM cb QUALIFY row_number() OVER (PARTITION BY seed ORDER BY related) <= 36)
      UNION ALL SELECT seed, target_id, kind, 1.0, 1 FROM seeds JOIN rel ON source_id = seed UNION ALL SELECT seed, source_id, kind, 1.0, 1 FROM seeds JOIN rel ON target_id = seed),
    merged AS (SELECT seed, related, least(1.0, sum(score))::DOUBLE AS graph_score, list_sort(list(DISTINCT kind)) AS relations, max(proof) AS proof FROM found GROUP BY seed, related)
    SELECT seed AS query_id, related AS document_id, round(graph_score, 6) AS graph_score, relations FROM merged
    QUALIFY row_number() OVER (PARTITION BY seed ORDER BY proof DESC, round(graph_score, 9) DESC, related) <= 12""")
def q_expand_documents(spark, sf_dir):
    owners = graph.unique_owners(_identifiers(spark, sf_dir))
    mentions = table(spark, sf_dir, "mention").select("document_id", "number_norm", F.element_at("kinds", 1).alias("kind"))
    relations = mentions.where("kind <> 'cites'").join(owners.withColumnRenamed("document_id", "target_id"), "number_norm")
    relations = relations.select(F.col("document_id").alias("source_id"), "target_id", F.upper("kind").alias("kind"), F.col("number_norm").alias("evidence")).where("source_id <> target_id").distinct()
    found = graph.expand_documents(_seeds(spark, sf_dir), _entities(spark, sf_dir), mentions, owners, relations, 12)
    return found.select("query_id", "document_id", r6(F.col("graph_score")).alias("graph_score"), "relations")


EDGES = """edges AS (SELECT 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, l_returnflag AS kind, max(1 - l_discount) AS confidence, min(strftime(l_shipdate, '%Y-%m-%d')) AS valid_from FROM lineitem GROUP BY ALL)"""


def _edges(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.concat(F.lit("s"), "l_suppkey").alias("source_id"), F.concat(F.lit("p"), "l_partkey").alias("target_id"), F.col("l_returnflag").alias("kind")).agg(
        F.max(1 - F.col("l_discount")).alias("confidence"), F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("valid_from")
    )


@query(f"WITH {EDGES} SELECT source_id, target_id, kind, round(confidence, 6) AS confidence FROM edges WHERE confidence >= 0.95 AND valid_from <= '1995-06-01' AND kind IN ('A', 'R')")
def q_edges_asof(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("valid_to", F.lit("")).withColumn("temporal_status", F.lit("known"))
    kept = edges.where(F.col("kind").isin("A", "R") & (F.col("confidence") >= 0.95) & graph.as_of("1995-06-01"))
    return kept.select("source_id", "target_id", "kind", r6(F.col("confidence")).alias("confidence"))


@query(f"""WITH {EDGES}, step AS (SELECT source_id AS a, target_id AS b FROM edges WHERE kind = 'R' UNION SELECT target_id, source_id FROM edges WHERE kind = 'R'),
    d1 AS (SELECT DISTINCT b AS node FROM step WHERE a = 's1'), d2 AS (SELECT DISTINCT step.b AS node FROM d1 JOIN step ON a = node)
    SELECT 's1' AS query_id, 's1' AS node, 0 AS depth UNION ALL SELECT 's1', node, 1 FROM d1 UNION ALL SELECT 's1', node, 2 FROM d2 WHERE node <> 's1' AND node NOT IN (SELECT node FROM d1)""")
def q_reachable(spark, sf_dir):
    edges = _edges(spark, sf_dir).where("kind = 'R'")
    return graph.reachable(spark.createDataFrame([("s1", "s1")], "query_id string, node string"), edges, 2)


@query(f"""WITH {EDGES}, kinds(flag, kind, weight) AS (VALUES ('R', 'AMENDS', 0.9::DOUBLE), ('A', 'CITES', 0.35::DOUBLE), ('N', 'SPECIFIES', 0.9::DOUBLE)),
    usable AS (SELECT source_id, target_id, k.kind, weight * confidence::DOUBLE AS gain FROM edges e JOIN kinds k ON k.flag = e.kind WHERE confidence >= 0.8),
    both_ AS (SELECT source_id AS a, target_id AS b, kind, gain FROM usable UNION ALL SELECT target_id, source_id, kind, gain FROM usable),
    steps AS (SELECT a, b, gain FROM both_ QUALIFY row_number() OVER (PARTITION BY a ORDER BY gain DESC, b, kind) <= 12),
    d0(query_id, node) AS (VALUES ('s1', 's1'), ('s2', 's2'), ('s3', 's3')),
    d1 AS (SELECT query_id, b AS node, max(gain) AS score FROM d0 JOIN steps ON a = node WHERE gain > 0 AND b <> query_id GROUP BY query_id, b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(gain) DESC, b) <= 60),
    used AS (SELECT query_id, count(*) AS n FROM d1 GROUP BY query_id),
    e2 AS (SELECT d1.query_id, b AS node, max(score * gain * 0.65) AS score FROM d1 JOIN steps ON a = node WHERE b <> query_id AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.query_id = d1.query_id AND x.node = b) GROUP BY d1.query_id, b),
    d2 AS (SELECT e2.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS place FROM e2)
    SELECT query_id, node, round(score, 6) AS score, 1 AS depth, 1 AS hops FROM d1 UNION ALL SELECT query_id, node, round(score, 6), 2, 2 FROM d2 JOIN used USING (query_id) WHERE place + n <= 60""")
def q_bfs(spark, sf_dir):
    edges = _edges(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "R", "AMENDS").when(F.col("kind") == "A", "CITES").otherwise("SPECIFIES"))
    seeds = spark.createDataFrame([("s1", "s1"), ("s2", "s2"), ("s3", "s3")], "query_id string, node string")
    return graph.expand_articles(seeds, graph.usable_edges(edges.drop("valid_from"), Expansion()), Expansion()).select("query_id", "node", r6(F.col("score")).alias("score"), "depth", F.size("path").alias("hops"))


@query(f"""WITH {EDGES} SELECT 'source' AS side, source_id AS node, kind, count(*) AS degree FROM edges GROUP BY ALL
    UNION ALL SELECT 'target', target_id, '', count(*) FROM edges GROUP BY ALL
    UNION ALL SELECT 'all', 'mostly other pairs', '', 1""")
def q_shuffled_edges(spark, sf_dir):
    """Degrees of the shuffled control graph (they must be those of the edges), and whether many pairs are new."""
    edges = cut(_edges(spark, sf_dir).select("source_id", "target_id", "kind"))
    shuffled = cut(graph.shuffled_edges(edges, 42))
    side = lambda name, node, kind: shuffled.groupBy(F.col(node).alias("node"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("degree")).select(F.lit(name).alias("side"), "node", "kind", "degree")
    old = edges.select("source_id", "target_id").distinct().withColumn("old", F.lit(1))
    pairs = shuffled.select("source_id", "target_id").distinct().join(old, ["source_id", "target_id"], "left")
    # Distinct pairs of the shuffled graph that the edges don't have, against the pairs of the edges: chance leaves few.
    fresh = pairs.agg(F.count_if(F.col("old").isNull()).alias("n")).crossJoin(old.agg(F.count(F.lit(1)).alias("m")))
    fresh = fresh.select(F.lit("all").alias("side"), F.lit("mostly other pairs").alias("node"), F.lit("").alias("kind"), (F.col("n") > 0.4 * F.col("m")).cast("bigint").alias("degree"))
    return side("source", "source_id", F.col("kind")).unionByName(side("target", "target_id", F.lit(""))).unionByName(fresh)


@query("""WITH a AS (SELECT DISTINCT id, parent_id, start_pos FROM provision WHERE level = 'Article' AND parent_id IS NOT NULL)
    SELECT "at", "to", distance FROM (SELECT x.id AS "at", y.id AS "to", abs(x.start_pos - y.start_pos) AS distance, row_number() OVER (PARTITION BY x.id ORDER BY abs(x.start_pos - y.start_pos), y.id) AS n
      FROM a x JOIN a y ON x.parent_id = y.parent_id AND x.id <> y.id) WHERE n <= 2""")
def q_siblings(spark, sf_dir):
    provisions = table(spark, sf_dir, "provision").select("id", "parent_id", "level", "start_pos").distinct()
    return graph.siblings(provisions, provisions.select(F.col("id").alias("article_id")), 2)


@query("""SELECT c_custkey, least(1.0, round(sum(0.2 * greatest(1, p)), 6))::DOUBLE AS score, count(*) AS n FROM
    (SELECT c_custkey, o_orderpriority, count(*) AS p FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY ALL) GROUP BY c_custkey""")
def q_saturating_score(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    strength = orders.groupBy("c_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("p"))
    return strength.groupBy("c_custkey").agg(r6(graph.saturating(F.col("p"), F.lit(0.2))).alias("score"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ENTITY}, m AS (SELECT a.document_id AS source_id, b.document_id AS target_id, etype, entity_key FROM ent a JOIN ent b USING (etype, entity_key) WHERE a.document_id <> b.document_id),
    c AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY source_id, etype, entity_key ORDER BY target_id) <= 5),
    o AS (SELECT source_id, target_id, count(DISTINCT etype || chr(31) || entity_key)::DOUBLE AS score FROM c GROUP BY ALL)
    SELECT source_id, target_id, 'entity' AS signal, score FROM o QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) <= 3""")
def q_entity_cap(spark, sf_dir):
    return candidates.entity_candidates(_entities(spark, sf_dir), 5, 3)


MERGED = f"""{OWNERS}, refs AS (SELECT DISTINCT m.document_id AS source_id, own.document_id AS target_id FROM mention m JOIN own USING (number_norm) WHERE m.document_id <> own.document_id)"""


@query(f"WITH {MERGED} SELECT source_id, target_id, 'reference' AS signal, 1.0::DOUBLE AS score FROM refs")
def q_reference_candidates(spark, sf_dir):
    return candidates.reference_candidates(table(spark, sf_dir, "mention").select("document_id", "number_norm"), graph.unique_owners(_identifiers(spark, sf_dir)))


SHORTLIST = f"""{ENTITY}, {MERGED}, dv AS (SELECT DISTINCT id, embedding FROM legal_document JOIN embeddings ON vec_id = coalesce(try_cast(regexp_replace(id, '[^0-9]', '', 'g') AS BIGINT), 0) % (SELECT count(*) FROM embeddings) WHERE id IS NOT NULL),
    cap AS (SELECT a.document_id AS source_id, b.document_id AS target_id, etype, entity_key FROM ent a JOIN ent b USING (etype, entity_key) WHERE a.document_id <> b.document_id
      QUALIFY row_number() OVER (PARTITION BY a.document_id, etype, entity_key ORDER BY b.document_id) <= 5),
    en AS (SELECT source_id, target_id, count(*)::DOUBLE AS score FROM cap GROUP BY source_id, target_id QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, target_id) <= 20),
    near AS (SELECT q.id AS source_id, p.id AS target_id, coalesce(round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9), 0) AS score FROM dv q, dv p),
    top AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) <= 21),
    dense AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM top WHERE source_id <> target_id QUALIFY rank <= 20),
    merged AS (SELECT source_id, target_id, max(explicit) AS explicit, max(shared) AS shared, max(rank_score) AS rank_score FROM (
      SELECT source_id, target_id, true AS explicit, 0.0 AS shared, 0.0 AS rank_score FROM refs UNION ALL SELECT source_id, target_id, false, score, 0.0 FROM en
      UNION ALL SELECT source_id, target_id, false, 0.0, 1.0 / (60 + rank) FROM dense) GROUP BY ALL),
    listed AS (SELECT *, row_number() OVER (PARTITION BY source_id, explicit ORDER BY rank_score DESC, shared DESC, target_id) AS place FROM merged),
    short AS (SELECT source_id, target_id, explicit, round(rank_score, 6) AS rank_score, place FROM listed WHERE explicit OR place <= 5)"""


@query(f"WITH {SHORTLIST} SELECT * FROM short")
def q_candidate_shortlist(spark, sf_dir):
    """All documents ask: shared entities, mentioned numbers, and the nearest vectors among all documents."""
    reference = q_reference_candidates(spark, sf_dir)
    entity = candidates.entity_candidates(_entities(spark, sf_dir), 5, 20)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ids = table(spark, sf_dir, "legal_document").where("id IS NOT NULL").select("id").distinct()
    place = F.pmod(F.expr("coalesce(try_cast(regexp_replace(id, '[^0-9]', '') AS bigint), 0)"), F.lit(vectors.count()))
    points = cut(ids.withColumn("vec_id", place).join(vectors, "vec_id").select("id", "embedding"))
    side = lambda name: points.select(F.col("id").alias(name), "embedding")
    # One more than wanted: a document's nearest is itself.
    near = search.dense_topk(side("target_id"), side("source_id"), 21, "target_id", "source_id").where("source_id <> target_id").drop("rank")
    dense = search.ranked(near, 20, "source_id", "target_id").withColumn("signal", F.lit("dense"))
    merged = candidates.merge_signals(candidates.signals(reference, entity, dense))
    return candidates.shortlist(cut(merged), 5).select("source_id", "target_id", "explicit", r6(F.col("rank_score")).alias("rank_score"), "place")


@query(f"""WITH {SHORTLIST}, turned AS (SELECT *, row_number() OVER (PARTITION BY explicit ORDER BY rank_score DESC, source_id, target_id) AS turn FROM short),
    once AS (SELECT * FROM turned QUALIFY row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY turn, explicit DESC, source_id) = 1)
    SELECT source_id, target_id, explicit, turn FROM once ORDER BY turn, explicit DESC LIMIT 100""")
def q_interleave(spark, sf_dir):
    pairs = q_candidate_shortlist(spark, sf_dir)
    return candidates.interleave(pairs, 100).select("source_id", "target_id", "explicit", "turn")


@query("""WITH c AS (SELECT DISTINCT id, document_id, chunk_index, section FROM document_chunk WHERE document_id IS NOT NULL AND id IS NOT NULL),
    k AS (SELECT *, coalesce(starts_with(section, 'Điều'), false) AS art, max(coalesce(starts_with(section, 'Điều'), false)) OVER (PARTITION BY document_id) AS has FROM c),
    p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS m FROM k WHERE art OR NOT has)
    SELECT document_id, id FROM p WHERE i IN (0, (m - 1) // 2) OR (m > 2 AND i = m - 1)""")
def q_representatives(spark, sf_dir):
    chunks = table(spark, sf_dir, "document_chunk").where("document_id IS NOT NULL AND id IS NOT NULL").select("id", "document_id", "chunk_index", F.coalesce("section", F.lit("")).alias("section")).distinct()
    return candidates.representatives(chunks, 3).select("document_id", "id")


@query("SELECT id FROM (SELECT DISTINCT id FROM provision WHERE level = 'Article') ORDER BY sha256(id), id LIMIT 100")
def q_hash_sample(spark, sf_dir):
    return candidates.hash_sample(table(spark, sf_dir, "provision").where("level = 'Article'").select("id").distinct(), 100)


@query("""WITH g AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'),
    r AS (SELECT l_orderkey AS qid, l_partkey AS item, min(l_linenumber) AS first FROM lineitem WHERE l_orderkey IN (SELECT qid FROM g) GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first, item) AS place FROM r QUALIFY place <= 3),
    h AS (SELECT p.qid, count(g.item) AS hits, min(CASE WHEN g.item IS NOT NULL THEN place END) AS best, coalesce(sum(CASE WHEN g.item IS NOT NULL THEN 1 / log2(place + 1) END), 0) AS dcg
      FROM p LEFT JOIN g ON p.qid = g.qid AND p.item = g.item GROUP BY p.qid), s AS (SELECT qid, count(*) AS gold FROM g GROUP BY qid)
    SELECT qid, (hits > 0)::INT::DOUBLE AS hit, round(hits / 3.0, 6) AS precision, round(hits / gold, 6) AS recall, round(coalesce(1.0 / best, 0), 6) AS mrr,
      round(dcg / CASE least(3, gold) WHEN 1 THEN 1 WHEN 2 THEN 1 + 1 / log2(3) ELSE 1.5 + 1 / log2(3) END, 6) AS ndcg,
      round(CASE WHEN hits > 0 THEN 2.0 * (hits / 3.0) * (hits / gold) / (hits / 3.0 + hits / gold) ELSE 0 END, 6) AS f1 FROM h JOIN s USING (qid)""")
def q_ranking_metrics(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    gold = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("item"))
    rankings = line.select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank")).join(gold.select("qid").distinct(), "qid", "left_semi")
    return evaluate.score_rankings(rankings, gold, 3).select("qid", *(r6(F.col(m)).alias(m) for m in evaluate.METRICS))


@query("SELECT event_type, count(*) AS questions, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def q_mode_summary(spark, sf_dir):
    return evaluate.mode_summary(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "questions", r6(F.col("p50")).alias("p50"), r6(F.col("p95")).alias("p95"))


RECALL = "(SELECT l_returnflag AS mode, l_linestatus AS grp, CASE WHEN l_linenumber % 3 = 0 THEN 0.0 WHEN l_linenumber % 3 = 1 THEN 0.5 ELSE 1.0 END AS recall FROM lineitem)"


@query(f"SELECT mode, grp, count(*) AS questions, count(*) FILTER (WHERE recall = 0) AS zero_hit, count(*) FILTER (WHERE recall < 1) AS incomplete, round(avg(recall), 6) AS recall FROM {RECALL} GROUP BY GROUPING SETS ((mode), (mode, grp))")
def q_failure_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS mode", "l_linestatus AS grp", "CASE WHEN l_linenumber % 3 = 0 THEN 0D WHEN l_linenumber % 3 = 1 THEN 0.5D ELSE 1D END AS recall")
    return evaluate.failure_summary(rows).withColumn("recall", r6(F.col("recall")))


@query(f"""SELECT mode, 'first' AS subset, count(*) FILTER (WHERE grp = 'F') AS questions, round(avg(recall) FILTER (WHERE grp = 'F'), 6) AS recall FROM {RECALL} GROUP BY mode
    UNION ALL SELECT mode, 'hit', count(*) FILTER (WHERE recall > 0), round(avg(recall) FILTER (WHERE recall > 0), 6) FROM {RECALL} GROUP BY mode""")
def q_coverage_subsets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS mode", "l_linestatus AS grp", "CASE WHEN l_linenumber % 3 = 0 THEN 0D WHEN l_linenumber % 3 = 1 THEN 0.5D ELSE 1D END AS recall")
    out = evaluate.subset_means(rows, {"first": F.col("grp") == "F", "hit": F.col("recall") > 0})
    return out.select("mode", "subset", "questions", r6(F.col("recall")).alias("recall"))


@query()
def q_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") - 150_000).alias("difference"))
    return evaluate.paired_bootstrap(rows)


@query("""WITH i AS (SELECT DISTINCT l_orderkey AS qid, l_returnflag AS mode, l_partkey AS item FROM lineitem), b AS (SELECT * FROM i WHERE mode = 'N'), g AS (SELECT DISTINCT l_orderkey AS qid, l_partkey AS item FROM lineitem WHERE l_quantity > 25),
    q AS (SELECT DISTINCT qid, mode FROM i WHERE qid IN (SELECT qid FROM b) AND qid IN (SELECT qid FROM g))
    SELECT qid, mode, (SELECT count(*) FROM i WHERE i.qid = q.qid AND i.mode = q.mode AND item NOT IN (SELECT item FROM b WHERE b.qid = q.qid) AND item IN (SELECT item FROM g WHERE g.qid = q.qid))::INT AS recovered,
      (SELECT count(*) FROM b WHERE b.qid = q.qid AND item NOT IN (SELECT item FROM i WHERE i.qid = q.qid AND i.mode = q.mode) AND item IN (SELECT item FROM g WHERE g.qid = q.qid))::INT AS lost,
      (SELECT count(*) FROM i WHERE i.qid = q.qid AND i.mode = q.mode AND item NOT IN (SELECT item FROM b WHERE b.qid = q.qid))::INT AS added FROM q""")
def q_against_baseline(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    items = line.select(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("mode"), F.col("l_partkey").alias("item")).distinct()
    gold = line.where("l_quantity > 25").select(F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("item"))
    return evaluate.against_baseline(items, gold, "N")


@query("""WITH a AS (SELECT DISTINCT doc_id, lower(trim(subject)) AS s FROM subject_label WHERE annotator = 'an1'), b AS (SELECT DISTINCT doc_id, lower(trim(subject)) AS s FROM subject_label WHERE annotator = 'an2')
    SELECT 'both' AS what, doc_id, s FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'first', doc_id, s FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def q_set_ops(spark, sf_dir):
    labels = table(spark, sf_dir, "subject_label").select("doc_id", F.lower(F.trim("subject")).alias("s"), "annotator")
    one = lambda a: labels.where(F.col("annotator") == a).select("doc_id", "s")
    both = one("an1").intersect(one("an2")).select(F.lit("both").alias("what"), "doc_id", "s")
    return both.unionByName(one("an1").subtract(one("an2")).select(F.lit("first").alias("what"), "doc_id", "s"))


@query("SELECT what, n FROM (SELECT event_type AS what, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, what LIMIT 3")
def q_most_common(spark, sf_dir):
    return evaluate.most_common(table(spark, sf_dir, "events").withColumnRenamed("event_type", "what"), "what", 3)


@query("""WITH p AS (SELECT DISTINCT number, id FROM legal_document WHERE number IS NOT NULL) SELECT number, id FROM p WHERE number IN (SELECT number FROM p GROUP BY number HAVING count(*) = 1) AND id IN (SELECT id FROM p GROUP BY id HAVING count(*) = 1)""")
def q_unambiguous(spark, sf_dir):
    return evaluate.unambiguous(table(spark, sf_dir, "legal_document").where("number IS NOT NULL"), "number", "id").select("number", "id")


@query("""WITH c AS (SELECT DISTINCT id AS item_id, document_id, text AS body FROM provision WHERE level = 'Clause' AND text IS NOT NULL), a AS (SELECT DISTINCT id AS article_id, document_id, text FROM provision WHERE level = 'Article'),
    per AS (SELECT item_id, count(DISTINCT article_id) AS n, min(article_id) AS article_id FROM c JOIN a USING (document_id) WHERE length(body) >= 30 AND contains(text, body) GROUP BY item_id),
    sh AS (SELECT article_id, count(*) AS items FROM per WHERE n = 1 GROUP BY 1)
    SELECT i.item_id, CASE WHEN n IS NULL THEN 'no_exact_article_match' WHEN n > 1 THEN 'ambiguous' WHEN items > 1 THEN 'multiple_original_ids' ELSE 'mapped' END AS outcome,
      CASE WHEN n = 1 AND items = 1 THEN per.article_id END AS article_id FROM (SELECT DISTINCT item_id FROM c) i LEFT JOIN per USING (item_id) LEFT JOIN sh ON sh.article_id = per.article_id""")
def q_substring_map(spark, sf_dir):
    rows = table(spark, sf_dir, "provision").select("id", "document_id", "level", "text").distinct()
    passages = rows.where("level = 'Clause' AND text IS NOT NULL").select(F.col("id").alias("item_id"), "document_id", F.col("text").alias("body"))
    articles = rows.where("level = 'Article'").select(F.col("id").alias("article_id"), "document_id", F.col("text").alias("body"))
    return evaluate.mapped_passages(passages, articles, "document_id")


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_valid(props) AS valid FROM events")
def q_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("""SELECT event_id, list_sort(list_filter(s, lambda x: list_contains(['S1', 'S2'], x))) AS valid, list_sort(list_filter(s, lambda x: NOT list_contains(['S1', 'S2'], x))) AS invalid FROM
    (SELECT event_id, list_distinct(regexp_extract_all('See [S' || user_id % 4 || '] and [S' || event_id % 3 || '].', '\\[(S\\d+)\\]', 1)) AS s FROM events)""")
def q_citations(spark, sf_dir):
    answer = F.concat(F.lit("See [S"), F.col("user_id") % 4, F.lit("] and [S"), F.col("event_id") % 3, F.lit("]."))
    cited = X.citations(answer, F.array(F.lit("S1"), F.lit("S2")))
    return table(spark, sf_dir, "events").select("event_id", cited.alias("c")).select("event_id", F.array_sort("c.valid").alias("valid"), F.array_sort("c.invalid").alias("invalid"))


@query("""SELECT id, document_id, CASE WHEN regexp_full_match(label, '(?i)điều\\s+\\d+[a-zđ]?') THEN document_id || ':article:' || lower(regexp_extract(label, '(?i)^điều\\s+(\\d+[a-zđ]?)$', 1)) ELSE '' END AS article_id FROM provision WHERE document_id IS NOT NULL AND label IS NOT NULL""")
def q_article_id(spark, sf_dir):
    return table(spark, sf_dir, "provision").where("document_id IS NOT NULL AND label IS NOT NULL").select("id", "document_id", X.article_id("document_id", "label").alias("article_id"))


@query("""SELECT doc_id, round(len(list_intersect(['lao', 'động', 'hợp', 'đồng'], coalesce(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), []))) / 4.0, 6) AS overlap FROM documents WHERE text IS NOT NULL""")
def q_token_overlap(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", r6(X.token_overlap(F.lit("hợp đồng lao động"), "text")).alias("overlap"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 51")
def q_page(spark, sf_dir):
    return search.page(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 50, 100, "vec_id")


@query("SELECT 'chunks' AS label, count(*) AS n FROM document_chunk UNION ALL SELECT 'documents', count(*) FROM legal_document UNION ALL SELECT 'provisions', count(*) FROM provision")
def q_stats(spark, sf_dir):
    return graph.graph_stats(chunks=table(spark, sf_dir, "document_chunk"), documents=table(spark, sf_dir, "legal_document"), provisions=table(spark, sf_dir, "provision"))


@query("""WITH d AS (SELECT id, coalesce(count(DISTINCT c.id), 0) AS n FROM (SELECT DISTINCT id FROM legal_document) l LEFT JOIN document_chunk c ON c.document_id = l.id GROUP BY ALL) SELECT * FROM d""".replace("SELECT id,", "SELECT l.id AS id,"))
def q_chunk_counts(spark, sf_dir):
    counts = table(spark, sf_dir, "document_chunk").select("id", "document_id").distinct().groupBy("document_id").agg(F.countDistinct("id").alias("n"))
    documents = table(spark, sf_dir, "legal_document").select("id").distinct()
    return documents.join(counts, documents["id"] == counts["document_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def _documents(spark, sf_dir) -> DataFrame:
    return earliest_rows(table(spark, sf_dir, "legal_document"))


@query()
def q_chunks(spark, sf_dir):
    return chunking.chunk_documents(_documents(spark, sf_dir)).select("id", "document_id", "chunk_index", "section", F.length("text").alias("chars"))


@query()
def q_structure(spark, sf_dir):
    return chunking.parse_structure(_documents(spark, sf_dir)).select("id", "document_id", "parent_id", "level", "label", "start_pos", "end_pos")


@query(f"""WITH d AS (SELECT id, coalesce(full_text, '') AS x, {_number("nfc_normalize(coalesce(number, ''))")} AS own FROM legal_document WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1),
    parts AS (SELECT id, own, unnest(regexp_extract_all(x, '(?:^|[^\\p{{L}}\\p{{N}}_])(?i:(\\p{{Nd}}{{1,4}}{WS}*/{WS}*(?:\\p{{Nd}}{{4}}{WS}*/{WS}*)?[A-ZĐ][A-ZĐ0-9]*(?:{WS}*-{WS}*[A-ZĐ0-9]+)*))(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)) AS written FROM d),
    named AS (SELECT id, own, {_number('nfc_normalize(written)')} AS number_norm FROM parts)
    SELECT id AS document_id, number_norm, count(*)::INT AS mention_count FROM named WHERE number_norm <> own GROUP BY id, number_norm""")
def q_mentions(spark, sf_dir):
    return chunking.mentions(_documents(spark, sf_dir)).select("document_id", "number_norm", "mention_count")


@query()
def q_chunk_articles(spark, sf_dir):
    documents = _documents(spark, sf_dir)
    return chunking.map_chunks(chunking.parse_structure(documents), chunking.chunk_documents(documents))


@query()
def q_article_citations(spark, sf_dir):
    documents = cut(_documents(spark, sf_dir).select("id", "title", "number", "full_text", "effective_date", "expiry_date", "status"))
    chunks, provisions = cut(chunking.chunk_documents(documents)), cut(chunking.parse_structure(documents))
    mapping, owners = cut(chunking.map_chunks(provisions, chunks)), graph.unique_owners(_identifiers(spark, sf_dir))
    proposed = chunking.article_citations(chunks, mapping, owners).withColumn("bridge", validate.no_bridge())
    return validate.article_relations(proposed, chunks, mapping, documents, owners)


@query(f"""WITH {MERGED}, d AS (SELECT id, any_value(effective_date) AS f, any_value(expiry_date) AS u, any_value(coalesce(status, '')) AS st FROM legal_document WHERE id IS NOT NULL GROUP BY id),
    iso AS (SELECT id, st, coalesce(u, '') AS raw, CASE WHEN regexp_full_match(f, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_strptime(f, '%Y-%m-%d') IS NOT NULL THEN f ELSE '' END AS f,
      CASE WHEN regexp_full_match(u, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_strptime(u, '%Y-%m-%d') IS NOT NULL THEN u ELSE '' END AS u FROM d),
    both_ AS (SELECT source_id, target_id, greatest(a.f, b.f) AS vf, coalesce(least(nullif(a.u, ''), nullif(b.u, '')), '') AS vt, a.f <> '' AND b.f <> '' AND (a.raw = '' OR a.u <> '') AND (b.raw = '' OR b.u <> '')
      AND (NOT regexp_matches(a.st, '(?i)hết hiệu lực|ngưng hiệu lực') OR a.u <> '') AND (NOT regexp_matches(b.st, '(?i)hết hiệu lực|ngưng hiệu lực') OR b.u <> '') AS known
      FROM refs JOIN iso a ON a.id = source_id JOIN iso b ON b.id = target_id)
    SELECT source_id, target_id, CASE WHEN known THEN vf ELSE '' END AS valid_from, CASE WHEN known THEN vt ELSE '' END AS valid_to, CASE WHEN known THEN 'known' ELSE 'unknown' END AS temporal_status,
      known AND vt <> '' AND vf >= vt AS empty FROM both_""")
def q_temporal_validity(spark, sf_dir):
    documents = _documents(spark, sf_dir).select("id", "effective_date", "expiry_date", "status")
    pairs = q_reference_candidates(spark, sf_dir).select("source_id", "target_id")
    for end in ("source", "target"):
        pairs = pairs.join(documents.select(F.col("id").alias(f"{end}_id"), *(F.col(c).alias(f"{end}_{c}") for c in ("effective_date", "expiry_date", "status"))), f"{end}_id")
    span = validate.validity(F.lit("CITES"), "source_effective_date", "source_expiry_date", "source_status", "target_effective_date", "target_expiry_date", "target_status")
    return pairs.select("source_id", "target_id", span.alias("v")).select("source_id", "target_id", "v.*")


@query()
def q_document_relations(spark, sf_dir):
    chunks = table(spark, sf_dir, "document_chunk").where("text IS NOT NULL").dropDuplicates(["id"]).select("id", "document_id", X.chunk_body("text").alias("body"))
    owners = graph.unique_owners(_identifiers(spark, sf_dir))
    spans = chunking.reference_spans(chunks, "id", "body").withColumnRenamed("source_id", "source_chunk_id")
    proposals = spans.join(chunks.select(F.col("id").alias("source_chunk_id"), F.col("document_id").alias("source_id"), "body"), "source_chunk_id").join(owners.withColumnRenamed("document_id", "target_id"), "number_norm")
    proposals = proposals.where("source_id <> target_id").select(
        "source_id", "target_id", F.col("source_id").alias("candidate_source"), F.col("target_id").alias("candidate_target"), F.upper("kind").alias("kind"), "source_chunk_id", F.lit("").alias("target_chunk_id"),
        F.expr("substring(body, greatest(1, start_pos - 79), end_pos - start_pos + 80)").alias("evidence"),
    )
    return validate.document_relations(proposals, chunks, owners)


HYBRID = f"""{VECTORS}, words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    post AS (SELECT doc_id, term, count(*) AS tf, any_value(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM words) GROUP BY doc_id, term),
    idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
    bm AS (SELECT q.doc_id AS query_id, p.doc_id, round(sum(idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.l / 256.0))), 9) AS score FROM post q JOIN post p USING (term) JOIN idf USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL),
    de AS (SELECT q.doc_id AS query_id, p.doc_id, coalesce(round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9), 0) AS score FROM pts q, pts p WHERE q.doc_id % 100 = 0),
    al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 30 UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM de QUALIFY r <= 30),
    fu AS (SELECT query_id, doc_id, sum(1.0 / (60 + r)) AS score FROM al GROUP BY query_id, doc_id)
    SELECT query_id, doc_id AS id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id)::INT AS rank FROM fu QUALIFY rank <= 10"""


@query(f"WITH {HYBRID}")
def q_hybrid(spark, sf_dir):
    """Every document is a point, and every one whose id is divisible by 100 asks, with its whole text and its vector."""
    points = _points(spark, sf_dir)
    asked = points.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    return search.search(points, asked, "auto", 10).select("query_id", "id", r6(F.col("score")).alias("score"), "rank")


@query()
def q_index_recall(spark, sf_dir):
    """How many of the ten nearest points of all questions the inverted-file index finds; questions are the ids divisible by 100, points all rows."""
    points = cut(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    cells = search.fit_cells(points)
    asked = points.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = search.indexed_topk(cut(search.index_cells(points, cells)), cells, asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    exact = search.dense_topk(points, asked, 10).select("query_id", "id")
    return exact.join(found, ["query_id", "id"], "left").agg(F.count(F.lit(1)).alias("pairs"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


@query("""WITH RECURSIVE ordered AS (SELECT source, doc_id::VARCHAR AS id, law_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id::VARCHAR) AS n
      FROM documents WHERE n_chars > 0 AND n_chars <= 18000 AND source IS NOT NULL),
    walk AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS used, 0 AS place, []::VARCHAR[] AS laws, NULL::VARCHAR AS id, 0::BIGINT AS chars, false AS taken FROM (SELECT DISTINCT source FROM ordered)
      UNION ALL SELECT source, n, CASE WHEN good THEN used + n_chars ELSE used END, CASE WHEN good THEN place + 1 ELSE place END, CASE WHEN good THEN list_append(laws, law_id) ELSE laws END, id, n_chars, good FROM
        (SELECT o.source, o.n, w.used, w.place, w.laws, o.id, o.n_chars, o.law_id,
          w.place < 10 AND w.used + o.n_chars <= 18000 AND (o.law_id IS NULL OR len(list_filter(w.laws, lambda x: x = o.law_id)) < 2) AS good FROM walk w JOIN ordered o ON o.source = w.source AND o.n = w.n + 1))
    SELECT source AS query_id, id, chars, place FROM walk WHERE taken""")
def q_budget_select(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").where("n_chars > 0 AND source IS NOT NULL").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("id"), F.col("law_id").alias("document_id"), F.col("n_chars").alias("chars"))
    return retrieve.budget_select(hits, [F.desc("chars")], 10, 18_000, 2).select("query_id", "id", "chars", "place")


@query()
def q_retrieve(spark, sf_dir):
    chunks = table(spark, sf_dir, "document_chunk").where("text IS NOT NULL AND document_id IS NOT NULL").dropDuplicates(["id"])
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    place = F.pmod(F.xxhash64("text"), F.lit(vectors.count()))
    points = cut(chunks.select("id", "document_id", F.length("text").alias("chars"), "text").withColumn("vec_id", place).join(vectors, "vec_id").drop("vec_id"))
    asked = points.where("try_cast(document_id AS bigint) % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    seed_hits = cut(search.dense_topk(points, asked, 20)).join(points.select("id", "document_id", "chars"), "id")
    seeds = retrieve.distinct_seeds(seed_hits, 5).select("query_id", "seed")
    owners = graph.unique_owners(_identifiers(spark, sf_dir))
    mentions = table(spark, sf_dir, "mention").select("document_id", "number_norm", F.trim("number").alias("number"), "kinds")
    # A relation's evidence is a chunk whose body has the number as its document writes it.
    named = mentions.join(owners.withColumnRenamed("document_id", "target_id"), "number_norm").where("document_id <> target_id")
    named = named.select("document_id", "target_id", "number", F.explode("kinds").alias("kind")).where("kind <> 'cites'").distinct()
    bodies = chunks.select("id", "document_id", X.chunk_body("text").alias("body"))
    relations = named.join(bodies, "document_id").where(F.col("body").contains(F.col("number")))
    relations = cut(relations.select(F.col("document_id").alias("source_id"), "target_id", F.upper("kind").alias("kind"), F.col("id").alias("evidence")).distinct())
    neighbours = cut(graph.expand_documents(cut(seeds), _entities(spark, sf_dir), mentions, owners, relations, 12))
    near = points.join(neighbours.select("query_id", "document_id"), "document_id").select("query_id", "id").distinct()
    near_hits = search.ranked(search.confirm(points, near, asked), 20).join(points.select("id", "document_id", "chars"), "id")
    proof = neighbours.select("query_id", F.explode("evidence").alias("e")).select("query_id", F.get_json_object("e", "$.evidence").alias("id"))
    evidence_hits = search.confirm(points, proof, asked).join(points.select("id", "document_id", "chars"), "id")
    return retrieve.retrieve(seed_hits, near_hits, evidence_hits, neighbours, 10, 18_000, 2).select("query_id", "id", "document_id", r6(F.col("final_score")).alias("final_score"), "place")


@query()
def q_article_scores(spark, sf_dir):
    provisions = table(spark, sf_dir, "provision").where("level = 'Article' AND text IS NOT NULL").select(F.col("id").alias("article_id"), F.col("document_id").alias("query_id"), "start_pos", F.length("text").alias("chars"), "text").dropDuplicates(["article_id"])
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("start_pos", "article_id"))
    scored = provisions.withColumn("rank", rank).withColumn("cosine", F.lit(None).cast("double")).withColumn("overlap", X.token_overlap(F.lit("thời hạn và kinh phí"), "text")).withColumn("graph_score", F.when(F.col("rank") % 2 == 0, 0.5))
    return retrieve.retrieve_articles(scored.drop("text"), Expansion(), 5, 6_000).select("query_id", "article_id", r6(F.col("score")).alias("score"), "place")


@query("""WITH d AS (SELECT * FROM legal_document WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1),
    latest AS (SELECT * FROM ingest_state QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY changed_at DESC, index_status DESC) = 1),
    held AS (SELECT document_id, count(*) AS held FROM (SELECT DISTINCT id, document_id FROM document_chunk) GROUP BY document_id),
    done AS (SELECT document_id FROM latest LEFT JOIN held USING (document_id) WHERE index_status = 'ready' AND coalesce(held, 0) = chunk_count)
    SELECT id, sha256('1|' || sha256(concat_ws(chr(31), coalesce(id, ''), coalesce(title, ''), coalesce(full_text, ''), coalesce(number, ''), coalesce(document_type, ''), coalesce(sector, ''), coalesce(issued_date, ''),
      coalesce(field, ''), coalesce(effective_date, ''), coalesce(status, ''), coalesce(expiry_date, ''), coalesce(agency, ''), coalesce(signer_position, ''), coalesce(signer, ''))) || '|stub|1800|250') AS index_hash
    FROM d WHERE id NOT IN (SELECT document_id FROM done WHERE document_id IS NOT NULL)""")
def q_ingest_pending(spark, sf_dir):
    documents = ingest.with_hash(_documents(spark, sf_dir), ingest.Settings())
    state = sinks.latest(table(spark, sf_dir, "ingest_state"), ["document_id"], [F.desc("changed_at"), F.desc("index_status")])
    hashes = documents.select(F.col("id").alias("document_id"), "index_hash")
    return ingest.pending(documents, state.join(hashes, "document_id"), table(spark, sf_dir, "document_chunk").select("id", "document_id").distinct()).select("id", "index_hash")


def _chunk_vectors(spark, sf_dir, chunks: DataFrame) -> DataFrame:
    """``chunks`` with a vector each."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    place = F.pmod(F.expr("coalesce(try_cast(regexp_replace(document_id, '[^0-9]', '') AS bigint), 0)") + F.col("chunk_index"), F.lit(vectors.count()))
    return chunks.withColumn("vec_id", place).join(vectors, "vec_id").drop("vec_id")


def _article_corpus(spark, sf_dir) -> tuple[articles.Corpus, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The articles of all documents with vectors, and relations: an article that names a document's number leads to that document's first article."""
    documents = cut(_documents(spark, sf_dir).select("id", "title", "number", "full_text", "effective_date", "expiry_date", "status"))
    chunks, provisions = cut(chunking.chunk_documents(documents)), cut(chunking.parse_structure(documents))
    mapping, owners = cut(chunking.map_chunks(provisions, chunks)), cut(graph.unique_owners(_identifiers(spark, sf_dir)))
    points = cut(_chunk_vectors(spark, sf_dir, chunks).select("id", "document_id", "text", "embedding"))
    owned = mapping.join(chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", F.substring("body", 1, 40).alias("quote")), "chunk_id")
    first = owned.groupBy(F.col("document_id").alias("target")).agg(F.min_by(F.struct("article_id", "chunk_id", "quote"), F.struct("chunk_index", "chunk_id")).alias("t"))
    spans = chunking.reference_spans(chunks, "id", "body").join(owners.withColumnRenamed("document_id", "target"), "number_norm").join(first, "target")
    spans = spans.join(owned.select(F.col("chunk_id").alias("source_id"), F.col("article_id").alias("source"), "document_id"), "source_id").where("document_id <> target")
    # "text" is the number as it is written: the quote of the relation.
    edges = spans.groupBy(F.col("source").alias("source_id"), F.col("t.article_id").alias("target_id"), F.upper("kind").alias("kind")).agg(
        F.min(F.struct(F.col("source_id").alias("source_chunk_id"), F.col("t.chunk_id").alias("target_chunk_id"), F.col("text").alias("evidence"), F.col("t.quote").alias("target_evidence"))).alias("e")
    )
    edges = cut(edges.select("source_id", "target_id", "kind", "e.*", F.lit(1.0).alias("confidence")))
    return articles.Corpus(points, mapping, edges), documents, chunks, provisions, owners


def _article_questions(chunks: DataFrame, points: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions from the words of every chunk of an article in a document whose id is divisible by 100, and the article that each is about."""
    asked = chunks.where("try_cast(regexp_replace(document_id, '[^0-9]', '') AS bigint) % 100 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(F.split("body", r"\s+"), 4, 14), " ").alias("text"))
    asked = asked.join(mapping.select(F.col("chunk_id").alias("query_id"), "article_id"), "query_id")
    asked = cut(asked.join(points.select(F.col("id").alias("query_id"), "embedding"), "query_id"))
    return asked.drop("article_id"), asked.select(F.col("query_id").alias("qid"), F.col("article_id").alias("item"))


@query()
def q_article_retrieval(spark, sf_dir):
    corpus, _, chunks, _, _ = _article_corpus(spark, sf_dir)
    asked, _ = _article_questions(chunks, corpus.points, corpus.mapping)
    got = articles.retrieve_articles(corpus, asked, Expansion(mode="M2", context_chars=18_000), 10)
    return got.selected.select("query_id", "article_id", "chunk_id", "rank", r6(F.col("graph_score")).alias("graph_score"), r6(F.col("score")).alias("score"), "place")


@query()
def q_configurations(spark, sf_dir):
    corpus, _, chunks, _, _ = _article_corpus(spark, sf_dir)
    asked, gold = _article_questions(chunks, corpus.points, corpus.mapping)
    rows = articles.configurations(corpus, asked, gold, corpus.mapping.select(F.col("article_id").alias("item")))
    means = (F.avg(c).alias(c) for c in (*evaluate.METRICS, "candidate_recall"))
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("questions"), *means, F.sum("recovered").alias("recovered"), F.sum("lost").alias("lost"), F.sum("reached_2").alias("reached_2"))


@query()
def q_article_relations(spark, sf_dir):
    """Candidates of every article of a document whose id is divisible by 100, against all articles; relations as a fixed responder proposes them.

    Every candidate pair is proposed.  Texts are made again from the documents where they are needed, not kept.
    """
    texts = _documents(spark, sf_dir).select("id", "title", "number", "full_text", "effective_date", "expiry_date", "status")
    documents = cut(texts.drop("full_text", "title"))
    chunks, provisions = chunking.chunk_documents(texts).drop("text"), chunking.parse_structure(texts)
    named = cut(chunks.select("id", "document_id", "chunk_index", "section"))
    mapping, owners = cut(chunking.map_chunks(provisions.drop("text"), named)), cut(graph.unique_owners(_identifiers(spark, sf_dir)))
    sources = cut(mapping.where(F.expr("try_cast(regexp_extract(article_id, '([0-9]+):article:', 1) AS bigint) % 100 = 0")).select("article_id").distinct())
    points = _chunk_vectors(spark, sf_dir, named)
    found = articles.relation_candidates(chunks, mapping, points, owners, sources).select("source_id", "target_id", "chunks", "rank_score", "explicit")
    pairs = candidates.interleave(cut(found), None)
    built = articles.build_article_relations(documents, chunks, mapping, owners, provisions, pairs, pipelines.quoting_responder, lambda asked: ['{"supported": true}'] * len(asked))
    return built.relations.select("source_id", "target_id", "kind", "method", "source_chunk_id", "target_chunk_id")
