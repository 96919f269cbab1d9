"""TF-IDF: fit on long tables or in one pass over rows, cosine pairs, and best targets.

``similar_pairs`` makes every pair a row, by a self-join of the postings; it is for few texts.
``best_pairs`` takes the texts that ask in blocks, scores all texts against a block on arrays and
keeps each document's best, so that only those are shuffled; no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import let
from dossier.operators import search
from dossier.plans.shared import cut

#: Share of a block's texts from which a term's products are summed as a matrix, and numbers of the scores that are made at once.
HEAVY_SHARE, SCORE_NUMBERS = 0.08, 2_000_000
#: Texts whose grams are made at once.
GRAM_ROWS = 2_000


def word_tokens(c: str) -> Column:
    """Blank-separated tokens, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\S+"), F.lit(0))


def word_grams(c: str, low: int = 1, high: int = 4) -> Column:
    """Runs of ``low`` to ``high`` blank-separated tokens, lower-cased."""
    def runs(tokens: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda k: F.array_join(F.slice(tokens, k, n), " "))
        return F.when(F.size(tokens) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(word_tokens(c), lambda t: F.concat(*(runs(t, n) for n in range(low, high + 1))))


def char_grams(c: str, low: int = 3, high: int = 5) -> Column:
    """Runs of ``low`` to ``high`` characters, lower-cased."""
    def runs(value: Column, n: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.length(value) - n + 1), lambda k: F.substring(value, k, F.lit(n)))
        return F.when(F.length(value) >= n, made).otherwise(F.array().cast("array<string>"))

    return let(F.lower(c), lambda v: F.concat(*(runs(v, n) for n in range(low, high + 1))))


def fit(texts: DataFrame, grams: Column, min_df: int = 2, max_df: float = 0.8, features: int | None = 50_000) -> DataFrame:
    """(id, term, w): rows of unit length; sublinear tf, smooth idf, most frequent ``features`` terms."""
    counts = texts.select("id", F.explode(grams).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("uses"))
    total = texts.agg(F.count(F.lit(1)).alias("__total"))
    kept = df.crossJoin(F.broadcast(total)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("__total")))
    if features:
        kept = kept.orderBy(F.desc("uses"), "term").limit(features)
    idf = kept.select("term", (F.log((1 + F.col("__total")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counts.join(idf, "term").select("id", "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("raw") / F.col("norm")).alias("w"))


def fit_or_relax(texts: DataFrame, grams: Column, **options) -> DataFrame:
    """``fit``; if no term passes the thresholds, once more with every term."""
    first = fit(texts, grams, **options)
    if first.limit(1).count():
        return first
    return fit(texts, grams, **(options | {"min_df": 1, "max_df": 1.0}))


def similar_pairs(weights: DataFrame, group: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, score) of all rows that share a term; ``group`` (id, document_id) leaves out pairs within a document, ``sources`` (document_id) is the query set."""
    asked = weights if sources is None else weights.join(group.join(sources, "document_id", "left_semi").select("id"), "id", "left_semi")
    left = asked.select(F.col("id").alias("source_id"), "term", F.col("w").alias("a"))
    right = weights.select(F.col("id").alias("target_id"), "term", F.col("w").alias("b"))
    scored = left.join(right, "term").where("source_id <> target_id").groupBy("source_id", "target_id").agg(F.sum(F.col("a") * F.col("b")).alias("score"))
    if group is not None:
        of = lambda name: group.select(F.col("id").alias(f"{name}_id"), F.col("document_id").alias(f"{name}_document"))
        scored = scored.join(of("source"), "source_id").join(of("target"), "target_id").where("source_document <> target_document")
    return scored.where("score > 0")


def best_targets(scored: DataFrame, number: int, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """The ``number`` best targets of each source with their rank; ties by target."""
    rank = F.row_number().over(W.partitionBy(source).orderBy(F.desc("score"), target))
    return scored.withColumn("rank", rank).where(F.col("rank") <= number)


def best_document_pairs(scored: DataFrame, number: int) -> DataFrame:
    """(source_document, target_document, score, source_id, target_id, rank): the best pair of parts of each pair of documents, ``number`` a source."""
    best = scored.groupBy("source_document", "target_document").agg(
        F.max("score").alias("score"),
        F.max_by(F.struct("source_id", "target_id"), F.struct("score", F.hash("source_id", "target_id"))).alias("pair"),
    )
    ranked = best_targets(best, number, "source_document", "target_document")
    return ranked.select("source_document", "target_document", "score", "pair.source_id", "pair.target_id", "rank")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, GRAM_ROWS):
            yield batch.slice(start, GRAM_ROWS)


def _grams(lists: pa.ListArray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """For each length: (row, gram, uses) of the runs of a batch's tokens, ordered by row, and the grams."""
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    words, tokens = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    runs, names = tokens, words
    for n in range(1, high + 1):
        if n > 1:
            whole = rows[: len(rows) - n + 1] == rows[n - 1 :]
            longer = np.where(whole, runs[: len(runs) - 1] * len(words) + tokens[n - 1 :], -1)
            found, firsts, runs = np.unique(longer, return_index=True, return_inverse=True)
            names = [" ".join(words[t] for t in tokens[k : k + n]) for k in firsts]
            if len(found) and found[0] < 0:
                runs, names = runs - 1, names[1:]
        if n >= low:
            # A run that would reach into the next row is -1.
            kept = runs >= 0
            held, uses = np.unique(rows[: len(runs)][kept] * max(1, len(names)) + runs[kept], return_counts=True)
            yield held // max(1, len(names)), held % max(1, len(names)), uses, names


def fit_vectors(texts: DataFrame, tokens: Column, low: int, high: int, columns: list[str], min_df: int = 2, max_df: float = 0.8, features: int = 50_000) -> DataFrame:
    """(columns, terms, w): as ``fit`` over runs of ``low`` to ``high`` tokens, one row for each text that has a term; as ``fit_or_relax`` if no term passes.

    Texts stay where they are: what is shuffled is a row for each gram and task, and the vocabulary, at most ``features``
    grams, is held by every task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            terms, df, uses = [None], [np.array([batch.num_rows])], [np.array([0])]
            for _, grams, n, names in _grams(batch.column(0), low, high):
                terms += names
                df.append(np.bincount(grams, minlength=len(names)))
                uses.append(np.bincount(grams, n, len(names)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.concatenate(df)), pa.array(np.concatenate(uses))], names=["term", "df", "uses"])

    rows = texts.select(tokens.alias("__tokens"), *columns)
    each = rows.select("__tokens").mapInArrow(count, "term string, df bigint, uses bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("uses").alias("uses"))
    counts = cut(each.where((F.col("df") >= min_df) | F.col("term").isNull()))
    total = (counts.where("term IS NULL").first() or {"df": 0})["df"]
    kept = counts.where(F.col("term").isNotNull() & (F.col("df") <= max_df * total)).orderBy(F.desc("uses"), "term").limit(features)
    vocabulary = [(r["term"], r["df"]) for r in kept.collect()]  # bounded by ``features``
    if not vocabulary and (min_df > 1 or max_df < 1):
        return fit_vectors(texts, tokens, low, high, columns, 1, 1.0, features)
    idf = np.log((1 + total) / (1 + np.array([n for _, n in vocabulary], dtype=np.float64))) + 1
    held = rows.sparkSession.sparkContext.broadcast(({t: k for k, (t, _) in enumerate(vocabulary)}, idf))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, idf = held.value
        for batch in _slices(batches):
            parts = []
            for texts, grams, n, names in _grams(batch.column(0), low, high):
                known = np.array([places.get(name, -1) for name in names], dtype=np.int64)[grams] if len(grams) else grams
                parts.append(np.stack([texts, known, n])[:, known >= 0])
            at, terms, n = (found := np.concatenate(parts, axis=1))[:, np.lexsort((found[1], found[0]))]
            raw = (1 + np.log(n)) * idf[terms]
            w = raw / np.sqrt(np.bincount(at, raw * raw, batch.num_rows))[at]
            bounds = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
            made = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x)) for x in (terms.astype(np.int32), w)]
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*columns, "terms", "w"])
            yield out.filter(pa.array(np.diff(bounds) > 0))

    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(weigh, schema)


def vector_rows(weights: DataFrame) -> DataFrame:
    """(id, document_id, terms, w): the long table ``weights`` as one row for each text, which is its own document."""
    rows = weights.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    return rows.select("id", F.col("id").alias("document_id"), F.col("v.term").alias("terms"), F.col("v.w").alias("w"))


def _entries(terms: pa.ListArray, weights: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(term, weight, row) of all entries of a batch of vectors."""
    sizes = np.diff(terms.offsets.to_numpy())
    return terms.flatten(), weights.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


class _Block:
    """Texts that ask, ordered by their document: posting lists of their terms, and a matrix of those that many of them hold."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("document_id", "ascending"), ("id", "ascending")]).combine_chunks()
        whole = lambda name: pa.concat_arrays(rows.column(name).chunks) if rows.num_rows else rows.schema.field(name).type
        self.number = rows.num_rows
        self.ids, self.documents = rows.column("id").to_pylist(), []
        owners = rows.column("document_id").to_pylist()
        self.starts = np.array([k for k, d in enumerate(owners) if not k or d != owners[k - 1]], dtype=np.int64)
        self.documents = [owners[k] for k in self.starts]
        self.places = {d: k for k, d in enumerate(self.documents)}
        terms, weights, texts = _entries(whole("terms"), whole("w")) if rows.num_rows else (pa.array([], pa.string()), np.empty(0), np.empty(0, np.int64))
        coded = terms.dictionary_encode()
        self.terms = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
        codes = coded.indices.to_numpy().astype(np.int64)
        counts = np.bincount(codes, minlength=len(self.terms))
        heavy = counts >= max(2, HEAVY_SHARE * self.number)
        self.heavy = np.where(heavy, np.cumsum(heavy) - 1, -1)
        self.matrix = np.zeros((int(heavy.sum()), self.number))
        dense = heavy[codes]
        self.matrix[self.heavy[codes[dense]], texts[dense]] = weights[dense]
        order = np.argsort(codes[~dense], kind="stable")
        self.asked, self.weights = texts[~dense][order], weights[~dense][order]
        self.sizes = np.where(heavy, 0, counts)
        self.firsts = np.cumsum(self.sizes) - self.sizes

    def scores(self, terms: pa.ListArray, weights: pa.ListArray) -> np.ndarray:
        """The products of each text of a batch (rows) with each of the block (columns)."""
        held, w, rows = _entries(terms, weights)
        coded = held.dictionary_encode()
        codes = np.array([self.terms.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()] if len(held) else np.empty(0, np.int64)
        met = codes >= 0
        codes, w, rows = codes[met], w[met], rows[met]
        dense = self.heavy[codes] >= 0
        mine = np.zeros((len(terms), len(self.matrix)))
        mine[rows[dense], self.heavy[codes[dense]]] = w[dense]
        out = mine @ self.matrix
        codes, w, rows = codes[~dense], w[~dense], rows[~dense]
        bounds = np.searchsorted(rows, np.arange(len(terms) + 1))
        for n in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[n], bounds[n + 1])
            sizes = self.sizes[codes[part]]
            places = np.repeat(self.firsts[codes[part]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            out[n] += np.bincount(self.asked[places], np.repeat(w[part], sizes) * self.weights[places], self.number)
        return out


class _BestPairs:
    """The ``k`` documents nearest to each document of a block so far, each with its best pair of texts; equal scores by document, then by the texts."""

    def __init__(self, block: _Block, k: int, decimals: int):
        self.block, self.k, self.decimals = block, k, decimals
        self.rows: list[list[tuple]] = [[] for _ in block.documents]
        self.bars = np.full(len(block.documents), -np.inf)

    def add(self, scores: np.ndarray, ids: list, documents: list) -> None:
        """``scores`` of texts ``ids`` of ``documents``, which are in order."""
        block = self.block
        starts = np.array([k for k, d in enumerate(documents) if not k or d != documents[k - 1]], dtype=np.int64)
        stops, ends = [*starts[1:], len(documents)], [*block.starts[1:], block.number]
        best = scores.copy() if len(starts) == len(documents) else np.maximum.reduceat(scores, starts, axis=0)
        best = best if len(block.starts) == block.number else np.maximum.reduceat(best, block.starts, axis=1)
        for n, start in enumerate(starts):
            if (own := block.places.get(documents[start])) is not None:
                best[n, own] = 0
        # Scores are rounded only where they may reach the bar.
        better = best >= np.maximum(self.bars - 10.0**-self.decimals, np.nextafter(0, 1))
        for asked in np.flatnonzero(better.any(axis=0)):
            places = np.flatnonzero(better[:, asked])
            column = np.round(best[places, asked], self.decimals)
            if len(places) > self.k:
                kept = column >= np.partition(column, len(places) - self.k)[len(places) - self.k]
                places, column = places[kept], column[kept]
            found = []
            for n, score in zip(places, column):
                if score < self.bars[asked]:
                    continue
                tile = np.round(scores[starts[n] : stops[n], block.starts[asked] : ends[asked]], self.decimals)
                pair = min((block.ids[block.starts[asked] + q], ids[starts[n] + p]) for p, q in np.argwhere(tile == score))
                found.append((-float(score), documents[starts[n]], *pair))
            if not found:
                continue
            once: dict = {}
            for row in sorted([*self.rows[asked], *found]):
                once.setdefault(row[1], row)
            self.rows[asked] = list(once.values())[: self.k]
            if len(self.rows[asked]) == self.k:
                self.bars[asked] = -self.rows[asked][-1][0]

    def table(self, text: pa.DataType, document: pa.DataType) -> pa.RecordBatch:
        rows = [(d, *row) for d, found in zip(self.block.documents, self.rows) for row in found]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (document, pa.float64(), document, text, text)
        made = [pa.array(c, kind) for c, kind in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([made[0], made[2], pa.array([-x for x in columns[1]], pa.float64()), made[3], made[4]], names=["source_document", "target_document", "score", "source_id", "target_id"])


def best_pairs(vectors: DataFrame, number: int, asked: DataFrame | None = None, decimals: int = 9) -> DataFrame:
    """(source_document, target_document, score, source_id, target_id, rank): the ``number`` other documents nearest to each document that asks.

    ``vectors`` and ``asked`` (all vectors by default) have (id, document_id, terms, w).  The score of two documents is
    that of their best pair of texts, rounded to ``decimals``; only documents that share a term are paired; ties by
    target.  A document among the best of all has its best text in some task, and is there among that task's best too.
    """
    vectors = vectors.where("id IS NOT NULL AND document_id IS NOT NULL").select("id", "document_id", "terms", "w")
    text, document = vectors.schema["id"].dataType, vectors.schema["document_id"].dataType
    schema = T.StructType([T.StructField(c, T.DoubleType() if c == "score" else document if c.endswith("document") else text) for c in ("source_document", "target_document", "score", "source_id", "target_id")])
    parts, context = [], vectors.sparkSession.sparkContext
    asked = vectors if asked is None else asked.where("id IS NOT NULL AND document_id IS NOT NULL").select(*vectors.columns)
    for rows in search.blocks(asked, F.size("terms")):
        block = context.broadcast(_Block(rows))  # bounded by QUESTION_BLOCK and BLOCK_NUMBERS
        del rows

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            best, kinds = _BestPairs(block.value, number, decimals), None
            size = max(1, SCORE_NUMBERS // max(1, block.value.number))
            for whole in batches:
                kinds = whole.schema.field("id").type, whole.schema.field("document_id").type
                for start in range(0, whole.num_rows, size):
                    batch = whole.slice(start, size).sort_by([("document_id", "ascending"), ("id", "ascending")])
                    scores = block.value.scores(batch.column("terms"), batch.column("w"))
                    best.add(scores, batch.column("id").to_pylist(), batch.column("document_id").to_pylist())
            if kinds is not None:
                yield best.table(*kinds)

        parts.append(vectors.mapInArrow(run, schema))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # The best pair of a document may be in another task or block than its second best.
    once = found.groupBy("source_document", "target_document").agg(F.min(F.struct((-F.col("score")).alias("less"), "source_id", "target_id")).alias("x"))
    once = once.select("source_document", "target_document", (-F.col("x.less")).alias("score"), "x.source_id", "x.target_id")
    return best_targets(once, number, "source_document", "target_document")
