"""Search on a chunk table: dense cosine, BM25, and rank fusion, for many questions at once.

Questions are a query set against all points.  They are taken in blocks of bounded size; a task
holds a block (a matrix of unit vectors, or posting lists of its words) and scores every batch
of points against the whole block on arrays, keeping only each question's best.  So a pair of a
point and a question is never a row, and what is shuffled is ``k`` rows for each question and
task.  Filters are ordinary predicates, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions import text as X
from dossier.plans.shared import cut

#: Most questions of a block, most numbers of its matrix or posting lists, and points that are scored at once.
QUESTION_BLOCK, BLOCK_NUMBERS, POINT_ROWS = 4_000, 4_000_000, 512
#: Decimals of a score by which points are ranked, so that equal vectors have equal scores wherever they stand.
DECIMALS = 9


def dot(a, b) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 if a side is a zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def check_dimension(df: DataFrame, column: str, expected: int | None = None) -> int:
    """The one vector dimension of a column; an error for mixed, empty or unexpected dimensions."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(F.size(column)).distinct().limit(2).collect()]
    if len(found) != 1 or found[0] < 1 or (expected is not None and found[0] != expected):
        raise ValueError(f"vector dimensions {sorted(found)}, expected {expected or 'one positive'}")
    return found[0]


def unit_rows(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """A matrix of the vectors at unit length; nulls count as 0, null and zero vectors are zero rows, short vectors are filled up."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width or 0, int(sizes.max(initial=0)), 1)
    flat = pc.fill_null(lists.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=out, where=norms > 0)


class Best:
    """The ``k`` best points of each question so far; equal scores by the least id."""

    def __init__(self, questions: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0)] * questions, [[] for _ in range(questions)]
        self.bars = np.full(questions, -np.inf)

    def add(self, scores: np.ndarray, ids: list, least: float | None = None) -> None:
        """``scores`` (points, questions) of points ``ids``; with ``least``, only scores above it count."""
        scores = np.round(scores, DECIMALS)
        better = scores >= self.bars if least is None else (scores >= self.bars) & (scores > least)
        for question in np.flatnonzero(better.any(axis=0)):
            column, places = scores[:, question], np.flatnonzero(better[:, question])
            if len(places) > self.k:
                edge = np.partition(column[places], len(places) - self.k)[len(places) - self.k]
                places = places[column[places] >= edge]
            rows = [(-score, ids[place]) for score, place in zip(column[places].tolist(), places)]
            rows = sorted([*rows, *zip(-self.scores[question], self.ids[question])])[: self.k]
            self.scores[question] = np.array([-score for score, _ in rows])
            self.ids[question] = [point for _, point in rows]
            if len(rows) == self.k:
                self.bars[question] = self.scores[question][-1]

    def table(self, asked: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        sizes = [len(i) for i in self.ids]
        rows = asked.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        points = pa.array([point for found in self.ids for point in found], kind)
        return pa.RecordBatch.from_arrays([rows, points, pa.array(np.concatenate([*self.scores, np.empty(0)]))], names=["q", "p", "score"])


def blocks(questions: DataFrame, size: Column) -> Iterator[pa.Table]:
    """The questions in blocks of at most QUESTION_BLOCK rows whose sizes add up to about BLOCK_NUMBERS; each is read apart."""
    questions = cut(questions)
    total = questions.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("m")).first()
    number = max(1, -(-total["n"] * 5 // (4 * QUESTION_BLOCK)) if total["n"] > QUESTION_BLOCK else 1, -(-int(total["m"]) // BLOCK_NUMBERS))
    block = F.pmod(F.xxhash64(questions.columns[0]), F.lit(number))
    for k in range(number):
        yield (questions if number == 1 else questions.where(block == k)).toArrow()


def _top(best: DataFrame, question_id: str, point_id: str, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(question_id).orderBy(F.desc("score"), point_id))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(points: DataFrame, questions: DataFrame, size: Column, k: int, scorer: Callable[[pa.Table], Callable[[pa.RecordBatch], np.ndarray]], least: float | None = None) -> DataFrame:
    """(question, point, score, rank): all points (id, ...) against all questions (id, ...); ``scorer`` makes a block's scores of a batch."""
    question_id, point_id = questions.columns[0], points.columns[0]
    schema = T.StructType([T.StructField("q", questions.schema[0].dataType), T.StructField("p", points.schema[0].dataType), T.StructField("score", T.DoubleType())])
    points = points.where(F.col(point_id).isNotNull())
    parts, context = [], points.sparkSession.sparkContext
    for rows in blocks(questions.where(F.col(question_id).isNotNull()), size):
        block = context.broadcast((rows.column(0).combine_chunks(), scorer(rows)))  # bounded by QUESTION_BLOCK and BLOCK_NUMBERS

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            asked, score = block.value
            best, kind = Best(len(asked), k), None
            for whole in batches:
                kind = whole.column(0).type
                for start in range(0, whole.num_rows, POINT_ROWS):
                    batch = whole.slice(start, POINT_ROWS)
                    best.add(score(batch), batch.column(0).to_pylist(), least)
            if kind is not None:
                yield best.table(asked, kind)

        parts.append(points.mapInArrow(run, schema))
    found = reduce(DataFrame.unionByName, parts).select(F.col("q").alias(question_id), F.col("p").alias(point_id), "score")
    return _top(found, question_id, point_id, k)


class _Cosine:
    def __init__(self, questions: pa.Table):
        self.matrix = unit_rows(questions.column(1))

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        points = unit_rows(batch.column(1), self.matrix.shape[1])
        return points[:, : self.matrix.shape[1]] @ self.matrix.T


def dense_topk(points: DataFrame, questions: DataFrame, k: int, point_id: str = "id", question_id: str = "query_id", vector: str = "embedding", predicate: Column | None = None) -> DataFrame:
    """(question_id, point_id, score, rank): the ``k`` points most similar to each question; ties by id.

    Null ids are left out; a null or zero vector has the similarity 0 to everything.
    """
    if predicate is not None:
        points = points.where(predicate)
    asked = questions.select(question_id, vector)
    return _search(points.select(point_id, vector), asked, F.size(F.coalesce(vector, F.array().cast(asked.schema[1].dataType))), k, _Cosine)


class Cells:
    """An inverted-file index: unit centroids; each point belongs to the cell of the nearest."""

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    def nearest(self, rows: np.ndarray, number: int) -> np.ndarray:
        return np.argsort(-(rows @ self.centroids.T), axis=1, kind="stable")[:, :number]


def fit_cells(points: DataFrame, vector: str = "embedding", cells: int = 64, sample: int = 20_000, recall: float = 0.97, k: int = 10, rounds: int = 12) -> Cells:
    """Cells fitted by spherical k-means on at most ``sample`` points (the least hashes of their vectors).

    ``probes`` is the least number of cells that finds ``recall`` of the ``k`` nearest of 200 points of the sample within it.
    """
    chosen = points.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(F.to_json(vector) if not isinstance(points.schema[vector].dataType, T.ArrayType) else vector)).limit(sample)
    rows = unit_rows(chosen.toArrow().column(0))  # bounded by ``sample``
    if not len(rows):
        return Cells(np.zeros((1, 1)), 1)
    rng = np.random.default_rng(7)
    centroids = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = (rows @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    asked = rows[rng.choice(len(rows), min(200, len(rows)), replace=False)]
    own, made = (rows @ centroids.T).argmax(axis=1), Cells(centroids, len(centroids))
    best = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
    order = made.nearest(asked, len(centroids))
    place = (order[:, None, :] == own[best][:, :, None]).argmax(axis=2)  # how many cells come before that of each neighbour
    reached = np.array([(place < n).mean() for n in range(1, len(centroids) + 1)])
    made.probes = int(np.argmax(reached >= recall)) + 1
    return made


def index_cells(points: DataFrame, cells: Cells, vector: str = "embedding") -> DataFrame:
    """``points`` with the ``cell`` of each: all rows are indexed; written by cell, a search reads only the cells it probes."""
    at = points.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column(at), cells.centroids.shape[1])[:, : cells.centroids.shape[1]]
            nearest = cells.nearest(rows, 1)[:, 0] if len(rows) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32))], names=[*batch.schema.names, "cell"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())]))


class _Probed:
    def __init__(self, cells: Cells):
        self.cells = cells

    def __call__(self, questions: pa.Table) -> Callable[[pa.RecordBatch], np.ndarray]:
        matrix = unit_rows(questions.column(1), self.cells.centroids.shape[1])
        nearest = self.cells.nearest(matrix[:, : self.cells.centroids.shape[1]], self.cells.probes)
        probed = np.zeros((len(matrix), len(self.cells.centroids)), dtype=bool)
        probed[np.repeat(np.arange(len(matrix)), nearest.shape[1]), nearest.ravel()] = True
        return _InCells(matrix, probed)


class _InCells:
    def __init__(self, matrix: np.ndarray, probed: np.ndarray):
        self.matrix, self.probed = matrix, probed

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        rows, own = unit_rows(batch.column(1), self.matrix.shape[1]), batch.column(2).to_numpy()
        out = np.full((len(rows), len(self.matrix)), -np.inf)
        for cell in np.unique(own):
            asked, mine = np.flatnonzero(self.probed[:, cell]), np.flatnonzero(own == cell)
            if len(asked):
                out[np.ix_(mine, asked)] = rows[mine][:, : self.matrix.shape[1]] @ self.matrix[asked].T
        return out


def indexed_topk(index: DataFrame, cells: Cells, questions: DataFrame, k: int, point_id: str = "id", question_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """``dense_topk`` within the cells that each question probes; ``index`` as ``index_cells`` makes it."""
    asked = questions.select(question_id, vector)
    size = F.size(F.coalesce(vector, F.array().cast(asked.schema[1].dataType)))
    return _search(index.select(point_id, vector, "cell"), asked, size, k, _Probed(cells), least=-2.0)


WORDS = r"[\p{L}\p{N}]+"


def _words(c) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(WORDS), F.lit(0))


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, length): one row for each distinct word of each text."""
    long = chunks.select(F.col(id_col).alias("id"), _words(text_col).alias("terms")).select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return long.groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


class _Coded:
    """The words of texts as places in a list of words; words that aren't in it have none."""

    def __init__(self, terms: list[str]):
        self.places = {t: k for k, t in enumerate(terms)}

    def __call__(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each word or -1, bounds of each text)."""
        coded = lists.flatten().dictionary_encode()
        codes = np.array([self.places.get(t, -1) for t in coded.dictionary.to_pylist()], dtype=np.int64)
        bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        return codes[coded.indices.to_numpy()] if len(codes) else np.empty(0, np.int64), bounds


def frequencies(chunks: DataFrame, asked: list[str], text_col: str = "text") -> np.ndarray:
    """In how many texts each of the asked words (those of a block of questions) stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = _Coded(asked), np.zeros(len(asked), dtype=np.int64)
        for batch in batches:
            places, bounds = coder(batch.column(0))
            held = np.unique(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[places >= 0] * len(asked) + places[places >= 0])
            counts += np.bincount(held % len(asked), minlength=len(asked))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["place", "n"])

    out = np.zeros(len(asked), dtype=np.int64)
    if asked:
        for r in chunks.select(_words(text_col).alias("terms")).mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r["place"]] = r["n"]  # bounded by the block's words
    return out


class _Sparse:
    """BM25 of a block of questions: posting lists of the words they ask for."""

    def __init__(self, lists: list[list[str]], terms: list[str], weights: np.ndarray, k1: float, b: float, average: float):
        coder = _Coded(terms)
        pairs = sorted((coder.places[t], question) for question, words in enumerate(lists) for t in words)
        self.coder, self.weights, self.number = coder, weights, len(lists)
        self.asked = np.array([question for _, question in pairs], dtype=np.int64)
        self.sizes = np.bincount(np.array([place for place, _ in pairs], dtype=np.int64), minlength=len(terms))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.k1, self.b, self.average = k1, b, average

    def __call__(self, batch: pa.RecordBatch) -> np.ndarray:
        places, bounds = self.coder(batch.column(1))
        out = np.zeros((batch.num_rows, self.number))
        for n in range(batch.num_rows):
            mine = places[bounds[n] : bounds[n + 1]]
            terms, tf = np.unique(mine[mine >= 0], return_counts=True)
            if len(terms):
                scale = self.k1 * (1 - self.b + self.b * len(mine) / self.average)
                weight, sizes = self.weights[terms] * tf * (self.k1 + 1) / (tf + scale), self.sizes[terms]
                rows = np.repeat(self.starts[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                out[n] = np.bincount(self.asked[rows], np.repeat(weight, sizes), self.number)
        return out


def bm25_topk(chunks: DataFrame, questions: DataFrame, k: int, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75, average: float = 256.0) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` texts with the highest BM25 score of each question (query_id, text); only texts that hold a word of it.

    The texts are read once for the frequencies of a block's words and once for its scores; no posting is shuffled.
    """
    total = chunks.count()
    asked = questions.select("query_id", F.array_distinct(_words("text")).alias("terms"))

    def scorer(rows: pa.Table) -> _Sparse:
        lists = rows.column(1).to_pylist()
        terms = sorted({t for words in lists for t in words})
        counts = frequencies(chunks, terms, text_col)
        return _Sparse(lists, terms, np.log(1 + (total - counts + 0.5) / (counts + 0.5)), k1, b, average)

    return _search(chunks.select(F.col(id_col).alias("id"), _words(text_col).alias("terms")), asked, F.size("terms"), k, scorer, least=0.0)


def ranked(scores: DataFrame, limit: int, question: str = "query_id", item: str = "id", score: str = "score") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(question).orderBy(F.desc(score), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= limit)


def fuse(*rankings: DataFrame, constant: int = 60, question: str = "query_id", item: str = "id") -> DataFrame:
    """(question, item, score): reciprocal-rank fusion of rankings that have a ``rank``."""
    union = None
    for ranking in rankings:
        part = ranking.select(question, item, "rank")
        union = part if union is None else union.unionByName(part)
    # Rounded, so that the order in which ranks are added can't break a tie.
    return union.groupBy(question, item).agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("rank"))), 12).alias("score"))


def candidate_limit(limit: int, given: int | None = None) -> int:
    return given or max(20, 3 * limit)


def hybrid(points: DataFrame, questions: DataFrame, limit: int, given: int | None = None, predicate: Column | None = None) -> DataFrame:
    """Fusion of the dense and the BM25 ranking under the same filter; points have id, text, embedding, questions query_id, text, embedding."""
    kept = points if predicate is None else points.where(predicate)
    most = candidate_limit(limit, given)
    return ranked(fuse(dense_topk(kept, questions, most), bm25_topk(kept, questions, most)), limit)


def search(points: DataFrame, questions: DataFrame, mode: str = "auto", limit: int = 10, predicate: Column | None = None) -> DataFrame:
    """Ranking by mode ``dense``, ``bm25``, ``hybrid``, or ``auto``: hybrid where the points have a text."""
    sparse = "text" in points.columns
    if mode == "auto":
        mode = "hybrid" if sparse else "dense"
    if mode not in ("dense", "bm25", "hybrid"):
        raise ValueError("mode must be auto, dense, bm25 or hybrid")
    if mode != "dense" and not sparse:
        raise ValueError(f"{mode} search needs a text")
    kept = points if predicate is None else points.where(predicate)
    if mode == "dense":
        return dense_topk(kept, questions, limit)
    return hybrid(kept, questions, limit) if mode == "hybrid" else bm25_topk(kept, questions, limit)


def confirm(points: DataFrame, wanted: DataFrame, questions: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(query_id, id, score) of exactly the ``wanted`` (query_id, id) that exist under the filter."""
    kept = points if predicate is None else points.where(predicate)
    pairs = wanted.select("query_id", "id").distinct().join(questions.select("query_id", F.col("embedding").alias("__q")), "query_id")
    return kept.select("id", "embedding").join(pairs, "id").select("query_id", "id", cosine(F.col("__q"), F.col("embedding")).alias("score"))


def page(df: DataFrame, limit: int, after: str | None = None, key: str = "id") -> DataFrame:
    """A page of rows by key, one row more than ``limit`` so that the caller sees whether another follows."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit + 1)


def scroll(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """All chunks, or those of some documents, by document and place."""
    kept = chunks if documents is None else chunks.join(documents.select("document_id"), "document_id", "left_semi")
    return kept.orderBy("document_id", "chunk_index")


def article_of(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    """The article of each hit: by the chunk mapping, else from its section heading."""
    joined = hits.join(mapping.select(F.col("chunk_id").alias("id"), "article_id"), "id", "left")
    return joined.withColumn("article_id", F.coalesce("article_id", X.article_id("document_id", "section")))
